"""Raw documents to training tokens: language ID, quality, near-dedup, mixing,
tokens.  Each stage works on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.llm import langid, mixing, quality_gbdt, sentencepiece_codec, simhash
from clauseforge.llm.queries import LANGUAGE_TARGETS
from clauseforge.llm.storage import discard, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts and those without a letter.  The
    others' ``lang`` becomes the language found, which the mixing goes by.  The classifier
    learns from the rows with a language."""
    return langid.keep_known(docs, langid.train(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below 0.3, as ``labels.quality`` teaches."""
    model = quality_gbdt.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_gbdt.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group linked by a
    similarity of 0.8 of five-word shingles.  Of rows that repeat an id and a text one
    stays; texts that only share an id all stay, as do rows without an id."""
    return simhash.first_of_groups(docs)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by their rates towards the target weights of the languages that
    the first stage found.  No rate is below 1, so every document stays, and the language
    with the most tokens for its target keeps its own; rows without an id stay once."""
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    mixed = mixing.mix(docs, labelled, LANGUAGE_TARGETS, raise_only=True)
    return mixing.repeat(docs, mixed)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document and whether they decode to its text, by its id."""
    return sentencepiece_codec.round_trip(docs)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("mixing", mix_languages),
    ("SentencePiece", tokens),
]

# Classifiers, fingerprints and a tokenizer are not SQL; tests/llm holds each stage
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
        if last is not None:
            discard(last)
        last = docs
    return docs
