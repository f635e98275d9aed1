"""Search by words and vectors at once, without a row for each pair of a query and a
document: documents are reduced to the counts of the words that queries ask for, and
meet all queries slice by slice."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseforge.operators.matching import _width
from clauseforge.operators.retrieval import K1, TERM, B, terms

#: Documents of a slice; queries of a block, and the words they may have in all (one
#: query with more is a block of its own).
SLICE, BLOCK, POSTINGS = 512, 256, 16_384
#: Texts of more characters are read word by word.
LONG = 1_000_000


def counted(vocabulary: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(item, text)`` in lower case -> ``(item, size, terms, counts)``: a text's number of
    words, and the words of the vocabulary with their counts."""
    word = re.compile(f"[{TERM}]+")

    def row(text: str) -> tuple[int, list[int], list[int]]:
        words = word.findall(text) if len(text) <= LONG else (m.group() for m in word.finditer(text))
        found = Counter(map(vocabulary.get, words))
        size = found.total()
        found.pop(None, None)
        ids = sorted(found)
        return size, ids, [found[i] for i in ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = [(None, [], []) if text is None else row(text) for text in part["text"].to_pylist()]
                size, ids, counts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part["item"], pa.array(size, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["item", "size", "terms", "counts"])

    return run


class Queries:
    """Queries in blocks.  Of each block: the number of its first query, how many there
    are, for each word where those that ask for it begin and who they are, and the
    vectors by their length."""

    def __init__(self, words: list[list[int]], vectors: list[list[float] | None], n_words: int):
        self.blocks, at = [], 0
        while at < len(words):
            end, size = at + 1, len(words[at])
            while end < len(words) and end - at < BLOCK and size + len(words[end]) <= POSTINGS:
                size += len(words[end])
                end += 1
            who = np.repeat(np.arange(end - at), [len(w) for w in words[at:end]])
            what = np.fromiter((i for w in words[at:end] for i in w), np.int64, len(who))
            starts = np.concatenate(([0], np.cumsum(np.bincount(what, minlength=n_words))))
            lengths: dict[int, list[int]] = {}
            for q, v in enumerate(vectors[at:end]):
                if v is not None:
                    lengths.setdefault(len(v), []).append(q)
            dense = {n: (np.array(qs), np.array([vectors[at + q] for q in qs], float)) for n, qs in lengths.items()}
            self.blocks.append((at, end - at, starts, who[np.argsort(what, kind="stable")], dense))
            at = end


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows of both; not finite where there is none."""
    with np.errstate(all="ignore"):
        norms = [np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (a, b)]
        return np.einsum("ik,jk->ij", a, b) / (norms[0][:, None] * norms[1])


def scores(part: pa.RecordBatch, queries: Queries, idf: np.ndarray, mean: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block, its first query and the BM25 scores and cosines of the slice's
    documents (down) and its queries (across); NaN where there is none."""
    lengths = pc.list_value_length(part["terms"]).to_numpy(zero_copy_only=False).astype(int)
    ids, tf = part["terms"].flatten().to_numpy().astype(int), part["counts"].flatten().to_numpy().astype(float)
    row = np.repeat(np.arange(part.num_rows), lengths)
    size = part["size"].fill_null(0).to_numpy(zero_copy_only=False)[row]
    weight = idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
    wide = pc.list_value_length(part["embedding"]).fill_null(0).to_numpy(zero_copy_only=False).astype(int)
    flat, ends = part["embedding"].flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(wide)
    for first, n, starts, who, dense in queries.blocks:
        asked = starts[ids + 1] - starts[ids]
        at = np.repeat(starts[ids] - np.cumsum(asked) + asked, asked) + np.arange(asked.sum())
        s = np.bincount(np.repeat(row * n, asked) + who[at], np.repeat(weight, asked), part.num_rows * n).reshape(-1, n)
        d = np.full(s.shape, np.nan)
        for length, (qs, vectors) in dense.items():
            if length and len(rows := np.flatnonzero(wide == length)):
                d[np.ix_(rows, qs)] = cosines(flat[(ends[rows] - length)[:, None] + np.arange(length)], vectors)
        yield first, np.where(s > 0, s, np.nan), np.where(np.isfinite(d), d, np.nan)


def ranges(queries: Queries, idf: np.ndarray, mean: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(query, s_low, s_high, d_low, d_high)`` of all documents of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(n for _, n, *_ in queries.blocks)
        found = np.array([[np.inf], [-np.inf], [np.inf], [-np.inf]]).repeat(total, 1)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for first, s, d in scores(batch.slice(at, SLICE), queries, idf, mean):
                    here = found[:, first : first + s.shape[1]]
                    for k, x in ((0, s), (2, d)):
                        here[k] = np.fmin(here[k], np.fmin.reduce(x, axis=0))
                        here[k + 1] = np.fmax(here[k + 1], np.fmax.reduce(x, axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total)), *map(pa.array, found)], ["query", "s_low", "s_high", "d_low", "d_high"])

    return run


def scaled(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """To 0..1; 1 where all are equal, 0 where there is none."""
    with np.errstate(all="ignore"):
        return np.where(np.isnan(x), 0.0, np.where(high > low, (x - low) / (high - low), 1.0))


def best(queries: Queries, idf: np.ndarray, mean: float, bounds: np.ndarray, k: int, alpha: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(query, item, score)``: the k best items of a partition for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field("item").type
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                named = [(False,) if x is None else (True, x) for x in part["item"].to_pylist()]
                order = sorted(range(len(named)), key=named.__getitem__)
                firsts = [p for p, r in enumerate(order) if not p or named[r] != named[order[p - 1]]]
                names = [named[order[p]] for p in firsts]
                for first, s, d in scores(part, queries, idf, mean):
                    s_low, s_high, d_low, d_high = bounds[:, first : first + s.shape[1]]
                    f = np.where(np.isnan(s) & np.isnan(d), -1.0, alpha * scaled(d, d_low, d_high) + (1 - alpha) * scaled(s, s_low, s_high))
                    f = np.maximum.reduceat(f[order], firsts, axis=0)
                    by = np.round(f, 9)
                    # what is below the k-th of the slice, or of those held, cannot be among the best
                    bar = np.partition(by, max(len(by) - k, 0), axis=0)[max(len(by) - k, 0)]
                    for j in range(f.shape[1]):
                        old = held.get(first + j, [])
                        low = max(bar[j], 0.0, -old[-1][0] if len(old) == k else 0.0)
                        if len(new := np.flatnonzero(by[:, j] >= low)):
                            new = new[np.lexsort((new, -by[new, j]))][:k]
                            seen: dict[tuple, tuple] = {}
                            for x in sorted([*old, *((-by[i, j], names[i], f[i, j]) for i in new)], key=lambda x: x[:2]):
                                seen.setdefault(x[1], x)
                            held[first + j] = list(seen.values())[:k]
        rows = [(q, x[1][-1] if x[1][0] else None, x[2]) for q, xs in held.items() for x in xs]
        if rows:
            q, items, f = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(items, kind), pa.array(f, pa.float64())], ["query", "item", "score"])

    return run


def usable(vector: str) -> Column:
    """Whether all components are finite numbers and one is not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return ~odd & F.exists(vector, lambda x: x != 0)


def hybrid_top_k(docs: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """``docs(item, text)``, ``queries(query, text)``, ``vectors(id, embedding)``, where items
    and queries have the vectors of their ids -> ``(query, item, score, place)``: of every
    document that shares a word with the query or has a vector where it has one, the k best
    by ``retrieval.fuse`` of BM25 and cosine, compared to nine digits, ties to the smaller
    item.  Vectors with null or non-finite components or of zeros take no part; of rows
    that repeat a vector's id the least counts, of documents that repeat an item the
    best, and rows that repeat a query are one with the words of all.

    Every worker holds all queries; their words, vectors and k results pass the driver.
    The counts of documents stay on the executors' disks until the results are found."""
    spark = docs.sparkSession
    one = vectors.where(F.col("id").isNotNull() & usable("embedding")).groupBy("id").agg(F.min("embedding").alias("embedding"))
    asked: dict = {}
    for r in queries.select("query", F.array_distinct(terms(F.col("text"))).alias("t")).join(one, F.col("query") == F.col("id"), "left").select("query", "t", "embedding").collect():
        asked.setdefault(r["query"], ([], r["embedding"]))[0].extend(r["t"] or [])
    vocabulary = {t: i for i, t in enumerate(sorted({t for words, _ in asked.values() for t in words}))}
    table = Queries([[vocabulary[t] for t in words] for words, _ in asked.values()], [v for _, v in asked.values()], len(vocabulary))

    item, ints = T.StructField("item", docs.schema["item"].dataType), T.ArrayType(T.IntegerType())
    form = T.StructType([item, T.StructField("size", T.LongType()), T.StructField("terms", ints), T.StructField("counts", ints)])
    even = docs.select("item", "text").repartition(_width(docs), "item", "text")
    counts = even.select("item", F.lower("text").alias("text")).mapInArrow(counted(vocabulary), form)
    kept = counts.join(one, F.col("item") == F.col("id"), "left").select("item", "size", "terms", "counts", "embedding").persist(StorageLevel.DISK_ONLY)
    try:
        whole = kept.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
        df = np.zeros(len(vocabulary))
        for r in kept.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r["term"]] = r["count"]
        idf, mean = np.log(1 + (whole["n"] - df + 0.5) / (df + 0.5)), whole["mean"] or 1.0

        bounds = np.array([[np.inf], [-np.inf], [np.inf], [-np.inf]]).repeat(len(asked), 1)
        span = kept.mapInArrow(ranges(table, idf, mean), "query long, s_low double, s_high double, d_low double, d_high double")
        for r in span.groupBy("query").agg(F.min("s_low"), F.max("s_high"), F.min("d_low"), F.max("d_high")).collect():
            bounds[:, r[0]] = r[1:]

        form = T.StructType([T.StructField("query", T.LongType()), item, T.StructField("score", T.DoubleType())])
        found = kept.mapInArrow(best(table, idf, mean, bounds, k, alpha), form).groupBy("query", "item").agg(F.max("score").alias("score"))
        w = W.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "item")
        rows = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).collect()
    finally:
        kept.unpersist()
    names = list(asked)
    out = T.StructType([T.StructField("query", queries.schema["query"].dataType), *form.fields[1:], T.StructField("place", T.IntegerType())])
    return spark.createDataFrame([(names[r["query"]], *r[1:]) for r in rows], out)
