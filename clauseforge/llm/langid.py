"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier over hashed byte n-grams
predicts each bit.  A text takes the codeword of the least loss, each bit's loss
weighted by how well its classifier does, and is flagged where two are close."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseforge.llm.labelled import sample_rows
from clauseforge.llm.storage import give_back, materialize

UNDETERMINED = "und"
BUCKETS = 1 << 12
ROWS_A_LANGUAGE, ROWS = 600, 4_000  # training rows, at most
FEW_LANGUAGES = 10_000  # whose sizes may be broadcast
BLOCK = 1 << 20  # bytes hashed at a time
PART = 256  # rows or columns of a training table worked on at a time
MARGIN = 0.1
_PERHAPS_LETTER = re.compile(r"[^\W\d_]")  # also numerals that \d leaves out
_NOT_WORDS = bytes.maketrans(bytes(range(9, 65)), b" " * 56)  # ASCII white space, digits and punctuation


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter by Unicode (category L)."""
    return any(m[0].isalpha() for m in _PERHAPS_LETTER.finditer(text or ""))


def _buckets(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of the text's byte 2- and 4-grams, in blocks."""
    for at in range(0, max(len(text) - 3, 0), BLOCK):
        b = np.frombuffer(text, np.uint8, min(BLOCK + 3, len(text) - at), at).astype(np.uint32)
        two = b[:-3] | b[1:-2] << np.uint32(8)
        four = two | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
        for h, salt in ((two, 2654435761), (four, 2246822519)):
            yield ((h + np.uint32(1)) * np.uint32(salt)) >> np.uint32(20)


def profile(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of a whole text's n-grams; None without a
    letter.  Letters are lower-cased; digits and punctuation count as spaces."""
    if not text or not has_letter(text):
        return None
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_NOT_WORDS) + b"  "
    counts = np.zeros(BUCKETS, np.int64)
    for h in _buckets(raw):
        counts += np.bincount(h, minlength=BUCKETS)
    counts[int(((0x2020 + 1) * 2654435761 & 0xFFFFFFFF) >> 20)] = 0  # two spaces say nothing
    return np.sqrt(counts / max(counts.sum(), 1)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """(languages, bits) of -1 and 1: the exhaustive code up to 6 languages, else
    the greedily most distant columns of a fixed random pool."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        return np.array([(1, *c) for c in product((1, -1), repeat=n - 1) if -1 in c], np.int8).T
    pool = np.where(np.random.default_rng(7).random((4000, n)) < 0.5, -1, 1).astype(np.int8)
    pool = pool[np.abs(pool.sum(1)) < n - 1]
    picked: list[np.ndarray] = []
    apart = np.zeros((n, n))
    for _ in range(max(15, int(np.ceil(6 * np.log2(n))))):
        gain = [(np.minimum(apart + (c[:, None] != c), 99)[~np.eye(n, dtype=bool)]).min() for c in pool[:400]]
        c = pool[int(np.argmax(gain))]
        pool = np.roll(pool, -400, 0)
        picked.append(c)
        apart += c[:, None] != c
    return np.array(picked, np.int8).T


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # (languages, bits)
    weight: np.ndarray  # (BUCKETS, bits)
    bias: np.ndarray
    trust: np.ndarray  # by bit, sums to 1

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, probability, whether it is ambiguous."""
        m = x @ self.weight + self.bias
        loss = (np.logaddexp(0, -m[:, None, :] * self.code[None]) * self.trust).sum(2)
        p = np.exp(-len(self.trust) * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        ranked = np.sort(p, 1)
        close = ranked[:, -1] - ranked[:, -2] < MARGIN if p.shape[1] > 1 else np.zeros(len(p), bool)
        return best, p[np.arange(len(p)), best].astype(float), close


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 300) -> Model:
    """A logistic classifier for each bit, fitted by accelerated gradient steps
    with the same weight on every language.  Deterministic."""
    code = codewords(len(languages))
    target = code[y].astype(np.float32)
    share = 1.0 / np.maximum(np.bincount(y, minlength=len(languages)), 1)
    w = (share[y] / share[y].sum()).astype(np.float32)[:, None]
    # in parts, without further tables of the size of x
    mean = np.concatenate([(x[:, s : s + PART] * w).sum(0) for s in range(0, x.shape[1], PART)])
    c = x - mean
    c *= 30
    beta, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    look, last = beta.copy(), beta.copy()
    squares = np.concatenate([c[:0, 0], *[(c[s : s + PART] ** 2).sum(1) for s in range(0, len(c), PART)]])
    step, l2 = 4.0 / max(float((squares * w[:, 0]).sum()), 1e-9), 1e-3
    for k in range(steps):
        m = c @ look + bias
        g = -target / (1 + np.exp(np.clip(target * m, -40, 40))) * w
        beta = look - step * (c.T @ g + l2 * look)
        bias -= g.sum(0)
        look, last = beta + k / (k + 3) * (beta - last), beta
    m = c @ beta + bias
    right = ((np.sign(m) == target) * w).sum(0).astype(float)
    trust = np.maximum(right - 0.5, 1e-3)
    return Model(languages, code, (beta * 30).astype(np.float32), (bias - 30 * mean @ beta).astype(np.float32), trust / trust.sum())


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = ROWS_A_LANGUAGE,
    rows: int = ROWS,
) -> Model:
    """Fit on labelled rows of ``docs``: of each language at most
    ``per_language`` and ``rows`` in all, those of the least hash of the id, and
    one of each language whatever the bound.
    Rows with a null language, id or text, or without a letter, are passed over before
    any is picked.  Whole texts are profiled on the executors, where they are; only what
    is not 0 of the sample's profiles comes to the driver."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, F.lit(29)).alias("h"), F.col(text_col).alias("text"))
    known = known.where("doc_id is not null and lang is not null").where(F.col("text").rlike(r"\p{L}")).drop("text")
    known = materialize(known, "languages")
    # the hash bound that leaves enough of each language, from counts alone, so that no
    # language's rows meet in one task
    sizes = known.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"))
    bound = F.ceil(F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("n")) * 1_000_003)
    sizes = materialize(sizes.select("of", bound.alias("bound")), "sizes")
    near = known.join(F.broadcast(sizes) if sizes.count() <= FEW_LANGUAGES else sizes, F.col("lang") == F.col("of")).where(F.pmod("h", F.lit(1_000_003)) < F.col("bound"))
    first = W.partitionBy("lang").orderBy("h", "doc_id")
    ranked = near.select("doc_id", "lang", F.row_number().over(first).alias("r")).where(F.col("r") <= per_language)
    ranked = materialize(ranked.select(F.col("doc_id").alias("t_id"), "r"), "picked")
    picked = sample_rows(ranked.select("t_id").distinct(), "t_id", rows).union(ranked.where("r = 1").select("t_id")).distinct()
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(x, lang.as_py()) for text, lang in zip(*b.columns, strict=True) if (x := profile(text.as_py())) is not None]
            places = [np.flatnonzero(x) for x, _ in found]
            columns = [[at.astype(np.uint16).tobytes() for at in places], [x[at].tobytes() for (x, _), at in zip(found, places, strict=True)]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.binary()) for c in columns], pa.array([k for _, k in found], pa.string())], ["at", "x", "lang"])

    got = (
        d.join(F.broadcast(picked), d["doc_id"] == picked["t_id"])
        .where("lang is not null")
        .select("text", "lang")
        .mapInArrow(run, "at binary, x binary, lang string")
        .toArrow()
    )
    x, y, languages = _table(got)
    del got
    model = fit(x, y, languages)
    del x
    give_back()
    return model


def _table(got: pa.Table) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Profiles, indices of their languages, and these, of rows (at, x, lang): the places
    and values of a profile that are not 0.  The rows' order is no part of the result."""
    told = got["lang"].to_pylist()
    languages = sorted(set(told))
    place = {k: i for i, k in enumerate(languages)}
    x, y = np.zeros((len(told), BUCKETS), np.float32), np.array([place[k] for k in told], np.int64)
    for row, at, value in zip(x, got["at"], got["x"], strict=True):
        row[np.frombuffer(at.as_buffer(), np.uint16)] = np.frombuffer(value.as_buffer(), np.float32)
    order = np.argsort(x.view(f"S{x.itemsize * BUCKETS}")[:, 0], kind="stable")  # by their bytes
    order = order[np.argsort(y[order], kind="stable")]
    return x[order], y[order], languages


def predict_batches(model: Model, column: int) -> Callable:
    """(languages, scores, ambiguous) of the texts in a batch's column."""

    def predict(b: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
        n = b.num_rows
        lang, score, close = [UNDETERMINED] * n, np.zeros(n), np.zeros(n, bool)
        texts = b.column(column)
        for at in range(0, n, 256):
            found = [(i, x) for i in range(at, min(at + 256, n)) if (x := profile(texts[i].as_py())) is not None]
            if found and model.languages:
                best, p, c = model.predict(np.array([x for _, x in found]))
                for (i, _), k, pk, ck in zip(found, best, p, c, strict=True):
                    lang[i], score[i], close[i] = model.languages[k], pk, ck
        return lang, score, close

    return predict


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` of every whole text, in one pass
    without a shuffle.  Null texts, and those without a letter, are ``und`` with
    score 0.  Repeated rows stay; further columns are ignored."""
    of = predict_batches(model, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, close = of(b)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean"
    )


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is in some language the model knows (not
    ``und``), with all their columns; ``lang_col`` is the language found, whatever stood
    there.  A model without languages keeps every text with a letter, as it is."""
    column, told = docs.columns.index(text_col), docs.columns.index(lang_col)
    of = predict_batches(model, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model.languages:
                found = of(b)[0]
                b = b.set_column(told, lang_col, pa.array(found, b.column(told).type))
                keep = [x != UNDETERMINED for x in found]
            else:
                keep = [has_letter(x.as_py()) for x in b.column(column)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
