"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted with numpy on a bounded sample of labelled rows and
flattened into arrays; every document walks all trees at once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseforge.llm.labelled import sample_rows

TRAIN_ROWS = 12_000  # labelled rows to fit on, at most
CUT = 0.3

_SYMBOLS = b"#*$%&|<>"
_PUNCTUATION = b".,;:!?'\"()-"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_END_MARK = re.compile(rb"[^\w\s\x80-\xff.,;:]{2,}(?=\s|$)")
_CAMEL = re.compile(rb"[a-z][A-Z]")
STATISTICS = (
    "log_bytes", "log_words", "log_lines", "bytes_a_word", "word_spread", "longest_word", "symbol_share", "punctuation_share",
    "upper_share", "digit_share", "non_ascii_share", "exclaim_share", "bar_share", "marked_words", "unique_words", "top_word",
    "unique_lines", "words_a_line", "repeated_pairs", "short_words", "camel_share", "full_stop_share",
)


def statistics(text: bytes | None) -> list[float]:
    """The statistics of a whole text in UTF-8; a null one counts as empty."""
    text = text or b""
    words = text.split()
    size, n = max(len(text), 1), max(len(words), 1)
    without: Callable[[bytes], int] = lambda chars: len(text) - len(text.translate(None, chars))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    pairs = len(words) - 1
    number = {w: i for i, w in enumerate(counts)}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    repeated = 1 - len(np.unique(ids[:-1] * len(number) + ids[1:])) / pairs if pairs > 0 else 0.0
    ascii_ = len(text.translate(None, bytes(range(128, 256))))
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), float(sizes.mean()), float(sizes.std()), float(sizes.max()),
        without(_SYMBOLS) / size, without(_PUNCTUATION) / size, without(_UPPER) / size, without(_DIGITS) / size,
        1 - ascii_ / size, text.count(b"!") / n, text.count(b"|") / n, len(_END_MARK.findall(text)) / n, len(counts) / n,
        max(counts.values(), default=0) / n, len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1), repeated,
        float((sizes <= 3).mean()), len(_CAMEL.findall(text)) / n, text.count(b".") / n,
    ]


@dataclass
class Trees:
    """Complete binary trees of one depth, as arrays (tree, node)."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray  # (tree, leaf)
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[row, self.feature[tree, at]] > self.cut[tree, at]
            at = 2 * at + 1 + right
        return self.base + self.value[tree, at - (2**self.depth - 1)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: float = 4.0
) -> Trees:
    """Boosting with the logistic loss; splits are sought in histograms of at
    most ``bins`` quantile bins a feature.  Deterministic.  Without rows every
    score is 0.5; with one class, near it."""
    n, m = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    feature, cut = np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf)
    value = np.zeros((trees, 2**depth))
    if n == 0 or y.min() == y.max():
        return Trees(feature[:1], cut[:1], value[:1], base, depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-6)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = node * bins + binned[:, j]
                gs, hs = (np.bincount(key, w, width * bins).reshape(width, bins).cumsum(1) for w in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain = gain[:, : len(e)]
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best = np.where(better, top, best)
                feature[t, first : first + width][better] = j
                cut[t, first : first + width][better] = e[at[better]]
            f, c = feature[t, first + node], cut[t, first + node]
            node = 2 * node + (x[np.arange(n), f] > c)
        gs, hs = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
        value[t] = -rate * gs / (hs + l2)
        margin += value[t][node]
    return Trees(feature, cut, value, base, depth)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS
) -> Trees:
    """Fit on at most ``rows`` of ``labels`` (least hash of the id first; null ids
    and labels are passed over); the statistics are taken from their whole texts
    on the executors and only they come to the driver."""
    picked = sample_rows(
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
            F.col(id_col).alias("t_id"), F.col(label_col).cast("double").alias("y")
        ),
        "t_id",
        rows,
    )
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    m = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(0)], float).reshape(-1, m)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * m + 1, m, np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([flat, b.column(1)], ["x", "y"])

    got = (
        d.join(F.broadcast(picked), d["doc_id"] == picked["t_id"])
        .select("text", "y")
        .mapInArrow(run, "x array<double>, y double")
        .toArrow()
    )
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, m) if len(got) else np.zeros((0, m))
    y = got["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # the rows' order is no part of the result
    return fit(x[order], y[order])


def score_batches(model: Trees, column: int) -> Callable:
    """scores of the binary texts in a batch's column."""

    def scores(b: pa.RecordBatch) -> np.ndarray:
        out = [np.zeros(0)]
        texts = b.column(column)
        for at in range(0, len(texts), 1024):
            x = np.array([statistics(t.as_py()) for t in texts[at : at + 1024]], float).reshape(-1, len(STATISTICS))
            out.append(model.score(x))
        return np.concatenate(out)

    return scores


def quality_scores(
    docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT
) -> DataFrame:
    """``(doc_id, score, predicted)`` of every whole text, in one pass without a
    shuffle.  Null and empty texts are scored alike, by an empty text's
    statistics.  Repeated rows stay; further columns are ignored."""
    of = score_batches(model, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = of(b)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double, predicted int"
    )


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score at least ``cut``, with all their columns."""
    at = docs.columns.index(text_col)
    of = score_batches(model, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = of(b.set_column(at, text_col, b.column(at).cast(pa.binary())))
            yield b.filter(pa.array(s >= cut))

    return docs.mapInArrow(run, docs.schema)
