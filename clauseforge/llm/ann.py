"""Nearest neighbours, by inner product, by an inverted multi-index.

The two halves of each vector are quantised separately, so K centroids a half give
K*K cells; K grows with the square root of the rows, so that a cell keeps its size.
A half's distance to a centroid is minus the inner product that a member of it can be
expected to reach: the centroid's own and an allowance for the members' spread around
it.  For a query a heap yields centroid pairs by summed distance until their cells
hold ``share`` of a sample's distinct vectors; what they hold is reranked by the exact
inner product in double precision.

The codebooks are fitted on a bounded sample, and ``share`` is read from it: the part
of the cells, in each sampled query's order, that holds RECALL of the sampled queries'
true neighbours.  Every vector is indexed.  Cells are dealt into slabs of a fixed
number of rows, large cells into several; a query goes to the slabs that hold cells it
visits, and to no others."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauseforge.llm.labelled import sample_rows
from clauseforge.llm.storage import materialize

CELL = 48  # rows that a cell should have
LEAST, MOST = 8, 256  # centroids a half
SAMPLE = 16_384  # vectors that the codebooks are fitted on
TRIALS, RECALL = 256, 0.96  # sampled queries, and the part of their neighbours that visits must reach
SPREAD = 1.5  # standard deviations of a centroid's members along a query that are allowed for
SLAB, BLOCK = 16_384, 4_096  # rows of the index and queries that meet in a task
PAIRS = 1 << 20  # scores held at a time


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k centroids; deterministic.  Starts from rows spread over the
    distinct ones; an empty centroid keeps its place."""
    rows = np.unique(x, axis=0)
    k = max(1, min(k, len(rows)))
    if not len(rows):
        return np.zeros((1, x.shape[1]))
    c = rows[np.random.default_rng(5).permutation(len(rows))[:k]].astype(float)
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c**2).sum(1)).argmax(1)


def traverse(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) by rising d1[i] + d2[j], by the multi-sequence heap."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap = [(s1[0] + s2[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield o1[i], o2[j]
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))


class MultiIndex:
    """Two codebooks over the halves of vectors, the spread of each centroid's members
    and how many of the sample's distinct vectors each cell holds."""

    def __init__(self, sample: np.ndarray, k: int):
        sample = np.unique(sample, axis=0)
        self.half = sample.shape[1] // 2
        self.first, self.second = kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)
        self.spread = [self._spread(sample[:, : self.half], self.first), self._spread(sample[:, self.half :], self.second)]
        self.weight = np.bincount(self.cell(sample), minlength=self.cells) if len(sample) else np.zeros(self.cells, np.int64)

    @staticmethod
    def _spread(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The standard deviation of a centroid's members along a direction."""
        if not x.size:
            return np.zeros(len(c))
        near = nearest(x, c)
        off = ((x - c[near]) ** 2).mean(1)
        return np.sqrt(np.bincount(near, off, len(c)) / np.maximum(np.bincount(near, minlength=len(c)), 1))

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def cell(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.first) * len(self.second) + nearest(x[:, self.half :], self.second)

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a query's halves to the centroids; a cell's is the sum of its two."""
        halves = ((q[: self.half], self.first, self.spread[0]), (q[self.half :], self.second, self.spread[1]))
        one, two = (-(c @ x + SPREAD * np.sqrt((x**2).sum()) * s) for x, c, s in halves)
        return one, two

    def visits(self, q: np.ndarray, sizes: np.ndarray, share: float, least: int) -> np.ndarray:
        """Cells with rows, in the order of the heap, until the cells before hold more
        than ``share`` of the sample and, by ``sizes``, ``least`` rows."""
        d1, d2 = self.distances(q)
        out, seen, held, width = [], 0, 0, len(self.second)
        enough = share * self.weight.sum()
        for i, j in traverse(d1, d2):
            if seen > enough and held >= least:
                break
            at = i * width + j
            seen += self.weight[at]
            if sizes[at]:
                out.append(at)
                held += sizes[at]
        return np.array(out, np.int64)

    def share_for(self, sample: np.ndarray, k: int) -> float:
        """The share at which sampled queries reach RECALL of their k nearest in the
        sample; what is found there is nearer still among all rows."""
        sample = np.unique(sample, axis=0)
        if len(sample) < 2:
            return 1.0
        cells, total = self.cell(sample), max(int(self.weight.sum()), 1)
        found = []
        for i in np.random.default_rng(11).permutation(len(sample))[:TRIALS].tolist():
            scores = sample @ sample[i]
            scores[i] = -np.inf
            best = np.argsort(-scores, kind="stable")[: min(k, len(sample) - 1)]
            d1, d2 = self.distances(sample[i])
            order = np.argsort((d1[:, None] + d2[None]).ravel(), kind="stable")
            before = np.empty(self.cells)
            before[order] = np.cumsum(self.weight[order]) - self.weight[order]
            found.append(before[cells[best]] / total)
        return float(np.quantile(np.concatenate(found), RECALL, method="higher"))


def first_copies(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k + 1 smallest ids of each distinct vector: a query's k nearest, ties
    to the smaller id, need no more of one, itself left out."""
    same = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}").ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, same))
    starts = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return np.sort(order[rank <= k])


def rerank(q: np.ndarray, own: np.ndarray, on: np.ndarray, x: np.ndarray, ids: np.ndarray, cell: np.ndarray, k: int):
    """(query, id, score) of each query's k rows of the largest inner product in the
    cells it visits (``on[query, cell]``), ties to the smaller id.  Rows are sorted by
    cell and come cell by cell; candidates near the k-th best are scored again one row
    at a time, so equal vectors have equal scores."""
    best = np.full((len(q), k), -np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        asked = np.flatnonzero(on[:, cell[s]]) if e > s else np.zeros(0, np.int64)
        step = max(1, PAIRS // max(e - s, 1))
        for at in range(0, len(asked), step):
            a = asked[at : at + step]
            scores = q[a] @ x[s:e].T
            scores[own[a][:, None] == ids[None, s:e]] = -np.inf
            low = best[a, 0]
            i, j = np.nonzero((scores >= (low - 1e-9 * np.maximum(1.0, np.abs(low)))[:, None]) & (scores > -np.inf))
            found.append((a[i], s + j, scores[i, j]))
            hit = np.unique(i)
            best[a[hit]] = np.partition(np.concatenate([best[a[hit]], scores[hit]], 1), -k, 1)[:, -k:]
            best[a[hit], 0] = best[a[hit]].min(1)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    a, j, rough = (np.concatenate(c) for c in zip(*found, strict=True))
    low = best[a, 0]
    near = rough >= low - 1e-9 * np.maximum(1.0, np.abs(low))
    a, j = a[near], j[near]
    exact = np.concatenate([(x[j[t : t + PAIRS // 64]] * q[a[t : t + PAIRS // 64]]).sum(1) for t in range(0, max(len(a), 1), PAIRS // 64)])
    order = np.lexsort((ids[j], -exact, a))
    a, j, exact = a[order], j[order], exact[order]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
    return a[rank < k], ids[j[rank < k]], exact[rank < k]


def deal(sizes: np.ndarray, slab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cell its first slab and how many it has, and for each slab its first cell:
    neighbouring cells share a slab of about ``slab`` rows, a larger cell has several."""
    first, parts, starts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), [0]
    held = 0
    for at, n in enumerate(sizes.tolist()):
        if (held and held + n > slab) or (n > slab and starts[-1] != at):
            starts.append(at)
            held = 0
        first[at] = len(starts) - 1
        held += n
        if n > slab:
            parts[at] = -(-n // slab)
            starts += [at] * (int(parts[at]) - 1)
            starts.append(at + 1)
            held = 0
    return first, parts, np.array(starts, np.int64)


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, np.dtype]:
    """``(vec_id, vec binary)`` of the vectors that take part, and their length:
    the most common one (of equals the larger)."""
    dtype = np.dtype("f4") if "float" in vectors.schema[vec_col].dataType.simpleString() else np.dtype("f8")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0"
    )
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            x = v.flatten().cast(pa.float32() if dtype.itemsize == 4 else pa.float64())
            x = x.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
            with np.errstate(all="ignore"):
                good = np.isfinite(x).all(1) & (x != 0).any(1)
            x = x[good] + dtype.type(0)  # -0.0 becomes 0.0, so equal vectors have equal bytes
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(pa.array(good)), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "vec"]
            )

    clean = rows.where(F.size("v") == dim).mapInArrow(run, "vec_id long, vec binary")
    return clean, dim, dtype


def _matrix(column: pa.Array, dtype: np.dtype, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dim).astype(float)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    centroids: int | None = None,
    share: float | None = None,
    sample: int = SAMPLE,
    slab: int = SLAB,
    block: int = BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row with ``is_query`` (a
    condition on ``vec_id``) its k nearest of the other rows.

    Nearness is the inner product in double precision, ties to the smaller id;
    rank starts at 1.  Vectors that are null, zero, of another length than most, or
    hold a null or non-finite number take no part, nor do null ids; of rows that
    repeat an id the one of the least bytes counts.  Fewer than k candidates are all
    returned; no candidates or an empty table give no rows.  Where the visited
    cells hold fewer than k rows, more are visited.  ``share``: how much of the sample
    a query's cells hold, 1.0 for an exact search; by default it is read from the
    sample.  ``centroids`` a half follow from the rows.  Further columns are ignored."""
    spark = vectors.sparkSession
    clean, dim, dtype = _usable(vectors, id_col, vec_col)
    rows = clean.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    if dim == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = materialize(rows, "vectors")
    total = rows.count()
    picked = sample_rows(rows, "vec_id", sample).select("vec").toArrow()
    known = _matrix(picked["vec"], dtype, dim) if len(picked) else np.zeros((0, dim))
    index = MultiIndex(known, centroids or int(np.clip(np.sqrt(total / CELL), LEAST, MOST)))
    part = index.share_for(known, k) if share is None else share

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = index.cell(_matrix(b.column(1), dtype, dim)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell)], ["vec_id", "vec", "cell"])

    placed = materialize(rows.mapInArrow(place, "vec_id long, vec binary, cell int"), "multi-index")
    sizes = np.zeros(index.cells, np.int64)
    for cell, n in placed.groupBy("cell").count().collect():  # MOST * MOST rows at most
        sizes[cell] = n
    first, parts, starts = deal(sizes, slab)
    ends = np.r_[starts[1:], index.cells]
    ends = np.maximum(ends, starts + 1)  # the slabs of one large cell start at it, and hold it alone

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "vec", "slab", "visits"]
        for b in batches:
            for one, q in enumerate(_matrix(b.column(1), dtype, dim)):
                on = np.zeros(index.cells, bool)
                cells = index.visits(q, sizes, part, min(k + 1, total))
                on[cells] = True
                slabs = np.unique(np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in cells.tolist()])).tolist() if len(cells) else []
                bits = [np.packbits(on[starts[s] : ends[s]]).tobytes() for s in slabs]
                at = pa.array([one] * len(slabs), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(slabs, pa.int64()), pa.array(bits, pa.binary())], names)

    routed = materialize(placed.where(is_query).select("vec_id", "vec").mapInArrow(route, "vec_id long, vec binary, slab long, visits binary"), "routes")
    asked = routed.groupBy(F.col("slab").alias("s")).agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = spark.createDataFrame([(c, int(f), int(n)) for c, (f, n) in enumerate(zip(first, parts, strict=True))], "c int, first long, parts long")
    spread = placed.join(F.broadcast(dealt), F.col("cell") == F.col("c")).withColumn("slab", F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(11)), F.col("parts")))
    here = spread.join(asked, F.col("slab") == F.col("s")).select(
        "vec_id", "vec", "cell", F.lit(None).cast("binary").alias("visits"), "slab", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    )
    there = routed.join(asked, F.col("slab") == F.col("s")).select(
        "vec_id", "vec", F.lit(-1).alias("cell"), "visits", "slab", F.pmod(F.xxhash64("vec_id", F.lit(11)), F.col("blocks")).alias("block")
    )

    def meet(table: pa.Table) -> pa.Table:
        cell, ids, vec = table["cell"].to_numpy(), table["vec_id"].to_numpy(), table["vec"].combine_chunks()
        base, queries = int(starts[table["slab"][0].as_py()]), np.flatnonzero(cell < 0)
        here = np.flatnonzero(cell >= 0)
        here = here[np.lexsort((ids[here], cell[here]))]
        x = _matrix(vec.take(pa.array(here)), dtype, dim)
        kept = first_copies(x, ids[here], k) if len(here) else np.zeros(0, np.int64)
        x, here = x[kept], here[kept]
        visits = table["visits"].combine_chunks().take(pa.array(queries)).to_pylist()
        on = np.unpackbits(np.frombuffer(b"".join(visits), np.uint8).reshape(len(queries), -1), axis=1).astype(bool) if len(queries) else np.zeros((0, 1), bool)
        q = _matrix(vec.take(pa.array(queries)), dtype, dim)
        a, found, scores = rerank(q, ids[queries], on, x, ids[here], cell[here] - base, k)
        return pa.table([pa.array(ids[queries][a]), pa.array(found), pa.array(scores)], ["query_id", "vec_id", "score"])

    local = here.unionByName(there).groupBy("slab", "block").applyInArrow(meet, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
