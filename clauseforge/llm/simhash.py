"""Near-duplicate detection with 64-bit SimHash fingerprints.

Fingerprints are compared exactly.  Equal ones collapse first, so a group of
copies is one row.  Each distinct fingerprint is a resident of the cell of its
population counts (upper and lower half) and visits the cells that follow within the
radius; residents and visitors of a cell are dealt into blocks of a bounded size, and
a task compares one block with another tile by tile with numpy exclusive-or and bit
counts, skipping tile pairs whose population counts (of four 16-bit words) differ
beyond the radius.  A task returns a spanning forest of the links it found, never all
pairs; components come from those forests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from clauseforge.llm.components import connected_components
from clauseforge.llm.storage import give_back, materialize

SEED = 42
TILE = 1024
BLOCK = 1 << 15  # shingles hashed at a time, whatever the text's length


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of a whole text: ASCII-lower-cased words, ``width``-word shingles
    with repeats (fewer words: the whole sequence).  No word: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, n, total = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array(
            [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)],
            np.uint64,
        )
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp long)`` of every row, in one pass without a shuffle; fp holds
    the unsigned 64 bits as a signed long.  A null or empty text has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), width) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp long"
    )


def _parts(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit words."""
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)


class _Forest:
    """Union-find over a cell's rows; the root is the row with the least rep."""

    def __init__(self, rep: np.ndarray):
        self.rep, self.up = rep, np.arange(len(rep))

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while (n := self.up[r]).tolist() != r.tolist():
            r = n
        self.up[x] = r
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            far = a != b
            if not far.any():
                return
            a, b = a[far], b[far]
            swap = self.rep[a] < self.rep[b]
            low, high = np.where(swap, a, b), np.where(swap, b, a)
            high, first = np.unique(high, return_index=True)  # each root hangs on one other at a time
            self.up[high] = low[first]


def near_tiles(fps: np.ndarray, resident: np.ndarray, radius: int, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (indices) of a resident and a visitor within ``radius`` bits, tile pair by
    tile pair."""
    parts = _parts(fps)
    order = np.lexsort((*parts.T, ~resident))  # residents first, each by its words' population counts
    fps, parts, n_res = fps[order], parts[order], int(resident.sum())
    here = [(s, min(s + tile, n_res)) for s in range(0, n_res, tile)]
    there = [(s, min(s + tile, len(fps))) for s in range(n_res, len(fps), tile)]
    if not here or not there:
        return
    low = np.array([parts[s:e].min(0) for s, e in there])
    high = np.array([parts[s:e].max(0) for s, e in there])
    for s, e in here:
        gap = np.maximum(0, np.maximum(parts[s:e].min(0) - high, low - parts[s:e].max(0))).sum(1)
        for j in np.flatnonzero(gap <= radius):
            p, q = there[j]
            a, b = np.nonzero(np.bitwise_count(fps[s:e, None] ^ fps[None, p:q]) <= radius)
            if len(a):
                yield order[a + s], order[b + p]


def link_block(fps: np.ndarray, resident: np.ndarray, radius: int = 3, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """The links of ``near_tiles`` as a forest: edges of fingerprints, as signed longs."""
    names, place = np.unique(fps.view(np.int64), return_inverse=True)
    forest = _Forest(names)
    for a, b in near_tiles(fps, resident, radius, tile):
        forest.link(place[a], place[b])
    root = forest.roots(np.arange(len(names)))
    moved = root != np.arange(len(names))
    return names[moved], names[root[moved]]


def _by_group(df: DataFrame, n_keys: int, each: Callable, schema: str) -> DataFrame:
    """Deal rows by their first ``n_keys`` columns (longs), and call ``each`` with the
    other columns of a group at a time (a pyarrow Table); it returns a RecordBatch or
    None.  A task holds one group at a time."""
    keys = df.columns[:n_keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None
        for b in batches:
            key = np.stack([c.to_numpy() for c in b.columns[:n_keys]], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                now = tuple(key[s].tolist())
                if held and now != last:
                    if (out := each(pa.Table.from_batches(held).select(range(n_keys, b.num_columns)))) is not None:
                        yield out
                    held = []
                last = now
                held.append(b.slice(s, e - s))
        if held and (out := each(pa.Table.from_batches(held).select(range(n_keys, held[0].num_columns)))) is not None:
            yield out
        held = []
        give_back()

    width = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return df.repartition(width, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _edges(found) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"]) if len(found[0]) else None


def near_links(distinct: DataFrame, radius: int = 3, rows_per_block: int = 8_192) -> DataFrame:
    """``distinct(fp)``, one row per fingerprint -> edges ``(a, b)`` that connect
    exactly the fingerprints within ``radius`` bits.

    Cells are (count of the upper half, count of the lower half), 33 * 33 at most, so
    their sizes may come to the driver.  A cell of r residents and v visitors (its own
    rows are among them) has ceil(r / rows_per_block) * ceil(v / rows_per_block) tasks'
    worth of blocks, at every size."""
    hi, lo = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF))
    counted = distinct.select("fp", hi.alias("hi"), lo.alias("lo"))
    sizes = {(r["hi"], r["lo"]): r["n"] for r in counted.groupBy("hi", "lo").agg(F.count("*").alias("n")).collect()}
    offsets = [(x, y) for x in range(0, radius + 1) for y in range(-radius, radius + 1) if x + abs(y) <= radius and (x > 0 or y >= 0)]
    blocks = [
        (100 * x + y, -(-n // rows_per_block), -(-sum(sizes.get((x - i, y - j), 0) for i, j in offsets) // rows_per_block)) for (x, y), n in sizes.items()
    ]
    dealt = F.broadcast(distinct.sparkSession.createDataFrame(blocks, "cell int, ni long, nj long"))
    part = lambda n, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), F.col(n))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    moves = F.explode(F.array(*[F.lit(100 * x + y) for x, y in offsets]))
    residents = counted.select("fp", (F.col("hi") * 100 + F.col("lo")).alias("cell")).join(dealt, "cell").select("cell", part("ni", 1).alias("i"), span("nj").alias("j"), "fp", F.lit(True).alias("resident"))
    near = counted.select("fp", "hi", "lo", moves.alias("o")).select("fp", (F.col("hi") * 100 + F.col("lo") + F.col("o")).alias("cell"))
    visitors = near.join(dealt, "cell").select("cell", span("ni").alias("i"), part("nj", 2).alias("j"), "fp", F.lit(False).alias("resident"))
    key = F.col("cell") * F.lit(1 << 48) + F.col("i") * F.lit(1 << 24) + F.col("j")

    def each(t: pa.Table) -> pa.RecordBatch | None:
        return _edges(link_block(t["fp"].to_numpy().view(np.uint64), t["resident"].to_numpy(), radius))

    return _by_group(residents.unionByName(visitors).select(key.alias("key"), "fp", "resident"), 1, each, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    ``fingerprint``: 16 lower-case hex digits.  ``component_id``: the smallest
    doc_id reachable over links of at most ``radius`` differing bits.  Ids are
    longs.  Null, empty and blank texts have fingerprint 0 and link like any
    other.  Rows with a null id are returned and linked, and link others; they never
    name a component, which is null where a group has no other id.  Repeated rows stay
    repeated.  An empty table gives no rows.  Further columns are ignored."""
    rows = materialize(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    labels = connected_components(near_links(distinct.select("fp"), radius))
    linked = distinct.join(labels, distinct["fp"] == labels["node"])
    names = linked.groupBy(F.col("component").alias("c")).agg(F.min("rep").alias("least"))
    named = labels.join(names, labels["component"] == names["c"]).select("node", "least")
    by_fp = distinct.join(named, distinct["fp"] == named["node"], "left").select(
        F.col("fp").alias("k"), F.when(F.col("node").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id")
    )
    return rows.join(by_fp, rows["fp"] == by_fp["k"], "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def text_key(text: bytes | None) -> bytes:
    """Equal for texts that are equal but for case (ASCII) and white space."""
    return xxhash.xxh3_128_digest(b" ".join((text or b"").lower().split()))


@F.arrow_udf(BinaryType())
def text_keys(texts: pa.Array) -> pa.Array:
    """``text_key`` of a column of binary texts."""
    return pa.array([text_key(x.as_py()) for x in texts], pa.binary())


def shingle_hashes(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a whole text's word shingles (fewer words: of the
    whole sequence; no word: none)."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64))


CERTAINTY = 64  # in bits: as many as a shingle's hash has
SOME = 8  # rarest and commonest keys that proposals go by
COMMON, SAMPLE = 1 << 16, 32  # frequent shingles that are put last, and one in how many documents tells them
BITS = 512  # of a set's parities, at least


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, with their ranks from 1 by falling rarity, in a
    sample.  They only order shingles, so a sample costs no pair; those in fewer than one
    of COMMON sampled texts are left out before any are sorted."""
    least = max(2.0, texts.count() / SAMPLE / COMMON)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_hashes(x.as_py(), width) for x in b.column(1)]
            k, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "n"])

    some = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SAMPLE)) == 0).mapInArrow(run, "k long, n long")
    top = some.groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > least).orderBy(F.desc("n"), "k").limit(COMMON).toArrow()
    k = top["k"].to_numpy().view(np.uint64)
    order = np.argsort(k)
    return k[order], (len(k) - np.arange(len(k)))[order]


def rare_first(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """The hashes in one order for all texts, common ones last, the most frequent at the
    end; and how many are not common."""
    if not len(common[0]):
        return hashes, len(hashes)
    at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
    rank = np.where(common[0][at] == hashes, common[1][at], 0)
    return hashes[np.lexsort((hashes, rank))], int((rank == 0).sum())


def prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first hashes of a set, in the order of ``rare_first``, of which two sets of
    ``similarity`` share one.

    The first n - ceil(similarity * n) + 1 always do.  Fewer do in all likelihood: of two
    such sets' union at most (1 / similarity - 1) * n elements are not in both, and the r
    that are not common stand in the order of their hashes, so one of the first k is in
    neither or one only with a chance of (1 / similarity - 1) * n / r each.  k makes that
    a chance of 2^-CERTAINTY for all of them, or 2^-50 where the other text is so much
    shorter that its certain number is below k."""
    if not len(hashes):
        return hashes
    n = len(hashes)
    ordered, rare = rare_first(hashes, common)
    most = n - int(np.ceil(similarity * n - 1e-6)) + 1
    odds = rare / ((1 / similarity - 1) * n) if similarity < 1 else np.inf
    return ordered[: min(most, int(np.ceil(CERTAINTY / np.log2(odds)))) if odds > 1 else most]


def parities(hashes: np.ndarray) -> bytes:
    """For each of BITS classes of hashes, or of as many as there are hashes (a power of two),
    whether their number is odd.  Two sets differ in as many elements, at least, as
    these bits do."""
    n = max(BITS, 1 << (max(len(hashes), 1) - 1).bit_length())
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % n, minlength=n) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _differ(bits: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many parities rows a and b differ; the longer ones are folded to the
    shorter, which gives the parities of fewer classes."""
    words = [np.frombuffer(x, np.uint64) for x in bits]
    sizes = np.array([len(w) for w in words])
    least, out = np.minimum(sizes[a], sizes[b]), np.zeros(len(a), np.int64)
    for n in np.unique(least).tolist():
        here = np.flatnonzero(least == n)
        used, place = np.unique(np.concatenate([a[here], b[here]]), return_inverse=True)
        folded = np.array([np.bitwise_xor.reduce(words[k].reshape(-1, n), axis=0) for k in used.tolist()])
        p, q = place[: len(here)], place[len(here) :]
        for at in range(0, len(here), 1 << 14):
            s = slice(at, at + (1 << 14))
            out[here[s]] = np.bitwise_count(folded[p[s]] ^ folded[q[s]]).sum(1, dtype=np.int64)
    return out


def possible_pairs(t: pa.Table, similarity: float, best: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (node, component, size, at, bits, x, own) that share the shingle in place
    ``at`` of their order, the pairs of two components that sizes, places and
    parities do not rule out; ``best``: of each row the one of the most alike parities
    and the one with the smallest node."""
    node, comp, size, at, x, own = (t[c].to_numpy() for c in ("node", "component", "size", "at", "x", "own"))
    bits = t["bits"].to_pylist()
    resident = own | (x == x.min())
    within, out = bool(own.any()), [(node[:0], node[:0])]
    right = np.arange(len(node)) if within else np.flatnonzero(~resident)
    step = max(1, (1 << 20) // max(len(right), 1))
    left = np.flatnonzero(resident)
    for k in range(0, len(left), step):
        i = left[k : k + step, None]
        both = size[i] + size[right]
        need = similarity / (1 + similarity) * both - 1e-6
        ok = (comp[i] != comp[right]) & (np.minimum(size[i] - at[i], size[right] - at[right]) >= need)
        ok &= np.minimum(size[i], size[right]) >= similarity * np.maximum(size[i], size[right]) - 1e-6
        a, b = np.nonzero(ok)
        a, b = i[a, 0], right[b]
        differ = _differ(bits, a, b)
        fits = (size[a] + size[b] - differ) / 2 >= similarity / (1 + similarity) * (size[a] + size[b]) - 1e-6
        if best:
            order = np.lexsort((node[b], differ / (size[a] + size[b]), a, ~fits))[: int(fits.sum())]
            least = np.lexsort((node[b], a, ~fits))[: int(fits.sum())]
            fits = np.concatenate([o[np.unique(a[o], return_index=True)[1]] for o in (order, least)])
        out.append((np.minimum(node[a], node[b])[fits], np.maximum(node[a], node[b])[fits]))
    pairs = np.unique(np.stack([np.concatenate(o) for o in zip(*out, strict=True)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _alike(pairs: DataFrame, distinct: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` of nodes whose texts have a Jaccard similarity of at least
    ``similarity``.  Texts are hashed where they are; a pair's two sets meet in joins
    whose skewed partitions may be split."""
    asked = pairs.select(F.col("a").alias("asked")).union(pairs.select("b")).distinct()
    wanted = distinct.join(asked, distinct["node"] == F.col("asked")).select("node", "rep", "key")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sets = [], []
            for node, key, text in zip(*b.columns, strict=True):
                if text_key(text.as_py()) == key.as_py():  # an id may have several texts
                    nodes.append(node.as_py())
                    sets.append(shingle_hashes(text.as_py(), width).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "hashes"])
        give_back()

    met = texts.join(wanted.hint("merge"), texts["doc_id"] == F.col("rep")).select("node", "key", "text")
    sets = materialize(met.mapInArrow(hashes, "node long, hashes binary").groupBy("node").agg(F.any_value("hashes").alias("hashes")), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike = []
            for p, q in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(h.as_buffer(), np.uint64) for h in (p, q))
                least, most = sorted((len(x), len(y)))
                both = int(np.isin(x, y, assume_unique=True, kind="sort").sum()) if least >= similarity * most else 0
                alike.append(both > 0 and both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(alike, pa.bool_()))
        give_back()

    one, two = (sets.select(F.col("node").alias(f"{k}_node"), F.col("hashes").alias(f"{k}_hashes")) for k in "ab")
    told = pairs.join(one.hint("merge"), F.col("a") == F.col("a_node")).join(two.hint("merge"), F.col("b") == F.col("b_node"))
    return told.select("a", "b", "a_hashes", "b_hashes").mapInArrow(compare, "a long, b long")


def _close_pairs(distinct: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: a forest of the nodes whose fingerprints differ in ``radius`` bits at most."""
    firsts = materialize(distinct.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    edges = near_links(firsts.select("fp"), radius)
    one, two = (firsts.select(F.col("fp").alias(f"{k}_fp"), F.col("first").alias(f"{k}_first")) for k in "ab")
    by_bits = edges.join(one, F.col("a") == F.col("a_fp")).join(two, F.col("b") == F.col("b_fp")).select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    same = distinct.select("node", "fp").join(one, F.col("fp") == F.col("a_fp")).select(F.col("a_first").alias("a"), F.col("node").alias("b"))
    return by_bits.union(same).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sharing_pairs(distinct: DataFrame, labels: DataFrame | None, similarity: float, rows_per_block: int) -> DataFrame:
    """``(a, b)`` of nodes that may have ``similarity``: every such pair of different
    components, or without ``labels`` a few for each node, the likeliest of a block.

    A prefix filter: in one order of all shingles, two such texts share one of their
    first, their ``keys`` (see ``prefix``).  Shingles that many texts share come last,
    a large group of texts meets in blocks, and sizes, places and parities rule out most
    of the rest.  Without labels only SOME rarest and commonest keys count, which small
    and large groups share, and blocks do not meet, so work and pairs follow the rows,
    however large a group is."""
    if labels is None:
        least = F.array_distinct(F.concat(F.slice("keys", 1, SOME), F.slice("keys", F.greatest(F.size("keys") - SOME, F.lit(0)) + 1, SOME)))
        met = distinct.where(F.size("keys") > 0).select(F.col("node").alias("m_node"), F.col("node").alias("component"), F.lit(0).alias("at"), F.explode(least).alias("shingle"))
    else:
        label = labels.select(F.col("node").alias("l_node"), F.col("component").alias("l_component"))
        known = distinct.join(label.hint("merge"), distinct["node"] == F.col("l_node"), "left").withColumn("component", F.coalesce("l_component", "node"))
        met = known.select(F.col("node").alias("m_node"), "component", F.posexplode("keys").alias("at", "shingle"))
    groups = met.groupBy(F.col("shingle").alias("s")).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high")
    mixed = met.join(groups, F.col("shingle") == F.col("s")).select("shingle", "m_node", "component", F.col("at").cast("long").alias("at"), F.ceil(F.col("n") / rows_per_block).alias("blocks"))
    rows = mixed.join(distinct.select("node", "size", "bits").hint("merge"), F.col("m_node") == F.col("node"))
    rows = rows.withColumn("x", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("y", F.col("x") if labels is None else F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = rows.select("shingle", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "node", "component", "size", "at", "bits", "x", (F.col("x") == F.col("y")).alias("own"))
    few = labels is None
    return _by_group(dealt, 3, lambda t: _edges(possible_pairs(t, similarity, few)) if len(t) > 1 else None, "a long, b long").distinct()


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    radius: int = 3,
    rows_per_block: int = 2_000,
) -> DataFrame:
    """``(doc_id, key, component_id, first_key)`` of every row with an id: groups linked
    by a Jaccard similarity of word shingles of at least ``similarity``.

    ``component_id`` is the smallest doc_id of the group and ``first_key`` the ``key`` of
    its text (the least, where that id has several in the group); both name the group,
    since an id may have texts in several.  SimHash and some shingles
    propose pairs, as many as rows, whose shingles then decide; the components
    they make leave few pairs for the exact search that adds every other one.  Texts equal but for case
    and white space collapse first.  A text without words is like any other such text.
    Null ids take no part."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    common = common_shingles(texts, width)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "fp", "size", "bits", "keys"]
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                words = [x.as_py() for x in part.column(1)]
                sets = [shingle_hashes(t, width) for t in words]
                first = [prefix(h, common, similarity) for h in sets]
                ends = pa.array(np.cumsum([0, *map(len, first)]), pa.int64())
                keys = pa.LargeListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)))
                columns = [
                    part.column(0), pa.array([text_key(t) for t in words], pa.binary()), pa.array(np.array([fingerprint(t) for t in words], np.uint64).view(np.int64)),
                    pa.array([len(h) for h in sets], pa.int64()), pa.array([parities(h) for h in sets], pa.binary()), keys.cast(pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
            give_back()

    marked = materialize(texts.mapInArrow(mark, f"doc_id {kind}, key binary, fp long, size long, bits binary, keys array<long>"), "marked")
    once = marked.groupBy("key").agg(F.min("doc_id").alias("rep"), *[F.any_value(c).alias(c) for c in ("fp", "size", "bits", "keys")])
    distinct = materialize(once.withColumn("node", F.monotonically_increasing_id()), "distinct")  # numbered as written
    likely = materialize(_close_pairs(distinct, radius).union(_sharing_pairs(distinct, None, similarity, rows_per_block)).distinct(), "likely")
    labels = materialize(connected_components(_alike(likely, distinct, texts, width, similarity)), "labels")
    pairs = materialize(_sharing_pairs(distinct, labels, similarity, rows_per_block), "remaining")
    rest = _alike(pairs, distinct, texts, width, similarity)
    labels = connected_components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest))
    grouped = distinct.select("key", "rep", "node").join(labels.withColumnRenamed("node", "l"), F.col("node") == F.col("l"), "left")
    grouped = grouped.select("key", "rep", F.coalesce("component", "node").alias("component"))
    firsts = grouped.groupBy(F.col("component").alias("c")).agg(F.min(F.struct("rep", "key")).alias("first"))
    by_key = grouped.join(firsts, F.col("component") == F.col("c")).select(F.col("key").alias("k"), F.col("first.rep").alias("component_id"), F.col("first.key").alias("first_key"))
    return marked.select("doc_id", "key").join(by_key, F.col("key") == F.col("k")).select("doc_id", "key", "component_id", "first_key")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, with all their columns: of each of
    ``similar_groups`` (``how``) the row of the smallest id stays, of rows that repeat it
    with the same text one (the least by text).  Rows of one id with texts of different
    groups all stay, as do rows without an id.

    The rows meet the kept ids in one merge join, a plan that is the same at every size."""
    groups = similar_groups(docs, id_col, text_col, **how)
    free = "_" * (1 + max((len(c) - len(c.rstrip("_")) for c in docs.columns), default=0))
    kept_id, kept_key, rank = f"kept_id{free}", f"kept_key{free}", f"rank{free}"
    kept = groups.where("doc_id = component_id and key = first_key").select(F.col("doc_id").alias(kept_id), F.col("key").alias(kept_key)).distinct()
    met = docs.where(F.col(id_col).isNotNull()).join(kept.hint("merge"), docs[id_col] == kept[kept_id])
    named = met.where(text_keys(F.col(text_col).cast("binary")) == F.col(kept_key))
    one = named.withColumn(rank, F.row_number().over(W.partitionBy(id_col, kept_key).orderBy(text_col))).where(F.col(rank) == 1)
    return one.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
