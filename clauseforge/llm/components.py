"""Connected components by alternating large-star and small-star rounds.

Edges stay distributed; each round is two min-aggregations (combined map-side)
and two equi-joins whose skewed partitions AQE may split.  A round's plan holds its
edges four times: what needs a row's both directions makes them of the row, since a
union of two selections would plan all that is below it twice, and the driver keeps
plans, stages and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseforge.llm.storage import discard, materialize


def _pairs(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """``(a, b)``: of each row those columns, in pairs."""
    each = F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs]))
    return rows.select(each)


def _star(pairs: DataFrame) -> DataFrame:
    """For each a with its neighbours b, join the least of a and all b to every b."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return pairs.join(least, "a")


def large_star(edges: DataFrame) -> DataFrame:
    joined = _star(_pairs(edges, ("a", "b"), ("b", "a")))
    return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return _pairs(_star(down), ("b", "m"), ("a", "m")).where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of orderable ids -> ``(node, component)``: every node that
    has an edge to another one, with the smallest id it can reach.  Self-loops
    and repeated edges are ignored; nulls are dropped; no edges give no rows."""
    now = materialize(
        edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges"
    )
    state = None
    for _ in range(max_rounds + 1):
        seen = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if seen["n"] == 0 or state == (seen["n"], seen["h"]):
            break
        state = (seen["n"], seen["h"])
        last, now = now, materialize(small_star(large_star(now)), "stars")
        discard(last)
    else:
        raise RuntimeError("connected components did not settle")
    return _pairs(now, ("a", "b"), ("b", "b")).select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
