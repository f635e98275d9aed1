"""Every query with an oracle against DuckDB on the smallest tables; every other
one runs."""

import duckdb
import pytest

from clauseforge.plans import catalog
from clauseforge.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return "~" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    assert got
    if name in ORACLES:
        r = duck.execute(ORACLES[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall())


def test_nothing_changes_between_equal_versions(spark):
    from clauseforge.operators import changes
    from clauseforge.plans import fixtures as X

    v = X.sql(spark, SF, X.CLAUSES_V1)
    again = X.sql(spark, SF, X.CLAUSES_V1)
    assert changes.change_records(v, again, meanings=False).isEmpty()


def test_sides_swap(spark):
    from clauseforge.operators import changes
    from clauseforge.plans import fixtures as X

    a, b = X.sql(spark, SF, X.CLAUSES_V1), X.sql(spark, SF, X.CLAUSES_V2)
    count = lambda d: {r["change_type"]: r["count"] for r in d.groupBy("change_type").count().collect()}
    there, back = count(changes.align(a, b)), count(changes.align(b, a))
    assert there["ADDED"] == back["REMOVED"] and there["REMOVED"] == back["ADDED"]


def test_streamed_windows_equal_batch(spark, tmp_path):
    from clauseforge.streaming import ingest

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ingest.window_counts(stream, late="10000 days").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (str(r["start"]), r["event_type"], r["n"])
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, ingest.window_counts(events).collect()))
