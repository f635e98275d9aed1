"""Stored nodes, documents and comparisons: Parquet tables that runs write and read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CACHE_VERSION, LIFE = "v2", 86400


def save_nodes(nodes: DataFrame, path: str) -> None:
    """Write nodes by ``doc``; documents that come again replace what was stored.
    Static partitions stay as they are."""
    clustered = nodes.repartition("doc")
    clustered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc").parquet(path)


def load_nodes(spark: SparkSession, path: str, doc: object) -> DataFrame:
    """A document's nodes in order; the filter prunes to its partition."""
    return spark.read.parquet(path).where(F.col("doc") == F.lit(doc)).orderBy("ord", "node")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, newest: str) -> DataFrame:
    """Stored rows with the incoming ones put over those of the same key; of incoming
    rows of one key the newest stays.  Rows without a key are not stored."""
    w = W.partitionBy(key).orderBy(F.desc(newest))
    once = incoming.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return stored.join(once.select(key), key, "left_anti").unionByName(once)


def delete(stored: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored rows without those of ``docs(doc)``."""
    return stored.join(docs.select("doc"), "doc", "left_anti")


def cache_key(left: Column, right: Column) -> Column:
    """A compared pair's key; the order of the pair counts."""
    return F.sha2(F.concat_ws("::", F.lit(CACHE_VERSION), F.trim(left), F.trim(right)), 256)


def is_fresh(updated: Column, now: Column, life: int = LIFE) -> Column:
    """Whether a cached row still counts: not older than ``life`` seconds (0: any age),
    or of a time that cannot be read."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(updated))
    return F.lit(life <= 0) | F.coalesce(age <= life, F.lit(True))


def documents(metadata: DataFrame) -> DataFrame:
    """Rows of ``metadata(path, id, name, upload_date, ...)`` that are documents: with id,
    name and date, not from a folder that begins with "_"; the newest first."""
    hidden = F.coalesce(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).startswith("_"), F.lit(False))
    full = [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in ("id", "name", "upload_date")]
    return metadata.where(~hidden & full[0] & full[1] & full[2]).orderBy(F.desc("upload_date"), "id")


def job_state(state: Column) -> Column:
    """A job's state as it is shown."""
    s = F.upper(F.coalesce(state, F.lit("PENDING")))
    return F.when(s.isin("PENDING", "RECEIVED"), "queued").when(s.isin("STARTED", "RETRY"), "running").when(s == "SUCCESS", "finished").otherwise("failed")


def citations(records: DataFrame, graph: DataFrame) -> DataFrame:
    """Records with ``section`` and ``page`` of their node in ``graph(node, section, page)``,
    of nodes that are not there their own."""
    g = graph.select("node", F.col("section").alias("_section"), F.col("page").alias("_page"))
    own = records.withColumn("_row_page", F.col("page") if "page" in records.columns else F.lit(None).cast("int"))
    joined = own.join(g, "node", "left")
    return joined.withColumns({"section": F.coalesce("_section", "section"), "page": F.coalesce("_page", "_row_page")}).drop("_section", "_page", "_row_page")


def searchable(nodes: DataFrame, docs: list, types: list[str]) -> DataFrame:
    """The nodes of some documents that have one of some types; both conditions reach
    the scan."""
    return nodes.where(F.col("doc").isin(*docs) & F.col("node_type").isin(*types))


def citation(graph: DataFrame, ids: DataFrame) -> DataFrame:
    """``(node, section, page, source)`` of ``ids(node)`` that ``graph`` holds, with its
    defaults where it does not say."""
    met = graph.join(ids.select("node").distinct(), "node", "left_semi")
    return met.select("node", F.coalesce("section", F.lit("Unknown Section")).alias("section"), F.coalesce("page", F.lit(0)).cast("long").alias("page"), F.coalesce("text", F.lit("")).alias("source"))


def refreshed(stored: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """Stored rows with the value found anew ('' where none is), and ``changed``: whether
    it is another than the stored one."""
    new = found.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    joined = stored.join(new, stored[key] == new["_key"], "left").withColumn("_value", F.coalesce("_value", F.lit("")))
    return joined.withColumn("changed", ~F.col("_value").eqNullSafe(F.coalesce(F.col(value), F.lit("")))).withColumn(value, F.col("_value")).drop("_key", "_value")
