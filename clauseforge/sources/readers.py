"""Where documents come from: element lists, addresses of files, page elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def location(uri: Column) -> Column:
    """struct(scheme, container, key) of s3, azblob, azure, http(s) and drive
    addresses; null for others and for incomplete ones."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z0-9]+)://", 1))
    place = F.regexp_extract(uri, r"^[A-Za-z0-9]+://([^/?#]*)", 1)
    key = F.regexp_replace(F.regexp_extract(uri, r"^[A-Za-z0-9]+://[^/?#]*([^?#]*)", 1), "^/+", "")
    drive = F.coalesce(F.nullif(F.regexp_extract(uri, r"[?&]id=([^&#]+)", 1), F.lit("")), F.nullif(F.regexp_extract(uri, r"/file/d/([a-zA-Z0-9_-]+)", 1), F.lit("")))
    made = lambda s, p, k: F.struct(s.alias("scheme"), p.alias("container"), k.alias("key"))
    return (
        F.when(scheme.isin("http", "https") & F.contains(place, F.lit("drive.google.com")) & drive.isNotNull(), made(F.lit("gdrive"), place, drive))
        .when(scheme.isin("http", "https") & (place != ""), made(scheme, place, key))
        .when(scheme.isin("s3", "azblob", "azure") & (place != "") & (key != ""), made(F.when(scheme == "azure", "azblob").otherwise(scheme), place, key))
    )


def elements(pages: DataFrame) -> DataFrame:
    """``(page_id, ord, kind, text)``: the h1, p and li elements of html in order."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)(<(?:h1|p|li)[^>]*>[^<]*(?:<(?!/?(?:h1|p|li)\b)[^<]*)*)"))
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<(\w+)", 1))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>", " "), r"\s+", " "))
    return rows.select("page_id", "ord", F.when(tag == "h1", "heading").otherwise("clause").alias("kind"), text.alias("text")).where("text <> ''")


def with_headings(chunks: DataFrame, doc: str = "page_id", order: str = "ord") -> DataFrame:
    """Adds ``heading``: the last heading at or before each chunk."""
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return chunks.withColumn("heading", F.last(F.when(F.col("kind") == "heading", F.col("text")), True).over(w))


def fill_hints(rows: DataFrame, doc: str, order: str, hint: str) -> DataFrame:
    """Fills null hints from the row before, and leading ones from the row after."""
    w = W.partitionBy(doc).orderBy(order)
    before = F.last(hint, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(hint, True).over(w.rowsBetween(0, W.unboundedFollowing))
    return rows.withColumn(hint, F.coalesce(before, after))
