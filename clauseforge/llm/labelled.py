"""Bounded samples of labelled rows, by which classifiers here are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_bucket(id_col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def sample_rows(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, those of the least hash of ``key`` (ties by it):
    the same ones wherever and however often it runs.  A hash bound from their number
    lets some ``2 * bound`` through to be sorted, however many partitions there are."""
    h = F.xxhash64(key, F.lit(17))
    part = min(1.0, (2.0 * bound + 100) / max(rows.count(), 1))
    return rows.where(h <= min(int(-(2**63) + part * 2**64), 2**63 - 1)).orderBy(h, key).limit(bound)
