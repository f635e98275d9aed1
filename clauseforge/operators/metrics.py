"""Quality figures of matches and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_accuracy(matches: DataFrame, *by: str) -> DataFrame:
    """Mean distance, score and confidence of ``matches(distance)``."""
    sure = F.when(F.col("distance") <= 0.20, 1.0).when(F.col("distance") <= 0.35, 0.7).otherwise(0.3)
    return matches.groupBy(*by).agg(
        F.round(F.avg("distance"), 4).alias("avg_distance"),
        F.round(F.avg(1 - F.col("distance")), 4).alias("avg_score"),
        F.count("*").alias("n"),
        F.round(F.avg(sure), 4).alias("confidence"),
    )


def percent(part, whole):
    return F.round(100.0 * part / F.greatest(whole, F.lit(1)), 4)
