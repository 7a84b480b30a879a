"""Fold levels over a stream of profiles: sums and counts by lineage and feature that grow as cells arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_levels(stream: DataFrame, closed: DataFrame) -> DataFrame:
    """A streaming aggregate (cell, feature, n, gain, loss) of a stream (cell, feature, cn) against a fixed tree's closure (anc, desc). Write it in update or complete mode; amp is gain / n and del loss / n. State
    is one row for each lineage and feature."""
    met = stream.join(closed.select(F.col("anc"), F.col("desc").alias("cell")), "cell")
    return met.groupBy(F.col("anc").alias("cell"), "feature").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.col("cn") - 2, F.lit(0))).alias("gain"), F.sum(F.least(F.col("cn") - 2, F.lit(0))).alias("loss"))


def windowed_levels(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """(window, feature, n, gain, loss) of a stream (time, feature, cn): of all cells that arrive within a window, late ones up to `late`."""
    own = stream.withWatermark(time, late).groupBy(F.window(time, width), "feature")
    return own.agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.col("cn") - 2, F.lit(0))).alias("gain"), F.sum(F.least(F.col("cn") - 2, F.lit(0))).alias("loss"))
