"""Tests against permutations that arrive in files, a few at a time."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloneforge.operators import stats


#: Tests of a task, at about.
TESTS = 100_000


def counts(permuted: DataFrame, levels: DataFrame, feature: Sequence[str] = ("feature",), parts: int | None = None) -> DataFrame:
    """(cell, feature, direction, score, extreme, n) of permuted levels (cell, feature, amp, del) against the real ones (cell, feature, amp, del). Both directions of a lineage and feature are counted in one row.
    Permuted levels that are no number don't count as extreme, as in stats.empirical()."""
    on = ["cell", *feature]
    back, own = permuted.select(*on, F.col("amp").alias("_amp"), F.col("del").alias("_del")), levels.select(*on, "amp", "del")
    if parts:
        back, own = back.repartition(parts, *on), own.repartition(parts, *on)
    extreme = lambda c: F.count_if(F.abs(f"_{c}") >= F.abs(c)).alias(f"_{c}")
    per = back.join(own, on).groupBy(*on, "amp", "del").agg(extreme("amp"), extreme("del"), F.count(F.lit(1)).alias("n"))
    side = lambda name, c: F.struct(F.lit(name).alias("direction"), F.col(c).alias("score"), F.col(f"_{c}").alias("extreme"))
    return per.select(*on, F.explode(F.array(side("AMP", "amp"), side("DEL", "del"))).alias("e"), "n").select(*on, "e.*", "n")


def tests(counted: DataFrame, feature: Sequence[str] = ("feature",)) -> DataFrame:
    """(cell, feature, direction, score, extreme, n, pvalue, adjustp), as stats.significance() gives of all permutations at once."""
    whole = counted.withColumn("pvalue", (F.col("extreme") + 1) / (F.col("n") + 1))
    return stats.adjusted(whole, ["cell", "direction"]).select("cell", *feature, "direction", "score", "extreme", "n", "pvalue", "adjustp")


def follow(spark: SparkSession, path: str, levels: DataFrame, output: str, checkpoint: str, feature: Sequence[str] = ("feature",), files: int = 100) -> int:
    """Takes in the files of permuted levels (folders perm_id=<k>, as writers.permutations() makes them) that have come since the last call with this checkpoint, and writes the counts of all so far as Parquet to
    output; tests() tells p-values of them. Sums lie in the checkpoint's folder, by plain aggregates that spill, and no state is held in memory. A call that finds nothing new leaves output as it is; a portion that was cut off is taken again, and replaces what it had written. Each permutation is to be written
    once: a file that is replaced by one of another name counts again. -> number of rows that were new"""
    kinds = levels.schema
    schema = T.StructType([*[kinds[c] for c in ("cell", *feature)], T.StructField("amp", T.DoubleType()), T.StructField("del", T.DoubleType()), T.StructField("perm_id", T.IntegerType())])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).drop("perm_id")
    keys = ["cell", *feature, "direction", "score"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2 * levels.count() / TESTS))
    kept = f"{checkpoint}/counts"  # in turn the sums up to even and up to odd portions, so that those before a portion are there if it is taken again

    def taken(portion: DataFrame, k: int) -> None:
        own = counts(portion, levels, feature, parts)
        shape = T.StructType([*own.schema, T.StructField("portion", T.LongType()), T.StructField("turn", T.IntegerType())])
        if k:
            before = spark.read.schema(shape).parquet(kept).where((F.col("turn") == (k - 1) % 2) & (F.col("portion") == k - 1))
            both = before.select(own.columns).unionByName(own).repartition(parts, *keys[:-2])
            own = both.groupBy(*keys).agg(F.sum("extreme").alias("extreme"), F.sum("n").alias("n"))
        sums = own.withColumn("portion", F.lit(k).cast("long")).withColumn("turn", F.lit(k % 2))
        sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("turn").parquet(kept)
        now = spark.read.schema(shape).parquet(kept).where((F.col("turn") == k % 2) & (F.col("portion") == k))
        now.select(*keys, "extreme", "n").write.mode("overwrite").parquet(output)

    run = stream.writeStream.foreachBatch(taken).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(p["numInputRows"] for p in run.recentProgress)
