"""Sums and neighbours along an order, where a group may hold more rows than a task: ranges of the order are parted, each is summed on its own, and the sums of those before are carried in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cloneforge.plans.storage import written


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], parts: int | None = None) -> DataFrame:
    """df with `<v>_before` for each of values: the sum over the rows of equal keys that come before in order. Order must tell the rows of a key apart. A task sorts one range; what is
    carried is one row for each key and range."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # as many rows as ranges
    carried = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_carry_{v}") for v in values])
    within = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = ranged.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_own_{v}") for v in values])
    on = F.lit(True)
    for k in (*keys, "_part"):
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = own.alias("a").join(carried.alias("b"), on)
    return both.select(*[F.col(f"a.{c}").alias(c) for c in df.columns], *[(F.col(f"_own_{v}") + F.col(f"_carry_{v}")).alias(f"{v}_before") for v in values])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """df with the rows of equal keys numbered from 1 in order."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), keys, order, ["_one"], parts).withColumn(name, F.col("_one_before") + 1).drop("_one", "_one_before")


def around(df: DataFrame, keys: Sequence[str], at: str, value: str, parts: int | None = None) -> DataFrame:
    """df with `before` and `after`: the last value at or before a row, and the first one at or after it, in order of `at`, of rows with equal keys; null where there is none. Values rise along `at`, and are null on
    rows that only ask. A task goes along one range, there and back; what is carried is one row for each key and range."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *keys, at).withColumn("_part", F.spark_partition_id()), "ranged")
    ends = ranged.groupBy(*keys, "_part").agg(F.min(value).alias("_least"), F.max(value).alias("_most"))
    ranges = W.partitionBy(*keys)
    earlier, later = (ranges.orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc("_part"), F.desc("_part")))
    carried = ends.select(*keys, "_part", F.max("_most").over(earlier).alias("_before"), F.min("_least").over(later).alias("_after"))
    own = W.partitionBy(*keys, "_part")
    there, back = (own.orderBy(o).rangeBetween(W.unboundedPreceding, 0) for o in (F.asc(at), F.desc(at)))  # back from the end: a frame that only shrinks is worked out anew for each row
    near = ranged.select("*", F.max(value).over(there).alias("before"), F.min(value).over(back).alias("after"))
    on = F.lit(True)
    for k in (*keys, "_part"):
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = near.alias("a").join(carried.alias("b"), on)
    return both.select(*[F.col(f"a.{c}").alias(c) for c in df.columns], F.coalesce("before", "_before").alias("before"), F.coalesce("after", "_after").alias("after"))
