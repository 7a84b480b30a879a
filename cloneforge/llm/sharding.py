"""Sharding: weighted rendezvous hashing of stable record keys, in DataFrame operations only.

Each (key, shard) pair draws an exponential variate with rate = the shard's weight, from a hash; the
shard with the least variate holds the record. A shard's variates depend on nothing but the key and
the shard, so adding a shard moves exactly the records for which the new shard wins, and removing one
moves only its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

#: Rows that one window partition numbers, about.
ROWS_PER_BUCKET = 50_000
#: Window partitions of a shard at least.
LEAST_BUCKETS = 16


def variate(keys: Sequence[Column], shard: int, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of the MD5 of shard and keys, which is the same in any engine."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(shard)), *keys).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) * F.lit(2.0**-52)
    return -F.log(u) / F.lit(float(weight))


def rendezvous(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard (its place in weights) of least variate; of equal ones the smallest. Weight 0: holds nothing."""
    draws = [F.struct(variate(keys, k, w).alias("v"), F.lit(k).alias("k")) for k, w in enumerate(weights) if w > 0]
    if not draws:
        raise ValueError("no shard has a positive weight")
    return (F.least(*draws) if len(draws) > 1 else draws[0])["k"]


def assign(df: DataFrame, keys: Sequence[str], weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """df with `shard`, and `grown_shard` under the weights of `grown`. Null keys are keys like any other."""
    cols = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0")) for k in keys]
    out = df.withColumn("shard", rendezvous(cols, weights))
    return out.withColumn("grown_shard", rendezvous(cols, grown) if grown is not None else F.lit(None).cast("int"))


def numbered(df: DataFrame, by: str, keys: Sequence[str], ties: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """df with `slot`: gapless from 0 in each value of `by`. Each value is cut by a hash of the keys into
    buckets; a count per bucket gives where its numbers begin, a window numbers within it, so that no task
    holds a whole shard. Rows equal in keys and ties fall in one bucket, and are numbered by one window, which spills where there are very many."""
    rows = df.count() if rows is None else rows
    n = max(LEAST_BUCKETS, math.ceil(rows / ROWS_PER_BUCKET))
    names = F.concat_ws("|", F.lit("slot"), *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0")) for k in [*keys, *ties]])
    own = df.withColumn("_bucket", F.pmod(F.conv(F.substring(F.md5(names.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int"))
    begin = (
        own.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_begin", F.sum("_n").over(W.partitionBy(by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)))
        .select(by, "_bucket", F.coalesce("_begin", F.lit(0)).alias("_begin"))
    )
    w = W.partitionBy(by, "_bucket").orderBy(*[F.col(f"`{k}`") for k in [*keys, *ties]])
    return own.withColumn("_at", F.row_number().over(w)).join(begin, [by, "_bucket"]).withColumn("slot", (F.col("_begin") + F.col("_at") - 1).cast("long")).drop("_bucket", "_at", "_begin")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes of the text, null: none, plus 1), text_crc32 (null: 0, as
    for no bytes), law, shard, slot, grown_shard (with one more shard). Law `key`: doc_id and the number of
    shards decide. Repeated rows share a shard and get slots of their own; a null doc_id is a key of its own; an empty
    table gives no rows. Other columns of docs are neither read nor returned."""
    slim = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign(slim, ["doc_id"], [1.0] * shards, [1.0] * (shards + 1))
    return numbered(placed, "shard", ["doc_id"], ["text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
