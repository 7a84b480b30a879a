"""Cells as they arrive: each is placed beside the cell, or the root, that is nearest to it, and older cells move where a new one is nearer to them.

Sequencing gives cells in portions, and working out all distances again for each portion is what takes a run's time. Here a file stream takes the files that are new; new cells search all, old ones the new
ones alone, within what they have found before.

    python -m jobs.new_cells --tables DIR --output DIR --checkpoint DIR [--config jobs/new_cells.json]

Reads embeddings.parquet in DIR, a file or a folder that grows: vec_id names a cell, its components are relative to two copies, label is the sample's. Rows without a name or a vector, or with a null or non-finite component, take no part; all vectors have
one length; of rows of one name the one that arrives first counts, and in one portion the one of the least profile. Writes `placed`, by label. `cells` and `parents` keep, by portion, what has arrived and what was
nearest then; a portion that is taken again after a failure replaces its own partitions, so that nothing counts twice. A run over nothing new gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneforge.functions import numeric
from cloneforge.operators import nearest, segment
from cloneforge.plans.storage import written
from jobs.common import configured, log, main, overwritten

#: scale: copies for a component of 1; high: the highest copy number; bins: of a chromosome; mode: the zero rule of distances; files: taken at a time, at most.
DEFAULTS = {"scale": 8, "high": 4, "bins": 16, "mode": "directed", "files": 100}
CELLS = "cell string, label int, chrom string, cns array<int>, batch bigint"
PARENTS = "dst string, src string, w bigint, batch bigint"


def profiles(vectors: DataFrame, settings: dict) -> DataFrame:
    """(cell, label, chrom, cns) of vectors: one row of a name."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fit = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~F.exists("embedding", odd))
    cn = F.transform("embedding", lambda x: numeric.clamped(F.floor(x.cast("double") * settings["scale"]).cast("int") + 2, 0, settings["high"]))
    cells = fit.select(F.col("vec_id").cast("string").alias("cell"), F.col("label").cast("int").alias("label"), cn.alias("cn"))
    cells = cells.groupBy("cell").agg(F.min(F.struct("cn", "label")).alias("m")).select("cell", "m.label", "m.cn")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("cn") - 1) / settings["bins"]).cast("int")), lambda k: F.struct(k.cast("string").alias("chrom"), F.slice("cn", k * settings["bins"] + 1, settings["bins"]).alias("cns")))
    return cells.select("cell", "label", F.inline(parts))


def placed(new: DataFrame, batch: int, output: str, settings: dict) -> None:
    """Takes one portion in: its cells, and what is nearest to them and to older ones since."""
    spark = new.sparkSession
    cells, parents = f"{output}/cells", f"{output}/parents"
    old = spark.read.schema(CELLS).parquet(cells).where(F.col("batch") < batch)
    fresh = written(profiles(new, settings).join(old.select("cell").distinct(), "cell", "left_anti"), "fresh")
    n = fresh.select("cell").distinct().count()
    log.info("portion %d: %d new cells", batch, n)
    if not n:
        return
    overwritten(fresh.withColumn("batch", F.lit(batch).cast("long")), cells, ["batch"], dynamic=True)
    base = fresh.select("chrom", F.transform("cns", lambda _: F.lit(2)).alias("cns")).distinct().select(F.lit("root").alias("cell"), "chrom", "cns")
    known = old.where("cell <> 'root'").select("cell", "chrom", "cns")
    rows, cuts = nearest.profiles(known.unionByName(fresh.select("cell", "chrom", "cns")).unionByName(base))
    names = fresh.select("cell").distinct()
    every = nearest.indexed(rows, cuts, settings["mode"])
    found, pairs = nearest.search(every, every.rows.join(names, "cell", "left_semi"))
    best = spark.read.schema(PARENTS).parquet(parents).where(F.col("batch") < batch).groupBy(F.col("dst").alias("cell")).agg(F.min("w").alias("most"))
    asks = rows.join(best, "cell").select("cell", "cn", F.col("cell").alias("label"), "most")
    more = 0
    if best.limit(1).count():  # not in the first portion
        only_new = nearest.indexed(written(rows.join(names, "cell", "left_semi"), "new"), cuts, settings["mode"])
        moved, more = nearest.search(only_new, asks)
        found = found.unionByName(moved)
    both = found.select(F.col("cell").alias("dst"), F.col("near")[0]["src"].alias("src"), F.col("near")[0]["w"].alias("w"))
    overwritten(both.withColumn("batch", F.lit(batch).cast("long")), parents, ["batch"], dynamic=True)
    log.info("portion %d: worked out %d distances", batch, pairs + more)


def run(spark: SparkSession, tables: str, output: str, checkpoint: str, config: str | None = None) -> None:
    settings = configured(spark, DEFAULTS, config)
    path = f"{tables.rstrip('/')}/embeddings.parquet"
    # so that both tables can be read before anything has arrived; a row of no portion, which is left as it is
    overwritten(spark.createDataFrame([("root", None, "", [], -1)], CELLS), f"{output}/cells", ["batch"], dynamic=True)
    overwritten(spark.createDataFrame([("root", "root", 0, -1)], PARENTS), f"{output}/parents", ["batch"], dynamic=True)
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes a folder or a pattern, and this one is a file as well
    vectors = spark.readStream.schema("vec_id bigint, embedding array<float>, label int").option("maxFilesPerTrigger", settings["files"]).parquet(pattern)
    stream = vectors.writeStream.foreachBatch(lambda df, k: placed(df, k, output, settings)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("read %s: %d rows that were new", path, sum(p["numInputRows"] for p in stream.recentProgress))
    cells = spark.read.schema(CELLS).parquet(f"{output}/cells").where("batch >= 0").groupBy("cell").agg(F.min("label").alias("label"), F.min("batch").alias("batch"))
    parents = spark.read.schema(PARENTS).parquet(f"{output}/parents").where("batch >= 0").groupBy(F.col("dst").alias("cell")).agg(F.min(F.struct("w", "src")).alias("m"))
    overwritten(cells.join(parents, "cell").select("cell", F.col("m.src").alias("parent"), F.col("m.w").alias("dist"), "label"), f"{output}/placed", ["label"])


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema("cell string, parent string, dist bigint, label int").parquet(f"{output}/placed").select("cell", "label", "parent", "dist")


if __name__ == "__main__":
    main(__doc__, ["tables", "output", "checkpoint"], run)
