"""Intermediate tables in the folder that all executors share. They are deleted when the driver ends."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[tuple[str, str]] = []
#: Rows that go to Python at a time while a table is written; rows may hold whole documents.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset: a temporary folder in local mode
    (driver and executor are one machine there), else a folder in the warehouse."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        if not any(k == "tmp" for k, _ in _own):
            _own.append(("tmp", tempfile.mkdtemp(prefix="cloneforge-")))
        return "file://" + next(v for k, v in _own if k == "tmp")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cloneforge"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back. The files outlive
    lost executors, and each value is computed once, however often the result is used."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cloneforge-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(ROWS, int(before))) if int(before) > 0 else str(ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    _delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """By the file system that holds it, where the driver's JVM can be reached; a local path by this process."""
    if path.startswith("file://"):
        _own.append(("path", path))
    elif jvm := getattr(spark, "_jvm", None):
        own = jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@atexit.register
def _clean() -> None:
    for kind, path in _own:
        local = path.removeprefix("file://")
        if kind == "tmp" or path.startswith("file://") and os.path.isdir(local):
            shutil.rmtree(local, ignore_errors=True)
