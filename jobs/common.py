"""What the jobs share: configuration, logging, and the session of the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def configured(spark: SparkSession, defaults: dict, path: str | None) -> dict:
    """The defaults, with what the JSON file at path, which may be remote, says in their place. ValueError for names that mean nothing."""
    given = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := set(given) - set(defaults):
        raise ValueError(f"no such settings: {sorted(unknown)}; there are {sorted(defaults)}")
    return defaults | given


def overwritten(df: DataFrame, path: str, by: Sequence[str], dynamic: bool = False) -> int:
    """Writes df as Parquet in partitions: in place of all that is there, or, dynamic, of the partitions that df has. The rows that are there then."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if dynamic else "static").partitionBy(*by).parquet(path)
    n = df.sparkSession.read.schema(df.schema).parquet(path).count()
    log.info("wrote %s: %d rows, partitioned by %s", path, n, ", ".join(by))
    return n


def main(doc: str, paths: Sequence[str], run: Callable, argv: Sequence[str] | None = None) -> None:
    """The command line: an option for each path, and --config. Creates a session and stops it."""
    parser = argparse.ArgumentParser(description=doc)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help="JSON file of settings")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, *[getattr(args, p) for p in paths], config=args.config)
    finally:
        spark.stop()
