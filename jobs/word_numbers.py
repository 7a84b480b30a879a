"""Copy numbers of words: which stretches of a language's vocabulary a source uses more or less than others do.

The analysis of relative copy numbers, over texts: sources stand for cells, languages for chromosomes, beginnings of words for genes. A source's number of a beginning is its share of the source's words, relative to the
share in the language as a whole, doubled and rounded; beginnings that some source lacks are left out; neighbours in the alphabet are joined to bins. Each source also gets the source, or `root`, nearest to it.

    python -m jobs.word_numbers --tables DIR --output DIR [--config jobs/word_numbers.json]

Reads documents.parquet in DIR. Writes `numbers`, by lang, and `sources`, by parent. A run writes all of it anew, so that it can be repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneforge.functions import numeric
from cloneforge.operators import nearest, segment
from cloneforge.plans.storage import written
from jobs.common import configured, log, main, overwritten

#: letters: of a beginning; width: beginnings of a bin; most: the highest copy number; mode: the zero rule of distances.
DEFAULTS = {"letters": 3, "width": 10, "most": 6, "mode": "directed"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counts(docs: DataFrame, letters: int) -> DataFrame:
    """(lang, source, gene, n): words of all texts by their beginnings. Rows without a language, a source or a text have none."""
    words = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    own = docs.where("lang is not null and source is not null and text is not null").select("lang", "source", words.alias("word"))
    return own.groupBy("lang", "source", F.substring("word", 1, letters).alias("gene")).agg(F.count(F.lit(1)).alias("n"))


def relative(n: DataFrame) -> DataFrame:
    """(cell, chrom, gene, rel) from counts(): of the beginnings that every source has. The four sums are over counts, which are few."""
    cells = n.select("source").distinct().count()
    mine = n.groupBy("lang", "source").agg(F.sum("n").alias("mine"))
    genes = n.groupBy("lang", "gene").agg(F.sum("n").alias("theirs"), F.count(F.lit(1)).alias("cells"))
    whole = n.groupBy("lang").agg(F.sum("n").alias("whole"))
    both = n.join(genes.where(F.col("cells") == cells), ["lang", "gene"]).join(mine, ["lang", "source"]).join(whole, "lang")
    return both.select(F.col("source").alias("cell"), F.col("lang").alias("chrom"), F.concat_ws(":", "lang", "gene").alias("gene"), ((F.col("n") / F.col("mine")) / (F.col("theirs") / F.col("whole"))).alias("rel"))


def run(spark: SparkSession, tables: str, output: str, config: str | None = None) -> None:
    settings = configured(spark, DEFAULTS, config)
    path = f"{tables.rstrip('/')}/documents.parquet"
    docs = spark.read.parquet(path)
    n = written(counts(docs, settings["letters"]), "counts")
    log.info("read %s: %d rows, %d words", path, docs.count(), n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    rel = written(relative(n), "relative")
    places = rel.select("gene", "chrom").distinct().withColumn("start", F.lit(0))  # neighbours are those of the alphabet
    bins = segment.binned_genes(rel.select("cell", "gene", "rel"), places, settings["width"])
    bins = written(bins.withColumn("cn", numeric.clamped(F.col("cn"), 0, settings["most"])), "bins")
    called = F.when(F.col("cn") == 2, "NONE").otherwise(numeric.direction(F.col("cn") - 2))
    overwritten(bins.select(F.col("chrom").alias("lang"), F.col("cell").alias("source"), "bin", "cn", called.alias("call")), f"{output}/numbers", ["lang"])
    root = bins.select("chrom", "bin").distinct().select(F.lit("root").alias("cell"), "chrom", "bin", F.lit(2).alias("cn"))
    found = nearest.nearest_parents(segment.packed(bins.unionByName(root)), "root", settings["mode"])
    overwritten(found.select(F.col("dst").alias("source"), F.col("w").alias("dist"), F.col("src").alias("parent")), f"{output}/sources", ["parent"])


def read(spark: SparkSession, output: str) -> DataFrame:
    """Both outputs as one table."""
    numbers = spark.read.schema("source string, bin int, cn int, call string, lang string").parquet(f"{output}/numbers")
    sources = spark.read.schema("source string, dist bigint, parent string").parquet(f"{output}/sources")
    return numbers.join(sources, "source", "left").select("lang", "source", "bin", "cn", "call", "parent", "dist")


if __name__ == "__main__":
    main(__doc__, ["tables", "output"], run)
