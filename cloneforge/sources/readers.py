"""Text tables in, long tables out: matrices, segmented profiles, bands, annotation, trees, permutations, synthetic data."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneforge import schema
from cloneforge.functions import numeric


def header(spark: SparkSession, path: str, sep: str | None) -> tuple[str, list[str]]:
    """The first line of a text, and its fields."""
    line = spark.read.text(path).first()
    line = line[0] if line else ""
    return line, line.split() if sep is None else line.split(sep)


def fields(spark: SparkSession, path: str, sep: str | None, first: str) -> DataFrame:
    """(f): the fields of each line but the header, which every file of a folder may have, and blank lines. sep None: any white space."""
    lines = spark.read.text(path).where(F.trim("value") != "").where(F.col("value") != first)
    return lines.select((F.split(F.trim("value"), r"\s+") if sep is None else F.split("value", re.escape(sep), -1)).alias("f"))


def named(names: Sequence[str], skip: int) -> Column:
    """(k, name) for each name, of which field k is the value. The names are one literal, however many there are, so that the plan doesn't grow with the columns."""
    clean = [n.strip().strip('"') for n in names]
    if not clean:
        return F.posexplode(F.expr("cast(array() as array<string>)")).alias("k", "name")
    return F.posexplode(F.concat(F.array_repeat(F.lit(None).cast("string"), skip), F.split(F.lit("\n".join(clean)), "\n", -1))).alias("k", "name")


def long(body: DataFrame, lead: Sequence[Column], names: Sequence[str], skip: int) -> DataFrame:
    """Lead columns, `name` and `value` of each field from field `skip` on; null where a line is too short, and fields beyond the names are left out."""
    return body.select(*lead, "f", named(names, skip)).where(F.col("k") >= skip).select(*[c for c in body.select(*lead).columns], "name", number(F.get("f", F.col("k"))).alias("value"))


def number(x: Column) -> Column:
    """A field as a number: also 2.0, 1e5 and quoted ones; null where it is empty, NA or no number."""
    return F.regexp_replace(x, '^[\\s"]+|[\\s"]+$', "").try_cast("double")


def dna_matrix(spark: SparkSession, path: str, sep: str | None = "\t") -> DataFrame:
    """Rows are bins: chrom, position, then one column for each cell, whose names may hold dots and blanks. sep None: any white space. Fields that are empty, NA or no numbers
    are null. Names are read once and lines are cut to fields, so that there may be any number of cells. -> schema.BINS"""
    first, head = header(spark, path, sep)
    bare = lambda k: F.regexp_replace(F.get("f", F.lit(k)), '^"|"$', "")
    lead = [numeric.chrom(bare(0)).alias("chrom"), number(F.get("f", F.lit(1))).cast("long").alias("pos")]
    return long(fields(spark, path, sep, first), lead, head[2:], 2).select(F.col("name").alias("cell"), "chrom", "pos", F.col("value").cast("int").alias("cn"))


def rna_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Rows are genes: the name, then one column for each cell; the header may lack the name's field. Fields that are
    empty, NA or no numbers are null. -> schema.GENES"""
    first, head = header(spark, path, sep)
    body = fields(spark, path, sep, first)
    width = body.select(F.size("f")).first()
    cells = head if width and width[0] == len(head) + 1 else head[1:]
    lead = [F.regexp_replace(F.col("f")[0], '^"|"$', "").alias("gene")]
    return long(body, lead, cells, 1).select(F.col("name").alias("cell"), "gene", F.col("value").alias("rel"))


def segmented(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Rows are cells; columns chr<k>_<bin>, one name fewer than fields. Fields that are empty, NA or no numbers are null. -> schema.PROFILE"""
    first, head = header(spark, path, sep)
    body = fields(spark, path, sep, first).where(F.size("f") == len(head) + 1)
    key = F.col("name")
    got = long(body, [F.regexp_replace(F.col("f")[0], '^"|"$', "").alias("cell")], head, 1)
    return got.select("cell", numeric.chrom(F.substring_index(key, "_", 1)).alias("chrom"), F.substring_index(key, "_", -1).cast("int").alias("bin"), F.col("value").cast("int").alias("cn"))


def bands(spark: SparkSession, path: str) -> DataFrame:
    got = spark.read.csv(path, sep="\t", schema=schema.BAND)
    return got.withColumn("chrom", numeric.chrom(F.col("chrom")))


def annotation(spark: SparkSession, path: str) -> DataFrame:
    """Genes with their places, one row a gene: the first in the file. Then those of the chromosomes M and Y are left out."""
    got = spark.read.csv(path, sep="\t", schema=schema.ANNOTATION).withColumn("chrom", numeric.chrom(F.col("chrom")))
    line = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return first_match(got.withColumn("line", line), ["line"]).where(~F.col("chrom").isin("M", "MT", "24"))


def first_match(annotation_: DataFrame, order: Sequence[str] = ("chrom", "start", "end")) -> DataFrame:
    """Of several rows of a gene the first by `order`."""
    best = annotation_.groupBy("gene").agg(F.min_by(F.struct("chrom", "start", "end"), F.struct(*order)).alias("p"))
    return best.select("gene", "p.chrom", "p.start", "p.end")


def pathways(spark: SparkSession, path: str) -> DataFrame:
    got = spark.read.csv(path, sep="\t", header=True, schema=schema.PATHWAY)
    return got.withColumn("chrom", numeric.chrom(F.col("chrom")))


def tree(spark: SparkSession, path: str) -> DataFrame:
    """from, to, dist (or other names); whole distances may be written as 5 or 5.0. -> schema.TREE"""
    got = spark.read.csv(path, sep="\t", header=True)
    a, b, d = got.columns[:3]
    return got.select(F.col(f"`{a}`").alias("parent"), F.col(f"`{b}`").alias("child"), F.col(f"`{d}`").cast("double").cast("long").alias("dist"))


def permutations(spark: SparkSession, path: str) -> DataFrame:
    """A table of permutations, in folders perm_id=<k>."""
    return spark.read.parquet(path)


def synthetic(spark: SparkSession, genes: int, cells: int, seed: int = 42) -> DataFrame:
    """Relative copy numbers around 1: the first fifth of the genes is gained in about 30 % of the cells, the next fifth lost in about 20 %. -> schema.GENES"""
    grid = spark.range(genes * cells).select(F.floor(F.col("id") / cells).alias("g"), (F.col("id") % cells).alias("c"))
    # from MD5, the same in any engine: a cell's share of the draw, and the noise of each number
    draw = lambda *x: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *x).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    u, noise = draw("c"), draw("g", "c")
    base = F.when((F.col("g") < genes * 0.2) & (u < 0.3), 1.5).when((F.col("g") >= genes * 0.2) & (F.col("g") < genes * 0.4) & (u >= 0.8), 0.5).otherwise(1.0)
    return grid.select(F.concat(F.lit("cell"), "c").alias("cell"), F.concat(F.lit("gene"), "g").alias("gene"), F.greatest(F.lit(0.1), base + 0.2 * (noise - 0.5)).alias("rel"))
