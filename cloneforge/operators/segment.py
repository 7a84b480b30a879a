"""From raw matrices to segmented profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cloneforge.functions import numeric
from cloneforge.operators.ordered import numbered


def numbered_bins(bins: DataFrame) -> DataFrame:
    """Bins (BINS) with `bin`: from 1 along each chromosome, by position. Positions are numbered once, not for each cell. -> PROFILE"""
    return bins.join(bin_numbers(bins), ["chrom", "pos"]).select("cell", "chrom", "bin", "cn")


def bin_numbers(bins: DataFrame) -> DataFrame:
    """(chrom, pos, bin): each position's number along its chromosome, which may hold more of them than a task."""
    places = numbered(bins.select("chrom", "pos").distinct(), ["chrom"], ["pos"], "bin")
    return places.select("chrom", "pos", F.col("bin").cast("int").alias("bin"))


def fixed_count_bins(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int) -> DataFrame:
    """Mean of value by bins of `width` rows in order: of n rows half_even(n / width) bins, one at least; the last takes what remains. Columns keys, bin, n, total."""
    own, along = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_k", F.row_number().over(along)).withColumn("_n", F.count(F.lit(1)).over(own))
    most = F.greatest(F.bround(F.col("_n") / width, 0), F.lit(1)).cast("int")
    bin_ = F.least((F.floor((F.col("_k") - 1) / width) + 1).cast("int"), most)
    return rows.withColumn("bin", bin_).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def binned_genes(genes: DataFrame, annotation: DataFrame, width: int = 30, scale: float = 2, keys: Sequence[str] = ()) -> DataFrame:
    """Segments of `width` genes each, from relative copy numbers (GENES) and places. Genes' bins are worked out once, by place, and joined. -> PROFILE, with keys
    (such as perm_id) before."""
    known = genes.select("gene").distinct().join(annotation, "gene").where(~F.col("chrom").isin("M", "MT", "24"))
    ranked = numbered(known.select("gene", "chrom", "start"), ["chrom"], ["start", "gene"], "_k")
    counts = ranked.groupBy("chrom").agg(F.max("_k").alias("_n"))
    most = F.greatest(F.bround(F.col("_n") / width, 0), F.lit(1)).cast("int")
    places = ranked.join(counts, "chrom").select("gene", "chrom", F.least((F.floor((F.col("_k") - 1) / width) + 1).cast("int"), most).alias("bin"))
    means = genes.withColumn("cn", numeric.absolute(F.col("rel"), scale)).join(places, "gene").groupBy(*keys, "cell", "chrom", "bin").agg(F.sum("cn").alias("t"), F.count(F.lit(1)).alias("n"))
    return means.select(*keys, "cell", "chrom", "bin", numeric.half_even_mean(F.col("t"), F.col("n")).cast("int").alias("cn"))


def packed(profile: DataFrame, keys: Sequence[str] = ("cell",)) -> DataFrame:
    """One array of copy numbers for each cell and chromosome, by bin."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("bin", "cn"))), lambda x: x["cn"])
    return profile.groupBy(*keys, "chrom").agg(ordered.alias("cns"))


def root_of(profile: DataFrame) -> DataFrame:
    """(cell) of the root: the smallest name of the cells that have two copies throughout, else none."""
    whole = profile.groupBy("cell").agg(F.min("cn").alias("lo"), F.max("cn").alias("hi")).where("lo = 2 and hi = 2")
    return whole.agg(F.min("cell").alias("cell")).where("cell is not null")


def with_root(profile: DataFrame, name: str = "root") -> tuple[DataFrame, str]:
    """The profiles with a root, and its name: a cell of two copies throughout, or one that is made up."""
    if found := root_of(profile).first():
        return profile, found.cell
    made = profile.select("chrom", "bin").distinct().select(F.lit(name).alias("cell"), "chrom", "bin", F.lit(2).alias("cn"))
    return profile.unionByName(made), name


def collapsed(profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles of one cell for each that is equal, the smallest name, and (par_cell, dup_cell) of the others. Equal is told by the profiles' hashes, twice 64 bits."""
    whole = F.array_sort(F.collect_list(F.struct("chrom", "bin", "cn")))
    keyed = profile.groupBy("cell").agg(whole.alias("p")).select("cell", F.xxhash64("p").alias("h1"), F.xxhash64(F.lit(1), "p").alias("h2"))
    first = keyed.groupBy("h1", "h2").agg(F.min("cell").alias("par_cell"))
    all_ = keyed.join(first, ["h1", "h2"]).select("par_cell", F.col("cell").alias("dup_cell"))
    kept = profile.join(first.select(F.col("par_cell").alias("cell")), "cell", "left_semi")
    return kept, all_.where("par_cell <> dup_cell")


def complete_features(df: DataFrame, feature: Sequence[str], value: str) -> DataFrame:
    """df without features that have a null value anywhere."""
    bad = df.groupBy(*feature).agg(F.bool_or(F.col(value).isNull()).alias("bad")).where("bad").drop("bad")
    return df.join(bad, list(feature), "left_anti")
