"""Genomic intervals: bands, arms, bins and genes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneforge.functions import numeric
from cloneforge.operators.ordered import around


def arms(bands: DataFrame) -> DataFrame:
    """(chrom, band, start, end, length) of the arms: from the first of their bands to the last."""
    by = bands.groupBy("chrom", F.substring("band", 1, 1).alias("arm")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return by.select("chrom", F.col("arm").alias("band"), "start", "end", (F.col("end") - F.col("start")).alias("length"))


def major_bands(bands: DataFrame) -> DataFrame:
    """As arms(), of bands without what follows the point."""
    by = bands.groupBy("chrom", F.substring_index("band", ".", 1).alias("major")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return by.select("chrom", F.col("major").alias("band"), "start", "end", (F.col("end") - F.col("start")).alias("length"))


def in_bands(points: DataFrame, bands: DataFrame) -> DataFrame:
    """Columns of points and `band` of each interval (start, end] on the chromosome that holds pos. Places are cut into stretches as long as an interval is on the mean: an interval stands in those it
    meets, and a point looks in its own alone, by an equi-join, which Spark broadcasts where there are few intervals."""
    mean = bands.agg(F.avg(F.greatest(F.col("end") - F.col("start"), F.lit(1)))).first()[0]
    width = F.lit(max(1, int(mean or 1)))
    upto = lambda x: F.floor(x / width)
    own = bands.where(F.col("end") > F.col("start")).select("chrom", F.col("start").alias("_s"), F.col("end").alias("_e"), "band", F.explode(F.sequence(upto(F.col("start") + 1), upto(F.col("end")))).alias("_at"))
    met = points.withColumn("_at", upto(F.col("pos"))).join(own, ["chrom", "_at"]).where((F.col("pos") > F.col("_s")) & (F.col("pos") <= F.col("_e")))
    return met.select(*points.columns, "band")


def band_means(bins: DataFrame, keys: Sequence[str] = ("cell",)) -> DataFrame:
    """(keys, chrom, band, cn): half-even means of bins that have a band."""
    by = bins.groupBy(*keys, "chrom", "band").agg(F.sum("cn").cast("long").alias("t"), F.count(F.lit(1)).alias("n"))
    return by.select(*keys, "chrom", "band", numeric.half_even_mean(F.col("t"), F.col("n")).cast("int").alias("cn"))


def nearest_bins(points: DataFrame, bins: DataFrame, parts: int | None = None) -> DataFrame:
    """Columns of points (chrom, pos, ...) and `bin` of the bin (chrom, pos, bin) nearest in place, of equally near ones the smaller. Points and bins meet in order of
    place, the last bin before and the first one after, which ranges of a chromosome tell each other; no pairs are made."""
    cols = points.columns
    null = lambda kind: F.lit(None).cast(kind)
    p = points.select("chrom", F.col("pos").alias("_at"), F.struct(*cols).alias("p"), null("struct<pos:bigint,bin:int>").alias("b"))
    b = bins.select("chrom", F.col("pos").alias("_at"), null(p.schema["p"].dataType).alias("p"), F.struct(F.col("pos").cast("long").alias("pos"), F.col("bin").cast("int").alias("bin")).alias("b"))
    met = around(p.unionByName(b), ["chrom"], "_at", "b", parts).where("p is not null")
    far = F.lit(2**62)
    d1, d2 = F.coalesce(F.col("_at") - F.col("before.pos"), far), F.coalesce(F.col("after.pos") - F.col("_at"), far)
    near = F.when(d1 < d2, F.col("before.bin")).when(d2 < d1, F.col("after.bin")).otherwise(F.least("before.bin", "after.bin"))
    return met.where("before is not null or after is not null").select("p.*", near.alias("bin"))


def gene_spans(genes: DataFrame, bins: DataFrame) -> DataFrame:
    """(gene, chrom, first, last, start_nearer): the bins nearest to a gene's start and end, and whether the start is strictly nearer to its own."""
    place = bins.select("chrom", F.col("bin"), F.col("pos").alias("binpos"))
    both = None
    for side in ("start", "end"):
        near = nearest_bins(genes.select("gene", "chrom", F.col(side).alias("pos")), bins).join(place, ["chrom", "bin"]).select("gene", "chrom", F.col("bin").alias(f"b_{side}"), F.abs(F.col("binpos") - F.col("pos")).alias(f"d_{side}"))
        both = near if both is None else both.join(near, ["gene", "chrom"])
    return both.select("gene", "chrom", F.least("b_start", "b_end").alias("first"), F.greatest("b_start", "b_end").alias("last"), F.col("b_start").alias("start_bin"), F.col("b_end").alias("end_bin"), (F.col("d_start") < F.col("d_end")).alias("start_nearer"))


def gene_votes(spans: DataFrame, profile: DataFrame, keys: Sequence[str] = ("cell",)) -> DataFrame:
    """(keys, gene, chrom, cn) over the bins of a gene's span: 2 where all are 2; the most where gains are more than losses; the least where losses are more; else the number at the
    span's end that is nearer to a bin, the start only if strictly nearer. profile: keys, chrom, bin, cn."""
    wide = spans.withColumn("bin", F.explode(F.sequence("first", "last")))
    met = wide.join(profile, ["chrom", "bin"])
    gains, losses = F.count_if(F.col("cn") > 2), F.count_if(F.col("cn") < 2)
    tie_bin = F.when(F.col("start_nearer"), F.col("start_bin")).otherwise(F.col("end_bin"))
    at_tie = F.max(F.when(F.col("bin") == tie_bin, F.col("cn")))
    cn = F.when((gains == 0) & (losses == 0), F.lit(2)).when(gains > losses, F.max("cn")).when(losses > gains, F.min("cn")).otherwise(at_tie)
    return met.groupBy(*keys, "gene", "chrom").agg(cn.cast("int").alias("cn"))
