"""From many findings to few: redundant lineages go, neighbouring regions are joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cloneforge.plans.storage import written

SIGN = F.signum


def by_arm(findings: DataFrame, bands: DataFrame, own_arm: bool = True) -> DataFrame:
    """findings (cell, depth, chrom, band, score, pvalue, adjustp) with neighbouring bands joined: where those of one lineage, arm and direction cover more than half the arm, the arm stands for
    them, with mean figures; else the same for each major band. -> cell, depth, region, score, pvalue, adjustp. own_arm False: the share is of the short arm's length for either."""
    from cloneforge.operators import genome

    arms, majors = genome.arms(bands), genome.major_bands(bands)
    sized = findings.join(bands.select("chrom", "band", (F.col("end") - F.col("start")).alias("len")), ["chrom", "band"])
    sized = sized.withColumn("arm", F.substring("band", 1, 1)).withColumn("major", F.substring_index("band", ".", 1)).withColumn("sign", SIGN("score"))
    own = arms.select("chrom", F.col("band").alias("arm"), F.col("length").alias("armlen")) if own_arm else arms.where("band = 'p'").select("chrom", F.col("length").alias("armlen"))
    sized = sized.join(own, ["chrom", "arm"] if own_arm else ["chrom"], "left").join(majors.select("chrom", F.col("band").alias("major"), F.col("length").alias("majorlen")), ["chrom", "major"], "left")
    a, m = W.partitionBy("cell", "chrom", "arm", "sign"), W.partitionBy("cell", "chrom", "arm", "major", "sign")
    n_a, n_m = F.count(F.lit(1)).over(a), F.count(F.lit(1)).over(m)
    whole = (n_a > 1) & (F.sum("len").over(a) / F.col("armlen") > 0.5)
    large = (n_m > 1) & (F.sum("len").over(m) / F.col("majorlen") > 0.5)
    named = sized.withColumn("whole", whole).withColumn("large", large)
    region = F.concat(F.col("chrom"), F.lit(":"), F.when(F.col("whole"), F.col("arm")).when(F.col("large"), F.col("major")).otherwise(F.col("band")))
    return named.withColumn("region", region).groupBy("cell", "depth", "region", "sign").agg(F.avg("score").alias("score"), F.avg("pvalue").alias("pvalue"), F.avg("adjustp").alias("adjustp")).drop("sign")


def islands(findings: DataFrame, by: Sequence[str], place: str) -> DataFrame:
    """findings with `island`, the same for neighbours in `place` (whole numbers) within `by`; `first` and `last` place of it and `n`."""
    w = W.partitionBy(*by).orderBy(place)
    new = F.when(F.col(place) - F.lag(place).over(w) == 1, 0).otherwise(1)
    numbered = findings.withColumn("_new", new).withColumn("island", F.sum("_new").over(w)).drop("_new")
    own = W.partitionBy(*by, "island")
    return numbered.withColumn("first", F.min(place).over(own)).withColumn("last", F.max(place).over(own)).withColumn("n", F.count(F.lit(1)).over(own))


def combined(findings: DataFrame, bands: DataFrame) -> DataFrame:
    """findings (cell, depth, region, score, pvalue, adjustp) with runs joined: of bands that follow each other in the table of bands, and of major bands with numbers that
    follow each other, on one arm and in one direction. Whole arms stay. The new region is chrom:<arm><first>-<last>, with mean figures."""
    placed = bands.withColumn("at", F.row_number().over(W.partitionBy("chrom").orderBy("start"))).select(F.concat_ws(":", "chrom", "band").alias("region"), "at")
    own = findings.withColumn("chrom", F.substring_index("region", ":", 1)).withColumn("name", F.substring_index("region", ":", -1))
    own = own.withColumn("arm", F.substring("name", 1, 1)).withColumn("rest", F.substring("name", 2, 100)).withColumn("sign", SIGN("score")).join(placed, "region", "left")
    major = F.when(F.col("at").isNull() & F.col("rest").rlike("^[0-9]+$"), F.col("rest").cast("int"))
    own = own.withColumn("kind", F.when(F.col("at").isNotNull(), "band").when(major.isNotNull(), "major").otherwise("arm")).withColumn("at", F.coalesce("at", major))
    still = own.where("kind = 'arm'").select("cell", "depth", "region", "score", "pvalue", "adjustp")
    by = ["cell", "depth", "kind", "chrom", "arm", "sign"]
    runs = islands(own.where("kind <> 'arm'"), by, "at")
    one = runs.groupBy(*by, "island").agg(F.min_by("rest", "at").alias("a"), F.max_by("rest", "at").alias("z"), F.first("region").alias("r"), F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("score", "pvalue", "adjustp")])
    region = F.when(F.col("n") == 1, F.col("r")).otherwise(F.concat(F.col("chrom"), F.lit(":"), F.col("arm"), F.col("a"), F.lit("-"), F.col("z")))
    return one.select("cell", "depth", region.alias("region"), "score", "pvalue", "adjustp").unionByName(still)


def refined(findings: DataFrame, closed: DataFrame, tree: DataFrame, lineage: DataFrame) -> DataFrame:
    """findings (cell, depth, region, score, pvalue, adjustp) without redundant lineages, each region and direction on its own. Where a region is found in a lineage and
    in some below it: if all eligible lineages below have it, the uppermost one stays; else the first found one that is not above the least depth of those without it, or, if there is none, the uppermost one. Then
    of lineages of one region those below others go, and two or more with one parent (but the root) become the parent, until nothing changes; what hangs on the root alone stays
    only where more eligible lineages hang there. closed: anc, desc, hops; tree: parent, child; lineage: eligible cells with depth. Rounds go up the tree, a level or more each; a row stands for one
    region, direction and lineage."""
    group = ["region", "sign"]
    figures = ["score", "pvalue", "adjustp"]
    roots = tree.select("parent").distinct().join(tree.select(F.col("child").alias("parent")), "parent", "left_anti")
    above = closed.where("hops > 0").select(F.col("desc").alias("cell"), F.col("anc").alias("up"), "hops")
    own = written(findings.withColumn("sign", SIGN("score")).select(*group, "cell", "depth", *figures), "found")
    # the uppermost found lineage above each
    met = own.select(*group, "cell").join(above, "cell").join(own.select(*group, F.col("cell").alias("up")), [*group, "up"])
    named = own.select(*group, "cell", "depth").join(met.groupBy(*group, "cell").agg(F.max_by("up", "hops").alias("top")), [*group, "cell"], "left")
    named = written(named.withColumn("top", F.coalesce("top", "cell")), "named")
    # the least depth at which an eligible lineage below it lacks the finding: there are more of them than found ones
    eligible = lineage.select("cell", F.col("depth").alias("ddepth"))
    below = above.join(named.select(F.col("top").alias("up")).distinct(), "up", "left_semi").join(eligible, "cell").groupBy(F.col("up").alias("top"), "ddepth").agg(F.count(F.lit(1)).alias("all"))
    have = named.where("cell <> top").join(eligible, "cell").groupBy(*group, "top", "ddepth").agg(F.count(F.lit(1)).alias("have"))
    lacks = named.select(*group, "top").distinct().join(below, "top").join(have, [*group, "top", "ddepth"], "left").where(F.col("all") > F.coalesce("have", F.lit(0)))
    lacks = lacks.groupBy(*group, "top").agg(F.min("ddepth").alias("lacks"))
    late = named.join(lacks, [*group, "top"], "left").groupBy(*group, "top").agg(F.min(F.when(F.col("depth") >= F.col("lacks"), F.struct("depth", "cell"))).alias("m"))
    chosen = late.select(*group, F.coalesce("m.cell", "top").alias("cell"))
    live = written(own.join(chosen, [*group, "cell"], "left_semi"), "live")
    several = live.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*group)
    while True:
        under = live.select(*group, "cell").join(above, "cell").join(live.select(*group, F.col("cell").alias("up")), [*group, "up"], "left_semi")
        tops = live.join(under, [*group, "cell"], "left_anti")
        kids = tops.join(tree.select(F.col("child").alias("cell"), "parent"), "cell").join(roots, "parent", "left_anti")
        merged = kids.groupBy(*group, "parent").agg(F.count(F.lit(1)).alias("n"), (F.min("depth") - 1).alias("depth"), *[F.avg(x).alias(x) for x in figures]).where("n > 1")
        merged = written(merged, "merged")
        gone = kids.join(merged.select(*group, "parent"), [*group, "parent"], "left_semi").select(*group, "cell")
        live = written(tops.join(gone, [*group, "cell"], "left_anti").unionByName(merged.select(*group, F.col("parent").alias("cell"), "depth", *figures)), "live")
        if not merged.limit(1).count():
            break
    hang = tree.join(roots, "parent", "left_semi").join(lineage.select(F.col("cell").alias("child")), "child", "left_semi").count()
    deep = live.join(tree.select(F.col("child").alias("cell"), "parent"), "cell").join(roots, "parent", "left_anti").select(*group).distinct()
    shallow = live.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).join(several, group, "left_semi").join(deep, group, "left_anti").where(F.col("n") >= hang)
    return live.join(shallow, group, "left_anti").select("cell", F.col("depth").cast("int").alias("depth"), "region", *figures)


def top_labels(findings: DataFrame, most: int = 3) -> DataFrame:
    """(cell, label): the regions of least p-value of each lineage, joined by commas."""
    w = W.partitionBy("cell").orderBy("pvalue", F.desc(F.abs("score")), "region")
    top = findings.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    return top.groupBy("cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "region"))), lambda x: x["region"]), ",").alias("label"))
