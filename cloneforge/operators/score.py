"""Cumulative fold levels of lineages, on real and on shuffled copy numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cloneforge.operators.ordered import running
from cloneforge.plans.storage import written


#: Features that are summed side by side in one row.
SIDE = 8
#: Place of the sum of gains beside a count, in one whole number.
GAINS = 1 << 32


def side_by_side(cn: DataFrame, feature: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """cn with SIDE features in a row: (keys, cell, all but the last of feature, piece, a0.., b0..), a: gains and, below them, how many; b: losses; and the features' places
    (feature, piece, at). There are no more places than columns in the matrix."""
    *by, last = feature
    order = W.partitionBy(*by).orderBy(last)
    places = cn.select(*feature).distinct().withColumn("_k", F.row_number().over(order) - 1)
    places = written(places.select(*feature, F.floor(F.col("_k") / SIDE).alias("piece"), (F.col("_k") % SIDE).alias("at")), "places")
    gain, loss = F.greatest(F.col("cn") - 2, F.lit(0)).cast("long") * GAINS + 1, F.least(F.col("cn") - 2, F.lit(0)).cast("long")
    at = lambda x, k: F.sum(F.when(F.col("at") == k, x))
    sums = [at(gain, k).alias(f"a{k}") for k in range(SIDE)] + [at(loss, k).alias(f"b{k}") for k in range(SIDE)]
    return cn.join(places, list(feature)).groupBy(*keys, "cell", *by, "piece").agg(*sums), places


def fold_levels(cn: DataFrame, spans: DataFrame, lineage: DataFrame | None = None, feature: Sequence[str] = ("feature",), keys: Sequence[str] = (), map_: DataFrame | None = None) -> DataFrame:
    """(keys, cell, feature, n, amp, del): over the subtree of each lineage, itself included, mean of what is above two copies, and of what is below. cn: keys, cell, feature, cn. With
    map_ (keys, chrom, cell, label) lineages have the numbers of `cell` in place of `label`'s; feature begins with chrom then, and cn has no keys. spans: trees.spans(). Numbers are summed along the order of spans, and a
    subtree's sum is the difference between its end and its beginning, so that no cell meets its ancestors; features are summed SIDE in a row."""
    *by, last = feature
    wide, places = side_by_side(cn, feature, keys if map_ is None else ())
    sums = [f"{x}{k}" for x in "ab" for k in range(SIDE)]
    at = spans.select("cell", "first")
    if map_ is None:
        rows = wide.join(at, "cell")
        lines = rows.select(*keys).distinct() if keys else None
    else:
        rows = wide.join(map_, ["cell", "chrom"]).drop("cell").withColumnRenamed("label", "cell").join(at, "cell")
        lines = map_.select(*keys).distinct()
    group = [*keys, *by, "piece"]
    none = F.lit(0).cast("long")
    data = rows.select(*group, F.col("first").alias("at"), F.lit(1).alias("kind"), "cell", *[F.coalesce(x, none).alias(x) for x in sums])
    tops = spans if lineage is None else spans.join(lineage.select("cell").distinct(), "cell", "left_semi")
    ends = tops.select("cell", F.inline(F.array(F.struct(F.col("first").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("last").alias("at"), F.lit(2).alias("kind")))))
    marks = ends.crossJoin(places.select(*by, "piece").distinct())  # two rows for each of the results' lineages and pieces
    marks = marks if lines is None else marks.crossJoin(lines)
    marks = marks.select(*group, "at", "kind", "cell", *[none.alias(x) for x in sums])
    told = running(data.unionByName(marks), group, ["at", "kind", "cell"], sums).where("kind <> 1")
    sign = F.when(F.col("kind") == 2, 1).otherwise(-1)
    both = told.groupBy(*group, "cell").agg(*[F.sum(F.col(f"{x}_before") * sign).alias(x) for x in sums])
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("at"), F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b")) for k in range(SIDE)]))
    long = both.select(*group, "cell", each).where("a > 0").join(places, [*by, "piece", "at"])
    n = F.col("a") % GAINS
    return long.select(*keys, "cell", *feature, n.alias("n"), (F.floor(F.col("a") / GAINS) / n).alias("amp"), (F.col("b") / n).alias("del"))


def shuffle_key(seed: int, perm: Column, chrom: Column, cell: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), perm.cast("string"), chrom.cast("string"), cell.cast("string")))


def shuffled_cells(cells: DataFrame, chroms: DataFrame, perms: DataFrame, seed: int = 1234) -> DataFrame:
    """(perm_id, chrom, cell, label): in each permutation and chromosome a random one-to-one map of cells. Whole chromosomes change hands; the matrix itself
    is never copied: join its cells to `cell` and read them as `label`."""
    ordinal = cells.withColumn("k", F.row_number().over(W.orderBy("cell")))  # the list of cells, not the matrix
    grid = perms.select("perm_id").crossJoin(chroms.select("chrom")).crossJoin(cells.select("cell"))
    at = W.partitionBy("perm_id", "chrom").orderBy(shuffle_key(seed, F.col("perm_id"), F.col("chrom"), F.col("cell")), "cell")
    return grid.withColumn("k", F.row_number().over(at)).join(ordinal.select("k", F.col("cell").alias("label")), "k").select("perm_id", "chrom", "cell", "label")


def shuffled(cn: DataFrame, map_: DataFrame) -> DataFrame:
    """cn (cell, chrom, ...) under each permutation, with perm_id."""
    return cn.join(map_, ["cell", "chrom"]).drop("cell").withColumnRenamed("label", "cell")


def permuted_levels(cn: DataFrame, map_: DataFrame, spans: DataFrame, lineage: DataFrame | None = None, feature: Sequence[str] = ("chrom", "feature")) -> DataFrame:
    """fold_levels() of each permutation on the given tree."""
    return fold_levels(cn, spans, lineage, feature, ["perm_id"], map_)


def of_use(n: Column, p: Column, least: int = 20, most: int = 100) -> Column:
    """goes_on() of columns."""
    return (n < least) | ((n < most) & (p <= 0.1) & (p >= 0.001) & ~((n > 50) & (p > 0.05)))


def goes_on(n: int, p: float, least: int = 20, most: int = 100) -> bool:
    """Are more permutations of use, after n, for a p-value that is p so far?"""
    if n < least:
        return True
    if n >= most or p > 0.1 or p < 0.001:
        return False
    return not (n > 50 and p > 0.05)


def permutations_needed(cells: int = 0, genes: int = 0) -> int:
    """Permutations at most: of any input as many. A caller that gives sizes gets the reference's estimate, which is less for large ones; no operator gives them, so that no result depends on the input's size."""
    if cells > 5000 or genes > 2000:
        return 30
    return 50 if cells > 1000 or genes > 1000 else 100
