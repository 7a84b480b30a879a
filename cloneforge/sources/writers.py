"""Sinks: text tables as other tools read them. Wide forms are made here alone; everything else stays long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def wide_profiles(profile: DataFrame) -> DataFrame:
    """cells x bins, columns chr<k>_<bin>."""
    keyed = profile.withColumn("key", F.concat(F.lit("chr"), "chrom", F.lit("_"), "bin"))
    names = [r.key for r in keyed.select("chrom", "bin", "key").distinct().orderBy(F.expr("try_cast(chrom as int)"), "chrom", "bin").collect()]
    return keyed.groupBy("cell").pivot("key", names).agg(F.first("cn")).orderBy("cell")


def wide_lines(long: DataFrame, names: list, row: str, column: str, value: str) -> DataFrame:
    """(row, line) of a table that is too wide for a pivot: a line of fields apart by tabs for each row, in order of names, with empty fields where there is no value. Of several values of one field the least counts."""
    places = long.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names)], schema=T.StructType([T.StructField(column, long.schema[column].dataType), T.StructField("_k", T.IntegerType())]))
    own = long.join(places, column).groupBy(row, "_k").agg(F.min(value).cast("string").alias("_v"))
    sorted_ = F.array_sort(F.collect_list(F.struct("_k", F.coalesce("_v", F.lit("")).alias("v"))))
    tabs = lambda n: F.repeat(F.lit("\t"), n)
    met = own.groupBy(row).agg(sorted_.alias("_a"))
    cells = F.transform("_a", lambda x, k: F.concat(tabs(x["_k"] - F.when(k > 0, F.get("_a", k - 1)["_k"]).otherwise(0)), x["v"]))
    return met.select(row, F.concat(F.array_join(cells, ""), tabs(F.lit(len(names) - 1) - F.element_at("_a", -1)["_k"])).alias("line"))


def _tsv_of_lines(lines: DataFrame, row: str, names: list[str], path: str) -> None:
    """Each file under a header of its own, as of one column with that name."""
    out = lines.orderBy(row).select(F.concat_ws("\t", row, "line").alias("\t".join([row, *names])))
    out.write.mode("overwrite").csv(path, sep="\u0001", header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def profiles(profile: DataFrame, path: str) -> None:
    """The table of wide_profiles(), without a pivot: any number of bins."""
    keyed = profile.withColumn("key", F.concat(F.lit("chr"), "chrom", F.lit("_"), "bin"))
    names = [r.key for r in keyed.select("chrom", "bin", "key").distinct().orderBy(F.expr("try_cast(chrom as int)"), "chrom", "bin").collect()]  # they are the header
    _tsv_of_lines(wide_lines(keyed, names, "cell", "key", "cn"), "cell", names, path)


def tree(tree_: DataFrame, path: str) -> None:
    _tsv(tree_.select(F.col("parent").alias("from"), F.col("child").alias("to"), "dist"), path)


def wide_distances(edges: DataFrame) -> DataFrame:
    names = [r[0] for r in edges.select("dst").distinct().orderBy("dst").collect()]
    return edges.groupBy("src").pivot("dst", names).agg(F.first("w")).orderBy("src")


def distances(edges: DataFrame, path: str) -> None:
    """The table of wide_distances(), without a pivot: any number of cells."""
    names = [r[0] for r in edges.select("dst").distinct().orderBy("dst").collect()]  # they are the header
    _tsv_of_lines(wide_lines(edges, names, "src", "dst", "w"), "src", names, path)


def results(result: DataFrame, path: str) -> None:
    """Gene, segmental or parallel results."""
    _tsv(result, path)


def duplicates(kept: DataFrame, copies: DataFrame, path: str) -> None:
    _tsv(kept, f"{path}/kept")
    _tsv(copies, f"{path}/duplicates")


def permutations(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").partitionBy("perm_id").parquet(path)
