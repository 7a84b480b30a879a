"""Each operator as a query over the test tables, and the same in SQL.

Cells stand for rows of embeddings, whose components are cut to copy numbers 0 to 4 on four chromosomes of 16 bins; genes and positions stand for events; trees are
nearest-neighbour trees of cells, or heaps, where cell k hangs on cell k div 2.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cloneforge.functions import numeric
from cloneforge.operators import arborescence, distance, genome, implicit, nearest, regions, score, segment, stats, trees
from cloneforge.plans import lineage as lineages
from cloneforge.plans.storage import shared_dir, table, written
from cloneforge.sources import readers, writers
from cloneforge.streaming import permutations

HOUR = 3_600_000_000
PERMS, SEED = 5, 1234
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- tables as the operators want them, and the same as common table expressions


def profile(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("cell"), F.posexplode("embedding").alias("i", "x"))
    cn = numeric.clamped(F.floor(F.col("x").cast("double") * 8).cast("int") + 2, 0, 4)
    return long.select("cell", F.floor(F.col("i") / 16).cast("string").alias("chrom"), (F.col("i") % 16 + 1).cast("int").alias("bin"), cn.alias("cn"))


PROF = """prof AS (SELECT CAST(vec_id AS VARCHAR) AS cell, CAST((i - 1) // 16 AS VARCHAR) AS chrom, CAST((i - 1) % 16 + 1 AS INTEGER) AS bin,
  CAST(greatest(0, least(4, floor(CAST(x AS DOUBLE) * 8) + 2)) AS INTEGER) AS cn
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def _med(kind: str) -> str:
    """(src, dst, w) of all ordered pairs: how much each one-sided difference rises along a chromosome."""
    keep = "WHERE a.cn <> 0 OR b.cn <> 0" if kind == "symmetric" else ""
    there, back = {"directed": ("l", "r"), "symmetric": ("l OR r", "l OR r"), "none": ("FALSE", "FALSE")}[kind]
    return f"""{PROF}, diffs AS (SELECT a.cell AS src, b.cell AS dst, a.chrom, a.bin, a.cn - b.cn AS d, a.cn = 0 AND b.cn <> 0 AS l, a.cn <> 0 AND b.cn = 0 AS r
  FROM prof a JOIN prof b ON a.chrom = b.chrom AND a.bin = b.bin AND a.cell < b.cell {keep}),
rises AS (SELECT src, dst, chrom, l, r, greatest(0, greatest(d, 0) - greatest(lag(d, 1, 0) OVER o, 0)) + greatest(0, greatest(-d, 0) - greatest(-lag(d, 1, 0) OVER o, 0)) AS s
  FROM diffs WINDOW o AS (PARTITION BY src, dst, chrom ORDER BY bin)),
chroms AS (SELECT src, dst, chrom, sum(s) AS s, bool_or(l) AS l, bool_or(r) AS r FROM rises GROUP BY src, dst, chrom),
pairs AS (SELECT src, dst, CAST(sum(CASE WHEN {there} THEN 1000000 ELSE s END) AS BIGINT) AS w, CAST(sum(CASE WHEN {back} THEN 1000000 ELSE s END) AS BIGINT) AS w2 FROM chroms GROUP BY src, dst),
med AS (SELECT src, dst, w FROM pairs UNION ALL SELECT dst, src, w2 FROM pairs)"""


pairs_sql = _med


def med(spark: SparkSession, d: str, mode: str = "directed") -> DataFrame:
    return distance.all_pairs(segment.packed(profile(spark, d)), mode)


def nearest_tree(spark: SparkSession, d: str) -> DataFrame:
    """Each cell hangs on the nearest of those with smaller names."""
    best = nearest.nearest_before(segment.packed(profile(spark, d)))
    return best.select(F.col("src").alias("parent"), F.col("dst").alias("child"), F.col("w").alias("dist"))


NEAREST = _med("directed") + """, tree AS (SELECT src AS parent, dst AS child, w AS dist FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w, src) AS k FROM med WHERE src < dst) WHERE k = 1)"""


def heap(spark: SparkSession, d: str, arity: int = 2) -> DataFrame:
    ids = table(spark, d, "embeddings").select("vec_id").where("vec_id > 0")
    return ids.select(F.floor(F.col("vec_id") / arity).cast("string").alias("parent"), F.col("vec_id").cast("string").alias("child"), F.lit(1).cast("long").alias("dist"))


HEAP = "tree AS (SELECT CAST(vec_id // 2 AS VARCHAR) AS parent, CAST(vec_id AS VARCHAR) AS child, CAST(1 AS BIGINT) AS dist FROM embeddings WHERE vec_id > 0)"
CLOSE = """nodes AS (SELECT parent AS n FROM tree UNION SELECT child FROM tree),
clo AS (SELECT n AS anc, n AS descendant, 0 AS hops, CAST(0 AS BIGINT) AS dist FROM nodes UNION ALL SELECT clo.anc, tree.child, clo.hops + 1, clo.dist + tree.dist FROM clo JOIN tree ON tree.parent = clo.descendant)"""
LINEAGE = """lineage AS (SELECT u.cell, u.depth, d.height, d.subtreesize, u.root_dist FROM
  (SELECT descendant AS cell, max(hops) AS depth, max(dist) AS root_dist FROM clo GROUP BY 1) u JOIN (SELECT anc AS cell, max(hops) AS height, count(*) AS subtreesize FROM clo GROUP BY 1) d USING (cell))"""
HEAPED = f"WITH RECURSIVE {PROF}, {HEAP}, {CLOSE}, {LINEAGE}"
LEVELS = """levels AS (SELECT c.anc AS cell, p.chrom, p.bin, count(*) AS n, CAST(sum(greatest(p.cn - 2, 0)) AS DOUBLE) / count(*) AS amp, CAST(sum(least(p.cn - 2, 0)) AS DOUBLE) / count(*) AS del
  FROM clo c JOIN prof p ON p.cell = c.descendant JOIN lineage l ON l.cell = c.anc AND l.subtreesize >= 5 AND l.cell <> '0' GROUP BY 1, 2, 3)"""
MAP = f"""map AS (SELECT g.perm_id, g.chrom, g.cell, o.cell AS label FROM
  (SELECT perm_id, chrom, cell, row_number() OVER (PARTITION BY perm_id, chrom ORDER BY md5(concat_ws(':', '{SEED}', perm_id, chrom, cell)), cell) AS k
   FROM (SELECT DISTINCT cell FROM prof), (SELECT DISTINCT chrom FROM prof), (SELECT CAST(unnest(range(1, {PERMS + 1})) AS INTEGER) AS perm_id)) g
  JOIN (SELECT cell, row_number() OVER (ORDER BY cell) AS k FROM (SELECT DISTINCT cell FROM prof)) o USING (k))"""
PERMUTED = """permuted AS (SELECT m.perm_id, c.anc AS cell, p.chrom, p.bin, CAST(sum(greatest(p.cn - 2, 0)) AS DOUBLE) / count(*) AS amp, CAST(sum(least(p.cn - 2, 0)) AS DOUBLE) / count(*) AS del
  FROM prof p JOIN map m ON m.cell = p.cell AND m.chrom = p.chrom JOIN clo c ON c.descendant = m.label JOIN lineage l ON l.cell = c.anc AND l.subtreesize >= 5 AND l.cell <> '0' GROUP BY 1, 2, 3, 4)"""
SIDES = """sides AS (SELECT cell, chrom, bin, 'AMP' AS direction, amp AS score FROM levels UNION ALL SELECT cell, chrom, bin, 'DEL', del FROM levels),
back AS (SELECT cell, chrom, bin, 'AMP' AS direction, amp AS score FROM permuted UNION ALL SELECT cell, chrom, bin, 'DEL', del FROM permuted),
tests AS (SELECT s.cell, s.chrom, s.bin, s.direction, s.score, CAST(count(b.score) FILTER (WHERE abs(b.score) >= abs(s.score)) + 1 AS DOUBLE) / (count(b.score) + 1) AS pvalue
  FROM sides s JOIN back b USING (cell, chrom, bin, direction) GROUP BY 1, 2, 3, 4, 5),
adjusted AS (SELECT *, least(1, min(pvalue * m / k) OVER (PARTITION BY cell, direction ORDER BY pvalue DESC RANGE UNBOUNDED PRECEDING)) AS adjustp FROM
  (SELECT *, count(*) OVER (PARTITION BY cell, direction) AS m, count(*) OVER (PARTITION BY cell, direction ORDER BY pvalue RANGE UNBOUNDED PRECEDING) AS k FROM tests))"""
TESTED = f"{HEAPED}, {LEVELS}, {MAP}, {PERMUTED}, {SIDES}"


def heaped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tree = heap(spark, d)
    cells = written(trees.measured(tree), "lineages")
    return tree, trees.spans(tree, cells), cells


def heap_levels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Closure, lineages and levels of the eligible ones."""
    tree, spans, cells = heaped(spark, d)
    own = trees.eligible(cells, "0")
    return tree, spans, cells, score.fold_levels(profile(spark, d), spans, own, ["chrom", "bin"])


def shuffle_map(spark: SparkSession, d: str) -> DataFrame:
    prof = profile(spark, d)
    perms = spark.range(1, PERMS + 1).select(F.col("id").cast("int").alias("perm_id"))
    return score.shuffled_cells(prof.select("cell").distinct(), prof.select("chrom").distinct(), perms, SEED)


def heap_permuted(spark: SparkSession, d: str, spans: DataFrame, cells: DataFrame) -> DataFrame:
    return score.permuted_levels(profile(spark, d), shuffle_map(spark, d), spans, trees.eligible(cells, "0"), ["chrom", "bin"])


def heap_tests(spark: SparkSession, d: str) -> DataFrame:
    tree, spans, cells, levels = heap_levels(spark, d)
    return stats.significance(levels, heap_permuted(spark, d, spans, cells), None, ["chrom", "bin"])


def _r(c: str, digits: int = 9):
    return F.round(c, digits).alias(c)


# --- sources and projections


@query("SELECT p_partkey, CAST(round_even(p_size / 4.0 * 2, 0) AS INTEGER) AS cn, CAST(round_even(CAST(p_size AS DOUBLE) / 4, 0) AS INTEGER) AS cn_absolute, CAST(greatest(0, least(6, p_size)) AS INTEGER) AS clamped FROM part")
def rel_to_abs_round(spark: SparkSession, d: str) -> DataFrame:
    rel = F.col("p_size") / 4
    return table(spark, d, "part").select("p_partkey", numeric.absolute(rel).alias("cn"), numeric.absolute(rel, 1).alias("cn_absolute"), numeric.clamped(F.col("p_size")).alias("clamped"))


@query("SELECT s_suppkey, regexp_replace(s_name, '[ .\\-]', '_', 'g') AS name, CASE WHEN s_nationkey = 23 THEN 'X' WHEN s_nationkey = 24 THEN 'Y' ELSE CAST(s_nationkey AS VARCHAR) END AS chrom, CASE WHEN s_acctbal < 0 THEN 'DEL' ELSE 'AMP' END AS cna FROM supplier")
def names_and_chroms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", numeric.clean_name(F.col("s_name")).alias("name"), numeric.chrom(F.concat(F.lit("chr"), "s_nationkey"), False).alias("chrom"), numeric.direction(F.col("s_acctbal")).alias("cna"))


@query("SELECT CAST(user_id AS VARCHAR) AS cell, event_type AS chrom, CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY event_id) AS INTEGER) AS bin, CAST(floor(value) AS INTEGER) AS cn FROM events")
def chrom_row_number(spark: SparkSession, d: str) -> DataFrame:
    bins = table(spark, d, "events").select(F.col("user_id").cast("string").alias("cell"), F.col("event_type").alias("chrom"), F.col("event_id").alias("pos"), F.floor("value").cast("int").alias("cn"))
    return segment.numbered_bins(bins)


@query("""SELECT l_suppkey, l_returnflag, bin, count(*) AS n, CAST(round_even(avg(l_quantity), 0) AS BIGINT) AS cn FROM
  (SELECT *, CAST(least(floor((k - 1) / 30) + 1, greatest(round_even(n / 30.0, 0), 1)) AS INTEGER) AS bin FROM
    (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS n FROM lineitem)) GROUP BY 1, 2, 3""")
def fixed_count_binning(spark: SparkSession, d: str) -> DataFrame:
    binned = segment.fixed_count_bins(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber"], "l_quantity", 30)
    return binned.select("l_suppkey", "l_returnflag", "bin", "n", numeric.half_even_mean(F.col("total").cast("long"), F.col("n")).alias("cn"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("cell"), F.col("o_orderstatus").alias("chrom")).agg(F.count(F.lit(1)).cast("int").alias("cn")).withColumn("bin", F.lit(1))


ORDERS = """WITH prof AS (SELECT CAST(o_custkey AS VARCHAR) AS cell, o_orderstatus AS chrom, CAST(count(*) AS INTEGER) AS cn FROM orders GROUP BY 1, 2),
whole AS (SELECT cell, list(chrom || ':' || cn ORDER BY chrom) AS p FROM prof GROUP BY cell), first AS (SELECT p, min(cell) AS par_cell FROM whole GROUP BY p)"""


@query(ORDERS + " SELECT cell, chrom, 1 AS bin, cn FROM prof WHERE cell IN (SELECT par_cell FROM first)")
def profile_dedup(spark: SparkSession, d: str) -> DataFrame:
    return segment.collapsed(_orders(spark, d))[0].select("cell", "chrom", "bin", "cn")


@query(ORDERS + " SELECT par_cell, cell AS dup_cell FROM whole JOIN first USING (p) WHERE cell <> par_cell")
def dup_map(spark: SparkSession, d: str) -> DataFrame:
    return segment.collapsed(_orders(spark, d))[1]


@query(ORDERS + " SELECT min(cell) AS cell FROM (SELECT cell FROM prof GROUP BY cell HAVING min(cn) = 2 AND max(cn) = 2) HAVING min(cell) IS NOT NULL")
def diploid_root(spark: SparkSession, d: str) -> DataFrame:
    return segment.root_of(_orders(spark, d))


@query("SELECT user_id, event_type, value FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE value > 200 OR value IS NULL)")
def complete_features(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "events").select("user_id", "event_type", F.when(F.col("value") <= 200, F.col("value")).alias("value"))
    return segment.complete_features(own, ["user_id", "event_type"], "value")


# --- text tables, written and read again


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cloneforge-text-{name}-{uuid.uuid4().hex}"


def text_table(lines: DataFrame, header: str | None, name: str) -> str:
    """The folder of a text of lines (k, line), in order of k, under a header."""
    spark, path = lines.sparkSession, folder(lines.sparkSession, name)
    if header is not None:
        lines = spark.createDataFrame([(header,)], "line string").select(F.lit(None).alias("k"), "line").unionByName(lines, allowMissingColumns=True)
    lines.repartition(1).sortWithinPartitions(F.col("k").asc_nulls_first()).select("line").write.text(path)
    return path


def matrix(spark: SparkSession, d: str, sep: str, of: str, lead: list, names: list[str], scale: float = 1) -> str:
    """A text with a row for each of the bins or cells of the profile, after a header of names and cells or bins."""
    prof = profile(spark, d)
    column = F.col("cell") if of == "bins" else F.concat(F.lit("chr"), "chrom", F.lit("_"), "bin")
    by = ["chrom", "bin"] if of == "bins" else ["cell"]
    order = F.struct("cell") if of == "bins" else F.struct("chrom", "bin")
    columns = [r.c for r in prof.select(column.alias("c"), order.alias("o")).distinct().orderBy("o").collect()]  # a matrix has its columns in its header
    values = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "cn"))), lambda x: x["cn"] * scale)
    lines = prof.groupBy(*by).agg(values.alias("v")).select(F.struct(*by).alias("k"), F.concat_ws(sep, *lead, F.array_join("v", sep)).alias("line"))
    return text_table(lines.withColumn("k", F.to_json("k")), sep.join([*names, *columns]), of)


@query(f"WITH {PROF} SELECT cell, chrom, CAST(bin * 100 AS BIGINT) AS pos, cn FROM prof")
def dna_matrix(spark: SparkSession, d: str) -> DataFrame:
    return readers.dna_matrix(spark, matrix(spark, d, "\t", "bins", [F.concat(F.lit("chr"), "chrom"), (F.col("bin") * 100).cast("string")], ["chrom", "chrompos"]))


@query(f"WITH {PROF} SELECT cell, chrom, CAST(bin * 100 AS BIGINT) AS pos, cn FROM prof")
def dna_matrix_by_blanks(spark: SparkSession, d: str) -> DataFrame:
    return readers.dna_matrix(spark, matrix(spark, d, "  ", "bins", ["chrom", (F.col("bin") * 100).cast("string")], ["chrom", "chrompos"]), None)


def rna(spark: SparkSession, d: str) -> DataFrame:
    return readers.rna_matrix(spark, matrix(spark, d, "\t", "bins", [F.concat_ws("_", "chrom", "bin")], [], 0.5))


GENED = "genes AS (SELECT cell, chrom || '_' || bin AS gene, chrom, bin, CAST(cn AS DOUBLE) / 2 AS rel, cn FROM prof)"


@query(f"WITH {PROF}, {GENED} SELECT cell, gene, rel FROM genes")
def rna_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rna(spark, d)


@query(f"WITH {PROF} SELECT cell, chrom, bin, cn FROM prof")
def segmented_profile(spark: SparkSession, d: str) -> DataFrame:
    return readers.segmented(spark, matrix(spark, d, "\t", "cells", ["cell"], []))


@query(f"WITH {PROF}, {GENED}, placed AS (SELECT *, least((row_number() OVER (PARTITION BY cell, chrom ORDER BY bin) - 1) // 5 + 1, 3) AS b FROM genes) SELECT cell, chrom, CAST(b AS INTEGER) AS bin, CAST(round_even(avg(cn), 0) AS INTEGER) AS cn FROM placed GROUP BY 1, 2, 3")
def rna_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of five genes, from relative numbers; of 16 genes of a chromosome the last three segments' remainder goes to the third."""
    return segment.binned_genes(rna(spark, d), gene_places(spark, d), 5)


def gene_places(spark: SparkSession, d: str) -> DataFrame:
    own = profile(spark, d).select("chrom", "bin").distinct()
    return own.select(F.concat_ws("_", "chrom", "bin").alias("gene"), "chrom", (F.col("bin") * 100).cast("long").alias("start"), (F.col("bin") * 100 + 50).cast("long").alias("end"))


@query("SELECT gene, chrom, start, stop FROM (SELECT 'g' || (p_partkey % 700) AS gene, CASE WHEN p_size % 24 = 22 THEN '23' WHEN p_size % 24 = 23 THEN '24' ELSE CAST(p_size % 24 + 1 AS VARCHAR) END AS chrom, CAST(p_size AS BIGINT) * 1000 AS start, CAST(p_size AS BIGINT) * 1000 + p_partkey AS stop, row_number() OVER (PARTITION BY p_partkey % 700 ORDER BY p_partkey) AS k FROM part) WHERE k = 1 AND chrom <> '24'")
def annotation(spark: SparkSession, d: str) -> DataFrame:
    """The first place of each gene in the file, without those on Y."""
    size = F.col("p_size") % 24
    chrom = F.when(size == 22, "chrX").when(size == 23, "chrY").otherwise(F.concat(F.lit("chr"), size + 1))
    start = F.col("p_size").cast("long") * 1000
    lines = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat_ws("\t", F.concat(F.lit("g"), F.col("p_partkey") % 700), chrom, start.cast("string"), (start + F.col("p_partkey")).cast("string")).alias("line"))
    return readers.annotation(spark, text_table(lines, None, "annotation")).withColumnRenamed("end", "stop")


@query("SELECT 'g' || p_partkey AS gene, p_size FROM part WHERE p_partkey IN (SELECT n_nationkey * 3 FROM nation)")
def pathway_genes(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat_ws("\t", F.lit("chr1"), F.lit("1"), F.lit("2"), F.concat(F.lit("g"), F.col("n_nationkey") * 3), F.concat(F.lit("p"), "n_regionkey")).alias("line"))
    named = readers.pathways(spark, text_table(lines, "chr\tstart\tend\tname\tpathway", "pathways"))
    return lineages.of_pathways(table(spark, d, "part").select(F.concat(F.lit("g"), "p_partkey").alias("gene"), "p_size"), named.unionByName(named))


@query(f"WITH {HEAP} SELECT parent, child, dist FROM tree")
def tree_table(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "tree")
    writers.tree(heap(spark, d), path)
    return readers.tree(spark, path)


@query(f"WITH {PROF}, {MAP} SELECT perm_id, chrom, cell, label FROM map")
def permutation_tables(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "permutations")
    writers.permutations(shuffle_map(spark, d), path)
    return readers.permutations(spark, path).withColumn("perm_id", F.col("perm_id").cast("int"))


@query(f"WITH {PROF} SELECT cell, " + ", ".join(f"max(cn) FILTER (chrom = '{c}' AND bin = {b}) AS chr{c}_{b}" for c in range(4) for b in range(1, 17)) + " FROM prof GROUP BY cell")
def wide_profiles(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "profiles")
    writers.profiles(profile(spark, d), path)
    got = spark.read.csv(path, sep="\t", header=True)
    return got.select("cell", *[F.col(c).cast("int") for c in got.columns[1:]])


def nation_profile(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("cell"), F.col("c_mktsegment").alias("chrom"), (F.col("c_custkey") % 8 + 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("cell")).crossJoin(table(spark, d, "customer").select(F.col("c_mktsegment").alias("chrom")).distinct()).crossJoin(spark.range(1, 9).select(F.col("id").cast("int").alias("bin")))
    return grid.join(own, ["cell", "chrom", "bin"], "left").select("cell", "chrom", "bin", (F.coalesce("n", F.lit(0)) % 4 + 1).cast("int").alias("cn"))


NATION_PROF = """prof AS (SELECT g.cell, g.chrom, g.bin, CAST(coalesce(n, 0) % 4 + 1 AS INTEGER) AS cn FROM
  (SELECT CAST(n_nationkey AS VARCHAR) AS cell, chrom, bin FROM nation, (SELECT DISTINCT c_mktsegment AS chrom FROM customer), (SELECT CAST(unnest(range(1, 9)) AS INTEGER) AS bin)) g
  LEFT JOIN (SELECT CAST(c_nationkey AS VARCHAR) AS cell, c_mktsegment AS chrom, CAST(c_custkey % 8 + 1 AS INTEGER) AS bin, count(*) AS n FROM customer GROUP BY 1, 2, 3) USING (cell, chrom, bin))"""


@query(f"WITH {_med('directed').replace(PROF, NATION_PROF)} SELECT src, " + ", ".join(f"coalesce(max(w) FILTER (dst = '{k}'), 0) AS d{k}" for k in range(25)) + " FROM med GROUP BY src")
def distance_matrix(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "distances")
    writers.distances(distance.all_pairs(segment.packed(nation_profile(spark, d))), path)
    got = spark.read.csv(path, sep="\t", header=True)
    return got.select("src", *[F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)).alias(f"d{c}") for c in got.columns[1:]])


@query(ORDERS + " SELECT 'kept' AS kind, cell, chrom || ':' || cn AS other FROM prof WHERE cell IN (SELECT par_cell FROM first) UNION ALL SELECT 'copy', cell, par_cell FROM whole JOIN first USING (p) WHERE cell <> par_cell")
def duplicate_tables(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "duplicates")
    writers.duplicates(*segment.collapsed(_orders(spark, d)), path)
    kept, copies = (spark.read.csv(f"{path}/{x}", sep="\t", header=True) for x in ("kept", "duplicates"))
    return kept.select(F.lit("kept").alias("kind"), "cell", F.concat_ws(":", "chrom", "cn").alias("other")).unionByName(copies.select(F.lit("copy").alias("kind"), F.col("dup_cell").alias("cell"), F.col("par_cell").alias("other")))


DRAW = "CAST(CAST(('0x' || left(md5({}), 8)) AS BIGINT) AS DOUBLE) / 4294967296"


@query(f"""WITH own AS (SELECT g, c, {DRAW.format("'42:' || c")} AS u, {DRAW.format("'42:' || g || ':' || c")} AS noise FROM range(60) a(g), range((SELECT count(*) FROM customer)) b(c))
SELECT 'cell' || c AS cell, 'gene' || g AS gene, round(greatest(0.1, CASE WHEN g < 12 AND u < 0.3 THEN 1.5 WHEN g >= 12 AND g < 24 AND u >= 0.8 THEN 0.5 ELSE 1.0 END + 0.2 * (noise - 0.5)), 9) AS rel FROM own""")
def synthetic_source(spark: SparkSession, d: str) -> DataFrame:
    """Made-up numbers of sixty genes in as many cells as there are customers."""
    return readers.synthetic(spark, 60, table(spark, d, "customer").count()).select("cell", "gene", _r("rel"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty: the limit is what is asked for."""
    return table(spark, d, "part").select("p_partkey", "p_name").orderBy("p_partkey").limit(20)


# --- distances


@query(f"WITH {_med('directed')} SELECT src, dst, w FROM med")
def med_directed(spark: SparkSession, d: str) -> DataFrame:
    return med(spark, d)


@query(f"WITH {_med('symmetric')} SELECT src, dst, w FROM med")
def med_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return med(spark, d, "symmetric")


@query(f"WITH {_med('none')} SELECT src, dst, w FROM med WHERE src < dst")
def med_sparse(spark: SparkSession, d: str) -> DataFrame:
    return distance.sparse_pairs(segment.packed(profile(spark, d)))


@query(f"WITH {_med('directed')} SELECT m.src, m.dst, m.w FROM med m JOIN tree t ON m.src = t.parent AND m.dst = t.child".replace("WITH ", f"WITH {HEAP}, "))
def med_of_edges(spark: SparkSession, d: str) -> DataFrame:
    pairs = heap(spark, d).where("parent <> child").select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    return distance.pair_distance(pairs, segment.packed(profile(spark, d)))


@query(f"WITH {_med('directed')} SELECT count(*) AS n_pairs, min(w) AS min_w, max(w) AS max_w, round(avg(w), 6) AS mean_w, CAST(sum(w) AS BIGINT) AS sum_w FROM med")
def distance_summary(spark: SparkSession, d: str) -> DataFrame:
    return distance.summary_of_pairs(segment.packed(profile(spark, d))).select("n_pairs", "min_w", "max_w", _r("mean_w", 6), "sum_w")


@query(f"WITH {_med('directed')} SELECT max(abs(a.w - b.w)) AS max_diff, count(*) FILTER (WHERE a.w <> b.w) AS n_differ FROM med a JOIN med b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def distance_asymmetry(spark: SparkSession, d: str) -> DataFrame:
    return distance.asymmetry_of_pairs(segment.packed(profile(spark, d)))


@query(f"WITH {_med('none')}, own AS (SELECT w FROM med WHERE src < dst) SELECT CAST(least(20, floor(CAST(w - lo AS DOUBLE) / greatest(1, hi - lo) * 20) + 1) AS INTEGER) AS bucket, count(*) AS n FROM own, (SELECT min(w) AS lo, max(w) AS hi FROM own) GROUP BY 1")
def distance_histogram(spark: SparkSession, d: str) -> DataFrame:
    return distance.histogram_of_pairs(segment.packed(profile(spark, d)))


@query("SELECT CAST(a.p_partkey AS VARCHAR) AS src, CAST(b.p_partkey AS VARCHAR) AS dst FROM part a JOIN part b ON a.p_partkey <> b.p_partkey AND (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice) + (a.p_size * 10.0 - b.p_size * 10.0) * (a.p_size * 10.0 - b.p_size * 10.0) < 900")
def spatial_gated_pairs(spark: SparkSession, d: str) -> DataFrame:
    coords = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("cell"), F.col("p_retailprice").alias("x"), (F.col("p_size") * F.lit(10.0)).alias("y"))
    return distance.near_pairs(coords, 30.0)


CHOSEN = "CAST(('0x' || left(md5(cell), 8)) AS BIGINT) % 10 = 0"


@query(f"""WITH {_med('directed')}, {_med('none').replace('med AS', 'plain AS').replace('diffs', 'diffs0').replace('rises', 'rises0').replace('chroms', 'chroms0').replace('pairs', 'pairs0').split('),', 1)[1].lstrip()},
cells AS (SELECT DISTINCT cell, {CHOSEN} AS own FROM prof),
near AS (SELECT src AS cell, arg_min(dst, row(w, dst)) AS by FROM plain JOIN cells a ON a.cell = src AND NOT a.own JOIN cells b ON b.cell = dst AND b.own GROUP BY 1 UNION ALL SELECT cell, cell FROM cells WHERE own)
SELECT a.cell AS src, b.cell AS dst, CASE WHEN a.by = b.by THEN 0 ELSE w END AS w FROM near a JOIN near b ON a.cell <> b.cell LEFT JOIN med ON med.src = a.by AND med.dst = b.by""")
def approximate_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances by a sample of one cell in ten."""
    return distance.approximate(segment.packed(profile(spark, d)), 10)


@query(f"""WITH {HEAP}, {_med('symmetric')}, edges AS (SELECT parent AS src, child AS dst, least(parent, child) AS x, greatest(parent, child) AS y FROM tree WHERE parent <> child),
flat AS (SELECT src, dst, x, y, a.chrom, sum(abs(a.cn - b.cn)) AS l1, count(*) FILTER (a.cn <> 0 OR b.cn <> 0) AS n, bool_or((a.cn = 0) <> (b.cn = 0)) AS bad FROM edges JOIN prof a ON a.cell = x JOIN prof b ON b.cell = y AND b.chrom = a.chrom AND b.bin = a.bin GROUP BY 1, 2, 3, 4, 5)
SELECT f.src, f.dst, CAST(sum(CASE WHEN bad THEN 1000000 WHEN n > 10 THEN l1 ELSE coalesce(c.s, 0) END) AS BIGINT) AS w FROM flat f LEFT JOIN chroms c ON c.src = f.x AND c.dst = f.y AND c.chrom = f.chrom GROUP BY 1, 2""")
def quick_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of given pairs, by the sum of differences where more than ten bins are left."""
    pairs = heap(spark, d).where("parent <> child").select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    return distance.quick_pair_distance(pairs, segment.packed(profile(spark, d)))


@query(f"""WITH {_med('directed')}, place AS (SELECT CAST(vec_id AS VARCHAR) AS cell, CAST(vec_id % 50 AS DOUBLE) * 20 AS x, CAST(vec_id // 50 AS DOUBLE) * 20 AS y FROM embeddings)
SELECT src, dst, w FROM med JOIN place a ON a.cell = src JOIN place b ON b.cell = dst WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 900""")
def gated_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances between cells nearer than 30 alone."""
    own = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("cell"), ((F.col("vec_id") % 50) * 20.0).alias("x"), (F.floor(F.col("vec_id") / 50) * 20.0).alias("y"))
    return distance.pair_distance(distance.near_pairs(own, 30.0), segment.packed(profile(spark, d)))


# --- graphs and trees


def region_graph(spark: SparkSession, d: str) -> DataFrame:
    """A complete digraph of the regions, and a root: distinct weights, so that one tree is the least."""
    a = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("a"))
    b = a.withColumnRenamed("a", "b")
    weight = lambda w, k: w * (1 << 32) + F.pow(F.lit(2.0), k).cast("long")
    inner = a.crossJoin(b).where("a <> b").select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"), weight((F.col("a") * 3 + F.col("b") * 5 + F.col("a") * F.col("b")) % 7 + 1, F.col("a") * 5 + F.col("b")).alias("w"))
    return inner.unionByName(b.select(F.lit("root").alias("src"), F.col("b").cast("string").alias("dst"), weight(40 + F.col("b") * 7 % 4, 25 + F.col("b")).alias("w")))  # 25 edges


REGION_GRAPH = """edges AS (SELECT CAST(x.r_regionkey AS INTEGER) AS a, CAST(y.r_regionkey AS INTEGER) AS b, ((x.r_regionkey * 3 + y.r_regionkey * 5 + x.r_regionkey * y.r_regionkey) % 7 + 1) * CAST(4294967296 AS BIGINT) + (CAST(1 AS BIGINT) << (x.r_regionkey * 5 + y.r_regionkey)) AS w
  FROM region x, region y WHERE x.r_regionkey <> y.r_regionkey UNION ALL SELECT -1, r_regionkey, (40 + r_regionkey * 7 % 4) * CAST(4294967296 AS BIGINT) + (CAST(1 AS BIGINT) << (25 + r_regionkey)) FROM region)"""


def _followed(k: int, times: int) -> str:
    """The node that is so many parents up from k."""
    return str(k) if times == 0 else f"CASE {_followed(k, times - 1)} WHEN 0 THEN e0.a WHEN 1 THEN e1.a WHEN 2 THEN e2.a WHEN 3 THEN e3.a WHEN 4 THEN e4.a ELSE -1 END"


@query(f"""WITH {REGION_GRAPH}, trees AS (SELECT {", ".join(f"e{k}.a AS p{k}, e{k}.w AS w{k}" for k in range(5))}, {" + ".join(f"e{k}.w" for k in range(5))} AS total FROM {", ".join(f"edges e{k}" for k in range(5))}
  WHERE {" AND ".join(f"e{k}.b = {k}" for k in range(5))} AND {" AND ".join(f"{_followed(k, 5)} = -1" for k in range(5))}), best AS (SELECT * FROM trees ORDER BY total LIMIT 1)
{" UNION ALL ".join(f"SELECT CASE WHEN p{k} < 0 THEN 'root' ELSE CAST(p{k} AS VARCHAR) END AS parent, '{k}' AS child, w{k} AS dist FROM best" for k in range(5))}""")
def rdmst_in_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The minimum tree of a digraph whose least edges make cycles, in rounds; in SQL the cheapest of all choices of parents."""
    return arborescence.tree(written(region_graph(spark, d), "graph"), "root")


def nation_graph(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    w = (F.col("a") * 37 + F.col("b") * 101 + F.col("a") * F.col("b") * 13) % 997
    return a.crossJoin(a.withColumnRenamed("a", "b")).where("a <> b").select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"), w.alias("w"))  # 600 edges


NATION_GRAPH = "graph AS (SELECT CAST(x.n_nationkey AS VARCHAR) AS src, CAST(y.n_nationkey AS VARCHAR) AS dst, CAST((x.n_nationkey * 37 + y.n_nationkey * 101 + x.n_nationkey * y.n_nationkey * 13) % 997 AS BIGINT) AS w FROM nation x, nation y WHERE x.n_nationkey <> y.n_nationkey)"
CYCLES = f"""{NATION_GRAPH}, chosen AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w, src) AS k FROM graph) WHERE k = 1),
walk AS (SELECT dst AS node, src AS spot, 1 AS k FROM chosen UNION ALL SELECT walk.node, chosen.src, k + 1 FROM walk JOIN chosen ON chosen.dst = walk.spot WHERE k < 25),
cycles AS (SELECT node, min(spot) AS cycle FROM walk WHERE node IN (SELECT node FROM walk WHERE spot = node) GROUP BY node)"""


@query(f"WITH RECURSIVE {CYCLES} SELECT node, cycle FROM cycles")
def cycles_of_least_edges(spark: SparkSession, d: str) -> DataFrame:
    return arborescence.cycle_nodes(arborescence.least_incoming(nation_graph(spark, d)))


@query(f"""WITH RECURSIVE {CYCLES}, less AS (SELECT src, dst, w - min(w) OVER (PARTITION BY dst) AS w FROM graph),
named AS (SELECT coalesce(a.cycle, src) AS s, coalesce(b.cycle, dst) AS d, src, dst, w FROM less LEFT JOIN cycles a ON a.node = src LEFT JOIN cycles b ON b.node = dst)
SELECT s AS src, d AS dst, w, src AS osrc, dst AS odst FROM (SELECT *, row_number() OVER (PARTITION BY s, d ORDER BY w, src, dst) AS k FROM named WHERE s <> d) WHERE k = 1""")
def contracted_cycles(spark: SparkSession, d: str) -> DataFrame:
    graph = written(nation_graph(spark, d), "graph")
    cycles = arborescence.cycle_nodes(arborescence.least_incoming(graph))
    return arborescence.contracted(arborescence.reduced(graph), cycles)


@query("""WITH RECURSIVE links AS (SELECT CAST(c_custkey AS VARCHAR) AS src, CAST(c_custkey * 2 AS VARCHAR) AS dst FROM customer UNION SELECT CAST(c_custkey AS VARCHAR), CAST(c_custkey + 7 AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0),
seen AS (SELECT '1' AS node, 0 AS hops UNION SELECT dst, hops + 1 FROM seen JOIN links ON src = node WHERE hops < 60) SELECT node, min(hops) AS hops FROM seen GROUP BY node""")
def reached(spark: SparkSession, d: str) -> DataFrame:
    """Fewest steps from node 1, in a graph that doubles numbers and, of those divisible by three, adds seven."""
    key = F.col("c_custkey")
    own = table(spark, d, "customer")
    step = lambda to, which: own.where(which).select(key.cast("string").alias("src"), to.cast("string").alias("dst"))
    return arborescence.reach(step(key * 2, F.lit(True)).unionByName(step(key + 7, key % 3 == 0)), "1")


@query(f"""WITH RECURSIVE {NATION_GRAPH}, own AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(w) * 1000 + min(CAST(src AS INTEGER) * 25 + CAST(dst AS INTEGER)) AS w FROM graph GROUP BY 1, 2),
lighter AS (SELECT src, dst, w, src AS spot FROM own UNION SELECT l.src, l.dst, l.w, CASE WHEN e.src = l.spot THEN e.dst ELSE e.src END FROM lighter l JOIN own e ON e.w < l.w AND (e.src = l.spot OR e.dst = l.spot))
SELECT src, dst, w FROM own WHERE (src, dst) NOT IN (SELECT (src, dst) FROM lighter WHERE spot = dst)""")
def spanning_forest(spark: SparkSession, d: str) -> DataFrame:
    """The minimum spanning tree of an undirected graph; in SQL the edges whose ends no lighter edges connect."""
    code = F.col("src").cast("long") * 25 + F.col("dst").cast("long")
    own = nation_graph(spark, d).withColumn("code", code).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg((F.min("w") * 1000 + F.min("code")).alias("w"))
    return arborescence.spanning_forest(own)


@query(f"WITH {_med('directed')} SELECT dst AS src, src AS dst, w - min(w) OVER (PARTITION BY src) AS w FROM med")
def reversed_and_reduced(spark: SparkSession, d: str) -> DataFrame:
    packed = segment.packed(profile(spark, d))
    least = distance.least(packed, out=True).select(F.col("src").alias("cell"), F.col("w").alias("less"))
    return arborescence.reversed_edges(distance.all_pairs(packed, less=written(least, "least")))


@query(f"WITH {_med('directed')} SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w, src) AS k FROM med WHERE dst <> '0') WHERE k = 1")
def least_incoming(spark: SparkSession, d: str) -> DataFrame:
    return distance.least(segment.packed(profile(spark, d))).where("dst <> '0'")


@query(f"WITH {NEAREST} SELECT parent, child, dist FROM tree")
def nearest_parent_tree(spark: SparkSession, d: str) -> DataFrame:
    return nearest_tree(spark, d)


@query(f"WITH RECURSIVE {NEAREST}, {CLOSE} SELECT anc, descendant, hops, dist FROM clo")
def subtree_closure(spark: SparkSession, d: str) -> DataFrame:
    return trees.closure(written(nearest_tree(spark, d), "tree")).withColumnRenamed("desc", "descendant")


@query(f"WITH RECURSIVE {NEAREST}, {CLOSE}, {LINEAGE} SELECT cell, depth, height, subtreesize, root_dist FROM lineage")
def tree_lineages(spark: SparkSession, d: str) -> DataFrame:
    return trees.measured(written(nearest_tree(spark, d), "tree"))


@query(f"WITH RECURSIVE {HEAP}, {CLOSE}, {LINEAGE} SELECT cell, depth FROM lineage")
def tree_depth(spark: SparkSession, d: str) -> DataFrame:
    return trees.measured(heap(spark, d)).select("cell", "depth")


@query(f"WITH RECURSIVE {HEAP}, {CLOSE}, {LINEAGE} SELECT cell, height FROM lineage")
def tree_height(spark: SparkSession, d: str) -> DataFrame:
    return trees.measured(heap(spark, d)).select("cell", "height")


@query(f"WITH RECURSIVE {HEAP}, {CLOSE}, {LINEAGE} SELECT cell, subtreesize FROM lineage WHERE subtreesize >= 5 AND cell <> '0'")
def subtree_size(spark: SparkSession, d: str) -> DataFrame:
    return trees.eligible(trees.measured(heap(spark, d)), "0").select("cell", "subtreesize")


@query(f"WITH {HEAP} SELECT 'root' AS kind, parent AS cell FROM (SELECT DISTINCT parent FROM tree) WHERE parent NOT IN (SELECT child FROM tree) UNION ALL SELECT 'leaf', child FROM tree WHERE child NOT IN (SELECT parent FROM tree)")
def roots_and_leaves(spark: SparkSession, d: str) -> DataFrame:
    tree = heap(spark, d)
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "cell")
    return kind(trees.roots(tree), "root").unionByName(kind(trees.leaves(tree), "leaf"))


@query(f"WITH RECURSIVE {HEAP}, {CLOSE}, {LINEAGE} SELECT parent, child, subtreesize * ((SELECT max(subtreesize) FROM lineage) - subtreesize) AS through FROM tree JOIN lineage ON cell = child")
def edge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    tree = heap(spark, d)
    return trees.betweenness(written(trees.measured(tree), "lineages"), tree)


@query(f"WITH {HEAP} SELECT parent AS src, count(*) AS n_out FROM tree GROUP BY 1")
def out_degrees(spark: SparkSession, d: str) -> DataFrame:
    return arborescence.out_degree(heap(spark, d).select(F.col("parent").alias("src"), F.col("child").alias("dst")))


@query(f"""WITH RECURSIVE {HEAP}, {CLOSE}, {LINEAGE}, own AS (SELECT cell, depth FROM lineage WHERE subtreesize >= 5),
up AS (SELECT o.cell, o.depth, u.cell AS anc, u.depth AS updepth, row_number() OVER (PARTITION BY o.cell ORDER BY u.depth DESC NULLS LAST, u.cell DESC) AS k
  FROM own o LEFT JOIN (SELECT c.descendant, w.cell, w.depth FROM clo c JOIN own w ON w.cell = c.anc WHERE c.hops > 0) u ON u.descendant = o.cell)
SELECT coalesce(anc, 'root') AS node1, cell AS node2, CAST(depth - coalesce(updepth, 0) AS INTEGER) AS dist FROM up WHERE k = 1""")
def ancestor_network(spark: SparkSession, d: str) -> DataFrame:
    """Of all lineages of five cells and more, which are those that can have a finding; ancestor_network_of_findings has those that have one."""
    tree, spans, cells = heaped(spark, d)
    return trees.network(cells.where("subtreesize >= 5").select("cell", "depth"), tree)


ROOTED = f"""{PROF.replace("prof AS", "cells AS")}, prof AS (SELECT cell, chrom, bin, cn FROM cells UNION ALL SELECT DISTINCT 'root', chrom, bin, 2 FROM cells)"""


@query(f"""WITH {ROOTED}{_med("directed").removeprefix(PROF)}, least_of AS (SELECT dst, min(w) AS w FROM med WHERE dst <> 'root' GROUP BY dst)
SELECT CAST(sum(w) AS BIGINT) AS weight, count(*) AS n_edges, CAST(1 AS BIGINT) AS n_roots FROM least_of""")
def rdmst(spark: SparkSession, d: str) -> DataFrame:
    """The minimum tree of all cells and a root, without a table of their pairs: its weight, edges and roots. In SQL the sum of least edges into cells, below which no tree can be, so that a tree of that weight is proved to be least."""
    own, root = segment.with_root(profile(spark, d))
    return arborescence.facts(implicit.tree(segment.packed(own), root))


def region_profile(spark: SparkSession, d: str) -> DataFrame:
    """Cells for regions, near to each other and far from the root, so that their least edges make cycles."""
    own = table(spark, d, "region").select(F.col("r_regionkey").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("i"))
    cn = 5 + (F.col("r") * 3 + F.col("i") * 7 + F.col("r") * F.col("i")) % 3 - F.when(F.col("r") * 5 == F.col("i"), 5).otherwise(0)
    long = own.select(F.col("r").cast("string").alias("cell"), F.floor(F.col("i") / 12).cast("string").alias("chrom"), (F.col("i") % 12 + 1).cast("int").alias("bin"), cn.cast("int").alias("cn"))
    return long.unionByName(long.select("chrom", "bin").distinct().select(F.lit("root").alias("cell"), "chrom", "bin", F.lit(2).alias("cn")))


REGION_PROFILE = """cells AS (SELECT CAST(r_regionkey AS VARCHAR) AS cell, CAST(i // 12 AS VARCHAR) AS chrom, CAST(i % 12 + 1 AS INTEGER) AS bin, 5 + (r_regionkey * 3 + i * 7 + r_regionkey * i) % 3 - CASE WHEN r_regionkey * 5 = i THEN 5 ELSE 0 END AS cn
  FROM region, range(24) t(i)), prof AS (SELECT * FROM cells UNION ALL SELECT DISTINCT 'root', chrom, bin, 2 FROM cells)"""


@query(f"""WITH {REGION_PROFILE}{_med("directed").removeprefix(PROF)}, edges AS (SELECT CASE src WHEN 'root' THEN -1 ELSE CAST(src AS INTEGER) END AS a, CAST(dst AS INTEGER) AS b, w FROM med WHERE dst <> 'root'),
totals AS (SELECT {" + ".join(f"e{k}.w" for k in range(5))} AS total FROM {", ".join(f"edges e{k}" for k in range(5))} WHERE {" AND ".join(f"e{k}.b = {k}" for k in range(5))} AND {" AND ".join(f"{_followed(k, 5)} = -1" for k in range(5))})
SELECT CAST(min(total) AS BIGINT) AS weight, CAST(5 AS BIGINT) AS n_edges, CAST(1 AS BIGINT) AS n_roots FROM totals""")
def implicit_tree(spark: SparkSession, d: str) -> DataFrame:
    """The minimum tree of cells whose least edges make cycles, without a table of pairs; in SQL the cheapest of all choices of parents."""
    return arborescence.facts(implicit.tree(segment.packed(region_profile(spark, d)), "root", listed=1))


@query(f"WITH {ROOTED}{_med('directed').removeprefix(PROF)} SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w, src) AS k FROM med WHERE dst <> 'root') WHERE k = 1")
def nearest_sources(spark: SparkSession, d: str) -> DataFrame:
    """The least edge into each cell, by the metric index in place of all pairs."""
    own, root = segment.with_root(profile(spark, d))
    return nearest.nearest_parents(segment.packed(own), root)


@query()
def permuted_trees(spark: SparkSession, d: str) -> DataFrame:
    """Trees of two permutations, told by weight and edges."""
    return lineages.shuffled_trees(profile(spark, d), 2).groupBy("perm_id").agg(F.sum("dist").alias("weight"), F.count(F.lit(1)).alias("n_edges"))


# --- the genome


def positions(spark: SparkSession, d: str) -> DataFrame:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("chrom"), micros.alias("pos"), "value")


POS = "pos AS (SELECT event_id, user_id, event_type AS chrom, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) AS pos, value FROM events)"


def day_bands(spark: SparkSession, d: str) -> DataFrame:
    days = spark.range(40)
    return positions(spark, d).select("chrom").distinct().crossJoin(days).select("chrom", (F.col("id") * 24 * HOUR).alias("start"), ((F.col("id") + 1) * 24 * HOUR).alias("end"), F.concat(F.lit("d"), "id").alias("band"))


BANDED = f"{POS}, banded AS (SELECT p.*, 'd' || CAST(k AS VARCHAR) AS band FROM pos p JOIN (SELECT CAST(unnest(range(40)) AS BIGINT) AS k) ON p.pos > k * {24 * HOUR} AND p.pos <= (k + 1) * {24 * HOUR})"


@query(f"WITH {BANDED} SELECT event_id, chrom, pos, band FROM banded")
def point_in_band(spark: SparkSession, d: str) -> DataFrame:
    return genome.in_bands(positions(spark, d).select("event_id", "chrom", "pos"), day_bands(spark, d)).select("event_id", "chrom", "pos", "band")


@query(f"WITH {BANDED} SELECT CAST(user_id AS VARCHAR) AS cell, chrom, band, CAST(round_even(avg(CAST(floor(value) AS BIGINT)), 0) AS INTEGER) AS cn FROM banded GROUP BY 1, 2, 3")
def band_mean_cn(spark: SparkSession, d: str) -> DataFrame:
    own = positions(spark, d).select(F.col("user_id").cast("string").alias("cell"), "chrom", "pos", F.floor("value").alias("cn"))
    return genome.band_means(genome.in_bands(own, day_bands(spark, d)))


def hours(spark: SparkSession, d: str) -> DataFrame:
    """Bins: hours in which something happened, numbered along each type."""
    own = positions(spark, d).select("chrom", (F.floor(F.col("pos") / HOUR) * HOUR).alias("pos")).distinct()
    return own.withColumn("bin", F.row_number().over(W.partitionBy("chrom").orderBy("pos")).cast("int"))


def spans_of(spark: SparkSession, d: str) -> DataFrame:
    """Genes: from an hour's first event to its last, and half an hour more."""
    own = positions(spark, d).withColumn("h", F.floor(F.col("pos") / HOUR))
    return own.groupBy("chrom", "h").agg(F.min("pos").alias("start"), (F.max("pos") + HOUR // 2).alias("end")).select(F.concat_ws(":", "chrom", "h").alias("gene"), "chrom", "start", "end")


HOURS = f"""{POS}, bins AS (SELECT chrom, pos, CAST(row_number() OVER (PARTITION BY chrom ORDER BY pos) AS INTEGER) AS bin FROM (SELECT DISTINCT chrom, pos // {HOUR} * {HOUR} AS pos FROM pos)),
genes AS (SELECT chrom || ':' || h AS gene, chrom, min(pos) AS start, max(pos) + {HOUR // 2} AS stop FROM (SELECT *, pos // {HOUR} AS h FROM pos) GROUP BY chrom, h),
near AS (SELECT g.gene, g.chrom, arg_min(b.bin, abs(b.pos - g.start) * 100000 + b.bin) AS b1, min(abs(b.pos - g.start)) AS d1, arg_min(b.bin, abs(b.pos - g.stop) * 100000 + b.bin) AS b2, min(abs(b.pos - g.stop)) AS d2
  FROM genes g JOIN bins b USING (chrom) GROUP BY 1, 2)"""


@query(f"WITH {HOURS} SELECT gene, chrom, least(b1, b2) AS first, greatest(b1, b2) AS last, b1 AS start_bin, b2 AS end_bin, d1 < d2 AS start_nearer FROM near")
def nearest_bin(spark: SparkSession, d: str) -> DataFrame:
    return genome.gene_spans(spans_of(spark, d), hours(spark, d))


@query(f"""WITH {HOURS}, prof AS (SELECT CAST(user_id % 10 AS VARCHAR) AS cell, p.chrom, b.bin, CAST(least(4, count(*)) AS INTEGER) AS cn FROM pos p JOIN bins b ON b.chrom = p.chrom AND b.pos = p.pos // {HOUR} * {HOUR} GROUP BY 1, 2, 3),
met AS (SELECT p.cell, n.gene, n.chrom, p.bin, p.cn, CASE WHEN d1 < d2 THEN b1 ELSE b2 END AS tie FROM near n JOIN prof p ON p.chrom = n.chrom AND p.bin BETWEEN least(b1, b2) AND greatest(b1, b2)),
votes AS (SELECT cell, gene, chrom, count(*) FILTER (WHERE cn > 2) AS g, count(*) FILTER (WHERE cn < 2) AS l, max(cn) AS hi, min(cn) AS lo, max(cn) FILTER (WHERE bin = tie) AS t FROM met GROUP BY 1, 2, 3)
SELECT cell, gene, chrom, CASE WHEN g = 0 AND l = 0 THEN 2 WHEN g > l THEN hi WHEN l > g THEN lo ELSE t END AS cn FROM votes""")
def gene_cn_vote(spark: SparkSession, d: str) -> DataFrame:
    bins = hours(spark, d)
    own = positions(spark, d).select((F.col("user_id") % 10).cast("string").alias("cell"), "chrom", (F.floor(F.col("pos") / HOUR) * HOUR).alias("pos"))
    prof = own.join(bins, ["chrom", "pos"]).groupBy("cell", "chrom", "bin").agg(F.least(F.lit(4), F.count(F.lit(1))).cast("int").alias("cn"))
    return genome.gene_votes(genome.gene_spans(spans_of(spark, d), bins), prof)


def bin_bands(spark: SparkSession) -> DataFrame:
    """A band for each of 4 x 16 bins: arms p and q, major bands of two; lengths grow along the chromosome."""
    own = spark.range(64).select(F.floor(F.col("id") / 16).cast("string").alias("chrom"), (F.col("id") % 16).alias("b"))
    name = F.concat(F.when(F.col("b") < 8, "p").otherwise("q"), (F.floor(F.col("b") % 8 / 2) + 1).cast("string"), F.lit("."), (F.col("b") % 2 + 1).cast("string"))
    return own.select("chrom", (F.col("b") * F.col("b") * 100 + F.col("b") * 1000).alias("start"), ((F.col("b") + 1) * (F.col("b") + 1) * 100 + (F.col("b") + 1) * 1000).alias("end"), name.alias("band"), (F.col("b") + 1).cast("int").alias("bin"))


BANDS = """bands AS (SELECT CAST(i // 16 AS VARCHAR) AS chrom, b * b * 100 + b * 1000 AS start, (b + 1) * (b + 1) * 100 + (b + 1) * 1000 AS stop, CASE WHEN b < 8 THEN 'p' ELSE 'q' END AS arm,
  CASE WHEN b < 8 THEN 'p' ELSE 'q' END || (b % 8 // 2 + 1) AS major, CASE WHEN b < 8 THEN 'p' ELSE 'q' END || (b % 8 // 2 + 1) || '.' || (b % 2 + 1) AS band, CAST(b + 1 AS INTEGER) AS bin
  FROM (SELECT CAST(i AS BIGINT) AS i, CAST(i % 16 AS BIGINT) AS b FROM (SELECT unnest(range(64)) AS i)))"""


def part_bands(spark: SparkSession, d: str) -> DataFrame:
    """Bands for parts: five chromosomes, on which those of the smaller sizes make the short arm."""
    own = table(spark, d, "part")
    arm = F.when(F.col("p_size") <= 25, "p").otherwise("q")
    at = (F.col("p_size") * 1_000_000 + F.floor(F.col("p_partkey") / 5)).cast("long")
    band = F.concat(arm, F.floor((F.col("p_size") - 1) % 25 / 5).cast("string"), F.lit("."), F.col("p_partkey").cast("string"))
    return own.select((F.col("p_partkey") % 5).cast("string").alias("chrom"), at.alias("start"), (at + 1).alias("end"), band.alias("band"))


PART_BANDS = """bands AS (SELECT CAST(p_partkey % 5 AS VARCHAR) AS chrom, p_size * 1000000 + p_partkey // 5 AS start, p_size * 1000000 + p_partkey // 5 + 1 AS stop, CASE WHEN p_size <= 25 THEN 'p' ELSE 'q' END AS arm,
  CASE WHEN p_size <= 25 THEN 'p' ELSE 'q' END || ((p_size - 1) % 25 // 5) AS major FROM part)"""


@query(f"WITH {PART_BANDS} SELECT chrom, arm AS band, min(start) AS start, max(stop) AS stop, max(stop) - min(start) AS length FROM bands GROUP BY 1, 2")
def arm_extent(spark: SparkSession, d: str) -> DataFrame:
    return genome.arms(part_bands(spark, d)).withColumnRenamed("end", "stop")


@query(f"WITH {PART_BANDS} SELECT chrom, major AS band, min(start) AS start, max(stop) AS stop, max(stop) - min(start) AS length FROM bands GROUP BY 1, 2")
def major_band_extent(spark: SparkSession, d: str) -> DataFrame:
    return genome.major_bands(part_bands(spark, d)).withColumnRenamed("end", "stop")


@query(f"""WITH {PART_BANDS}, spots AS (SELECT event_id, CAST(user_id % 5 AS VARCHAR) AS chrom, (event_id % 50 + 1) * 1000000 + event_id % 997 + 1 AS pos FROM events)
SELECT event_id, chrom, pos, min(band) AS band FROM (SELECT event_id, s.chrom, pos, b.major || '.' || b.k AS band FROM spots s JOIN (SELECT chrom, start, stop, major, p_partkey AS k FROM (SELECT *, CAST(start % 1000000 * 5 + CAST(chrom AS BIGINT) AS BIGINT) AS p_partkey FROM bands)) b ON b.chrom = s.chrom AND pos > b.start AND pos <= b.stop) GROUP BY ALL""")
def bands_of_a_file(spark: SparkSession, d: str) -> DataFrame:
    """Points in bands that come from a table without a header, in folders as Spark writes it."""
    path = folder(spark, "bands")
    part_bands(spark, d).write.csv(path, sep="\t")
    spots = table(spark, d, "events").select("event_id", (F.col("user_id") % 5).cast("string").alias("chrom"), ((F.col("event_id") % 50 + 1) * 1_000_000 + F.col("event_id") % 997 + 1).alias("pos"))
    return genome.in_bands(spots, readers.bands(spark, path)).select("event_id", "chrom", "pos", "band")


# --- levels, permutations, tests


STEP = 20
MOST = 100


@query(f"""{HEAPED}, {LEVELS}, {MAP.replace(f"range(1, {PERMS + 1})", f"range(1, {MOST + 1})")}, {PERMUTED}, {SIDES.split("tests AS")[0]}
hits AS (SELECT s.cell, s.chrom, s.bin, s.direction, any_value(s.score) AS score, ceil(perm_id / {STEP}.0) * {STEP} AS part, count(*) AS m, count(*) FILTER (abs(b.score) >= abs(s.score)) AS x FROM sides s JOIN back b USING (cell, chrom, bin, direction) GROUP BY s.cell, s.chrom, s.bin, s.direction, part),
sums AS (SELECT cell, chrom, bin, direction, score, CAST(sum(x) OVER o AS BIGINT) AS extreme, CAST(sum(m) OVER o AS BIGINT) AS n FROM hits WINDOW o AS (PARTITION BY cell, chrom, bin, direction ORDER BY part)),
ends AS (SELECT *, (extreme + 1) / (n + 1) AS pvalue FROM sums),
stops AS (SELECT *, row_number() OVER (PARTITION BY cell, chrom, bin, direction ORDER BY n) AS k FROM ends WHERE n >= 20 AND (n >= {MOST} OR pvalue > 0.1 OR pvalue < 0.001 OR (n > 50 AND pvalue > 0.05))),
tests AS (SELECT cell, chrom, bin, direction, score, extreme, n, pvalue FROM stops WHERE k = 1)
SELECT cell, chrom, bin, direction, round(score, 9) AS score, extreme, n, round(pvalue, 9) AS pvalue, round(least(1, min(pvalue * m / r) OVER (PARTITION BY cell, direction ORDER BY pvalue DESC RANGE UNBOUNDED PRECEDING)), 9) AS adjustp FROM
  (SELECT *, count(*) OVER (PARTITION BY cell, direction) AS m, count(*) OVER (PARTITION BY cell, direction ORDER BY pvalue RANGE UNBOUNDED PRECEDING) AS r FROM tests)""".replace("back AS (SELECT cell, chrom, bin, 'AMP'", "back AS (SELECT perm_id, cell, chrom, bin, 'AMP'").replace("UNION ALL SELECT cell, chrom, bin, 'DEL', del FROM permuted", "UNION ALL SELECT perm_id, cell, chrom, bin, 'DEL', del FROM permuted"))
def adaptive_permutations(spark: SparkSession, d: str) -> DataFrame:
    """Each lineage and bin with as many permutations as are of use to it."""
    tree, spans, cells = heaped(spark, d)
    tests, _ = lineages.adaptively_tested(profile(spark, d), lineages.Lineage(tree, spans, cells, "0"), STEP, seed=SEED, feature=["chrom", "bin"])
    return tests.select("cell", "chrom", "bin", "direction", _r("score"), "extreme", "n", _r("pvalue"), _r("adjustp"))


@query(f"{HEAPED}, {LEVELS} SELECT cell, chrom, bin, n, round(amp, 9) AS amp, round(del, 9) AS del FROM levels")
def cfl_score(spark: SparkSession, d: str) -> DataFrame:
    return heap_levels(spark, d)[3].select("cell", "chrom", "bin", "n", _r("amp"), _r("del"))


@query(f"WITH {PROF}, {MAP} SELECT perm_id, chrom, cell, label FROM map")
def permute_blocks(spark: SparkSession, d: str) -> DataFrame:
    return shuffle_map(spark, d)


@query(f"{HEAPED}, {MAP}, {PERMUTED} SELECT perm_id, cell, chrom, bin, round(amp, 9) AS amp, round(del, 9) AS del FROM permuted")
def permuted_cfl(spark: SparkSession, d: str) -> DataFrame:
    tree, spans, cells = heaped(spark, d)
    return heap_permuted(spark, d, spans, cells).select("perm_id", "cell", "chrom", "bin", _r("amp"), _r("del"))


@query(f"{TESTED} SELECT cell, chrom, bin, direction, round(score, 9) AS score, round(pvalue, 9) AS pvalue FROM tests")
def empirical_p(spark: SparkSession, d: str) -> DataFrame:
    return heap_tests(spark, d).select("cell", "chrom", "bin", "direction", _r("score"), _r("pvalue"))


@query(f"{TESTED} SELECT cell, chrom, bin, direction, round(pvalue, 9) AS pvalue, round(adjustp, 9) AS adjustp FROM adjusted")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    return heap_tests(spark, d).select("cell", "chrom", "bin", "direction", _r("pvalue"), _r("adjustp"))


@query(f"{TESTED} SELECT cell, chrom, bin, direction, CAST({PERMS} AS BIGINT) AS n, round(pvalue, 9) AS pvalue, round(adjustp, 9) AS adjustp FROM adjusted")
def permutations_as_they_arrive(spark: SparkSession, d: str) -> DataFrame:
    """bh_adjust of permutations that a stream finds in two portions, and is started anew for the second."""
    tree, spans, cells, levels = heap_levels(spark, d)
    levels, permuted = written(levels, "levels"), written(heap_permuted(spark, d, spans, cells), "permuted")
    path, output, mark = (folder(spark, x) for x in ("arriving", "counts", "mark"))
    for portion in ("perm_id < 3", "perm_id >= 3"):
        permuted.where(portion).write.mode("append").partitionBy("perm_id").parquet(path)
        permutations.follow(spark, path, levels, output, mark, ["chrom", "bin"])
    got = permutations.tests(spark.read.parquet(output), ["chrom", "bin"])
    return got.select("cell", "chrom", "bin", "direction", "n", _r("pvalue"), _r("adjustp"))


@query(f"{TESTED} SELECT cell, chrom, bin, direction, round(score, 9) AS score, round(pvalue, 9) AS pvalue FROM adjusted WHERE pvalue < 0.2 AND abs(score) > 0.3")
def significant_filter(spark: SparkSession, d: str) -> DataFrame:
    return stats.significant(heap_tests(spark, d), 0.2, 0.3).select("cell", "chrom", "bin", "direction", _r("score"), _r("pvalue"))


ARITIES = (3, 4, 5)
TREES = "trees AS (SELECT perm_id, CAST(vec_id // (perm_id + 2) AS VARCHAR) AS parent, CAST(vec_id AS VARCHAR) AS child FROM embeddings, (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS perm_id) WHERE vec_id > 0)"
SIZES = f"""{TREES}, pclo AS (SELECT perm_id, n AS anc, n AS descendant FROM (SELECT perm_id, parent AS n FROM trees UNION SELECT perm_id, child FROM trees) UNION ALL SELECT pclo.perm_id, pclo.anc, trees.child FROM pclo JOIN trees ON trees.perm_id = pclo.perm_id AND trees.parent = pclo.descendant),
psizes AS (SELECT perm_id, anc AS cell, count(*) AS subtreesize FROM pclo GROUP BY 1, 2)"""


def permuted_sizes(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for k, arity in enumerate(ARITIES, 1):
        own = trees.measured(heap(spark, d, arity)).select(F.lit(k).alias("perm_id"), "cell", "subtreesize")
        out = own if out is None else out.unionByName(own)
    return written(out, "sizes")


@query(f"""{HEAPED}, {SIZES} SELECT cell, perm_id, pcell FROM (SELECT l.cell, p.perm_id, p.cell AS pcell, rank() OVER (PARTITION BY l.cell, p.perm_id ORDER BY abs(p.subtreesize - l.subtreesize)) AS k
  FROM lineage l, psizes p WHERE l.subtreesize >= 5 AND l.cell <> '0') WHERE k = 1""")
def size_matched_background(spark: SparkSession, d: str) -> DataFrame:
    return stats.size_matched(trees.eligible(trees.measured(heap(spark, d)), "0"), permuted_sizes(spark, d))


TREE_LEVELS = f"""{HEAPED}, {MAP}, {SIZES}, mine AS (SELECT * FROM psizes WHERE subtreesize >= 5 AND cell <> '0'),
permuted AS (SELECT m.perm_id, c.anc AS cell, p.chrom, p.bin, CAST(sum(greatest(p.cn - 2, 0)) AS DOUBLE) / count(*) AS amp, CAST(sum(least(p.cn - 2, 0)) AS DOUBLE) / count(*) AS del
  FROM prof p JOIN map m ON m.cell = p.cell AND m.chrom = p.chrom JOIN pclo c ON c.perm_id = m.perm_id AND c.descendant = m.label JOIN mine l ON l.perm_id = c.perm_id AND l.cell = c.anc GROUP BY 1, 2, 3, 4)"""


def permuted_heaps(spark: SparkSession, d: str) -> DataFrame:
    """Three trees that stand for trees of permutations."""
    out = None
    for k, arity in enumerate(ARITIES, 1):
        own = heap(spark, d, arity).withColumn("perm_id", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return written(out, "shuffled")


def features(spark: SparkSession, d: str) -> DataFrame:
    return profile(spark, d).select("cell", "chrom", F.col("bin").cast("string").alias("feature"), "cn")


@query(f"{TREE_LEVELS} SELECT perm_id, cell, chrom, CAST(bin AS VARCHAR) AS feature, round(amp, 9) AS amp, round(del, 9) AS del FROM permuted")
def permuted_tree_levels(spark: SparkSession, d: str) -> DataFrame:
    got = lineages.permuted_tree_levels(features(spark, d), permuted_heaps(spark, d), 5, SEED)[0]
    return got.select("perm_id", "cell", "chrom", "feature", _r("amp"), _r("del"))


@query(f"""{TREE_LEVELS}, {LEVELS}, sides AS (SELECT cell, chrom, bin, 'AMP' AS direction, amp AS score FROM levels UNION ALL SELECT cell, chrom, bin, 'DEL', del FROM levels),
matched AS (SELECT cell, perm_id, pcell FROM (SELECT l.cell, p.perm_id, p.cell AS pcell, rank() OVER (PARTITION BY l.cell, p.perm_id ORDER BY abs(p.subtreesize - l.subtreesize)) AS k FROM lineage l, mine p WHERE l.subtreesize >= 5 AND l.cell <> '0') WHERE k = 1),
back AS (SELECT m.cell, p.chrom, p.bin, 'AMP' AS direction, p.amp AS score FROM matched m JOIN permuted p ON p.perm_id = m.perm_id AND p.cell = m.pcell UNION ALL SELECT m.cell, p.chrom, p.bin, 'DEL', p.del FROM matched m JOIN permuted p ON p.perm_id = m.perm_id AND p.cell = m.pcell)
SELECT s.cell, s.chrom, CAST(s.bin AS VARCHAR) AS feature, s.direction, round(s.score, 9) AS score, round(CAST(count(b.score) FILTER (WHERE abs(b.score) >= abs(s.score)) + 1 AS DOUBLE) / (count(b.score) + 1), 9) AS pvalue
FROM sides s JOIN back b USING (cell, chrom, bin, direction) GROUP BY s.cell, s.chrom, s.bin, s.direction, s.score""")
def permuted_tree_test(spark: SparkSession, d: str) -> DataFrame:
    """Tests against lineages of like size in trees of permutations."""
    tree, spans, cells = heaped(spark, d)
    _, _, tests, _ = lineages.tested(features(spark, d), lineages.Lineage(tree, spans, cells, "0"), shuffled=permuted_heaps(spark, d), seed=SEED)
    return tests.select("cell", "chrom", "feature", "direction", _r("score"), _r("pvalue"))


def found(levels: DataFrame, cells: DataFrame) -> DataFrame:
    """Findings of a rule: levels from 0.35 up, with figures that stand for p-values."""
    sides = levels.select("cell", "chrom", "bin", F.explode(F.array(F.col("amp"), F.col("del"))).alias("score")).where(F.abs("score") >= 0.35)
    p = 1 / (F.col("subtreesize") + F.col("bin") * 3)
    return sides.join(cells.select("cell", "depth", "subtreesize"), "cell").withColumn("pvalue", p).withColumn("adjustp", F.least(F.lit(1.0), 2 * p))


FOUND = """found AS (SELECT s.cell, l.depth, l.subtreesize, s.chrom, s.bin, s.score, 1.0 / CAST(l.subtreesize + s.bin * 3 AS DOUBLE) AS pvalue, least(1.0, 2.0 / CAST(l.subtreesize + s.bin * 3 AS DOUBLE)) AS adjustp FROM
  (SELECT cell, chrom, bin, amp AS score FROM levels UNION ALL SELECT cell, chrom, bin, del FROM levels) s JOIN lineage l USING (cell) WHERE abs(s.score) >= 0.35)"""


@query(f"""{HEAPED}, {LEVELS}, {FOUND}, own AS (SELECT DISTINCT cell, depth FROM found),
up AS (SELECT o.cell, o.depth, u.cell AS anc, u.depth AS updepth, row_number() OVER (PARTITION BY o.cell ORDER BY u.depth DESC NULLS LAST, u.cell DESC) AS k
  FROM own o LEFT JOIN (SELECT c.descendant, w.cell, w.depth FROM clo c JOIN own w ON w.cell = c.anc WHERE c.hops > 0) u ON u.descendant = o.cell)
SELECT coalesce(anc, 'root') AS node1, cell AS node2, CAST(depth - coalesce(updepth, 0) AS INTEGER) AS dist FROM up WHERE k = 1""")
def ancestor_network_of_findings(spark: SparkSession, d: str) -> DataFrame:
    """ancestor_network of all cells that have a finding, in place of all that can have one."""
    tree, spans, cells, levels = heap_levels(spark, d)
    return trees.network(found(levels, cells), tree)


@query(f"""{HEAPED}, {LEVELS}, {MAP}, {PERMUTED}, {FOUND}, named AS (SELECT chrom || ':' || bin AS region, score, subtreesize FROM found), signs AS (SELECT region, count(*) AS lineage, CASE WHEN count(*) FILTER (WHERE score < 0) > 1 THEN -1 WHEN count(*) FILTER (WHERE score > 0) > 1 THEN 1 END AS sg FROM named GROUP BY 1 HAVING count(*) > 1),
own AS (SELECT n.region, s.sg, n.subtreesize, row_number() OVER () AS id FROM named n JOIN signs s ON s.region = n.region AND sign(n.score) = s.sg),
psizes AS (SELECT perm_id, cell, subtreesize FROM lineage, (SELECT CAST(unnest(range(1, {PERMS + 1})) AS INTEGER) AS perm_id) WHERE subtreesize >= 5 AND cell <> '0'),
near AS (SELECT id, region, sg, perm_id, cell FROM (SELECT o.id, o.region, o.sg, p.perm_id, p.cell, rank() OVER (PARTITION BY o.id, p.perm_id ORDER BY abs(p.subtreesize - o.subtreesize)) AS k FROM own o, psizes p) WHERE k = 1),
counts AS (SELECT n.region, n.perm_id, count(*) FILTER (WHERE CASE WHEN n.sg > 0 THEN q.amp >= 0.5 ELSE q.del <= -0.5 END) AS c FROM near n JOIN permuted q ON q.perm_id = n.perm_id AND q.cell = n.cell AND q.chrom || ':' || q.bin = n.region GROUP BY 1, 2)
SELECT s.region, s.lineage, round(p.pvalue, 9) AS pvalue FROM signs s LEFT JOIN (SELECT c.region, CAST(count(*) FILTER (WHERE c.c >= o.need) + 1 AS DOUBLE) / (count(*) + 1) AS pvalue FROM counts c JOIN (SELECT region, count(*) AS need FROM own GROUP BY 1) o USING (region) GROUP BY 1) p USING (region)""")
def parallel_test(spark: SparkSession, d: str) -> DataFrame:
    tree, spans, cells, levels = heap_levels(spark, d)
    region = F.concat_ws(":", "chrom", "bin").alias("region")
    own = found(levels, cells).select(region, "score", "subtreesize")
    permuted = written(heap_permuted(spark, d, spans, cells), "permuted").select("perm_id", "cell", region, "amp", "del")
    sizes = permuted.select("perm_id", "cell").distinct().join(cells.select("cell", "subtreesize"), "cell")
    return stats.parallel(own, permuted, sizes).select("region", "lineage", _r("pvalue"))


MERGED = f"""{BANDS}, sized AS (SELECT f.cell, f.depth, f.chrom, f.score, f.pvalue, f.adjustp, sign(f.score) AS sg, b.band, b.arm, b.major, b.stop - b.start AS len FROM found f JOIN bands b ON b.chrom = f.chrom AND b.bin = f.bin),
shares AS (SELECT s.*, count(*) OVER a AS na, sum(len) OVER a / (SELECT max(stop) - min(start) FROM bands b WHERE b.chrom = s.chrom AND b.arm = s.arm) AS fa, count(*) OVER m AS nm, sum(len) OVER m / (SELECT max(stop) - min(start) FROM bands b WHERE b.chrom = s.chrom AND b.major = s.major) AS fm
  FROM sized s WINDOW a AS (PARTITION BY cell, chrom, arm, sg), m AS (PARTITION BY cell, chrom, arm, major, sg)),
merged AS (SELECT cell, depth, chrom || ':' || CASE WHEN na > 1 AND fa > 0.5 THEN arm WHEN nm > 1 AND fm > 0.5 THEN major ELSE band END AS region, sg, avg(score) AS score, avg(pvalue) AS pvalue, avg(adjustp) AS adjustp FROM shares GROUP BY 1, 2, 3, 4)"""
_round = "round(score, 9) AS score, round(pvalue, 9) AS pvalue, round(adjustp, 9) AS adjustp"


def merged(spark: SparkSession, d: str) -> DataFrame:
    _, _, cells, levels = heap_levels(spark, d)
    own = found(levels, cells).join(F.broadcast(bin_bands(spark).select("chrom", "bin", "band")), ["chrom", "bin"])  # 64 rows
    return regions.by_arm(own.select("cell", "depth", "chrom", "band", "score", "pvalue", "adjustp"), bin_bands(spark).drop("bin"))


@query(f"{HEAPED}, {LEVELS}, {FOUND}, {MERGED} SELECT cell, CAST(depth AS INTEGER) AS depth, region, {_round} FROM merged")
def region_arm_merge(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).select("cell", "depth", "region", _r("score"), _r("pvalue"), _r("adjustp"))


@query(f"{HEAPED}, {LEVELS}, {FOUND}, {MERGED} SELECT region, round(score, 9) AS score, round(pvalue, 9) AS pvalue, round(adjustp, 9) AS adjustp, m.cell, CAST(m.depth AS INTEGER) AS depth, subtreesize, CASE WHEN score < 0 THEN 'DEL' ELSE 'AMP' END AS CNA FROM merged m JOIN lineage USING (cell)")
def result_table(spark: SparkSession, d: str) -> DataFrame:
    path, (tree, spans, cells) = folder(spark, "results"), heaped(spark, d)
    writers.results(lineages.reported(merged(spark, d), lineages.Lineage(tree, spans, cells, "0")), path)
    got = spark.read.csv(path, sep="\t", header=True)
    number = lambda c, name: F.round(F.col(c).cast("double"), 9).alias(name)
    return got.select("region", number("Score", "score"), number("pvalue", "pvalue"), number("adjustp", "adjustp"), "cell", F.col("depth").cast("int"), F.col("subtreesize").cast("long"), "CNA")


@query(f"""{HEAPED}, {LEVELS}, {FOUND}, {MERGED}, split AS (SELECT m.*, split_part(region, ':', 1) AS chrom, substr(split_part(region, ':', 2), 1, 1) AS arm, substr(split_part(region, ':', 2), 2) AS rest FROM merged m),
placed AS (SELECT s.*, CASE WHEN b.band IS NOT NULL THEN 'band' WHEN s.rest <> '' THEN 'major' ELSE 'arm' END AS kind, coalesce(b.bin, try_cast(s.rest AS INTEGER)) AS spot FROM split s LEFT JOIN bands b ON b.chrom || ':' || b.band = s.region),
runs AS (SELECT *, spot - row_number() OVER (PARTITION BY cell, kind, chrom, arm, sg ORDER BY spot) AS island FROM placed WHERE kind <> 'arm'),
joined AS (SELECT cell, depth, CASE WHEN count(*) = 1 THEN min(region) ELSE chrom || ':' || arm || arg_min(rest, spot) || '-' || arg_max(rest, spot) END AS region, avg(score) AS score, avg(pvalue) AS pvalue, avg(adjustp) AS adjustp FROM runs GROUP BY cell, depth, kind, chrom, arm, sg, island
  UNION ALL SELECT cell, depth, region, score, pvalue, adjustp FROM placed WHERE kind = 'arm')
SELECT cell, CAST(depth AS INTEGER) AS depth, region, {_round} FROM joined""")
def region_islands(spark: SparkSession, d: str) -> DataFrame:
    return regions.combined(merged(spark, d), bin_bands(spark).drop("bin")).select("cell", "depth", "region", _r("score"), _r("pvalue"), _r("adjustp"))


#: Rounds of merging in SQL, of which a heap of depth k needs k at most; one more changes nothing.
ROUNDS = 20


def _merging(k: int) -> str:
    """Findings m<k + 1>, from m<k>: those below others go, and several with one parent but the root become it."""
    return f"""t{k} AS (SELECT x.*, tree.parent FROM m{k} x LEFT JOIN tree ON tree.child = x.cell AND tree.parent <> '0'
  WHERE NOT EXISTS (SELECT 1 FROM m{k} y JOIN clo ON clo.anc = y.cell WHERE y.region = x.region AND y.sg = x.sg AND clo.descendant = x.cell AND clo.hops > 0)),
g{k} AS (SELECT region, sg, parent AS cell, min(depth) - 1 AS depth, avg(score) AS score, avg(pvalue) AS pvalue, avg(adjustp) AS adjustp FROM t{k} WHERE parent IS NOT NULL GROUP BY region, sg, parent HAVING count(*) > 1),
m{k + 1} AS (SELECT region, sg, cell, depth, score, pvalue, adjustp FROM t{k} WHERE NOT EXISTS (SELECT 1 FROM g{k} WHERE g{k}.region = t{k}.region AND g{k}.sg = t{k}.sg AND g{k}.cell = t{k}.parent) UNION ALL SELECT * FROM g{k})"""


@query(f"""{HEAPED}, {LEVELS}, {FOUND}, own AS (SELECT cell, depth, chrom || ':' || bin AS region, sign(score) AS sg, score, pvalue, adjustp FROM found),
eligible AS (SELECT cell, depth FROM lineage WHERE subtreesize >= 5 AND cell <> '0'),
pairs AS (SELECT a.region, a.sg, a.cell AS anc, b.cell, b.depth FROM own a JOIN clo ON clo.anc = a.cell JOIN own b ON b.cell = clo.descendant AND b.region = a.region AND b.sg = a.sg),
uppermost AS (SELECT * FROM own o WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.region = o.region AND p.sg = o.sg AND p.cell = o.cell AND p.anc <> o.cell)),
lacking AS (SELECT o.region, o.sg, o.cell, min(e.depth) AS least FROM uppermost o JOIN clo ON clo.anc = o.cell AND clo.hops > 0 JOIN eligible e ON e.cell = clo.descendant
  LEFT JOIN own f ON f.cell = e.cell AND f.region = o.region AND f.sg = o.sg WHERE f.cell IS NULL GROUP BY ALL),
kept AS (SELECT u.region, u.sg, coalesce(arg_min(p.cell, CAST(p.depth AS VARCHAR).lpad(9, '0') || p.cell) FILTER (p.depth >= l.least), u.cell) AS cell FROM uppermost u JOIN pairs p ON p.region = u.region AND p.sg = u.sg AND p.anc = u.cell
  LEFT JOIN lacking l ON l.region = u.region AND l.sg = u.sg AND l.cell = u.cell GROUP BY u.region, u.sg, u.cell),
m0 AS (SELECT own.region, own.sg, own.cell, own.depth, own.score, own.pvalue, own.adjustp FROM own JOIN kept USING (region, sg, cell)),
{", ".join(_merging(k) for k in range(ROUNDS))},
ends AS (SELECT m.*, count(*) OVER w AS n, max(m.depth) OVER w AS deep, (SELECT count(*) FROM m0 WHERE m0.region = m.region AND m0.sg = m.sg) AS n0 FROM m{ROUNDS} m WINDOW w AS (PARTITION BY m.region, m.sg))
SELECT cell, CAST(depth AS INTEGER) AS depth, region, {_round} FROM ends WHERE NOT (n0 > 1 AND deep <= 1 AND n >= (SELECT count(*) FROM eligible JOIN tree ON child = cell WHERE parent = '0'))""")
def refine_merge(spark: SparkSession, d: str) -> DataFrame:
    """Findings without redundant lineages, merged up the tree."""
    tree, spans, cells, levels = heap_levels(spark, d)
    own = found(levels, cells).select("cell", "depth", F.concat_ws(":", "chrom", "bin").alias("region"), "score", "pvalue", "adjustp")
    done = regions.refined(own, trees.closure(tree), tree, trees.eligible(cells, "0"))
    return done.select("cell", "depth", "region", _r("score"), _r("pvalue"), _r("adjustp"))


@query(f"""{HEAPED}, {LEVELS}, {FOUND} SELECT cell, string_agg(region, ',' ORDER BY k) AS label FROM (SELECT cell, chrom || ':' || bin AS region, row_number() OVER (PARTITION BY cell ORDER BY pvalue, abs(score) DESC, chrom || ':' || bin) AS k FROM found) WHERE k <= 3 GROUP BY cell""")
def top3_labels(spark: SparkSession, d: str) -> DataFrame:
    _, _, cells, levels = heap_levels(spark, d)
    return regions.top_labels(found(levels, cells).select("cell", F.concat_ws(":", "chrom", "bin").alias("region"), "score", "pvalue"))
