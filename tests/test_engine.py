import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from cloneforge.functions import numeric
from cloneforge.operators import genome, regions, score, segment, stats, trees
from cloneforge.plans import lineage, queries
from cloneforge.sources import readers, writers
from cloneforge.streaming import levels


def test_half_even(spark):
    df = spark.createDataFrame([(0.25, 1, 2), (0.75, 3, 2), (1.25, 5, 2), (1.3, -1, 2)], "x double, t long, n long")
    got = df.select(numeric.absolute(F.col("x")).alias("a"), numeric.half_even_mean(F.col("t"), F.col("n")).alias("m")).collect()
    assert [r.a for r in got] == [0, 2, 2, 3] and [r.m for r in got] == [0, 2, 2, 0]


@pytest.mark.parametrize(("n", "sizes"), [(1, [1]), (40, [40]), (45, [30, 15]), (50, [30, 20]), (75, [30, 45])])
def test_fixed_count_bins(spark, n, sizes):
    df = spark.range(n).select(F.lit("1").alias("chrom"), "id", F.col("id").alias("v"))
    got = segment.fixed_count_bins(df, ["chrom"], ["id"], "v", 30).orderBy("bin").collect()
    assert [r.n for r in got] == sizes and sum(r.total for r in got) == n * (n - 1) // 2


def test_binned_genes(spark):
    genes = spark.createDataFrame([("a", f"g{k}", 1.0 if k < 30 else 1.6) for k in range(60)] + [("a", "gone", 9.0)], "cell string, gene string, rel double")
    places = spark.createDataFrame([(f"g{k}", "1", k, k + 1) for k in range(60)], "gene string, chrom string, start long, end long")
    assert [(r.bin, r.cn) for r in segment.binned_genes(genes, places).orderBy("bin").collect()] == [(1, 2), (2, 3)]


def test_root_and_duplicates(spark):
    rows = [("a", 2), ("b", 3), ("c", 2), ("d", 3)]
    prof = spark.createDataFrame([(c, "1", b, cn) for c, cn in rows for b in (1, 2)], "cell string, chrom string, bin int, cn int")
    assert segment.with_root(prof)[1] == "a"
    made, name = segment.with_root(prof.where("cell in ('b', 'd')"))
    assert name == "root" and made.where("cell = 'root'").count() == 2
    kept, copies = segment.collapsed(prof)
    assert {r.cell for r in kept.collect()} == {"a", "b"} and {tuple(r) for r in copies.collect()} == {("a", "c"), ("b", "d")}


def test_bands(spark):
    bands = spark.createDataFrame([("1", 0, 10, "p2"), ("1", 10, 20, "p1"), ("1", 20, 40, "q1.1"), ("1", 40, 50, "q1.2")], "chrom string, start long, end long, band string")
    points = spark.createDataFrame([("1", p) for p in (0, 1, 10, 11, 40, 51)], "chrom string, pos long")
    want = {(1, "p2"), (10, "p2"), (11, "p1"), (40, "q1.1")}
    assert {(r.pos, r.band) for r in genome.in_bands(points, bands).collect()} == want
    # intervals that overlap hold a point each, whatever their lengths
    nested = bands.unionByName(spark.createDataFrame([("1", 5, 1000, "x"), ("1", 7, 7, "empty")], bands.schema))
    assert {(r.pos, r.band) for r in genome.in_bands(points, nested).collect()} == want | {(10, "x"), (11, "x"), (40, "x"), (51, "x")}
    assert genome.in_bands(points, bands.limit(0)).count() == 0
    assert {(r.band, r.start, r.end) for r in genome.arms(bands).collect()} == {("p", 0, 20), ("q", 20, 50)}
    assert {(r.band, r.length) for r in genome.major_bands(bands).collect()} == {("p2", 10), ("p1", 10), ("q1", 30)}


def test_gene_votes(spark):
    bins = spark.createDataFrame([("1", 10 * k, k) for k in range(1, 7)], "chrom string, pos long, bin int")
    genes = spark.createDataFrame([("flat", "1", 10, 20), ("up", "1", 30, 50), ("tie", "1", 50, 58), ("tie2", "1", 53, 60)], "gene string, chrom string, start long, end long")
    cn = {1: 2, 2: 2, 3: 4, 4: 3, 5: 1, 6: 3}
    prof = spark.createDataFrame([("a", "1", b, v) for b, v in cn.items()], "cell string, chrom string, bin int, cn int")
    got = {r.gene: r.cn for r in genome.gene_votes(genome.gene_spans(genes, bins), prof).collect()}
    assert got == {"flat": 2, "up": 4, "tie": 1, "tie2": 3}


def test_nearest_tie_takes_the_smaller_bin(spark):
    bins = spark.createDataFrame([("1", 10, 1), ("1", 20, 2)], "chrom string, pos long, bin int")
    points = spark.createDataFrame([("1", p) for p in (3, 15, 16, 99)], "chrom string, pos long")
    assert {(r.pos, r.bin) for r in genome.nearest_bins(points, bins).collect()} == {(3, 1), (15, 1), (16, 2), (99, 2)}


def test_adjusted(spark):
    df = spark.createDataFrame([("x", p) for p in (0.01, 0.02, 0.02, 0.5)] + [("y", 0.9)], "g string, pvalue double")
    got = [(r.g, r.pvalue, round(r.adjustp, 6)) for r in stats.adjusted(df, ["g"]).orderBy("g", "pvalue").collect()]
    assert got == [("x", 0.01, 0.026667), ("x", 0.02, 0.026667), ("x", 0.02, 0.026667), ("x", 0.5, 0.5), ("y", 0.9, 0.9)]


def test_empirical(spark):
    obs = spark.createDataFrame([("a", 0.5), ("b", -0.5), ("c", 1.0)], "f string, score double")
    back = spark.createDataFrame([("a", x) for x in (0.1, 0.5, 0.9)] + [("b", x) for x in (-0.1, -0.2)], "f string, score double")
    assert {r.f: r.pvalue for r in stats.empirical(obs, back, ["f"]).collect()} == {"a": 0.75, "b": 1 / 3}


def test_shuffled_cells_are_a_bijection(spark):
    cells = spark.createDataFrame([(f"c{k}",) for k in range(20)], "cell string")
    chroms = spark.createDataFrame([("1",), ("2",)], "chrom string")
    perms = spark.range(1, 4).select(F.col("id").cast("int").alias("perm_id"))
    got = score.shuffled_cells(cells, chroms, perms)
    assert got.count() == 120
    assert got.groupBy("perm_id", "chrom").agg(F.count_distinct("label").alias("n")).where("n <> 20").count() == 0
    assert got.where("cell <> label").count() > 60


def test_adaptive_permutations():
    assert score.goes_on(5, 1.0) and not score.goes_on(20, 0.2) and not score.goes_on(30, 0.0001) and score.goes_on(30, 0.07)
    assert not score.goes_on(60, 0.07) and score.goes_on(60, 0.03) and not score.goes_on(100, 0.03)
    assert [score.permutations_needed(*x) for x in ((6000, 10), (10, 3000), (1500, 10), (10, 10))] == [30, 30, 50, 100]


BANDS = [("1", 0, 10, "p2"), ("1", 10, 20, "p1"), ("1", 20, 25, "q1.1"), ("1", 25, 30, "q1.2"), ("1", 30, 50, "q2"), ("1", 50, 70, "q3")]


def findings(spark, rows):
    return spark.createDataFrame([("a", 1, c, b, s, 0.01, 0.02) for c, b, s in rows], "cell string, depth int, chrom string, band string, score double, pvalue double, adjustp double")


def test_arm_merge(spark):
    bands = spark.createDataFrame(BANDS, "chrom string, start long, end long, band string")
    merge = lambda rows: {(r.region, round(r.score, 6)) for r in regions.by_arm(findings(spark, rows), bands).collect()}
    assert merge([("1", "p2", 1.0), ("1", "p1", 2.0)]) == {("1:p", 1.5)}
    assert merge([("1", "p2", 1.0), ("1", "p1", -2.0)]) == {("1:p2", 1.0), ("1:p1", -2.0)}
    assert merge([("1", "q1.1", 1.0), ("1", "q1.2", 3.0)]) == {("1:q1", 2.0)}
    assert merge([("1", "q1.1", 1.0), ("1", "q2", 3.0)]) == {("1:q1.1", 1.0), ("1:q2", 3.0)}


def test_islands(spark):
    bands = spark.createDataFrame(BANDS, "chrom string, start long, end long, band string")
    rows = [("1:q1.1", 1.0), ("1:q1.2", 2.0), ("1:q2", 3.0), ("1:q3", -1.0), ("1:p2", 4.0), ("1:p", -2.0)]
    df = spark.createDataFrame([("a", 1, r, s, 0.01, 0.02) for r, s in rows], "cell string, depth int, region string, score double, pvalue double, adjustp double")
    assert {(r.region, r.score) for r in regions.combined(df, bands).collect()} == {("1:q1.1-2", 2.0), ("1:q3", -1.0), ("1:p2", 4.0), ("1:p", -2.0)}


def test_refined(spark):
    rows = [("r", "a"), ("a", "b"), ("a", "c"), ("r", "d"), ("d", "e"), ("r", "f")]
    tree = spark.createDataFrame([(a, b, 1) for a, b in rows], "parent string, child string, dist bigint")
    closed = trees.closure(tree)
    cells = trees.lineages(closed).where("cell <> 'r'")
    make = lambda cs: spark.createDataFrame([(c, d, "1:p", 1.0, 0.01, 0.02) for c, d in cs], "cell string, depth int, region string, score double, pvalue double, adjustp double")
    keep = lambda cs: sorted(r.cell for r in regions.refined(make(cs), closed, tree, cells).collect())
    assert keep([("a", 1), ("b", 2), ("c", 2)]) == ["a"]  # all below have it
    assert keep([("a", 1), ("b", 2)]) == ["b"]  # c has not
    assert keep([("b", 2), ("c", 2)]) == ["a"]  # two children become the parent
    assert keep([("e", 2)]) == ["e"]


def test_top_labels(spark):
    df = spark.createDataFrame([("a", f"r{k}", 1.0, 0.1 * k) for k in range(5)], "cell string, region string, score double, pvalue double")
    assert [r.label for r in regions.top_labels(df).collect()] == ["r0,r1,r2"]


def test_text_tables(spark, tmp_path):
    dna = tmp_path / "dna.txt"
    dna.write_text("chrom\tpos\tc1\tc2\n7\t100\t2\t3\n7\t50\t1\t2\nX\t5\t2\t0\n")
    bins = readers.dna_matrix(spark, str(dna))
    assert {tuple(r) for r in bins.collect()} >= {("c1", "7", 100, 2), ("c2", "23", 5, 0)} and bins.count() == 6
    assert readers.dna_matrix(spark, str(dna), None).count() == 6
    prof = segment.numbered_bins(bins)
    assert {(r.chrom, r.bin, r.cn) for r in prof.where("cell = 'c1'").collect()} == {("7", 1, 1), ("7", 2, 2), ("23", 1, 2)}
    writers.profiles(prof, str(tmp_path / "wide"))
    wide = spark.read.csv(str(tmp_path / "wide"), sep="\t", header=True)
    assert wide.columns == ["cell", "chr7_1", "chr7_2", "chr23_1"]
    seg = tmp_path / "seg.txt"
    seg.write_text("chr7_1\tchr7_2\nc1\t2\t3\nc2\t1\t2\n")
    assert {tuple(r) for r in readers.segmented(spark, str(seg)).collect()} == {("c1", "7", 1, 2), ("c1", "7", 2, 3), ("c2", "7", 1, 1), ("c2", "7", 2, 2)}
    rna = tmp_path / "rna.txt"
    rna.write_text("gene\tc1\tc2\ng1\t1.0\t1.5\n")
    assert {tuple(r) for r in readers.rna_matrix(spark, str(rna)).collect()} == {("c1", "g1", 1.0), ("c2", "g1", 1.5)}
    tree = spark.createDataFrame([("r", "a", 5)], "parent string, child string, dist bigint")
    writers.tree(tree, str(tmp_path / "tree"))
    assert readers.tree(spark, str(tmp_path / "tree")).collect() == tree.collect()


def test_synthetic(spark):
    got = readers.synthetic(spark, 20, 10)
    assert got.count() == 200 and got.select("cell").distinct().count() == 10 and got.where("rel < 0.1").count() == 0


def test_whole_analysis(spark):
    """A clone with a gained arm among cells without changes is found."""
    rows = []
    for k in range(24):
        for chrom, n in (("1", 8), ("2", 8)):
            for b in range(n):
                if k >= 12:  # cells of the clone, each with one change more than the one before
                    cn = 4 if chrom == "1" and b < 4 else 3 if chrom == "2" and b < k - 12 else 2
                else:
                    cn = 3 if chrom == "2" and k > 1 and b == k % 8 else 2
                rows.append((f"c{k:02d}", chrom, 10 * b + 5, cn))
    bins = spark.createDataFrame(rows, "cell string, chrom string, pos long, cn int")
    bands = spark.createDataFrame([(c, 40 * h, 40 * h + 40, "pq"[h] + "1") for c in "12" for h in (0, 1)], "chrom string, start long, end long, band string")
    out = lineage.dna(spark, bins, bands, n_perm=60, cutoff=0.05)
    facts = out["tree"].agg(F.count(F.lit(1)).alias("n")).first()
    assert facts.n == 23
    assert out["segmental"].where("CNA = 'AMP' and region = '1:p1'").count() >= 1
    assert set(out["segmental"].columns) == {"region", "Score", "pvalue", "adjustp", "cell", "depth", "subtreesize", "CNA"}
    assert out["parallel"].columns == ["region", "lineage", "pvalue"]


def clone_of_genes():
    """Relative numbers of 24 cells on two chromosomes of 40 genes; in half of them a chromosome's first half is doubled."""
    rows = []
    for k in range(24):
        for c in (1, 2):
            for g in range(40):
                clone = 2.0 if k >= 12 and c == 1 and g < 20 else 1.5 if k >= 12 and c == 2 and g < 2 * (k - 12) else 1.5 if 1 < k < 12 and c == 2 and g // 5 == k % 8 else 1.0
                rows.append((f"c{k:02d}", f"g{c}_{g}", clone))
    places = [(f"g{c}_{g}", str(c), 10 * g + 1, 10 * g + 9) for c in (1, 2) for g in range(40)] + [("gM", "M", 1, 2)]
    bands = [(str(c), 200 * h, 200 * h + 200, "pq"[h] + "1") for c in (1, 2) for h in (0, 1)]
    return rows, places, bands


@pytest.mark.parametrize("n_trees", [0, 12])
def test_whole_analysis_of_rna(spark, n_trees):
    rows, places, bands = clone_of_genes()
    genes = spark.createDataFrame(rows + [("c00", "unknown", 1.0), ("c01", "gM", 9.0)], "cell string, gene string, rel double")
    annotation = spark.createDataFrame(places, "gene string, chrom string, start long, end long")
    bands = spark.createDataFrame(bands, "chrom string, start long, end long, band string")
    pathways = spark.createDataFrame([("1", 1, 2, f"g1_{g}", "p") for g in (0, 30)] + [("1", 1, 2, "g1_0", "q")], "chrom string, start long, end long, name string, pathway string")
    out = lineage.rna(spark, genes, annotation, bands, width=5, n_perm=40, cutoff=0.4 if n_trees else 0.05, pathways=pathways, n_trees=n_trees)
    assert out["tree"].count() in (23, 24)
    # of the pathways' genes the one that the clone has twice
    assert {r.feature for r in out["gene_levels"].select("feature").distinct().collect()} == {"g1_0", "g1_30"}
    if n_trees:  # a chromosome keeps its clone in permuted trees, so that these find it too
        assert out["band_tests"].where("pvalue > 0 and pvalue <= 1").count() == out["band_tests"].count() > 0
    else:
        assert out["segmental"].where("CNA = 'AMP' and region = '1:p1'").count() >= 1
        assert {r.region for r in out["gene"].where("CNA = 'AMP'").collect()} == {"g1_0"}
    assert out["parallel"].columns == ["region", "lineage", "pvalue"]


def test_tree_of_near_cells(spark):
    rows = [(f"c{k}", "1", b, 2 + k * (b == 1)) for k in range(4) for b in range(1, 6)]
    prof = spark.createDataFrame(rows, "cell string, chrom string, bin int, cn int")
    coords = spark.createDataFrame([("c0", 0.0, 0.0), ("c1", 0.0, 100.0), ("c2", 0.0, 10.0), ("c3", 0.0, 105.0)], "cell string, x double, y double")
    near = lineage.infer(prof, coords=coords)
    # c2 isn't near c1, nor c3 near c2: the root, which has no place, stands in
    assert {(r.parent, r.child) for r in near.tree.collect()} == {("c0", "c1"), ("c0", "c2"), ("c1", "c3")}
    assert near.root == "c0"


@pytest.mark.parametrize("small", [0, 4000])
def test_a_root_that_does_not_reach_all(spark, monkeypatch, small):
    prof = spark.createDataFrame([("a", "1", 1, 2), ("b", "1", 1, 3)], "cell string, chrom string, bin int, cn int")
    monkeypatch.setattr(lineage.distance, "all_pairs", lambda *a, **k: spark.createDataFrame([("b", "a", 1)], "src string, dst string, w bigint"))
    monkeypatch.setattr(lineage.implicit, "tree", lambda *a, **k: None)
    with pytest.raises(ValueError):
        lineage.infer(prof, small=small)


def test_permutations_stop_when_of_no_more_use(spark):
    rows, places, bands = clone_of_genes()
    genes = spark.createDataFrame(rows, "cell string, gene string, rel double")
    annotation = spark.createDataFrame(places, "gene string, chrom string, start long, end long")
    own = lineage.infer(segment.binned_genes(genes, annotation, 5))
    numbers = lineage.relative_bands(genes, annotation, spark.createDataFrame(bands, "chrom string, start long, end long, band string"))
    tests, n = lineage.adaptively_tested(numbers, own, step=25)
    rows = tests.collect()
    assert 25 <= n <= 100 and rows
    for r in rows:  # each went on as long as it was of use, and no longer
        assert r.n % 25 == 0 and r.n <= n and not score.goes_on(r.n, r.pvalue) and r.pvalue == (r.extreme + 1) / (r.n + 1)
    # the counts are those of the permutations themselves
    _, permuted, whole, _ = lineage.tested(numbers, own, 25)
    by = {(r.cell, r.feature, r.direction): r.pvalue for r in whole.collect()}
    assert all(by[r.cell, r.feature, r.direction] == r.pvalue for r in rows if r.n == 25)


def test_permutations_come_in_whole_steps(spark, monkeypatch):
    """Where fewer are asked for than whole steps make, the last step is made in full, as in SQL."""
    prof = spark.createDataFrame([(str(k), "1", b, 2 + (k * b) % 3) for k in range(12) for b in (1, 2)], "cell string, chrom string, bin int, cn int")
    tree = spark.createDataFrame([(str(k // 2), str(k), 1) for k in range(1, 12)], "parent string, child string, dist long")
    cells = trees.measured(tree)
    monkeypatch.setattr(score, "permutations_needed", lambda *_: 30)
    tests, n = lineage.adaptively_tested(prof, lineage.Lineage(tree, trees.spans(tree, cells), cells, "0"), step=20, feature=["chrom", "bin"])
    monkeypatch.setattr(score, "of_use", lambda n, p, most: n < most)
    whole, _ = lineage.adaptively_tested(prof, lineage.Lineage(tree, trees.spans(tree, cells), cells, "0"), step=20, feature=["chrom", "bin"])
    assert n in (20, 40) and {r.n for r in tests.collect()} <= {20, 40} and {r.n for r in whole.collect()} == {40}


def test_wide_inputs_get_as_many_permutations_as_others(spark, monkeypatch):
    prof = spark.range(8).select(F.col("id").cast("string").alias("cell"), F.lit("1").alias("chrom"), F.explode(F.sequence(F.lit(1), F.lit(2001))).alias("bin")).withColumn("cn", F.pmod(F.xxhash64("cell", "bin"), F.lit(3)).cast("int") + 1)
    tree = spark.createDataFrame([(str(k // 2), str(k), 1) for k in range(1, 8)], "parent string, child string, dist long")
    cells = trees.measured(tree)
    monkeypatch.setattr(score, "of_use", lambda n, p, most: n < most)
    tests, n = lineage.adaptively_tested(prof, lineage.Lineage(tree, trees.spans(tree, cells), cells, "0"), step=50, least_size=3, feature=["chrom", "bin"])
    assert n == 100 and {r.n for r in tests.select("n").distinct().collect()} == {100}


def test_levels_of_many_features(spark):
    rng = random.Random(4)
    cn = {(c, f): rng.randrange(5) for c in "abcdef" for f in range(21) if rng.random() < 0.9}
    df = spark.createDataFrame([(c, "1", f"f{f}", n) for (c, f), n in cn.items()], "cell string, chrom string, feature string, cn int")
    spans = spark.createDataFrame([("a", 0, 5), ("b", 1, 2)] + [(x, k + 2, k + 2) for k, x in enumerate("cdef")], "cell string, first bigint, last bigint")
    got = {(r.cell, r.feature): (r.n, r.amp, r["del"]) for r in score.fold_levels(df, spans, spans.where("cell in ('a', 'b')"), ["chrom", "feature"]).collect()}
    want = {}
    for top, members in (("a", "abcdef"), ("b", "bc")):
        for f in range(21):
            own = [cn[c, f] for c in members if (c, f) in cn]
            if own:
                want[top, f"f{f}"] = (len(own), sum(max(0, x - 2) for x in own) / len(own), sum(min(0, x - 2) for x in own) / len(own))
    assert got == want


def test_permuted_trees(spark):
    prof = spark.createDataFrame([(f"c{k}", c, b, 2 + (k + b) % 3) for k in range(6) for c in "12" for b in (1, 2, 3)], "cell string, chrom string, bin int, cn int")
    got = lineage.shuffled_trees(prof, 3)
    assert {(r.perm_id, r["count"]) for r in got.groupBy("perm_id").count().collect()} == {(1, 6), (2, 6), (3, 6)}


def test_stream(spark, tmp_path):
    closed = spark.createDataFrame([("r", "r"), ("r", "a"), ("a", "a")], "anc string, desc string")
    spark.createDataFrame([("r", "f", 2), ("a", "f", 5)], "cell string, feature string, cn int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cell string, feature string, cn int").parquet(str(tmp_path / "in"))
    q = levels.running_levels(stream, closed).writeStream.outputMode("complete").format("memory").queryName("levels").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from levels").collect()} == {("r", "f", 2, 3, 0), ("a", "f", 1, 3, 0)}


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["rel_to_abs_round", "fixed_count_binning", "profile_dedup", "med_symmetric", "least_incoming", "subtree_closure", "point_in_band", "nearest_bin", "gene_cn_vote", "cfl_score", "bh_adjust", "region_islands", "parallel_test", "dna_matrix", "dna_matrix_by_blanks", "rna_segments", "segmented_profile", "annotation", "pathway_genes", "duplicate_tables", "synthetic_source", "rdmst_in_rounds", "contracted_cycles", "spanning_forest", "reached", "approximate_distances", "quick_distances", "permuted_tree_test", "result_table"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda it: sorted(map(repr, it))
    assert rows(tuple(r) for r in got.select(*cols).collect()) == rows(want.select(*cols).fetchall())


def test_a_background_by_size_is_that_of_the_matched_lineages(spark, monkeypatch):
    monkeypatch.setattr(stats, "TOGETHER", 2)
    rng = random.Random(4)
    real = spark.createDataFrame([(f"c{k}", k % 4 + 5) for k in range(12)], "cell string, subtreesize long")
    sizes = spark.createDataFrame([(p, f"p{k}", rng.choice([5, 7, 9])) for p in (1, 2) for k in range(11)], "perm_id int, cell string, subtreesize long")
    row = lambda: (rng.randint(0, 4) / 4, -rng.randint(0, 4) / 4)
    levels = spark.createDataFrame([(f"c{k}", f, 1, *row()) for k in range(12) for f in "xy"], "cell string, feature string, n long, amp double, del double")
    permuted = spark.createDataFrame([(p, f"p{k}", f, *row()) for p in (1, 2) for k in range(11) for f in "xy"], "perm_id int, cell string, feature string, amp double, del double")
    matched = stats.size_matched(real, sizes)
    own, theirs = {r.cell: r.subtreesize for r in real.collect()}, sizes.collect()
    near = {(c, r.perm_id, r.cell) for c, n in own.items() for r in theirs if abs(r.subtreesize - n) == min(abs(x.subtreesize - n) for x in theirs if x.perm_id == r.perm_id)}
    assert sorted(map(tuple, matched.select("cell", "perm_id", "pcell").collect())) == sorted(near)
    told = lambda df: sorted(map(tuple, df.select("cell", "feature", "direction", "score", "pvalue", "adjustp").collect()))
    assert told(stats.significance_by_size(levels, permuted, real, sizes)) == told(stats.significance(levels, permuted, matched))


def test_backgrounds_of_a_common_size_are_met_by_several_tasks(spark):
    """Few sizes, and one of most lineages, on both sides."""
    real = spark.range(300).select(F.concat(F.lit("c"), "id").alias("cell"), F.when(F.col("id") < 280, 7).otherwise(9).cast("long").alias("subtreesize"))
    sizes = spark.range(400).select(F.lit(1).alias("perm_id"), F.concat(F.lit("p"), "id").alias("cell"), F.when(F.col("id") < 390, 6).otherwise(10).cast("long").alias("subtreesize"))
    got = stats.size_matched(real, sizes)
    rows = got.collect()
    assert len(rows) == len({tuple(r) for r in rows}) == 280 * 390 + 20 * 10
    assert all((int(r.cell[1:]) < 280) == (int(r.pcell[1:]) < 390) for r in rows)
    assert got.select(F.spark_partition_id()).distinct().count() > 1
