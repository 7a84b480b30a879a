"""Matrices of very many columns, read and written without a plan that grows with them."""

import time

from pyspark.sql import functions as F

from cloneforge.sources import readers, writers


def test_a_matrix_of_many_cells(spark, tmp_path):
    n = 100_000
    lines = ["\t".join(["chrom", "pos", *[f"c.{k}" for k in range(n)]])] + ["\t".join([f"chr{b}", str(b * 10), *[str((b + k) % 5) for k in range(n)]]) for b in (1, 2)]
    (tmp_path / "m.txt").write_text("\n".join(lines) + "\n")
    t = time.time()
    got = readers.dna_matrix(spark, str(tmp_path / "m.txt"))
    r = got.agg(F.count(F.lit(1)), F.sum("cn"), F.countDistinct("cell")).first()
    assert tuple(r) == (2 * n, sum((b + k) % 5 for b in (1, 2) for k in range(n)), n) and time.time() - t < 60
    assert [tuple(r) for r in got.where("cell = 'c.99999'").orderBy("pos").collect()] == [("c.99999", "1", 10, 0), ("c.99999", "2", 20, 1)]


def test_lines_of_other_lengths_and_headers_in_each_file(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.txt").write_text('chrom\tpos\t"a b"\tc\n1\t10\t2\n\n2\t20\t3\t4\t9\n')
    (tmp_path / "m" / "b.txt").write_text('chrom\tpos\t"a b"\tc\nX\t30\t\tNA\n')
    got = {(r.cell, r.chrom, r.pos): r.cn for r in readers.dna_matrix(spark, str(tmp_path / "m")).collect()}
    assert got == {("a b", "1", 10): 2, ("c", "1", 10): None, ("a b", "2", 20): 3, ("c", "2", 20): 4, ("a b", "23", 30): None, ("c", "23", 30): None}
    (tmp_path / "none.txt").write_text("chrom\tpos\n")
    assert readers.dna_matrix(spark, str(tmp_path / "none.txt")).collect() == []


def test_wide_tables_are_those_of_a_pivot(spark, tmp_path):
    rows = [(c, ch, b, None if (c, b) == ("x", 2) else b + len(ch)) for c in ("x", "y", "a b") for ch in ("1", "10", "2") for b in (1, 2, 3) if (c, ch, b) not in (("x", "1", 1), ("y", "10", 3), ("y", "2", 3), ("a b", "10", 1))]
    prof = spark.createDataFrame(rows, "cell string, chrom string, bin int, cn int")
    writers.profiles(prof, str(tmp_path / "wide"))
    want = writers.wide_profiles(prof)
    got = spark.read.csv(str(tmp_path / "wide"), sep="\t", header=True)
    assert got.columns == want.columns
    text = lambda df: sorted(tuple(None if v is None else str(v) for v in r) for r in df.collect())
    assert text(got) == text(want)
    edges = spark.createDataFrame([("a", "b", 3), ("b", "a", 4), ("c", "a", 1_000_000), ("a", "d", 2)], "src string, dst string, w long")
    writers.distances(edges, str(tmp_path / "d"))
    assert text(spark.read.csv(str(tmp_path / "d"), sep="\t", header=True)) == text(writers.wide_distances(edges))
    long = spark.range(40_000).select((F.col("id") % 2).cast("string").alias("cell"), F.lit("1").alias("chrom"), F.floor(F.col("id") / 2).cast("int").alias("bin"), (F.col("id") % 7).cast("int").alias("cn"))
    writers.profiles(long, str(tmp_path / "long"))
    lines = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "long")).collect()]
    assert {len(x) for x in lines} == {20_001} and [x[-1] for x in lines if x[0] == "1"] == [str(39_999 % 7)]
