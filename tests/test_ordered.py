"""Sums and neighbours along an order by ranges, interval labels of trees, and what is built on them."""

import random
import time

from pyspark.sql import functions as F

from cloneforge.operators import genome, ordered, score, trees

TREE = "parent string, child string, dist long"


def random_tree(n, seed, hub=0.0):
    """Parents before children; a share of the nodes hangs on one."""
    rng = random.Random(seed)
    return [(str(0 if rng.random() < hub else rng.randrange(k)), str(k), 1) for k in range(1, n)]


def test_running_sums_of_a_group_of_several_ranges(spark):
    rng = random.Random(1)
    rows = [("a" if k % 3 else None if k % 6 else "b", k, rng.randrange(9)) for k in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    got = {r.k: r.v_before for r in ordered.running(df, ["g"], ["k"], ["v"], 7).collect()}
    sums = {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        assert got[k] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v
    numbers = sorted((r.k, r.no) for r in ordered.numbered(df.where("g = 'a'"), ["g"], ["k"], "no", 6).collect())
    assert [no for _, no in numbers] == list(range(1, len(numbers) + 1))
    assert ordered.numbered(df.limit(0), ["g"], ["k"], "no").collect() == []


def test_spans_hold_the_subtree(spark):
    for seed, hub in ((1, 0.0), (2, 0.5)):
        rows = random_tree(200, seed, hub) + [("x", "y", 1), ("y", "z", 2)]  # a forest
        tree = spark.createDataFrame(rows, TREE)
        spans = {r.cell: (r.first, r.last) for r in trees.spans(tree).collect()}
        assert sorted(a for a, _ in spans.values()) == list(range(203))
        below = {}
        for r in trees.closure(tree).collect():
            below.setdefault(r.anc, set()).add(r.desc)
        for cell, (a, b) in spans.items():
            assert {c for c, (x, _) in spans.items() if a <= x <= b} == below[cell]


def test_levels_and_networks_of_a_long_chain(spark):
    n = 20_000
    chain = spark.range(1, n).select((F.col("id") - 1).cast("string").alias("parent"), F.col("id").cast("string").alias("child"), F.lit(1).cast("long").alias("dist"))
    begin = time.time()
    spans = trees.spans(chain)
    cn = spark.range(n).select(F.col("id").cast("string").alias("cell"), F.lit("f").alias("feature"), F.when(F.col("id") % 4 == 0, 5).when(F.col("id") % 4 == 1, 0).otherwise(2).cast("int").alias("cn"))
    got = {int(r.cell): (r.n, r.amp, r["del"]) for r in score.fold_levels(cn, spans).collect()}
    for k in (0, 1, 777, n - 5, n - 1):
        below = range(k, n)
        assert got[k] == (n - k, sum(3 for x in below if x % 4 == 0) / (n - k), sum(-2 for x in below if x % 4 == 1) / (n - k))
    marked = spark.createDataFrame([(str(k), k) for k in (3, 10_000, n - 1)], "cell string, depth int")
    assert {tuple(r) for r in trees.network(marked, chain).collect()} == {("root", "3", 3), ("3", "10000", 9997), ("10000", str(n - 1), n - 1 - 10_000)}
    assert time.time() - begin < 120


def test_nearest_values_of_a_group_of_several_ranges(spark):
    rng = random.Random(3)
    rows = [("a" if k % 4 else "b", rng.randrange(500), k if rng.random() < 0.3 else None) for k in range(2000)]
    rows = [(g, at, None if v is None else at) for g, at, v in rows] + [("c", 5, None), (None, 7, 7), (None, 9, None)]
    df = spark.createDataFrame(rows, "g string, at int, v int").repartition(3)
    own = {}
    for g, at, v in rows:
        own.setdefault(g, []).extend([] if v is None else [v])
    got = ordered.around(df, ["g"], "at", "v", 7).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.before == max((v for v in own[r.g] if v <= r.at), default=None)
        assert r.after == min((v for v in own[r.g] if v >= r.at), default=None)
    assert ordered.around(df.limit(0), ["g"], "at", "v").collect() == []


def test_nearest_bins_of_one_long_chromosome(spark):
    bins = spark.range(1, 200_001).select(F.lit("1").alias("chrom"), (F.col("id") * 10).alias("pos"), F.col("id").cast("int").alias("bin"))
    points = spark.range(200_000).select(F.lit("1").alias("chrom"), (F.col("id") * 10 + F.col("id") % 10).alias("pos"))
    want = F.greatest(F.lit(1), F.col("pos") / 10 + F.when(F.col("pos") % 10 > 5, 1).otherwise(0)).cast("int")
    got = genome.nearest_bins(points, bins, 8)
    assert got.count() == 200_000 and got.where(F.col("bin") != want).count() == 0
