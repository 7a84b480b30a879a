import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloneforge.operators import distance


def greedy(u, v, zero="none"):
    """Steps on stretches, one after another."""
    if zero == "directed" and any(a == 0 and b != 0 for a, b in zip(u, v)):
        return distance.PENALTY
    if zero == "symmetric":
        if any((a == 0) != (b == 0) for a, b in zip(u, v)):
            return distance.PENALTY
        u, v = zip(*[(a, b) for a, b in zip(u, v) if a or b]) if any(a or b for a, b in zip(u, v)) else ((), ())
    d, n = [a - b for a, b in zip(u, v)], 0
    while any(d):
        i = next(k for k, x in enumerate(d) if x)
        sign, j = (1 if d[i] > 0 else -1), i
        while j < len(d) and d[j] * sign > 0:
            d[j] -= sign
            j += 1
        n += 1
    return n


@pytest.mark.parametrize("mode", distance.MODES)
def test_blocks_equal_greedy(mode):
    rng = np.random.default_rng(5)
    a, b = rng.choice(5, (30, 24), p=[0.03, 0.2, 0.5, 0.17, 0.1]), rng.choice(5, (20, 24), p=[0.03, 0.2, 0.5, 0.17, 0.1])
    cuts = [0, 7, 8, 24]
    there, back = distance.block_distance(a, b, cuts, mode)
    for i in range(len(a)):
        for j in range(len(b)):
            parts = [(a[i, lo:hi].tolist(), b[j, lo:hi].tolist()) for lo, hi in zip(cuts, cuts[1:])]
            assert there[i, j] == sum(greedy(x, y, mode) for x, y in parts)
            assert back[i, j] == sum(greedy(y, x, mode) for x, y in parts)


CASES = [([5, 3, 5, 1], [2, 2, 2, 2], 6, 6), ([0, 2], [1, 2], 1_000_000, 1_000_000), ([1, 2], [0, 2], 1, 1_000_000), ([3, 0, 3], [2, 0, 2], 2, 1)]


def test_fixtures_in_columns(spark):
    df = spark.createDataFrame([(k, u, v) for k, (u, v, _, _) in enumerate(CASES)], "k int, u array<int>, v array<int>")
    got = df.select("k", *[distance.steps(F.col("u"), F.col("v"), m).alias(m) for m in ("directed", "symmetric")]).orderBy("k").collect()
    assert [(r.directed, r.symmetric) for r in got] == [(d, s) for _, _, d, s in CASES]


def profiles(spark, n=12, bins=9, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(f"c{k:02d}", str(c), rng.choice(5, bins, p=[0.05, 0.2, 0.5, 0.15, 0.1]).tolist()) for k in range(n) for c in (1, 2)]
    return spark.createDataFrame(rows, "cell string, chrom string, cns array<int>"), rows


@pytest.mark.parametrize("block", [3, 256])
def test_all_pairs(spark, block):
    packed, rows = profiles(spark)
    got = {(r.src, r.dst): r.w for r in distance.all_pairs(packed, "directed", block=block).collect()}
    by = {}
    for cell, chrom, cns in rows:
        by.setdefault(cell, {})[chrom] = cns
    want = {(a, b): sum(greedy(by[a][c], by[b][c], "directed") for c in by[a]) for a in by for b in by if a != b}
    assert got == want
    pairs = spark.createDataFrame(list(want), "src string, dst string")
    assert {(r.src, r.dst): r.w for r in distance.pair_distance(pairs, packed).collect()} == want


def test_sparse_equals_dense(spark):
    packed, _ = profiles(spark)
    dense = {(r.src, r.dst): r.w for r in distance.all_pairs(packed, "none").where("src < dst").collect()}
    sparse = {(r.src, r.dst): r.w for r in distance.sparse_pairs(packed).collect()}
    assert sparse and all(dense[k] == w for k, w in sparse.items())


def test_sparse_has_pairs_that_share_no_breakpoint(spark):
    cells = {"flat": [2, 2, 2, 2], "also": [2, 2, 2, 2], "left": [3, 2, 2, 2], "right": [2, 2, 2, 5], "same": [3, 3, 2, 2]}
    packed = spark.createDataFrame([(c, k, v if k == "1" else [2, 2]) for c, v in cells.items() for k in ("1", "2")], "cell string, chrom string, cns array<int>")
    dense = sorted(map(tuple, distance.all_pairs(packed, "none").where("src < dst").select("src", "dst", "w").collect()))
    assert len(dense) == 10
    for block in (2, 256):
        assert sorted(map(tuple, distance.sparse_pairs(packed, block).collect())) == dense


def test_properties(spark):
    packed, _ = profiles(spark, 8)
    w = {(r.src, r.dst): r.w for r in distance.all_pairs(packed, "none").collect()}
    names = sorted({a for a, _ in w})
    assert all(w[a, b] == w[b, a] for a, b in w)
    assert all(w[a, c] <= w[a, b] + w[b, c] for a in names for b in names for c in names if len({a, b, c}) == 3)


def test_cells_of_other_shapes_raise(spark):
    rows = [("a", "1", [2, 2, 3]), ("b", "1", [2, 2])]
    with pytest.raises(Exception, match="differ in their chromosomes or bins"):
        distance.all_pairs(spark.createDataFrame(rows, "cell string, chrom string, cns array<int>")).collect()


def test_near_pairs(spark):
    rng = np.random.default_rng(1)
    pts = [(f"c{k}", float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-100, 100, (80, 2)))]
    got = {(r.src, r.dst) for r in distance.near_pairs(spark.createDataFrame(pts, "cell string, x double, y double"), 30.0).collect()}
    assert got == {(a, b) for a, x, y in pts for b, p, q in pts if a != b and (x - p) ** 2 + (y - q) ** 2 < 900}


@pytest.mark.parametrize("alike, together", [(100, 1000), (2, 3)])
def test_near_pairs_of_crowded_squares(spark, monkeypatch, alike, together):
    monkeypatch.setattr(distance, "ALIKE", alike)
    monkeypatch.setattr(distance, "TOGETHER", together)
    rng = np.random.default_rng(2)
    pts = [(f"c{k}", float(x) * 10, float(y) * 10) for k, (x, y) in enumerate(rng.integers(-4, 5, (150, 2)))] + [("far", 1e12, -1e12), ("zero", -0.0, 0.0)]
    none = [("n1", None, 0.0), ("n2", float("nan"), 0.0), ("n3", float("inf"), 0.0), ("n4", 0.0, float("-inf")), ("n5", float("inf"), 0.0)]
    near = distance.near_pairs(spark.createDataFrame(pts + none, "cell string, x double, y double"), 30.0)
    got = [(r.src, r.dst) for r in near.collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, x, y in pts for b, p, q in pts if a != b and (x - p) ** 2 + (y - q) ** 2 < 900}
    assert near.select(F.spark_partition_id()).distinct().count() > 1  # small tables that make many pairs aren't joined in one task


def test_approximate_is_exact_within_the_sample(spark):
    packed, _ = profiles(spark)
    exact = {(r.src, r.dst): r.w for r in distance.all_pairs(packed, "none").collect()}
    got = {(r.src, r.dst): r.w for r in distance.approximate(packed, 3, "none").collect()}
    assert set(got) == set(exact)


@pytest.mark.parametrize("mode", distance.MODES)
@pytest.mark.parametrize("block", [3, 256])
def test_what_is_kept_of_pairs_is_what_all_pairs_give(spark, mode, block):
    packed, _ = profiles(spark)
    edges = distance.all_pairs(packed, mode, block=block).cache()
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(distance.summary_of_pairs(packed, mode, block).select("n_pairs", "min_w", "max_w", "mean_w", "sum_w"), distance.summary(edges))
    assert same(distance.asymmetry_of_pairs(packed, mode, block), distance.asymmetry(edges))
    assert same(distance.histogram_of_pairs(packed, mode, 5, block), distance.histogram(edges, 5))
    assert same(distance.least(packed, mode, block=block), edges.groupBy("dst").agg(F.min(F.struct("w", "src")).alias("e")).select("e.src", "dst", "e.w"))
    assert same(distance.least(packed, mode, smaller=True, block=block), edges.where("src < dst").groupBy("dst").agg(F.min(F.struct("w", "src")).alias("e")).select("e.src", "dst", "e.w"))
    least = edges.groupBy("src").agg(F.min(F.struct("w", "dst")).alias("e")).select("src", "e.dst", "e.w")
    assert same(distance.least(packed, mode, out=True, block=block), least)
    less = least.select(F.col("src").alias("cell"), F.col("w").alias("less"))
    assert same(distance.all_pairs(packed, mode, block=block, less=less), edges.join(less, edges.src == less.cell).select("src", "dst", F.col("w") - F.col("less")))


def test_tiles_of_numbers_far_apart():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 3_000, (20, 9))
    for m in (a, a % 7):
        for mode in distance.MODES:
            one, two = distance.block_distance(m, m, [0, 4, 9], mode), distance._plain_distance(m, m, [0, 4, 9], mode)
            assert (one[0] == two[0]).all() and (one[1] == two[1]).all()


@pytest.mark.parametrize("block", [25, 600])
def test_pairs_are_opened_from_tiles(spark, block):
    """Blocks of several tiles, the last ones narrower than a tile; groups of their own, which have no cells in some blocks."""
    rng = np.random.default_rng(7)
    m = rng.choice(5, (300, 6), p=[0.05, 0.2, 0.5, 0.15, 0.1])
    rows = [(g, f"c{k:03d}", c, m[k, 3 * c - 3 : 3 * c].tolist()) for g, n in (("x", 300), ("y", 40)) for k in range(n) for c in (1, 2)]
    packed = spark.createDataFrame(rows, "g string, cell string, chrom int, cns array<int>").withColumn("chrom", F.col("chrom").cast("string"))
    got = distance.all_pairs(packed, "directed", ["g"], block=block).toArrow().to_pylist()
    there, _ = distance.block_distance(m, m, [0, 3, 6], "directed")
    want = {(g, f"c{i:03d}", f"c{j:03d}"): int(there[i, j]) for g, n in (("x", 300), ("y", 40)) for i in range(n) for j in range(n) if i != j}
    assert len(got) == len(want) and {(r["g"], r["src"], r["dst"]): r["w"] for r in got} == want


def test_blocks_are_parted(monkeypatch):
    monkeypatch.setattr(distance, "BLOCK", 10)
    m = np.random.default_rng(3).choice(4, (27, 8))
    got, (there, back) = np.full((2, 27, 15), -1), distance.block_distance(m, m[:15], [0, 8], "directed")
    for at, to, one, two in distance.parted(m, m[:15], [0, 8], "directed"):
        got[:, at, to] = one, two
    assert (got == [there, back]).all()


def test_blocks_grow_with_the_cells():
    """Each cell meets all blocks, so that there may be few of them."""
    assert distance.grown(500, None, 64) == distance.blocks_of(500, None) and distance.grown(60_000, None, 64) == 59
    assert distance.grown(615_384, None, 64) <= 65 and distance.grown(615_384, 1000, 64) == 616
    assert 64 < distance.grown(615_384, None, 20_000) <= 601


def test_half_tiles(monkeypatch):
    monkeypatch.setattr(distance, "BLOCK", 10)
    monkeypatch.setattr(distance, "TILE", 4)
    rng = np.random.default_rng(3)
    for most in (1, 4, 500):
        a, b = rng.integers(-most, most, (23, 5)), rng.integers(0, most, (17, 5))
        got = np.full((23, 17), -1.0)
        for at, to, w in distance.half_tiles(distance.narrow(a), distance.narrow(b)):
            got[at, to] = w
        assert (got == np.abs(a[:, None] - b[None]).sum(2) / 2).all()


@pytest.mark.parametrize("block", [30, 600])
def test_sparse_pairs_of_several_tiles(spark, monkeypatch, block):
    """No row is copied for each of the blocks: these are of one row, so that what is shuffled is a row a block and pair."""
    met, seen = distance.met, []
    monkeypatch.setattr(distance, "met", lambda blocks, several, *a: seen.append((blocks.count(), several)) or met(blocks, several, *a))
    packed, _ = profiles(spark, 300)
    dense = {(r.src, r.dst): r.w for r in distance.all_pairs(packed, "none", block=600).where("src < dst").collect()}
    seen.clear()
    got = distance.sparse_pairs(packed, block=block).collect()
    assert len(got) == len(dense) == 300 * 299 // 2 and {(r.src, r.dst): r.w for r in got} == dense
    assert seen == [(math.ceil(300 / block), math.ceil(300 / block))]


@pytest.mark.parametrize("block", [None, 70])
def test_approximate_distances_are_those_of_the_nearest_sampled_cells(spark, monkeypatch, block):
    """Over several blocks and tiles; blocks are of one row each."""
    met, seen = distance.met, []
    monkeypatch.setattr(distance, "met", lambda blocks, several, *a: seen.append((blocks.count(), several)) or met(blocks, several, *a))
    rng = np.random.default_rng(9)
    m, names = rng.choice(5, (300, 10), p=[0.05, 0.2, 0.5, 0.15, 0.1]), [f"c{k:03d}" for k in range(300)]
    packed = spark.createDataFrame([(c, k, m[n, i : i + 5].tolist()) for n, c in enumerate(names) for k, i in (("1", 0), ("2", 5))], "cell string, chrom string, cns array<int>")
    chosen = [n for n, c in enumerate(names) if int(hashlib.md5(c.encode()).hexdigest()[:8], 16) % 5 == 0]
    plain, _ = distance.block_distance(m, m, [0, 5, 10], "none")
    there, _ = distance.block_distance(m, m, [0, 5, 10], "directed")
    by = [n if n in chosen else min(chosen, key=lambda c: (plain[n, c], c)) for n in range(300)]
    got = distance.approximate(packed, 5, block=block).collect()
    assert len(got) == 300 * 299 and {(r.src, r.dst): r.w for r in got} == {(names[a], names[b]): int(there[by[a], by[b]]) for a in range(300) for b in range(300) if a != b}
    assert seen[0][0] == seen[0][1] > 1
