"""Nearest sources and the tree of all cells without a table of pairs, against all pairs; missing copy numbers."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloneforge.operators import arborescence, distance, implicit, nearest, segment
from cloneforge.plans import lineage
from cloneforge.sources import readers

CHROMS, BINS = 4, 12


def evolved(n, seed=1, events=2):
    """Cells that come from one another by gains and losses of stretches."""
    rng = np.random.default_rng(seed)
    x = np.full((n, CHROMS * BINS), 2)
    for k in range(1, n):
        x[k] = x[rng.integers(0, k)]
        for _ in range(rng.integers(1, events + 2)):
            a, size = rng.integers(0, CHROMS * BINS), rng.integers(1, 9)
            x[k, a : a + size] = np.clip(x[k, a : a + size] + rng.choice([-1, 1]), 0, 6)
    return x


def crowded(n, seed=2):
    """A few groups of cells that are all about as near to one another, copies among them; the first one is the root."""
    rng = np.random.default_rng(seed)
    x = rng.integers(1, 5, (3, CHROMS * BINS))[rng.integers(0, 3, n)] + (rng.random((n, CHROMS * BINS)) < 0.15)
    x[n // 2 : n // 2 + n // 10] = x[3]
    x[0] = 2
    return x


def packed(spark, x):
    rows = [(f"c{i:04d}", str(k), [int(v) for v in x[i, k * BINS : (k + 1) * BINS]]) for i in range(len(x)) for k in range(CHROMS)]
    return spark.createDataFrame(rows, "cell string, chrom string, cns array<int>")


@pytest.mark.parametrize("mode", distance.MODES)
def test_nearest_sources_are_those_of_all_pairs(spark, mode, monkeypatch):
    monkeypatch.setattr(nearest, "CHUNK", 40)  # so that balls are met in several chunks
    p = packed(spark, np.vstack([evolved(150), crowded(60)])).persist()
    pairs = distance.all_pairs(p, mode)
    ranked = pairs.withColumn("k", F.row_number().over(W.partitionBy("dst").orderBy("w", "src")))
    want = {(r.dst, r.src, r.w) for r in ranked.where("k <= 5").collect()}
    index = nearest.indexed(*nearest.profiles(p), mode, pivots=6)
    found, _ = nearest.search(index, k=5)
    assert {(r.cell, e.src, e.w) for r in found.collect() for e in r.near} == want
    one = {(r.src, r.dst, r.w) for r in nearest.nearest_parents(p, "c0000", mode).collect()}
    assert one == {(r.src, r.dst, r.w) for r in arborescence.least_incoming(pairs, "c0000").collect()}


def test_sources_of_a_label_and_those_too_far_are_left_out(spark):
    p = packed(spark, evolved(120, 3)).persist()
    index = nearest.indexed(*nearest.profiles(p), "none", pivots=8)
    labels = index.rows.select("cell", F.substring("cell", -1, 1).alias("label"))
    found, _ = nearest.search(index.labelled(labels))
    pairs = distance.all_pairs(p, "none").where(F.substring("src", -1, 1) != F.substring("dst", -1, 1))
    assert {(r.near[0].src, r.cell, r.near[0].w) for r in found.collect()} == {(r.src, r.dst, r.w) for r in arborescence.least_incoming(pairs).collect()}
    near, pairs_near = nearest.search(index, index.rows.withColumn("most", F.lit(1.0)))
    want = {(r.src, r.dst, r.w) for r in arborescence.least_incoming(distance.all_pairs(p, "none")).collect() if r.w <= 1}
    assert want <= {(r.near[0].src, r.cell, r.near[0].w) for r in near.collect()}


def test_few_pairs_are_worked_out_where_cells_lie_in_groups(spark):
    rng = np.random.default_rng(5)
    heads = rng.integers(0, 9, (40, CHROMS * BINS)) + 1
    x = np.repeat(heads, 40, axis=0)
    x[np.arange(1600), rng.integers(0, CHROMS * BINS, 1600)] += 1
    index = nearest.indexed(*nearest.profiles(packed(spark, x)), "none")
    found, pairs = nearest.search(index)
    assert found.count() == 1600 and pairs < 0.2 * 1600**2


def is_least_tree(got, x, root, mode="directed"):
    w = distance.block_distance(x, x, list(range(0, CHROMS * BINS + 1, BINS)), mode)[0].astype(float)
    parents = arborescence.solve(w, root)
    place = {f"c{i:04d}": i for i in range(len(x))}
    rows = got.collect()
    assert {r.child for r in rows} == set(place) - {f"c{root:04d}"} and len(rows) == len(x) - 1
    assert all(w[place[r.parent], place[r.child]] == r.dist for r in rows)
    up = {r.child: r.parent for r in rows}
    for c in up:
        hops = 0
        while c in up:
            c, hops = up[c], hops + 1
            assert hops < len(x)
    assert sum(r.dist for r in rows) == sum(w[parents[k], k] for k in range(len(x)) if k != root)


@pytest.mark.parametrize("x, mode, listed, held", [(evolved(200), "directed", 8, 400_000), (crowded(30), "symmetric", 4, 400_000), (crowded(16, 3), "none", 1, 0)])
def test_the_tree_is_least(spark, x, mode, listed, held):
    is_least_tree(implicit.tree(packed(spark, x), "c0000", mode, listed, held), x, 0, mode)


def test_components_by_doubled_pointers(spark):
    rng = np.random.default_rng(1)
    up = {k: int(rng.integers(0, 200)) for k in range(200)} | {300 + k: 300 + (k + 1) % 37 for k in range(37)} | {400: 400} | {401 + k: 400 + k for k in range(50)}
    got = implicit.components(spark.createDataFrame([(f"{k:03d}", f"{v:03d}") for k, v in up.items()], "top string, up string")).collect()
    for r in got:
        k, seen = int(r.top), []
        while k not in seen:
            seen.append(k)
            k = up[k]
        cycle = seen[seen.index(k) :]
        assert int(r.f) == min(cycle) and r.core == (int(r.top) in cycle)
    assert len(got) == len(up)


def test_one_task_and_rounds_give_trees_of_one_weight(spark):
    x = evolved(60, 7)
    long = packed(spark, x).select("cell", "chrom", F.posexplode("cns").alias("bin", "cn"))
    a, b = lineage.infer(long, small=1000), lineage.infer(long, small=0)
    assert a.root == b.root and a.tree.agg(F.sum("dist")).first() == b.tree.agg(F.sum("dist")).first()
    assert b.cells.count() == 60


# --- sources told by losses


def lossy(n, seed=4, share=0.16):
    """Cells that have lost some bins, few of which have all that another one has; the first one has lost none, the last ones are copies."""
    rng = np.random.default_rng(seed)
    x = np.clip(rng.normal(2, 1, (n, CHROMS * BINS)).round().astype(int), 1, 4)
    x[rng.random(x.shape) < share * (0.4 + rng.random((n, 1)))] = 0
    x[0] = 2
    x[-5:] = x[1:6]
    return x


@pytest.mark.parametrize("leaf", [20, 1 << 16])
def test_rows_that_have_all_that_others_have(leaf, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF", leaf)
    rng = np.random.default_rng(1)
    for bins, share in ((5, 0.5), (64, 0.05), (70, 0.2), (130, 0.02)):
        a, b = rng.random((60, bins)) < share, rng.random((90, bins)) < share
        a[7], b[3], b[9] = True, False, a[11]
        got = [p for i, j in nearest._covered(a, b) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(60) for j in range(90) if not (b[j] & ~a[i]).any()}


def test_few_pairs_are_worked_out_where_losses_tell_sources(spark, monkeypatch):
    monkeypatch.setattr(nearest, "MEET", 150)  # so that groups are met in several chunks
    x = lossy(500)
    p = packed(spark, x).persist()
    index = nearest.indexed(*nearest.profiles(p), "directed")
    assert index.sparse
    pairs = distance.all_pairs(p)
    found, n = nearest.search(index, index.rows.where("cell <> 'c0000'"))
    assert {(r.near[0].src, r.cell, r.near[0].w) for r in found.collect()} == {(r.src, r.dst, r.w) for r in arborescence.least_incoming(pairs, "c0000").collect()}
    assert n < 0.05 * 500**2
    ranked = pairs.withColumn("k", F.row_number().over(W.partitionBy("dst").orderBy("w", "src"))).where("k <= 6")
    want = {(r.dst, r.src, r.w) for r in ranked.collect()}
    assert any(w >= distance.PENALTY for *_, w in want)  # some have too few that cost less
    got, _ = nearest.search(index, k=6)
    assert {(r.cell, e.src, e.w) for r in got.collect() for e in r.near} == want
    short, _ = nearest.search(index, index.rows.where("cell <> 'c0000'"), 6, short=True)
    assert {(r.cell, e.src, e.w) for r in short.collect() for e in r.near} == {e for e in want if e[2] < distance.PENALTY and e[0] != "c0000"}


def test_distances_beyond_the_penalty_without_a_loss(spark):
    x = lossy(60)
    x[x > 0] *= 8_000
    p = packed(spark, x).persist()
    index = nearest.indexed(*nearest.profiles(p), "directed")
    found, _ = nearest.search(index)
    assert {(r.near[0].src, r.cell, r.near[0].w) for r in found.collect()} == {(r.src, r.dst, r.w) for r in arborescence.least_incoming(distance.all_pairs(p)).collect()}


@pytest.mark.parametrize("lost", [0.0, 0.02, 0.3])
def test_nearest_sources_of_smaller_names(spark, monkeypatch, lost):
    """With and without losses that tell sources, and cells that find none by them."""
    rng = np.random.default_rng(5)
    cells = [np.where(rng.random(24) < lost, 0, rng.integers(1, 4, 24)) for _ in range(150)]
    p = spark.createDataFrame([(str(k), c, cells[k][i : i + 12].tolist()) for k in range(150) for c, i in (("1", 0), ("2", 12))], "cell string, chrom string, cns array<int>")
    monkeypatch.setattr(nearest, "FEW", 0)
    all_before, seen = nearest._all_before, []
    monkeypatch.setattr(nearest, "_all_before", lambda queries, rows, several, *a: seen.append(several) or all_before(queries, rows, several, *a))
    got = sorted(map(tuple, nearest.nearest_before(p, block=40).collect()))
    assert got == sorted(map(tuple, distance.least(p, smaller=True).collect())) and len(got) == 149
    assert seen[0] == 150 if lost < 0.3 else 0 < seen[0] < 150


@pytest.mark.parametrize("root, listed", [(0, 8), (0, 1), (3, 2)])
def test_the_tree_of_cells_with_losses_is_least(spark, root, listed):
    x = np.unique(lossy(40, 6), axis=0)
    x = np.vstack([x[(x != 2).any(1)], x[(x == 2).all(1)]])[::-1]  # the first one has lost none
    is_least_tree(implicit.tree(packed(spark, x), f"c{root:04d}", "directed", listed), x, root)


# --- missing copy numbers


def test_distances_fail_on_null_copy_numbers(spark):
    p = spark.createDataFrame([("a", "1", [2, None]), ("b", "1", [2, 3])], "cell string, chrom string, cns array<int>")
    pairs = spark.createDataFrame([("a", "b")], "src string, dst string")
    for make in (lambda: distance.all_pairs(p), lambda: distance.sparse_pairs(p), lambda: distance.pair_distance(pairs, p), lambda: distance.quick_pair_distance(pairs, p), lambda: distance.approximate(p, 2), lambda: nearest.nearest_parents(p)):
        with pytest.raises(Exception, match="copy number"):
            make().collect()


def test_matrices_with_missing_numbers(spark, tmp_path):
    (tmp_path / "dna.txt").write_text("chr\tpos\tc.1\tc 2\tc-3\nchr1\t100\t2.0\t3\t2\n1\t2e2\tNA\t2\t1\nchrX\t300\t2\t\t2\n2\t5\t1\t2\t0\n")
    got = {(r.cell, r.chrom, r.pos): r.cn for r in readers.dna_matrix(spark, f"{tmp_path}/dna.txt").collect()}
    assert got[("c.1", "1", 100)] == 2 and got[("c.1", "1", 200)] is None and got[("c 2", "23", 300)] is None and got[("c-3", "2", 5)] == 0 and len(got) == 12
    (tmp_path / "rna.txt").write_text("c.1\tc2\nA\t1.0\tNA\nB\t\t0.5\nC\t1\t2e0\n")
    got = {(r.cell, r.gene): r.rel for r in readers.rna_matrix(spark, f"{tmp_path}/rna.txt").collect()}
    assert got == {("c.1", "A"): 1.0, ("c2", "A"): None, ("c.1", "B"): None, ("c2", "B"): 0.5, ("c.1", "C"): 1.0, ("c2", "C"): 2.0}
    (tmp_path / "seg.txt").write_text("chr1_1\tchr1_2\na\t2.0\tNA\nb\t3\t1\n")
    got = {(r.cell, r.bin): r.cn for r in readers.segmented(spark, f"{tmp_path}/seg.txt").collect()}
    assert got == {("a", 1): 2, ("a", 2): None, ("b", 1): 3, ("b", 2): 1}


def test_an_analysis_leaves_out_bins_that_are_missing_somewhere(spark, tmp_path):
    rng = np.random.default_rng(3)
    lines = ["chr\tpos\t" + "\t".join(f"c{k}" for k in range(12))]
    for i in range(8):
        own = [str(int(v)) for v in rng.integers(1, 4, 12)]
        if i in (2, 5):
            own[i] = "NA"
        lines.append(f"chr1\t{100 * i + 50}\t" + "\t".join(own))
    (tmp_path / "dna.txt").write_text("\n".join(lines) + "\n")
    bins = readers.dna_matrix(spark, f"{tmp_path}/dna.txt")
    bands = spark.createDataFrame([("1", 0, 400, "p1"), ("1", 400, 800, "q1")], "chrom string, start long, end long, band string")
    out = lineage.dna(spark, bins, bands, n_perm=3)
    assert out["tree"].count() == 12 and 0 <= out["tree"].agg(F.max("dist")).first()[0] < distance.PENALTY
    whole = segment.complete_features(bins, ["chrom", "pos"], "cn")
    assert whole.select("pos").distinct().count() == 6
