import itertools

import numpy as np
from pyspark.sql import functions as F

from cloneforge.operators import arborescence, trees


def brute(w, root):
    n, best = len(w), None
    others = [k for k in range(n) if k != root]
    for ps in itertools.product(range(n), repeat=n - 1):
        up = dict(zip(others, ps))
        if any(w[p, v] == np.inf or p == v for v, p in up.items()):
            continue
        for v in others:
            seen, x = set(), v
            while x != root and x not in seen:
                seen.add(x)
                x = up[x]
            if x != root:
                break
        else:
            total = sum(w[p, v] for v, p in up.items())
            best = total if best is None else min(best, total)
    return best


def test_solve_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(2, 6))
        w = rng.integers(0, 8, (n, n)).astype(float)
        w[rng.random((n, n)) < 0.25] = np.inf
        root = int(rng.integers(n))
        parents = arborescence.solve(w, root)
        want = brute(w, root)
        assert (None if parents is None else sum(w[parents[v], v] for v in range(n) if v != root)) == want


def edges_of(w):
    return [(f"n{i}", f"n{j}", int(w[i, j])) for i in range(len(w)) for j in range(len(w)) if i != j and w[i, j] < np.inf]


def test_rounds_equal_one_task(spark):
    rng = np.random.default_rng(7)
    w = rng.integers(1, 6, (9, 9)).astype(float)
    edges = spark.createDataFrame(edges_of(w), "src string, dst string, w bigint")
    one = arborescence.facts(arborescence.group_trees(edges, "n0")).first()
    rounds = arborescence.facts(arborescence.tree(edges, "n0")).first()
    assert one == rounds and (one.n_edges, one.n_roots) == (8, 1)


def test_nested_cycles_and_unreachable(spark):
    rows = [("r", "a", 10), ("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("c", "d", 1), ("d", "c", 1), ("c", "a", 1), ("r", "d", 20)]
    edges = spark.createDataFrame(rows, "src string, dst string, w bigint")
    assert arborescence.facts(arborescence.tree(edges, "r")).first().weight == 13
    assert arborescence.facts(arborescence.group_trees(edges, "r")).first().weight == 13
    assert arborescence.tree(edges, "x") is None
    lone = edges.union(spark.createDataFrame([("y", "z", 1)], "src string, dst string, w bigint"))
    assert arborescence.tree(lone, "r") is None and arborescence.group_trees(lone, "r").count() == 0


def test_groups(spark):
    rows = [(p, "r", "a", 1 + p) for p in (1, 2)] + [(p, "a", "b", 2) for p in (1, 2)] + [(p, "r", "b", p) for p in (1, 2)]
    got = arborescence.group_trees(spark.createDataFrame(rows, "perm_id int, src string, dst string, w bigint"), "r", ["perm_id"])
    assert {(r.perm_id, r.w) for r in got.groupBy("perm_id").agg(F.sum("dist").alias("w")).collect()} == {(1, 3), (2, 5)}


def test_spanning_forest_equals_tree_weight(spark):
    rng = np.random.default_rng(2)
    w = rng.integers(1, 50, (10, 10)).astype(float)
    w = np.minimum(w, w.T)
    edges = spark.createDataFrame(edges_of(w), "src string, dst string, w bigint")
    forest = arborescence.spanning_forest(edges).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).first()
    parents = arborescence.solve(w, 0)
    assert (forest.w, forest.n) == (sum(w[parents[v], v] for v in range(1, 10)), 9)


def tree_of(spark, rows):
    return spark.createDataFrame([(a, b, 1) for a, b in rows], "parent string, child string, dist bigint")


def test_long_chain(spark):
    chain = tree_of(spark, [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(150)])
    got = {r.cell: (r.depth, r.height, r.subtreesize) for r in trees.lineages(trees.closure(chain)).collect()}
    assert all(got[f"c{k:03d}"] == (k, 150 - k, 151 - k) for k in range(151))


def test_measures_without_the_closure(spark):
    rng = np.random.default_rng(3)
    rows = [(f"n{int(rng.integers(max(0, k - 4), k))}", f"n{k}", int(rng.integers(1, 9))) for k in range(1, 120)] + [("x", "y", 2)]
    tree = spark.createDataFrame(rows, "parent string, child string, dist bigint")
    cols = ["cell", "depth", "height", "subtreesize", "root_dist"]
    rows = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    assert rows(trees.measured(tree)) == rows(trees.lineages(trees.closure(tree)))


def test_measures_of_a_very_long_chain(spark):
    n = 100_000
    chain = spark.range(1, n).selectExpr("cast(id - 1 as string) parent", "cast(id as string) child", "cast(1 as bigint) dist")
    got = trees.measured(chain)
    assert got.where(f"depth + height <> {n - 1} or depth + subtreesize <> {n} or depth <> root_dist").count() == 0 and got.count() == n


def test_star_and_edge(spark):
    star = tree_of(spark, [("r", f"l{k}") for k in range(5)])
    got = {r.cell: (r.depth, r.height, r.subtreesize) for r in trees.lineages(trees.closure(star)).collect()}
    assert got["r"] == (0, 1, 6) and got["l3"] == (1, 0, 1)
    assert [r.cell for r in trees.roots(star).collect()] == ["r"] and trees.leaves(star).count() == 5


def test_network(spark):
    tree = tree_of(spark, [("r", "a"), ("a", "b"), ("b", "c"), ("r", "d")])
    found = spark.createDataFrame([("a", 1), ("c", 3), ("d", 1)], "cell string, depth int")
    got = {(r.node1, r.node2, r.dist) for r in trees.network(found, tree).collect()}
    assert got == {("root", "a", 1), ("a", "c", 2), ("root", "d", 1)}


def test_reach(spark):
    edges = spark.createDataFrame([("r", "a", 1), ("a", "b", 1), ("r", "b", 9), ("x", "r", 1)], "src string, dst string, w bigint")
    assert {(r.node, r.hops) for r in arborescence.reach(edges, "r").collect()} == {("r", 0), ("a", 1), ("b", 1)}


def test_network_of_all_cells_with_findings(spark, tmp_path):
    # cell 1 leads to all others but 0; a name of three digits has a finding too
    from cloneforge.plans import queries

    rng = np.random.default_rng(5)
    rows = [(k, [float(v) for v in rng.choice([-0.5, 0.0, 0.5], 64)]) for k in range(600)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.node2: (r.node1, r.dist) for r in queries.queries()["ancestor_network_of_findings"](spark, str(tmp_path)).collect()}
    _, _, cells, levels = queries.heap_levels(spark, str(tmp_path))
    depth = {r.cell: r.depth for r in queries.found(levels, cells).select("cell", "depth").collect()}
    want = {}
    for cell in depth:
        up = int(cell) // 2
        while up and str(up) not in depth:
            up //= 2
        want[cell] = (str(up), depth[cell] - depth[str(up)]) if up else ("root", depth[cell])
    assert got == want and any(len(c) == 3 for c in got)
