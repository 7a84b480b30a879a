"""Rooted directed minimum spanning trees, and the single steps they are made of.

`group_trees` solves each group (such as a permutation) in one task; `tree` solves one graph with DataFrame operations alone: in each round every node takes its
least incoming edge, cycles are contracted all at once, and the rounds are played back to expand them. Of equal weights the smaller source wins.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cloneforge.plans.storage import written


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def reduced(edges: DataFrame) -> DataFrame:
    """Weights less the least that comes into the same node."""
    return edges.withColumn("w", F.col("w") - F.min("w").over(W.partitionBy("dst")))


def least_incoming(edges: DataFrame, root: str | None = None) -> DataFrame:
    """(src, dst, w): for each node but the root one incoming edge of least weight."""
    own = edges if root is None else edges.where(F.col("dst") != root)
    best = own.groupBy("dst").agg(F.min(F.struct("w", "src")).alias("e"))
    return best.select("e.src", "dst", "e.w")


def cycle_nodes(chosen: DataFrame) -> DataFrame:
    """(node, cycle) of the nodes on cycles of a graph in which each node has at most one incoming edge; cycle: its smallest node. Pointers are doubled, so
    rounds grow with the logarithm of the longest path."""
    jump = written(chosen.select(F.col("dst").alias("node"), F.col("src").alias("up"), F.least("dst", "src").alias("least")), "jump")
    n, rounds = jump.count(), 0
    while 2**rounds < n + 1:  # those that still have an ancestor after n steps hang on a cycle
        up = jump.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("least").alias("least2"))
        jump = written(jump.join(up, "up").select("node", F.col("up2").alias("up"), F.least("least", "least2").alias("least")), "jump")
        rounds += 1
        if not jump.limit(1).count():  # all paths have ended: no cycle
            break
    # a node that others reach after so many steps is on a cycle itself
    return jump.join(jump.select(F.col("up").alias("node")).distinct(), "node", "left_semi").select("node", F.col("least").alias("cycle"))


def contracted(edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """Edges between what cycles (node, cycle) make one node, of each pair the least. Weights of edges into a cycle are less by the cycle's own edge into the same node;
    `e` keeps the edge as it was before. edges: src, dst, w; w must be reduced()."""
    a = cycles.select(F.col("node").alias("src"), F.col("cycle").alias("a"))
    b = cycles.select(F.col("node").alias("dst"), F.col("cycle").alias("b"))
    named = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("s"), F.coalesce("b", "dst").alias("d"), "src", "dst", "w")
    best = named.where("s <> d").groupBy("s", "d").agg(F.min(F.struct("w", "src", "dst")).alias("e"))
    return best.select(F.col("s").alias("src"), F.col("d").alias("dst"), F.col("e.w").alias("w"), F.col("e.src").alias("osrc"), F.col("e.dst").alias("odst"))


def reach(edges: DataFrame, root: str) -> DataFrame:
    """(node, hops): the fewest edges from the root to what it reaches."""
    spark = edges.sparkSession
    pairs = written(edges.select("src", "dst").distinct(), "pairs")
    seen = spark.createDataFrame([(root, 0)], "node string, hops int")
    front, hops = seen, 0
    while True:
        hops += 1
        new = front.join(pairs, front.node == pairs.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(hops))
        front = written(new, "front")
        if not front.limit(1).count():
            return seen
        seen = written(seen.unionByName(front), "seen")


def tree(edges: DataFrame, root: str) -> DataFrame | None:
    """(parent, child, dist) of the rooted minimum tree; None where the root is missing or does not reach all nodes. edges: src, dst, w; contracted in rounds."""
    own = written(edges.where((F.col("src") != F.col("dst")) & (F.col("dst") != root)).groupBy("src", "dst").agg(F.min("w").alias("w")), "edges")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    if not nodes.where(F.col("node") == root).limit(1).count() or reach(edges, root).count() < nodes.count():
        return None
    rounds: list[tuple[DataFrame, DataFrame, DataFrame]] = []  # chosen edges, cycles, edges as contracted
    level = own
    while True:
        less = written(reduced(level), "reduced")
        chosen = written(least_incoming(less), "chosen")
        cycles = written(cycle_nodes(chosen), "cycles")
        if not cycles.limit(1).count():
            break
        next_ = written(contracted(less, cycles), "contracted")
        rounds.append((chosen, cycles, next_))
        level = next_.select("src", "dst", "w")
    picked = chosen.select("src", "dst")
    for chosen, cycles, next_ in reversed(rounds):
        # edges of the smaller graph, as they were in the larger one; a cycle's own edges, but for the node that is entered
        entered = picked.join(next_, ["src", "dst"]).select(F.col("osrc").alias("src"), F.col("odst").alias("dst"))
        inside = chosen.join(cycles.select(F.col("node").alias("dst")), "dst", "left_semi").join(entered.select("dst"), "dst", "left_anti").select("src", "dst")
        picked = written(entered.unionByName(inside), "picked")
    return picked.join(own, ["src", "dst"]).select(F.col("src").alias("parent"), F.col("dst").alias("child"), F.col("w").alias("dist"))


def solve(w: np.ndarray, root: int) -> np.ndarray | None:
    """Parents of the minimum tree of a dense graph, w[i, j] from i to j, inf where there is no edge; None where the root does not reach all. Cycles are contracted one after
    another, each in time that is quadratic in the nodes left at most."""
    n = len(w)
    w = w.astype(float).copy()
    np.fill_diagonal(w, np.inf)
    w[:, root] = np.inf
    source = np.tile(np.arange(n)[:, None], (1, n))  # the edge that an entry stands for
    target = np.tile(np.arange(n)[None], (n, 1))
    alive = np.ones(n, bool)
    label = np.arange(n)
    history: list[tuple[int, list[int], list[tuple[int, int]], list[np.ndarray]]] = []
    parent_of: dict[int, int] = {}
    state = np.zeros(n, np.int8)  # 1: on the path, 2: leads to the root
    state[root] = 2
    for begin in range(n):
        if not alive[begin] or state[begin] == 2:
            continue
        path = [begin]
        state[begin] = 1
        while True:
            v = path[-1]
            column = np.where(alive, w[:, v], np.inf)
            u = int(column.argmin())
            if column[u] == np.inf:
                return None
            parent_of[v] = u
            if state[u] == 2:
                state[path] = 2
                break
            if state[u] == 0:
                state[u] = 1
                path.append(u)
                continue
            cycle = path[path.index(u) :]
            path = path[: path.index(u)]
            least = [w[parent_of[x], x] for x in cycle]
            history.append((cycle[0], cycle, [(int(source[parent_of[x], x]), int(target[parent_of[x], x])) for x in cycle], [np.flatnonzero(label == x) for x in cycle]))
            label[np.isin(label, cycle)] = cycle[0]
            into = w[:, cycle] - np.array(least)[None]
            k = into.argmin(1)
            at = np.arange(n)
            c = cycle[0]
            new_in = into[at, k], source[at, np.array(cycle)[k]], target[at, np.array(cycle)[k]]
            k = w[cycle].argmin(0)
            new_out = w[np.array(cycle)[k], at], source[np.array(cycle)[k], at], target[np.array(cycle)[k], at]
            w[:, c], source[:, c], target[:, c] = new_in
            w[c], source[c], target[c] = new_out
            w[c, c] = np.inf
            for x in cycle[1:]:
                alive[x] = False
            state[cycle] = 0
            state[c] = 1
            w[c, cycle] = np.inf
            path.append(c)
    chosen = {v: (int(source[parent_of[v], v]), int(target[parent_of[v], v])) for v in range(n) if alive[v] and v != root}
    for c, cycle, own, stood in reversed(history):
        entry = chosen.pop(c)
        # the member in which the entered node lies keeps the edge that comes in
        chosen |= {x: entry if entry[1] in nodes else e for x, e, nodes in zip(cycle, own, stood)}
    parents = np.full(n, -1)
    for s, t in chosen.values():
        parents[t] = s
    return parents


def group_trees(edges: DataFrame, root: str | None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, parent, child, dist): the minimum tree of each group's graph, from `root` or, where None, the group's column `root`. A group without a tree has no rows.
    A group's graph must fit one task, which holds a few numbers for each pair of nodes."""
    kinds = dict(edges.dtypes)
    own = edges if keys else edges.withColumn("_all", F.lit(0))
    by = list(keys) or ["_all"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["src"]) | set(pdf["dst"]))
        place = {x: k for k, x in enumerate(names)}
        start = root if root is not None else pdf["root"].iloc[0]
        out = pd.DataFrame({**{k: pdf[k].iloc[:0] for k in keys}, "parent": pd.Series(dtype=object), "child": pd.Series(dtype=object), "dist": pd.Series(dtype="int64")})
        if start not in place:
            return out
        w = np.full((len(names), len(names)), np.inf)
        np.minimum.at(w, (pdf["src"].map(place).to_numpy(), pdf["dst"].map(place).to_numpy()), pdf["w"].to_numpy(float))
        parents = solve(w, place[start])
        if parents is None:
            return out
        child = [k for k in range(len(names)) if parents[k] >= 0]
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "parent": [names[parents[k]] for k in child], "child": [names[k] for k in child], "dist": [int(w[parents[k], k]) for k in child]})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "parent string, child string, dist bigint"])
    return own.groupBy(*by).applyInPandas(run, schema)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of a minimum spanning forest of an undirected graph: each component takes its least edge to another one, all at once, until none is left."""
    own = written(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")), "edges")
    named = written(own.select(F.col("src").alias("node")).union(own.select("dst")).distinct().withColumn("comp", F.col("node")), "named")
    picked = own.limit(0)
    while True:
        a, b = named.select(F.col("node").alias("src"), F.col("comp").alias("a")), named.select(F.col("node").alias("dst"), F.col("comp").alias("b"))
        between = own.join(a, "src").join(b, "dst").where("a <> b")
        sides = between.select("a", "src", "dst", "w", "b").unionByName(between.select(F.col("b").alias("a"), "src", "dst", "w", F.col("a").alias("b")))
        best = written(sides.groupBy("a").agg(F.min(F.struct("w", "src", "dst", "b")).alias("e")).select("a", "e.*"), "best")
        if not best.limit(1).count():
            return picked
        picked = written(picked.unionByName(best.select("src", "dst", "w").distinct()), "picked")
        label = written(named.select("comp").distinct().withColumn("to", F.col("comp")), "label")
        while True:  # smallest names spread along the edges taken
            links = best.select("a", "b").unionByName(best.select(F.col("b").alias("a"), F.col("a").alias("b")))
            near = links.join(label.select(F.col("comp").alias("b"), F.col("to").alias("t")), "b").groupBy(F.col("a").alias("comp")).agg(F.min("t").alias("t"))
            new = label.join(near, "comp", "left").select("comp", F.least("to", F.coalesce("t", "to")).alias("to"), (F.coalesce("t", "to") < F.col("to")).alias("moved"))
            new = written(new, "label")
            label = new.drop("moved")
            if not new.where("moved").limit(1).count():
                break
        named = written(named.join(label, "comp").select("node", F.col("to").alias("comp")), "named")


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))


def facts(tree_: DataFrame) -> DataFrame:
    """Total weight, edges and roots of a tree (parent, child, dist)."""
    roots = tree_.select(F.col("parent").alias("child")).distinct().join(tree_.select("child"), "child", "left_anti").agg(F.count(F.lit(1)).alias("n_roots"))
    return tree_.agg(F.sum("dist").alias("weight"), F.count(F.lit(1)).alias("n_edges")).crossJoin(roots)
