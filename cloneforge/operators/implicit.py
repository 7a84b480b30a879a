"""The rooted minimum tree of all cells under their distances, without a table of all pairs.

Each cell has a list of its nearest sources, and a bound that no other source undercuts. A contracted node enters by the least reduced weight of its cells' lists; where a bound comes first, lists are made anew by
a search that leaves out the node's own cells. The nodes and the sources they chose make a graph of one cycle a component: a task takes a component, contracts its cycle, and goes on as long as the contracted node's
best source lies in the component. So each round joins every component to another one, and rounds grow with the logarithm of the cells. Components too large for a task contract their cycle alone, from one
best source for each of its nodes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneforge.operators import nearest
from cloneforge.operators.distance import PENALTY
from cloneforge.plans.storage import written

#: Sources in a cell's first list, in the longest ones that are made anew, and entries of lists that a task holds of one component.
LISTED, LONGEST, HELD = 8, 256, 400_000
SOLVED = "kind string, step int, node string, child string, u string, v string, tv string, red bigint"


class Component:
    """One cycle, or one node that waits for a source, and the nodes that hang on it. picks: node -> (u, v, the node of u, reduced weight); edges: (reduced weight, is it a bound, u, v, node of u, node of v)."""

    def __init__(self, picks: dict[str, tuple], edges: dict[str, list[tuple]]):
        self.picks, self.edges = picks, edges
        self.inside: set[str] = set()  # of the contracted node
        self.heap: list[tuple] = []
        self.off = 0  # what the contracted node's edges are less by than their entries in heap say
        self.taken: dict[str, int] = {}  # what a node's edges were less by, less off, when it was taken in
        self.history: list[tuple[str | None, tuple]] = []

    def take(self, nodes: list[str], step: int) -> None:
        for x in nodes:
            own = self.picks[x][3] if x in self.picks else 0
            self.taken[x] = own - self.off
            for red, *rest in self.edges.get(x, ()):
                heapq.heappush(self.heap, (red - own + self.off, *rest))
            if x in self.picks:
                self.history.append((step, x, self.picks[x]))
        self.inside.update(nodes)

    def path(self, node: str) -> list[str]:
        """From a node along sources to the contracted one, or, before there is one, to the cycle, which is then given, or to the node that waits."""
        seen: dict[str, None] = {}
        while node not in self.inside and node not in seen and node in self.picks:
            seen[node] = None
            node = self.picks[node][2]
        if self.inside:
            return list(seen)
        return [node] if node not in seen else list(seen)[list(seen).index(node) :]

    def solve(self, members: set[str]) -> tuple[tuple | None, set[str]]:
        """The edge into the contracted node from outside, or None and the cells whose lists are used up."""
        self.take(self.path(min(members)), 0)
        step = 0
        while True:
            while self.heap and not self.heap[0][1] and self.heap[0][4] in self.inside:
                heapq.heappop(self.heap)
            if not self.heap:
                return None, set()
            key, bound, u, v, tu, tv = self.heap[0]
            if bound:
                best = next((e[0] for e in sorted(e for e in self.heap if not e[1] and e[4] not in self.inside)[:1]), None)
                return None, {e[3] for e in self.heap if e[1] and (best is None or e[0] <= best)}
            red = key - self.off
            if tu not in members:
                return (u, v, tv, red), set()
            step += 1
            self.history.append((step, None, (u, v, tv, red)))
            self.off += red
            self.take(self.path(tu), step)


def _solved(pdf: pd.DataFrame, round_: int) -> pd.DataFrame:
    """Rows of a component (what: edge, bound, pick) -> rows of SOLVED: step (the contraction's history), node (the contracted node and its pick), less (what a node's edges become less by), ask (cells to search for)."""
    picks, edges = {}, {}
    for what, tv, u, v, tu, red in zip(pdf.what, pdf.tv, pdf.u, pdf.v, pdf.tu, pdf.red):
        if what == "pick":
            picks[tv] = (u, v, tu, int(red))
        else:
            edges.setdefault(tv, []).append((int(red), what == "bound", u or "", v, tu or "", tv))
    own = Component(picks, edges)
    members = set(pdf.tv)
    found, ask = own.solve(members)
    name = f"{round_}:{pdf.f.iloc[0].split(':', 1)[1]}" if len(own.inside) > 1 else next(iter(own.inside))
    rows = []
    if len(own.inside) > 1:
        for step, child, edge in own.history:  # edges of members, and of what was contracted in the step before
            u, v, tv = (edge[0], edge[1], child) if child is not None else edge[:3]
            rows.append(("step", step, name, child, u, v, tv, None))
        rows += [("less", None, name, x, None, None, None, own.off + less) for x, less in own.taken.items()]
    if found:
        rows.append(("node", None, name, None, found[0], found[1], None, found[3]))
    rows += [("ask", None, name, None, None, v, None, None) for v in sorted(ask)]
    return pd.DataFrame(rows, columns=["kind", "step", "node", "child", "u", "v", "tv", "red"]).astype({"step": "Int32", "red": "Int64"})


def _expanded(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edges into a contracted node's members: history rows and one row of the edge that enters it (step -1)."""
    enter = pdf[pdf.step == -1].iloc[0]
    edge = (enter.u, enter.v, enter.tv)
    steps: dict[int, list] = {}
    bridge: dict[int, tuple] = {}
    for step, child, u, v, tv in zip(pdf.step, pdf.child, pdf.u, pdf.v, pdf.tv):
        if step >= 0 and child is None:
            bridge[step] = (u, v, tv)
        elif step >= 0:
            steps.setdefault(step, []).append((child, (u, v, tv)))
    out = []
    members = {c for own in steps.values() for c, _ in own}
    base = ({tv for *_, tv in bridge.values()} | {edge[2]}) - members  # a node that had waited for a source and had none of its own
    for step in range(max([*steps, *bridge], default=0), -1, -1):
        own = steps.get(step, [])
        children = {c for c, _ in own} | (base if step == 0 else set())
        if edge[2] in children:
            out.append((edge[2], edge[0], edge[1]))
            out += [(c, e[0], e[1]) for c, e in own if c != edge[2]]
            edge = bridge.get(step)
        else:
            out += [(c, e[0], e[1]) for c, e in own]
    return pd.DataFrame(out, columns=["top", "u", "v"])


def components(picks: DataFrame) -> DataFrame:
    """(top, f, core) of nodes: their component's name, which is the least node of its cycle or the node at its end, and whether they are on the cycle or that end. picks: top, up (itself at an end). Pointers are doubled until
    the least names that paths meet stay the same, which they do only once all paths have gone around."""
    jump = written(picks.select("top", "up", F.least("top", "up").alias("least")), "jump")
    of = lambda j: j.join(j.select(F.col("top").alias("up"), F.col("least").alias("f")), "up").select("top", "up", "f")
    named = written(of(jump), "named")
    while True:
        far = jump.select(F.col("top").alias("up"), F.col("up").alias("up2"), F.col("least").alias("least2"))
        jump = written(jump.join(far, "up").select("top", F.col("up2").alias("up"), F.least("least", "least2").alias("least")), "jump")
        before, named = named, written(of(jump), "named")
        if not named.join(before.select("top", F.col("f").alias("g")), "top").where("f <> g").limit(1).count():
            core = named.select(F.col("up").alias("top")).distinct().withColumn("core", F.lit(True))
            return named.select("top", "f").join(core, "top", "left").select("top", "f", F.coalesce("core", F.lit(False)).alias("core"))


def tree(packed: DataFrame, root: str, mode: str = "directed", listed: int = LISTED, held: int = HELD) -> DataFrame:
    """(parent, child, dist) of the rooted minimum tree of cells (cell, chrom, cns) under distance.all_pairs(); every cell is reached, as all pairs have a distance. Cells with equal profiles hang on the
    smallest name of theirs, or on the root if it is one of them. Of trees of equal weight one is given."""
    rows, cuts = nearest.profiles(packed)
    first = rows.groupBy("cn").agg(F.min(F.struct(F.col("cell") != root, "cell")).alias("m")).select("cn", F.col("m.cell").alias("rep"))
    copies = written(rows.join(first, "cn").select("cell", "rep"), "copies")
    index = nearest.indexed(written(rows.join(copies.where("cell = rep").select("cell"), "cell", "left_semi"), "cells"), cuts, mode)
    single = F.concat(F.lit("0:"), F.col("cell"))
    top_root = f"0:{root}"
    nodes = written(index.rows.select("cell", single.alias("top"), F.lit(0).cast("long").alias("pot")), "nodes")

    def lists_of(queries: DataFrame, k: int, among: nearest.Index, short: bool) -> DataFrame:
        """short: lists end where sources come to cost PENALTY, if they have any before."""
        full = F.when(F.size("near") >= k, F.element_at("near", -1)["w"])
        if short and among.sparse:
            full = full.otherwise(F.when(F.col("near")[0]["w"] < PENALTY, F.lit(PENALTY)))
        return nearest.search(among, queries, k, short)[0].select("cell", "near", full.cast("long").alias("bound"))

    lists = lists_of(index.rows.where(F.col("cell") != root), listed, index, True)
    picks = lists.select(F.concat(F.lit("0:"), "cell").alias("top"), F.col("near")[0]["src"].alias("u"), F.col("cell").alias("v"), F.col("near")[0]["w"].alias("red"))
    picks = written(picks, "picks")
    history: list[tuple[DataFrame, DataFrame]] = []
    round_, k = 0, listed
    while True:
        round_ += 1
        at = nodes.select(F.col("cell").alias("u"), F.col("top").alias("tu"))
        pointed = picks.join(at, "u")
        tops = nodes.select("top").distinct()
        comps = written(components(tops.join(pointed.select("top", "tu"), "top", "left").select("top", F.coalesce("tu", "top").alias("up"))), "components")
        ends = comps.where(F.col("top") == top_root).select("f")
        left = comps.join(F.broadcast(ends), "f", "left_anti")  # one row
        if not left.limit(1).count():
            break
        # entries of lists into the components' nodes, with the nodes they come from
        into = nodes.join(left, "top").join(lists, "cell")
        edge = into.select("f", "core", F.col("top").alias("tv"), F.col("cell").alias("v"), "pot", F.explode("near").alias("e")).select("f", "core", "tv", "v", F.col("e.src").alias("u"), (F.col("e.w") - F.col("pot")).alias("red"))
        edge = edge.join(at, "u").where("tu <> tv").select("f", "core", F.lit("edge").alias("what"), "tv", "u", "v", "tu", "red")
        none = F.lit(None).cast("string")
        bound = into.where("bound is not null").select("f", "core", F.lit("bound").alias("what"), F.col("top").alias("tv"), none.alias("u"), F.col("cell").alias("v"), none.alias("tu"), (F.col("bound") - F.col("pot")).alias("red"))
        pick = pointed.join(left, "top").select("f", "core", F.lit("pick").alias("what"), F.col("top").alias("tv"), "u", "v", "tu", "red")
        waits = left.where("core").join(picks.select("top"), "top", "left_anti").select("f", "core", F.lit("wait").alias("what"), F.col("top").alias("tv"), none.alias("u"), none.alias("v"), none.alias("tu"), F.lit(0).cast("long").alias("red"))
        entries = written(edge.unionByName(bound), "entries")
        large = entries.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > held).select("f")
        small = entries.unionByName(pick).join(large, "f", "left_anti")
        if large.limit(1).count():  # of large components the cycle alone, with one best source from outside the cycle and one bound for each of its nodes
            on = left.where("core").select(F.col("top").alias("tu"), F.col("f").alias("g"))
            core = entries.where("core").join(large, "f", "left_semi").join(on, "tu", "left").where((F.col("g").isNull()) | (F.col("g") != F.col("f")))
            best = core.groupBy("f", "core", "what", "tv").agg(F.min(F.struct("red", "u", "v", "tu")).alias("m")).select("f", "core", "what", "tv", "m.u", "m.v", "m.tu", "m.red")
            small = small.unionByName(best).unionByName(pick.where("core").join(large, "f", "left_semi"))
        steps = small.unionByName(waits).drop("core").groupBy("f").applyInPandas(_told(round_), SOLVED)
        solved = written(steps, "solved")
        less = solved.where("kind = 'less'").select(F.col("child").alias("top"), F.col("node").alias("new"), "red")
        history.append((solved.where("kind = 'step'"), nodes.select("cell", "top")))
        nodes = written(nodes.join(less, "top", "left").select("cell", F.coalesce("new", "top").alias("top"), (F.col("pot") + F.coalesce("red", F.lit(0))).alias("pot")), "nodes")
        entered = solved.where("kind = 'node'").select(F.col("node").alias("top"), "u", "v", "red")
        picks = written(picks.join(less.select("top"), "top", "left_anti").unionByName(entered), "picks")
        ask = written(solved.where("kind = 'ask'").select(F.col("v").alias("cell")).join(lists.select("cell", "bound"), "cell"), "ask")
        if ask.limit(1).count():
            named = index.labelled(nodes.select("cell", F.col("top").alias("label")))
            k = min(LONGEST, 2 * k)  # longer ones each time, as who asks lies among many near ones
            lists = lists.join(ask, "cell", "left_anti")
            for short in (True, False):  # sources of PENALTY and more are looked for only by those that come to need them
                own = ask.where((F.col("bound") < PENALTY) == F.lit(short))
                if own.limit(1).count():
                    # a cell for which nothing is left has no list
                    lists = lists.unionByName(lists_of(named.rows.join(own, "cell", "left_semi"), k, named, short))
            lists = written(lists, "lists")
    chosen = picks.select("top", "u", "v")
    for steps, before in reversed(history):
        inside = steps.select("node").distinct()
        own = chosen.join(inside.select(F.col("node").alias("top")), "top", "left_semi").join(before.select(F.col("cell").alias("v"), F.col("top").alias("tv")), "v")
        enter = own.select(F.lit(-1).alias("step"), F.col("top").alias("node"), F.lit(None).cast("string").alias("child"), "u", "v", "tv")
        opened = steps.select("step", "node", "child", "u", "v", "tv").unionByName(enter).groupBy("node").applyInPandas(_expanded, "top string, u string, v string")
        chosen = written(chosen.join(inside.select(F.col("node").alias("top")), "top", "left_anti").unionByName(opened), "chosen")
    edges = chosen.select(F.col("u").alias("src"), F.col("v").alias("dst"))
    paired = nearest.weighed(edges, index)
    hung = copies.where("cell <> rep").select(F.col("rep").alias("parent"), F.col("cell").alias("child"), F.lit(0).cast("long").alias("dist"))
    return paired.select(F.col("src").alias("parent"), F.col("dst").alias("child"), F.col("w").alias("dist")).unionByName(hung)


def _told(round_: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _solved(pdf, round_)

    return run
