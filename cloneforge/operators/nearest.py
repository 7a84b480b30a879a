"""Nearest sources of cells, exactly, without all pairs.

Half the L1 distance of breakpoint vectors is a metric, and no more than the distance (of chromosomes that cost PENALTY no more than that). Cells are dealt to balls around pivots. A cell that is d from a
pivot is d - r from all members of a ball whose members are r from it at most, and r - d where they are r from it at least. A ball knows these two for its own pivot and for some others; balls that are
farther by this than what a cell has found already need no look. Balls are met in chunks of bounded size, in tasks of two chunks each.

By the directed rule a source costs less than PENALTY only if the cell has lost all that the source has lost. Where few pairs of cells are so, these are told by their losses, without a distance of any other pair:
a cell meets the sources whose losses among some bins it has too, and a task parts both sides by one bin after another. Cells that find enough sources so need no balls.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneforge.operators import distance
from cloneforge.operators.distance import matrix, profiles
from cloneforge.operators.ordered import numbered
from cloneforge.plans.storage import written

#: Share of pairs of cells up to which sources are told by losses; bins by which sources are dealt; queries and sources that meet in one task at most; pairs that are compared, and that are kept, at a time.
SPARSE, DEALT, MEET, LEAF, KEPT = 0.05, 12, 16_384, 1 << 16, 1 << 20
#: Cells up to which comparing all of them takes less time than telling sources of smaller names by losses; results are the same.
FEW = 60_000
#: Pivots at most, which every task holds, and those among them that all balls are measured by; cells of a chunk; balls that are looked into before others are judged by what was found.
PIVOTS, MARKS, CHUNK, FIRST = 512, 64, 1024, 2


@dataclass
class Index:
    """rows: cell, cn (packed whole numbers), ball, chunk, loss, label. least, most: distances of each ball's members from the pivots numbered in marks. Sources with a cell's own label are none of its.
    bits: the bins of which a row's loss tells those it has lost; losses: those that rows have, and how many; sparse: are sources to be told by losses first?"""

    rows: DataFrame
    pivots: np.ndarray
    radii: np.ndarray
    marks: np.ndarray
    least: np.ndarray
    most: np.ndarray
    chunks: np.ndarray
    cuts: list[int]
    mode: str
    n: int
    bits: np.ndarray
    losses: np.ndarray
    sparse: bool

    def labelled(self, labels: DataFrame) -> Index:
        """With labels (cell, label) in place of those it has."""
        return replace(self, rows=self.rows.drop("label").join(labels, "cell"))


def placed(m: np.ndarray, cuts: list[int], mode: str) -> np.ndarray:
    """Breakpoint vectors whose half L1 distance is no more than the distance; by the symmetric rule, of chromosomes without the bins that are lost."""
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        x = m[:, lo:hi]
        if mode == "symmetric":
            lost = x == 0
            x = np.take_along_axis(np.where(lost, 2, x), np.argsort(lost, axis=1, kind="stable"), 1)
        out.append(distance.deltas(x))
    return np.hstack(out)


def _to_pivots(m: np.ndarray, pivots: np.ndarray, cuts: list[int], mode: str) -> np.ndarray:
    return distance.half_l1(placed(m, cuts, mode), pivots)


def indexed(rows: DataFrame, cuts: list[int], mode: str = "directed", pivots: int | None = None) -> Index:
    """The index of profiles() rows."""
    bins = cuts[-1]
    n = rows.count()
    several = pivots or min(PIVOTS, max(1, math.ceil(2 * math.sqrt(n))))
    heads = rows.orderBy(F.xxhash64("cell"), "cell").limit(several).select("cn").toArrow()
    tops = np.unique(placed(matrix(heads.column(0), bins), cuts, mode), axis=0) if n else np.zeros((0, 0), np.int32)

    lost = matrix(heads.column(0), bins) == 0
    sparse = bool(n and bins and mode == "directed" and (lost.astype(np.float32) @ (~lost).astype(np.float32).T == 0).mean() <= SPARSE + 1 / len(lost))  # all are so with themselves
    share = lost.mean(0) if n else np.zeros(0)
    bits = np.sort(np.argsort(-share * (1 - share), kind="stable")[:DEALT])

    marks = np.unique(np.linspace(0, max(0, len(tops) - 1), MARKS).astype(int))

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _to_pivots(matrix(batch.column(1), bins), tops, cuts, mode)
            ball = far.argmin(1)
            kept = [pa.array(ball, pa.int32()), pa.array(far[np.arange(len(ball)), ball], pa.int64()), pa.array(list(far[:, marks]), pa.list_(pa.int64())), pa.array(_loss(matrix(batch.column(1), bins), bits), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *kept], names=["cell", "cn", "ball", "far", "marks", "loss"])

    dealt = written(rows.mapInArrow(balls, "cell string, cn binary, ball int, far bigint, marks array<bigint>, loss int"), "balls")
    radii, chunks = np.zeros(len(tops), np.int64), np.zeros(len(tops), np.int64)
    for r in dealt.groupBy("ball").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # PIVOTS rows at most
        radii[r.ball], chunks[r.ball] = r.far, math.ceil(r.n / CHUNK)
    least, most = np.zeros((len(tops), len(marks)), np.int64), np.full((len(tops), len(marks)), np.iinfo(np.int64).max // 2)
    ends = dealt.select("ball", F.posexplode("marks").alias("mark", "d")).groupBy("ball", "mark").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).toArrow()  # PIVOTS x MARKS rows at most
    if ends.num_rows:
        at = np.asarray(ends.column("ball")), np.asarray(ends.column("mark"))
        least[at], most[at] = np.asarray(ends.column("lo")), np.asarray(ends.column("hi"))
    per = rows.sparkSession.createDataFrame([(b, int(c)) for b, c in enumerate(chunks)], "ball int, chunks int")
    chunk = F.pmod(F.xxhash64("cell"), F.col("chunks")).cast("int").alias("chunk")
    own = dealt.join(F.broadcast(per), "ball").select("cell", "cn", "ball", chunk, "loss", F.col("cell").alias("label"))  # PIVOTS rows
    losses = [(r.loss, r.n) for r in dealt.groupBy("loss").agg(F.count(F.lit(1)).alias("n")).collect()] if sparse else []  # 2 ^ DEALT rows at most
    return Index(own, tops, radii, marks, least, most, chunks, cuts, mode, n, bits, np.array(losses, np.int64).reshape(-1, 2), sparse)


def _loss(m: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the bins `bits` rows have lost, as whole numbers."""
    return (m[:, bits] == 0) @ (1 << np.arange(len(bits)))


def _covered(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i of a and j of b, two matrices of what is lost, of which i has all that j has; a few at a time, each pair once. Rows are parted by one bin after another: what lacks in i isn't in j."""
    words = lambda m: np.pad(np.packbits(m, axis=1), ((0, 0), (0, -math.ceil(m.shape[1] / 8) % 8))).view(np.uint64)
    lack, has = ~words(a), words(b)
    a, b = np.asfortranarray(a), np.asfortranarray(b)
    todo = [(np.arange(len(a)), np.arange(len(b)), 0)]
    while todo:
        i, j, bin_ = todo.pop()
        if not len(i) or not len(j):
            continue
        if len(i) * len(j) > LEAF and bin_ < a.shape[1]:
            lost = b[j, bin_]
            if lost.any():
                todo.append((i[a[i, bin_]], j[lost], bin_ + 1))
                j = j[~lost]
            todo.append((i, j, bin_ + 1))
            continue
        step = max(1, LEAF // len(j))
        for k in range(0, len(i), step):
            part = i[k : k + step]
            x, y = np.nonzero((lack[part, 0][:, None] & has[j, 0]) == 0)
            x, y = part[x], j[y]
            for word in range(1, has.shape[1]):
                keep = (lack[x, word] & has[y, word]) == 0
                x, y = x[keep], y[keep]
            if len(x):
                yield x, y


def _first_of(i: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least keys of each i, in order."""
    order = np.lexsort((key, i))
    own = i[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    return order[np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)])) < k]


def _met_by_loss(queries: DataFrame, index: Index, k: int, before: bool = False) -> DataFrame:
    """(cell, src, w, pairs): of each group of sources that a cell meets its k nearest ones that cost less than PENALTY, and once a task the pairs worked out. Groups are met in chunks of MEET sources, by MEET queries at a time.
    before: sources of smaller names than the cell's alone."""
    cuts, bits, losses = index.cuts, index.bits, index.losses

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, group = np.nonzero((losses[:, 0] & ~_loss(matrix(batch.column(1), cuts[-1]), bits)[:, None]) == 0) if batch.num_rows else ([], [])
            if len(x):
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(x)).columns, pa.array(losses[group, 0], pa.int32())], names=["cell", "cn", "label", "loss"])

    probes = written(queries.select("cell", "cn", "label").mapInArrow(asks, "cell string, cn binary, label string, loss int"), "probes")
    several = dict(losses.tolist())
    rows = [(r.loss, math.ceil(several[r.loss] / MEET), math.ceil(r.n / MEET)) for r in probes.groupBy("loss").agg(F.count(F.lit(1)).alias("n")).collect()]  # 2 ^ DEALT rows at most
    per = F.broadcast(probes.sparkSession.createDataFrame(rows, "loss int, chunks int, salts int"))  # 2 ^ DEALT rows at most
    dealt = lambda by, seed: F.pmod(F.xxhash64(F.lit(seed), "cell"), F.col(by)).cast("int")
    every = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    at = ["loss", "chunk", "salt"]
    ask = probes.join(per, "loss").select("loss", dealt("salts", 1).alias("salt"), every("chunks").alias("chunk"), "cell", "cn", "label")
    has = index.rows.select("cell", "cn", "label", "loss").join(per, "loss").select("loss", dealt("chunks", 2).alias("chunk"), every("salts").alias("salt"), "cell", "cn", "label")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.sort_by("cell").combine_chunks()  # of equal weights the smaller source
        found, n = [np.zeros(0, np.int64)] * 2, 0
        if a.num_rows and b.num_rows:
            x, y = (matrix(t.column("cn"), cuts[-1]) for t in (a, b))
            label = np.array(pa.chunked_array([*a.column("label").chunks, *b.column("label").chunks]).combine_chunks().dictionary_encode().indices)
            mine, theirs = label[: len(x)], label[len(x) :]
            if before:
                rank = np.array(pc.rank(pa.chunked_array([*a.column("cell").chunks, *b.column("cell").chunks]), tiebreaker="dense"))
                own, other = rank[: len(x)], rank[len(x) :]
            u, v = (np.hstack([distance.deltas(m[:, lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:])]) for m in (x, y))
            waits, held = [found], 0
            for i, j in _covered(x == 0, y == 0):
                keep = other[j] < own[i] if before else mine[i] != theirs[j]
                i, j = i[keep], j[keep]
                n += len(i)
                w = np.abs(u[i] - v[j]).sum(1, dtype=np.int64) // 2
                near = w < distance.PENALTY
                waits.append([i[near], w[near] * len(y) + j[near]])
                held += len(waits[-1][0])
                if held > KEPT:
                    waits, held = [_least(waits, k)], 0
            found = _least(waits, k)
        at, key = found
        some = max(1, b.num_rows)
        told = pa.table({"cell": pa.array([None], pa.string()), "src": pa.array([None], pa.string()), "w": pa.array([None], pa.int64()), "pairs": pa.array([n], pa.int64())})
        near = pa.table({"cell": a.column("cell").take(pa.array(at)), "src": b.column("cell").take(pa.array(key % some)), "w": pa.array(key // some, pa.int64()), "pairs": pa.nulls(len(at), pa.int64())})
        return pa.concat_tables([near, told]).combine_chunks()

    return ask.groupBy(*at).cogroup(has.groupBy(*at)).applyInArrow(run, "cell string, src string, w bigint, pairs bigint")


def _least(waits: list, k: int) -> list[np.ndarray]:
    i, key = (np.concatenate(x) for x in zip(*waits))
    first = _first_of(i, key, k)
    return [i[first], key[first]]


def _probes(queries: DataFrame, index: Index, first: bool) -> DataFrame:
    """(cell, cn, label, ball): balls to look into. queries: cell, cn, label, and the distance `most` beyond which nothing is of use, null where there is none."""
    pivots, radii, cuts, mode, some = index.pivots, index.radii, index.cuts, index.mode, index.chunks > 0
    marks, least, greatest = index.marks, index.least, index.most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _to_pivots(matrix(batch.column(1), cuts[-1]), pivots, cuts, mode)
            rank = np.argsort(np.argsort(np.where(some, far, np.iinfo(np.int64).max), axis=1, kind="stable"), axis=1, kind="stable")
            most = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
            apart = far - radii
            for j, mark in enumerate(marks):
                d = far[:, mark][:, None]
                apart = np.maximum(apart, np.maximum(d - greatest[:, j], least[:, j] - d))
            near = np.minimum(apart, distance.PENALTY) <= np.where(np.isnan(most), np.inf, most)[:, None]
            look = some & near & ((rank < FIRST) if first else (rank >= FIRST))
            k, ball = np.nonzero(look)
            if len(k):
                own = batch.select([0, 1, 2]).take(pa.array(k))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(ball, pa.int32())], names=["cell", "cn", "label", "ball"])

    return queries.select("cell", "cn", "label", F.col("most").cast("double").alias("most")).mapInArrow(run, "cell string, cn binary, label string, ball int")


def _met(probes: DataFrame, index: Index, k: int) -> DataFrame:
    """(cell, src, w, pairs): of each chunk that a cell looks into its k nearest sources, and once a task the pairs worked out. Balls that many cells look into are met by several tasks."""
    probes = written(probes, "probes")
    rows = [(r.ball, int(index.chunks[r.ball]), math.ceil(r.n / CHUNK)) for r in probes.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).collect()]  # PIVOTS rows at most
    per = F.broadcast(probes.sparkSession.createDataFrame(rows, "ball int, chunks int, salts int"))  # PIVOTS rows at most
    salt = F.pmod(F.xxhash64(F.lit(1), "cell"), F.col("salts")).cast("int").alias("salt")
    asks = probes.join(per, "ball").select("ball", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), salt, "cell", "cn", "label")
    has = index.rows.join(per.select("ball", "salts"), "ball").select("ball", "chunk", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "cell", "cn", "label")
    cuts, mode = index.cuts, index.mode

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"cell": [], "src": [], "w": []}
        if a.num_rows and b.num_rows:
            b = b.sort_by("cell")  # of equal weights the smaller source
            _, w = distance.block_distance(matrix(a.column("cn"), cuts[-1]), matrix(b.column("cn"), cuts[-1]), cuts, mode)
            codes = {x: j for j, x in enumerate({*a.column("label").to_pylist(), *b.column("label").to_pylist()})}
            mine, theirs = (np.array([codes[x] for x in t.column("label").to_pylist()]) for t in (a, b))
            m = b.num_rows
            key = np.where(mine[:, None] == theirs[None], np.iinfo(np.int64).max, w * m + np.arange(m))
            best = np.sort(np.partition(key, min(k, m) - 1, axis=1)[:, : min(k, m)], axis=1)
            at, _ = np.nonzero(best < np.iinfo(np.int64).max)
            best = best[best < np.iinfo(np.int64).max]
            out = {"cell": a.column("cell").take(pa.array(at)), "src": b.column("cell").take(pa.array(best % m)), "w": best // m}
        n = len(out["w"])
        pairs = pa.array([None] * n, pa.int64())
        found = pa.table({"cell": pa.chunked_array(out["cell"], pa.string()) if n else pa.array([], pa.string()), "src": pa.chunked_array(out["src"], pa.string()) if n else pa.array([], pa.string()), "w": pa.array(out["w"], pa.int64()), "pairs": pairs})
        told = pa.table({"cell": pa.array([None], pa.string()), "src": pa.array([None], pa.string()), "w": pa.array([None], pa.int64()), "pairs": pa.array([a.num_rows * b.num_rows], pa.int64())})
        return pa.concat_tables([found, told]).combine_chunks()

    return asks.groupBy("ball", "chunk", "salt").cogroup(has.groupBy("ball", "chunk", "salt")).applyInArrow(run, "cell string, src string, w bigint, pairs bigint")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(cell, near): up to k structs (w, src), nearest first, of different sources."""
    own = found.where("cell is not null")
    if k == 1:
        return own.groupBy("cell").agg(F.array(F.min(F.struct("w", "src"))).alias("near"))
    return own.groupBy("cell").agg(F.slice(F.array_sort(F.collect_set(F.struct("w", "src"))), 1, k).alias("near"))


def search(index: Index, queries: DataFrame | None = None, k: int = 1, short: bool = False) -> tuple[DataFrame, int]:
    """(cell, near) of each query that has sources: its up to k nearest ones, structs (w, src), nearest first and of equal weights the smaller name; and how many pairs were worked out.
    w is the distance from src to cell. queries: cell, cn, label and, if known, `most`, a distance beyond which sources are of no use; without queries, all rows of the index.
    short: a cell that has a source of less than PENALTY may be given fewer than k, if all others cost PENALTY or more."""
    queries = index.rows if queries is None else queries
    queries = queries if "most" in queries.columns else queries.withColumn("most", F.lit(None).cast("double"))
    queries = queries.select("cell", "cn", "label", F.col("most").cast("double").alias("most"))
    if not index.sparse:
        return _searched(index, queries, k)
    met = written(_met_by_loss(queries, index, k), "near")
    pairs = met.agg(F.sum("pairs")).first()[0] or 0
    found = written(_merged(met, k), "nearest")
    done = found.where(F.size("near") >= (1 if short else k)).select("cell")
    rest = written(queries.where(F.col("most").isNull() | (F.col("most") >= distance.PENALTY)).join(done, "cell", "left_anti"), "rest")
    if not rest.limit(1).count():
        return found, pairs
    others, more = _searched(index, rest, k)
    return written(found.join(rest.select("cell"), "cell", "left_anti").unionByName(others), "nearest"), pairs + more


def _searched(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, int]:
    """search() by balls."""
    one = written(_met(_probes(queries, index, True), index, k), "near")
    so_far = _merged(one, k)
    last = F.when(F.size("near") >= k, F.element_at("near", -1)["w"])
    narrowed = queries.join(so_far, "cell", "left").select("cell", "cn", "label", F.least("most", last).alias("most"))
    two = written(_met(_probes(narrowed, index, False), index, k), "near")
    both = one.unionByName(two)
    pairs = both.agg(F.sum("pairs")).first()[0] or 0
    return written(_merged(both, k), "nearest"), pairs


def nearest_parents(packed: DataFrame, root: str | None = None, mode: str = "directed") -> DataFrame:
    """(src, dst, w): for each cell but the root the nearest other one, as arborescence.least_incoming() gives them from all pairs."""
    index = indexed(*profiles(packed), mode)
    queries = index.rows if root is None else index.rows.where(F.col("cell") != root)
    found, _ = search(index, queries)
    return found.select(F.col("near")[0]["src"].alias("src"), F.col("cell").alias("dst"), F.col("near")[0]["w"].alias("w"))


def nearest_before(packed: DataFrame, mode: str = "directed", block: int | None = None) -> DataFrame:
    """(src, dst, w): for each cell the nearest of those with smaller names, as distance.least(smaller=True) gives them of all pairs. Where losses tell sources, only cells that find none by them meet all others of smaller names,
    which are few: cells whose names are among the first, or that have lost little."""
    profile, cuts = profiles(packed)
    if profile.count() <= FEW:
        return distance.least(packed, mode, smaller=True, block=block)
    index = indexed(profile, cuts, mode)
    rows = written(numbered(index.rows.select("cell", "cn"), [], ["cell"], "_k"), "named")
    if not index.sparse:
        return _all_before(rows, rows, index.n, index.n, index.cuts, mode, block)
    found = written(_merged(_met_by_loss(index.rows, index, 1, True), 1), "near")
    rest = written(rows.join(found.select("cell"), "cell", "left_anti"), "rest")
    others = _all_before(rest, rows, rest.count(), index.n, index.cuts, mode, block)
    return found.select(F.col("near")[0]["src"].alias("src"), F.col("cell").alias("dst"), F.col("near")[0]["w"].alias("w")).unionByName(others)


def _all_before(queries: DataFrame, rows: DataFrame, several: int, n: int, cuts: list[int], mode: str, block: int | None) -> DataFrame:
    """(src, dst, w): for each of `several` queries the nearest of the rows before it, by comparison with all of these. queries, rows: cell, cn, and place _k in order of names; blocks of both are stretches of that order, so that a block of queries meets
    no rows beyond its last one."""
    size, per = (max(1, math.ceil(x / distance.grown(x, block, cuts[-1]))) for x in (n, several))
    at = lambda c, by: F.floor((F.col(c) - 1) / by).cast("int")
    one_row = lambda df, c: df.groupBy(c).agg(F.array_sort(F.collect_list(F.struct("_k", "cell", "cn"))).alias("rows")).select(c, F.transform("rows", lambda r: r["_k"]).alias("k"), F.transform("rows", lambda r: r["cell"]).alias("cell"), F.transform("rows", lambda r: r["cn"]).alias("cn"))
    asks = written(one_row(numbered(queries, [], ["_k"], "_r").withColumn("_q", at("_r", per)), "_q").withColumn("_last", ((F.element_at("k", -1) - 2) / size).cast("int")), "asks")
    has = written(one_row(rows.withColumn("_c", at("_k", size)), "_c"), "blocks")
    pairs = asks.where(F.element_at("k", -1) > 1).select("_q", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_c"))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(distance.MANY, math.ceil(several / per) * math.ceil(n / size) // 8))
    anew = lambda df: df.select([F.col(c).alias(c) for c in ("_q", "_c", "k", "cell", "cn")]).repartition(tasks, "_q", "_c").groupBy("_q", "_c")
    a, b = anew(pairs.join(asks.drop("_last"), "_q")), anew(has.join(pairs, "_c"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names, place, m = [], [], []
        for t in (b, a):
            names.append(t.column("cell")[0].values)
            place.append(np.array(t.column("k")[0].values))
            m.append(matrix(t.column("cn")[0].values, cuts[-1]))
        some = int(np.searchsorted(place[0], place[1][-1]))  # of the rows those before the last query
        best, who = np.full(len(place[1]), np.inf), np.full(len(place[1]), -1)
        for x, y, w, _ in distance.parted(m[0][:some], m[1], cuts, mode) if cuts[-1] else [(slice(0, some), slice(0, len(place[1])), np.zeros((some, len(place[1]))), None)]:
            w = np.where(place[0][:some][x][:, None] < place[1][y], w, np.inf)
            own = w.min(0)
            near = np.flatnonzero(own < best[y])
            best[y.start + near], who[y.start + near] = own[near], w[:, near].argmin(0) + x.start
        found = np.flatnonzero(who >= 0)
        return pa.table({"src": names[0].take(pa.array(who[found])), "dst": names[1].take(pa.array(found)), "w": pa.array(best[found].astype(np.int64), pa.int64())})

    met = a.cogroup(b).applyInArrow(run, "src string, dst string, w bigint")
    return met.groupBy("dst").agg(F.min(F.struct("w", "src")).alias("e")).select("e.src", "dst", "e.w")


def weighed(pairs: DataFrame, index: Index) -> DataFrame:
    """(src, dst, w) of given pairs (src, dst) of the index's cells."""
    cuts, mode = index.cuts, index.mode
    cn = index.rows.select("cell", "cn")
    both = pairs.join(cn.select(F.col("cell").alias("src"), F.col("cn").alias("a")), "src").join(cn.select(F.col("cell").alias("dst"), F.col("cn").alias("b")), "dst").select("src", "dst", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = matrix(batch.column(2), cuts[-1]), matrix(batch.column(3), cuts[-1])
                w = [int(distance.block_distance(a[k : k + 1], b[k : k + 1], cuts, mode)[0][0, 0]) for k in range(len(a))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(w, pa.int64())], names=["src", "dst", "w"])

    return both.mapInArrow(run, "src string, dst string, w bigint")
