"""Minimal-event distance: the fewest steps of one copy, each on a stretch of neighbouring bins, that turn one profile into another; summed over
chromosomes.

With d the difference of two profiles along a chromosome and zeros before and after, that is half of sum |d[i] - d[i-1]|: half the L1 distance of the
profiles' breakpoint vectors. A chromosome on which a lost allele would have to come back costs PENALTY instead:
`directed`: some bin has 0 in the source and not in the target. `symmetric`: some bin has 0 in one of them alone; bins with 0 in both are
left out, so that stretches join across them. `none`: no such rule.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloneforge.operators.ordered import numbered
from cloneforge.plans.storage import written

PENALTY = 1_000_000
MODES = ("directed", "symmetric", "none")
#: Cells of a block at most and at least; cells of a tile, whose distances are worked out at once; levels of breakpoints beyond which they are worked out one by one.
BLOCK, BLOCK_LEAST, TILE, LEVELS = 1024, 128, 256, 64
#: Blocks at about, beyond which they grow, and bytes of a block that has grown: each cell meets all blocks, so that their number tells how often cells are copied.
BLOCKS, BLOCK_BYTES = 64, 1 << 26
#: Cells of one place in an array at most; cells of a square in a part; pairs of cells that a task compares, at about, and tasks at most.
ALIKE, TOGETHER, A_TASK, MANY = 16, 1_000, 10_000_000, 4_096


def breakpoints(cns: Column) -> Column:
    """Differences of neighbours along a chromosome, with 2 before and after."""
    ends = F.array(F.lit(2))
    return F.zip_with(F.concat(cns, ends), F.concat(ends, cns), lambda a, b: a - b)


def steps(u: Column, v: Column, mode: str = "directed") -> Column:
    """Distance of two chromosomes, as array columns of one length."""
    if mode == "symmetric":
        keep = lambda x, y: F.transform(F.filter(F.arrays_zip(x.alias("a"), y.alias("b")), lambda e: (e["a"] != 0) | (e["b"] != 0)), lambda e: e["a"])
        mine, other = keep(u, v), keep(v, u)
    else:
        mine, other = u, v
    diff = F.zip_with(breakpoints(mine), breakpoints(other), lambda a, b: F.abs(a - b))
    total = (F.aggregate(diff, F.lit(0).cast("long"), lambda acc, x: acc + x) / 2).cast("long")
    if mode == "none":
        return total
    bad = (lambda a, b: (a == 0) & (b != 0)) if mode == "directed" else (lambda a, b: (a == 0) != (b == 0))
    return F.when(F.exists(F.zip_with(u, v, bad), lambda x: x), F.lit(PENALTY).cast("long")).otherwise(total)


def known(cns: Column) -> Column:
    """Copy numbers of a chromosome, none of them null: a null makes the query fail, as no distance could tell what it stands for. segment.complete_features() drops what isn't known of all cells."""
    return F.when(cns.isNull() | F.exists(cns, lambda x: x.isNull()), F.raise_error(F.lit("a copy number is null: drop its feature first, by segment.complete_features()"))).otherwise(cns)


def pair_distance(pairs: DataFrame, packed: DataFrame, mode: str = "directed") -> DataFrame:
    """(src, dst, w) of given pairs (src, dst): array functions on the chromosomes of both. Fails on null copy numbers."""
    u = packed.select(F.col("cell").alias("src"), "chrom", known(F.col("cns")).alias("u"))
    v = packed.select(F.col("cell").alias("dst"), "chrom", known(F.col("cns")).alias("v"))
    both = pairs.join(u, "src").join(v, ["dst", "chrom"])
    return both.groupBy("src", "dst").agg(F.sum(steps(F.col("u"), F.col("v"), mode)).alias("w"))


def whole_profiles(packed: DataFrame) -> tuple[DataFrame, list[int]]:
    """(cell, cns) of whole cells, chromosomes in order of their names, and where these begin, and the end. ValueError where cells differ in chromosomes or bins, or a copy number is null."""
    whole = packed.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("chrom", "cns"))).alias("p"))
    shape = F.transform("p", lambda x: F.struct(x["chrom"], F.size(x["cns"]).alias("n")))
    null = F.exists("p", lambda x: x["cns"].isNull() | F.exists(x["cns"], lambda c: c.isNull()))
    told = whole.agg(F.min(shape).alias("lo"), F.max(shape).alias("hi"), F.min_by("cell", shape).alias("a"), F.max_by("cell", shape).alias("b"), F.min(F.when(null, F.col("cell"))).alias("null")).first()
    if told.null is not None:
        raise ValueError(f"a copy number of cell {told.null} is null: drop its feature first, by segment.complete_features()")
    if told.lo != told.hi:
        raise ValueError(f"cells {told.a} and {told.b} differ in their chromosomes or bins")
    cuts = np.cumsum([0, *(x.n for x in told.lo or [])]).tolist()
    return whole.select("cell", F.flatten(F.transform("p", lambda x: x["cns"])).alias("cns")), cuts


def matrix(packed: pa.ChunkedArray | pa.Array, bins: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in packed), np.int16).reshape(len(packed), bins)


def profiles(packed: DataFrame) -> tuple[DataFrame, list[int]]:
    """(cell, cn) of cells (cell, chrom, cns), with all copy numbers in one row, and where chromosomes begin, and the end. All cells must have the same chromosomes and bins, and no null copy number (ValueError)."""
    whole, cuts = whole_profiles(packed)

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1).astype(np.int16)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in m], pa.binary())], names=["cell", "cn"])

    return written(whole.select("cell", "cns").mapInArrow(blobs, "cell string, cn binary"), "cells"), cuts


def half_l1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half the L1 distances of all rows of a to all of b, whose sums are even."""
    out = np.empty((len(a), len(b)), np.int64)
    if not out.size:
        return out
    spread = int(max(a.max(initial=0), b.max(initial=0)) - min(a.min(initial=0), b.min(initial=0)))
    if 0 < spread <= LEVELS and spread * a.shape[1] < 1 << 22:
        left, right = _factors(a, b)
        for i in range(0, len(a), TILE):
            out[i : i + TILE] = left[i : i + TILE] @ right
        return out
    small = max(1, (1 << 18) // max(1, a.shape[1]))
    for i in range(len(a)):
        for j in range(0, len(b), small):
            out[i, j : j + small] = np.abs(b[j : j + small] - a[i]).sum(1, dtype=np.int64)
    return out // 2


def deltas(x: np.ndarray) -> np.ndarray:
    """breakpoints() of rows."""
    return np.diff(np.pad(x.astype(np.int32), ((0, 0), (1, 1)), constant_values=2), axis=1)


def _plain_distance(a: np.ndarray, b: np.ndarray, cuts: Sequence[int], mode: str) -> tuple[np.ndarray, np.ndarray]:
    """block_distance() of any copy numbers."""
    there = np.zeros((len(a), len(b)), np.int64)
    back = there.copy()
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        x, y = a[:, lo:hi], b[:, lo:hi]
        zx, zy = (x == 0), (y == 0)
        own = half_l1(*(deltas(_squeezed(m, z) if mode == "symmetric" else m) for m, z in ((x, zx), (y, zy))))
        if mode == "none" or not (zx.any() or zy.any()):
            there += own
            back += own
            continue
        lost = zx.astype(np.float32) @ (~zy).astype(np.float32).T > 0  # 0 in a, not in b
        lost_back = (~zx).astype(np.float32) @ zy.astype(np.float32).T > 0
        if mode == "symmetric":
            lost = lost_back = lost | lost_back
        there += np.where(lost, PENALTY, own)
        back += np.where(lost_back, PENALTY, own)
    return there, back


def _squeezed(m: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """Rows without the bins that are lost: patterns of two rows that differ cost the penalty anyway."""
    return np.take_along_axis(np.where(lost, 2, m), np.argsort(lost, axis=1, kind="stable"), 1)


def _factors(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices whose product is half the L1 distances of all rows of x to all of y: |u - v| counts the levels that one of them alone exceeds."""
    least, most = int(min(x.min(), y.min())), int(max(x.max(), y.max()))
    s, t = ((m[:, :, None] > np.arange(least, most)).reshape(len(m), -1).astype(np.float32) for m in (x, y))
    one = lambda m: np.ones((len(m), 1), np.float32)
    return np.hstack([s, s.sum(1, keepdims=True) / 2, one(s)]), np.hstack([-t, one(t), t.sum(1, keepdims=True) / 2]).T.copy()


def tiles(a: np.ndarray, b: np.ndarray, cuts: Sequence[int], mode: str, tile: int = TILE) -> Iterator[tuple[slice, slice, np.ndarray, np.ndarray]]:
    """Distances a -> b and b -> a of all pairs of rows by tiles, from the first rows to the last ones; cuts: where chromosomes begin, and the end. Tiles hold whole numbers, and are written over by the next ones. Matrix products of single precision: all they sum
    are halves and whole numbers that it holds exactly, and a chromosome with a loss comes to more than the penalty, to which it is cut."""
    if not len(a) or not len(b):
        return
    spread = max(1, 2 * int(max(a.max(initial=2), b.max(initial=2)) - min(a.min(initial=2), b.min(initial=2))))
    if spread > LEVELS or spread * (cuts[-1] + len(cuts)) >= PENALTY:
        for i in range(0, len(a), tile):
            for j in range(0, len(b), tile):
                yield slice(i, i + tile), slice(j, j + tile), *_plain_distance(a[i : i + tile], b[j : j + tile], cuts, mode)
        return
    f = lambda m: m.astype(np.float32)
    parts = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        x, y = a[:, lo:hi], b[:, lo:hi]
        zx, zy = x == 0, y == 0
        own = [deltas(_squeezed(m, z) if mode == "symmetric" else m) for m, z in ((x, zx), (y, zy))]
        rule = mode != "none" and (zx.any() or zy.any())
        big = np.float32(2 * PENALTY)
        if not rule:
            loss = []
        elif mode == "symmetric":
            loss = [(np.hstack([f(zx), f(~zx)]) * big, f(np.hstack([~zy, zy])).T.copy())]
        else:
            loss = [(f(zx) * big, f(~zy).T.copy()), (f(~zx) * big, f(zy).T.copy())]
        parts.append((own, loss))
    free = [own for own, loss in parts if not loss]  # chromosomes without a rule are as one
    factors = [(_factors(*(np.hstack(m) for m in zip(*free))), [])] if free else []
    factors += [(_factors(*own), loss) for own, loss in parts if loss]
    kind = np.float32 if PENALTY * (len(cuts) + 1) < 1 << 24 else np.float64
    for i in range(0, len(a), tile):
        for j in range(0, len(b), tile):
            at, to = slice(i, i + tile), slice(j, j + tile)
            there = back = None
            for (left, right), loss in factors:
                own = left[at] @ right[:, to]
                sides = []
                for u, v in loss:
                    w = u[at] @ v[:, to]
                    w += own
                    sides.append(np.minimum(w, np.float32(PENALTY), out=w))
                one, two = (sides[0], sides[-1]) if sides else (own, own)
                if there is None:
                    there, back = one.astype(kind), two.astype(kind)
                else:
                    there += one
                    back += two
            yield at, to, there, back


def block_distance(a: np.ndarray, b: np.ndarray, cuts: Sequence[int], mode: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances a -> b and b -> a of all pairs of rows; cuts: where chromosomes begin, and the end."""
    there = np.zeros((len(a), len(b)), np.int64)
    back = there.copy()
    if cuts[-1]:
        for at, to, one, two in tiles(a, b, cuts, mode):
            there[at, to], back[at, to] = one, two
    return there, back


def blocks_of(n: int, block: int | None) -> int:
    """In how many blocks so many cells are dealt: of BLOCK cells at most, or else so many that pairs of blocks keep all cores busy."""
    return max(1, math.ceil(n / (block or min(BLOCK, max(BLOCK_LEAST, math.ceil(n / 16))))))


def dealt(rows: DataFrame, blocks: int, by_hash: bool = True) -> DataFrame:
    """rows (cell, ...) in each of the pairs of blocks (_i, _j), _i <= _j, that their own block (_b) belongs to; without by_hash they have it."""
    own = rows.withColumn("_b", F.pmod(F.xxhash64("cell"), F.lit(blocks)).cast("int")) if by_hash else rows
    own = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return own.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_o")


def met(blocks: DataFrame, several: int, keys: Sequence[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run over each pair of blocks: two rows of blocks (keys, _b, ...), or one where a block meets itself, in as many tasks as there is work for."""
    tasks = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MANY, several * several // 8))
    both = dealt(blocks, several, False)
    return both.repartition(tasks, *keys, "_i", "_j").groupBy(*keys, "_i", "_j").applyInArrow(run, schema)


def sides(batches: Iterator[pa.RecordBatch]) -> tuple[dict, dict] | None:
    """The two blocks of a task, as scalars by column; the same one twice where a block meets itself, and None where the other one has no cells."""
    rows = [{name: batch.column(name)[k] for name in batch.schema.names} for batch in batches for k in range(batch.num_rows)]
    rows.sort(key=lambda r: r["_b"].as_py())
    return (rows[0], rows[-1]) if len(rows) > 1 or rows[0]["_i"] == rows[0]["_j"] else None


def tiled(got: Iterator[tuple], same: bool, both: bool = True) -> Iterator[tuple[bool, slice, slice, np.ndarray]]:
    """Is it the way back, places of sources and of targets, and distances, by tiles of the pairs of two blocks; of one block with itself all pairs are there once. both: with those from the second block to the first."""
    for at, to, there, back in got:
        yield False, at, to, there
        if both and not same:
            yield True, to, at, back.T


def tile_of(src: pa.Array, dst: pa.Array, w: np.ndarray, without: np.ndarray | None = None) -> list[pa.Array]:
    """One row for the pairs of all src with all dst, but those `without`: names of both, and distances by rows of TILE places. What is null is no pair, such as places beyond the last name."""
    out, none = np.zeros((len(src), TILE), np.int64), np.zeros((len(src), TILE), bool)
    out[:, : len(dst)] = w
    none[:, len(dst) :] = True
    if without is not None:
        none[:, : len(dst)] |= without
    lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return [lists(src), lists(dst), lists(pa.array(out.ravel(), pa.int64(), mask=none.ravel() if none.any() else None))]


def narrow(m: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them."""
    return m.astype(next(k for k in ("int8", "int16", "int64") if not m.size or np.iinfo(k).min <= m.min() and m.max() <= np.iinfo(k).max))


#: What tile_of() makes.
TILED = "src array<string>, dst array<string>, w array<bigint>"


def opened(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, src, dst, w) of tiles. Names are taken by place as rows are made, so that Python hands over no string for a pair."""
    shift = TILE.bit_length() - 1
    long = rows.select(*keys, "src", "dst", F.posexplode("w").alias("_p", "w")).where("w is not null")
    return long.select(*keys, F.get("src", F.shiftright("_p", shift)).alias("src"), F.get("dst", F.col("_p").bitwiseAND(TILE - 1)).alias("dst"), "w")


def grown(n: int, block: int | None, bins: int) -> int:
    """blocks_of(), with larger blocks where there would be more than BLOCKS: of BLOCK_BYTES at most, as copy numbers of two bytes, or of BLOCK cells."""
    return blocks_of(n, block or max(min(BLOCK, max(BLOCK_LEAST, math.ceil(n / 16))), min(math.ceil(n / BLOCKS), BLOCK_BYTES // max(1, 2 * bins))))


def parted(one: np.ndarray, two: np.ndarray, cuts: Sequence[int], mode: str) -> Iterator[tuple]:
    """tiles() of blocks of any size, BLOCK by BLOCK rows, so that what is held beside the blocks doesn't grow with them."""
    for i in range(0, len(one), BLOCK):
        for j in range(0, len(two), BLOCK):
            for at, to, there, back in tiles(one[i : i + BLOCK], two[j : j + BLOCK], cuts, mode):
                yield slice(i + at.start, i + min(at.stop, BLOCK)), slice(j + to.start, j + min(to.stop, BLOCK)), there, back


def all_pairs(packed: DataFrame, mode: str = "directed", keys: Sequence[str] = (), block: int | None = None, less: DataFrame | None = None) -> DataFrame:
    """(keys, src, dst, w) of all ordered pairs of different cells. Cells are dealt to blocks, of one row each; each pair of blocks meets in one task, which works both
    directions out in one go and hands them over tile by tile. A task holds two blocks of profiles, whatever the number of cells. less (cell, less): what is taken off the distances from a cell. Fails on null copy numbers."""
    whole = packed.withColumn("cns", known(F.col("cns"))).groupBy(*keys, "cell").agg(F.array_sort(F.collect_list(F.struct("chrom", "cns"))).alias("p"))
    shape = F.to_json(F.transform("p", lambda x: F.struct(x["chrom"].cast("string").alias("c"), F.size(x["cns"]).alias("n"))))
    whole = whole.select(*keys, "cell", F.flatten(F.transform("p", lambda x: x["cns"])).alias("cns"), shape.alias("shape"))
    n, bins = whole.agg(F.count_distinct("cell"), F.max(F.size("cns"))).first()
    if less is not None:
        whole = whole.join(less.select("cell", F.col("less").cast("long").alias("less")), "cell")
    else:
        whole = whole.withColumn("less", F.lit(0).cast("long"))
    several = grown(n, block, bins or 0)
    kept = "".join(f"{k} {dict(packed.dtypes)[k]}, " for k in keys)

    def differ(a: object, b: object) -> ValueError:
        return ValueError(f"cells {a} and {b} differ in their chromosomes or bins")

    def gathered(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        cell, shapes = t.column("cell").combine_chunks(), t.column("shape").to_pylist()
        if any(x != shapes[0] for x in shapes):
            raise differ(cell[0], cell[next(k for k, x in enumerate(shapes) if x != shapes[0])])
        m = narrow(np.array(t.column("cns").combine_chunks().flatten()))
        row = {"_b": t.column("_b")[:1], "names": [cell.to_pylist()], "cn": pa.array([m.tobytes()], pa.binary()), "kind": [m.dtype.name], "shape": shapes[:1], "less": [t.column("less").to_pylist()]}
        return pa.table({k: t.column(k)[:1] for k in keys} | row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (both := sides(batches)):
            return
        one, two = both
        if one["shape"] != two["shape"]:
            raise differ(one["names"].values[0], two["names"].values[0])
        cuts = np.cumsum([0, *(x["n"] for x in json.loads(one["shape"].as_py()))]).tolist()
        names = [x["names"].values for x in (one, two)]
        m = [np.frombuffer(x["cn"].as_buffer(), x["kind"].as_py()).reshape(len(y), -1) for x, y in zip((one, two), names)]
        off = [np.array(x["less"].values) for x in (one, two)]
        same = one["_b"] == two["_b"]
        for back, at, to, w in tiled(parted(*m, cuts, mode), same):
            src, dst = (names[x][y.start : y.stop] for x, y in ((back, at), (not back, to)))
            own = tile_of(src, dst, w.astype(np.int64) - off[back][at][:, None], np.eye(len(w), dtype=bool) if same and at == to else None)
            yield pa.RecordBatch.from_arrays([*(pa.array([one[k].as_py()], one[k].type) for k in keys), *own], names=[*keys, "src", "dst", "w"])

    whole = whole.withColumn("_b", F.pmod(F.xxhash64("cell"), F.lit(several)).cast("int"))
    blocks = whole.groupBy(*keys, "_b").applyInArrow(gathered, f"{kept}_b int, names array<string>, cn binary, kind string, shape string, less array<bigint>")
    return opened(met(blocks, several, keys, run, kept + TILED), keys)


def over_pairs(packed: DataFrame, mode: str, fold: Callable[[pa.Array, pa.Array, Iterator[tuple], bool], pa.Table], schema: str, block: int | None = None) -> DataFrame:
    """What fold tells of each pair of blocks: of the names of both, in order, tiles() of their distances, and whether they are one block. No table of pairs is made, so that what leaves a task is what fold keeps."""
    rows, cuts = profiles(packed)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cell").combine_chunks()
        cell, b, i, j = t.column("cell").combine_chunks(), np.array(t.column("_b")), t.column("_i")[0].as_py(), t.column("_j")[0].as_py()
        m = matrix(t.column("cn"), cuts[-1])
        one, two = np.flatnonzero(b == i), np.flatnonzero(b == j)
        return fold(cell.take(pa.array(one)), cell.take(pa.array(two)), tiles(m[one], m[two], cuts, mode), i == j)

    return dealt(rows, blocks_of(rows.count(), block)).groupBy("_i", "_j").applyInArrow(run, schema)


def least(packed: DataFrame, mode: str = "directed", smaller: bool = False, out: bool = False, block: int | None = None) -> DataFrame:
    """(src, dst, w): for each cell the least distance from another one, of equal ones that of the smallest name; smaller: from one of a smaller name than its own. out: for each cell src the least distance to another one. Each pair of blocks
    keeps one source for each of its cells."""

    def fold(one: pa.Array, two: pa.Array, got: Iterator[tuple], same: bool) -> pa.Table:
        best = [np.full(len(x), np.inf) for x in (one, two)]
        who = [np.full(len(x), -1) for x in (one, two)]
        if smaller:
            rank = np.argsort(np.argsort(np.array([*one.to_pylist(), *two.to_pylist()], object), kind="stable"), kind="stable")
            before, after = rank[: len(one)], rank[len(one) :]
        for at, to, there, back in got:
            if out:
                there, back = back, there
            if same and at == to:
                np.fill_diagonal(there, np.inf)
            if smaller:
                mine = (np.arange(len(one)) if same else before)[at][:, None] < (np.arange(len(two)) if same else after)[to]
                there = np.where(mine, there, np.inf)
                back = back if same else np.where(mine, np.inf, back)
            for side, w, where in ((1, there, to), (0, back.T, at))[: 1 if same else 2]:
                own = w.min(0)
                near = np.flatnonzero(own < best[side][where])
                if len(near):
                    best[side][where.start + near] = own[near]
                    who[side][where.start + near] = w[:, near].argmin(0) + (at if side else to).start
        found = []
        for side, mine, other in ((1, two, one), (0, one, two))[: 1 if same else 2]:
            has = np.flatnonzero(who[side] >= 0)
            found.append(pa.table({"a": other.take(pa.array(who[side][has])), "b": mine.take(pa.array(has)), "w": pa.array(best[side][has].astype(np.int64), pa.int64())}))
        return pa.concat_tables(found).combine_chunks()

    met = over_pairs(packed, mode, fold, "a string, b string, w bigint", block).groupBy("b").agg(F.min(F.struct("w", "a")).alias("e"))
    a, b = ("dst", "src") if out else ("src", "dst")
    return met.select(F.col("e.a").alias(a), F.col("b").alias(b), F.col("e.w").alias("w")).select("src", "dst", "w")


def _once(at: slice, to: slice, w: np.ndarray, same: bool) -> np.ndarray:
    """Which entries of a tile are pairs of cells, each of them once."""
    if not same or at.start < to.start:
        return np.ones(w.shape, bool)
    return np.triu(np.ones(w.shape, bool), 1) if at == to else np.zeros(w.shape, bool)


def summary_of_pairs(packed: DataFrame, mode: str = "directed", block: int | None = None) -> DataFrame:
    """summary() of all_pairs(); each pair of blocks gives one row."""

    def fold(one: pa.Array, two: pa.Array, got: Iterator[tuple], same: bool) -> pa.Table:
        n, lo, hi, total = 0, [], [], 0
        for at, to, there, back in got:
            if same and at.start > to.start:
                continue
            for w in (there, back):
                if same and at == to:
                    w = w[_once(at, to, w, same)]
                if w.size:
                    n, total = n + w.size, total + int(w.sum(dtype=np.float64))
                    lo.append(int(w.min()))
                    hi.append(int(w.max()))
        return pa.table({"n": [n], "lo": pa.array([min(lo, default=None)], pa.int64()), "hi": pa.array([max(hi, default=None)], pa.int64()), "total": pa.array([total if n else None], pa.int64())})

    per = over_pairs(packed, mode, fold, "n bigint, lo bigint, hi bigint, total bigint", block)
    whole = per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_pairs"), F.min("lo").alias("min_w"), F.max("hi").alias("max_w"), F.sum("total").alias("sum_w"))
    return whole.select("n_pairs", "min_w", "max_w", F.when(F.col("n_pairs") > 0, F.col("sum_w") / F.col("n_pairs")).alias("mean_w"), "sum_w")


def histogram_of_pairs(packed: DataFrame, mode: str = "none", buckets: int = 20, block: int | None = None) -> DataFrame:
    """histogram() of all_pairs(); each pair of blocks counts its distances."""

    def fold(one: pa.Array, two: pa.Array, got: Iterator[tuple], same: bool) -> pa.Table:
        names = np.array([*one.to_pylist(), *two.to_pylist()], object)
        first, second = (names[: len(one), None], names[None, len(one) :])
        count: dict[int, int] = {}
        for at, to, there, back in got:
            once = _once(at, to, there, same)
            if mode == "directed" and not same:  # the distance from the smaller name is the pair's
                there = np.where(first[at] < second[:, to], there, back)
            w, n = np.unique(there[once].astype(np.int64), return_counts=True)
            for k, c in zip(w.tolist(), n.tolist()):
                count[k] = count.get(k, 0) + c
        return pa.table({"w": pa.array(list(count), pa.int64()), "n": pa.array(list(count.values()), pa.int64())})

    own = written(over_pairs(packed, mode, fold, "w bigint, n bigint", block).groupBy("w").agg(F.sum("n").alias("n")), "distances")
    ends = own.agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    share = (F.col("w") - F.col("lo")) / F.greatest(F.lit(1), F.col("hi") - F.col("lo"))
    return own.crossJoin(F.broadcast(ends)).groupBy(F.least(F.lit(buckets), F.floor(share * buckets) + 1).cast("int").alias("bucket")).agg(F.sum("n").alias("n"))  # one row


def asymmetry_of_pairs(packed: DataFrame, mode: str = "directed", block: int | None = None) -> DataFrame:
    """asymmetry() of all_pairs(); each pair of blocks gives one row."""

    def fold(one: pa.Array, two: pa.Array, got: Iterator[tuple], same: bool) -> pa.Table:
        most, n = None, 0
        for at, to, there, back in got:
            apart = np.abs(there.astype(np.float64) - back)[_once(at, to, there, same)]
            if apart.size:
                most, n = max(most or 0, int(apart.max())), n + int(np.count_nonzero(apart))
        return pa.table({"most": pa.array([most], pa.int64()), "n": pa.array([n], pa.int64())})

    return over_pairs(packed, mode, fold, "most bigint, n bigint", block).agg(F.max("most").alias("max_diff"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_differ"))


def half_tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Half the L1 distances of all rows of a to all of b by tiles, halves included; factors are held for BLOCK by BLOCK rows."""
    spread = int(max(a.max(initial=0), b.max(initial=0))) - int(min(a.min(initial=0), b.min(initial=0)))
    for i in range(0, len(a), BLOCK):
        for j in range(0, len(b), BLOCK):
            x, y = a[i : i + BLOCK], b[j : j + BLOCK]
            quick = 0 < spread <= LEVELS and spread * a.shape[1] < 1 << 22
            left, right = _factors(x, y) if quick and x.size and min(x.min(), y.min()) < max(x.max(), y.max()) else (None, None)
            for k in range(0, len(x), TILE):
                for n in range(0, len(y), TILE):
                    at, to = slice(k, min(k + TILE, len(x))), slice(n, min(n + TILE, len(y)))
                    w = left[at] @ right[:, to] if left is not None else half_l1(2 * x[at].astype(np.int64), 2 * y[to].astype(np.int64)) / 2
                    yield slice(i + at.start, i + at.stop), slice(j + to.start, j + to.stop), w


def sparse_pairs(packed: DataFrame, block: int | None = None) -> DataFrame:
    """(src, dst, w) of all pairs, src < dst, without a zero rule, for profiles with few breakpoints: sums of the cells' own breakpoints, and what changes at places where both of two blocks have some. Blocks are stretches of the cells in order of their
    names, of one row each with the cells' breakpoints alone, and a task compares two blocks at the places that they share. Fails on null copy numbers."""
    points = F.filter(F.transform(breakpoints(known(F.col("cns"))), lambda d, i: F.struct(F.concat_ws(":", "chrom", i.cast("string")).alias("at"), d.cast("int").alias("d"))), lambda e: e["d"] != 0)
    whole = packed.select("cell", points.alias("p")).groupBy("cell").agg(F.flatten(F.collect_list("p")).alias("p"))
    whole = written(whole.select("cell", F.transform("p", lambda e: e["at"]).alias("at"), F.transform("p", lambda e: e["d"]).alias("d")), "breakpoints")
    n, most = whole.agg(F.count(F.lit(1)), F.max(F.size("at"))).first()
    several = grown(n, block, most or 0)
    size = max(1, math.ceil(n / several))
    order = numbered(whole.select("cell"), [], ["cell"], "_k").select("cell", F.floor((F.col("_k") - 1) / size).cast("int").alias("_b"))

    def gathered(t: pa.Table) -> pa.Table:
        t = t.sort_by("cell").combine_chunks()
        at = t.column("at").combine_chunks()
        coded, d = at.flatten().dictionary_encode(), narrow(np.array(t.column("d").combine_chunks().flatten(), np.int64))
        blob = lambda x: pa.array([x.tobytes()], pa.binary())
        count, place = narrow(np.array(at.value_lengths())), narrow(np.array(coded.indices))
        return pa.table({"_b": t.column("_b")[:1], "names": [t.column("cell").to_pylist()], "places": pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())), "count": blob(count), "place": blob(place), "d": blob(d), "kinds": [[x.dtype.name for x in (count, place, d)]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (both := sides(batches)):
            return
        places = [x["places"].values.to_pylist() for x in both]
        column = {x: k for k, x in enumerate(sorted({*places[0]} & {*places[1]}))}
        m, rest, names = [], [], [x["names"].values for x in both]
        for x, own in zip(both, places):
            count, place, d = (np.frombuffer(x[c].as_buffer(), kind) for c, kind in zip(("count", "place", "d"), x["kinds"].as_py()))
            row, to = np.repeat(np.arange(len(count)), count), np.array([column.get(p, -1) for p in own], np.int64)[place]
            shared = to >= 0
            m.append(np.zeros((len(x["names"].values), len(column)), d.dtype))
            m[-1][row[shared], to[shared]] = d[shared]
            rest.append(np.bincount(row[~shared], np.abs(d[~shared].astype(np.int64)), minlength=len(m[-1])) / 2)
        same = both[0]["_b"] == both[1]["_b"]
        for at, to, w in half_tiles(*m):
            if not same or at.start <= to.start:
                without = np.tri(*w.shape, dtype=bool) if same and at == to else None
                src, dst = names[0][at.start : at.stop], names[1][to.start : to.stop]
                yield pa.RecordBatch.from_arrays(tile_of(src, dst, np.rint(w.astype(float) + rest[0][at][:, None] + rest[1][to]), without), names=["src", "dst", "w"])

    blocks = whole.join(order, "cell").groupBy("_b").applyInArrow(gathered, "_b int, names array<string>, places array<string>, count binary, place binary, d binary, kinds array<string>")
    return opened(met(blocks, several, [], run, TILED))


def near_pairs(coords: DataFrame, radius: float) -> DataFrame:
    """(src, dst) of different cells nearer than radius. Cells of one place stand in arrays, which are compared as one: an equi-join over the squares of a grid and those around them, crowded squares in parts. Arrays are opened
    where they are near, in as many tasks as there are cells to compare, since rows that meet are few beside the pairs they make. Cells without a place have none near."""
    there = [F.abs(F.col(c)).cast("double") < float("inf") for c in ("x", "y")]
    side = radius / 2 * (1 + 1e-6)  # a little more than half, so that no rounding parts cells by three squares
    at = ["gx", "gy"]
    own = coords.where(there[0] & there[1]).select("cell", "x", "y", F.floor(F.col("x") / side).alias("gx"), F.floor(F.col("y") / side).alias("gy"))
    alike = own.groupBy("x", "y").agg(F.ceil(F.count(F.lit(1)) / ALIKE).cast("int").alias("chunks"))
    arrays = own.join(alike, ["x", "y"]).groupBy(*at, "x", "y", F.pmod(F.xxhash64("cell"), F.col("chunks")).alias("chunk")).agg(F.collect_list("cell").alias("cells"))
    arrays = written(arrays, "places")
    squares = written(arrays.groupBy(*at).agg(F.sum(F.size("cells")).alias("n")).withColumn("parts", F.ceil(F.col("n") / TOGETHER).cast("int")), "squares")
    around = F.explode(F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in range(-2, 3) for j in range(-2, 3)])).alias("g")
    met = squares.select(F.col("n").alias("n1"), around).select("n1", "g.*").join(squares, at).agg(F.sum(F.col("n1").cast("double") * F.col("n"))).first()[0] or 0
    tasks = max(int(coords.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MANY, math.ceil(met / A_TASK)))
    a = arrays.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("cells").alias("a"), around).select("x1", "y1", "a", "g.*").join(squares, at).select(*at, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "x1", "y1", "a")
    b = arrays.join(squares, at).select(*at, F.pmod(F.xxhash64("x", "y", "chunk"), F.col("parts")).cast("int").alias("part"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("cells").alias("b"))
    a, b = (x.repartition(tasks, *at, "part") for x in (a, b))
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    near = a.join(b, [*at, "part"]).where(dx * dx + dy * dy < radius * radius)
    return near.select(F.explode("a").alias("src"), "b").select("src", F.explode("b").alias("dst")).where(F.col("src") != F.col("dst"))


def summary(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("n_pairs"), F.min("w").alias("min_w"), F.max("w").alias("max_w"), F.avg("w").alias("mean_w"), F.sum("w").alias("sum_w"))


def histogram(edges: DataFrame, buckets: int = 20) -> DataFrame:
    """(bucket, n) of the distances of unordered pairs, in as many buckets of equal width, from 1; equal distances alone make one bucket."""
    own = edges.where("src < dst")
    ends = own.agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    share = (F.col("w") - F.col("lo")) / F.greatest(F.lit(1), F.col("hi") - F.col("lo"))
    return own.crossJoin(F.broadcast(ends)).groupBy(F.least(F.lit(buckets), F.floor(share * buckets) + 1).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))  # one row


def asymmetry(edges: DataFrame) -> DataFrame:
    """The largest difference between the two directions of a pair, and how many pairs differ."""
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("w2"))
    return edges.where("src < dst").join(back, ["src", "dst"]).agg(F.max(F.abs(F.col("w") - F.col("w2"))).alias("max_diff"), F.count_if(F.col("w") != F.col("w2")).alias("n_differ"))


def long_runs(u: Column, v: Column, most: int = 10) -> Column:
    """Distance of two chromosomes, as steps() with the symmetric rule; where more than `most` bins are left, the sum of their differences stands for it. Approximate by its nature, and no less than the distance."""
    diff = F.aggregate(F.zip_with(u, v, lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    left = F.size(F.filter(F.arrays_zip(u.alias("a"), v.alias("b")), lambda e: (e["a"] != 0) | (e["b"] != 0)))
    exact = steps(u, v, "symmetric")
    return F.when((left > most) & (exact < PENALTY), diff).otherwise(exact)


def quick_pair_distance(pairs: DataFrame, packed: DataFrame, most: int = 10) -> DataFrame:
    """(src, dst, w) of given pairs (src, dst), by long_runs(). Approximate. Fails on null copy numbers."""
    u = packed.select(F.col("cell").alias("src"), "chrom", known(F.col("cns")).alias("u"))
    v = packed.select(F.col("cell").alias("dst"), "chrom", known(F.col("cns")).alias("v"))
    return pairs.join(u, "src").join(v, ["dst", "chrom"]).groupBy("src", "dst").agg(F.sum(long_runs(F.col("u"), F.col("v"), most)).alias("w"))


def sampled(cell: Column, every: int) -> Column:
    """Is the cell one of the sample? One in `every`, by MD5."""
    return F.pmod(F.conv(F.substring(F.md5(cell.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(every)) == 0


def approximate(packed: DataFrame, every: int, mode: str = "directed", block: int | None = None) -> DataFrame:
    """(src, dst, w): distances of a sample, one in `every` cells by hash; other cells have those of the sampled cell nearest to them by breakpoints. Approximate by its nature. Blocks of cells meet
    blocks of the sample, and give the nearest one of each block; then blocks of all cells meet, of one row each with the profiles of the sampled cells that theirs have. Fails on null copy numbers."""
    profile, cuts = profiles(packed)
    chosen = sampled(F.col("cell"), every)
    n, m = profile.agg(F.count_if(~chosen), F.count_if(chosen)).first()
    rows, columns = grown(n, block, cuts[-1]), blocks_of(m, block or BLOCK)
    dealt_to = lambda name, by: F.pmod(F.xxhash64("cell"), F.lit(by)).cast("int").alias(name)
    one = profile.where(~chosen).select("cell", "cn", dealt_to("_i", rows), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("_j"))
    two = profile.where(chosen).select("cell", "cn", dealt_to("_j", columns), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("_i"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("cell").combine_chunks()  # of equal distances the smaller name
        best, who = np.full(a.num_rows, np.inf), np.zeros(a.num_rows, np.int64)
        if a.num_rows and b.num_rows:
            x, y = (np.hstack([deltas(own[:, lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:])]) for own in (matrix(t.column("cn"), cuts[-1]) for t in (a, b)))
            for at, to, w in half_tiles(x, y):
                own = w.min(1)
                near = np.flatnonzero(own < best[at])
                best[at.start + near], who[at.start + near] = own[near], w[near].argmin(1) + to.start
        found = np.flatnonzero(best < np.inf)
        return pa.table({"cell": a.column("cell").take(pa.array(found)), "by": b.column("cell").take(pa.array(who[found])), "w": pa.array(best[found].astype(np.int64), pa.int64())})

    met_one = one.groupBy("_i", "_j").cogroup(two.groupBy("_i", "_j")).applyInArrow(run, "cell string, by string, w bigint")
    nearest = met_one.groupBy("cell").agg(F.min_by("by", F.struct("w", "by")).alias("by"))
    own = profile.where(chosen)
    stands = nearest.unionByName(own.select("cell", F.col("cell").alias("by")))
    placed = written(numbered(stands, [], ["by", "cell"], "_k"), "stands")  # cells of one sampled cell lie side by side, so that a block has few of these
    count = placed.count()
    several = grown(count, block, cuts[-1])
    size = max(1, math.ceil(count / several))
    rows = placed.select("cell", "by", F.floor((F.col("_k") - 1) / size).cast("int").alias("_b")).join(own.select(F.col("cell").alias("by"), "cn"), "by")

    def gathered(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        _, first, code = np.unique(np.array(t.column("by").combine_chunks().dictionary_encode().indices), return_index=True, return_inverse=True)
        blob = lambda x: pa.array([x], pa.binary())
        return pa.table({"_b": t.column("_b")[:1], "names": [t.column("cell").to_pylist()], "code": blob(code.astype(np.int32).tobytes()), "cn": blob(b"".join(x.as_py() for x in t.column("cn").take(pa.array(first))))})

    def met_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (both := sides(batches)):
            return
        names, code = [x["names"].values for x in both], [np.frombuffer(x["code"].as_buffer(), np.int32) for x in both]
        u, v = (np.frombuffer(x["cn"].as_buffer(), np.int16).reshape(int(k.max()) + 1, -1) for x, k in zip(both, code))
        there, back = block_distance(u, v, cuts, mode)
        same = both[0]["_b"] == both[1]["_b"]
        spans = [[slice(k, min(k + TILE, len(x))) for k in range(0, len(x), TILE)] for x in names]
        got = ((at, to, there[code[0][at][:, None], code[1][to]], back[code[0][at][:, None], code[1][to]]) for at in spans[0] for to in spans[1])
        for way, at, to, w in tiled(got, same):
            src, dst = (names[x][y.start : y.stop] for x, y in ((way, at), (not way, to)))
            yield pa.RecordBatch.from_arrays(tile_of(src, dst, w, np.eye(len(w), dtype=bool) if same and at == to else None), names=["src", "dst", "w"])

    blocks = rows.groupBy("_b").applyInArrow(gathered, "_b int, names array<string>, code binary, cn binary")
    return opened(met(blocks, several, [], met_by, TILED))
