"""Centroid clustering by ball trees. Vectors are dealt to blocks as they are read; each block keeps a metric tree, whose balls know their middle, radius, count and whole-number sum. A round
takes the trees as they are: by the triangle inequality a centroid that is farther from a ball's middle than the nearest one by more than the ball's width is out for all its members. A ball with one
centroid left goes to it whole, by its count and sum; others are opened, down to leaves, whose vectors are compared one by one. All numbers are whole, so that results are exact and the same
however rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, using, written

#: Components of a vector, what they are multiplied by before they are cut to whole numbers, centroids, and rounds.
DIMS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
#: Vectors of a block, which is one row of the table of trees, and of a leaf.
BLOCK, LEAF = 4096, 24
#: Squared distances must fit 64 bits.
MOST = 1 << 27
#: Of middles and radii, as parts of the distance: what rounding may make of them is far less.
SLACK = 1e-9

TREES = "ids array<bigint>, known array<boolean>, vectors binary, balls binary, sums binary, radii binary"


@dataclass
class Tree:
    """vectors: rows in order of the leaves. balls: begin, end, left, right of each (left 0: a leaf); the first one holds all. middles: whole numbers."""

    vectors: np.ndarray
    balls: np.ndarray
    sums: np.ndarray
    radii: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return self.balls[:, 1] - self.balls[:, 0]

    @property
    def middles(self) -> np.ndarray:
        return self.sums // self.counts[:, None]


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y, exactly: by floating point where no sum can pass 2^53."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    kind = np.float64 if 4 * top * top * max(1, x.shape[1]) < 1 << 53 else np.int64
    a, b = x.astype(kind), y.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)


def grown(x: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of rows x, and their order in it. A ball is parted between the member farthest from its middle and the one farthest from that; one whose members are all equal is a leaf."""
    order = np.arange(len(x))
    balls, sums, radii = [], [], []
    todo = [(0, len(x), -1, 0)]
    while todo:
        lo, hi, above, side = todo.pop()
        own = order[lo:hi]
        v = x[own]
        total = v.sum(0)
        far = squares(v, (total // len(own))[None])[:, 0]
        at = len(balls)
        balls.append([lo, hi, 0, 0])
        sums.append(total)
        radii.append(float(np.sqrt(far.max())))
        if above >= 0:
            balls[above][2 + side] = at
        if hi - lo <= LEAF:
            continue
        one = squares(v, v[far.argmax()][None])[:, 0]
        if not one.max():
            continue
        two = squares(v, v[one.argmax()][None])[:, 0]
        near = np.argsort(one - two, kind="stable")
        cut = min(max(int((one < two).sum()), 1), hi - lo - 1)
        order[lo:hi] = own[near]
        todo += [(lo, lo + cut, at, 0), (lo + cut, hi, at, 1)]
    return Tree(x[order], np.array(balls, np.int64), np.array(sums, np.int64), np.array(radii)), order


def filtered(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows or balls, their centroids, are they balls): whole balls first, then vectors of leaves. Levels of the tree are worked out side by side."""
    middles, live = tree.middles, np.ones((1, len(centroids)), bool)
    level = np.zeros(1, np.int64)
    while len(level):
        far = np.where(live, np.sqrt(squares(middles[level], centroids).astype(float)), np.inf)
        least = far.min(1)
        # members lie within the radius, so that a centroid nearer to one of them than the ball's own is no farther than this
        live = live & (far <= (least + 2 * tree.radii[level])[:, None] * (1 + SLACK) + SLACK)
        sure = live.sum(1) == 1
        if sure.any():
            yield level[sure], live[sure].argmax(1), True
        leaf = ~sure & (tree.balls[level, 2] == 0)
        if leaf.any():
            sizes = tree.counts[level[leaf]]
            rows = np.concatenate([np.arange(a, b) for a, b in tree.balls[level[leaf], :2]])
            left = np.repeat(live[leaf], sizes, axis=0)
            d = np.where(left, squares(tree.vectors[rows], centroids), np.iinfo(np.int64).max)
            yield rows, d.argmin(1), False
        open_ = ~sure & ~leaf
        level, live = tree.balls[level[open_], 2:].ravel(), np.repeat(live[open_], 2, axis=0)


def gathered(tree: Tree, centroids: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
    """Adds the tree's vectors to counts and sums of their centroids."""
    for at, to, whole in filtered(tree, centroids):
        np.add.at(counts, to, tree.counts[at] if whole else 1)
        np.add.at(sums, to, tree.sums[at] if whole else tree.vectors[at])


def assigned(tree: Tree, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(tree.vectors), np.int64)
    for at, to, whole in filtered(tree, centroids):
        if not whole:
            out[at] = to
            continue
        for (a, b), c in zip(tree.balls[at, :2], to):
            out[a:b] = c
    return out


def whole_numbers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of `dims` components, none of them null or not finite, as whole numbers floor(scale * x)."""
    x = F.col("embedding")
    odd = lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf"))
    fit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(x.isNotNull() & (F.size(x) == dims) & ~F.coalesce(F.exists(x, odd), F.lit(False)))
    inside = F.forall("v", lambda e: (e > -MOST) & (e < MOST))
    own = fit.select("vec_id", F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))
    return own.withColumn("v", F.when(inside, F.col("v")).otherwise(F.raise_error(F.lit(f"components beyond {MOST}: squared distances would not fit 64 bits"))))


def trees(whole: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each block of vectors (vec_id, v), with its tree. Nothing is shuffled."""

    def row(ids: list[pa.Array], flat: list[np.ndarray], dims: int) -> pa.RecordBatch:
        names, x = pa.concat_arrays(ids), np.concatenate(flat).reshape(-1, dims)
        tree, order = grown(x)
        names = names.take(pa.array(order))
        blob = lambda a: pa.array([a.tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([names.fill_null(0).to_pylist()], pa.list_(pa.int64())), pa.array([names.is_valid().to_pylist()], pa.list_(pa.bool_())), blob(tree.vectors.astype(np.int32)), blob(tree.balls), blob(tree.sums), blob(tree.radii)],
            names=["ids", "known", "vectors", "balls", "sums", "radii"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("balls")
        ids, flat, n, dims = [], [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                piece = batch.slice(at, block)
                own = np.asarray(piece.column(1).flatten())
                dims = len(own) // piece.num_rows
                if n and n + piece.num_rows > block:
                    yield row(ids, flat, dims)
                    ids, flat, n = [], [], 0
                ids.append(piece.column(0))
                flat.append(own)
                n += piece.num_rows
        if n:
            yield row(ids, flat, dims)

    return whole.mapInArrow(run, TREES)


def _trees_of(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, pa.Array, Tree]]:
    for k in range(batch.num_rows):
        raw = [batch.column(c)[k].as_buffer() for c in range(2, 6)]
        vectors = np.frombuffer(raw[0], np.int32).reshape(-1, dims).astype(np.int64)
        yield batch.column(0)[k].values, batch.column(1)[k].values, Tree(vectors, np.frombuffer(raw[1], np.int64).reshape(-1, 4), np.frombuffer(raw[2], np.int64).reshape(-1, dims), np.frombuffer(raw[3], np.float64))


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of what is nearest to each; one with nothing stays. A task gives one row of counts and sums for each centroid, and the driver gets one."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("balls")
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, _, tree in _trees_of(batch, dims):
                gathered(tree, centroids, counts, sums)
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["c", "n", "s"])

    got = blocks.mapInArrow(run, "c bigint, n bigint, s array<bigint>").groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dims)])
    out = centroids.copy()
    for r in got.collect():  # a row for each centroid
        out[r.c] = [r[f"s{i}"] // r.n for i in range(dims)]
    return out


def first_centroids(whole: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """Of the vectors the k whose name's SHA-256 is least; of equal names the least vector, and those without a name last."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in whole.orderBy(name.asc_nulls_last(), "v").limit(k).select("v").collect()], np.int64)


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each vector (vec_id, embedding) after so many rounds, and the final centroids, of which there are fewer than k where there are fewer vectors. Rows of null
    embeddings, of other lengths, or with null or non-finite components take no part; a null vec_id stays null; rows that come again count and come out again; an empty table gives no rows and no
    centroids; other columns don't matter. Components of 2^27 or more, after scaling, are an error, as distances would pass 64 bits. Of equally near centroids the smaller number wins."""
    whole = whole_numbers(vectors, dims, scale)
    centroids = first_centroids(whole, k)
    if not len(centroids):
        return whole.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    blocks = written(trees(whole, block), "balls")
    for _ in range(rounds):
        centroids = moved(blocks, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("balls")
        for batch in batches:
            for ids, known, tree in _trees_of(batch, dims):
                to = assigned(tree, centroids)
                far = ((tree.vectors - centroids[to]) ** 2).sum(1)
                names = pa.array(np.asarray(ids), pa.int64(), mask=~np.asarray(known, bool))
                yield pa.RecordBatch.from_arrays([names, pa.array(to, pa.int32()), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return written(blocks.mapInArrow(run, "vec_id bigint, cluster int, distance bigint"), "assigned"), centroids


def reported(out: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows of clustered() with the sums of their cluster and of all, and the SHA-256 of their centroid."""
    own = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    facts = [(c, own.get(c, 0), sum(own.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    of = out.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each centroid


def op11_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reported(*clustered(table(spark, sf_dir, "embeddings")))
