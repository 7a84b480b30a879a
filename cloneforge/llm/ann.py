"""Approximate nearest neighbours for the largest inner product: product quantisation under the score-aware anisotropic loss.

For a vector x, reconstructed as x - r, an error along x hurts the scores that matter, those near the top, more than one across it: the loss is
|r|^2 + (eta - 1) (r . x / |x|)^2. Codes of four bits for each pair of dimensions are chosen, and codebooks fitted on a
bounded sample, under this loss.

1. Each row is encoded once; its code is stored, two subspaces a byte.
2. A query's inner products with all codewords make a table of sixteen entries of eight bits for each subspace. The tables are scanned over the codes of each block of rows.
3. Of all blocks' best rows by code the RERANKED best of each query are the shortlist.
4. The shortlist goes back to the blocks that hold the vectors, and is reranked by exact inner products.
5. An exact check follows: of a row whose code is r away from it, a query q has a score of no more than that of the code and |q| |r|. Rows that might so beat the last of a query's shortlist are scored exactly, so that codes which fit some rows badly
cost time, and no neighbours.

Equal vectors are one class. Rows are dealt to blocks by hash, so that a block holds its share of a query's shortlist; it gives that share and six standard deviations more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, written

#: Vectors that codebooks are fitted on at most; rows and queries of one task, about; bytes of its vectors, about; rows that are reranked for a query.
SAMPLE, ROWS, QUERIES, BYTES, RERANKED = 4_000, 65_536, 4_096, 64 << 20, 512
#: Rows and queries from which a block is cut into more, where there are cores for them.
ROWS_LEAST, QUERIES_LEAST = 4_096, 256
#: Codewords (four bits), dimensions of a subspace, and the share of a score from which errors count.
WORDS, WIDTH, AT = 16, 2, 0.2
EVERY, TOP = 20, 20


class Codebooks:
    """words: subspaces x WORDS x WIDTH; vectors are padded with zeros to whole subspaces."""

    def __init__(self, dim: int, words: np.ndarray, eta: float):
        self.dim, self.words, self.eta = dim, words, eta

    @staticmethod
    def padded(x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH)))

    def encode(self, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
        """A code for each subspace, each in turn chosen for the least loss given the others."""
        x = self.padded(x)
        m = x.shape[1] // WIDTH
        parts = x.reshape(len(x), m, WIDTH)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        r2 = ((parts[:, :, None, :] - self.words[None]) ** 2).sum(-1)  # n x m x WORDS
        along = np.einsum("nmd,nmd->nm", parts, unit)[:, :, None] - np.einsum("nmd,mwd->nmw", unit, self.words)
        code = r2.argmin(2)
        at = np.arange(len(x))
        total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(sweeps):
            for k in range(m):
                rest = total - along[at, k, code[:, k]]
                code[:, k] = (r2[:, k] + (self.eta - 1) * (rest[:, None] + along[:, k]) ** 2).argmin(1)
                total = rest + along[at, k, code[:, k]]
        return code

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 4, seed: int = 3) -> Codebooks:
        dim = x.shape[1]
        eta = max(1.0, (dim - 1) * AT**2 / (1 - AT**2))
        own = cls.padded(x)
        n, m = len(own), own.shape[1] // WIDTH
        parts = own.reshape(n, m, WIDTH)
        rng = np.random.default_rng(seed)
        words = np.stack([parts[rng.choice(n, WORDS, replace=n < WORDS), k] for k in range(m)])
        at = np.arange(n)
        for _ in range(8):  # Lloyd's steps to begin with
            code = ((parts[:, :, None, :] - words[None]) ** 2).sum(-1).argmin(2)
            for k in range(m):
                count = np.bincount(code[:, k], minlength=WORDS)
                for d in range(WIDTH):
                    mean = np.bincount(code[:, k], parts[:, k, d], minlength=WORDS) / np.maximum(count, 1)
                    words[k, :, d] = np.where(count > 0, mean, words[k, :, d])
        books = cls(dim, words, eta)
        unit = parts / np.maximum(np.linalg.norm(own, axis=1), 1e-300)[:, None, None]
        size = m * WORDS * WIDTH
        for _ in range(rounds):
            code = books.encode(x, 2)
            place = ((np.arange(m)[None] * WORDS + code)[:, :, None] * WIDTH + np.arange(WIDTH)).reshape(n, -1)
            books.words = _solved(place, own, unit.reshape(n, -1), books.words.ravel(), eta).reshape(m, WORDS, WIDTH)
        return books

    def decoded(self, packed: np.ndarray) -> np.ndarray:
        """The vectors that packed codes stand for."""
        code = np.stack([packed // WORDS, packed % WORDS], 2).reshape(len(packed), -1)[:, : len(self.words)]
        return self.words[np.arange(len(self.words)), code].reshape(len(code), -1)[:, : self.dim]

    def packed(self, code: np.ndarray) -> np.ndarray:
        """Two codes a byte, one row for each vector."""
        if code.shape[1] % 2:
            code = np.pad(code, ((0, 0), (0, 1)))
        return np.ascontiguousarray((code[:, ::2] * WORDS + code[:, 1::2]).astype(np.uint8))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Of each query, for each subspace, the inner products with its codewords, less their least, in steps of which 255 are the widest table's."""
        own = self.padded(q).reshape(len(q), -1, WIDTH)
        one = np.einsum("nmd,mwd->nmw", own, self.words)
        one -= one.min(2, keepdims=True)
        return np.rint(one * (255 / np.maximum(one.max((1, 2), keepdims=True), 1e-300))).astype(np.uint8)


def _solved(place: np.ndarray, x: np.ndarray, unit: np.ndarray, words: np.ndarray, eta: float, steps: int = 60) -> np.ndarray:
    """Codewords of the least loss, codes held, by conjugate gradients on its normal equations: rows have one place for each dimension, and no matrix is made."""
    size, ridge = len(words), 1e-6
    count = np.bincount(place.ravel(), minlength=size) + ridge
    back = lambda v: np.bincount(place.ravel(), (unit * v[:, None]).ravel(), minlength=size)
    apply = lambda w: count * w + (eta - 1) * back((unit * w[place]).sum(1))
    b = np.bincount(place.ravel(), x.ravel(), minlength=size) + ridge * words + (eta - 1) * back(np.linalg.norm(x, axis=1))
    w = words.copy()
    r = b - apply(w)
    z = r / count
    p, old = z, r @ z
    for _ in range(steps):
        if old <= 1e-18 * max(1.0, b @ b):
            break
        ap = apply(p)
        alpha = old / (p @ ap)
        w, r = w + alpha * p, r - alpha * ap
        z = r / count
        new = r @ z
        p, old = z + new / old * p, new
    return w


def scanned(tables: np.ndarray, codes: np.ndarray, most: int, together: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each query the places and sums of the `most` best rows by code. codes: a row for each pair of subspaces, whose tables' sums are looked up for some queries at once."""
    if tables.shape[1] % 2:
        tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
    n, kind = codes.shape[1], np.uint16 if tables.shape[1] * 255 < 1 << 16 else np.uint32
    codes = codes.astype(np.intp)
    for at in range(0, len(tables), together):
        t = tables[at : at + together].astype(kind)
        pairs = (t[:, ::2, :, None] + t[:, 1::2, None, :]).reshape(len(t), -1, WORDS * WORDS).transpose(1, 2, 0).copy()
        near = pairs[0][codes[0]]
        for k in range(1, len(codes)):
            near += np.take(pairs[k], codes[k], axis=0)
        for sums in near.T.astype(np.uint32):
            some = np.argpartition(sums, n - most)[n - most :] if n > most else np.arange(n)
            yield some, sums[some]


def chosen(sums: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` largest sums, of equal ones those of smaller ids."""
    return np.lexsort((ids, -sums.astype(np.int64)))[:most]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) of vectors that aren't null or zero and hold finite numbers alone."""
    v = F.col(embedding).cast("array<double>")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda e: e != 0))


def search(vectors: DataFrame, every: int = EVERY, top: int = TOP, vec_id: str = "vec_id", embedding: str = "embedding", reranked: int = RERANKED) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the `top` other rows of largest inner product, as found. Unusable
    vectors take no part, nor do those of another length than most have (of equally common lengths the smaller). Equal vectors
    tie, and go by vec_id; of rows of one id the least vector takes part; an empty table gives no rows."""
    spark = vectors.sparkSession
    own = usable(vectors, vec_id, embedding)
    lengths = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = lengths[0].d if lengths else 1
    own = own.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    own = written(own.withColumn("key", F.concat_ws(":", F.xxhash64("v"), F.xxhash64(F.lit(1), "v"), F.element_at("v", 1), F.element_at("v", -1))), "vectors")
    w = W.partitionBy("key").orderBy("id")
    # the smallest ids of each class, so many as a result can hold, and one more
    few = own.select("key", "id").withColumn("k", F.row_number().over(w)).where(F.col("k") <= top + 1)
    classes = few.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    reps = written(own.join(classes.select("key", F.col("ids")[0].alias("rep"), "ids"), "key").where("id = rep").select("key", "rep", "ids", "v"), "classes")
    n = reps.count()
    asked = own.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), "key")
    queries = written(reps.join(asked.select("key").distinct(), "key", "left_semi").select("key", F.col("rep").alias("q"), "v"), "queries")
    m = queries.count()
    cores = spark.sparkContext.defaultParallelism
    blocks = lambda count, most, least: max(1, math.ceil(count / most), min(cores, math.ceil(count / least)))
    row_blocks, query_blocks = blocks(n, min(ROWS, max(1, BYTES // (8 * dim))), ROWS_LEAST), blocks(m, QUERIES, QUERIES_LEAST)
    share = reranked / row_blocks
    most = min(reranked, math.ceil(share + 6 * math.sqrt(share)) + 8) if row_blocks > 1 else reranked
    sample = reps.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow()
    sample = np.array(sample.column("v").combine_chunks().flatten(), float).reshape(-1, dim)
    books = Codebooks.fit(sample) if len(sample) else None

    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every_ = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    matrix = lambda column: np.array(column.combine_chunks().flatten(), float).reshape(-1, dim)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = books.packed(books.encode(np.array(batch.column("v").flatten(), float).reshape(-1, dim)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=["rb", "id", "v", "code"])

    rows = reps.select(block("rep", row_blocks).alias("rb"), F.col("rep").alias("id"), "v")
    codes = written(rows.mapInArrow(encode, "rb int, id bigint, v array<double>, code binary"), "codes")
    asks = queries.select(block("q", query_blocks).alias("qb"), F.col("q").alias("id"), "v").withColumn("rb", every_(row_blocks))

    def scan(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and b.num_rows:
            ids = np.array(b.column("id"))
            own = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            lut, rb = books.tables(matrix(a.column("v"))), b.column("rb")[0].as_py()
            for q, (some, sums) in zip(a.column("id").to_pylist(), scanned(lut, np.ascontiguousarray(own.T), most)):
                out.append((q, rb, ids[some].tobytes(), sums.astype("<u4").tobytes()))
        q, rb, who, sums = zip(*out) if out else ([], [], [], [])
        return pa.table({"q": pa.array(q, pa.int64()), "rb": pa.array(rb, pa.int32()), "ids": pa.array(who, pa.binary()), "sums": pa.array(sums, pa.binary())})

    near = asks.groupBy("qb", "rb").cogroup(codes.select("rb", "id", "code").withColumn("qb", every_(query_blocks)).groupBy("qb", "rb")).applyInArrow(scan, "q bigint, rb int, ids binary, sums binary")

    def shortlist(t: pa.Table) -> pa.Table:
        by: dict[int, list[tuple[int, bytes, bytes]]] = {}
        for q, rb, ids, sums in zip(*(t.column(c).to_pylist() for c in ("q", "rb", "ids", "sums"))):
            by.setdefault(q, []).append((rb, ids, sums))
        out = []
        for q, got in by.items():
            ids, sums = np.frombuffer(b"".join(x[1] for x in got), np.int64), np.frombuffer(b"".join(x[2] for x in got), "<u4")
            rb = np.repeat([x[0] for x in got], [len(x[1]) // 8 for x in got])
            best = chosen(sums, ids, reranked)
            for k in np.unique(rb[best]):
                out.append((int(k), q, ids[best][rb[best] == k].tobytes()))
        rb, q, ids = zip(*out) if out else ([], [], [])
        return pa.table({"rb": pa.array(rb, pa.int32()), "q": pa.array(q, pa.int64()), "ids": pa.array(ids, pa.binary())})

    merges = max(query_blocks, math.ceil(m * row_blocks * most * 12 / BYTES))
    listed = near.groupBy(block("q", merges).alias("part")).applyInArrow(shortlist, "rb int, q bigint, ids binary")
    listed = listed.join(queries.select("q", F.col("v").alias("qv")), "q")

    def rerank(a: pa.Table, b: pa.Table) -> pa.Table:
        qs, found, scores = [], [], []
        if a.num_rows and b.num_rows:
            ids = np.array(b.column("id"))
            order = np.argsort(ids)
            ids, x = ids[order], matrix(b.column("v"))[order]
            for q, some, v in zip(a.column("q").to_pylist(), a.column("ids").to_pylist(), matrix(a.column("qv"))):
                some = np.frombuffer(some, np.int64)
                exact = (x[np.searchsorted(ids, some)] * v).sum(1)
                best = np.lexsort((some, -exact))[: top + 1]
                qs.append(np.full(len(best), q))
                found.append(some[best])
                scores.append(exact[best])
        whole = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"q": whole(qs, pa.int64()), "rep": whole(found, pa.int64()), "score": whole(scores, pa.float64())})

    def check(a: pa.Table, b: pa.Table) -> pa.Table:
        qs, found, scores = [], [], []
        if a.num_rows and b.num_rows:
            ids, x, names, asked, floor = np.array(b.column("id")), matrix(b.column("v")), np.array(a.column("id")), matrix(a.column("v")), np.array(a.column("floor"))
            near = books.decoded(np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(ids), -1))
            away, size = np.linalg.norm(x - near, axis=1), np.linalg.norm(asked, axis=1)
            floor = floor - 1e-9 * size * (np.linalg.norm(x, axis=1) + away).max()  # what rounding may amount to
            for at in range(0, len(names), 64):
                q = asked[at : at + 64]
                bound = q @ near.T
                bound += size[at : at + 64, None] * away
                look = ~(bound < floor[at : at + 64, None])
                some = np.flatnonzero(look.any(0))
                hit = look[:, some] & ~(q @ x[some].T < floor[at : at + 64, None])
                for k in np.flatnonzero(hit.any(1)):
                    who = some[hit[k]]
                    exact = (x[who] * q[k]).sum(1)
                    best = np.lexsort((ids[who], -exact))[: top + 1]
                    qs.append(np.full(len(best), names[at + k]))
                    found.append(ids[who][best])
                    scores.append(exact[best])
        whole = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"q": whole(qs, pa.int64()), "rep": whole(found, pa.int64()), "score": whole(scores, pa.float64())})

    found = listed.groupBy("rb").cogroup(rows.groupBy("rb")).applyInArrow(rerank, "q bigint, rep bigint, score double")
    w = W.partitionBy("q").orderBy(F.desc("score"), "rep")
    first = lambda df: df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top + 1).drop("k")
    found = written(first(found), "found")
    floors = found.groupBy("q").agg(F.when(F.count(F.lit(1)) > top, F.min("score")).alias("floor"))
    check_blocks = max(1, math.ceil(m / QUERIES))
    checks = queries.join(floors, "q", "left").select(block("q", check_blocks).alias("qb"), every_(row_blocks).alias("rb"), F.col("q").alias("id"), "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    met = checks.groupBy("qb", "rb").cogroup(codes.withColumn("qb", every_(check_blocks)).groupBy("qb", "rb"))
    found = first(found.unionByName(met.applyInArrow(check, "q bigint, rep bigint, score double")).dropDuplicates(["q", "rep"]))
    members = found.join(reps.select("rep", "ids"), "rep").select("q", F.explode("ids").alias("id"), "score")
    w = W.partitionBy("q").orderBy(F.desc("score"), "id")
    lists = members.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("k", "id", "score"))).alias("near"))
    keyed = lists.join(queries.select("q", "key"), "q")
    own_list = asked.join(keyed, "key").select("query_id", F.slice(F.filter("near", lambda e: e["id"] != F.col("query_id")), 1, top).alias("near"))
    out = own_list.select("query_id", F.posexplode("near").alias("pos", "e"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), F.col("e.score").alias("score"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
