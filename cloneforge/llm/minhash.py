"""MinHash near-dedup by bottom-k sketches from one hash function.

A sketch is the k least hashes of a document's shingle set. Inverted lists are kept for runs of `RUN` neighbouring retained
values: where two sets are alike to at least 0.8, their sorted union holds such a run that both retain. For sets of up to
k values that is certain (u values of which at most u/5 are in one set only fall into at most u/5 + 1 stretches of common
values, one of which is of 4 or more if u > 15; below, runs of two serve). Beyond k, each value of the union's sketch is common with
probability 0.8 or more, and that no four of 64 in a row are has a probability of 1.0e-6 where it is 0.8, and less above.
Frequent shingles thus make no long lists: documents meet only where four values in a row agree.

Equal sets are one class and enter once. In each list all are paired with the smallest id alone; pairs pass a size filter and the
estimate from the union's sketch, and are verified on the full sets. What stands in one list but is then still in different
components gets inverted lists of another kind: of the rarest shingles of the full sets, so many that sets that are alike share one. Pages of
one template that are not alike meet in none of these, as their rarest shingles are their own. Short lists give pairs, which are filtered, estimated
and verified as before; what long ones connect is compared in blocks, on the full sets, so that no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import guarded, table, using, written
from .graphs import components

K, RUN, SHORT_RUN = 64, 4, 2
#: Sets of up to so many values also get lists of runs of two; of at least so many, lists of runs of four.
SHORT_MOST, LONG_LEAST = 19, 13
#: Documents of a cluster in one block, about, and columns of a matrix that compares two blocks.
BLOCK, COLUMNS = 512, 8192
#: Documents of a list of rare shingles up to which its pairs are tried, and counters of shingles, as a power of two.
TRIED, COUNTERS = 32, 18
#: Ids that are broadcast at most, to read fewer texts.
IDS_MOST = 500_000
#: Pairs are dropped where the estimate is so many standard deviations below the threshold.
SIGMAS = 5.0


def features(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """doc_id, n (size of the shingle set), key (equal for equal sets), sketch (the k least hashes, in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("shingles")
        for batch in batches:
            n, keys, sketches = [], [], []
            for raw in batch.column(1):
                own = shingles.shingle_set(raw.as_py() or b"", width)
                n.append(len(own))
                keys.append(xxhash.xxh128_hexdigest(own.tobytes()))
                sketches.append((own[:k] >> np.uint64(1)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "n", "key", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("b")).mapInArrow(run, "doc_id bigint, n bigint, key string, sketch array<bigint>")


def lists(reps: DataFrame) -> DataFrame:
    """(list, doc): the inverted lists of runs of retained values."""
    at = lambda r: F.transform(F.sequence(F.lit(1), F.size("sketch") - (r - 1)), lambda i: F.xxhash64(F.lit(r), *[F.element_at("sketch", (i + j).cast("int")) for j in range(r)]))
    empty = F.array().cast("array<bigint>")
    runs = F.concat(F.when(F.col("n") >= LONG_LEAST, at(RUN)).otherwise(empty), F.when((F.col("n") <= SHORT_MOST) & (F.col("n") >= 4), at(SHORT_RUN)).otherwise(empty))
    return reps.where("n >= 4").select(F.explode(runs).alias("list"), F.col("doc_id").alias("doc"))


def estimated(pairs: DataFrame, reps: DataFrame, threshold: float, k: int) -> DataFrame:
    """Of pairs (a, b), those that sizes and the union's sketch allow to be alike."""
    one = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, F.least(F.lit(k), F.greatest(F.size("sa"), F.size("sb"))))
    share = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union)) / F.size(union)
    slack = SIGMAS * math.sqrt(threshold * (1 - threshold) / k)
    return both.where((F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & (share >= threshold - slack)).select("a", "b")


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and t, the text's bytes, of the documents in ids; where these are few, others don't leave the scan."""
    ids = ids.distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    few = ids.limit(IDS_MOST + 1).count() <= IDS_MOST
    return text.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those of which the full sets have 100 * intersection >= percent * union."""
    text = of_ids(docs, pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))))
    one = lambda x: text.select(F.col("doc_id").alias(x), F.col("t").alias(f"t{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("shingles")
        last, own = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb")):
                if a != last:
                    last, own = a, shingles.shingle_set(ta.as_py(), width)
                other = shingles.shingle_set(tb.as_py(), width)
                both = shingles.common(own, other)
                keep.append(100 * both >= percent * (len(own) + len(other) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def linked(sets: list[np.ndarray], label: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (x of a, y of b) of sets that are alike, one pair for each two labels: sizes of intersections are products of 0-1 matrices over
    the values that more than one set holds."""
    size = np.array([len(x) for x in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(sets)), size)
    more = count[inverse] > 1
    row, column = row[more], column[inverse[more]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inter = np.zeros((len(a), len(b)), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [begin, begin + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - begin)), np.float32)
        m[row[lo:hi], column[lo:hi] - begin] = 1
        inter += m[a] @ m[b].T
    inter = inter.astype(np.int64)
    union = size[a][:, None] + size[b][None] - inter
    x, y = np.nonzero((100 * inter >= percent * union) & (label[a][:, None] != label[b][None]))
    x, y = a[x], b[y]
    lo, hi = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
    _, first = np.unique(np.stack([lo, hi]), axis=1, return_index=True)
    return x[first], y[first]


def leftover(entries: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between what is in different components so far but stands in one list. Documents that such lists connect are a cluster; it is
    cut by size, as only neighbouring sizes can be alike, and by hash into blocks, and each block meets each that it may be alike to once,
    on the full sets. What comes out is one link for each two components that a pair of blocks joins."""
    labelled = entries.join(found, entries.doc == found.node, "left").select("list", "doc", F.coalesce("component", "doc").alias("c"))
    mixed = labelled.groupBy("list").agg(F.min("doc").alias("a"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("list", "a")
    clusters = components(labelled.join(mixed, "list").where("doc <> a").select("a", F.col("doc").alias("b")))
    step = math.log(100 / percent)
    own = clusters.join(reps.select(F.col("doc_id").alias("node"), "n"), "node").join(found.withColumnRenamed("component", "c"), "node", "left")
    own = written(own.select(F.col("component").alias("cluster"), F.col("node").alias("doc"), F.coalesce("c", "node").alias("c"), F.floor(F.log(F.col("n").cast("double")) / step).cast("int").alias("u")), "clusters")
    sizes = own.groupBy("cluster", "u").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    at = lambda name, by: sizes.select("cluster", (F.col("u") + by).alias("u"), F.col("blocks").alias(name))
    own = own.join(at("own", 0), ["cluster", "u"]).join(at("above", -1), ["cluster", "u"], "left").join(at("below", 1), ["cluster", "u"], "left")
    own = own.withColumn("s", F.pmod(F.xxhash64("doc"), F.col("own")).cast("int"))
    upto = lambda k: F.when(F.coalesce(k, F.lit(0)) > 0, F.sequence(F.lit(0), F.coalesce(k, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda u1, s1, u2, s2: F.struct(u1.alias("u1"), s1.alias("s1"), u2.alias("u2"), s2.alias("s2"))
    u, s = F.col("u"), F.col("s")
    meets = F.concat(
        F.transform(upto(F.col("own")), lambda o: pair(u, F.least(s, o), u, F.greatest(s, o))),
        F.transform(upto(F.col("above")), lambda o: pair(u, s, u + 1, o)),
        F.transform(upto(F.col("below")), lambda o: pair(u - 1, o, u, s)),
    )
    texts = of_ids(docs, own.select(F.col("doc").alias("doc_id")))
    dealt = own.join(texts, own.doc == texts.doc_id).select("cluster", F.explode(meets).alias("m"), "u", "s", "doc", "c", "t").select("cluster", "m.*", "u", "s", "doc", "c", "t")

    def compare(t: pa.Table) -> pa.Table:
        using("shingles")
        one = {x: t.column(x)[0].as_py() for x in ("u1", "s1", "u2", "s2")}
        doc, c, u, s = (np.array(t.column(x)) for x in ("doc", "c", "u", "s"))
        a, b = np.flatnonzero((u == one["u1"]) & (s == one["s1"])), np.flatnonzero((u == one["u2"]) & (s == one["s2"]))
        x = y = np.zeros(0, np.int64)
        if len(a) and len(b) and c.min() != c.max():
            sets = [shingles.shingle_set(raw.as_py(), width) for raw in t.column("t")]
            x, y = linked(sets, c, a, b, percent)
        return pa.table({"a": pa.array(np.minimum(doc[x], doc[y]), pa.int64()), "b": pa.array(np.maximum(doc[x], doc[y]), pa.int64())})

    return dealt.groupBy("cluster", "u1", "s1", "u2", "s2").applyInArrow(compare, "a bigint, b bigint")


def rarest(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc, n, tokens) of texts (doc_id, t): the rarest shingles of each set, n - ceil(percent n) + 1 of them, by counts over all these texts, and by hash. Counts are of hashes' first bits; any order
    would do that is the same for all sets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("shingles")
        total = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                np.add.at(total, (shingles.shingle_set(raw.as_py(), width) >> np.uint64(64 - COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    got = texts.select("t").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # 1 << COUNTERS rows at most
    counts = np.zeros(1 << COUNTERS, np.int64)
    counts[np.array(got.column("at"), np.int64)] = np.array(got.column("n"), np.int64)
    magnitude = np.minimum(255, np.ceil(8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)
    magnitude = texts.sparkSession.sparkContext.broadcast(magnitude)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("shingles")
        by = magnitude.value
        for batch in batches:
            n, tokens = [], []
            for raw in batch.column(1):
                own = shingles.shingle_set(raw.as_py(), width)
                order = np.argsort(by[(own >> np.uint64(64 - COUNTERS)).astype(np.int64)], kind="stable")  # sets are in order of hashes
                n.append(len(own))
                tokens.append(own[order[: len(own) - (percent * len(own) + 99) // 100 + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["doc", "n", "tokens"])

    return texts.select("doc_id", "t").mapInArrow(run, "doc bigint, n bigint, tokens array<bigint>")


def remaining(entries: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """Links (a, b) between what stands in one list but is in different components so far: by lists of rare shingles of the documents of such lists."""
    labelled = entries.join(found, entries.doc == found.node, "left").select("list", "doc", F.coalesce("component", "doc").alias("c"))
    mixed = labelled.groupBy("list").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("list")
    own = written(labelled.join(mixed, "list").select("doc", "c").distinct(), "left")
    if not own.limit(1).count():
        return own.select(F.col("doc").alias("a"), F.col("c").alias("b"))
    texts = written(of_ids(docs, own.select(F.col("doc").alias("doc_id"))).dropDuplicates(["doc_id"]), "texts")
    rare = written(rarest(texts, width, percent).join(own, "doc"), "rare")
    long = rare.select("doc", "c", "n", F.posexplode("tokens").alias("pos", "list"))
    lists_ = long.groupBy("list").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("list", "m")
    met = written(long.join(lists_, "list"), "met")
    few = met.where(F.col("m") <= TRIED)
    one = lambda x: few.select("list", F.col("doc").alias(x), F.col("c").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"))
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need)
    pairs = one("a").join(one("b"), "list").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits).select("a", "b").distinct()
    links = verified(written(estimated(pairs, reps, percent / 100, k), "pairs"), texts.withColumnRenamed("t", "text"), width, percent)
    large = written(met.where(F.col("m") > TRIED).select("list", "doc"), "large")
    if large.limit(1).count():
        links = links.unionByName(leftover(large, found, reps, texts.withColumnRenamed("t", "text"), width, percent))
    return links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included),
    kept (is it the smallest?). Documents without words, null texts included, are linked with nothing. Repeated rows get equal
    answers; a null doc_id takes no part: its component is null and it is kept; an empty table gives no rows."""
    threshold = percent / 100
    feats = written(features(docs, width, k), "sketches")
    named = feats.where("n > 0 and doc_id is not null")
    classes = written(named.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    reps = written(named.join(classes.select(F.col("rep").alias("doc_id"), F.col("key").alias("_k")), "doc_id").where("key = _k").drop("_k", "key").dropDuplicates(["doc_id"]), "reps")
    entries = lists(reps)
    counted = entries.groupBy("list").agg(F.count(F.lit(1)).alias("m"), F.min("doc").alias("a"), F.max("doc").alias("z")).where("m > 1")
    counted = written(counted, "lists")
    more = written(entries.join(counted.where("m > 2").select("list", "a"), "list"), "members")
    stars = counted.where("m = 2").select("a", F.col("z").alias("b")).unionByName(more.where("doc <> a").select("a", F.col("doc").alias("b"))).where("a <> b").distinct()
    links = written(verified(written(estimated(stars, reps, threshold, k), "pairs"), docs, width, percent), "links")
    found = components(links)
    rest = written(remaining(more.select("list", "doc"), found, reps, docs, width, percent, k), "leftover")
    if rest.limit(1).count():
        found = components(links.unionByName(rest))
    to = classes.join(found, classes.rep == found.node, "left").select("key", F.coalesce("component", "rep").alias("component"))
    out = feats.select("doc_id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(to, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs, one document of each component left; repeated rows of it stay."""
    gone = near_duplicates(docs.select("doc_id", "text"), width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return guarded(docs, ["doc_id"], lambda d: d.join(gone, d.doc_id == gone._gone, "left_anti"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)
