"""Clustering by ball trees against brute force, and toxicity by what is planted in written texts."""

import hashlib
import math
import random

import numpy as np
import pytest
from cases import documents, empty, odd, sentence
from pyspark.sql import functions as F

from cloneforge.llm import balls, toxicity

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=16, rounds=3, dims=64, scale=64):
    """(vec_id, cluster, distance) and the final centroids, by whole numbers of Python, row by row."""
    fit = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(fit, key=name)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in fit:
            groups.setdefault(near(v), []).append(v)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else old for c, old in enumerate(centroids)]
    return sorted(((i, (c := near(v)), far(v, centroids[c])) for i, v in fit), key=lambda r: (r[0] is None, *map(lambda x: x or 0, r))), centroids


def vectors(seed, n, dims=64, spread=0.05, heads=5):
    rng = np.random.default_rng(seed)
    tops = rng.normal(0, 0.3, (heads, dims))
    x = np.float32(tops[rng.integers(0, heads, n)] + rng.normal(0, spread, (n, dims)))
    return [(k, [float(y) for y in v]) for k, v in enumerate(x)]


def found(df):
    return sorted(((r.vec_id, r.cluster, r.distance) for r in df.collect()), key=lambda r: (r[0] is None, *map(lambda x: x or 0, r)))


@pytest.mark.parametrize("seed, spread, block", [(1, 0.05, 4096), (2, 0.4, 4096), (3, 0.0, 64), (4, 0.01, 50)])
def test_clusters_are_those_of_brute_force(spark, seed, spread, block):
    rows = vectors(seed, 400, spread=spread)
    rows += [(1000 + k, rows[k % 7][1]) for k in range(60)]  # copies
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(3)
    got, centroids = balls.clustered(df, block=block)
    want, ends = brute(rows)
    assert found(got) == want and centroids.tolist() == ends


def test_trees_hold_what_their_balls_say():
    x = np.round(np.random.default_rng(5).normal(0, 20, (700, 8))).astype(np.int64)
    x[300:500] = x[0]
    tree, order = balls.grown(x)
    assert sorted(order) == list(range(700)) and (tree.vectors == x[order]).all()
    for (a, b, left, right), total, radius in zip(tree.balls, tree.sums, tree.radii):
        own = tree.vectors[a:b]
        assert (own.sum(0) == total).all() and np.sqrt(((own - total // (b - a)) ** 2).sum(1)).max() <= radius + 1e-9
        if left:
            assert tree.balls[left][0] == a and tree.balls[left][1] == tree.balls[right][0] and tree.balls[right][1] == b
        else:
            assert b - a <= balls.LEAF or (own == own[0]).all()


def test_whole_balls_are_assigned_at_once():
    x = np.vstack([np.random.default_rng(k).integers(0, 4, (500, 6)) + 1000 * k for k in range(3)]).astype(np.int64)
    tree, _ = balls.grown(x)
    centroids = np.array([[0] * 6, [1000] * 6, [2000] * 6])
    kinds = [whole for _, _, whole in balls.filtered(tree, centroids)]
    assert all(kinds)
    assert (balls.assigned(tree, centroids) == tree.vectors[:, 0] // 900).all()


def test_odd_vectors_and_columns(spark):
    good = vectors(6, 20)
    bad = [(100, None), (101, []), (102, good[0][1][:63]), (103, [None, *good[0][1][1:]]), (104, [float("nan"), *good[0][1][1:]]), (105, [float("-inf"), *good[0][1][1:]]), (106, good[0][1] + [0.0])]
    rows = good + bad + [(3, good[3][1]), (3, good[4][1]), (None, good[5][1]), (None, good[5][1]), (200, [0.0] * 64), (201, [-1e-9] * 64)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    for c in ("cluster", "distance", "v", "c", "n", "s", "ids", "inertia"):
        df = df.withColumn(c, F.lit("x"))
    got, centroids = balls.clustered(df)
    want, ends = brute(rows)
    assert found(got) == want and centroids.tolist() == ends
    told = balls.reported(got, centroids).collect()
    assert {r.inertia for r in told} == {sum(w[2] for w in want)}
    assert all(r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster) for r in told)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, ends[r.cluster])).encode()).hexdigest() for r in told)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(7, 3) + [(9, vectors(7, 1)[0][1])]
    got, centroids = balls.clustered(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS))
    assert found(got) == brute(rows)[0] and len(centroids) == 4
    none = balls.reported(*balls.clustered(spark.createDataFrame([], VECTORS)))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_that_do_not_fit_are_an_error(spark):
    df = spark.createDataFrame([(1, [3e7] + [0.0] * 63, 0)], VECTORS)
    with pytest.raises(Exception, match="would not fit"):
        balls.clustered(df)


def test_large_components_are_exact(spark):
    rows = [(k, [float(np.float32(1.9e6 * math.sin(k * 7 + j)))for j in range(64)]) for k in range(40)]
    got, _ = balls.clustered(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS))
    assert found(got) == brute(rows)[0]


# --- toxicity

INSULTS = ["grubvex", "snarlok", "blatweed"]


def labelled(spark, n=400, seed=3):
    rng = random.Random(seed)
    texts, toxic = [], []
    for k in range(n):
        own = [sentence(rng, rng.randrange(4, 15)) + "." for _ in range(rng.randrange(1, 12))]
        toxic.append(int(rng.random() < 0.3))
        if toxic[-1]:
            at = rng.randrange(len(own))
            own[at] = own[at][:-1] + f" {rng.choice(INSULTS)}{rng.choice(['', 'ed', 'ish'])}."
        texts.append(" ".join(own))
    docs = documents(spark, texts)
    return docs, spark.createDataFrame([(k, 1, t) for k, t in enumerate(toxic)], "doc_id bigint, quality int, toxic int"), texts, toxic


def test_held_out_documents_and_the_sentences_at_fault(spark):
    docs, labels, texts, toxic = labelled(spark)
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).withColumn("held", toxicity.held_out()).collect()}
    held = [k for k in range(len(texts)) if got[k].held]
    assert len(held) > 40
    right = sum((got[k].score >= 0.5) == toxic[k] for k in held) / len(held)
    assert right > 0.97
    told = toxicity.offending(docs, labels).collect()
    for r in told:
        assert texts[r.doc_id][r.start : r.start + r.length] == r.sentence
    at_fault = [r for r in told if any(x in r.sentence for x in INSULTS)]
    assert len(at_fault) / len(told) > 0.97 and len({r.doc_id for r in at_fault}) > 0.97 * sum(toxic)


def test_scores_are_noisy_or_of_sentences(spark):
    docs, labels, texts, _ = labelled(spark, 200, 4)
    model = toxicity.learned(docs, labels)
    for text in texts[:50]:
        ps = [model.of_sentence(set(words)) for _, _, words in toxicity.pieces(text)]
        assert model.of_text(text) == pytest.approx(1 - math.prod(1 - p for p in ps), abs=1e-9)


def test_labels_that_may_not_be_used_change_nothing(spark):
    docs, labels, _, _ = labelled(spark, 200, 5)
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs2 = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("zz"))
    a = {r.doc_id: r.score for r in toxicity.scored(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.scored(docs2, other).collect()}


def test_the_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    n_docs, n_sentences, n_stems = 12, 40, 9
    doc = np.sort(rng.integers(0, n_docs, n_sentences))
    row = np.repeat(np.arange(n_sentences), 3)
    bags = (row, rng.integers(0, n_stems, len(row)), np.ones(len(row)), doc, rng.integers(1, 3, n_sentences).astype(float))
    y, w = rng.integers(0, 2, n_docs), rng.normal(0, 1, n_stems + 1)
    y[np.setdiff1d(np.arange(n_docs), doc)] = 0
    # the loss by its definition: documents' noisy-or, sentence by sentence
    z = np.array([sum(w[c] for r, c in zip(row, bags[1]) if r == s) for s in range(n_sentences)]) + w[-1]
    p = 1 / (1 + np.exp(-z))
    whole = [1 - math.prod((1 - p[s]) ** bags[4][s] for s in range(n_sentences) if doc[s] == d) for d in range(n_docs)]
    loss = -np.mean([math.log(q) if t else math.log(1 - q) for q, t in zip(whole, y)]) + toxicity.RIDGE / 2 * (w[:-1] ** 2).sum()
    got, grad = toxicity.losses(w, bags, y)
    assert got == pytest.approx(loss)
    for k in range(len(w)):
        step = np.zeros_like(w)
        step[k] = 1e-6
        assert grad[k] == pytest.approx((toxicity.losses(w + step, bags, y)[0] - toxicity.losses(w - step, bags, y)[0]) / 2e-6, abs=1e-6)


def test_odd_documents_and_labels(spark):
    docs, labels, _, toxic = labelled(spark, 100, 6)
    more = odd(spark)
    mixed = docs.withColumn("doc_id", F.col("doc_id") + 100).unionByName(more, allowMissingColumns=True)
    ids = labels.withColumn("doc_id", F.col("doc_id") + 100)
    ids = ids.unionByName(spark.createDataFrame([(None, 1, 1), (100, 1, None), (101, 1, 7), (3, 0, 1), (3, 0, 0), (9999, 1, 1)], ids.schema))
    got = toxicity.scored(mixed, ids)
    assert got.columns == mixed.drop("score").columns + ["score"] and got.count() == mixed.count()
    scores = {r.doc_id: r.score for r in got.collect()}
    assert scores[0] == scores[1] == scores[5] == 0.0 and all(0 <= s <= 1 for s in scores.values())
    assert len({r.score for r in got.where("doc_id = 3").collect()}) == 1
    assert toxicity.scored(empty(spark), ids).collect() == [] and toxicity.offending(empty(spark), ids).collect() == []
    one = toxicity.scored(docs, labels.where("toxic = 0"))
    assert {r.score for r in one.collect()} == {0.0}
    assert {r.score for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.0}


def test_sentences_without_an_end_are_cut():
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(100)]
    cut = toxicity.sentences(" ".join(words))
    assert [len(s) for s in cut] == [40, 40, 20]
    assert [set(w) for _, _, w in toxicity.pieces(" ".join(words))] == cut
    assert toxicity.sentences("a b. c d! e\nf ... 12 %") == [{"a", "b"}, {"c", "d"}, {"e"}, {"f"}]
    assert toxicity.sentences("") == [] and toxicity.sentences(" .!? \n 7") == []
