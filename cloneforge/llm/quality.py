"""Quality classifier: a Bradley-Terry model. Of a pair of documents, one labelled good and one bad, the good one is preferred with
probability sigmoid(w . (x_good - x_bad)); w is learned by the logistic loss on these differences of features. A document's
strength w . x is turned into a score that is 0.7 at a quantile of the strengths of all documents: the share that is asked for, or else the one at which
the sample has the fewest labelling mistakes.

Labels are learned from a bounded sample: of all labelled rows that may be used, the SAMPLE ones of least hash. Features
are of the text alone and of all of it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import guarded, parts, table, using, written

#: Labelled rows that the model is fitted on at most, and pairs drawn from them.
SAMPLE, PAIRS = 20_000, 60_000
#: Score from which a document counts as good.
GOOD = 0.7
#: Steps between the sample's least and greatest strengths, at which quantiles are counted.
BINS = 4_000
RIDGE = 1e-3

_kinds = np.zeros(256, np.int64)  # of bytes: 0 rest
for _k, _span in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\r\n", b".", b",", b"!?", b"|", b"<>{}[]()=/\\", b"#@$%&*_+~^", b"-:;'\""), 1):
    _kinds[list(_span)] = _k
_kinds[128:] = 13
N_KINDS = 14
NAMES = [*(f"bytes_{k}" for k in range(N_KINDS)), "log_words", "log_lines", "word_length", "long_words", "short_words", "types", "top_word", "repeat_pairs", "repeat_lines", "line_words", "upper_words", "capital_words", "stops", "lone_marks", "runs", "new_words", "tail_words"]


def features(text: str) -> list[float]:
    """Numbers NAMES of a text; an empty text has zeros throughout."""
    raw = text.encode()
    if not raw or not (words := text.split()):
        return [0.0] * len(NAMES)
    by_kind = np.bincount(_kinds, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=N_KINDS)
    n = len(words)
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, words[1:])))
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    capital = sum(c for w, c in counts.items() if w[0].isupper())
    ends = sum(c for w, c in counts.items() if w[-1] in ".!?")
    lone = sum(c for w, c in counts.items() if not w[0].isalnum() and len(w) == 1)
    same = sum(1 for a, b in zip(words, words[1:]) if a == b)
    # how much of the second half is new
    half = n // 2
    first = set(words[:half])
    new = sum(1 for w in words[half:] if w not in first) / max(1, n - half)
    return [
        *(by_kind / len(raw)), math.log1p(n), math.log1p(len(lines)), float(sizes.mean()), float((sizes > 14).mean()), float((sizes <= 3).mean()), len(counts) / n, max(counts.values()) / n,
        1 - pairs / max(1, n - 1) if n > 1 else 0.0, 1 - len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))), upper / n, capital / n, ends / n, lone / n, same / n, new, float(sizes[-1] > 14),
    ]


def expanded(x: np.ndarray) -> np.ndarray:
    """Standardised features, clipped, and how far each lies beyond one deviation on either side."""
    x = np.clip(x, -6, 6)
    return np.hstack([x, np.maximum(x - 1, 0), np.maximum(-x - 1, 0)])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        # row by row, so that a text's strength doesn't depend on its neighbours, as by BLAS
        return (np.ascontiguousarray(expanded((x - self.mean) / self.scale)) * self.weights).sum(axis=1)

    def score(self, strength: F.Column) -> F.Column:
        z = self.slope * (strength - self.cut) + math.log(GOOD / (1 - GOOD))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def drawn(y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, a good and a bad one."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    n = min(PAIRS, len(good) * len(bad))
    return good[rng.integers(0, len(good), n)], bad[rng.permutation(np.resize(np.arange(len(bad)), n))]


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model | None:
    """The model, cut in the middle between the medians of the classes until `at_quantile`. None where a class has no example."""
    if not (y == 1).any() or not (y == 0).any():
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = expanded((x - mean) / scale)
    better, worse = drawn(y, seed)
    d = z[better] - z[worse]
    n, w = len(d), np.zeros(z.shape[1])
    for _ in range(25):  # Newton steps on mean(log(1 + exp(-d w))) + ridge
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = -(d.T @ p) / n + RIDGE * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    cut = float((np.median(s[y == 1]) + np.median(s[y == 0])) / 2)
    return Model(mean, scale, w, cut, 3.0 / (np.median(np.abs(s - cut)) + 1e-9))


def at_quantile(model: Model, strong: DataFrame, x: np.ndarray, y: np.ndarray, share: float | None = None) -> Model:
    """model, cut at a quantile of the column `strength` over all rows of strong: the one above which the share `share` of rows lies, about; or else that of the fewest mistakes in the sample (x, y), of equally good ones
    the middle one. Quantiles are told by counts in BINS steps, so that no more than that comes to the driver and equal rows give equal cuts, however they are dealt."""
    s = model.strengths(x)
    low, width = float(s.min()), max(float(s.max() - s.min()) / BINS, 1e-9)
    steps = F.greatest(F.lit(-1.0), F.least(F.lit(float(BINS)), F.floor((F.col("strength") - low) / width))).cast("int")
    counts = np.zeros(BINS + 2, np.int64)
    for r in strong.groupBy(steps.alias("step")).count().collect():
        counts[r["step"] + 1] = r["count"]
    below = np.cumsum(counts)  # rows below the edge of each step, from the first one to that above the last
    if not below[-1]:
        return model
    edges = low + width * np.arange(BINS + 2)
    if share is not None:
        quantile = (1 - share) * below[-1]
    else:
        good, bad = np.sort(s[y == 1]), np.sort(s[y == 0])
        wrong = np.searchsorted(good, edges) + len(bad) - np.searchsorted(bad, edges)
        best = np.flatnonzero(wrong == wrong.min())
        # the middle of the longest run of such edges, as texts yet to come are least likely there
        runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
        run = max(runs, key=len)
        quantile = below[run[len(run) // 2]]
    same = np.flatnonzero(below == below[min(np.searchsorted(below, quantile), BINS + 1)])
    if share is None:
        same = same[np.isin(same, run)]
    cut = float(edges[same[len(same) // 2]])
    return replace(model, cut=cut, slope=3.0 / (float(np.median(np.abs(s - cut))) + 1e-9))


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learned(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, np.ndarray, np.ndarray]:
    """The model, and the features and labels of its sample."""
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_y").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("quality")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(t.as_py() or "") for t in batch.column(2)], pa.list_(pa.float64()))], names=["id", "y", "x"])

    docs = docs.select("doc_id", "text")
    rows = docs.join(F.broadcast(chosen), docs.doc_id == chosen._id).select(F.col("_id").cast("long").alias("id"), F.col("_y").cast("int").alias("y"), "text")
    # of rows of one doc_id the least features, so that no more than SAMPLE come to the driver
    got = rows.mapInArrow(run, "id bigint, y int, x array<double>").groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).toArrow()
    if not got.num_rows:
        return None, np.zeros((0, len(NAMES))), np.zeros(0)
    x = np.array(got.column("x").combine_chunks().values).reshape(got.num_rows, -1)
    y, ids = np.array(got.column("y")), np.array(got.column("id"))
    order = np.argsort(ids, kind="stable")
    return fit(x[order], y[order]), x[order], y[order]


def strengths(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `strength`."""
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("quality")
        for batch in parts(batches):
            own = model.strengths(np.array([features(t.as_py() or "") for t in batch.column(at)])) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.float64())], names=[*names, "strength"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("strength", T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, share: float | None = None, keep_text: bool = True) -> DataFrame:
    """docs with `score`, which takes the place of a column of that name; score >= GOOD for the share `share` of all rows, about, or as the sample of labels has it. Null and empty texts are scored as texts without words;
    repeated rows get equal scores; without labels of both classes every score is 0.7, so that nothing is rejected; an empty table gives no rows. Without its texts a table's strengths are written and
    worked out once, otherwise twice."""
    docs = docs.drop("score", "strength")
    own = docs if keep_text else docs.drop("text")
    model, x, y = learned(docs, labels)
    if model is None:
        return own.withColumn("score", F.lit(GOOD))
    if keep_text:
        strong, counted = strengths(docs, model), strengths(docs.select("text"), model)
    else:
        strong = counted = written(strengths(docs, model).drop("text"), "strengths")
    model = at_quantile(model, counted, x, y, share)
    return strong.withColumn("score", model.score(F.col("strength"))).select(*own.columns, "score")


def accepted(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """docs without those that score below GOOD."""
    return guarded(docs, ["doc_id", "text"], lambda d: scored(d, labels, share).where(F.col("score") >= GOOD))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, table(spark, sf_dir, "labels"), keep_text=False).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
