"""Toxicity by multiple-instance learning. A document is a bag of sentences. Each sentence is toxic with a probability that is logistic in the stems of its words; a document is toxic if any
sentence is: 1 - product of (1 - p), noisy-or. Documents have labels, sentences none: the loss of the documents' labels is what the weights of stems are learned by, and sentences are then
told by their own probabilities.

Labels are learned from a bounded sample: of all labelled rows that may be used, the SAMPLE ones of least hash. Every document is scored whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts, table, using, written

#: Labelled rows that the model is fitted on at most, hash values of stems, and stems that the model has at most.
SAMPLE, BUCKETS, STEMS = 20_000, 1 << 20, 2048
#: Words of a sentence; longer ones, such as texts without any full stop, are cut.
LONGEST = 40
#: Score from which a document, or a sentence, counts as toxic.
TOXIC = 0.5
#: Words whose stems a worker remembers.
REMEMBERED = 300_000
#: Of 1e-5, 3e-5, 1e-4, 3e-4 and 1e-3 the ridge of least log loss on the rows of sf0.1 with remainder 1, learned from those with 2 to 4; held-out rows had no part in it.
RIDGE, STEPS = 1e-4, 300

_sentence = re.compile(r"[^.!?\n]+(?:[.!?]+(?!\s)[^.!?\n]+)*[.!?]*")
_word = re.compile(r"[^\W\d_]+")
#: Rows of the sample are read by so many tasks.
TASKS = 12


def pieces(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(begin, end, words in small letters) of the sentences of a text that have words: they end at a line's end, or at marks that blanks follow."""
    for m in _sentence.finditer(text):
        words = [(w.start(), w.end(), w.group()) for w in _word.finditer(m.group())]
        for k in range(0, len(words), LONGEST):
            own = words[k : k + LONGEST]
            yield m.start() + own[0][0], m.start() + own[-1][1], [w.lower() for _, _, w in own]


def sentences(text: str) -> list[set[str]]:
    """The different words of the sentences, as pieces() cuts them, without their places."""
    out = []
    for m in _sentence.findall(text.lower()):
        words = _word.findall(m)
        if len(words) <= LONGEST:
            if words:
                out.append(set(words))
        else:
            out += [set(words[k : k + LONGEST]) for k in range(0, len(words), LONGEST)]
    return out


def stems(word: str) -> list[int]:
    """Hash values of a word and of its beginnings of three to eight letters."""
    return [zlib.crc32(x.encode()) % BUCKETS for x in ("=" + word, *("^" + word[:k] for k in range(3, min(8, len(word)) + 1)))]


class Words(dict):
    """What a word means, by a function, remembered for a bounded number of words."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word):
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = self.of(word)
        return found


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    words: Words = field(init=False, repr=False)

    def __post_init__(self) -> None:
        weights = self.weights
        self.words = Words(lambda w: sum(weights.get(h, 0.0) for h in stems(w)))

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def of_sentence(self, words: set[str]) -> float:
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.bias + math.fsum(map(self.words.__getitem__, words))))))

    def of_text(self, text: str) -> float:
        """Noisy-or of the sentences; a text without words has none and scores 0."""
        return -math.expm1(math.fsum(math.log1p(-min(self.of_sentence(s), 1 - 1e-12)) for s in sentences(text)))


def losses(w: np.ndarray, bags: tuple[np.ndarray, ...], y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss of the documents' labels under weights w, of which the last one is the bias, and its gradient. bags: for each entry its sentence, stem and count; for each sentence its
    document and how often it stands there."""
    row, column, count, doc, times = bags
    z = np.clip(np.bincount(row, w[column] * count, len(doc)) + w[-1], -30, 30)
    p = 1 / (1 + np.exp(-z))
    quiet = np.bincount(doc, times * -np.logaddexp(0, z), len(y))  # log of the product of 1 - p
    sure = np.maximum(-np.expm1(quiet), 1e-12)
    loss = -np.where(y == 1, np.log(sure), quiet).mean() + RIDGE / 2 * (w[:-1] ** 2).sum()
    pull = times * p * np.where(y == 1, -np.exp(quiet) / sure, 1.0)[doc] / len(y)
    grad = np.concatenate([np.bincount(column, pull[row] * count, len(w) - 1), [pull.sum()]])
    grad[:-1] += RIDGE * w[:-1]
    return float(loss), grad


def fit(bags: tuple[np.ndarray, ...], y: np.ndarray, n_stems: int) -> np.ndarray:
    """Weights of least loss, by Adam over all bags at once, from no weights and a bias by which the documents' share is met."""
    share = y.mean()
    w = np.zeros(n_stems + 1)
    per = max(1.0, bags[4].sum() / max(1, len(y)))
    w[-1] = math.log(max(1e-6, 1 - (1 - share) ** (1 / per)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, STEPS + 1):
        _, g = losses(w, bags, y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * min(1.0, 2 - 2 * k / (STEPS + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return w


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _chosen(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, y, text) of the sample, one row of a doc_id: the least text."""
    ids = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = own.join(F.broadcast(ids), own.doc_id == ids._id).groupBy(F.col("_id").alias("id")).agg(F.min("y").alias("y"), F.min("text").alias("text"))  # SAMPLE ids at most
    return written(rows.repartition(TASKS, "id"), "labelled")


def _stems(rows: DataFrame) -> np.ndarray:
    """The stems that tell most of the labels, by the likelihood ratio of the documents that have them. Each task counts into one array of BUCKETS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("toxicity")
        known, n = Words(stems), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                own = {h for w in set(_word.findall(text.as_py().lower())) for h in known[w]}
                n[y, list(own)] += 1
        some = np.flatnonzero(n.sum(0))
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[0, part]), pa.array(n[1, part])], names=["stem", "clean", "toxic"])

    total = rows.agg(F.count_if(F.col("y") == 0).alias("clean"), F.count_if(F.col("y") == 1).alias("toxic")).first()
    if not total.clean or not total.toxic:
        return np.array([], np.int64)
    n = total.clean + total.toxic
    both = F.col("clean") + F.col("toxic")
    term = lambda seen, of, share: F.when(seen > 0, seen * F.log(seen * n / (of * share))).otherwise(0.0)
    tells = term(F.col("clean"), both, total.clean) + term(F.col("toxic"), both, total.toxic) + term(total.clean - F.col("clean"), n - both, total.clean) + term(total.toxic - F.col("toxic"), n - both, total.toxic)
    counts = rows.mapInArrow(run, "stem int, clean bigint, toxic bigint").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(both >= 3)
    return np.array(sorted(r.stem for r in counts.orderBy(tells.desc(), "stem").limit(STEMS).select("stem").collect()), np.int64)


def learned(docs: DataFrame, labels: DataFrame) -> Model | None:
    """None where a class has no example. The driver gets the sample's sentences as stems, each different one of a document once."""
    rows = _chosen(docs, labels)
    chosen = _stems(rows)
    if not len(chosen):
        return None
    place = {int(h): k for k, h in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("toxicity")
        known = Words(lambda w: [place[h] for h in stems(w) if h in place])
        for batch in parts(batches):
            out = []
            for text in batch.column(2):
                seen: dict[tuple[int, ...], int] = {}
                for s in sentences(text.as_py()):
                    key = tuple(sorted(k for w in s for k in known[w]))
                    seen[key] = seen.get(key, 0) + 1
                out.append((list(seen.values()), [len(k) for k in seen], [x for k in seen for x in k]))
            lists = [pa.array([x[j] for x in out], pa.list_(pa.int32())) for j in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), *lists], names=["id", "y", "times", "sizes", "stems"])

    got = rows.mapInArrow(run, "id bigint, y int, times array<int>, sizes array<int>, stems array<int>").toArrow().sort_by("id").combine_chunks()
    flat = lambda c: np.asarray(got.column(c).combine_chunks().flatten()).astype(np.int64)
    y, times, sizes, column = np.asarray(got.column("y")), flat("times"), flat("sizes"), flat("stems")
    doc = np.repeat(np.arange(len(y)), [len(x) for x in got.column("times")])
    bags = (np.repeat(np.arange(len(sizes)), sizes), column, np.ones(len(column)), doc, times.astype(float))
    w = fit(bags, y, len(chosen))
    return Model({int(h): float(x) for h, x in zip(chosen, w) if abs(x) > 1e-4}, float(w[-1]))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with `score`, which takes the place of a column of that name. Null, empty and wordless texts score 0; repeated rows get equal scores; without labels of both classes every score is 0;
    a document with several labels is toxic if one says so; an empty table gives no rows."""
    docs = docs.drop("score")
    model = learned(docs, labels)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("toxicity")
        for batch in parts(batches):
            score = [0.0 if model is None else model.of_text(t.as_py() or "") for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def offending(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, start, length, sentence, score) of the sentences that are toxic by themselves, at TOXIC or more; start and length in characters, from 0. Handles what scored() does, alike."""
    model = learned(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("toxicity")
        for batch in parts(batches):
            found = []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                for a, b, words in pieces(text) if model else ():
                    if (p := model.of_sentence(set(words))) >= TOXIC:
                        found.append((k, a, b - a, text[a:b], p))
            ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
            rest = [pa.array([x[j] for x in found], kind) for j, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.string()), (4, pa.float64()))]
            yield pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "start", "length", "sentence", "score"])

    own = docs.select("doc_id", "text")
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, start bigint, length bigint, sentence string, score double")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, table(spark, sf_dir, "labels")).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
