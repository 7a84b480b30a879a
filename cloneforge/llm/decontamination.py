"""Benchmark decontamination: a generalised suffix automaton of the normalised test items reads each document's words and tracks
the longest match that ends at each of them; words inside a match of at least a window are hit. Spans of hit words are
cut out, and documents of which too much is hit are dropped.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cached, guarded, parts, table, using, written
from .shingles import P, mixed, word_hashes

WINDOW = 10
#: Share of hit words from which the pipeline drops a document.
COVERAGE = 0.5
#: Bytes of items that one automaton holds, about; more items are dealt to several, each of which reads the documents that may hold any.
SHARD_BYTES = 1 << 20
#: Bits, as a power of two, of the filter that tells such documents: one for each pair of neighbours in an item, by hash.
FILTER = 27

#: Lower-cases A-Z and makes the word breaks blanks: what isn't 0-9, A-Z, a-z or beyond 7F.
BREAKS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(BREAKS).split()


class Automaton:
    """Of sequences of numbers; a path from state 0 exists for each of their substrings and for nothing else."""

    def __init__(self, sequences: Iterable[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for s in sequences:
            last = 0
            for c in s:
                last = self._extend(last, c)

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the longest suffix of p extended by c, where q holds longer strings too."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:  # an earlier sequence went here
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def lengths(self, stream: Iterable[int]) -> list[int]:
        """At each number, the length of the longest match that ends there."""
        out, state, n = [], 0, 0
        moves, link, length = self.next, self.link, self.length
        for c in stream:
            while (to := moves[state].get(c)) is None and state:
                state = link[state]
                n = length[state]
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            out.append(n)
        return out


class Items:
    """The automaton of some items and the windows that tell which item was met."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[str]] = {}
        sequences = []
        for key, raw in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(raw)]
            if ids:
                sequences.append(ids)
                n = min(window, len(ids))
                for k in range(len(ids) - n + 1):
                    seen.setdefault(tuple(ids[k : k + n]), set()).add(key)
        self.automaton = Automaton(sequences)
        self.windows = seen
        self.sizes = sorted({len(w) for w in seen})
        self.pairs = np.unique(np.array([a * len(self.vocabulary) + b for s in sequences for a, b in zip(s, s[1:])], np.int64))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words, as they come, and the items met."""
        if not self.sizes or len(words) < self.sizes[0]:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        least = self.sizes[0]
        known = ids >= 0
        if least > 1:  # a match needs neighbours that are neighbours in an item
            code = ids[:-1] * len(self.vocabulary) + ids[1:]
            both = np.flatnonzero(known[:-1] & known[1:])
            if len(both) < least - 1:
                return [], set()
            at = np.searchsorted(self.pairs, code[both])
            both = both[self.pairs[np.minimum(at, len(self.pairs) - 1)] == code[both]]
            if len(both) < least - 1:
                return [], set()
            cuts = np.flatnonzero(np.diff(both) > 1) + 1
            runs = [(x[0], x[-1] + 2) for x in np.split(both, cuts) if len(x) >= least - 1]
        else:
            single = np.flatnonzero(known)
            if not len(single):
                return [], set()
            runs = [(x[0], x[-1] + 1) for x in np.split(single, np.flatnonzero(np.diff(single) > 1) + 1)]
        spans, met = [], set()
        for a, b in runs:
            own = ids[a:b].tolist()
            for i, n in enumerate(self.automaton.lengths(own), 1):
                for size in self.sizes:
                    if size > n:
                        break
                    if found := self.windows.get(tuple(own[i - size : i])):
                        spans.append((int(a) + i - size, int(a) + i))
                        met |= found
        return spans, met


def merged(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_built: dict[str, Items] = {}
cached("decontamination", _built.clear)


def built(key: str, items: list[tuple[str, bytes]], window: int) -> Items:
    """One a worker and set of items."""
    if key not in _built:
        _built.clear()
        _built[key] = Items(items, window)
    return _built[key]


def shards_of(benchmark: DataFrame, shard_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items, at most about shard_bytes at a time (or one item)."""
    slim = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("k"), F.col("text").cast("binary").alias("b")).where("b is not null")
    total = slim.agg(F.sum(F.length("b"))).first()[0] or 0
    n = max(1, math.ceil(2 * total / shard_bytes)) if total > shard_bytes else 1
    for k in range(n):
        own = slim if n == 1 else slim.where(F.pmod(F.xxhash64("k", "b"), F.lit(n)) == k)
        yield sorted((r.k, bytes(r.b)) for r in own.collect())


FOUND = "spans array<struct<a:int,b:int>>, items array<string>, n_words bigint"


def found(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, cut: bool = False) -> DataFrame:
    """docs (with cut: without the spans in their texts) with `spans` (of hit words, from and to, apart and in order), `items` (ids of the items met, sorted) and `n_words`.
    Null and empty texts have no words; an item without words meets nothing; equal items are met together."""
    shards = [s for s in shards_of(benchmark, shard_bytes) if s] or [[]]
    if len(shards) == 1:
        return _scan(docs, shards[0], window, cut)
    own = written(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
    likely = written(_likely(own.select("_row", "text"), shards, window), "likely")
    all_, texts = None, likely.where("text is not null").select("_row", "text")
    for s in shards:
        part = _scan(texts, s, window).drop("text", "n_words")
        all_ = part if all_ is None else all_.unionByName(part)
    per = all_.groupBy("_row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # one span may end in another's: glue them
    glue = F.aggregate("spans", F.expr("cast(array() as array<struct<a:int,b:int>>)"), lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= s["a"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(s))))
    none = lambda kind: F.expr(f"cast(array() as {kind})")
    per = per.select("_row", glue.alias("_spans"), F.col("items").alias("_items"))
    out = own.join(likely.select("_row", "n_words"), "_row").join(per, "_row", "left")
    out = out.select(*docs.columns, F.coalesce("_spans", none("array<struct<a:int,b:int>>")).alias("spans"), F.coalesce("_items", none("array<string>")).alias("items"), "n_words")
    return _recut(out) if cut else out


def _pairs(words: list[bytes]) -> np.ndarray:
    """Places in the filter of neighbours."""
    h = word_hashes(words)
    return (mixed(h[:-1] * P + h[1:]) >> np.uint64(64 - FILTER)).astype(np.int64)


def _likely(docs: DataFrame, shards: list[list[tuple[str, bytes]]], window: int) -> DataFrame:
    """_row, n_words, and the text where it has so many neighbours in a row that are neighbours in items as the shortest item's windows have."""
    bits = np.zeros(1 << (FILTER - 3), np.uint8)
    least = window
    for s in shards:
        for _, raw in s:
            if words := words_of(raw):
                least = min(least, len(words))
                at = _pairs(words)
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    filter_ = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("shingles")
        own = filter_.value
        for batch in parts(batches):
            n, texts = [], []
            for raw in batch.column(1):
                words = words_of((raw.as_py() or "").encode())
                at = _pairs(words) if len(words) > 1 else np.zeros(0, np.int64)
                miss = np.flatnonzero(own[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 0)
                longest = int(np.diff(np.concatenate([[-1], miss, [len(at)]])).max()) - 1
                n.append(len(words))
                texts.append(raw.as_py() if len(words) >= least and longest >= least - 1 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(texts, pa.string())], names=["_row", "n_words", "text"])

    return docs.select("_row", F.col("text").cast("string")).mapInArrow(run, "_row bigint, n_words bigint, text string")


def _recut(hit: DataFrame) -> DataFrame:
    """hit with its spans cut out of its texts."""
    at, names = hit.columns.index("text"), hit.columns
    by = names.index("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            columns[at] = pa.array(_cut(columns[at].to_pylist(), [[(s["a"], s["b"]) for s in x] for x in columns[by].to_pylist()]), columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return hit.mapInArrow(run, hit.schema)


def _scan(docs: DataFrame, items: list[tuple[str, bytes]], window: int, cut: bool = False) -> DataFrame:
    key = hashlib.sha256(repr((window, items)).encode()).hexdigest()
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(FOUND).fields])
    at = docs.columns.index("text")
    keep = [c for c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("decontamination")
        own = built(key, items, window)
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in parts(batches):
            spans, met, n, columns = [], [], [], batch.columns
            for raw in columns[at].cast(pa.large_binary()):
                words = words_of(raw.as_py() or b"")
                s, m = own.hits(words)
                spans.append(merged(s))
                met.append(sorted(m))
                n.append(len(words))
            if cut:
                columns[at] = pa.array(_cut(columns[at].to_pylist(), spans), columns[at].type)
            spans = [[{"a": a, "b": b} for a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind), pa.array(met, pa.list_(pa.string())), pa.array(n, pa.int64())], names=[*keep, "spans", "items", "n_words"])

    return docs.mapInArrow(run, schema)


def digest(hit: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return hit.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    places = [m.span() for m in WORD.finditer(raw.lower())]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]])


def _cut(texts: list[str | None], spans: list[list[list[int]]]) -> list[str | None]:
    return [without(t.encode(), s).decode() if s else t for t, s in zip(texts, spans)]


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """docs, hit spans cut out; documents with at least the share `coverage` of hit words go. Other columns stay as they are."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    good = (n_hit == 0) | (n_hit < coverage * F.col("n_words"))
    return guarded(docs, ["text"], lambda d: found(d, benchmark, window, cut=True).where(good).select(*d.columns))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(found(docs, table(spark, sf_dir, "benchmark")).drop("text"))
