"""Packing: concatenate and cut. Pass one tokenises each partition once, stores the ids and sums the tokens of each
partition; prefix sums of these totals give every document its place in the one global stream. Pass two cuts the
stream at fixed windows; a document across a boundary becomes several pieces.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cached, table, using, written

#: Entries of a worker's word caches; words beyond are encoded each time they occur.
WHOLE_WORDS, BARE_WORDS = 150_000, 250_000
END_ID = 2
LENGTH = 4096
#: Bytes of text encoded at a time.
STEP = 2 << 20


#: How a tokenizer by words parts them.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Byte-level vocabularies name bytes that can't be printed by the characters from 256 on, and all others by themselves.
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b))}


def by_words(path: str) -> bool:
    """Does the tokenizer take lower-cased words one by one, apart from marks and digits, whatever white space is between them, and end them by a suffix?"""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    parts_of = lambda x, key: [{k: v for k, v in p.items()} for p in ((x or {}).get(key) or ([x] if x else []))]
    before, split, model = parts_of(own.get("normalizer"), "normalizers"), parts_of(own.get("pre_tokenizer"), "pretokenizers"), own["model"]
    return (
        [p["type"] for p in before] == ["NFC", "Replace", "Lowercase"] and before[1]["pattern"] == {"Regex": r"\s+"} and before[1]["content"] == " "
        and [p["type"] for p in split] == ["Split", "ByteLevel"] and split[0]["behavior"] == "Removed" and split[0]["invert"] and split[0]["pattern"] == {"Regex": WORD_PATTERN}
        and not split[1]["add_prefix_space"] and not split[1]["use_regex"] and not model.get("dropout") and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>"
    )


class Encoder:
    """Token ids, as little-endian uint32 bytes. By a tokenizer by words each distinct word is encoded once and then looked up; words without letters only, or
    beyond the caches, go to the tokenizer, as do whole texts where it is another kind."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = by_words(path)
        self.bare: dict[str, bytes] = {}
        whole: dict[str, bytes] = {}
        self.whole = whole
        encode = self.tokenizer.encode
        bare = self.bare

        tokenize = self.tokenizer.model.tokenize

        def direct(word: str) -> bytes:
            return np.array(encode(word, add_special_tokens=False).ids, "<u4").tobytes()

        def part(word: str) -> bytes:
            if (got := bare.get(word)) is None:
                if word.isalpha():  # what stands before the model leaves it whole; it sees bytes as characters
                    own = tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(BYTES))
                    got = struct.pack(f"<{len(own)}I", *[t.id for t in own])
                else:
                    got = direct(word)
                if len(bare) < BARE_WORDS:
                    bare[word] = got
            return got

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                core = word.rstrip(".,;:!?")
                if core.isalpha() and core.isascii() or core.isalpha() and max(core) < "\u0100":
                    core, end = core.lower(), word[len(core):]
                    got = part(core) + part(end) if end else part(core)
                else:
                    got = direct(word)
                if len(self) < WHOLE_WORDS:
                    self[word] = got
                return got

        self.words = Words()

    def ids(self, text: str) -> bytes:
        if not self.by_words:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(text) <= STEP:
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        out, words = [], self.words  # a very long text: without a list of all its words
        text = text.replace("\n", " ")
        at = 0
        while at < len(text):
            cut = text.find(" ", at + STEP)
            cut = len(text) if cut < 0 else cut
            out.append(b"".join(map(words.__getitem__, text[at:cut].split(" "))))
            at = cut + 1
        return b"".join(out)


_encoders: dict[str, Encoder] = {}
cached("packing", _encoders.clear)


def encoder(path: str) -> Encoder:
    """One a worker; workers serve many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


STORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("begin", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part (the partition), begin (tokens of the partition before the document), n, ids (uint32, little-endian; the
    end id last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("packing")
        enc, part, before = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, ids, begin, n, held = [], [], [], [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                raw = enc.ids(text.as_py() or "") + end
                keys.append(key.as_py())
                begin.append(before)
                n.append(len(raw) // 4)
                ids.append(raw)
                before += n[-1]
                held += len(raw)
                if held > STEP:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([part] * len(keys), pa.int32()), pa.array(begin, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], schema=SCHEMA)
                    keys, ids, begin, n, held = [], [], [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([part] * len(keys), pa.int32()), pa.array(begin, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], schema=SCHEMA)

    SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("begin", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, STORED)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in sequences of `length` tokens: doc_id, start (its document's tokens before it), length, ids (its
    tokens, little-endian uint32), doc_tokens, sequence_id, offset. All sequences but the last are full. A null or
    empty text is its end id alone; repeated rows are packed each; an empty table gives no rows; other columns are
    not read. The order of documents is that of the input's partitions."""
    stored = written(tokenised(docs, path or vocabulary(), end_id), "tokens")
    totals = stored.groupBy("part").agg(F.sum("n").alias("total"))
    # one row for each input partition, whatever the rows are
    begins = totals.select("part", F.coalesce(F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_begin"))
    # so small for up to a million partitions that it is broadcast; beyond, Spark decides
    begins = F.broadcast(begins) if docs.rdd.getNumPartitions() <= 1_000_000 else begins
    placed = stored.join(begins, "part").withColumn("at", F.col("part_begin") + F.col("begin"))
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("n") - 1) / length)

    def piece(k):
        start = F.greatest(k * length, F.col("at")) - F.col("at")
        stop = F.least((k + 1) * length, F.col("at") + F.col("n")) - F.col("at")
        return F.struct(start.alias("start"), (stop - start).alias("length"), F.substring(F.col("ids"), (start * 4 + 1).cast("int"), ((stop - start) * 4).cast("int")).alias("ids"), k.cast("long").alias("sequence_id"), (F.col("at") + start - k * length).alias("offset"))

    return placed.select("doc_id", F.col("n").alias("doc_tokens"), F.inline(F.transform(F.sequence(first, last), piece))).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", F.col("start").cast("long"), F.col("length").cast("long"), F.crc32("ids").cast("long").alias("ids_crc32"), F.col("doc_tokens").cast("long"), F.col("sequence_id").cast("long"), F.col("offset").cast("long"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
