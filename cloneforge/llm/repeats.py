"""Suffix-array dedup: maximal repeats from the common-prefix interval tree of an enhanced suffix array.

A repeat of LEAST bytes is found where it can be shared: every window of LEAST bytes has one anchor, the place of its least k-gram hash, which
its bytes alone decide; so equal windows have equal anchors.
1. Anchors' hashes are dealt to buckets, which report those that occur in more than one text to the groups of documents that have them. Of an anchor that more
   than one text of a batch has, the groups of these texts are told at once, and its bucket gets a mark in place of them.
2. For reported anchors, the stretch of all windows that have this anchor is sent to a bucket by the anchor's hash; of equal stretches in
   one group of documents, only that of the smallest doc_id, as the others are known to be repeats. A bucket that would get too many gets none: their windows
   are dealt to further buckets, by their own hashes, so that one passage in many surroundings meets in as many buckets as it has windows.
3. Each bucket sorts the suffixes that begin a window and occur more than once, has the longest common prefixes of neighbours, and a stack scan yields the
   tree's intervals. An interval whose occurrences are preceded by different bytes is a maximal repeat, with all its occurrences. All but
   those in the smallest document are covered.
4. Documents meet their covered spans, and are cut.
Equal texts are told by their hashes before: all but the smallest doc_id are covered throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .minhash import IDS_MOST
from .shingles import P, mixed

LEAST, GRAM = 50, 20
#: Bytes worked on at a time; a longer text is cut into pieces that overlap. Below 1 << PLACE.
STEP, PLACE = 1 << 20, 23
#: Anchors in a bucket and bytes of text in a group of documents, about.
BUCKET, GROUP = 500_000, 8_000_000
#: Anchors that are told to the buckets at a time, about.
TOLD = 500_000
#: Stretches from which on a bucket's windows are dealt to others.
LOAD_MOST = 2 * BUCKET


def _gram(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of k neighbours, by doubling."""
    power = lambda q: np.uint64(pow(int(P), q, 1 << 64))
    out, done, size, block = None, 0, 1, h
    while size <= k:
        if k & size:
            own = block[done:]
            out = own if out is None else out[: len(own)] * power(size) + own
            done += size
        if size * 2 <= k:
            block = block[: len(block) - size] * power(size) + block[size:]
        size *= 2
    return out[: max(0, len(h) - k + 1)]


def anchors(texts: list[bytes], least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of at most 1 << PLACE bytes together: for each anchor its text, its hash, and the first and last start of its windows, in bytes
    from the beginning of all texts."""
    size = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none.astype(np.uint64), none, none
    h = mixed(_gram(buf.astype(np.uint64) + np.uint64(1), gram))
    place = np.uint64((1 << PLACE) - 1)
    low = (h & ~place) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first
    span = least - gram + 1
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    m = n - least + 1
    if width < span:
        low = np.minimum(low[:m], low[span - width : span - width + m])
    end = np.repeat(np.cumsum(size), size)
    start = np.flatnonzero(np.arange(m) + least <= end[:m])
    at = (low[start] & place).astype(np.int64)
    if not len(at):
        return none, none.astype(np.uint64), none, none
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(new[1:], len(at)) - 1
    first = start[new]
    return np.searchsorted(np.cumsum(size), first, side="right"), h[at[new]], first, start[last]


def pieces(texts: list[bytes], least: int = LEAST) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts some MB at a time: their places in the list, offsets, and bytes. Each window of a long text is whole in one of its pieces."""
    who, offset, own, held = [], [], [], 0
    for k, t in enumerate(texts):
        for begin in range(0, max(1, len(t) - least + 1), STEP):
            part = t[begin : begin + STEP + least - 1]
            if len(part) < least:
                continue
            if held + len(part) > STEP + least and own:
                yield who, offset, own
                who, offset, own, held = [], [], [], 0
            who.append(k)
            offset.append(begin)
            own.append(part)
            held += len(part)
    if own:
        yield who, offset, own


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """As group() has it."""
    u = ids.view(np.uint64)
    return np.mod((u ^ (u >> np.uint64(7)) ^ (u >> np.uint64(19))).view(np.int64), groups)


def group(groups: int) -> F.Column:
    d = F.col("doc_id")
    return F.coalesce(F.pmod(d.bitwiseXOR(F.shiftrightunsigned(d, 7)).bitwiseXOR(F.shiftrightunsigned(d, 19)), F.lit(groups)), F.lit(0)).cast("int")


def maximal_repeats(buf: np.ndarray, start: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of the suffixes that begin at start, of strings from begin to end, and the maximal repeats among them as (length, first, last) in this order:
    intervals of common prefixes of at least `least` bytes whose occurrences aren't all preceded by one byte. A string's beginning differs from every byte."""
    n = len(start)
    if n < 2:
        return np.arange(n), []
    rest = end - start
    width = -(-int(rest.max()) // 8) * 8
    padded = np.concatenate([buf, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[start]
    rows[np.arange(width)[None] >= rest[:, None]] = 0
    keys = rows.view(">u8").astype(np.uint64)
    order = np.lexsort([*(keys[:, k] for k in range(keys.shape[1] - 1, -1, -1))])
    keys, rest = keys[order], rest[order]
    differ = keys[1:] != keys[:-1]
    some, word = differ.any(1), differ.argmax(1)
    x = keys[1:][np.arange(n - 1), word] ^ keys[:-1][np.arange(n - 1), word]
    byte = np.zeros(n - 1, np.int64)
    for k in range(1, 8):  # leading bytes that agree
        byte += (x >> np.uint64(64 - 8 * k)) == 0
    lcp = np.minimum(np.where(some, word * 8 + byte, width), np.minimum(rest[1:], rest[:-1]))
    before = np.where(start > begin, buf[np.maximum(start - 1, 0)].astype(np.int64), -1 - np.arange(n))[order]
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])]).tolist()
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # length, first
    for i, length in enumerate([*lcp.tolist(), 0]):
        first = i
        while stack and stack[-1][0] > length:
            top, first = stack.pop()
            if changes[i] > changes[first]:
                found.append((top, first, i))
        if length >= least and (not stack or stack[-1][0] < length):
            stack.append((length, first))
    return order, found


def _lists(names: list[str], by: np.ndarray, columns: list[tuple[np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    """One row for each value of by, with the columns as lists."""
    order = np.argsort(by, kind="stable")
    own, first = np.unique(by[order], return_index=True)
    offsets = pa.array(np.append(first, len(by)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.ListArray.from_arrays(offsets, pa.array(c[order], kind)) for c, kind in columns)], names=names)


ASKED = "bucket int, grp array<int>, text array<bigint>, hash array<int>"


def asked(docs: DataFrame, buckets: int, groups: int, least: int) -> DataFrame:
    """Anchors by bucket: the group of the document (-1: a mark of many texts), the hash of its text (of a mark: texts) and the rest of the anchor's hash. In bucket -1 - g what group g
    is told at once: the anchor's bucket in place of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[int, tuple[int, bytes]] = {}
            for d, key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if d is not None and (key not in first or d < first[key][0]):
                    first[key] = (d, raw.as_py())
            keys = np.array(list(first), np.int64)
            owner = group_of(np.array([d for d, _ in first.values()], np.int64), groups)
            got: list[tuple[np.ndarray, np.ndarray]] = []

            def told() -> pa.RecordBatch:
                h, who = (np.concatenate(x) for x in zip(*got))
                got.clear()
                order = np.lexsort((who, h))
                h, who = h[order], who[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])])
                h, who = h[new], who[new]
                _, index, count = np.unique(h, return_index=True, return_counts=True)
                many = np.repeat(count > 1, count)
                one, mark = np.flatnonzero(~many), index[count > 1]
                local = np.flatnonzero(many)
                _, once = np.unique(np.stack([h[local].view(np.int64), owner[who[local]]]), axis=1, return_index=True) if len(local) else (None, local)
                local = local[once]
                at = np.concatenate([one, mark, local])
                bucket, rest = (h[at] % np.uint64(buckets)).astype(np.int64), (h[at] // np.uint64(buckets)).astype(np.uint32).view(np.int32)
                grp = np.concatenate([owner[who[one]], np.full(len(mark), -1), bucket[len(one) + len(mark) :]])
                text = np.concatenate([keys[who[one]], count[count > 1], np.zeros(len(local), np.int64)])
                by = np.concatenate([bucket[: len(one) + len(mark)], -1 - owner[who[local]]])
                return _lists(["bucket", "grp", "text", "hash"], by, [(grp, pa.int32()), (text, pa.int64()), (rest, pa.int32())])

            for who, _, own in pieces([t for _, t in first.values()], least):
                text, h, _, _ = anchors(own, least)
                if len(h):
                    got.append((h, np.array(who, np.int64)[text]))
                if sum(len(x) for x, _ in got) > TOLD:
                    yield told()
            if got:
                yield told()

    return docs.mapInArrow(run, ASKED)


SHARED = "grp int, bucket array<int>, hash array<int>, load bigint"


def shared(packed: DataFrame) -> DataFrame:
    """Anchors that occur in more than one text, by the groups of documents that have them; with group -1 the texts that have such anchors of a bucket."""

    def run(t: pa.Table) -> pa.Table:
        flat = lambda x: np.array(t.column(x).combine_chunks().flatten())
        grp, text, h = flat("grp").astype(np.int64), flat("text"), flat("hash")
        own = t.column("bucket")[0].as_py()
        if own < 0:
            code = np.unique(grp << 32 | h.view(np.uint32).astype(np.int64))
            rows = _lists(["grp", "bucket", "hash"], np.full(len(code), -1 - own), [((code >> 32), pa.int32()), ((code & 0xFFFFFFFF).astype(np.uint32).view(np.int32), pa.int32())])
            return pa.Table.from_batches([rows]).append_column("load", pa.nulls(rows.num_rows, pa.int64()))
        marked = grp < 0
        order = np.lexsort((text, marked, h))
        grp, text, h, marked = grp[order], text[order], h[order], marked[order]
        first = np.concatenate([[True], h[1:] != h[:-1]])
        member = np.cumsum(first) - 1
        other = np.concatenate([[False], (text[1:] != text[:-1]) & ~first[1:]])
        more = np.bincount(member, other | marked)[member] > 0
        load = int(np.where(marked, text, 1)[more].sum())
        tell = more & ~marked
        pairs = np.unique(grp[tell] << 32 | h[tell].view(np.uint32).astype(np.int64))
        to, rest = pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
        rows = _lists(["grp", "bucket", "hash"], to, [(np.full(len(to), own), pa.int32()), (rest, pa.int32())])
        rows = pa.Table.from_batches([rows]).append_column("load", pa.nulls(rows.num_rows, pa.int64()))
        mine = pa.table({"grp": pa.array([-1], pa.int32()), "bucket": pa.array([[own]], pa.list_(pa.int32())), "hash": pa.array([[]], pa.list_(pa.int32())), "load": pa.array([load], pa.int64())})
        return pa.concat_tables([rows, mine])

    return packed.groupBy("bucket").applyInArrow(run, SHARED)


STRETCHES = "bucket int, bytes array<binary>, doc array<bigint>, start array<bigint>, length array<bigint>"


def stretches(docs: DataFrame, told: DataFrame, buckets: int, least: int, hot: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """Stretches of windows that have a shared anchor, by bucket; of equal ones in a group, that of the smallest document. In bucket -1 - g, as spans
    (doc, start, length), those of group g that equal one of a smaller document of it. hot: buckets whose windows go to others, with the first of these and their number."""
    hot = hot or {}

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        flat = lambda x: np.array(b.column(x).combine_chunks().flatten()) if b.num_rows else np.zeros(0, np.int64)
        bucket, h = flat("bucket").astype(np.uint64), flat("hash").astype(np.int32)
        each = np.sort(bucket << np.uint64(32) | h.view(np.uint32).astype(np.uint64))
        ids = np.array(a.column("doc_id"), np.int64) if a.column("doc_id").null_count == 0 else np.array([x if x is not None else -1 for x in a.column("doc_id").to_pylist()], np.int64)
        live = np.array([x is not None for x in a.column("doc_id").to_pylist()], bool)
        order = np.argsort(ids, kind="stable")
        order = order[live[order]]
        texts, ids = [a.column("t")[int(k)].as_py() for k in order], ids[order]
        seen: dict[bytes, int] = {}
        kept: list[tuple[bytes, int, int, int]] = []  # bytes, bucket, doc, start
        spans: list[tuple[int, int, int]] = []
        held = lambda x, among: (np.searchsorted(among, x, side="right") > np.searchsorted(among, x)) if len(among) else np.zeros(len(x), bool)
        for who, offset, own in pieces(texts, least):
            text, hs, first, last = anchors(own, least)
            if not len(text):
                continue
            d = ids[np.array(who)[text]]
            code = (hs % np.uint64(buckets)) << np.uint64(32) | (hs // np.uint64(buckets)).astype(np.uint32).astype(np.uint64)
            some = np.flatnonzero(held(code, each))
            begins = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            buf = b"".join(own)
            starts = (first[some] - begins[text[some]] + np.array(offset)[text[some]]).tolist()
            for dd, bk, lo, hi, s in zip(d[some].tolist(), (hs[some] % np.uint64(buckets)).astype(np.int64).tolist(), first[some].tolist(), (last[some] + least).tolist(), starts):
                if bk in hot:
                    begin, n = hot[bk]
                    parts = [(buf[k : k + least], s + k - lo) for k in range(lo, hi - least + 1)]
                    for x, at in parts:
                        if (before := seen.setdefault(x, dd)) == dd:
                            kept.append((x, begin + xxhash.xxh3_64_intdigest(x) % n, dd, at))
                        else:
                            spans.append((dd, at, least))
                    continue
                x = buf[lo:hi]
                if (before := seen.setdefault(x, dd)) == dd:  # documents come by doc_id
                    kept.append((x, bk, dd, s))
                else:
                    spans.append((dd, s, hi - lo))
        out = []
        names = ["bucket", "bytes", "doc", "start", "length"]
        if kept:
            xs, bk, ds, ss = zip(*kept)
            bk = np.array(bk)
            order = np.argsort(bk, kind="stable")
            own, first = np.unique(bk[order], return_index=True)
            offsets = pa.array(np.append(first, len(bk)).astype(np.int32))
            cut = lambda v, kind: pa.ListArray.from_arrays(offsets, pa.array(v, kind).take(pa.array(order)))
            out.append(pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), cut(xs, pa.binary()), cut(ds, pa.int64()), cut(ss, pa.int64()), cut([0] * len(ss), pa.int64())], names=names))
        if spans:
            one = [pa.array([list(c)], pa.list_(pa.int64())) for c in zip(*spans)]
            out.append(pa.RecordBatch.from_arrays([pa.array([-1 - a.column("grp")[0].as_py()], pa.int32()), pa.array([[]], pa.list_(pa.binary())), *one], names=names))
        kinds = pa.schema([("bucket", pa.int32()), ("bytes", pa.list_(pa.binary())), *((x, pa.list_(pa.int64())) for x in names[2:])])
        return pa.Table.from_batches(out, schema=kinds)

    return docs.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(run, STRETCHES)


COVERED = "grp int, doc array<bigint>, start array<bigint>, length array<bigint>"


def repeated_in(strings: list[bytes], docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct strings, each with a document: (string, offset, length) of what a string of a smaller document holds too."""
    size = np.array([len(x) for x in strings], np.int64)
    end = np.cumsum(size)
    buf = np.frombuffer(b"".join(strings), np.uint8)
    windows = size - least + 1
    owner = np.repeat(np.arange(len(strings)), windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + (end - size)[owner]
    h = _gram(buf.astype(np.uint64) + np.uint64(1), least)[start]
    order = np.argsort(h)
    twin = h[order][1:] == h[order][:-1]
    more = np.zeros(len(h), bool)  # only windows that occur again can begin a repeat
    more[order[1:][twin]] = more[order[:-1][twin]] = True
    start, owner = start[more], owner[more]
    order, found = maximal_repeats(buf, start, (end - size)[owner], end[owner], least)
    start, owner = start[order], owner[order]
    doc, cover = docs[owner], np.zeros(len(owner), np.int64)
    for length, first, last in found:
        own = doc[first : last + 1]
        least_doc = own.min()
        part = cover[first : last + 1]
        np.maximum(part, np.where(own > least_doc, length, 0), out=part)
    hit = np.flatnonzero(cover)
    return owner[hit], start[hit] - (end - size)[owner[hit]], cover[hit]


def covered(sent: DataFrame, groups: int, least: int) -> DataFrame:
    """Spans that a smaller document holds too, by group of the document."""

    def run(t: pa.Table) -> pa.Table:
        flat = lambda x: np.array(t.column(x).combine_chunks().flatten(), np.int64)
        doc, start, length = flat("doc"), flat("start"), flat("length")
        if t.column("bucket")[0].as_py() >= 0:
            xs = t.column("bytes").combine_chunks().flatten().to_pylist()
            place: dict[bytes, int] = {}
            which = np.array([place.setdefault(x, len(place)) for x in xs], np.int64)
            strings = list(place)
            size = np.array([len(x) for x in strings], np.int64)
            first = np.full(len(strings), np.iinfo(np.int64).max)
            np.minimum.at(first, which, doc)
            later = doc > first[which]
            s, offset, cover = repeated_in(strings, first, least)
            # each string's spans go to all places where its first document has it
            own = np.flatnonzero(~later)
            own = own[np.argsort(which[own], kind="stable")]
            lo, hi = np.searchsorted(which[own], s), np.searchsorted(which[own], s, side="right")
            n = hi - lo
            at = own[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            doc, start, length = (
                np.concatenate([doc[later], doc[at]]),
                np.concatenate([start[later], start[at] + np.repeat(offset, n)]),
                np.concatenate([size[which[later]], np.repeat(cover, n)]),
            )
        return pa.Table.from_batches([_lists(["grp", "doc", "start", "length"], group_of(doc, groups), [(doc, pa.int64()), (start, pa.int64()), (length, pa.int64())])])

    return sent.groupBy("bucket").applyInArrow(run, COVERED)


def cut(raw: bytes, start: np.ndarray, stop: np.ndarray) -> tuple[bytes, int, int]:
    """The bytes outside the spans; how many are inside, and in how many maximal runs."""
    if not len(start):
        return raw, 0, 0
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    lo, hi = start[new], np.minimum(np.append(reach[new[1:] - 1], reach[-1]), len(raw))
    kept = [raw[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)])]
    return b"".join(kept), int((hi - lo).sum()), len(lo)


CUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def deduplicated(docs: DataFrame, least: int = LEAST, whole: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes; their SHA-256 where not `whole`): of each text, as UTF-8, goes each byte that is covered
    by a string of `least` bytes that also starts in a document of a smaller doc_id. A null text is an empty one. Rows of one doc_id are taken to have
    one text, and keep it alike; a null doc_id takes no part and loses nothing; an empty table gives no rows."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("t"))
    total = own.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    buckets = max(16, math.ceil(total * 2 / (LEAST - GRAM + 2) / BUCKET))
    groups = max(9, math.ceil(total / GROUP)) | 1
    keyed = own.withColumn("key", F.xxhash64("t"))
    # all but the smallest document of each text
    slim = keyed.where(F.col("doc_id").isNotNull() & (F.length("t") >= least)).select("doc_id", "key", F.xxhash64(F.lit(1), "t").alias("key2"), F.length("t").cast("long").alias("n"))
    classes = slim.groupBy("key", "key2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")).where("m > 1")
    copies = written(slim.join(classes.drop("m"), ["key", "key2", "n"]).where("doc_id > rep").select("doc_id", "n").distinct(), "copies")
    few = copies.limit(IDS_MOST + 1).count() <= IDS_MOST
    live = own.join(F.broadcast(copies.select("doc_id")) if few else copies.select("doc_id"), "doc_id", "left_anti")
    told = written(shared(asked(keyed.select("doc_id", "key", "t"), buckets, groups, least)), "shared")
    # so few that the driver has them: each stands for LOAD_MOST stretches
    hot, begin = {}, buckets
    for r in told.where((F.col("grp") < 0) & (F.col("load") > LOAD_MOST)).select(F.col("bucket")[0].alias("b"), "load").orderBy("b").collect():
        n = math.ceil(r.load * (least - GRAM + 1) / BUCKET)
        hot[r.b], begin = (begin, n), begin + n
    spans = covered(stretches(live.withColumn("grp", group(groups)), told.where("grp >= 0"), buckets, least, hot), groups, least)
    one = lambda c: F.array(c.cast("long"))
    spans = spans.unionByName(copies.select(group(groups).alias("grp"), one(F.col("doc_id")).alias("doc"), one(F.lit(0)).alias("start"), one(F.col("n")).alias("length")))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        flat = lambda x: np.array(b.column(x).combine_chunks().flatten(), np.int64) if b.num_rows else np.zeros(0, np.int64)
        doc, start, length = flat("doc"), flat("start"), flat("length")
        order = np.argsort(doc, kind="stable")
        doc, start, length = doc[order], start[order], length[order]
        rows = []
        for d, raw in zip(a.column("doc_id").to_pylist(), a.column("t")):
            raw = raw.as_py()
            lo, hi = (np.searchsorted(doc, d), np.searchsorted(doc, d, side="right")) if d is not None else (0, 0)
            kept, gone, runs = cut(raw, start[lo:hi], start[lo:hi] + length[lo:hi])
            rows.append((d, len(raw), gone, runs, kept if whole else hashlib.sha256(kept).digest()))
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept"), zip(*rows) if rows else [()] * 5, [pa.int64()] * 4 + [pa.binary()])})

    return own.withColumn("grp", group(groups)).groupBy("grp").cogroup(spans.groupBy("grp")).applyInArrow(run, CUT)


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), whole=False).select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
