"""Line dedup: an exact set-similarity join over lines. A line's tokens are its five-word shingles; two lines match where 100 * intersection >=
80 * union of their token sets. A line that matches an earlier one, by (doc_id, place in the document), is removed.

Pass one counts tokens and finds the frequent ones, of which there are a bounded number. Pass two orders each line's tokens by rarity
(those that aren't frequent first, then by the count's magnitude; of equal ones by hash) and deals the prefix, of n - ceil(0.8 n) + 1 tokens,
to inverted lists. Equal lines are told by a sum of hashes, a bitmap and the number of tokens, and within a task already as far as it remembers them. Of a list's other lines stay those that have a partner by
the length filter, the positional filter and a filter on bitmaps (each token turns one of 32 bits, so that two sets differ in at least as many
tokens as their bitmaps in bits); they join the family of one of them. Any two lines that can match thus meet in a
family, where the sizes of intersections are counted on the full sets. A large family is cut into blocks; each block meets each once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cached, guarded, table, using, written
from .shingles import P, mixed

WIDTH, PERCENT = 5, 80
#: Frequent tokens at most; entries of one bucket of inverted lists, about.
FREQUENT_MOST, BUCKET = 50_000, 250_000
#: Lists of up to so many lines have the filters tried on all pairs, neighbours by neighbours or as a matrix; lines of a block of a family, and of small families that one task gets together.
TRIED, MATRIX, BLOCK, TOGETHER = 32, 4096, 512, 20_000
#: Tokens that a task counts at most; what it then misses of a count is one in so many of its tokens at most.
COUNTED = 4 * FREQUENT_MOST
#: Documents, and numbers of lines of them all, up to which a table of lines by doc_id is broadcast.
DOCS_MOST, LINES_MOST = 200_000, 2_000_000
#: Bytes of text that are worked on together, about.
STEP = 1 << 20
#: n and pos are told up to here; lines with more tokens pass the filters.
LONG = 32_767
#: Slots of a task's memory of lines.
SLOTS = 1 << 18
#: Lines of a step, or 2 ** 22 of them, up to which a line's number fits into a sort key.
KEYED = 1 << 22


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_bytes = mixed(np.arange(1, 257, dtype=np.uint64))
_powers = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
cached("lines", lambda: _powers.__setitem__(slice(None), [np.zeros(0, np.uint64)] * 2))


def _upto(n: int) -> list[np.ndarray]:
    """Powers of P and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((int(P), pow(int(P), -1, 1 << 64))):
            own = np.full(n, base, np.uint64)
            own[0] = 1
            _powers[k] = np.cumprod(own)
    return _powers


def _hashed(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words in buf, and their hashes: polynomials of their bytes, as differences of sums from the beginning of a block."""
    starts, hashes, at = [], [], 0
    while at < len(buf):
        stop = len(buf)
        if stop - at > STEP:  # a block ends at a blank
            back = np.flatnonzero(SPACE[buf[at + STEP // 2 : at + STEP]])
            stop = at + STEP // 2 + int(back[-1]) + 1 if len(back) else at + STEP
            while stop < len(buf) and not SPACE[buf[stop - 1]]:
                on = np.flatnonzero(SPACE[buf[stop : stop + STEP]])
                stop = stop + int(on[0]) + 1 if len(on) else min(len(buf), stop + STEP)
        part = buf[at:stop]
        turn = np.diff(SPACE[part].view(np.int8), prepend=1, append=1)
        st, en = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        power, inverse = _upto(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_bytes[part] * power[: len(part)], out=total[1:])
        starts.append(st + at)
        hashes.append(mixed((total[en] - total[st]) * inverse[st] + (en - st).astype(np.uint64)))
        at = stop
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def words(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents' texts, for each token of each line, in order of lines, the line and the hash; for each line that has words, its
    document's place in texts and its place in the document."""
    buf = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    start, h = _hashed(buf)
    counts = np.diff(np.searchsorted(start, np.flatnonzero(buf == 10)), prepend=0, append=len(start))
    each = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    some = np.flatnonzero(counts[: each.sum()] > 0)
    n = counts[some]
    owner = np.repeat(np.arange(len(texts)), each)[some]
    place = some - (np.cumsum(each) - each)[owner]
    line = np.repeat(np.arange(len(n)), n)
    ids, values = line[:0], h[:0]
    if len(h) >= width:
        m = len(h) - width + 1
        full = line[:m] == line[width - 1 :]
        acc = h[:m].copy()
        for k in range(1, width):
            acc = acc * P + h[k : m + k]
        ids, values = line[:m][full], mixed(acc[full])
    short = np.flatnonzero(n < width)  # their whole sequence is one token
    if len(short):
        begin = (np.cumsum(n) - n)[short]
        acc = h[begin].copy()
        for k in range(1, width - 1):
            more = n[short] > k
            acc[more] = acc[more] * P + h[begin[more] + k]
        ids, values = np.concatenate([ids, short]), np.concatenate([values, mixed(acc + n[short].astype(np.uint64))])
    return ids, values, owner, place


def tokens(texts: list[bytes], width: int, rank=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words(), each token of a line once, in order of (line, rank, hash); rank, below 64, is given for an array of hashes."""
    ids, values, owner, place = words(texts, width)
    if len(owner) >= KEYED:
        order = np.lexsort((values, rank(values), ids)) if rank else np.lexsort((values, ids))
        ids, values = ids[order], values[order]
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (values[1:] != values[:-1])])
        return ids[new], values[new], owner, place
    if rank is None:
        key = ids.astype(np.uint64) << np.uint64(42) | values >> np.uint64(22)
    else:
        key = ids.astype(np.uint64) << np.uint64(42) | rank(values).astype(np.uint64) << np.uint64(36) | values >> np.uint64(28)
    order = np.argsort(key)
    key, values = key[order], values[order]
    if len(key):
        same = key[1:] == key[:-1]
        if (same & (values[1:] != values[:-1])).any():  # as good as never: the hashes' other bits decide
            order = np.lexsort((values, key))
            key, values = key[order], values[order]
            same = key[1:] == key[:-1]
        new = np.concatenate([[True], ~(same & (values[1:] == values[:-1]))])
        key, values = key[new], values[new]
    return (key >> np.uint64(42)).astype(np.int64), values, owner, place


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """doc_ids and texts, some MB at a time, in order of doc_id; rows without doc_id are left out."""
    using("lines")
    rows, held = [], 0
    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            if d is None:
                continue
            raw = t.as_py() or b""
            rows.append((d, raw))
            held += len(raw)
            if held > STEP:
                rows.sort(key=lambda x: x[0])
                yield np.array([x[0] for x in rows], np.int64), [x[1] for x in rows]
                rows, held = [], 0
    if rows:
        rows.sort(key=lambda x: x[0])
        yield np.array([x[0] for x in rows], np.int64), [x[1] for x in rows]


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("b"))


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value once, with the number of its places."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))


def summed(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value once, with the sum of its n."""
    if not len(values):
        return values, n
    order = np.argsort(values, kind="stable")
    values, n = values[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(n, first)


def lowered(values: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A summary of heavy hitters (Misra-Gries): at most so many values; counts are less by what comes third, or gone where they were no more."""
    if len(n) <= most:
        return values, n, 0
    less = int(np.partition(n, len(n) - most - 1)[len(n) - most - 1])
    keep = n > less
    return values[keep], n[keep] - less, less


def frequent(docs: DataFrame, width: int = WIDTH) -> tuple[dict[int, int], int]:
    """Counts of the tokens that make at least one in FREQUENT_MOST of all, and the number of all tokens. All occurrences are counted, over all steps of a task, in summaries
    of COUNTED tokens: counts may be short by one in COUNTED of all tokens, and tokens that may be frequent are taken for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, total, short = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
        for _, texts in _steps(batches):
            _, values, _, _ = words(texts, width)
            total += len(values)
            own = counted(values)
            held, counts, less = lowered(*summed(np.concatenate([held, own[0]]), np.concatenate([counts, own[1]])), COUNTED)
            short += less
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64()), pa.array([short], pa.int64())], names=["token", "n", "short"])
        for at in range(0, len(held), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(held[part].view(np.int64)), pa.array(counts[part]), pa.array(np.zeros(len(held[part]), np.int64))], names=["token", "n", "short"])

    tokens_ = written(_slim(docs).mapInArrow(run, "token bigint, n bigint, short bigint").groupBy("token").agg(F.sum("n").alias("n"), F.sum("short").alias("short")), "tokens")
    whole = tokens_.where("token is null").agg(F.sum("n"), F.sum("short")).first()
    total, short = whole[0] or 0, whole[1] or 0
    least = max(16, math.ceil(total / FREQUENT_MOST))
    got = tokens_.where(F.col("token").isNotNull() & (F.col("n") + short >= least)).toArrow()
    return dict(zip(got.column("token").to_pylist(), got.column("n").to_pylist())), total


#: An entry of an inverted list, and rows of many.
ENTRY = np.dtype([("same", "<u8"), ("token", "<u4"), ("bits", "<u4"), ("doc", "<i8"), ("line", "<i4"), ("n", "<i2"), ("pos", "<i2")])
ENTRIES = "bucket int, entries binary"


def signed(values: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sets, each from its start in values: a sum of hashes, and the bitmap in which each value turns one bit."""
    return np.add.reduceat(mixed(values), start), np.bitwise_xor.reduceat(np.uint32(1) << (mixed(values ^ P) & np.uint64(31)).astype(np.uint32), start)


def packed(bucket: np.ndarray, cut: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket, with its entries from cut to cut; columns that aren't given are 0."""
    own = np.zeros(cut[-1], ENTRY)
    for name, values in columns.items():
        own[name] = values
    blobs = pa.Array.from_buffers(pa.large_binary(), len(bucket), [None, pa.py_buffer((cut * ENTRY.itemsize).astype(np.int64)), pa.py_buffer(own.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), blobs.cast(pa.binary())], names=["bucket", "entries"])


#: What a task remembers of a line; n is 0 in an empty slot.
SEEN = np.dtype([("same", "<u8"), ("bits", "<u4"), ("n", "<i4"), ("doc", "<i8"), ("line", "<i4")])


def remembered(seen: np.ndarray, same: np.ndarray, bits: np.ndarray, n: np.ndarray, doc: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines come later than an equal one in seen, and which are that line itself? The others are put there, in place of what had their slots:
    a line that is forgotten is met again in its lists. The number of slots is a power of two."""
    slot = (same & np.uint64(len(seen) - 1)).astype(np.int64)
    old = seen[slot]
    known = (old["same"] == same) & (old["bits"] == bits) & (old["n"] == n)
    later = known & ((doc > old["doc"]) | (doc == old["doc"]) & (line > old["line"]))
    again = known & (doc == old["doc"]) & (line == old["line"])
    put = np.flatnonzero(~(later | again))
    new = np.zeros(len(put), SEEN)
    for name, values in (("same", same), ("bits", bits), ("n", n), ("doc", doc), ("line", line)):
        new[name] = values[put]
    seen[slot[put]] = new
    return later, again


def entries(docs: DataFrame, common: dict[int, int], buckets: int, width: int, percent: int) -> DataFrame:
    """Prefix tokens, packed by batch and bucket; in a bucket below 0, one for each partition, the lines that an equal line of their task precedes.
    A line that stands everywhere is thus told to its lists about once a task."""
    keys = np.array(list(common), np.int64).view(np.uint64)
    magnitude = 1 + np.log2(np.maximum(1, np.array(list(common.values()), np.int64))).astype(np.int64)
    order = np.argsort(keys)
    keys, magnitude = keys[order], np.minimum(magnitude[order], 63)
    bits = np.zeros(1 << 20, bool)
    bits[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def rank(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        maybe = np.flatnonzero(bits[(values & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(keys, values[maybe]), len(keys) - 1)
            out[maybe] = np.where(keys[at] == values[maybe], magnitude[at], 0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = -1 - TaskContext.get().partitionId()
        seen = np.zeros(SLOTS, SEEN)
        for docs_, texts in _steps(batches):
            ids, values, owner, place = tokens(texts, width, rank if len(keys) else None)
            if not len(ids):
                continue
            n_lines = len(owner)
            n = np.bincount(ids, minlength=n_lines)
            start = np.cumsum(n) - n
            same, map_ = signed(values, start)
            order = np.lexsort((np.arange(n_lines), map_, same))  # lines come in order of (doc_id, place)
            twin = np.concatenate([[False], (same[order][1:] == same[order][:-1]) & (map_[order][1:] == map_[order][:-1]) & (n[order][1:] == n[order][:-1])])
            first = order[np.maximum.accumulate(np.where(twin, 0, np.arange(n_lines)))]
            other = (docs_[owner[order]] != docs_[owner[first]]) | (place[order] != place[first])  # a row that comes again is no other line
            out = np.zeros(n_lines, bool)
            out[order[twin]] = True
            gone = np.zeros(n_lines, bool)
            gone[order[twin & other]] = True
            live = np.flatnonzero(~out)
            later, again = remembered(seen, same[live], map_[live], n[live], docs_[owner[live]], place[live])
            out[live[later | again]] = True
            gone[live[later]] = True
            pos = np.arange(len(values)) - start[ids]
            prefix = n - (percent * n + 99) // 100 + 1
            keep = np.flatnonzero((pos < prefix[ids]) & ~out[ids])
            ids, values, pos = ids[keep], values[keep], pos[keep]
            bucket = (values % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ids, values, pos, bucket = ids[order], values[order], pos[order], bucket[order]
            own, first = np.unique(bucket, return_index=True)
            rest = (values // np.uint64(buckets)).astype(np.uint32)
            cut = np.append(first, len(bucket))
            yield packed(own, cut, same=same[ids], token=rest, bits=map_[ids], doc=docs_[owner[ids]], line=place[ids], n=np.minimum(n[ids], LONG), pos=np.minimum(pos, LONG))
            if gone.any():
                yield packed(np.array([apart]), np.array([0, gone.sum()]), doc=docs_[owner[gone]], line=place[gone])

    return _slim(docs).mapInArrow(run, ENTRIES)


#: Without ydoc: the line x is removed; with it: x is in the family of y.
JOINED = "xdoc bigint, xline int, ydoc bigint, yline int"


def fits(nx, ny, px, py, bx, by, percent: int):
    """Length filter, positional filter and bitmap filter: what is common can still reach the share."""
    need = -(-percent * (nx + ny) // (100 + percent))
    good = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (np.minimum(px, py) + np.minimum(nx - px, ny - py) >= need)
    return good & (np.bitwise_count(bx ^ by) + 2 * need <= nx + ny) | (nx >= LONG) | (ny >= LONG)


def partnered(n: np.ndarray, pos: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Which lines of one list have a partner by the filters?"""
    out = np.zeros(len(n), bool)
    for a in range(0, len(n), BLOCK):
        x = slice(a, a + BLOCK)
        y = slice(a, len(n))  # pairs before were tried from the other side
        ok = fits(n[x, None], n[None, y], pos[x, None], pos[None, y], bits[x, None], bits[None, y], percent)
        at = np.arange(ok.shape[0])
        ok[at, at] = False
        out[x] |= ok.any(1)
        out[y] |= ok.any(0)
    return out


def sorted_by(key: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """An order by key, and by (doc, line) where keys are equal."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    own = order[tied]
    order[tied] = own[np.lexsort((line[own], doc[own], key[own]))]
    return order


def joined(packed: DataFrame, percent: int) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        using("lines")
        got = np.frombuffer(b"".join(x.as_py() for x in t.column("entries")), ENTRY)
        doc, line = got["doc"].copy(), got["line"].copy()
        if t.column("bucket")[0].as_py() < 0:
            gone, x, y = np.arange(len(doc)), np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            token, n, pos, same, bits = got["token"].copy(), got["n"].astype(np.int64), got["pos"].astype(np.int64), got["same"].copy(), got["bits"].copy()
            order = sorted_by(token.astype(np.uint64) << np.uint64(32) | same >> np.uint64(32), doc, line)
            # equal sets, by sum, bitmap, number and place in order; the later ones go, and the first stands for them; what a collision parts goes the way of the others
            twin = np.concatenate([[False], np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in (token, same, bits, n, pos)])])
            first = order[np.maximum.accumulate(np.where(twin, 0, np.arange(len(order))))]
            gone = order[twin & (pos[order] == 0) & ((doc[order] != doc[first]) | (line[order] != line[first]))]
            rest = order[~twin]
            first = np.flatnonzero(np.concatenate([[True], token[rest][1:] != token[rest][:-1]]))
            size = np.diff(np.append(first, len(rest)))
            some = size > 1
            rest, size = rest[np.repeat(some, size)], size[some]
            group = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(rest)) - (np.cumsum(size) - size)[group]
            stays = np.repeat(size > MATRIX, size)
            for d in range(1, min(int(size.max(initial=0)), TRIED)):
                ok = np.flatnonzero((place >= d) & (size <= TRIED)[group])
                fit = ok[fits(n[rest[ok]], n[rest[ok - d]], pos[rest[ok]], pos[rest[ok - d]], bits[rest[ok]], bits[rest[ok - d]], percent)]
                stays[fit] = stays[fit - d] = True
            begin = np.cumsum(size) - size
            for k in np.flatnonzero((size > TRIED) & (size <= MATRIX)):
                one = slice(begin[k], begin[k] + size[k])
                stays[one] = partnered(n[rest[one]], pos[rest[one]], bits[rest[one]], percent)
            rest, group = rest[stays], group[stays]
            head = np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]
            x, y = rest, rest[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(rest) else rest
            x, y = x[~head], y[~head]
            new = np.unique(np.stack([doc[x], line[x], doc[y], line[y]]), axis=1, return_index=True)[1] if len(x) else x
            x, y = x[new], y[new]
        none = pa.nulls(len(gone))
        return pa.concat_tables([
            pa.table([pa.array(doc[gone], pa.int64()), pa.array(line[gone], pa.int32()), none.cast(pa.int64()), none.cast(pa.int32())], names=["xdoc", "xline", "ydoc", "yline"]),
            pa.table([pa.array(doc[x], pa.int64()), pa.array(line[x], pa.int32()), pa.array(doc[y], pa.int64()), pa.array(line[y], pa.int32())], names=["xdoc", "xline", "ydoc", "yline"]),
        ])

    return packed.groupBy("bucket").applyInArrow(run, JOINED)


def matched(ids: np.ndarray, values: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of b match one of a before them? Sets are numbered in order; ids has the set of each value."""
    m = int(max(a.max(), b.max())) + 1
    n = np.bincount(ids, minlength=m)
    own, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    column = (np.cumsum(count > 1) - 1)[inverse]
    more = count[inverse] > 1
    row, column = ids[more], column[more]
    inter = np.zeros((len(a), len(b)), np.float32)
    for begin in range(0, int(column.max(initial=-1)) + 1, 8192):
        part = (column >= begin) & (column < begin + 8192)
        x = np.zeros((m, min(8192, int(column.max()) + 1 - begin)), np.float32)
        x[row[part], column[part] - begin] = 1
        inter += x[a] @ x[b].T
    inter = inter.astype(np.int64)
    good = (100 * inter >= percent * (n[a][:, None] + n[b][None] - inter)) & (inter > 0) & (a[:, None] < b[None])
    return b[good.any(0)]


def small(by_doc: DataFrame, lines: str) -> bool:
    """May a table of lines by doc_id be broadcast?"""
    docs, n = by_doc.agg(F.count(F.lit(1)), F.sum(F.size(lines))).first()
    return docs <= DOCS_MOST and (n or 0) <= LINES_MOST


def verified(edges: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(xdoc, xline) of the lines that match an earlier one of a family. edges: x is in the family of y."""
    x, y = F.struct(F.col("xdoc").alias("d"), F.col("xline").alias("l")), F.struct(F.col("ydoc").alias("d"), F.col("yline").alias("l"))
    edges = written(edges.distinct().select(x.alias("x"), y.alias("y")), "edges")
    sizes = edges.groupBy("y").agg((F.count(F.lit(1)) + 1).alias("m"))
    edges = written(edges.unionByName(sizes.select(F.col("y").alias("x"), "y")).join(sizes, "y"), "families")
    needed = written(edges.select("x").distinct().groupBy(F.col("x.d").alias("d")).agg(F.collect_list("x.l").alias("ls")), "needed")
    few = small(needed, "ls")
    text = _slim(docs)
    split = F.split(F.col("b").cast("string"), "\n")
    lines = text.join(F.broadcast(needed) if few else needed, text.doc_id == F.col("d")).select("d", F.explode(F.arrays_zip(F.col("ls").alias("l"), F.transform("ls", lambda k: F.element_at(split, k + 1)).alias("t"))).alias("e")).select(F.struct(F.col("d"), F.col("e.l").alias("l")).alias("x"), F.col("e.t").cast("binary").alias("t"))
    rows = edges.count()
    together = max(8, math.ceil(rows / TOGETHER))
    own = edges.join(lines, "x")
    blocks = F.when(F.col("m") <= 2 * BLOCK, F.lit(0)).otherwise(F.ceil(F.col("m") / BLOCK)).cast("int")
    own = own.withColumn("blocks", blocks).withColumn("s", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64("x"), F.col("blocks"))).otherwise(0).cast("int"))
    meets = F.when(F.col("blocks") == 0, F.array(F.struct(F.pmod(F.xxhash64("y"), F.lit(together)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.xxhash64("y").alias("g"), F.least("s", o).alias("i"), F.greatest("s", o).alias("j")))
    )
    dealt = own.select(F.explode(meets).alias("e"), "s", "x", "y", "t").select("e.g", "e.i", "e.j", "s", F.col("x.d").alias("xdoc"), F.col("x.l").alias("xline"), F.col("y.d").alias("ydoc"), F.col("y.l").alias("yline"), "t")

    def compare(t: pa.Table) -> pa.Table:
        using("lines")
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        xd, xl, yd, yl, s = (np.array(t.column(c)) for c in ("xdoc", "xline", "ydoc", "yline", "s"))
        order = np.lexsort((xl, xd, yl, yd))
        again = np.concatenate([[False], (np.diff(xd[order]) == 0) & (np.diff(xl[order]) == 0) & (np.diff(yd[order]) == 0) & (np.diff(yl[order]) == 0)])
        order = order[~again]  # of repeated rows
        xd, xl, yd, yl, s = xd[order], xl[order], yd[order], yl[order], s[order]
        texts = [t.column("t")[int(k)].as_py() for k in order]
        ids, values, owner, _ = tokens(texts, width)  # each is one line
        ids = owner[ids]
        heads = np.append(np.flatnonzero(np.concatenate([[True], (yd[1:] != yd[:-1]) | (yl[1:] != yl[:-1])])), len(yd))
        cut = np.searchsorted(ids, heads)
        out = []
        for lo, hi, p, q in zip(heads[:-1], heads[1:], cut[:-1], cut[1:]):
            a = b = np.arange(hi - lo)
            if i >= 0 and i != j:
                a, b = np.flatnonzero(s[lo:hi] == i), np.flatnonzero(s[lo:hi] == j)
                if len(a) and len(b):
                    out += [matched(ids[p:q] - lo, values[p:q], a, b, percent) + lo, matched(ids[p:q] - lo, values[p:q], b, a, percent) + lo]
            else:
                out.append(matched(ids[p:q] - lo, values[p:q], a, b, percent) + lo)
        hit = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return pa.table({"xdoc": pa.array(xd[hit], pa.int64()), "xline": pa.array(xl[hit], pa.int32())})

    return dealt.groupBy("g", "i", "j").applyInArrow(compare, "xdoc bigint, xline int")


def removed(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, lines): places of the lines that match an earlier one; only documents that have any."""
    common, total = frequent(docs, width)
    buckets = max(16, math.ceil(total * (1 - percent / 100) / BUCKET))
    got = written(joined(entries(docs, common, buckets, width, percent), percent), "joined")
    gone = got.where("ydoc is null").select("xdoc", "xline")
    gone = gone.unionByName(verified(got.where("ydoc is not null"), docs, width, percent))
    return gone.groupBy(F.col("xdoc").alias("doc_id")).agg(F.sort_array(F.collect_set("xline")).alias("lines"))


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs without lines that match an earlier line, with `n_lines` and `n_removed`. Lines are parted by line feeds; blank ones stay. No
    document goes: where all lines go, the text is empty. A null text stays null; rows of a null doc_id stay as they are and no line is
    matched with theirs; rows of one doc_id are taken to have one text, and lose alike; an empty table gives no rows."""
    own = written(removed(docs, width, percent).select(F.col("doc_id").alias("_doc"), F.col("lines").alias("_lines")), "removed")
    few = small(own, "_lines")
    out = docs.join(F.broadcast(own) if few else own, docs.doc_id == own._doc, "left").drop("_doc")
    split = F.split("text", "\n")
    kept = F.when(F.col("_lines").isNull(), F.col("text")).otherwise(F.array_join(F.filter(split, lambda _, i: ~F.array_contains("_lines", i)), "\n"))
    return out.select(*[kept.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"), F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_removed"))


def cleaned(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """deduplicated() with the columns of docs alone, whatever their names."""
    return guarded(docs, ["doc_id", "text"], lambda d: deduplicated(d, width, percent))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
