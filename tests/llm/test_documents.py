"""Operators on documents against brute force, and on odd input."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import cases
from cloneforge.llm import decontamination, lines, minhash, packing, quality, repeats, sharding


def shingles(text, width):
    w = text.encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def alike(a, b):
    both = len(a & b)
    return both > 0 and 100 * both >= 80 * (len(a) + len(b) - both)


# --- sharding


def test_sharding(spark):
    docs = cases.documents(spark, [f"t{k}" for k in range(3000)] + ["same"] * 1000)
    rows = sharding.shard_documents(docs).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
        assert r.size == len(r and (f"t{r.doc_id}" if r.doc_id < 3000 else "same")) + 1
        assert r.text_crc32 == zlib.crc32((f"t{r.doc_id}" if r.doc_id < 3000 else "same").encode())
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) < 1.5 * min(map(len, by.values()))
    assert 100 < sum(r.grown_shard == 16 for r in rows) < 400


def test_weights(spark):
    got = sharding.assign(spark.range(8000).withColumnRenamed("id", "doc_id"), ["doc_id"], [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    n = {r.shard: r["count"] for r in got}
    assert set(n) == {0, 1} and 2.6 < n[1] / n[0] < 3.4
    with pytest.raises(ValueError):
        sharding.rendezvous([F.lit(1)], [0.0])


def test_sharding_odd(spark):
    rows = sharding.shard_documents(cases.odd(spark)).collect()
    assert len(rows) == 8 and len({(r.shard, r.slot) for r in rows}) == 8
    assert next(r for r in rows if r.doc_id == 0).size == 1
    assert sharding.shard_documents(cases.empty(spark)).count() == 0


# --- packing


def unpacked(docs, length, path=None):
    import pandas as pd

    pieces = packing.pack(docs, path, length).toPandas()
    assert (pieces.offset + pieces.length <= length).all()
    at = sorted((r.sequence_id * length + r.offset, r.length) for r in pieces.itertuples())
    assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:]))
    out = collections.defaultdict(list)
    for r in pieces.sort_values(["doc_id", "start"]).itertuples():
        out[None if pd.isna(r.doc_id) else int(r.doc_id)].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    return pieces, out


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_packing_round_trip(spark, name):
    from tokenizers import Tokenizer

    path = packing.vocabulary(name)
    tok = Tokenizer.from_file(path)
    assert packing.by_words(path) == (name == "word_bpe_49k.json")
    texts = [*cases.corpus(3, 40), "Don't STOP. naïve ﬁne Ünïcode ΣΑΣ x² 12.5 <|endoftext|> 日本語。", "\x1c a\tb\r\nc\x0b  d", None, ""]
    _, out = unpacked(cases.documents(spark, texts), 16, path)
    for k, t in enumerate(texts):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert [x for _, ids, _ in out[k] for x in ids] == want
        assert all(n == len(want) for _, _, n in out[k]) and out[k][0][0] == 0


def test_packing_digest_and_odd(spark):
    docs = cases.odd(spark)
    pieces = packing.digest(packing.pack(docs)).collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    assert [r.ids_crc32 for r in pieces if r.doc_id == 0] == [zlib.crc32(np.array([2], "<u4").tobytes())]
    assert packing.pack(cases.empty(spark)).count() == 0


def test_very_long_text_is_encoded_in_steps(monkeypatch):
    enc = packing.encoder(packing.vocabulary())
    text = " ".join(f"word{k}" for k in range(2000))
    whole = enc.ids(text)
    monkeypatch.setattr(packing, "STEP", 100)
    assert enc.ids(text) == whole


# --- quality


def junk(k):
    return f"BUY NOW!! {k} " * 20


def test_quality(spark):
    rng = __import__("random").Random(4)
    good = [". ".join(cases.sentence(rng, 9, 4000) for _ in range(5)) for _ in range(200)]
    docs = cases.documents(spark, [x for k, g in enumerate(good) for x in (g, junk(k))])
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    got = quality.scored(docs, labels).select("doc_id", "score", quality.held_out().alias("h")).collect()
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.h]
    assert 50 < len(held) < 150 and all((r.score >= 0.7) == (r.doc_id % 2 == 0) for r in held)
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    # labels of held-out rows are not looked at
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.scored(docs, turned).collect()} == {r.doc_id: r.score for r in got}
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id % 2 = 1").count() == 0


def test_quality_by_share(spark):
    """The threshold is a quantile of the strengths of all documents, labelled or not, and the same however they are dealt."""
    rng = __import__("random").Random(5)
    docs = cases.documents(spark, [x for _ in range(100) for x in (". ".join(cases.sentence(rng, 9, 4000) for _ in range(rng.randrange(2, 7))), junk(rng.randrange(99)) + cases.sentence(rng, 5), junk(3) + cases.sentence(rng, 8), "")])
    labels = docs.where("doc_id % 4 < 2").select("doc_id", (1 - F.col("doc_id") % 4).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    strong = quality.strengths(docs.select("text"), quality.learned(docs, labels)[0]).toPandas()["strength"]
    for share in (0.05, 0.2, 0.6):
        got = quality.scored(docs, labels, share).toPandas()
        up = got["score"] >= quality.GOOD
        assert abs(up.sum() - share * 400) <= (strong == strong.quantile(1 - share)).sum() + 8
        assert quality.accepted(docs, labels, share).count() == up.sum()
    one = quality.scored(docs.coalesce(1), labels).orderBy("doc_id").collect()
    assert one == quality.scored(docs.repartition(9), labels).orderBy("doc_id").collect()
    slim = quality.scored(docs, labels, keep_text=False)
    assert slim.columns == [c for c in docs.columns if c != "text"] + ["score"] and {r.doc_id: r.score for r in slim.collect()} == {r.doc_id: r.score for r in one}


def test_quality_weights():
    """Against a fit by plain loops: of the logistic loss over the same pairs, no other weights have less."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = (x @ [1.0, -2.0, 0.3] + rng.normal(size=60) > 0).astype(int)
    model = quality.fit(x, y)
    z = [[float(v) for v in row] for row in quality.expanded((x - model.mean) / model.scale)]
    pairs = list(zip(*(p.tolist() for p in quality.drawn(y))))
    assert all(y[a] == 1 and y[b] == 0 for a, b in pairs) and len(pairs) == y.sum() * (60 - y.sum())

    def loss(w):
        s = [sum(a * b for a, b in zip(row, w)) for row in z]
        return sum(math.log1p(math.exp(s[b] - s[a])) for a, b in pairs) / len(pairs) + quality.RIDGE / 2 * sum(v * v for v in w)

    w = [0.0] * 9
    for _ in range(400):  # gradient descent, pair by pair
        s = [sum(a * b for a, b in zip(row, w)) for row in z]
        grad = [quality.RIDGE * v for v in w]
        for a, b in pairs:
            p = 1 / (1 + math.exp(s[a] - s[b])) / len(pairs)
            for k in range(9):
                grad[k] -= p * (z[a][k] - z[b][k])
        w = [v - 0.7 * g for v, g in zip(w, grad)]
    own = [float(v) for v in model.weights]
    assert loss(own) <= loss(w) <= loss(own) + 5e-3
    for k in range(9):
        for step in (0.01, -0.01):
            assert loss([v + step * (i == k) for i, v in enumerate(own)]) > loss(own)


def test_quality_odd(spark):
    docs = cases.odd(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.scored(docs, none).collect()} == {quality.GOOD}
    assert quality.accepted(docs, none).columns == docs.columns and quality.accepted(docs, none).count() == 8
    some = spark.createDataFrame([(k, k % 2, None) for k in range(7)] + [(None, 1, 0), (3, None, 1)], "doc_id bigint, quality int, toxic int")
    assert quality.scored(docs, some).count() == 8
    assert quality.scored(cases.empty(spark), some).count() == 0
    assert quality.features("") == [0.0] * len(quality.NAMES) and len(quality.features("a b")) == len(quality.NAMES)


# --- near duplicates


def brute_components(texts, width):
    sets = [shingles(t or "", width) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if alike(sets[a], sets[b]) and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize(("width", "seed"), [(2, 1), (5, 2), (1, 3)])
def test_near_duplicates(spark, width, seed):
    texts = cases.corpus(seed, 90)
    comps, sizes = brute_components(texts, width)
    got = {r.doc_id: r for r in minhash.near_duplicates(cases.documents(spark, texts), width).collect()}
    assert [(got[k].component_id, got[k].n_shingles, got[k].kept) for k in range(len(texts))] == [(c, n, c == k) for k, (c, n) in enumerate(zip(comps, sizes))]


@pytest.mark.parametrize("tried", [32, 1])
def test_near_duplicates_of_a_family(spark, monkeypatch, tried):
    """One family whose members are alike to some of the others only, told by lists of rare shingles, and compared in several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "TRIED", tried)
    rng = __import__("random").Random(9)
    base = cases.sentence(rng, 120, 9999).split(" ")
    texts = []
    for _ in range(50):
        w = list(base)
        for _ in range(rng.randrange(3, 14)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(9999)}"
        texts.append(" ".join(w))
    comps, _ = brute_components(texts, 2)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(cases.documents(spark, texts), 2).collect()}
    assert [got[k] for k in range(50)] == comps and len(set(comps)) > 1


def test_pages_of_one_template_that_are_not_alike_meet_nowhere(spark, monkeypatch):
    rng = random.Random(10)
    base = cases.sentence(rng, 75, 99999)
    texts = [base + " " + " ".join(f"p{k}w{i}" for i in range(24)) for k in range(400)] + [cases.sentence(rng, 100, 99999)]
    texts.append(texts[7] + " end")
    pairs, blocks = [], []
    one, other = minhash.estimated, minhash.leftover
    monkeypatch.setattr(minhash, "estimated", lambda p, *rest: pairs.append(p.count()) or one(p, *rest))
    monkeypatch.setattr(minhash, "leftover", lambda *a: blocks.append(a) or other(*a))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(cases.documents(spark, texts), 2).collect()}
    assert got == {k: 7 if k == 401 else k for k in range(402)}
    # lists of neighbours pair each with the first alone, those of rare shingles pair what is alike
    assert len(pairs) == 2 and pairs[0] < 64 * len(texts) and pairs[1] <= 2 and not blocks


def test_near_duplicates_odd(spark):
    docs = cases.odd(spark)
    got = minhash.near_duplicates(docs.select("doc_id", "text"), 5).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.component_id, r.kept))
    assert len(got) == 8 and by == {0: {(0, True)}, 1: {(1, True)}, 2: {(2, True)}, 3: {(3, True)}, None: {(None, True)}, 5: {(5, True)}, 6: {(2, False)}}
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    assert minhash.deduplicated(cases.empty(spark)).count() == 0


# --- line dedup


def brute_lines(texts, width=5):
    seen, out = [], []
    for t in texts:
        kept, gone = [], 0
        for line in (t or "").split("\n"):
            s = shingles(line, width)
            if s and any(alike(s, x) for x in seen):
                gone += 1
            else:
                kept.append(line)
            if s:
                seen.append(s)
        out.append((gone, "\n".join(kept)))
    return out


@pytest.mark.parametrize(("width", "block"), [(5, 512), (1, 4)])
def test_lines(spark, monkeypatch, width, block):
    monkeypatch.setattr(lines, "BLOCK", block)
    monkeypatch.setattr(lines, "TRIED", 4)
    texts = cases.corpus(5, 120)
    got = {r.doc_id: (r.n_removed, r.text) for r in lines.deduplicated(cases.documents(spark, texts), width).collect()}
    assert [got[k] for k in range(len(texts))] == brute_lines(texts, width)


def test_frequent_tokens_that_come_once_a_step(spark, monkeypatch):
    # each document is a step of its own, and each says the same line once
    monkeypatch.setattr(lines, "STEP", 1)
    docs = cases.documents(spark, [f"a b c d e\nown{k} b{k} c{k} d{k} e{k}" for k in range(40)])
    got, total = lines.frequent(docs.coalesce(1), 5)
    assert list(got.values()) == [40] and total == 80
    monkeypatch.setattr(lines, "COUNTED", 3)
    few, total = lines.frequent(docs.coalesce(1), 5)
    assert total == 80 and max(few.values()) >= 40 - 80 // 4


@pytest.mark.parametrize(("tried", "matrix"), [(2, 4096), (32, 4096), (2, 3)])
def test_lines_by_each_way_of_filtering(spark, monkeypatch, tried, matrix):
    monkeypatch.setattr(lines, "TRIED", tried)
    monkeypatch.setattr(lines, "MATRIX", matrix)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(30)]
    texts = []
    for _ in range(80):  # one family whose lines differ in up to five words
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(30)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(own) + "\n" + cases.sentence(rng, 8))
    got = {r.doc_id: (r.n_removed, r.text) for r in lines.deduplicated(cases.documents(spark, texts).repartition(5), 1).collect()}
    assert [got[k] for k in range(len(texts))] == brute_lines(texts, 1)


def test_lines_whose_sums_of_hashes_collide(spark, monkeypatch):
    # the bitmap, the number of tokens and the place in the order still tell them apart
    one = lines.signed
    monkeypatch.setattr(lines, "signed", lambda values, start: (one(values, start)[0] * 0, one(values, start)[1]))
    texts = cases.corpus(8, 120)
    got = {r.doc_id: (r.n_removed, r.text) for r in lines.deduplicated(cases.documents(spark, texts).coalesce(1), 2).collect()}
    assert [got[k] for k in range(len(texts))] == brute_lines(texts, 2)


def test_lines_remembered():
    """Against a dictionary of what each slot holds."""
    rng = np.random.default_rng(5)
    seen, own = np.zeros(16, lines.SEEN), {}
    for step in range(200):
        same = rng.choice(np.arange(1, 40, dtype=np.uint64), 12, replace=False)
        bits, n = (same % np.uint64(3)).astype(np.uint32), 1 + (same % np.uint64(5)).astype(np.int64)
        doc, line = rng.integers(-4, 5, 12), rng.integers(0, 4, 12)
        later, again = lines.remembered(seen, same, bits, n, doc, line)
        before = dict(own)
        for k in range(12):
            slot, key, at = int(same[k]) % 16, int(same[k]), (doc[k], line[k])
            held = before.get(slot)
            assert later[k] == (held is not None and held[0] == key and at > held[1])
            assert again[k] == (held is not None and held == (key, at))
            if not later[k] and not again[k]:
                own[slot] = (key, at)
    assert {(int(s["same"]), int(s["doc"]), int(s["line"])) for s in seen if s["n"]} == {(k, *at) for k, at in own.values()}


def test_lines_over_steps(spark):
    """One task, several steps: lines of earlier steps come again, earlier and later ones of them, and rows that come twice."""
    rng = random.Random(6)
    pool = [" ".join(f"w{rng.randrange(50_000)}" for _ in range(40)) for _ in range(9_000)]
    texts = ["\n".join(rng.choice(pool) for _ in range(1_500)) for _ in range(16)]
    order = list(range(16))
    rng.shuffle(order)
    schema = "doc_id bigint, text string"
    docs = spark.createDataFrame([(d, texts[d]) for d in order + order[:3]], schema).coalesce(1)
    met, want = set(), {}
    for d in range(16):
        kept = []
        for t in texts[d].split("\n"):
            if t not in met:
                kept.append(t)
            met.add(t)
        want[d] = "\n".join(kept)
    got = lines.deduplicated(docs).collect()
    assert len(got) == 19 and all(r.text == want[r.doc_id] for r in got)


def test_more_lines_in_a_step_than_a_sort_key_tells(monkeypatch):
    n = (1 << 22) + 10
    ids, values, owner, _ = lines.tokens([b"a b\n" * n], 2)
    assert len(owner) == n and (ids == np.arange(n)).all() and (values == values[0]).all()
    texts = [t.encode() for t in cases.corpus(3, 80)]
    whole = lines.tokens(texts, 2)
    monkeypatch.setattr(lines, "KEYED", 1)
    assert all((np.sort(a) == np.sort(b)).all() for a, b in zip(whole, lines.tokens(texts, 2)))


def test_tables_of_lines_that_are_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lines, "LINES_MOST", 1)
    texts = cases.corpus(6, 60)
    out = lines.deduplicated(cases.documents(spark, texts), 2)
    assert [(r.n_removed, r.text) for r in out.orderBy("doc_id").collect()] == brute_lines(texts, 2)


def test_lines_odd(spark):
    docs = cases.odd(spark)
    out = lines.cleaned(docs)
    assert out.columns == docs.columns
    got = collections.defaultdict(set)
    for r in out.collect():
        got[r.doc_id].add(r.text)
    assert got[0] == {None} and got[1] == {""} and got[3] == {"one two three four five six"} and got[None] == {"one two three four five six"}
    assert got[6] == {""} and len(next(iter(got[2]))) > 100_000 and got[5] == {"  \n \n"}
    assert lines.cleaned(cases.empty(spark)).count() == 0


def test_words_over_blocks(monkeypatch):
    texts = [b"alpha beta " * 50 + b"x" * 300, b"\n\nGamma\xc3\xa9 delta\n", b""]
    whole = lines.words(texts, 2)
    monkeypatch.setattr(lines, "STEP", 64)
    assert all((a == b).all() for a, b in zip(whole, lines.words(texts, 2)))


# --- benchmark decontamination

W7 = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words7(t):
    return W7.findall(bytes(x + 32 if 65 <= x <= 90 else x for x in t.encode()))


def brute_hits(texts, items, window=10):
    windows = collections.defaultdict(set)
    for key, t in items:
        w = words7(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1):
            if n:
                windows[tuple(w[k : k + n])].add(str(key))
    out = []
    for t in texts:
        w, hit, met = words7(t or ""), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    met |= found
        out.append((len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [1 << 20, 300])
def test_decontamination(spark, shard):
    rng = __import__("random").Random(6)
    items = [(k, cases.sentence(rng, n, 30)) for k, n in enumerate((30, 12, 10, 9, 3, 1, 25))] + [(9, "w1 w2 w1 w2 w1 w2 w1 w2 w1 w2 w1 w2"), (10, "")]
    texts = [cases.sentence(rng, 60, 30) for _ in range(40)]
    for k, (_, t) in enumerate(items):
        texts.append(cases.sentence(rng, 5, 30) + ", " + t.upper().replace(" ", "-") + "! " + cases.sentence(rng, 4, 30))
    texts += ["w1 w2 " * 20, "É" + items[1][1], None, ""]
    bench = spark.createDataFrame(items + [(11, None), (1, items[1][1])], "item_id bigint, text string")
    got = decontamination.digest(decontamination.found(cases.documents(spark, texts), bench, shard_bytes=shard).drop("text")).collect()
    by = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got}
    assert [by[k] for k in range(len(texts))] == brute_hits(texts, items)


def test_only_likely_documents_meet_several_automata(spark):
    items = [[("1", b"a b c d e f g h i j k")], [("2", b"l m n o p q r s t u v w")]]
    texts = ["x y a b c d e f g h i j z", "a b c d e f g h i", "k j i h g f e d c b a " * 9, "l m n o p q r s t u", None]
    docs = cases.documents(spark, texts).selectExpr("doc_id as _row", "text")
    got = {r._row: (r.n_words, r.text is not None) for r in decontamination._likely(docs, items, 10).collect()}
    assert got == {0: (13, True), 1: (9, False), 2: (99, False), 3: (10, True), 4: (0, False)}


def test_decontamination_cuts(spark):
    passage = " ".join(f"q{k}" for k in range(12))
    docs = cases.documents(spark, [f"Before, {passage.upper()}! after. " + "more words here " * 5, passage, "clean text"])
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    got = {r.doc_id: r.text for r in decontamination.clean(docs, bench).collect()}
    assert got == {0: "Before, ! after. " + "more words here " * 5, 2: "clean text"}


def test_decontamination_odd(spark):
    bench = spark.createDataFrame([(None, "one two three four five six"), (2, None)], "item_id bigint, text string")
    docs = cases.odd(spark)
    out = decontamination.clean(docs, bench)
    assert out.columns == docs.columns and out.count() == 5
    none = bench.limit(0)
    assert decontamination.clean(docs, none).count() == 8 and decontamination.clean(cases.empty(spark), bench).count() == 0


def test_automaton():
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 3, n).tolist() for n in (12, 9, 1, 15)]
    auto = decontamination.Automaton(seqs)
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    stream = rng.integers(0, 4, 300).tolist()
    want = [max((n for n in range(1, i + 2) if tuple(stream[i + 1 - n : i + 1]) in subs), default=0) for i in range(len(stream))]
    assert auto.lengths(stream) == want


# --- repeats


def brute_repeats(rows, least):
    """(n_bytes, n_removed, n_spans, kept) of texts in order of id."""
    out, seen = {}, set()
    for d, t in sorted(rows):
        b = (t or "").encode()
        hit, own = [False] * len(b), set()
        for k in range(len(b) - least + 1):
            w = b[k : k + least]
            own.add(w)
            if w in seen:
                hit[k : k + least] = [True] * least
        seen |= own
        out[d] = (len(b), sum(hit), sum(h and (k == 0 or not hit[k - 1]) for k, h in enumerate(hit)), bytes(x for x, h in zip(b, hit) if not h))
    return out


@pytest.mark.parametrize(("step", "most"), [(1 << 20, 1 << 20), (333, 20), (1 << 20, 0)])
def test_repeats(spark, monkeypatch, step, most):
    monkeypatch.setattr(repeats, "STEP", step)
    monkeypatch.setattr(repeats, "LOAD_MOST", most)
    texts = cases.corpus(8, 100) + ["ab" * 60, "ab" * 70, "aa" * 50, "é" * 80, "é" * 30]
    want = brute_repeats(list(enumerate(texts)), 50)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.deduplicated(cases.documents(spark, texts)).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 1000


def test_a_passage_in_many_surroundings(spark, monkeypatch):
    # one anchor, and nearly as many different stretches as documents: its windows are spread over buckets
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh") for _ in range(62))
    own = lambda: "".join(rng.choice("ijklmnopqrstuvwxyz") for _ in range(90))
    texts = [own() + passage + own() for _ in range(300)]
    monkeypatch.setattr(repeats, "LOAD_MOST", 100)
    monkeypatch.setattr(repeats, "BUCKET", 500)
    monkeypatch.setattr(repeats, "GROUP", 5000)
    sizes = []
    one = repeats.covered
    monkeypatch.setattr(repeats, "covered", lambda sent, groups, least: sizes.extend(r.n for r in sent.where("bucket >= 0").groupBy("bucket").agg(F.sum(F.size("doc")).alias("n")).collect()) or one(sent, groups, least))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.deduplicated(cases.documents(spark, texts).repartition(4)).collect()}
    assert got == brute_repeats(list(enumerate(texts)), 50)
    assert max(sizes) < 1500 and len(sizes) > 13


def test_repeats_odd(spark):
    docs = cases.odd(spark)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.deduplicated(docs).collect()]
    n = next(x[1] for x in got if x[0] == 2)
    assert len(got) == 8 and (6, n, n, 1) in got and all(x[2] == 0 for x in got if x[0] != 6) and (0, 0, 0, 0) in got
    assert repeats.deduplicated(cases.empty(spark)).count() == 0


def test_maximal_repeats():
    """All occurrences of each repeat that can't be longer on either side."""
    rng = np.random.default_rng(5)
    strings = [bytes(rng.integers(97, 99, n).tolist()) for n in (40, 25, 33)]
    buf = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    begins = ends - [len(s) for s in strings]
    least = 6
    start = np.concatenate([np.arange(b, e - least + 1) for b, e in zip(begins, ends)])
    which = np.searchsorted(ends, start, side="right")
    order, found = repeats.maximal_repeats(buf, start, begins[which], ends[which], least)
    got = set()
    for length, lo, hi in found:
        places = start[order[lo : hi + 1]]
        assert len({bytes(buf[p : p + length]) for p in places}) == 1
        got.add((bytes(buf[places[0] : places[0] + length]), tuple(sorted(places.tolist()))))
    want = set()
    for n in range(least, 41):
        by = collections.defaultdict(list)
        for b, e in zip(begins, ends):
            for p in range(b, e - n + 1):
                by[bytes(buf[p : p + n])].append((p, b, e))
        for s, at in by.items():
            left = {int(buf[p - 1]) if p > b else -p - 1 for p, b, _ in at}
            right = {int(buf[p + n]) if p + n < e else -p - 1 for p, _, e in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((s, tuple(p for p, _, _ in at)))
    assert got == want
