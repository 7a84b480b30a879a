"""The jobs, by brute force, over tables that grow, and from the command line."""

import collections
import json
import logging
import os
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloneforge.operators import distance
from jobs import common, new_cells, word_numbers

ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VECTORS = "vec_id bigint, embedding array<float>, label int"


def half_even(x):
    return int(np.round(x))


def texts(seed, n, sources=4):
    rng = random.Random(seed)
    heads = ["abc", "abd", "Bcd", "cde", "éfg", "x"]
    out = []
    for k in range(n):
        s = k % sources
        words = [rng.choices(heads, [1 + s, 2, 3, 1 + (s == 2) * 5, 2, 1])[0] + rng.choice(["", "e", "st"]) for _ in range(rng.randrange(20, 60))]
        out.append((k, " ".join(words) + rng.choice(["", "\n\t", " "]), ["en", "de"][k // sources % 2], f"s{s}", 0))
    return out


def brute_numbers(docs, letters, width, most):
    n = collections.Counter()
    for _, text, lang, source, _ in docs:
        if None not in (text, lang, source):
            lowered = text.translate(str.maketrans(word_numbers.UPPER, word_numbers.LOWER))
            n.update((lang, source, w[:letters]) for w in re.findall(r"[^\x20\x09-\x0D]+", lowered))
    sources = {s for _, s, _ in n}
    out = {}
    for lang in {x[0] for x in n}:
        genes = sorted({g for l, _, g in n if l == lang and all(n[lang, s, g] for s in sources)})
        bins = max(1, half_even(len(genes) / width))
        whole = sum(c for (l, _, _), c in n.items() if l == lang)
        for s in sources:
            mine = sum(c for (l, t, _), c in n.items() if (l, t) == (lang, s))
            groups = collections.defaultdict(list)
            for k, g in enumerate(genes):
                theirs = sum(n[lang, t, g] for t in sources)
                groups[min(k // width + 1, bins)].append(half_even(2 * ((n[lang, s, g] / mine) / (theirs / whole))))
            for b, cns in groups.items():
                out[lang, s, b] = max(0, min(most, half_even(sum(cns) / len(cns))))
    return out


def test_word_numbers(spark, tmp_path, caplog):
    docs = texts(1, 120) + [(900, None, "en", "s1", 0), (901, "abc abc", None, "s1", 0), (902, "abc", "en", None, 0), (903, "", "en", "s2", 0)]
    spark.createDataFrame(docs, DOCS).withColumn("cn", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    (tmp_path / "c.json").write_text(json.dumps({"width": 2, "most": 5}))
    with caplog.at_level(logging.INFO, "jobs"):
        word_numbers.run(spark, str(tmp_path), f"{tmp_path}/out", f"{tmp_path}/c.json")
    assert re.search(r"124 rows, \d{4} words", caplog.text) and "documents.parquet" in caplog.text and "partitioned by lang" in caplog.text
    got = word_numbers.read(spark, f"{tmp_path}/out").collect()
    want = brute_numbers(docs, 3, 2, 5)
    assert {(r.lang, r.source, r.bin): r.cn for r in got} == want and len(got) == len(want)
    assert all(r.call == ("AMP" if r.cn > 2 else "DEL" if r.cn < 2 else "NONE") for r in got)
    assert os.path.isdir(tmp_path / "out/numbers/lang=en")
    # the nearest source, from all pairs
    names = sorted({r.source for r in got})
    keys = sorted({(r.lang, r.bin) for r in got})
    cuts = [0, sum(k[0] == "de" for k in keys), len(keys)]
    m = np.array([[want[lang, s, b] for lang, b in keys] for s in names] + [[2] * len(keys)])
    w = distance.block_distance(m, m, cuts, "directed")[0]
    near = {s: min((w[j, k], n) for j, n in enumerate([*names, "root"]) if j != k) for k, s in enumerate(names)}
    assert {r.source: (r.dist, r.parent) for r in got} == near
    # again: the same
    word_numbers.run(spark, str(tmp_path), f"{tmp_path}/out", f"{tmp_path}/c.json")
    assert sorted(word_numbers.read(spark, f"{tmp_path}/out").collect()) == sorted(got)


def test_word_numbers_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    word_numbers.run(spark, str(tmp_path), f"{tmp_path}/out")
    assert word_numbers.read(spark, f"{tmp_path}/out").collect() == []


def test_settings_that_mean_nothing(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"widht": 2}')
    with pytest.raises(ValueError, match="widht"):
        common.configured(spark, word_numbers.DEFAULTS, f"{tmp_path}/c.json")


def vectors(seed, ids, bins=8):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, 0.15, bins)], int(rng.integers(0, 3))) for i in ids]


def brute_places(rows, mode="directed", bins=4):
    cells = {}
    for i, v, label in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            own = [max(0, min(4, int(np.floor(np.float64(np.float32(x)) * 8)) + 2)) for x in v]
            cells.setdefault(str(i), (own, label))
    names = [*cells, "root"]
    n = len(next(iter(cells.values()))[0])
    m = np.array([cells[c][0] for c in cells] + [[2] * n])
    w = distance.block_distance(m, m, [*range(0, n, bins), n], mode)[0]
    out = set()
    for k, c in enumerate(cells):
        best = min((int(w[j, k]), s) for j, s in enumerate(names) if j != k)
        out.add((c, cells[c][1], best[1], best[0]))
    return out


def test_new_cells_over_input_that_grows(spark, tmp_path, caplog):
    table, out, mark = tmp_path / "embeddings.parquet", f"{tmp_path}/out", f"{tmp_path}/mark"
    (tmp_path / "c.json").write_text('{"bins": 4, "files": 1}')
    portions = [vectors(1, range(20)), vectors(2, range(20, 50)), vectors(3, range(50, 55))]
    portions[1] += [(3, portions[0][5][1], 1), (60, None, 1), (None, portions[0][0][1], 1), (61, [None] * 8, 0), (62, [float("nan")] * 8, 0), (70, portions[0][7][1], None), (71, portions[0][7][1], 2), (71, portions[0][7][1], 2)]

    def add(rows):
        spark.createDataFrame(rows, VECTORS).coalesce(1).write.mode("append").parquet(str(table))

    def ran():
        new_cells.run(spark, str(tmp_path), out, mark, f"{tmp_path}/c.json")
        got = new_cells.read(spark, out).collect()
        assert len(got) == len({r.cell for r in got})
        return {tuple(r) for r in got}

    so_far = []
    for rows in portions:
        add(rows)
        so_far += rows
        caplog.clear()
        with caplog.at_level(logging.INFO, "jobs"):
            assert ran() == brute_places(so_far)
        assert f"{len(rows)} rows that were new" in caplog.text
    with caplog.at_level(logging.INFO, "jobs"):
        assert ran() == brute_places(so_far)
    assert ": 0 rows that were new" in caplog.text
    # one folder for each portion, and for each label; older cells have moved to newer ones
    assert {"batch=0", "batch=1", "batch=2"} <= set(os.listdir(f"{out}/cells")) and "label=1" in os.listdir(f"{out}/placed")
    moved = spark.read.parquet(f"{out}/parents").where("batch = 1 and int(dst) < 20")
    assert 0 < moved.count()
    # a portion that was taken but not marked as done is taken again
    commits = Path(mark) / "commits"
    for f in (commits / "2", commits / ".2.crc"):
        f.unlink(missing_ok=True)
    assert ran() == brute_places(so_far)
    # without its marks, it takes all anew, and nothing counts twice
    new_cells.run(spark, str(tmp_path), out, f"{tmp_path}/mark2", f"{tmp_path}/c.json")
    assert {tuple(r) for r in new_cells.read(spark, out).collect()} == brute_places(so_far)


def test_few_distances_of_new_cells_are_worked_out(spark, tmp_path, caplog):
    """As a cell costs less than the penalty only from one whose losses it has, in the first portion and in a later one."""
    caplog.set_level(logging.INFO, "jobs")
    rows, out = vectors(9, range(400), 64), f"{tmp_path}/out"
    for part in (rows[:300], rows[300:]):
        spark.createDataFrame(part, VECTORS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/embeddings.parquet")
        new_cells.run(spark, str(tmp_path), out, f"{tmp_path}/mark")
    assert {tuple(r) for r in new_cells.read(spark, out).collect()} == brute_places(rows, bins=16)
    pairs = [int(n) for n in re.findall(r"worked out (\d+) distances", caplog.text)]
    assert len(pairs) == 2 and sum(pairs) < 0.1 * 400**2


def test_no_cells_yet(spark, tmp_path):
    spark.createDataFrame([], VECTORS).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    new_cells.run(spark, str(tmp_path), f"{tmp_path}/out", f"{tmp_path}/mark")
    assert new_cells.read(spark, f"{tmp_path}/out").collect() == []


def test_command_line(spark, tmp_path):
    rows = vectors(4, range(12), 32)
    spark.createDataFrame(rows, VECTORS).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    args = ["--tables", str(tmp_path), "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", str(ROOT / "jobs/new_cells.json")]
    done = subprocess.run([sys.executable, "-m", "jobs.new_cells", *args], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "12 rows that were new" in done.stderr
    assert {tuple(r) for r in new_cells.read(spark, f"{tmp_path}/out").collect()} == brute_places(rows, bins=16)
