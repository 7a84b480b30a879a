"""Tests against permutations that arrive one by one are those of all at once."""

import random

from pyspark.sql import functions as F

from cloneforge.operators import stats
from cloneforge.sources import writers
from cloneforge.streaming import permutations

LEVELS = "cell string, feature string, amp double, del double"


def test_permutations_that_arrive(spark, tmp_path):
    rng = random.Random(5)
    draw = lambda: (rng.randrange(5) / 4, -rng.randrange(5) / 4)
    tests = [(c, f) for c in "ab" for f in ("1:p", "1:q", "2:p")]
    levels = spark.createDataFrame([(*t, *draw()) for t in tests], LEVELS)
    permuted = spark.createDataFrame([(k, *t, *draw()) for k in range(1, 10) for t in tests if (k, t[1]) != (4, "2:p")] + [(1, "z", "1:p", 1.0, -1.0)], "perm_id int, " + LEVELS)
    path, output, mark = (str(tmp_path / x) for x in ("perms", "out", "mark"))
    name = lambda df: sorted((r.cell, r.feature, r.direction, r.score, round(r.pvalue, 9), round(r.adjustp, 9)) for r in df.collect())
    taken = []
    for upto, portion in ((2, "perm_id <= 2"), (2, None), (7, "perm_id between 3 and 7"), (9, "perm_id > 7")):
        if portion:
            permuted.where(portion).write.mode("append").partitionBy("perm_id").parquet(path)
        taken.append(permutations.follow(spark, path, levels, output, mark, files=1))
        want = stats.significance(levels, permuted.where(F.col("perm_id") <= upto))
        assert name(permutations.tests(spark.read.parquet(output))) == name(want)
    assert taken[1] == 0 and sum(taken) >= permuted.count()
    # without its checkpoint it takes all again, with the same counts
    again = str(tmp_path / "again")
    permutations.follow(spark, path, levels, again, str(tmp_path / "mark2"))
    assert sorted(map(tuple, spark.read.parquet(again).collect())) == sorted(map(tuple, spark.read.parquet(output).collect()))
    # the sink of permutations makes such folders
    writers.permutations(permuted, str(tmp_path / "sink"))
    permutations.follow(spark, str(tmp_path / "sink"), levels, str(tmp_path / "out3"), str(tmp_path / "mark3"))
    assert spark.read.parquet(str(tmp_path / "out3")).count() == 12


def test_no_state_is_held_and_a_portion_that_was_cut_off_is_taken_again(spark, tmp_path):
    rng = random.Random(6)
    rows = lambda: [(c, f, rng.randrange(5) / 4, -rng.randrange(5) / 4) for c in "abc" for f in ("1:p", "2:p")]
    levels = spark.createDataFrame(rows(), LEVELS)
    path, output, mark = (str(tmp_path / x) for x in ("perms", "out", "mark"))
    got = lambda: sorted(map(tuple, spark.read.parquet(output).collect()))
    seen = []
    for k in range(1, 5):
        spark.createDataFrame([(k, *r) for r in rows()], "perm_id int, " + LEVELS).coalesce(1).write.mode("append").partitionBy("perm_id").parquet(path)
        permutations.follow(spark, path, levels, output, mark)
        seen.append(got())
        if k == 3:
            for name in ("2", ".2.crc"):
                (tmp_path / "mark/commits" / name).unlink()
            permutations.follow(spark, path, levels, output, mark)
            assert got() == seen[-1]
    assert not (tmp_path / "mark/state").exists()
    assert [{r[-1] for r in s} for s in seen] == [{1}, {2}, {3}, {4}]
