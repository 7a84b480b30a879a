"""The jobs as queries: each runs twice into one new folder, and gives what is there then."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloneforge.plans import queries as own
from cloneforge.plans.storage import shared_dir
from jobs import new_cells, word_numbers


def job1_word_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        word_numbers.run(spark, sf_dir, at)
    return word_numbers.read(spark, at)


def job2_new_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        new_cells.run(spark, sf_dir, f"{at}/output", f"{at}/checkpoint")
    return new_cells.read(spark, f"{at}/output")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_word_numbers, job2_new_cells)}


def nearest_of(profile: str) -> str:
    """near (dst, src, w): of each cell but the root the nearest other one, from `prof0`, with a root."""
    rooted = "prof AS (SELECT cell, chrom, bin, cn FROM prof0 UNION ALL SELECT DISTINCT 'root', chrom, bin, 2 FROM prof0)"
    pairs = own.pairs_sql("directed").removeprefix(own.PROF)
    return f"{profile}, {rooted}{pairs}, near AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w, src) AS k FROM med WHERE dst <> 'root') WHERE k = 1)"


WORDS = f"""n AS (SELECT lang, source, substr(word, 1, 3) AS gene, count(*) AS n FROM
  (SELECT lang, source, unnest(regexp_extract_all(translate(text, '{word_numbers.UPPER}', '{word_numbers.LOWER}'), '[^ \t-\r]+')) AS word FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL) GROUP BY ALL),
genes AS (SELECT lang, gene, sum(n) AS theirs, count(*) AS cells FROM n GROUP BY ALL HAVING cells = (SELECT count(DISTINCT source) FROM n)),
rel AS (SELECT source AS cell, lang AS chrom, gene, CAST(round_even(2 * ((n / sum(n) OVER (PARTITION BY lang, source)) / (theirs / whole)), 0) AS BIGINT) AS cn
  FROM n LEFT JOIN genes USING (lang, gene) JOIN (SELECT lang, sum(n) AS whole FROM n GROUP BY lang) USING (lang)),
known AS (SELECT * FROM rel WHERE cn IS NOT NULL),
ranked AS (SELECT chrom, gene, row_number() OVER (PARTITION BY chrom ORDER BY gene) AS k, count(*) OVER (PARTITION BY chrom) AS m FROM (SELECT DISTINCT chrom, gene FROM known)),
placed AS (SELECT chrom, gene, CAST(least((k - 1) // 10 + 1, greatest(round_even(m / 10, 0), 1)) AS INTEGER) AS bin FROM ranked),
prof0 AS (SELECT cell, chrom, bin, CAST(greatest(0, least(6, round_even(sum(cn) / count(*), 0))) AS INTEGER) AS cn FROM known JOIN placed USING (chrom, gene) GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    words = f"""WITH {nearest_of(WORDS)} SELECT chrom AS lang, cell AS source, bin, cn, CASE WHEN cn > 2 THEN 'AMP' WHEN cn < 2 THEN 'DEL' ELSE 'NONE' END AS call, src AS parent, w AS dist
FROM prof0 LEFT JOIN near ON dst = cell"""
    cells = f"""WITH {nearest_of(own.PROF.replace("prof AS", "prof0 AS"))} SELECT dst AS cell, label, src AS parent, w AS dist FROM near JOIN embeddings ON CAST(vec_id AS VARCHAR) = dst"""
    return {"job1_word_numbers": words, "job2_new_cells": cells}
