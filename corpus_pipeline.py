"""The pipeline over documents, stage by stage. Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last the
columns of documents. run() writes each stage's rows as Parquet and reads them again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloneforge.llm import decontamination, lines, minhash, packing, quality
from cloneforge.llm.common import table, written


#: What near copies share, by the contract of the operator: shingles of so many words, and so many in a hundred of them.
NEAR_WORDS, NEAR_PERCENT = 2, 80


def counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars anew, for texts that were cut."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; no document does."""
    return counted(lines.cleaned(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id: copies are alike to 0.8 by shingles of NEAR_WORDS words."""
    return minhash.deduplicated(docs, NEAR_WORDS, NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go."""
    return counted(decontamination.clean(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of tokens, with their ids."""
    return packing.pack(docs).withColumnRenamed("ids", "token_ids")


STAGES = [("quality classifier", classify), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("packing", pack)]

#: Tokenisation, trained scores and the rest can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
