"""A corpus pipeline of five stages, each calling one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. The first four return the columns of ``documents``; the last one returns token counts and digests.

Cases, for every stage: an empty table gives an empty one of the same columns; columns beyond those of ``documents`` are kept by the first four,
whatever their names; texts of any length are taken whole. A null text counts as empty: the quality classifier scores it as it scores
an empty text, in near-dedup it is alike to every other empty text, it holds no benchmark item and no secret, and has no tokens. Rows without doc_id
stay in near-dedup and are judged like others elsewhere. Rows that repeat are judged alike, and near-dedup keeps one of them; rows that repeat a doc_id
with different texts are judged by their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import bpe, common, decontaminate, quality, secrets, simhash
from tapeloom.llm.queries import table, tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go. It learns from labelled rows of ``docs`` only."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, that with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every row stays."""
    return secrets.mask_secrets(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of ids and of the decoded text."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secret_masking),
    ("bpe", bpe_encoding),
]

#: The classifier and the fingerprints cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again. What a stage wrote besides is
    deleted after it, its predecessor's rows too."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with common.scratch(spark) as keep_last:
            docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            path = keep_last()
        if before:
            common.delete(spark, before)
        before = path
    return docs
