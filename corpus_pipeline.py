"""The corpus pipeline: STAGES applied to documents one after another, each on all that the one before it kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
A decision goes by doc_id, so rows without one pass the filters (of those with one text, one stays).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.decontaminate import contaminated
from docengine.llm.minhash import near_duplicates
from docengine.llm.packing import pack
from docengine.llm.pii import redact
from docengine.llm.shared import saved
from docengine.llm.toxicity import toxicity as toxicity_scores


NEAR_PERCENT = 80  # five-word similarity from which two documents are near copies


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids (one column, distinct)."""
    return docs.join(ids, "doc_id", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones among them, calls toxic go."""
    scores = toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scores.where("predicted = 1").select("doc_id").distinct())


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id.

    Of rows with one doc_id (or none) that stay, those with equal texts are one, different texts all stay.
    """
    groups = near_duplicates(docs, NEAR_PERCENT)
    kept = _without(docs, groups.where("NOT kept").select("doc_id").distinct())
    text_key = "_".join(["text_key", *docs.columns])  # a name that no column has
    return kept.withColumn(text_key, F.sha2(F.col("text").cast("binary"), 256)).dropDuplicates(["doc_id", text_key]).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.select("doc_id").distinct())


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenised and packed; a row per piece."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: Trained models, hashing and tokenising can't be written in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
