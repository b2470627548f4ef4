"""The corpus pipeline: reject, deduplicate, replace personal data, pack.

Every stage takes all rows that the one before kept.  Null and empty texts, null
and repeated ids, repeated rows, very long texts, empty tables and further columns
with any names are rows like others, with the results that each stage states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chosen_path, packing_gga, pii_surrogates, quality_ftrl
from tidemark.llm.queries import PII_KEY
from tidemark.llm.scratch import new_path, scope


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (7) rejects go.

    Null text is scored as empty, each row by its own text; without labels every
    score is 0.5 and all stay.
    """
    return quality_ftrl.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (2) stays.

    Null, empty and blank texts are no duplicates unless both id and text repeat;
    rows with a null id all stay.
    """
    return chosen_path.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates (6); ``n_chars`` follows the new text.

    All rows stay; null text stays null, and so does its ``n_chars``.
    """
    out = pii_surrogates.replace_entities(docs, PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences (4); the last stage, one row per piece.

    Null and empty texts are one end id; every row is a document of its own.
    """
    return packing_gga.best_fit_packing(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: a fitted classifier and a genetic algorithm decide; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scope(spark):  # what a stage wrote for itself goes with it
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
