"""A corpus of documents, cleaned and packed.

Each stage takes the documents that the one before kept, as a table, and works
on all of them. ``run`` writes each stage's result as Parquet into the shared
checkpoint folder and reads it again, so a lost executor costs one stage's
tasks at most. All but the last return the columns of documents.

A table without rows passes through. Extra columns stay as they are, whatever
their names, up to the last stage, which returns pieces. Repeated rows are one
document to the stage of near duplicates. NULL and empty texts have no language and go with
the first stage; were they to reach the others, toxicity and secrets would leave them as they are.
Very long texts are read whole in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stationflow.llm import language_id, packing, secret_scan, simhash, toxicity
from stationflow.llm.common import fold, table
from stationflow.llm.queries import VOCABULARY
from stationflow.session import delete_path, scratch_path, scratch_scope, ship_package

#: Below this likeness to every known language a text is taken for none of them (by chance it is about 0.03).
LEAST_LIKENESS = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus names; NULL, empty and letterless texts go."""
    ship_package(spark)
    profiles = language_id.learn(docs.where(fold() != 0))
    return language_id.keep_identified(docs, profiles, LEAST_LIKENESS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of these documents, doesn't call toxic."""
    ship_package(spark)
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest id."""
    ship_package(spark)
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of each secret; ``n_chars`` follows the text."""
    length = "n_chars" if "n_chars" in docs.columns else None
    return secret_scan.redact(docs, length_col=length)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences that hold every document."""
    ship_package(spark)
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Learned models and packing have no SQL; ``tests/llm/test_pipeline.py`` holds each stage's documents and texts against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over ``documents``. What a stage stored on its way goes when
    its result is written, and that goes when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
