"""The corpus pipeline: documents to packed training sequences in five stages.

``STAGES`` lists (name, function). A function takes the session, the documents that
the stage before it kept, and the data folder; its result is written as Parquet and
read again for the next stage. All stages but the last return the columns of
``documents``.

1. ``quality_classifier`` drops documents that the additive model scores below its threshold.
2. ``quality_rules`` drops documents that fail the word rules or whose lines are mostly shared.
3. ``near_duplicates`` keeps one document of every component of similar ones (five words, 0.8 or more).
4. ``personal_data`` masks personal data and secrets in the texts.
5. ``packing`` cuts the documents into pieces and packs them into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import additive_quality, jaccard_join, line_rules, stock_packing, weak_pii
from tidewatch.llm.queries import tokenizer
from tidewatch.session import scratch_path
from tidewatch.sources.tables import table

ORACLE_SQL = None  # the model, the components and the packing have no SQL twin; the tests use brute force


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return additive_quality.keep_good(docs, additive_quality.fit(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return weak_pii.redact(docs, weak_pii.fit(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stock_packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
