"""The corpus pipeline: quality rules, quality classifier, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of ``documents``. Between stages the
documents are written as Parquet and read again.

Edge cases: a null or empty text fails the word rules and goes in the first
stage; a null language is one of its own; rows with a null id pass like others
(as duplicates they go before those with one; of a group without any id, a row
of each different sequence of words stays);
repeated rows are copies of each other, of which one stays; very long texts are
judged, redacted and cut whole; further columns, whatever their names, pass
through all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import compression_quality, neardup, packing, perplexity_rules, pii
from spanloom.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside the word rules or their language's perplexity bands go; those without words are outside."""
    return perplexity_rules.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents classified as bad go. The classifier learns from the labelled rows of the source tables, as the
    stage before has already taken most bad examples out of docs."""
    model = compression_quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return compression_quality.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; texts without words are in no group."""
    return neardup.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind, and n_chars brought up to date; other texts stay as they are."""
    return pii.redact(docs, pii.fit(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, and their places in sequences; an empty text is a piece of one token."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Perplexity, compression, the CRF and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents in sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = materialise(docs, name)
    return docs
