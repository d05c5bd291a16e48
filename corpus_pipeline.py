"""A corpus pipeline: language ID, line dedup, near-duplicate removal, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. Between stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import language, lines, packing, secrets, shingles, simhash
from newsloom.session import shared_dir, texts

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if no language is found, or none with this mean probability.
MIN_LANGUAGE_SCORE = 0.4
REDACTED = "[SECRET]"


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars following text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; lang is the one found. Null, empty and letterless texts have none and go. Equal texts get
    equal results, so repeated rows and null ids fare like any other; no rows give no rows."""
    found = language.identify(docs).filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return _columns(found.withColumn("lang", F.col("lang_pred")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share. Equal texts count as one document, so that a text with many
    exact copies keeps its lines; near_dedup leaves one of them. Lines that ten or more near copies share still go. A null text
    becomes empty; rows with a null doc_id are kept whole and don't count; rows that repeat a doc_id count once."""
    counted = docs.filter("doc_id is not null").groupBy(shingles.text_id()).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return _columns(lines.drop_lines(docs, counted=counted))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (Jaccard similarity of five-word shingles of 0.8 or more): that with the
    smallest doc_id, a null one coming last; of rows that repeat it, one. Null and empty texts are one group."""
    return _columns(simhash.keep_one(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced. Null texts stay null; rows are independent of each other."""
    return _columns(secrets.scan(docs, redact=REDACTED))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; a null or empty text is its end id. Every row counts, repeated or without id."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the network, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents table."""
    docs = texts(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
