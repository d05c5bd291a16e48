"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import clustering, collocations, cotraining, language, lines, mixture, oracles, packing, quality_rules, secrets, sentencepiece_codec, simhash, substring, tiff
from newsloom.session import table, texts

Query = Callable[[SparkSession, str], DataFrame]


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(texts(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    digest = F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *(of_kind(k) for k in ("assign", "access", "hex")), digest, _listed(F.col("secrets")).alias("spans"), of_kind("crf"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(texts(spark, sf_dir, "documents"))


def op3_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tiff.tiff_pages(tiff.text_media(texts(spark, sf_dir, "documents")))
    tail = F.expr("substring(pixels, -16, 16)")
    return pages.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_lines(texts(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(texts(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score_documents(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(texts(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("reasons", ",").alias("reasons"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.learn(language.training_sample(docs)))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(texts(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(texts(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(texts(spark, sf_dir, "documents"))


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.pack(texts(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_secret_scan, op2_simhash_near_dedup, op3_tiff_media, op4_line_dedup, op5_substring_dedup,
        op6_quality_cotraining, op7_repetition_rules, op8_language_id, op9_sentencepiece, op10_best_fit_packing,
        op11_centroid_clustering, op12_phrase_collocations, op13_mixture_packing,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
