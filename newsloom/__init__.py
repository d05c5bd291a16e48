"""Spark-first analytics engine for crawled news corpora."""
