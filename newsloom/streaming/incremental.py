"""Incremental deduplication: each micro-batch is upserted into a stored article table, of which it reads what its URLs, hashes and
fingerprints ask for, and to which it appends what it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import hashing
from newsloom.operators.dedup import fingerprinted, upsert
from newsloom.session import cut
from newsloom.streaming.runs import BUCKET_ROWS, FAN, RunTable

STORE = (
    "workspace_id long, id long, canonical_url string, title string, body string, confidence double, content_hash string, simhash long, duplicate_of long"
)
#: An original under one of its keys: its content hash (band -1), or a pair of blocks of its fingerprint.
INDEX = "workspace_id long, band int, value long, id long, canonical_url string, content_hash string, simhash long"
OUTCOME = "workspace_id long, arrival long, canonical_url string, outcome string, duplicate_of long, distance int"
HASH_BAND = -1


def index_keys(rows: DataFrame) -> DataFrame:
    """rows (content_hash, simhash, ...) with band and value of each key that a text is found by."""
    of_hash = F.when(F.col("content_hash").isNotNull(), F.array(F.struct(F.lit(HASH_BAND).alias("band"), F.xxhash64("content_hash").alias("value"))))
    of_blocks = F.when(F.col("simhash").isNotNull(), F.transform(hashing.block_keys("simhash"), lambda k: F.struct(k["band"].cast("int").alias("band"), k["value"].cast("long").alias("value"))))
    none = F.array().cast("array<struct<band:int,value:bigint>>")
    keys = F.concat(F.coalesce(of_hash.cast("array<struct<band:int,value:bigint>>"), none), F.coalesce(of_blocks.cast("array<struct<band:int,value:bigint>>"), none))
    return rows.withColumn("_key", F.explode(keys)).select("*", "_key.band", "_key.value").drop("_key")


class ArticleStore:
    """The article table and an index of its originals by block key, under a folder (see RunTable for how they are kept).

    A batch looks up the articles under its URLs, and the originals under its keys and hashes, in the buckets that these fall
    in. It appends the articles that it brings or changes, and the index entries of originals whose texts are new or gone.
    """

    def __init__(self, spark: SparkSession, folder: str, bucket_rows: int = BUCKET_ROWS, fan: int = FAN):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.articles = RunTable(spark, f"{self.folder}/articles", f"url_key string, {STORE}, live boolean", ["workspace_id", "url_key"], ["workspace_id", "id"], bucket_rows, fan)
        self.index = RunTable(spark, f"{self.folder}/index", f"{INDEX}, live boolean", ["workspace_id", "band", "value"], ["workspace_id", "band", "value", "id"], bucket_rows, fan)

    @staticmethod
    def _url_key(fallback: str) -> Column:
        # articles without a URL are found under none, and spread by what they have
        return F.coalesce(F.col("canonical_url"), F.concat(F.lit("\0"), F.col(fallback).cast("string"))).alias("url_key")

    def snapshot(self, before: int) -> DataFrame:
        """All articles as they are before a batch."""
        return self.articles.rows(before).drop("url_key")

    def outcomes(self, batch: int) -> DataFrame:
        """What became of each arrival of a batch."""
        return self.spark.read.schema(OUTCOME).parquet(f"{self.folder}/outcomes/v={batch:012d}")

    def apply(self, incoming: DataFrame, batch: int) -> None:
        """For foreachBatch: upsert incoming (see dedup.upsert). What is read and written grows with the batch, and with the texts of the
        store that share a key with it; merging runs adds a rewrite of each row for every FAN-fold growth of the store."""
        printed = incoming if {"content_hash", "simhash"} <= set(incoming.columns) else fingerprinted(incoming)
        incoming = cut(printed)
        urls = incoming.filter("canonical_url is not null").select("workspace_id", F.col("canonical_url").alias("url_key"))
        stored = cut(self.articles.lookup(urls, batch).drop("url_key"))
        whole = F.col("duplicate_of").isNull()
        prints = ["workspace_id", "id", "canonical_url", "content_hash", "simhash"]
        met = self.index.lookup(index_keys(incoming.select("workspace_id", "content_hash", "simhash")), batch).select(*prints)
        originals = cut(met.unionByName(stored.filter(whole).select(*prints)).distinct())
        _, top = self.articles.held(batch)
        snapshot, outcomes = upsert(stored, incoming, originals, top)
        outcomes.select("workspace_id", "arrival", "canonical_url", "outcome", "duplicate_of", F.col("distance").cast("int").alias("distance")).write.mode("overwrite").parquet(f"{self.folder}/outcomes/v={batch:012d}")
        changed = cut(snapshot.exceptAll(stored.select(*snapshot.columns)))
        top = max(top, changed.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
        # originals that were stored with other prints leave their keys
        left = stored.filter(whole).join(changed.select("workspace_id", "id"), ["workspace_id", "id"], "left_semi")
        entries = lambda rows, live: index_keys(rows.select(*prints)).select("workspace_id", "band", "value", *prints[1:]).withColumn("live", F.lit(live))
        gone, come = entries(left, False), entries(changed.filter(whole), True)
        stays = come.select("workspace_id", "band", "value", "id")
        delta = come.unionByName(gone.join(stays, ["workspace_id", "band", "value", "id"], "left_anti"))
        names = [c.split()[0] for c in INDEX.split(", ")]
        self.index.add(cut(delta.select(*names, "live")), batch)
        # the articles' list comes last: it makes the batch count
        rows = changed.select(self._url_key("id"), *(c.split()[0] for c in STORE.split(", ")), F.lit(True).alias("live"))
        self.articles.add(rows, batch, top)

    def vacuum(self, before: int) -> int:
        """Deletes what only states before ``before`` need."""
        return self.articles.vacuum(before) + self.index.vacuum(before)
