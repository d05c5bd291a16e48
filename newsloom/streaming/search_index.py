"""A stored full-text index that follows its articles: postings in runs (see runs), laid out by term."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import search
from newsloom.session import cut
from newsloom.streaming.runs import FAN, RunTable

POSTINGS = "term string, id long, field string, weight double, positions array<int>, live boolean"
#: Postings of a bucket, about.
BUCKET_ROWS = 200_000


class SearchIndex:
    """The postings of all articles, duplicates too, under a folder. A batch appends the postings that come and those that go; a search reads
    the buckets of its own words, in as many runs as the table has."""

    def __init__(self, spark: SparkSession, folder: str, bucket_rows: int = BUCKET_ROWS, fan: int = FAN):
        self.spark = spark
        self.table = RunTable(spark, folder, POSTINGS, ["term"], ["term", "id", "field"], bucket_rows, fan)

    def update(self, now: DataFrame, before: DataFrame | None, batch: int) -> None:
        """Articles (id and the fields of search.FIELD_WEIGHTS) as a batch leaves them, and those of them that were there before it. An article
        of ``before`` that isn't in ``now`` leaves the index. Running a batch again gives the same index."""
        come = search.postings(now).withColumn("live", F.lit(True))
        if before is None:
            delta = come
        else:
            where = ["term", "id", "field"]
            gone = search.postings(before).join(come.select(*where), where, "left_anti").withColumn("live", F.lit(False))
            delta = come.unionByName(gone)
        self.table.add(cut(delta.select("term", "id", "field", F.col("weight").cast("double").alias("weight"), "positions", "live")), batch)

    def postings(self, q: str, before: int) -> DataFrame:
        """The postings of a query's words, as they are before a batch."""
        words = sorted({w for alternative in search.parse_query(q) for _, words in alternative for w in words})
        asked = self.spark.createDataFrame([(w,) for w in words], "term string")
        return self.table.lookup(asked, before)

    def search(self, articles: DataFrame, query: search.SearchQuery, before: int) -> search.SearchPage:
        """A page of articles by full text, from the stored postings alone."""
        index = self.postings(query.q, before) if (query.q or "").strip() else None
        return search.search(articles, query, "fulltext", index)

    def term_counts(self, q: str, before: int) -> DataFrame:
        """(term, docs, places) of a query's words over all fields."""
        each = self.postings(q, before).groupBy("term", "id").agg(F.sum(F.size("positions")).alias("n"))
        return each.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").cast("long").alias("places"))

    def vacuum(self, before: int) -> int:
        """Deletes what only states before ``before`` need."""
        return self.table.vacuum(before)
