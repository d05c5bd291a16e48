"""Queries of the article store over the documents table: hashes, duplicates, dashboard counts, search."""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import display, hashing, languages, text
from newsloom.operators import dedup, search, stats
from newsloom.session import cut, shared_dir, stash, streamed, table, texts
from newsloom.streaming import incremental
from newsloom.streaming.search_index import SearchIndex

#: The documents table as articles: three workspaces, a date for six of seven, the first line as title.
AS_OF = datetime(2024, 2, 15)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "documents")
    day = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 60) * 86400)
    return d.select(
        F.col("doc_id").alias("id"),
        (F.col("doc_id") % 3).alias("workspace_id"),
        F.col("source").alias("source_name"),
        F.col("lang").alias("language"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.col("text").alias("body"),
        F.when(F.col("doc_id") % 7 != 0, day).alias("published_at"),
        ((F.col("n_chars") % 100) / 100.0).alias("confidence"),
    )


_ARTICLES = """SELECT doc_id AS id, doc_id % 3 AS workspace_id, source AS source_name, lang AS language, split_part(text, chr(10), 1) AS title, text AS body,
  CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) END AS published_at, (n_chars % 100) / 100.0 AS confidence FROM documents"""
_NORMAL = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_HASHES = f"SELECT doc_id, lang, source, CASE WHEN {_NORMAL} <> '' THEN sha256({_NORMAL}) END AS content_hash FROM documents"
_ORIGINALS = f"SELECT *, CASE WHEN content_hash IS NOT NULL AND min(doc_id) OVER (PARTITION BY content_hash) < doc_id THEN min(doc_id) OVER (PARTITION BY content_hash) END AS duplicate_of FROM ({_HASHES})"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", hashing.content_hash("text").alias("content_hash"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two branches need the hashes, and they are small beside the texts
    return dedup.exact_originals(cut(_hashed(spark, sf_dir)).withColumnRenamed("doc_id", "id")).withColumnRenamed("id", "doc_id")


def content_hash_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir).select("doc_id", "content_hash")


def exact_duplicate_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("doc_id", "content_hash", "duplicate_of")


def exact_duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    dup = F.col("duplicate_of").isNotNull()
    return _resolved(spark, sf_dir).groupBy("lang", "source").agg(F.count_if(~dup).alias("originals"), F.count_if(dup).alias("duplicates"))


def article_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.article_totals(_resolved(spark, sf_dir).withColumnRenamed("duplicate_of", "duplicate_of_id"))


def language_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_languages(_resolved(spark, sf_dir).filter("duplicate_of is null"), 3, "lang")


def duplicate_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of the most copied original, by a self-join on duplicate_of."""
    rows = _resolved(spark, sf_dir)
    most = rows.filter("duplicate_of is not null").groupBy("duplicate_of").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "duplicate_of").limit(1)
    return rows.join(most.select("duplicate_of"), "duplicate_of").select("doc_id", "duplicate_of")


def sources_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their labelled documents, 0 where there are none."""
    d, labels = texts(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sources = d.select(F.col("source").alias("id")).distinct()
    good = d.join(labels.filter("quality = 1"), "doc_id").groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("articles"))
    return sources.join(good, "id", "left").select("id", F.coalesce("articles", F.lit(0)).alias("articles"))


def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = search.SearchQuery(workspace_id=1, language="EN", since=datetime(2024, 1, 10), until=datetime(2024, 2, 10), min_confidence=0.25, include_duplicates=True)
    return search.apply_filters(articles(spark, sf_dir), q).select("id", "workspace_id", "confidence")


def search_like_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a substring search, in which % and _ mean themselves."""
    q = search.SearchQuery(q="AND %%% the", include_duplicates=True, limit=200)
    page = search.search(articles(spark, sf_dir), q, "like")
    return page.items.select("id")


def article_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the listing, newest first and undated last."""
    page = search.search(articles(spark, sf_dir), search.SearchQuery(workspace_id=2, include_duplicates=True, limit=50, offset=50), "like")
    return page.items.select("id", "title", F.date_format("published_at", "yyyy-MM-dd").alias("published"))


def article_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(articles(spark, sf_dir), search.SearchQuery(workspace_id=2, include_duplicates=True), "like").total


def search_tokens_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = {"body": search.tokens(F.col("body"))}
    return articles(spark, sf_dir).filter(search.matches(toks, "the and -thly or que -le")).select("id")


def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = {"body": search.tokens(F.col("body"))}
    return articles(spark, sf_dir).filter(search.matches(toks, '"of the" and')).select("id")


def stored_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The index of the documents table, in the shared folder: made at the first call, and anew where the table's files have changed."""
    files = []
    for path in table(spark, sf_dir, "documents").inputFiles():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        files.append((path, status.getLen(), status.getModificationTime()))
    index = SearchIndex(spark, f"{shared_dir(spark)}/search-{hashlib.sha256(repr(sorted(files)).encode()).hexdigest()[:16]}")
    if not index.table.held(1)[0]:
        index.update(articles(spark, sf_dir), None, 0)
    return index


def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twenty for a query, by cover density, from stored postings of its words."""
    query = search.SearchQuery(q="the of", include_duplicates=True, sort="relevance", limit=20)
    page = stored_index(spark, sf_dir).search(articles(spark, sf_dir), query, 1)
    return page.items.select("id", F.round("rank", 6).alias("rank"))


def search_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index that two batches have changed: some articles came later, some have other bodies, some are gone."""
    rows, n = articles(spark, sf_dir), F.col("id") % 4
    index = SearchIndex(spark, f"{shared_dir(spark)}/search-{uuid.uuid4().hex}")
    index.update(rows.filter(n != 3), None, 0)
    other = rows.withColumn("body", F.when(n == 1, F.concat(F.lit("the "), "title", F.lit(" of"))).otherwise(F.col("body")))
    index.update(other.filter(n.isin(1, 3)), rows.filter(n == 1), 1)
    index.update(rows.limit(0), rows.filter("id % 8 = 0"), 2)
    query = search.SearchQuery(q="the of", include_duplicates=True, sort="relevance", limit=20)
    page = index.search(other.filter("id % 8 != 0"), query, 3)
    return page.items.select("id", F.round("rank", 6).alias("rank"))


def search_created_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a listing by the time of storing."""
    rows = articles(spark, sf_dir).withColumn("created_at", F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7919 % 5000))
    page = search.search(rows, search.SearchQuery(workspace_id=1, include_duplicates=True, sort="created_at", limit=20, offset=40))
    return page.items.select("id", "workspace_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


def article_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listing shows of an article, without its body, and what one article shows."""
    d = articles(spark, sf_dir).withColumn("content_hash", hashing.content_hash("body"))
    return d.select("id", "title", "language", "source_name", F.col("content_hash").isNotNull().alias("has_body"), F.length("body").alias("chars"))


def content_hash_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of texts written with ligatures, wide digits and decomposed letters, which are those of the plain texts."""
    d = texts(spark, sf_dir, "documents")
    spelled = F.col("text")
    for plain, form in (("fi", "\ufb01"), ("é", "e\u0301"), ("1", "\uff11"), ("the", "\uff54he")):
        spelled = F.replace(spelled, F.lit(plain), F.lit(form))
    return d.select("doc_id", hashing.content_hash(spelled).alias("content_hash"))


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and places of each word of the bodies."""
    return search.term_counts(articles(spark, sf_dir))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").select("doc_id", text.word_count("text").alias("words"))


def reader_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.paragraphs("text")).alias("pos", "paragraph")).select("doc_id", "pos", F.sha2("paragraph", 256).alias("paragraph_sha256"))


def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language codes from written forms of a language."""
    d = texts(spark, sf_dir, "documents")
    forms = F.create_map(*(F.lit(x) for x in ("en", " English ", "de", "de_AT", "fr", "FR-ca", "es", "x")))
    return d.select("doc_id", forms[F.col("lang")].alias("written")).select("doc_id", languages.normalize_language("written").alias("code"))


def keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(F.array_sort(text.split_keywords(F.array(F.substring_index("text", "\n", 1)))), ";").alias("keywords"))


def simhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near duplicates by fingerprint."""
    return dedup.near_pairs(dedup.fingerprinted(articles(spark, sf_dir)).withColumn("workspace_id", F.lit(0)))


def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of storing all documents in order of id, by workspace."""
    return dedup.resolve(dedup.fingerprinted(articles(spark, sf_dir)))


#: Stand-in fingerprints that SQL can make too: three single bits, so that many differ in two.
PRINT = "shiftleft(1L, int({k} % 11)) + shiftleft(1L, 20 + int({k} * 7 % 13)) + shiftleft(1L, 40 + int({k} * 3 % 9))"
_PRINT = "((1::BIGINT << ({k} % 11)::INTEGER) + (1::BIGINT << (20 + {k} * 7 % 13)::INTEGER) + (1::BIGINT << (40 + {k} * 3 % 9)::INTEGER))"


def customers_as_articles(spark: SparkSession, sf_dir: str, customers: DataFrame | None = None) -> DataFrame:
    """Customers in three workspaces, with hashes that some share and fingerprints near each other's; some have none."""
    c = (table(spark, sf_dir, "customer") if customers is None else customers).select(F.col("c_custkey").cast("long").alias("id"), (F.col("c_nationkey") % 3).cast("long").alias("workspace_id"))
    content = F.when(F.col("id") % 23 != 0, F.concat(F.lit("h"), (F.col("id") * 13 % 2000).cast("string")))
    return c.select("*", content.alias("content_hash"), F.when(F.col("id") % 19 != 0, F.expr(PRINT.format(k="id"))).alias("simhash"))


_CUSTOMERS = f"""SELECT c_custkey::BIGINT AS id, (c_nationkey % 3)::BIGINT AS ws, CASE WHEN c_custkey % 23 <> 0 THEN 'h' || (c_custkey * 13 % 2000) END AS h, CASE WHEN c_custkey % 19 <> 0 THEN {_PRINT.format(k="c_custkey")} END AS fp FROM customer"""


def near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' fingerprints within three bits, the first of equal ones standing for all."""
    return dedup.near_pairs(customers_as_articles(spark, sf_dir))


def fingerprint_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four bands of each fingerprint, its form for people, and its distance from the next one's."""
    rows = customers_as_articles(spark, sf_dir).filter("simhash is not null")
    band = F.inline(hashing.bands("simhash")).alias("band", "value")
    return rows.select("id", display.signature("simhash").alias("signature"), hashing.hamming("simhash", F.expr(PRINT.format(k="(id + 1)"))).alias("distance"), band)


def greedy_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of storing all customers as articles in order of id."""
    return dedup.resolve(customers_as_articles(spark, sf_dir))


def _arrivals(customers: DataFrame) -> DataFrame:
    """Customers (customers_as_articles()) as arrivals under half as many URLs."""
    n = F.col("id")
    return customers.select(
        "workspace_id", n.alias("arrival"), F.when(n % 31 != 0, F.concat(F.lit("u"), (n * 7 % 701).cast("string"))).alias("canonical_url"), F.concat(F.lit("t"), (n % 2).cast("string")).alias("title"),
        F.lit("").alias("body"), (F.lit(0.5) + n % 5 / 10).alias("confidence"), "content_hash", "simhash",
    )


def upsert_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each arrival of customers as articles under half as many URLs, in two batches: revisits update articles, and what an
    article is now decides on what comes after."""
    rows = _arrivals(customers_as_articles(spark, sf_dir))
    store = rows.limit(0).select("workspace_id", F.col("arrival").alias("id"), "canonical_url", "title", "body", "confidence", "content_hash", "simhash", F.lit(None).cast("long").alias("duplicate_of"))
    store, first = dedup.upsert(store, rows.filter("arrival % 1000 < 500"))
    # numbers of arrival only order a batch, so the later ones may be any
    _, second = dedup.upsert(cut(store), rows.filter("arrival % 1000 >= 500"))
    return first.unionByName(second).select("workspace_id", "arrival", "outcome", "duplicate_of", "distance")


def store_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by streams into a stored table with an index of blocks: the customers as a file source, read to its end for each half of
    them; the outcomes are those that the store keeps."""
    source = streamed(spark, sf_dir, "customer")
    rows = _arrivals(customers_as_articles(spark, sf_dir, source))
    store = incremental.ArticleStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    batches = 0
    for half in ("arrival % 1000 < 500", "arrival % 1000 >= 500"):
        seen: list[int] = []

        def apply(part: DataFrame, n: int, first: int = batches, seen: list[int] = seen) -> None:
            store.apply(part, first + n)
            seen.append(first + n)

        rows.filter(half).writeStream.foreachBatch(apply).trigger(availableNow=True).start().awaitTermination()
        batches = max(seen, default=batches - 1) + 1
    out = spark.createDataFrame([], incremental.OUTCOME)
    for batch in range(batches):
        out = out.unionByName(store.outcomes(batch))
    return out.select("workspace_id", "arrival", "outcome", "duplicate_of", "distance")


_DISTANCE = "bit_count(xor(x.fp, a.fp))"
_GREEDY = f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM ({_CUSTOMERS})),
r AS (SELECT 0::BIGINT AS n, CAST([] AS STRUCT(id BIGINT, ws BIGINT, h VARCHAR, fp BIGINT)[]) AS o, NULL::BIGINT AS ws, NULL::BIGINT AS id, NULL::BIGINT AS best UNION ALL
SELECT s.n, CASE WHEN s.best IS NULL THEN list_append(s.o, {{'id': s.id, 'ws': s.ws, 'h': s.h, 'fp': s.fp}}) ELSE s.o END, s.ws, s.id, s.best FROM
 (SELECT a.n, r.o, a.ws, a.id, a.h, a.fp, list_min(list_transform(list_filter(r.o, lambda x: x.ws = a.ws AND (coalesce(x.h = a.h, false) OR coalesce({_DISTANCE} <= 3, false))), lambda x: CASE WHEN coalesce(x.h = a.h, false) THEN 0 ELSE 1 + {_DISTANCE} END * 1000000000::BIGINT + x.id)) AS best
  FROM r JOIN a ON a.n = r.n + 1) s)
SELECT ws AS workspace_id, id, CASE WHEN best IS NULL THEN 'new' WHEN best < 1000000000 THEN 'duplicate' ELSE 'near_duplicate' END AS outcome, best % 1000000000 AS duplicate_of,
 CASE WHEN best >= 1000000000 THEN CAST(best // 1000000000 - 1 AS INTEGER) END AS distance FROM r WHERE n > 0"""
_UPSERT = f"""WITH RECURSIVE a AS (SELECT *, CASE WHEN id % 31 <> 0 THEN 'u' || (id * 7 % 701) END AS url, 't' || (id % 2) AS title, 0.5 + (id % 5) / 10.0 AS conf, row_number() OVER (ORDER BY id % 1000 >= 500, id) AS n FROM ({_CUSTOMERS})),
r AS (SELECT 0::BIGINT AS n, CAST([] AS STRUCT(id BIGINT, ws BIGINT, url VARCHAR, title VARCHAR, h VARCHAR, fp BIGINT, conf DOUBLE, dup BIGINT)[]) AS o, NULL::BIGINT AS ws, NULL::BIGINT AS arrival, NULL::VARCHAR AS said, NULL::BIGINT AS best UNION ALL
SELECT n, CASE said WHEN 'unchanged' THEN o WHEN 'updated' THEN list_transform(o, lambda x: CASE WHEN x.id = held.id THEN {{'id': x.id, 'ws': x.ws, 'url': x.url, 'title': title, 'h': h, 'fp': fp, 'conf': conf, 'dup': x.dup}} ELSE x END)
  ELSE list_append(o, {{'id': len(o) + 1, 'ws': ws, 'url': url, 'title': title, 'h': h, 'fp': fp, 'conf': conf, 'dup': best % 1000000000}}) END, ws, id, said, CASE WHEN said = 'first' THEN best END FROM
 (SELECT *, CASE WHEN held IS NULL THEN 'first' WHEN held.h IS NOT DISTINCT FROM h AND held.title = title OR conf + 0.1 < held.conf THEN 'unchanged' ELSE 'updated' END AS said FROM
  (SELECT a.n, r.o, a.ws, a.id, a.url, a.title, a.h, a.fp, a.conf::DOUBLE AS conf, list_filter(r.o, lambda x: x.ws = a.ws AND coalesce(x.url = a.url, false))[1] AS held,
   list_min(list_transform(list_filter(r.o, lambda x: x.dup IS NULL AND x.ws = a.ws AND (coalesce(x.h = a.h, false) OR coalesce({_DISTANCE} <= 3, false))), lambda x: CASE WHEN coalesce(x.h = a.h, false) THEN 0 ELSE 1 + {_DISTANCE} END * 1000000000::BIGINT + x.id)) AS best
   FROM r JOIN a ON a.n = r.n + 1)))
SELECT ws AS workspace_id, arrival, CASE WHEN said <> 'first' THEN said WHEN best IS NULL THEN 'new' WHEN best < 1000000000 THEN 'duplicate' ELSE 'near_duplicate' END AS outcome, best % 1000000000 AS duplicate_of,
 CASE WHEN best >= 1000000000 THEN CAST(best // 1000000000 - 1 AS INTEGER) END AS distance FROM r WHERE n > 0"""


def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of texts that declare none, by frequent words."""
    return texts(spark, sf_dir, "documents").select("doc_id", languages.detect_language("text").alias("language"))


def usage_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages left today of each source as a workspace: each document counts one page of usage."""
    d = texts(spark, sf_dir, "documents")
    deltas = d.select(F.substring("source", 4, 9).cast("long").alias("workspace_id"), F.lit(datetime(2024, 2, 15)).cast("date").alias("day"), F.lit(1).alias("pages"), F.lit(0).alias("llm_calls"), F.lit(0).alias("crawls"))
    usage = stats.add_usage(deltas.limit(0), deltas)
    spaces = usage.select(F.col("workspace_id").alias("id"), F.when(F.col("workspace_id") % 2 == 0, F.lit(40)).alias("max_pages_per_day"))
    left = stats.pages_left(spaces, usage, F.lit(datetime(2024, 2, 15)).cast("date"))
    limit = F.when(F.col("id") % 2 == 0, 40).otherwise(stats.DEFAULT_LIMITS["max_pages_per_day"])
    share, level = stats.usage_meter(F.col("used"), limit)
    return left.select("id", "used", "left", F.round(share, 4).alias("share"), level.alias("level"))


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"
_TOKENS_OF = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"
_RANKED = f"""WITH a AS (SELECT * FROM these), t AS (SELECT id, {_TOKENS_OF.format("title")} AS tt, {_TOKENS_OF.format("body")} AS tb FROM a), w AS (SELECT id, len(tt) AS k, list_concat(tt, tb) AS ws FROM t),
p AS (SELECT id, i, ws[i] AS term, CASE WHEN i <= k THEN 1.0 ELSE 0.2 END AS weight FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w) WHERE ws[i] IN ('the', 'of')),
c AS (SELECT *, lag(i) OVER o AS pi, lag(term) OVER o AS pt, lag(weight) OVER o AS pw FROM p WINDOW o AS (PARTITION BY id ORDER BY i))
SELECT id, round(sum(2 / (1 / weight + 1 / pw) / (i - pi)), 6) AS rank FROM c WHERE term <> pt GROUP BY id ORDER BY sum(2 / (1 / weight + 1 / pw) / (i - pi)) DESC, (SELECT published_at FROM a WHERE a.id = c.id) DESC NULLS LAST, id DESC LIMIT 20"""

QUERIES = {
    "content_hash_docs": (content_hash_docs, f"SELECT doc_id, content_hash FROM ({_HASHES})"),
    "exact_duplicate_originals": (exact_duplicate_originals, f"SELECT doc_id, content_hash, duplicate_of FROM ({_ORIGINALS})"),
    "exact_duplicate_summary": (
        exact_duplicate_summary,
        f"SELECT lang, source, count(*) FILTER (duplicate_of IS NULL) AS originals, count(*) FILTER (duplicate_of IS NOT NULL) AS duplicates FROM ({_ORIGINALS}) GROUP BY lang, source",
    ),
    "article_totals": (article_totals, f"SELECT count(*) FILTER (duplicate_of IS NULL) AS articles, count(*) FILTER (duplicate_of IS NOT NULL) AS duplicates FROM ({_ORIGINALS})"),
    "language_topk": (
        language_topk,
        f"SELECT coalesce(nullif(lang, ''), 'unknown') AS language, count(*) AS count FROM ({_ORIGINALS}) WHERE duplicate_of IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    ),
    "duplicate_copies": (
        duplicate_copies,
        f"WITH r AS ({_ORIGINALS}) SELECT doc_id, duplicate_of FROM r WHERE duplicate_of = (SELECT duplicate_of FROM r WHERE duplicate_of IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
    ),
    "sources_with_counts": (
        sources_with_counts,
        "SELECT s.id, count(g.doc_id) AS articles FROM (SELECT DISTINCT source AS id FROM documents) s LEFT JOIN (SELECT d.doc_id, d.source FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1) g ON g.source = s.id GROUP BY s.id",
    ),
    "search_filters": (
        search_filters,
        f"SELECT id, workspace_id, confidence FROM ({_ARTICLES}) WHERE workspace_id = 1 AND language = 'en' AND published_at >= TIMESTAMP '2024-01-10' AND published_at < TIMESTAMP '2024-02-10' AND confidence >= 0.25",
    ),
    "search_like_terms": (
        search_like_terms,
        f"SELECT id FROM ({_ARTICLES})" + r" WHERE body ILIKE '%AND%' AND body ILIKE '%\%\%\%%' ESCAPE '\' AND body ILIKE '%the%' ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 200",
    ),
    "article_page": (
        article_page,
        f"SELECT id, title, strftime(published_at, '%Y-%m-%d') AS published FROM ({_ARTICLES}) WHERE workspace_id = 2 ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 50 OFFSET 50",
    ),
    "article_page_total": (article_page_total, "SELECT count(*) AS total FROM documents WHERE doc_id % 3 = 2"),
    "search_tokens_boolean": (
        search_tokens_boolean,
        f"SELECT doc_id AS id FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE (list_contains(t, 'the') AND list_contains(t, 'and') AND NOT list_contains(t, 'thly')) OR (list_contains(t, 'que') AND NOT list_contains(t, 'le'))",
    ),
    "search_phrase": (
        search_phrase,
        f"SELECT doc_id AS id FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE list_contains(t, 'and') AND contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')",
    ),
    "search_ranked": (search_ranked, _RANKED.replace("these", f"({_ARTICLES})")),
    "search_updated": (
        search_updated,
        _RANKED.replace("these", f"(SELECT id, title, CASE WHEN id % 4 = 1 THEN 'the ' || title || ' of' ELSE body END AS body, published_at FROM ({_ARTICLES}) WHERE id % 8 <> 0)"),
    ),
    "search_created_order": (
        search_created_order,
        f"SELECT id, workspace_id, strftime(TIMESTAMP '2024-01-01' + to_seconds(id * 7919 % 5000), '%Y-%m-%d %H:%M:%S') AS created FROM ({_ARTICLES}) WHERE workspace_id = 1 ORDER BY id * 7919 % 5000 DESC, id DESC LIMIT 20 OFFSET 40",
    ),
    "article_projection": (
        article_projection,
        f"SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, lang AS language, source AS source_name, {_NORMAL} <> '' AS has_body, CAST(length(text) AS INTEGER) AS chars FROM documents",
    ),
    "content_hash_forms": (content_hash_forms, f"SELECT doc_id, content_hash FROM ({_HASHES})"),
    "near_fingerprints": (
        near_fingerprints,
        f"""WITH c AS ({_CUSTOMERS}), f AS (SELECT ws, fp, min(id) AS earlier FROM c WHERE fp IS NOT NULL GROUP BY 1, 2)
SELECT c.ws AS workspace_id, c.id, f.earlier, CAST(bit_count(xor(c.fp, f.fp)) AS INTEGER) AS distance FROM c JOIN f ON c.ws = f.ws AND f.earlier < c.id AND bit_count(xor(c.fp, f.fp)) <= 3""",
    ),
    "fingerprint_bands": (
        fingerprint_bands,
        f"SELECT id, printf('%016x', fp) AS signature, CAST(bit_count(xor(fp, {_PRINT.format(k='(id + 1)')})) AS INTEGER) AS distance, i::INTEGER AS band, (fp >> (16 * i)::INTEGER) & 65535 AS value FROM ({_CUSTOMERS}), range(4) t(i) WHERE fp IS NOT NULL",
    ),
    "greedy_outcomes": (greedy_outcomes, _GREEDY),
    "upsert_outcomes": (upsert_outcomes, _UPSERT),
    "store_stream": (store_stream, _UPSERT),
    "term_frequencies": (
        term_frequencies,
        f"SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS places FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term",
    ),
    "word_counts": (word_counts, r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS words FROM documents"),
    "reader_paragraphs": (
        reader_paragraphs,
        r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, sha256(p[i]) AS paragraph_sha256 FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM
  (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents))""",
    ),
    "language_codes": (language_codes, "SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'de' WHEN 'fr' THEN 'fr' END AS code FROM documents"),
    "keyword_lists": (
        keyword_lists,
        """SELECT doc_id, array_to_string(list_sort(list_slice(list_filter(k, lambda x, i: list_position(k, x) = i), 1, 50)), ';') AS keywords FROM
  (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(split_part(text, chr(10), 1), '[,;|]'), lambda x: trim(x)), lambda x: x <> '' AND length(x) <= 100) AS k FROM documents)""",
    ),
    "simhash_pairs": (simhash_pairs, None),
    "greedy_dedup": (greedy_dedup, None),
    "language_guess": (
        language_guess,
        f"""WITH s(w, k, n, o) AS (VALUES {", ".join(f"('{w}', '{k}', {n}, {o})" for w, k, n, o in languages.frequent_words())}),
t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM documents WHERE length(text) >= 50), c AS (SELECT doc_id, k, sum(n) * 100 - any_value(o) AS score FROM t JOIN s USING (w) GROUP BY 1, 2)
SELECT doc_id, g.language FROM documents LEFT JOIN (SELECT doc_id, arg_max(k, score) AS language FROM c GROUP BY 1) g USING (doc_id)""",
    ),
    "usage_left": (
        usage_left,
        """WITH u AS (SELECT CAST(substr(source, 4) AS BIGINT) AS id, count(*) AS used FROM documents GROUP BY 1), l AS (SELECT *, CASE WHEN id % 2 = 0 THEN 40 ELSE 500 END AS lim FROM u)
SELECT id, used, greatest(0, lim - used) AS left, round(least(1.0, used / lim), 4) AS share, CASE WHEN used >= lim THEN 'full' WHEN used >= 0.8 * lim THEN 'high' ELSE 'ok' END AS level FROM l""",
    ),
}
