"""Duplicate resolution of the article store: only originals have duplicates, the first to arrive wins, and what is stored stays decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import hashing
from newsloom.functions.text import nfkc, normalize_for_hash, word_count
from newsloom.session import cut, plain_join

MIN_WORDS_NEAR = 50
#: A new extraction this much less confident than the stored one doesn't replace it.
WORSE_BY = 0.1
#: Before all arrivals, and after.
EVER, NEVER = -1, (1 << 63) - 1
WHO = ["workspace_id", "id"]


def fingerprinted(articles: DataFrame, text: str = "body") -> DataFrame:
    """articles with content_hash and, from MIN_WORDS_NEAR words on, simhash."""
    normal = articles.withColumn("_normal", normalize_for_hash(nfkc(text))).withColumn("_long", F.when(word_count(text) >= MIN_WORDS_NEAR, F.col("_normal")))
    return normal.withColumn("content_hash", hashing.hash_of_normal("_normal")).withColumn("simhash", hashing.simhash_of_normal("_long")).drop("_normal", "_long")


def close_fingerprints(left: DataFrame, right: DataFrame, max_distance: int = hashing.MAX_DISTANCE) -> DataFrame:
    """(workspace_id, simhash, other, distance) of the distinct fingerprints of left and right (workspace_id, simhash) within
    max_distance, equal ones too, by an equi-join on pairs of blocks."""
    if not 0 <= max_distance <= hashing.MAX_DISTANCE:
        raise ValueError(f"keys find distances up to {hashing.MAX_DISTANCE} only")

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        distinct = rows.filter("simhash is not null").select("workspace_id", F.col("simhash").alias(name)).distinct()
        return distinct.select("workspace_id", name, F.explode(hashing.block_keys(name)).alias("b")).select("workspace_id", name, "b.band", "b.value")

    met = keyed(left, "simhash").join(keyed(right, "other"), ["workspace_id", "band", "value"]).withColumn("distance", hashing.hamming("simhash", "other"))
    return met.filter(F.col("distance") <= max_distance).select("workspace_id", "simhash", "other", "distance").distinct()


def near_pairs(articles: DataFrame, max_distance: int = hashing.MAX_DISTANCE) -> DataFrame:
    """(workspace_id, id, earlier, distance) of articles (workspace_id, id, simhash) within max_distance. Of those that share a
    fingerprint, the first stands for all on the earlier side, so copies of a text make as many rows as there are, not pairs."""
    # read by several branches, each of which would make the fingerprints again
    known = cut(articles.select("workspace_id", "id", "simhash")).filter("simhash is not null")
    heads = known.groupBy("workspace_id", "simhash").agg(F.min("id").alias("earlier"))
    close = close_fingerprints(known, known, max_distance)
    found = plain_join(known, close, ["workspace_id", "simhash"]).join(heads.withColumnRenamed("simhash", "other"), ["workspace_id", "other"])
    return found.filter("earlier < id").select("workspace_id", "id", "earlier", "distance")


def _decided(nodes: DataFrame, sources: DataFrame, max_distance: int) -> DataFrame:
    """(workspace_id, id, best) of nodes (workspace_id, id, at, content_hash, simhash): the closest original at the time ``at``, NULL
    for an original.

    sources (workspace_id, id, content_hash, simhash, since, until, settled) are texts that articles had from ``since`` to
    ``until``; a settled one's article is an original, another is a node itself. Which nodes are originals is decided in
    rounds, on links between nodes that are still undecided; the closest original is looked for once, at the end.
    """
    then = (F.col("since") < F.col("at")) & (F.col("at") < F.col("until"))
    right = sources.select("workspace_id", F.col("id").alias("earlier"), "content_hash", F.col("simhash").alias("other"), "since", "until", "settled")
    same = plain_join(nodes.filter("content_hash is not null").drop("simhash"), right.filter("content_hash is not null").drop("other"), ["workspace_id", "content_hash"]).filter(then)
    close = cut(close_fingerprints(nodes, sources, max_distance))
    of_node = plain_join(nodes.filter("simhash is not null").drop("content_hash"), close, ["workspace_id", "simhash"])
    near = plain_join(of_node, right.filter("other is not null").drop("content_hash"), ["workspace_id", "other"]).filter(then & (F.col("earlier") != F.col("id")))
    link = F.struct("rank", "earlier")
    ranked = same.select(*WHO, "earlier", "settled", F.lit(-1).alias("rank")).unionByName(near.select(*WHO, "earlier", "settled", F.col("distance").alias("rank")))
    links = cut(ranked.groupBy(*WHO, "earlier", "settled").agg(F.min("rank").alias("rank")))
    # a node that has an original before it is none itself, whatever else is before it; one that has none but such is an original
    waiting = cut(nodes.select(*WHO).join(links.filter("settled").select(*WHO).distinct(), WHO, "left_anti"))
    earlier = lambda rows: rows.select("workspace_id", F.col("id").alias("earlier"))
    open_ = links.filter("not settled").select(*WHO, "earlier").join(waiting, WHO, "left_semi")
    open_ = cut(open_.join(earlier(waiting), ["workspace_id", "earlier"], "left_semi"))
    won: list[DataFrame] = []
    while not waiting.isEmpty():
        fresh = cut(waiting.join(open_.select(*WHO).distinct(), WHO, "left_anti"))
        won.append(fresh)
        beaten = plain_join(open_, earlier(fresh), ["workspace_id", "earlier"], "left_semi").select(*WHO).distinct()
        waiting = cut(waiting.join(fresh.unionByName(beaten), WHO, "left_anti"))
        open_ = plain_join(open_.join(waiting, WHO, "left_semi"), earlier(waiting), ["workspace_id", "earlier"], "left_semi")
        open_ = cut(open_)
    originals = won[0] if won else waiting
    for more in won[1:]:
        originals = originals.unionByName(more)
    originals = cut(originals)
    standing = plain_join(links, earlier(originals).withColumn("original", F.lit(True)), ["workspace_id", "earlier"], "left").filter("settled or original")
    best = standing.groupBy(*WHO).agg(F.min(link).alias("best"))
    return nodes.select(*WHO).join(best, WHO, "left")


def _outcomes(articles: DataFrame, versions: DataFrame, alone: Column, max_distance: int) -> DataFrame:
    """(workspace_id, id, outcome, duplicate_of, distance) of articles (workspace_id, id, at, content_hash, simhash) by _decided().

    Of articles with one hash (with a fingerprint or without), the first stands for all, so that many copies make no more
    links than one; of those without a hash, the first with one fingerprint does: what makes it a near duplicate makes all of
    them so. Articles that are ``alone``, or have neither, stand for themselves.
    """
    kind = ["workspace_id", "text", "bare"]
    alike = F.coalesce(F.concat(F.lit("hash "), "content_hash"), F.concat(F.lit("print "), F.col("simhash").cast("string")))
    base = articles.withColumn("text", alike).withColumn("bare", F.col("simhash").isNull()).withColumn("alone", alone | F.col("text").isNull())
    heads = base.filter("not alone").groupBy(*kind).agg(F.min("id").alias("leader"))
    marked = cut(plain_join(base, heads, kind, "left", spread="id").withColumn("leader", F.when(F.col("alone"), F.col("id")).otherwise(F.col("leader"))))
    leaders = marked.filter("id = leader").select(*WHO, "at", "content_hash", "simhash")
    # texts of articles that don't stand for themselves are those of their leaders
    sources = versions.join(marked.filter("id != leader").select(*WHO), WHO, "left_anti")
    best = cut(_decided(leaders, sources, max_distance))
    of_leader = best.select("workspace_id", F.col("id").alias("leader"), "best", F.lit(True).alias("found"))
    originals = leaders.join(best.filter("best is null").select(*WHO), WHO).filter("content_hash is not null")
    first = originals.groupBy("workspace_id", "content_hash").agg(F.min("id").alias("first"))
    joined = plain_join(plain_join(marked, of_leader, ["workspace_id", "leader"]), first, ["workspace_id", "content_hash"], "left", spread="id")
    # a copy is a duplicate of the first original with its hash; if there is none before it, it is what its leader is (or near
    # that itself, where it has no hash), but that other originals may have come closer since
    copy = F.col("id") != F.col("leader")
    exact = copy & F.coalesce(F.col("first") < F.col("id"), F.lit(False))
    equal = copy & F.col("content_hash").isNull() & F.col("best").isNull()
    found = F.when(exact, F.struct(F.lit(-1).alias("rank"), F.col("first").alias("earlier"))).when(equal, F.struct(F.lit(0).alias("rank"), F.col("leader").alias("earlier"))).otherwise(F.col("best"))
    told = cut(joined.select(*WHO, "at", "simhash", "leader", found.alias("own")))
    again = told.filter(copy & (F.col("own.rank") >= 0)).select(*WHO, "at", "simhash")
    standing = sources.join(best.filter("best is null").select(*WHO, F.lit(True).alias("won")), WHO, "left").filter("settled or won")
    right = standing.filter("simhash is not null").select("workspace_id", F.col("id").alias("earlier"), F.col("simhash").alias("other"), "since", "until")
    met = plain_join(plain_join(again, close_fingerprints(again, standing, max_distance), ["workspace_id", "simhash"]), right, ["workspace_id", "other"])
    closer = met.filter("since < at and at < until").groupBy(*WHO).agg(F.min(F.struct(F.col("distance").alias("rank"), "earlier")).alias("closer"))
    own = F.coalesce("closer", "own")
    outcome = F.when(own.isNull(), "new").when(own["rank"] < 0, "duplicate").otherwise("near_duplicate")
    final = told.join(closer, WHO, "left")
    return final.select(*WHO, outcome.alias("outcome"), own["earlier"].alias("duplicate_of"), F.when(own["rank"] >= 0, own["rank"]).alias("distance"))


def resolve(articles: DataFrame, max_distance: int = hashing.MAX_DISTANCE) -> DataFrame:
    """(workspace_id, id, outcome, duplicate_of, distance) of articles (workspace_id, id, content_hash, simhash) in order of id.

    An article is a duplicate of the first *original* with its content hash, else a near duplicate of the closest earlier
    original (of equally close ones the first), else new. The rounds follow chains of decisions, not the number of articles;
    links are those between different texts.
    """
    # read by several branches, each of which would make the fingerprints again
    base = cut(articles.select(*WHO, F.col("id").alias("at"), "content_hash", "simhash"))
    versions = base.select(*WHO, "content_hash", "simhash", F.col("at").alias("since"), F.lit(NEVER).alias("until"), F.lit(False).alias("settled"))
    return _outcomes(base, versions, F.lit(False), max_distance)


def exact_originals(articles: DataFrame) -> DataFrame:
    """articles (id, content_hash) with duplicate_of: the first id with the same hash, NULL for that one and for no hash."""
    first = articles.filter("content_hash is not null").groupBy("content_hash").agg(F.min("id").alias("_first"))
    out = plain_join(articles, first, ["content_hash"], "left", spread="id")
    return out.withColumn("duplicate_of", F.when(F.col("_first") < F.col("id"), F.col("_first"))).drop("_first")


def duplicates_of(articles: DataFrame, article_id: int, limit: int = 200) -> DataFrame:
    """The copies of one article, by id."""
    return articles.filter(F.col("duplicate_of") == article_id).orderBy("id").limit(limit)


def fold_updates(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """What arrivals do to stored articles with the same canonical URL, one after the other.

    Both have (workspace_id, canonical_url, title, content_hash, confidence), incoming also arrival. A row (workspace_id,
    canonical_url, arrival, outcome) comes back for each arrival: outcome first, unchanged or updated. Unchanged: same hash and
    title, or clearly less confident. Arrivals without a URL are all first. One URL's arrivals are one row on the way:
    revisits of a page, not a share of the table.
    """
    key = ["workspace_id", "canonical_url"]
    event = F.struct("arrival", "title", "content_hash", "confidence")
    events = incoming.filter("canonical_url is not null").groupBy(*key).agg(F.array_sort(F.collect_list(event)).alias("events"))
    held = stored.filter("canonical_url is not null").select(*key, F.struct(F.lit(EVER).cast("long").alias("arrival"), "title", "content_hash", "confidence").alias("held"))
    said = "array<struct<arrival:bigint,outcome:string>>"

    def step(state: Column, x: Column) -> Column:
        was = state["held"]
        same = x["content_hash"].eqNullSafe(was["content_hash"]) & x["title"].eqNullSafe(was["title"])
        worse = F.coalesce(x["confidence"] + F.lit(WORSE_BY) < was["confidence"], F.lit(False))
        outcome = F.when(was.isNull(), "first").when(same | worse, "unchanged").otherwise("updated")
        now = F.when(outcome == "unchanged", was).otherwise(x)
        return F.struct(now.alias("held"), F.array_append(state["said"], F.struct(x["arrival"].alias("arrival"), outcome.alias("outcome"))).alias("said"))

    folded = events.join(held, key, "left").withColumn("held", F.col("held").cast(events.schema["events"].dataType.elementType))
    out = F.aggregate("events", F.struct(F.col("held"), F.array().cast(said).alias("said")), step, lambda state: state["said"])
    with_url = folded.select(*key, F.inline(out))
    return with_url.unionByName(incoming.filter("canonical_url is null").select(*key, F.col("arrival").cast("long"), F.lit("first").alias("outcome")))


STORED = ["workspace_id", "id", "canonical_url", "title", "body", "confidence", "content_hash", "simhash", "duplicate_of"]


def upsert(stored: DataFrame, incoming: DataFrame, originals: DataFrame | None = None, top: int | None = None, max_distance: int = hashing.MAX_DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, outcome of each arrival) for a store of articles, as if the arrivals came one after the other.

    stored has (workspace_id, id, canonical_url, title, body, confidence, content_hash, simhash, duplicate_of); incoming has
    (workspace_id, arrival, canonical_url, title, body, confidence), numbers of arrival being unique; fingerprints that it has
    already (content_hash and simhash) are taken. Ids of new articles
    follow the greatest stored one in order of arrival. An update replaces title, body, confidence and fingerprints, leaves
    duplicate_of as it is, and counts for what arrives later, also in the same batch: originals stay originals, whatever
    they come near to. Articles without a canonical URL stand alone. Where stored is only the part of a store that has the
    URLs of incoming, ``originals`` has (workspace_id, id, canonical_url, content_hash, simhash) of all its originals and ``top``
    the greatest id.
    """
    key = ["workspace_id", "canonical_url"]
    texts = ["title", "body", "confidence", "content_hash", "simhash"]
    printed = incoming if {"content_hash", "simhash"} <= set(incoming.columns) else fingerprinted(incoming)
    marked = cut(printed.withColumn("arrival", F.col("arrival").cast("long")))
    folded = cut(fold_updates(stored, marked))
    top = (stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) if top is None else top
    originals = (stored.filter("duplicate_of is null") if originals is None else originals).select(*WHO, "canonical_url", "content_hash", "simhash")
    taken = folded.filter("outcome != 'unchanged'").join(marked, [*key, "arrival"]).unionByName(folded.filter("canonical_url is null").join(marked.drop("canonical_url"), ["workspace_id", "arrival"]))
    # how long each text stood
    lasting = F.lead("arrival").over(Window.partitionBy(*key, F.when(F.col("canonical_url").isNull(), F.col("arrival"))).orderBy("arrival"))
    taken = cut(taken.withColumn("until", F.coalesce(lasting, F.lit(NEVER))))
    firsts = cut(_number(taken.filter("outcome = 'first'"), "arrival").withColumn("id", F.col("n") + F.lit(top)).drop("n"))
    updates = taken.filter("outcome = 'updated'")
    changed = updates.groupBy(*key).agg(F.min("arrival").alias("until"))
    old = originals.join(changed, key, "left").select(*WHO, "content_hash", "simhash", F.lit(EVER).cast("long").alias("since"), F.coalesce("until", F.lit(NEVER)).alias("until"), F.lit(True).alias("settled"))
    new = firsts.select(*WHO, "content_hash", "simhash", F.col("arrival").alias("since"), "until", F.lit(False).alias("settled"))
    whose = originals.filter("canonical_url is not null").select(*key, "id", F.lit(True).alias("settled")).unionByName(firsts.filter("canonical_url is not null").select(*key, "id", F.lit(False).alias("settled")))
    later = updates.join(whose, key).select(*WHO, "content_hash", "simhash", F.col("arrival").alias("since"), "until", "settled")
    versions = cut(old.unionByName(new).unionByName(later))
    # copies of a text that an update in this batch brings in, takes away or comes near to are looked at one by one
    restless = versions.filter(F.col("until") != F.lit(NEVER)).unionByName(later)
    noisy = cut(close_fingerprints(firsts, restless, max_distance).select("workspace_id", "simhash").distinct().withColumn("noisy", F.lit(True)))
    stirred = cut(restless.filter("content_hash is not null").select("workspace_id", "content_hash").distinct().withColumn("stirred", F.lit(True)))
    nodes = firsts.select(*WHO, F.col("arrival").alias("at"), "content_hash", "simhash").join(noisy, ["workspace_id", "simhash"], "left").join(stirred, ["workspace_id", "content_hash"], "left")
    decisions = cut(_outcomes(nodes, versions, F.coalesce("noisy", "stirred", F.lit(False)), max_distance))
    fresh = firsts.join(decisions.select(*WHO, F.col("outcome").alias("said"), "duplicate_of", "distance"), WHO)
    newest = updates.groupBy(*key).agg(F.max_by(F.struct(*texts), "arrival").alias("now"))
    everything = stored.select(*STORED).unionByName(fresh.select(*STORED))
    snapshot = everything.join(newest, key, "left").select(*WHO, "canonical_url", *(F.when(F.col("now").isNull(), F.col(c)).otherwise(F.col("now")[c]).alias(c) for c in texts), "duplicate_of")
    told = fresh.select("workspace_id", "arrival", "said", "duplicate_of", "distance")
    outcomes = folded.join(told, ["workspace_id", "arrival"], "left").select("workspace_id", "arrival", "canonical_url", F.coalesce("said", "outcome").alias("outcome"), "duplicate_of", "distance")
    return snapshot.select(*STORED), outcomes


def _number(rows: DataFrame, order: str) -> DataFrame:
    """rows with n = 1, 2, ... in an order: ranks within ranges of it, after the counts of the ranges before."""
    ranged = cut(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    table = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _before long")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.join(F.broadcast(table), "_part").withColumn("n", rank + F.col("_before")).drop("_part", "_before")

