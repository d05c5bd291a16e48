"""Merging of candidates, confidence, classification and the article row: Column expressions over extract_candidates()."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import hashing, urls
from newsloom.functions.display import signature
from newsloom.functions.languages import detect_language, normalize_language
from newsloom.functions.text import normalize_for_hash, strip_site_name
from newsloom.sources import extraction

MIN_WORDS, THRESHOLD = 120, 0.5
# What each sign adds to the score of an article.
AMOUNTS = {
    "type": 0.4, "listing": -0.25, "og": 0.2, "date": 0.15, "author": 0.05, "body": 0.25, "short": 0.05, "little": -0.2, "long": 0.1,
    "paragraphs": 0.1, "element": 0.05, "links": -0.2, "good url": 0.1, "bad url": -0.25,
}
# The reasons as they are shown.
REASONS = {
    "type": "json-ld type {}", "listing": "json-ld listing type", "og": "og:type=article", "date": "has publish date", "author": "has author",
    "body": "body {} words", "short": "short body {} words", "little": "little text ({} words)", "long": "long body", "paragraphs": "{} substantial paragraphs",
    "element": "<article> element", "links": "high link density {}", "good url": "article-like url", "bad url": "listing/home url",
    "veto short": "veto: body too short for a text article ({} words)", "veto noindex": "veto: meta robots noindex",
    "confirmed": "+ fallback strategy confirmed article", "rejected": "- fallback strategy rejected article",
}
LONG_WORDS, MANY_PARAGRAPHS, MANY_LINKS, GOOD_URL, BAD_URL = 300, 3, 0.5, 0.5, 0.1
# The share of each field in the confidence of a page.
WEIGHTS = {"title": 0.20, "body": 0.35, "published_at": 0.15, "authors": 0.10, "description": 0.05, "image_url": 0.05, "language": 0.05, "canonical_url": 0.05}


def merged(field: str, candidates: Column | str = "candidates") -> Column:
    """The best candidate of a field: the most confident, of equals the one of the earlier strategy. A body counts less the
    shorter it is than the longest one."""
    c = F.col(candidates) if isinstance(candidates, str) else candidates
    own = F.filter(c, lambda x: x["field"] == field)
    score = lambda x: x["confidence"]
    if field == "body":
        longest = F.greatest(F.array_max(F.transform(own, lambda x: x["words"])), F.lit(1))
        score = lambda x: x["confidence"] * F.sqrt(F.least(F.lit(1.0), x["words"] / longest))
    ranked = F.transform(own, lambda x: F.struct(score(x).alias("score"), (-x["ord"]).alias("order"), x["value"].alias("value"), x["values"].alias("values"), x["confidence"].alias("confidence"), x["source"].alias("source"), x["words"].alias("words")))
    return F.array_max(ranked)


def raw_confidence(best: dict[str, Column], min_words: int = MIN_WORDS) -> Column:
    """Weighted confidence of the merged fields, 0 to 1, not rounded."""
    total = F.lit(0.0)
    for field, weight in WEIGHTS.items():
        part = best[field]["confidence"]
        if field == "body":
            part = part * F.least(F.lit(1.0), best[field]["words"] / F.lit(float(max(min_words, 1))))
        total = total + F.coalesce(weight * part, F.lit(0.0))
    return F.least(F.lit(1.0), total)


def confidence(best: dict[str, Column], min_words: int = MIN_WORDS) -> Column:
    return F.round(raw_confidence(best, min_words), 3)


def _reason(key: str, value: Column | None = None) -> Column:
    head, _, tail = REASONS[key].partition("{}")
    return F.lit(head) if value is None else F.concat(F.lit(head), value.cast("string"), F.lit(tail))


def score_terms(words: Column, signals: Column, has_date: Column, has_author: Column, url_score: Column, min_words: int = MIN_WORDS) -> list[tuple[Column, Column]]:
    """(amount or NULL, reason) of each sign that a page is an article, in order. Of the signs in one group the first that is there counts."""
    s, enough = signals, words >= min_words
    groups: list[dict[str, tuple[Column, Column | None]]] = [
        {"type": (s["article_type"].isNotNull(), s["article_type"])},
        {"listing": (s["is_listing"], None)},
        {"og": (F.lower(s["og_type"]) == "article", None)},
        {"date": (has_date, None)},
        {"author": (has_author, None)},
        {"body": (enough, words), "short": (words >= min_words // 2, words), "little": (F.lit(True), words)},
        {"long": (enough & (words >= LONG_WORDS), None)},
        {"paragraphs": (s["paragraphs"] >= MANY_PARAGRAPHS, s["paragraphs"])},
        {"element": (s["has_article_tag"], None)},
        {"links": (s["link_density"] > MANY_LINKS, s["link_density"])},
        {"good url": (url_score >= GOOD_URL, None), "bad url": (url_score <= BAD_URL, None)},
    ]
    terms = []
    for group in groups:
        amount = why = F.lit(None)
        for key, (test, value) in reversed(group.items()):
            amount = F.when(test, F.lit(AMOUNTS[key])).otherwise(amount)
            why = F.when(test, _reason(key, value)).otherwise(why)
        terms.append((amount, why))
    return terms


def classify(terms: list[tuple[Column, Column]], words: Column, noindex: Column, min_words: int = MIN_WORDS, threshold: float = THRESHOLD) -> tuple[Column, Column, Column]:
    """(is_article, score, reasons): the sum of the terms, kept within 0 and 1; too little text and noindex are vetoes."""
    total = F.lit(0.0)
    for amount, _ in terms:
        total = total + F.coalesce(amount, F.lit(0.0))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3)
    short = words < max(30, min_words // 4)
    said = [F.when(a.isNotNull(), F.concat(F.format_string("%+.2f ", a), why)) for a, why in terms]
    said.append(F.when(short, _reason("veto short", words)).when(noindex, _reason("veto noindex")))
    return (score >= threshold) & ~short & ~noindex, score, F.array_compact(F.array(*said))


def needs_fallback(confidence_: Column, score: Column, url_score: Column, page_words: Column, noindex: Column, min_words: int = MIN_WORDS) -> Column:
    """Whether a costly strategy is worth its while."""
    promising = (score >= 0.2) | ((url_score >= 0.5) & (F.coalesce(page_words, F.lit(0)) >= min_words))
    return (confidence_ < 0.55) & ~noindex & promising


def build_articles(extracted: DataFrame, min_words: int = MIN_WORDS, threshold: float = THRESHOLD, keep: dict[str, Column] | None = None) -> DataFrame:
    """One article row for each extracted page, with columns to keep at the end."""
    fields = [*WEIGHTS, "modified_at", "category", "tags", "site_name"]
    best = extracted.select("*", *(merged(f).alias(f"_{f}") for f in fields))
    b = {f: F.col(f"_{f}") for f in fields}
    words = F.coalesce(b["body"]["words"], F.lit(0))
    noindex = F.array_contains("directives", "noindex") | F.array_contains("directives", "none")
    nofollow = F.array_contains("directives", "nofollow") | F.array_contains("directives", "none")
    prior = urls.article_url_score(F.col("url"))
    terms = score_terms(words, F.col("signals"), b["published_at"].isNotNull(), b["authors"].isNotNull(), prior, min_words)
    is_article, score, reasons = classify(terms, words, noindex, min_words, threshold)
    page_url = urls.normalize_url(F.col("url"))
    canonical = urls.resolve_url(b["canonical_url"]["value"], F.col("url"))
    out = best.withColumn("_page", page_url).withColumn("_canonical", canonical)
    same = F.col("_canonical").startswith("http") & (urls.registrable_domain(urls.host("_canonical")) == urls.registrable_domain(urls.host("_page")))
    return out.select(
        "page_id",
        F.col("_page").alias("url"),
        F.when(same, F.col("_canonical")).otherwise(F.col("_page")).alias("canonical_url"),
        strip_site_name(b["title"]["value"], b["site_name"]["value"]).alias("title"),
        b["body"]["value"].alias("body"),
        F.coalesce(b["authors"]["values"], F.array().cast("array<string>")).alias("authors"),
        F.try_to_timestamp(b["published_at"]["value"]).alias("published_at"),
        F.try_to_timestamp(b["modified_at"]["value"]).alias("modified_at"),
        b["description"]["value"].alias("description"),
        b["image_url"]["value"].alias("image_url"),
        b["category"]["value"].alias("category"),
        F.coalesce(b["tags"]["values"], F.array().cast("array<string>")).alias("tags"),
        F.coalesce(normalize_language(b["language"]["value"]), detect_language(b["body"]["value"])).alias("language"),
        b["site_name"]["value"].alias("site_name"),
        words.alias("word_count"),
        confidence(b, min_words).alias("confidence"),
        score.alias("article_score"),
        is_article.alias("is_article"),
        F.coalesce(b["body"]["source"], b["title"]["source"]).alias("primary_method"),
        F.map_filter(F.create_map(*(x for f in fields for x in (F.lit(f), b[f]["source"]))), lambda _, v: v.isNotNull()).alias("field_sources"),
        noindex.alias("noindex"),
        nofollow.alias("nofollow"),
        F.when(F.col("_canonical").isNotNull() & ~F.coalesce(same, F.lit(False)), F.col("_canonical")).alias("external_canonical"),
        reasons.alias("reasons"),
        needs_fallback(confidence(b, min_words), score, prior, F.col("signals")["page_words"], noindex, min_words).alias("needs_fallback"),
        *(c.alias(name) for name, c in (keep or {}).items()),
    )


def extract_articles(pages: DataFrame, as_of: datetime, bot: str = "newsloom", min_words: int = MIN_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Article rows of pages (page_id, url, html), with used_fallback. Where the page is promising but confidence stays low, the
    fallback strategies run too, on those pages only; a verdict of theirs (signal is_article) decides if it says no, or if it
    says yes and their candidates made confidence greater."""
    fallback = bool(extraction.strategies(fallback=True))
    first = extraction.extract_candidates(pages, as_of, bot, keep_html=fallback)
    if not fallback:
        return build_articles(first, min_words, threshold).withColumn("used_fallback", F.lit(False))
    judged = build_articles(first, min_words, threshold, {"_row": F.struct(*first.columns)}).select("_row", "needs_fallback", F.col("confidence").alias("_before"))
    again = extraction.add_fallbacks(judged.select("_row.*", "needs_fallback", "_before"), as_of)
    more = {"used_fallback": F.col("used_fallback"), "_before": F.col("_before"), "_verdict": F.when(F.col("used_fallback"), F.col("signals")["is_article"])}
    out = build_articles(again, min_words, threshold, more)
    yes, no = F.coalesce(F.col("_verdict") & (F.col("confidence") > F.col("_before")), F.lit(False)), F.coalesce(~F.col("_verdict"), F.lit(False))
    said = F.when(yes, F.lit(REASONS["confirmed"])).when(no, F.lit(REASONS["rejected"]))
    columns = {
        "is_article": (F.col("is_article") | yes) & ~no,
        "article_score": F.when(yes, F.greatest(F.col("article_score"), F.lit(threshold))).otherwise(F.col("article_score")),
        "reasons": F.array_compact(F.array_append("reasons", said)),
        "confidence": F.greatest("confidence", "_before"),
    }
    return out.withColumns(columns).drop("_before", "_verdict")


def trace(extracted: DataFrame, clip: int = 500, links: int = 100) -> DataFrame:
    """(page_id, trace) with every strategy's candidates and the fingerprints of the best body as JSON, for people who look into
    one page; long values are clipped."""
    shown = F.transform(
        "candidates",
        lambda c: F.struct(c["source"].alias("strategy"), c["field"].alias("field"), F.substring(c["value"], 1, clip).alias("value"), c["values"].alias("values"), c["confidence"].alias("confidence")),
    )
    normal = extracted.withColumn("_normal", normalize_for_hash(merged("body")["value"]))
    printed = normal.withColumn("_hash", hashing.hash_of_normal("_normal")).withColumn("_simhash", signature(hashing.simhash_of_normal("_normal")))
    prints = F.struct(F.col("_hash").alias("content_hash"), F.col("_simhash").alias("simhash"))
    parts = [shown.alias("candidates"), "signals", "directives", prints.alias("fingerprints"), F.slice("links", 1, links).alias("links"), "feeds", "errors"]
    return printed.select("page_id", F.to_json(F.struct(*parts)).alias("trace"))
