"""Search over articles: filters, substring terms, boolean full text with phrases, weighted rank, and a registry of backends."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from newsloom.session import stash

MAX_TERMS = 10
#: Weight of a term in the title, the description and the body.
FIELD_WEIGHTS = {"title": 1.0, "description": 0.4, "body": 0.2}


@dataclass
class SearchQuery:
    """What a search asks for; None means any."""

    workspace_id: int | None = None
    q: str | None = None
    source_id: int | None = None
    language: str | None = None
    category: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    min_confidence: float | None = None
    include_duplicates: bool = False
    sort: str = "published_at"
    limit: int = 50
    offset: int = 0

    def __post_init__(self) -> None:
        if not 0 < self.limit <= 200 or not 0 <= self.offset <= 100_000:
            raise ValueError("limit is 1 to 200, offset 0 to 100000")


@dataclass
class SearchPage:
    """One page of results, the number of all, the backend, and scores by id where there are any."""

    items: DataFrame
    total: DataFrame
    backend: str
    scores: DataFrame | None = field(default=None)


def apply_filters(articles: DataFrame, query: SearchQuery) -> DataFrame:
    """Plain conjunctive predicates, which reach the scan. A NULL publication date is in no range."""
    tests = [
        (query.workspace_id, lambda v: F.col("workspace_id") == v),
        (query.source_id, lambda v: F.col("source_id") == v),
        (query.language, lambda v: F.col("language") == v.lower()),
        (query.category, lambda v: F.col("category") == v),
        (query.since, lambda v: F.col("published_at") >= F.lit(v)),
        (query.until, lambda v: F.col("published_at") < F.lit(v)),
        (query.min_confidence, lambda v: F.col("confidence") >= v),
    ]
    for value, test in tests:
        if value is not None:
            articles = articles.filter(test(value))
    return articles if query.include_duplicates else articles.filter("duplicate_of_id is null")


def like_terms(columns: list[str], q: str | None) -> Column | None:
    """Each of the first MAX_TERMS words stands somewhere in one of the columns, in any case; % and _ mean themselves."""
    out = None
    for term in (q or "").split()[:MAX_TERMS]:
        pattern = "%" + re.sub(r"([\\%_])", r"\\\1", term) + "%"
        hit = None
        for c in columns:
            test = F.coalesce(F.col(c).ilike(pattern), F.lit(False))
            hit = test if hit is None else hit | test
        out = hit if out is None else out & hit
    return out


def tokens(text: Column) -> Column:
    """Words in lower case, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def parse_query(q: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives (or), each of terms (wanted, words): several words are a phrase, a leading - excludes."""
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)"([^"]*)"|(\S+)', q):
        if word.lower() == "or":
            if out[-1]:
                out.append([])
            continue
        excluded = bool(minus) or word.startswith("-")
        words = [w for w in re.split(r"\W+", (phrase or word).lower()) if w]
        if words:
            out[-1].append((not excluded, words))
    return [alternative for alternative in out if alternative]


def phrase_in(toks: Column, words: list[str]) -> Column:
    """The words stand next to each other."""
    if len(words) == 1:
        return F.array_contains(toks, words[0])
    joined = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
    return F.contains(joined, F.lit(f" {' '.join(words)} "))


def matches(fields: dict[str, Column], q: str) -> Column:
    """Whether a query matches any of the fields' token arrays; a query without words matches nothing."""

    def somewhere(words: list[str]) -> Column:
        hit = F.lit(False)
        for toks in fields.values():
            hit = hit | phrase_in(toks, words)
        return hit

    out = F.lit(False)
    for alternative in parse_query(q):
        all_of = F.lit(True)
        for wanted, words in alternative:
            all_of = all_of & (somewhere(words) if wanted else ~somewhere(words))
        out = out | all_of
    return out


def cover_density(places: list[tuple[int, str, float]], alternatives: list[set[str]]) -> float:
    """Rank of a document by its covers: the shortest stretches of its places (position, word, weight; in order) that hold all words of
    an alternative. A cover counts the harmonic mean of its places' weights, divided by one more than the words between."""
    total, begin = 0.0, 0
    while begin < len(places):
        # the first place up to which an alternative is whole
        held: set[str] = set()
        end = next((i for i in range(begin, len(places)) if held.add(places[i][1]) or any(a <= held for a in alternatives)), None)
        if end is None:
            break
        # from there backwards, the last place from which one is
        held = set()
        begin = next(i for i in range(end, begin - 1, -1) if held.add(places[i][1]) or any(a <= held for a in alternatives))
        inside = places[begin : end + 1]
        between = inside[-1][0] - inside[0][0] - (len(inside) - 1)
        total += len(inside) / sum(1 / w for _, _, w in inside) / (1 + max(between, 0))
        begin += 1
    return total


def _scorer(q: str) -> Callable[[Column], Column]:
    """An Arrow UDF from a document's places (position, term, weight) of a query's words to its rank, NULL where it doesn't match."""
    parsed = parse_query(q)
    wanted = [{w for keep, words in a if keep for w in words} for a in parsed]

    def score(places: list | None) -> float | None:
        found = sorted((p["pos"], p["term"], p["weight"]) for p in (places if places is not None else []))
        at: dict[str, set[int]] = {}
        for pos, term, _ in found:
            at.setdefault(term, set()).add(pos)
        there = lambda words: any(all(p + k in at.get(w, ()) for k, w in enumerate(words)) for p in at.get(words[0], ()))
        held = [w for w, a in zip(wanted, parsed, strict=True) if all(there(words) == keep for keep, words in a)]
        return cover_density(found, [w for w in held if w]) if held else None

    @F.pandas_udf(DoubleType())
    def scored(places: pd.Series) -> pd.Series:
        return pd.Series([score(p) for p in places], dtype="float64")

    return scored


def default_order(query: SearchQuery) -> list[Column]:
    """Newest first, those without a date last, then the greatest id; or by the time of storing."""
    if query.sort == "created_at":
        return [F.col("created_at").desc(), F.col("id").desc()]
    return [F.col("published_at").desc_nulls_last(), F.col("id").desc()]


Backend = Callable[[DataFrame, SearchQuery, DataFrame | None], SearchPage]
_backends: dict[str, Backend] = {}


def register_backend(name: str, backend: Backend) -> None:
    _backends[name] = backend


def search(articles: DataFrame, query: SearchQuery, backend: str = "auto", index: DataFrame | None = None) -> SearchPage:
    """A page of articles (id, workspace_id, title, description, body, ...) by one of the backends; by default full text where there
    is an index (see postings()), else substrings. Without an index full text reads the articles' words anew."""
    name = backend if backend != "auto" else "fulltext" if index is not None else "like"
    if name not in _backends:
        raise KeyError(f"no backend {name!r}; there are {sorted(_backends)}")
    return _backends[name](articles, query, index)


def _page(found: DataFrame, query: SearchQuery, order: list[Column], name: str, score: str | None = None) -> SearchPage:
    items = found.orderBy(*order).limit(query.limit + query.offset).offset(query.offset)
    return SearchPage(items, found.agg(F.count(F.lit(1)).alias("total")), name, items.select("id", score) if score else None)


def _like(articles: DataFrame, query: SearchQuery, index: DataFrame | None = None) -> SearchPage:
    """Substring search; it has no rank, so relevance falls back to the date."""
    found = apply_filters(articles, query)
    test = like_terms(["title", "description", "body"], query.q)
    return _page(found if test is None else found.filter(test), query, default_order(query), "like")


def _fulltext(articles: DataFrame, query: SearchQuery, index: DataFrame | None = None) -> SearchPage:
    """Boolean full text with phrases, by a join with the postings of the query's words only."""
    if not (query.q or "").strip():
        page = _like(articles, query)
        return SearchPage(page.items, page.total, "fulltext")
    found = apply_filters(articles, query)
    parsed = parse_query(query.q)
    words = sorted({w for a in parsed for _, words in a for w in words})
    hits = (postings(found) if index is None else index).filter(F.col("term").isin(words))
    place = F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("term").alias("term"), F.col("weight").alias("weight")))
    per_id = hits.groupBy("id").agg(F.flatten(F.collect_list(place)).alias("places"))
    # what has none of the words can match only if some alternative asks for none
    how = "left" if any(not any(keep for keep, _ in a) for a in parsed) else "inner"
    ranked = found.join(per_id, "id", how).withColumn("rank", _scorer(query.q)("places")).drop("places").filter("rank is not null")
    order = [F.col("rank").desc(), F.col("published_at").desc_nulls_last(), F.col("id").desc()] if query.sort == "relevance" else default_order(query)
    return _page(ranked, query, order, "fulltext", "rank")


register_backend("like", _like)
register_backend("fulltext", _fulltext)


def _runs(words: Column | str) -> Column:
    """Array of (term, positions) of an array of words: each different word with its places in it, in order. Words are sorted with
    their places, so that equal ones stand together."""
    placed = F.array_sort(F.transform(words, lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))

    def cut_up(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["term"] != F.get(s, i - 1)["term"]), i)), lambda i: i.isNotNull())
        ends = lambda b: F.transform(b, lambda x, k: F.struct(x.alias("at"), (F.coalesce(F.get(b, k + 1), F.size(s)) - x).alias("n")))
        # an array of one is the way to give a value a name
        pieces = F.flatten(F.transform(F.array(begins), ends))
        return F.transform(pieces, lambda p: F.struct(F.get(s, p["at"])["term"].alias("term"), F.transform(F.slice(s, p["at"] + 1, p["n"]), lambda x: x["pos"]).alias("positions")))

    return F.flatten(F.transform(F.array(placed), cut_up))


def postings(articles: DataFrame) -> DataFrame:
    """The inverted index: (term, id, field, weight, positions), to be stored where one corpus is searched often. Positions go on from
    field to field. Made within each row of articles, without an exchange; rows that share an id have postings of their own."""
    read = articles.select("id", *(tokens(F.col(c)).alias(c) for c in FIELD_WEIGHTS))
    parts, before = [], F.lit(0)
    for c, weight in FIELD_WEIGHTS.items():
        posting = lambda r: F.struct(r["term"].alias("term"), F.lit(c).alias("field"), F.lit(weight).alias("weight"), F.transform(r["positions"], lambda p: p + before).alias("positions"))  # noqa: B023, E731
        parts.append(F.transform(_runs(c), posting))
        before = before + F.size(c)
    return read.select("id", F.inline(F.concat(*parts))).select("term", "id", "field", "weight", "positions")


def term_counts(articles: DataFrame, field: str = "body") -> DataFrame:
    """(term, docs, places) of a field: documents that have a word, and how often it stands in them; rows that share an id are one
    document, those without an id none. A row's different words are found within it, so that partial counts are by word alone."""
    read = articles.select("id", tokens(F.col(field)).alias("words"))
    once = F.when(F.col("id").isNotNull(), F.array_distinct("words"))
    side = lambda words, docs, places: F.struct(words.alias("words"), F.lit(docs).alias("docs"), F.lit(places).alias("places"))
    sides = read.select(F.inline(F.array(side(F.col("words"), 0, 1), side(once, 1, 0))))
    each = sides.select(F.explode("words").alias("term"), "docs", "places")
    shared = stash(articles.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("id is not null and rows > 1").select("id"))
    if not shared.isEmpty():
        # of the rows of one document that have a word all but one count less
        again = read.join(shared, "id").select("id", F.explode(F.array_distinct("words")).alias("term")).groupBy("term", "id").agg((1 - F.count(F.lit(1))).alias("docs"))
        each = each.unionByName(again.select("term", "docs", F.lit(0).alias("places")))
    return each.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("places").alias("places"))
