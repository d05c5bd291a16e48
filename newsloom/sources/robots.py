"""robots.txt as a table of rules, and decisions by joining URLs with it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import urls
from newsloom.session import plain_join

MAX_BYTES = 500 << 10


def product_token(agent: str) -> str:
    """The name at the head of a user agent, in lower case."""
    return re.split("[/ ]", agent.strip(), maxsplit=1)[0].lower()


def rule_regex(path: str) -> str:
    """A path pattern with * and a final $ as a regular expression for the head of a path."""
    body, end = (path[:-1], "$") if path.endswith("$") else (path, "")
    return "^" + ".*".join(re.escape(p) for p in body.split("*")) + end


def parse_robots(text: str) -> tuple[list[tuple[int, str, bool, str]], dict[int, float], list[str]]:
    """Rules (group, agent, allow, path), crawl delays by group, and sitemaps. Agents in a row share a group."""
    rules: list[tuple[int, str, bool, str]] = []
    delays: dict[int, float] = {}
    sitemaps: list[str] = []
    agents: list[str] = []
    group, naming = -1, False
    for raw in text[:MAX_BYTES].splitlines():
        key, colon, value = raw.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "sitemap":
            sitemaps += [value] if value else []
        elif key == "user-agent":
            if not naming:
                group, agents = group + 1, []
            agents.append(value.lower())
            naming = True
            rules.append((group, value.lower(), True, ""))  # the group is there even without rules
        else:
            naming = False
            if key in ("allow", "disallow") and value and group >= 0:
                path = value if value[0] in "/*" else "/" + value
                rules += [(group, a, key == "allow", path) for a in agents]
            elif key == "crawl-delay" and group >= 0:
                try:
                    delays[group] = float(value)
                except ValueError:
                    pass
    return rules, delays, sitemaps


def robots_rules(robots: DataFrame) -> DataFrame:
    """robots (origin, status, text) to rules (origin, agent, allow, path, pattern, specificity, crawl_delay)."""
    fields = {"origin": pa.string(), "agent": pa.string(), "allow": pa.bool_(), "path": pa.string(), "pattern": pa.string(), "specificity": pa.int32(), "crawl_delay": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for origin, text in zip(batch.column("origin").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rules, delays, _ = parse_robots(text or "")
                rows += [(origin, agent, allow, path, rule_regex(path), len(path), delays.get(group)) for group, agent, allow, path in rules]
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, fields.values(), strict=True)], list(fields))

    return robots.select("origin", "text").mapInArrow(run, "origin string, agent string, allow boolean, path string, pattern string, specificity int, crawl_delay double")


def status_policy(status: Column) -> Column:
    """allow_all, disallow_all or rules by the status of the fetch: gone means free, broken or no answer means closed."""
    return F.when(status.between(200, 299), "rules").when((status == 429) | (status >= 500) | status.isNull(), "disallow_all").otherwise("allow_all")


def decide(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """pages (url) with allowed: by the most specific matching rule of the agent's own group, or of all * groups if it has none;
    allow wins ties; URLs of origins without robots.txt are free. URLs meet rules of their origin only."""
    token = product_token(agent)
    rules = robots_rules(robots.filter(status_policy(F.col("status")) == "rules"))
    own = rules.filter(F.col("agent").isin(token, "*"))
    named = own.groupBy("origin").agg(F.max(F.col("agent") == token).alias("named"))
    chosen = own.join(named, "origin").filter(F.col("named") == (F.col("agent") == token)).filter("path != ''").select("origin", "allow", "pattern", "specificity")
    target = F.concat(F.when(urls.path("url") == "", "/").otherwise(F.coalesce(F.try_url_decode(F.replace(urls.path("url"), F.lit("+"), F.lit("%2B"))), urls.path("url"))), F.when(urls.query("url") == "", "").otherwise(F.concat(F.lit("?"), urls.query("url"))))
    keyed = pages.withColumn("_origin", urls.origin("url")).withColumn("_target", target)
    policy = robots.select(F.col("origin").alias("_origin"), status_policy(F.col("status")).alias("_policy"))
    # rules of an origin become one array, so that no URL is multiplied; a robots.txt is at most MAX_BYTES long
    by_origin = chosen.groupBy(F.col("origin").alias("_origin")).agg(F.collect_list(F.struct("specificity", "allow", "pattern")).alias("_rules"))
    joined = plain_join(plain_join(keyed, policy, ["_origin"], "left", spread="url"), by_origin, ["_origin"], "left", spread="url")
    hits = F.filter(F.col("_rules"), lambda r: F.regexp(F.col("_target"), r["pattern"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["specificity"], r["allow"])))
    allowed = F.when(F.col("_policy") == "disallow_all", False).when(F.col("_target") == "/robots.txt", True).otherwise(F.coalesce(best["allow"], F.lit(True)))
    return joined.withColumn("allowed", allowed).drop("_origin", "_target", "_policy", "_rules")
