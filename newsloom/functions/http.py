"""What can be said of a fetch without making one: kind of content, retries, stored page sources."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from newsloom.functions.text import _col

HTML_TYPES = ("text/html", "application/xhtml+xml")
RETRIES, BASE_SECONDS, MAX_SECONDS, MAX_RETRY_AFTER = 3, 0.5, 30.0, 120.0
#: Pages with fewer words than this may be drawn by scripts.
SHELL_SCRIPTS, SHELL_CHARS = 10, 200_000


def is_html(content_type: Column | str, content: Column | str) -> Column:
    """By the declared type, or by how the content begins if none is declared."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(_col(content_type), F.lit("")), ";", 1)))
    head = F.lower(F.ltrim(F.substring(_col(content), 1, 256)))
    return kind.isin(*HTML_TYPES) | ((kind == "") & (head.startswith("<!doctype html") | head.startswith("<html")))


def needs_script(html: Column | str, words: Column, min_words: int = 50) -> Column:
    """A page with little text that scripts would fill."""
    head = F.substring(_col(html), 1, SHELL_CHARS)
    hint = head.rlike(r"""(?i)<div[^>]+id=["'](root|app|__next|___gatsby|svelte)["']|__NEXT_DATA__|window\.__INITIAL_STATE__|enable javascript""")
    return (words < min_words) & (hint | (F.regexp_count(head, F.lit("(?i)<script")) >= SHELL_SCRIPTS))


def backoff_seconds(attempt: Column | str, jitter: Column | float = 1.0) -> Column:
    """Pause before a retry: doubled with each attempt up to a limit, half of it fixed and half by the jitter (0 to 1)."""
    full = F.least(F.lit(MAX_SECONDS), F.lit(BASE_SECONDS) * F.pow(F.lit(2.0), _col(attempt) - 1))
    return full * (F.lit(0.5) + (jitter if isinstance(jitter, Column) else F.lit(jitter)) / 2)


def retry_after_seconds(header: Column | str, as_of: Column) -> Column:
    """Seconds that a Retry-After header asks for, as a number or as a date; NULL if it says nothing or asks for too long."""
    h = F.trim(_col(header))
    date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(h, "^[A-Za-z]{3,9}, ", ""), " GMT$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    number = F.when(h.rlike(r"^[0-9]{1,9}(\.[0-9]+)?$"), F.try_to_number(h, F.lit("999999999D999999")).cast("double"))
    until = F.when(date.isNotNull(), F.greatest(F.lit(0.0), (F.unix_timestamp(date) - F.unix_timestamp(as_of)).cast("double")))
    wait = F.coalesce(number, until)
    return F.when(wait <= MAX_RETRY_AFTER, wait)


@F.pandas_udf(BinaryType())
def gzip_text(text: pd.Series) -> pd.Series:
    """A page's source as it is stored."""

    def pack(t: str) -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(t.encode()) + c.flush()

    return text.map(pack, na_action="ignore")


@F.pandas_udf(StringType())
def gunzip_text(data: pd.Series) -> pd.Series:
    """The source of a stored page; damaged ones are NULL."""

    def unpack(b: bytes) -> str | None:
        try:
            return zlib.decompressobj(31).decompress(b).decode("utf-8", "replace")
        except zlib.error:
            return None

    return data.map(unpack, na_action="ignore")


def newest_source(raw: DataFrame) -> DataFrame:
    """(article_id, html) of each article's last stored source, from raw (id, article_id, content)."""
    last = raw.groupBy("article_id").agg(F.max_by("content", "id").alias("content"))
    return last.select("article_id", gunzip_text("content").alias("html"))
