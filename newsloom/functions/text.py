"""Text scalars: Column expressions, and Arrow UDFs where Spark SQL has no equivalent."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Texts that a UDF has as Python objects at a time.
PART_ROWS = 64
#: Runs of what is no letter, digit or underscore of any script.
NOT_WORDS = r"[^\p{L}\p{N}_]+"


# The words before a byline, what joins names, what separates keywords.
BYLINE_LEAD = r"(?i)^(by|von|par|por|di)\s+"
NAME_JOIN = r"\s+(?:and|&|und|et|y)\s+|,\s*(?=[A-Z])"
KEYWORD_SEPARATOR = "[,;|]"
MAX_KEYWORDS, MAX_NAMES, MAX_ITEM_CHARS = 50, 20, 100


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_for_hash(text: Column | str) -> Column:
    """Lower case, punctuation to spaces, runs of spaces to one, none at the ends. Text is taken as NFKC already; see nfkc()."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), NOT_WORDS, " "))


def in_parts(texts: pa.Array, one: Callable[[str], object], kind: pa.DataType) -> pa.Array:
    """one() of each text that isn't null. A few texts are Python objects at a time, as a batch has up to 64 MB of them."""
    out, begin = [], 0
    while begin < len(texts):
        end = begin + PART_ROWS
        out.append(pa.array([None if t is None else one(t) for t in texts.slice(begin, PART_ROWS).to_pylist()], kind))
        begin = end
    return pa.concat_arrays(out) if out else pa.array([], kind)


@F.arrow_udf(StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return in_parts(text, lambda t: unicodedata.normalize("NFKC", t), pa.string())


def nfkc(text: Column | str) -> Column:
    """Unicode compatibility composition, which Spark SQL lacks, so an Arrow UDF sees the texts that aren't ASCII."""
    c = _col(text)
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(_nfkc(F.when(F.octet_length(c) != F.length(c), c)))


def word_count(text: Column | str) -> Column:
    """Words between spaces of any kind; NULL counts 0."""
    return F.coalesce(F.regexp_count(_col(text), F.lit(r"(?U)\S+")), F.lit(0))


@F.pandas_udf(StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """Character references to characters."""
    return text.map(html.unescape, na_action="ignore")


#: Runs of horizontal white space, the no-break space among it.
_BLANKS = "[ \\t\\r\\f\\x0b\\u00a0]+"


def tidy(text: Column | str) -> Column:
    """Tags to spaces if there are both angle brackets, horizontal white space collapsed; empty is NULL."""
    plain = _col(text)
    untagged = F.when(F.contains(plain, F.lit("<")) & F.contains(plain, F.lit(">")), F.regexp_replace(plain, "<[^>]+>", " ")).otherwise(plain)
    return F.nullif(F.regexp_replace(F.regexp_replace(untagged, _BLANKS, " "), r"(?U)^\s+|\s+$", ""), F.lit(""))


def clean_text(text: Column | str) -> Column:
    """tidy() of a text with its character references resolved."""
    return tidy(unescape_html(_col(text)))


def tidy_body(text: Column | str) -> Column:
    """Lines trimmed and collapsed, at most one blank line between paragraphs; empty is NULL."""
    lines = F.split(_col(text), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]")
    trimmed = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, _BLANKS, " "), r"(?U)^\s+|\s+$", ""))
    joined = F.regexp_replace(F.array_join(trimmed, "\n"), "\n{3,}", "\n\n")
    return F.nullif(F.regexp_replace(joined, r"(?U)^\s+|\s+$", ""), F.lit(""))


def clean_body(text: Column | str) -> Column:
    """tidy_body() of a text with its character references resolved."""
    return tidy_body(unescape_html(_col(text)))


def split_keywords(values: Column | str) -> Column:
    """Keywords of an array of strings, each cut at comma, semicolon or bar: trimmed, 1 to 100 characters, first places kept, 50 at most."""
    parts = F.flatten(F.transform(_col(values), lambda v: F.split(v, KEYWORD_SEPARATOR)))
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.slice(F.array_distinct(F.filter(trimmed, lambda p: (p != "") & (F.length(p) <= MAX_ITEM_CHARS))), 1, MAX_KEYWORDS)


def clean_authors(values: Column | str) -> Column:
    """Names of an array of bylines (plain text): the lead word goes, joined names come apart, 2 to 100 characters, no links,
    first places kept, 20 at most."""
    bare = F.transform(_col(values), lambda v: F.regexp_replace(F.trim(v), BYLINE_LEAD, ""))
    parts = F.flatten(F.transform(bare, lambda v: F.split(v, NAME_JOIN)))
    trimmed = F.transform(parts, lambda p: F.btrim(p, F.lit(" ,;|")))
    link = lambda p: F.lower(p).startswith("http") | F.lower(p).startswith("www.")
    return F.slice(F.array_distinct(F.filter(trimmed, lambda p: F.length(p).between(2, MAX_ITEM_CHARS) & ~link(p))), 1, MAX_NAMES)


def paragraphs(text: Column | str) -> Column:
    """Lines with something on them, trimmed."""
    return F.filter(F.transform(F.split(_col(text), "\n+"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def strip_site_name(title: Column | str, site: Column | str) -> Column:
    """The title without a separator and the site's name at its end; the title itself if nothing would be left."""
    title, site = _col(title), _col(site)
    escaped = F.concat(F.lit(r"\Q"), F.regexp_replace(site, r"\\E", ""), F.lit(r"\E"))
    bare = F.trim(F.regexp_replace(title, F.concat(F.lit(r"\s*[|\-–—:]\s*"), escaped, F.lit(r"\s*$")), F.lit("")))
    return F.when(site.isNull() | (site == "") | (bare == ""), title).otherwise(bare)


_EMAIL = re.compile(r"[^@\s]+@[^@\s]+\.[^@\s]+")


def is_email(text: Column | str) -> Column:
    return _col(text).rlike(f"^(?:{_EMAIL.pattern})$")


def workspace_name(text: Column | str) -> Column:
    """A name with single spaces, none at its ends; empty is NULL."""
    return F.nullif(F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " ")), F.lit(""))


def personal_name(email: Column | str) -> Column:
    """What a person's own workspace is called: after the part of the address before the @, dots and underscores as spaces."""
    local = F.coalesce(F.nullif(F.substring_index(_col(email), "@", 1), F.lit("")), F.lit("My"))
    return F.concat(F.substring(F.trim(F.translate(local, "._", "  ")), 1, 60), F.lit("'s workspace"))
