"""Dates as they stand in pages and feeds."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from newsloom.functions.text import _col

EARLIEST = "1990-01-01"
#: Formats that are tried one after the other before the fuzzy parser.
FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "yyyy/MM/dd")


def plausible(ts: Column, as_of: Column) -> Column:
    """The time if it is no earlier than 1990 and no later than two days after as_of, else NULL."""
    return F.when((ts >= F.lit(EARLIEST).cast("timestamp")) & (ts <= as_of + F.expr("INTERVAL 2 DAYS")), ts)


def parse_date(text: Column | str, as_of: Column) -> Column:
    """ISO 8601, RFC 822 and a few plain forms; seconds or milliseconds since 1970; no zone means UTC."""
    t = F.trim(_col(text))
    number = F.when(t.rlike(r"^[0-9]{9,16}(\.[0-9]+)?$"), F.try_to_number(t, F.lit("9999999999999999D9999")).cast("double"))
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    # Spark reads no names of days, and zones as numbers only
    named = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3,9}, ", ""), r" (GMT|UT|UTC|Z)$", " +0000")
    forms = [F.try_to_timestamp(named, F.lit(f)) for f in FORMATS]
    ts = F.coalesce(F.when(number.isNotNull(), F.timestamp_seconds(seconds)), F.when(F.length(t) <= 100, F.coalesce(F.try_to_timestamp(t), *forms)))
    return plausible(ts, as_of)


def parse_loose(value: object, as_of: datetime) -> datetime | None:
    """Any date that dateutil can read, strictly or else amid other words."""
    from dateutil import parser

    if value is None or value == "":
        return None
    try:
        if isinstance(value, (int, float)):
            ts = datetime.fromtimestamp(value / 1000 if value > 1e11 else value, UTC)
        else:
            text = str(value).strip()
            if not text or len(text) > 100:
                return None
            try:
                ts = parser.parse(text)
            except (ValueError, OverflowError, TypeError):
                ts = parser.parse(text, fuzzy=True)
        ts = ts.replace(tzinfo=UTC) if ts.tzinfo is None else ts.astimezone(UTC)
    except (ValueError, OverflowError, TypeError, OSError):
        return None
    return ts if datetime(1990, 1, 1, tzinfo=UTC) <= ts <= as_of + timedelta(days=2) else None


def fuzzy_date(text: Column | str, as_of: datetime) -> Column:
    """parse_loose() as a Column; as_of must have a zone."""

    @F.pandas_udf(TimestampType())
    def run(values: pd.Series) -> pd.Series:
        found = [parse_loose(v, as_of) for v in values]
        return pd.to_datetime(pd.Series([None if x is None else x.replace(tzinfo=None) for x in found]))

    return run(_col(text))
