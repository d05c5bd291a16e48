"""Values as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import _col

STOP_REASONS = {"max_pages": "page limit", "daily_quota": "daily quota", "time_budget": "time limit", "cancelled": "cancelled", "frontier_exhausted": "nothing left to visit"}


def relative_time(ts: Column | str, as_of: Column) -> Column:
    """How long ago, or how soon: now, minutes, hours, days, else the date."""
    s = F.unix_timestamp(as_of) - F.unix_timestamp(_col(ts))
    n = F.abs(s)
    amount = F.when(n < 3600, F.format_string("%dm", (n / 60).cast("int"))).when(n < 86400, F.format_string("%dh", (n / 3600).cast("int"))).otherwise(F.format_string("%dd", (n / 86400).cast("int")))
    side = F.when(s >= 0, F.concat(amount, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), amount))
    return F.when(n < 60, F.lit("now")).when(n < 30 * 86400, side).otherwise(F.date_format(_col(ts), "yyyy-MM-dd"))


def duration(seconds: Column | str) -> Column:
    """Seconds as 45s, 3m 20s or 2h 5m."""
    s = _col(seconds).cast("long")
    part = lambda x: x.cast("int")
    return F.when(s < 60, F.format_string("%ds", part(s))).when(s < 3600, F.format_string("%dm %ds", part(F.floor(s / 60)), part(s % 60))).otherwise(F.format_string("%dh %dm", part(F.floor(s / 3600)), part(F.floor(s / 60) % 60)))


def percent(share: Column | str) -> Column:
    """A share as a whole percentage."""
    return F.format_string("%d%%", F.round(100 * _col(share)).cast("int"))


def stop_reason(code: Column | str) -> Column:
    """A stop reason in words; an unknown one as it is."""
    names = F.create_map(*(F.lit(x) for pair in STOP_REASONS.items() for x in pair))
    return F.coalesce(names[_col(code)], _col(code))


def signature(fingerprint: Column | str) -> Column:
    """A fingerprint as sixteen hexadecimal digits."""
    return F.lower(F.lpad(F.hex(_col(fingerprint)), 16, "0"))
