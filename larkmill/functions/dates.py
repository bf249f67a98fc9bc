"""Date expressions on explicit reference times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def hours_since(ts: Column, ref: Column) -> Column:
    return F.floor((_seconds(ref) - _seconds(ts)) / 3600)


def days_since(ts: Column, ref: Column) -> Column:
    return F.floor((_seconds(ref) - _seconds(ts)) / 86400)


def duration_seconds(start: Column, end: Column) -> Column:
    return F.floor(_seconds(end) - _seconds(start))


def parse_any(text: Column) -> Column:
    """RFC 822 dates, ISO dates with Z, or epoch seconds."""
    rfc = F.regexp_extract(text, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.coalesce(
        F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss")),
        F.when(text.rlike(r"^\d{9,11}$"), F.timestamp_seconds(text.try_cast("long"))),
        F.try_to_timestamp(text),
    )


def _open_end(raw: Column) -> Column:
    return F.lower(F.trim(raw)).isin("present", "current", "now")


def month(raw: Column) -> Column:
    """YYYY-MM of YYYY or YYYY-MM; null for the present, blanks and what can't be read."""
    text = F.trim(raw)
    return F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01"))).when(text.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), text)


def is_current(raw: Column) -> Column:
    return F.coalesce(_open_end(raw), F.lit(False))


def bad_month(raw: Column) -> Column:
    """Neither a month, nor the present, nor blank."""
    return F.coalesce((F.trim(raw) != "") & ~_open_end(raw) & month(raw).isNull(), F.lit(False))
