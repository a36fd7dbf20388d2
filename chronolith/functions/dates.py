"""Dates written in commit logs and in request text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolith.functions.text import strip


def commit_timestamp(text: Column) -> Column:
    """Wall-clock time of 'YYYY-MM-DD HH:MM:SS +ZZZZ'; only the date if the time is unreadable; else NULL."""
    clean = strip(F.get(F.split(text, r"\+"), F.lit(0)))
    dated = clean.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}")
    whole = F.regexp_replace(clean, r"\s-[0-9]{4}$", "").try_cast("timestamp_ntz")
    day = F.get(F.split(clean, " "), F.lit(0)).try_cast("date").cast("timestamp_ntz")
    return F.when(dated, F.coalesce(whole, day))


def month_text(text: Column) -> Column:
    """'YYYY-MM' of a commit date text."""
    return F.substring(F.get(F.split(strip(text), r"\s+"), F.lit(0)), 1, 7)


def folder_stamp(ts: Column) -> Column:
    return F.date_format(ts, "ddMMyyyy_HHmm")


def _part(parts: Column, i: int, default: Column) -> Column:
    return F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), default)


def request_range(text: Column) -> tuple[Column, Column]:
    """First and last day of 'between 2012 and 2014-06': open parts widen to the whole year or month."""
    one = r"([0-9]{4}(?:-[0-9]{1,2}(?:-[0-9]{1,2})?)?)"
    pattern = rf"(?:between|from)\s+{one}\s+(?:to|and)\s+{one}"
    low = F.lower(text)
    first, last = (F.split(F.regexp_extract(low, pattern, i), "-") for i in (1, 2))
    start = F.try_make_timestamp(
        _part(first, 0, F.lit(None)), _part(first, 1, F.lit(1)), _part(first, 2, F.lit(1)), F.lit(0), F.lit(0), F.lit(0)
    ).cast("date")
    month_start = F.try_make_timestamp(
        _part(last, 0, F.lit(None)), _part(last, 1, F.lit(12)), F.lit(1), F.lit(0), F.lit(0), F.lit(0)
    ).cast("date")
    end = F.when(F.get(last, F.lit(2)).isNull(), F.last_day(month_start)).otherwise(
        F.try_make_timestamp(
            _part(last, 0, F.lit(None)), _part(last, 1, F.lit(12)), _part(last, 2, F.lit(1)), F.lit(0), F.lit(0), F.lit(0)
        ).cast("date")
    )
    return start, end


def request_dates(text: Column) -> Column:
    """All years, months or days named in a text, as first days, in order."""
    pattern = r"((?:20|19)[0-9]{2}(?:-[0-9]{1,2}(?:-[0-9]{1,2})?)?)"
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    days = F.transform(
        found,
        lambda t: F.try_make_timestamp(
            _part(F.split(t, "-"), 0, F.lit(None)), _part(F.split(t, "-"), 1, F.lit(1)),
            _part(F.split(t, "-"), 2, F.lit(1)), F.lit(0), F.lit(0), F.lit(0),
        ).cast("date"),
    )
    return F.filter(days, lambda d: d.isNotNull())
