"""Dates and durations typed freely."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_day(raw: Column) -> Column:
    """The date of a full ISO day; null for anything else, impossible days included."""
    return F.when(F.trim(raw).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.trim(raw), "yyyy-MM-dd"))


def parse_day(raw: Column, today: Column) -> Column:
    """A day as owners write it: today or yesterday (English, Spanish), ISO, month/day with or without a year; else today.

    A year of two digits is of this century. Impossible days count as today.
    """
    word = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    parts = F.split(word, "/")
    year = F.when(F.size(parts) == 3, F.try_element_at(parts, F.lit(3)).try_cast("int")).otherwise(F.year(today))
    year = F.when(year < 100, year + 2000).otherwise(year)
    slashed = F.format_string("%04d-%02d-%02d", year, F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int"))
    return (
        F.when(word.isin("today", "hoy", ""), today)
        .when(word.isin("yesterday", "ayer"), F.date_sub(today, 1))
        .when(iso_day(word).isNotNull(), iso_day(word))
        .when(word.rlike(r"^\d{1,2}/\d{1,2}(/(\d{2}|\d{4}))?$"), F.coalesce(F.try_to_date(slashed, "yyyy-MM-dd"), today))
        .otherwise(today)
    )


def duration_seconds(raw: Column) -> Column:
    """Seconds of H:M:S, M:S or plain seconds; null if any part isn't a number."""
    parts = F.transform(F.split(F.trim(raw), ":"), lambda p: p.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p)
    return F.when(F.size(parts) <= 3, total)


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; fractions cut, negative times as 0:00."""
    s = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def in_season(day: Column, start: tuple[int, int], end: tuple[int, int]) -> Column:
    """Whether a day is within a yearly season, both ends included; a season may wrap over the year's end."""
    at, lo, hi = F.month(day) * 100 + F.dayofmonth(day), start[0] * 100 + start[1], end[0] * 100 + end[1]
    return (at >= lo) & (at <= hi) if lo <= hi else (at >= lo) | (at <= hi)
