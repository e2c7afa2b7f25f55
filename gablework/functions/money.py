"""Amounts of money: decimals at the edge, exact sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def cents(amount: Column) -> Column:
    """A double as an exact amount of two places; not-a-number and infinite are null."""
    return F.when(F.isnan(amount) | (F.abs(amount) == float("inf")), None).otherwise(amount).cast("decimal(38,6)").try_cast(MONEY)


def parse_amount(raw: Column, most: int = 10_000_000) -> Column:
    """An amount as typed: $ and commas dropped, a trailing k for thousands; null if unreadable, negative or over `most`."""
    plain = F.lower(F.regexp_replace(F.trim(raw), r"[$,\s]", ""))
    number = F.regexp_replace(plain, "k$", "")
    value = F.when(number.rlike(r"^\d+(\.\d+)?$|^\.\d+$"), number.try_cast("decimal(28,6)")) * F.when(plain.endswith("k"), 1000).otherwise(1)
    return F.when((value >= 0) & (value <= most), F.round(value, 2).try_cast(MONEY))


def total(amount: Column) -> Column:
    """The exact sum of amounts as a double; 0 where there is none."""
    return F.coalesce(F.sum(cents(amount)), F.lit(0)).cast("double")


def money_range(low: Column, high: Column, unit: Column) -> Column:
    """"$250" or "$250–400" as people write it; units that are measures carry no dollar sign. Trailing zeros are dropped."""
    figure = lambda c: F.regexp_replace(F.regexp_replace(F.format_number(c, 2), r"0+$", ""), r"\.$", "")
    sign = F.when(F.lower(F.coalesce(unit, F.lit(""))).rlike(r"percent|%|days?|months?|years?|hours?|feet|degrees"), "").otherwise("$")
    return F.when(low.eqNullSafe(high), F.concat(sign, figure(low))).otherwise(F.concat(sign, figure(low), F.lit("–"), figure(high)))
