"""E-mail addresses and telephone numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"(?:\+?1[\s.–-]?)?(?:\(\d{3}\)\s?|\d{3}[\s./–-]?)\d{3}[\s.–-]?\d{4}"


def email(raw: Column) -> Column:
    """An address in lower case, or null if it isn't one."""
    e = F.lower(F.trim(raw))
    return F.when(e.rlike(f"^{EMAIL}$") & ~e.contains("..") & (F.length(e) <= 254), e)


def us_phone(raw: Column) -> Column:
    """Ten digits of a number of the North American plan, or null: area and exchange start at 2, aren't of the form N11,
    and not all digits are the same; a leading 1 goes."""
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\D", "")
    ten = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substr(digits, F.lit(2))).otherwise(digits)
    return F.when(ten.rlike(r"^[2-9]\d{2}[2-9]\d{6}$") & ~ten.rlike(r"^.11|^(\d)\1{9}$|^\d{3}.11"), ten)


def disposable(address: Column, domains: list[str]) -> Column:
    """Whether an address belongs to one of the given throw-away domains."""
    return F.lower(F.substring_index(address, "@", -1)).isin(*domains)
