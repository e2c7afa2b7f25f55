"""Titles of recordings: prefixes, guests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_prefix(title: Column) -> Column:
    """A title without a leading episode number or mark."""
    return F.trim(F.regexp_replace(F.trim(title), r"^(?i:(?:ep(?:isode|isodio)?\.?\s*)?#?\s*\d+\s*[:.\-–—|]\s*|ep(?:isode)?\.\s+)", ""))


def guests(title: Column, hosts: Column, most: int = 3) -> Column:
    """Up to so many names of guests in a title: after "with", "feat." or "con", else what stands before a colon, dash or bar.

    A name is two to four capitalised words; hosts are no guests.
    """
    bare = without_prefix(title)
    after = F.regexp_extract(bare, r"(?i)\b(?:with|feat\.?|featuring|ft\.?|con)\s+(?-i:(\p{Lu}.*))$", 1)
    lead = F.regexp_extract(bare, r"^([^:|–—]+?)\s*(?:[:|–—]| - )", 1)
    part = F.when(after != "", after).otherwise(lead)
    names = F.transform(F.split(F.regexp_replace(part, r"\s*(?:[:|–—(].*| - .*)$", ""), r"\s*(?:,|&|\band\b|\by\b)\s*"), lambda n: F.trim(n))
    good = F.filter(names, lambda n: n.rlike(r"^\p{Lu}[\p{L}'’.-]*(?: \p{Lu}[\p{L}'’.-]*){1,3}$") & ~F.array_contains(F.transform(F.coalesce(hosts, F.array().cast("array<string>")), lambda h: F.lower(h)), F.lower(n)))
    return F.slice(F.array_distinct(good), 1, most)


def distinct_stems(terms: Column) -> Column:
    """Terms without those whose rough stem came before."""
    from .text import singular

    return F.filter(terms, lambda t, i: ~F.array_contains(F.transform(F.slice(terms, F.lit(1), i), lambda x: singular(x)), singular(t)))
