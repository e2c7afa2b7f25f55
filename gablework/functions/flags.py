"""Classifiers of questions by configurable phrase lists and by the nearness of words."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def any_phrase(c: Column, phrases: Sequence[str]) -> Column:
    """Whether folded text holds any of the phrases."""
    if not phrases:
        return F.lit(False)
    return T.fold(c).rlike("|".join(re.escape(p) for p in phrases))


def any_word(c: Column, words: Sequence[str]) -> Column:
    """Whether folded text holds any of the words as a whole word; plurals count."""
    if not words:
        return F.lit(False)
    return T.fold(c).rlike(r"\b(?:" + "|".join(re.escape(w) for w in words) + r")(?:s|es)?\b")


def near(c: Column, left: Sequence[str], right: Sequence[str], reach: int = 12) -> Column:
    """Whether a word of each list stands within `reach` words of the other, in either order."""
    a, b = ("(?:" + "|".join(re.escape(w) for w in ws) + r")\w*" for ws in (left, right))
    gap = rf"(?:\W+\w+){{0,{reach - 1}}}\W+"
    return T.fold(c).rlike(rf"\b{a}{gap}{b}|\b{b}{gap}{a}")


def flags(c: Column, rules: Mapping[str, Column], implied: Mapping[str, str] | None = None) -> Column:
    """Sorted names of the rules that hold; a rule may imply another."""
    found = [F.when(rule, F.lit(name)) for name, rule in rules.items()]
    found += [F.when(rules[name], F.lit(other)) for name, other in (implied or {}).items()]
    return F.array_sort(F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull())))


def small_talk(c: Column, greetings: Sequence[str] = ("hi", "hello", "hey", "thanks", "thank you", "hola", "gracias", "bye"), most_words: int = 8) -> Column:
    """Blank, or a short text that begins with a greeting."""
    t = T.fold(F.coalesce(c, F.lit("")))
    return (t == "") | (t.rlike(r"^(?:" + "|".join(greetings) + r")\b") & (T.word_count(c) <= most_words))


def follow_up(c: Column, cues: Sequence[str] = ("and", "but", "what about", "how about", "also", "y", "pero"), most_words: int = 10) -> Column:
    """Whether a question leans on the one before: a cue or pronoun in front, or very short."""
    t = T.fold(F.coalesce(c, F.lit("")))
    return t.rlike(r"^(?:" + "|".join(cues) + r")\b") | t.rlike(r"^(?:it|that|this|they|those|these|he|she|eso|esto)\b") | (T.word_count(c) < most_words)


def effort(c: Column, hard: Sequence[str], most_words: int = 12) -> Column:
    """low for small talk, high for long texts or those with a hard word, else default."""
    return F.when(small_talk(c), "low").when(any_word(c, hard) | (T.word_count(c) > most_words * 5), "high").otherwise("default")


def place_flag(c: Column, *, home: Sequence[str], region: Sequence[str], cities: Sequence[str], states: Sequence[str], before: Sequence[str], nouns: Sequence[str], suffixes: Sequence[str]) -> Column:
    """outside, region or null: where a text is about, by gazetteers.

    A city of the outside settles it. A state counts only in context, after one of the words `before` or before one of the `nouns`, and not where it
    names a street (a suffix follows). A place of the region counts unless a place of home is named as well.
    """
    t = T.fold(F.coalesce(c, F.lit("")))
    any_of = lambda xs: "(?:" + "|".join(re.escape(x) for x in xs) + ")"
    bare = F.regexp_replace(t, rf"\b{any_of(states)}\s+{any_of(suffixes)}\b", " ")
    outside = t.rlike(any_of(cities)) | bare.rlike(rf"\b{any_of(before)}\s+{any_of(states)}\b|\b{any_of(states)}\s+{any_of(nouns)}\b")
    return F.when(outside, "outside").when(t.rlike(any_of(region)) & ~t.rlike(any_of(home)), "region")


def _acted_near(words: Column, terms: Sequence[str], size: int, acts: str, reach: int) -> Column:
    """Whether a term of so many words stands among the words with an act in the window around it."""
    named = "^(?:" + "|".join(" ".join(re.escape(w) + "(?:s|es)?" for w in x.split()) for x in terms) + ")$"
    last = F.size(words) - size + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.array_join(F.slice(words, F.greatest(i - reach, F.lit(1)), F.least(i - 1, F.lit(reach)) + size + reach), " ")
    return F.exists(places, lambda i: F.array_join(F.slice(words, i, size), " ").rlike(named) & window(i).rlike(acts))


def risk(c: Column, *, phrases: Sequence[str], terms: Sequence[str], acts: str, reach: int = 12) -> Column:
    """Whether a text holds one of the phrases, or an act (a pattern: verbs, split verbs, stems) within `reach` words around one of the terms.

    Terms match word by word, plurals count. Each place of a term is looked at with its own window.
    """
    t = T.fold(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(t, F.lit(r"[a-z0-9']+"), F.lit(0))
    hit = t.rlike("|".join(re.escape(p) for p in phrases)) if phrases else F.lit(False)
    for size in sorted({len(x.split()) for x in terms}):
        hit = hit | _acted_near(words, [x for x in terms if len(x.split()) == size], size, acts, reach)
    return hit


def not_covered(question: Column, coverage: Column, answer: Column, phrase: str) -> Column:
    """Whether an answer leaves a gap: no small talk, and thin coverage or an answer that says so."""
    return ~small_talk(question) & (F.coalesce(coverage.isin("none", "weak"), F.lit(False)) | F.contains(T.fold(F.coalesce(answer, F.lit(""))), F.lit(phrase)))
