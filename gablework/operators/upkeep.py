"""Upkeep: runs of ingestion and their failures, sources of captions, sessions, costs, cited ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What refusals for a limit of requests say, and those of accounts that do not pay.
LIMIT_MARKS = ("rate limit", "429", "too many requests", " rpm", " tpm", "quota")
UNPAID_MARKS = ("payment method", "reduced rate limit")


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One row of what a run of ingestion did: total, added, updated, skipped, duplicates; outcomes: (id, outcome). Zeros if nothing came."""
    n = lambda name: F.coalesce(F.sum((F.col("outcome") == name).cast("long")), F.lit(0)).alias(name if name != "duplicate" else "duplicates")
    return outcomes.agg(F.count("*").alias("total"), n("added"), n("updated"), n("skipped"), n("duplicate"))


def failure_class(reason: Column) -> Column:
    """unpaid, limited or other, by what a failure says; an account that doesn't pay is told as such though it is limited too."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    has = lambda marks: F.greatest(*(F.contains(low, F.lit(m)) for m in marks))
    return F.when(has(UNPAID_MARKS), "unpaid").when(has(LIMIT_MARKS), "limited").otherwise("other")


def first_source(found: DataFrame, precedence: Sequence[str]) -> DataFrame:
    """(video_id, source, segments) of the first source that has a video's captions: found has a row a video and source (video_id, source, segments).

    Empty captions and sources that aren't listed count as missing.
    """
    place = F.array_position(F.array(*(F.lit(p) for p in precedence)), F.col("source"))
    usable = found.filter((place > 0) & (F.size("segments") > 0))
    best = usable.groupBy("video_id").agg(F.min_by(F.struct("source", "segments"), place).alias("b"))
    return best.select("video_id", "b.source", "b.segments")


def open_sessions(started: DataFrame, ended: DataFrame, seconds: int) -> DataFrame:
    """(token, account_id, expires_at) of sessions that were started and not ended; of one token started twice the last start counts.

    started: (token, account_id, at); ended: (token, at). An end before the last start ends nothing.
    """
    last = started.groupBy("token").agg(F.max(F.struct("at", "account_id")).alias("s"))
    over = ended.groupBy("token").agg(F.max("at").alias("over"))
    out = last.join(over, "token", "left").filter(F.col("over").isNull() | (F.col("over") < F.col("s.at")))
    return out.select("token", F.col("s.account_id").alias("account_id"), F.timestamp_micros(F.unix_micros("s.at") + seconds * 1_000_000).alias("expires_at"))


def model_cost(input_tokens: Column, output_tokens: Column, per_million: tuple[float, float]) -> Column:
    """What tokens cost at prices for a million in and out; missing counts are none."""
    return F.coalesce(input_tokens, F.lit(0)) / 1_000_000 * per_million[0] + F.coalesce(output_tokens, F.lit(0)) / 1_000_000 * per_million[1]


def undefined_ids(body: Column, cited: str, defined: str) -> Column:
    """Sorted ids that a text cites (a pattern with one group) and nowhere defines (another one)."""
    ids = lambda p: F.array_distinct(F.regexp_extract_all(body, F.lit(p), F.lit(1)))
    return F.array_sort(F.array_except(ids(cited), ids(defined)))
