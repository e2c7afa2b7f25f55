"""Queries that run through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..streaming import events as S
from .registry import query


def _events(s: SparkSession, d: str) -> DataFrame:
    return S.read_events(s, f"{d}/events.parquet")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(s: SparkSession, d: str) -> DataFrame:
    return S.run_once(S.daily_counts(_events(s, d)), "daily", "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_signal(s: SparkSession, d: str) -> DataFrame:
    return S.run_once(S.first_signals(_events(s, d)), "signals", "append")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stream_usage(s: SparkSession, d: str) -> DataFrame:
    return S.run_once(S.usage(_events(s, d)), "usage", "complete")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, true AS allowed, [t] AS kept FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, len(x.live) < 3, CASE WHEN len(x.live) < 3 THEN list_append(x.live, e.t) ELSE x.live END
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1, LATERAL (SELECT list_filter(r.kept, lambda k: e.t - k < 21600000000) AS live) x) SELECT user_id, event_id, allowed FROM r""")
def stream_rate_limit(s: SparkSession, d: str) -> DataFrame:
    return S.run_once(S.limited(_events(s, d), 3, 6 * 3600), "limit", "append")
