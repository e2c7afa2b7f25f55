"""Queries on upkeep: runs, failures, captions, sessions, costs, ids, and the reviewer's filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as X
from ..operators import ledger as L
from ..operators import upkeep as U
from ..session import table
from . import q_corpus, q_facts
from .registry import SQL, query


@query(f"""WITH o AS ({SQL['exact_dedup_outcomes']}) SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'added') AS added, count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates FROM o""")
def ingest_run(s: SparkSession, d: str) -> DataFrame:
    return U.run_summary(q_corpus.exact_dedup_outcomes(s, d))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'limited' WHEN 1 THEN 'unpaid' WHEN 2 THEN 'limited' WHEN 3 THEN 'other' ELSE 'other' END AS failure FROM events WHERE event_type = 'error'""")
def failures_classed(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    said = F.when(k == 0, "HTTP 429: slow down").when(k == 1, "no Payment Method on file, Rate Limit applies").when(k == 2, "over 3 RPM").when(k == 3, "timed out")
    return table(s, d, "events").filter("event_type = 'error'").select("event_id", U.failure_class(said).alias("failure"))


@query("""SELECT doc_id AS video_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 4 = 0 THEN 'file' WHEN doc_id % 3 = 0 THEN 'cache' ELSE 'page' END AS source FROM documents WHERE kind = 'youtube'""")
def captions_chosen(s: SparkSession, d: str) -> DataFrame:
    """Captions from a file (every second, half of them empty), a cache (every third), the page, and a source nobody asked for."""
    v = table(s, d, "documents").filter("kind = 'youtube'").select(F.col("doc_id").alias("video_id"))
    k = F.col("video_id")
    part = lambda rows, name, held: rows.select("video_id", F.lit(name).alias("source"), held.alias("segments"))
    some, none = F.array(F.lit("hello")), F.array().cast("array<string>")
    found = part(v.filter("video_id % 2 = 0"), "file", F.when(k % 4 == 0, some).otherwise(none)).union(part(v.filter("video_id % 3 = 0"), "cache", some)).union(part(v, "page", some)).union(part(v, "guess", some))
    return U.first_source(found, ("file", "cache", "page")).select("video_id", "source")


@query("""WITH s AS (SELECT user_id AS token, max(ts) AS began FROM events WHERE event_type = 'signup' GROUP BY 1), e AS (SELECT user_id AS token, max(ts) AS over FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT token, token AS account_id, epoch_us(began) + 86400000000 AS expires FROM s LEFT JOIN e USING (token) WHERE over IS NULL OR over < began""")
def sessions_open(s: SparkSession, d: str) -> DataFrame:
    """Sign-ups start a session of a day, errors end it."""
    e = table(s, d, "events").select(F.col("user_id").alias("token"), F.col("user_id").alias("account_id"), F.col("ts").cast("timestamp").alias("at"), "event_type")
    out = U.open_sessions(e.filter("event_type = 'signup'"), e.filter("event_type = 'error'").select("token", "at"), 86_400)
    return out.select("token", "account_id", F.unix_micros("expires_at").alias("expires"))


@query("""SELECT id, round(coalesce(input_tokens, 0) / 1000000::DOUBLE * 3 + coalesce(output_tokens, 0) / 1000000::DOUBLE * 15, 9) AS cost FROM (SELECT DISTINCT * FROM questions_log)""")
def question_costs(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "questions_log").dropDuplicates(["id"])
    return q.select("id", F.round(U.model_cost(F.col("input_tokens"), F.col("output_tokens"), (3.0, 15.0)), 9).alias("cost"))


@query("""WITH b AS (SELECT doc_id, string_agg(CASE WHEN idx % 2 = 0 THEN 'see p-' || idx || ' and p-' || idx + 1 ELSE '- `p-' || idx || '`' END, chr(10)) AS body FROM chunks GROUP BY doc_id),
x AS (SELECT doc_id, regexp_extract_all(body, '(p-\\d+)', 1) AS c, regexp_extract_all(body, '`(p-\\d+)`', 1) AS f FROM b) SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(c, lambda v: NOT list_contains(f, v)))), ',') AS ids FROM x""")
def ids_undefined(s: SparkSession, d: str) -> DataFrame:
    """Notes of a document cite its passages by two; only the odd ones are defined."""
    n = F.col("idx").cast("string")
    line = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("see p-"), n, F.lit(" and p-"), (F.col("idx") + 1).cast("string"))).otherwise(F.concat(F.lit("- `p-"), n, F.lit("`")))
    body = table(s, d, "chunks").groupBy("doc_id").agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    return body.select("doc_id", F.array_join(U.undefined_ids(F.col("body"), r"(p-\d+)", r"`(p-\d+)`"), ",").alias("ids"))


@query("""WITH e AS (SELECT DISTINCT * FROM log_entries), m AS (SELECT id, 'said <b>' || what || '</b>' AS w, vendor FROM e)
SELECT id, trim(left(trim(regexp_replace(coalesce(trim(regexp_replace(w, '<[^<>]{1,80}>', '', 'g')), ''), '[\\s\\x{00}-\\x{1f}\\x{7f}\\x{a0}]+', ' ', 'g')), 120)) AS what, trim(left(trim(regexp_replace(coalesce(trim(regexp_replace(vendor, '<[^<>]{1,80}>', '', 'g')), ''), '[\\s\\x{00}-\\x{1f}\\x{7f}\\x{a0}]+', ' ', 'g')), 60)) AS vendor FROM m WHERE NOT regexp_matches(lower(coalesce(w, '')), '</?(function|tool|invoke|parameter)')""")
def entries_cleaned(s: SparkSession, d: str) -> DataFrame:
    e = L.entries(table(s, d, "log_entries")).withColumn("what", F.concat(F.lit("said <b>"), "what", F.lit("</b>")))
    return L.cleaned(e, most_what=120, most_vendor=60).filter("not coalesce(lower(what), '') rlike '</?(function|tool|invoke|parameter)'").select("id", F.trim("what").alias("what"), F.trim("vendor").alias("vendor"))


@query(f"""WITH g AS ({SQL['proposal_groups']}) SELECT lead_id, support FROM g WHERE NOT known AND wanted AND support >= 2 AND contains(lower(topic), 'e')""")
def groups_picked(s: SparkSession, d: str) -> DataFrame:
    return X.picked(q_facts.proposal_groups(s, d), least_support=2, new_only=True, wanted_only=True, topic="E").select("lead_id", "support")
