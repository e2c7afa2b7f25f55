"""Queries on conversations, ratings, questions, outbox and visitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import activity as A
from ..operators import ledger as L
from ..session import table
from .registry import query

_W = r"'(?:(?:hi|hello|hey|hola|please|so|ok|okay|well)[,!.]?\s+)+'"


def title_sql(c: str) -> str:
    bare = f"regexp_replace(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')), '^(?:(?:hi|hello|hey|hola|please|so|ok|okay|well)[,!.]?\\s+)+', '', 'i')"
    short = f"CASE WHEN length({bare}) <= 60 THEN {bare} ELSE regexp_replace(left({bare}, 61), '\\s+\\S*$', '') END"
    return f"upper(left({short}, 1)) || substr({short}, 2)"


def _threads(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "threads")


def _log(s: SparkSession, d: str) -> DataFrame:
    return A.questions_once(table(s, d, "questions_log"))


Q = "q AS (SELECT DISTINCT * FROM questions_log)"
R1 = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, thread_id, turn ORDER BY created_at DESC NULLS LAST, rating, note NULLS LAST) AS n FROM ratings WHERE rating IN ('up', 'down')) WHERE n = 1)"
E = "entries AS (SELECT DISTINCT * FROM log_entries)"


@query(f"""WITH m AS (SELECT id AS thread_id, owner_id, generate_subscripts(messages, 1) AS seq, unnest(messages) AS m FROM threads),
f AS (SELECT thread_id, owner_id, count(*) FILTER (WHERE m.role = 'user') AS turns, count(*) AS n_messages, arg_min(m.content, seq) FILTER (WHERE m.role = 'user') AS q FROM m GROUP BY ALL)
SELECT thread_id, owner_id, CAST(turns AS INTEGER) AS turns, CAST(n_messages AS INTEGER) AS n_messages, {title_sql('q')} AS title FROM f""")
def thread_assembly(s: SparkSession, d: str) -> DataFrame:
    m = _threads(s, d).select(F.col("id").alias("thread_id"), "owner_id", F.posexplode("messages").alias("seq", "m"), F.col("updated_at").alias("at"))
    out = A.assemble_threads(m.select("thread_id", "owner_id", "seq", "m.role", "m.content", "at"))
    return out.select("thread_id", "owner_id", "turns", F.size("messages").alias("n_messages"), "title")


@query("SELECT id, owner_id, CAST(place AS INTEGER) AS place FROM (SELECT id, owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC NULLS LAST, id) AS place FROM threads) WHERE place <= 3")
def thread_prune(s: SparkSession, d: str) -> DataFrame:
    return A.newest_per_owner(_threads(s, d), 3).select("id", "owner_id", "place")


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC NULLS LAST, id) AS place FROM threads)
SELECT owner_id, array_to_string(list(coalesce(title, '') ORDER BY place), '|') AS titles, CAST(sum(turns) AS BIGINT) AS turns FROM t WHERE place <= 3 GROUP BY owner_id""")
def recent_topics(s: SparkSession, d: str) -> DataFrame:
    out = A.recent_topics(_threads(s, d))
    return out.select("owner_id", F.array_join(F.transform("titles", lambda t: F.coalesce(t, F.lit(""))), "|").alias("titles"), "turns")


@query("""WITH x AS (SELECT id, list_transform(list_filter(messages, lambda m: m.role = 'user'), lambda m: m.content) AS a, list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: m.content) AS b FROM threads)
SELECT id, array_to_string(a[greatest(1, len(a) - 7):len(a)], '|') AS questions, b[len(b)] AS last_answer FROM x""")
def handoff_tail(s: SparkSession, d: str) -> DataFrame:
    return A.last_questions(_threads(s, d), 8).select("id", F.array_join("questions", "|").alias("questions"), "last_answer")


@query("""WITH l AS (SELECT owner_id, updated_at, id, array_to_string(list_transform(messages, lambda m: m.role || ': ' || coalesce(m.content, '')), chr(10)) AS t FROM threads),
w AS (SELECT owner_id, array_to_string(list(t ORDER BY updated_at, id), chr(10)) AS t FROM l GROUP BY owner_id) SELECT owner_id, CASE WHEN length(t) > 1200 THEN '…' || right(t, 1200) ELSE t END AS transcript FROM w""")
def transcript_tail(s: SparkSession, d: str) -> DataFrame:
    return A.transcript_tail(_threads(s, d), 1200)


@query(f"WITH {R1} SELECT count(*) FILTER (WHERE rating = 'up') AS up, count(*) FILTER (WHERE rating = 'down') AS down FROM r")
def rating_counts(s: SparkSession, d: str) -> DataFrame:
    return A.rating_counts(A.latest_ratings(table(s, d, "ratings")))


@query(f"WITH {R1} SELECT r.thread_id, r.turn, r.rating, t.owner_id FROM r JOIN threads t ON t.id = r.thread_id WHERE r.rating = 'down'")
def rating_feed(s: SparkSession, d: str) -> DataFrame:
    r = A.latest_ratings(table(s, d, "ratings")).filter("rating = 'down'").select("thread_id", "turn", "rating")
    return r.join(_threads(s, d).select(F.col("id").alias("thread_id"), "owner_id"), "thread_id")


@query(f"WITH {Q} SELECT id, row_number() OVER (ORDER BY CAST(asked_at AS DATE) DESC NULLS LAST, asked_at DESC NULLS LAST, id DESC) AS place FROM q WHERE not_covered")
def question_gaps(s: SparkSession, d: str) -> DataFrame:
    return A.gaps(_log(s, d)).select("id", "place")


@query(f"WITH {Q} SELECT id, not_covered AND NOT coalesce(coverage = 'covered', false) AS not_covered FROM q")
def declined_gaps_settled(s: SparkSession, d: str) -> DataFrame:
    return A.settle_declined(_log(s, d)).select("id", "not_covered")


@query(f"WITH {Q}, {R1} SELECT question, 'gap' AS why FROM q WHERE not_covered AND trim(question) <> '' UNION ALL SELECT question, 'down' FROM r WHERE rating = 'down' AND trim(question) <> ''")
def questions_that_missed(s: SparkSession, d: str) -> DataFrame:
    return A.questions_that_missed(_log(s, d), A.latest_ratings(table(s, d, "ratings")))


@query(f"WITH {Q} SELECT session_id, count(*) AS n, count(*) > 4 AS over FROM q WHERE session_id IS NOT NULL GROUP BY session_id")
def usage_counts(s: SparkSession, d: str) -> DataFrame:
    return A.usage(_log(s, d), 4)


@query("SELECT event_id AS id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS INTEGER) AS nth, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= 300 AS allowed FROM events")
def daily_question_cap(s: SparkSession, d: str) -> DataFrame:
    return A.daily_cap(table(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("asked_at")), 300)


@query("SELECT CAST(user_id AS VARCHAR) AS owner, event_type AS signal, epoch_us(min(ts)) AS at FROM events GROUP BY ALL")
def first_signal(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("owner"), F.col("event_type").alias("signal"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return A.first_signals(e)


def _outbox(s: SparkSession, d: str) -> DataFrame:
    """Events in the part of an outbox: errors wait, purchases are delivered, a user's number makes the attempts."""
    at = F.col("ts").cast("timestamp")
    return table(s, d, "events").filter("event_type in ('error', 'purchase')").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 8).cast("int").alias("attempts"), at.alias("next_try_at"), F.when(F.col("event_type") == "purchase", at).alias("delivered_at"), F.lit("").alias("last_error")
    )


OB = "o AS (SELECT event_id AS id, CAST(user_id % 8 AS INTEGER) AS attempts, ts AS next_try_at, CASE WHEN event_type = 'purchase' THEN ts END AS delivered_at FROM events WHERE event_type IN ('error', 'purchase'))"


@query(f"WITH {OB} SELECT count(*) AS total, count(delivered_at) AS delivered, count(*) FILTER (WHERE delivered_at IS NULL AND attempts >= 6) AS gave_up, count(*) FILTER (WHERE delivered_at IS NULL AND attempts < 6) AS waiting FROM o")
def outbox_counts(s: SparkSession, d: str) -> DataFrame:
    return A.outbox_counts(_outbox(s, d))


@query(f"WITH {OB} SELECT id, attempts FROM o WHERE delivered_at IS NULL AND attempts < 6 AND next_try_at <= TIMESTAMP '2024-01-15' ORDER BY id LIMIT 20")
def outbox_due(s: SparkSession, d: str) -> DataFrame:
    return A.outbox_due(_outbox(s, d), F.to_timestamp(F.lit("2024-01-15"))).select("id", "attempts")


@query(f"""WITH {OB} SELECT id, CASE WHEN h THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN h THEN epoch_us(TIMESTAMP '2024-02-01') // 1000000 + [60, 300, 900, 3600, 21600][least(attempts + 1, 5)] ELSE CAST(floor(epoch_us(next_try_at) / 1000000) AS BIGINT) END AS next_s
FROM (SELECT *, delivered_at IS NULL AS h FROM o)""")
def outbox_backoff(s: SparkSession, d: str) -> DataFrame:
    o = _outbox(s, d)
    out = A.outbox_failed(o, o.filter("delivered_at is null").select("id", F.lit("no answer").alias("error")), F.to_timestamp(F.lit("2024-02-01")))
    return out.select("id", "attempts", F.unix_timestamp("next_try_at").alias("next_s"))


@query("SELECT owner_id, epoch_us(max(updated_at)) AS last_seen FROM threads WHERE owner_id LIKE 'browser:%' GROUP BY owner_id ORDER BY max(updated_at) DESC, owner_id LIMIT 200")
def visitor_last_seen(s: SparkSession, d: str) -> DataFrame:
    return A.visitors_last_seen(_threads(s, d), 200).select("owner_id", F.unix_micros("last_seen").alias("last_seen"))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC NULLS LAST, id) AS place FROM threads),
b AS (SELECT owner_id, array_to_string(list(coalesce(title, '') ORDER BY place) FILTER (WHERE place <= 5), ' | ') AS titles, count(*) AS threads FROM t GROUP BY owner_id)
SELECT 'account:' || a.id AS owner_id, lower(trim(email)) AS email, name, coalesce(titles, '') AS titles, coalesce(threads, 0) AS threads FROM accounts a LEFT JOIN b ON b.owner_id = 'account:' || a.id
UNION ALL SELECT owner_id, NULL, NULL, titles, threads FROM b WHERE owner_id LIKE 'browser:%'""")
def admin_rows(s: SparkSession, d: str) -> DataFrame:
    return A.admin_rows(table(s, d, "accounts"), _threads(s, d))


@query("""WITH u AS (SELECT owner_id, id, coalesce(units, 1) AS u, sum(coalesce(units, 1)) OVER (PARTITION BY owner_id ORDER BY created_at NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS after FROM properties)
SELECT owner_id, id, CAST(after - u AS BIGINT) AS before, CAST(after AS BIGINT) AS after FROM u WHERE after - u < 4 AND after >= 4""")
def unit_crossings(s: SparkSession, d: str) -> DataFrame:
    return A.unit_crossings(table(s, d, "properties"))


@query(f"""WITH {E}, m AS (SELECT owner_id, CAST(coalesce(sum(CASE WHEN kind = 'income' THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS money_in, CAST(coalesce(sum(CASE WHEN kind IN ('expense','bill') THEN CAST(amount AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS money_out FROM entries WHERE happened_on >= '2025-06-01' AND amount IS NOT NULL GROUP BY 1),
o AS (SELECT owner_id, what, row_number() OVER (PARTITION BY owner_id ORDER BY CASE urgency WHEN 'emergency' THEN 0 WHEN 'urgent' THEN 1 ELSE 2 END, happened_on NULLS FIRST, created_at NULLS FIRST, id) AS place FROM entries WHERE kind = 'maintenance' AND status = 'open'),
w AS (SELECT owner_id, array_to_string(list(what ORDER BY place), '; ') AS open_items FROM o WHERE place <= 5 GROUP BY 1), p AS (SELECT owner_id, count(*) AS properties FROM properties GROUP BY 1),
a AS (SELECT 'account:' || id AS owner_id FROM accounts)
SELECT a.owner_id, coalesce(money_in, 0) AS money_in, coalesce(money_out, 0) AS money_out, coalesce(open_items, '') AS open_items, coalesce(properties, 0) AS properties FROM a LEFT JOIN m USING (owner_id) LEFT JOIN w USING (owner_id) LEFT JOIN p USING (owner_id)
WHERE coalesce(money_in, 0) <> 0 OR coalesce(money_out, 0) <> 0 OR coalesce(open_items, '') <> ''""")
def owner_digest(s: SparkSession, d: str) -> DataFrame:
    return A.digest(table(s, d, "accounts"), L.entries(table(s, d, "log_entries")), table(s, d, "properties"), "2025-06-01")


@query(f"""WITH {Q}, b AS (SELECT *, lag(question) OVER (PARTITION BY session_id ORDER BY asked_at, id) AS prev FROM q)
SELECT id, CASE WHEN length(question) < 45 AND prev IS NOT NULL AND session_id IS NOT NULL THEN prev || ' ' || question ELSE question END AS query FROM b""")
def follow_up_queries(s: SparkSession, d: str) -> DataFrame:
    return A.with_follow_up(_log(s, d), F.length("question") < 45).select("id", "query")


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, ts AS "at", event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, "at", id, n, true AS allowed, [t] AS kept FROM e WHERE n = 1
  UNION ALL SELECT e.key, e."at", e.id, e.n, len(x.live) < 3, CASE WHEN len(x.live) < 3 THEN list_append(x.live, e.t) ELSE x.live END
  FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1, LATERAL (SELECT list_filter(r.kept, lambda k: e.t - k < 21600000000) AS live) x) SELECT key, "at", id, allowed FROM r""")
def rate_limited_hits(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"))
    return A.sliding_limit(e, 3, 6 * 3600)


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, ts AS "at", event_id AS id, epoch_us(ts) AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, "at", id, n, false AS blocked, CASE WHEN ok THEN 0 ELSE 1 END AS fails, CASE WHEN ok THEN NULL ELSE t END AS last FROM e WHERE n = 1
  UNION ALL SELECT e.key, e."at", e.id, e.n, x.shut, CASE WHEN x.shut THEN r.fails WHEN e.ok THEN 0 ELSE r.fails + 1 END, CASE WHEN x.shut OR e.ok THEN r.last ELSE e.t END
  FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1, LATERAL (SELECT r.fails >= 3 AND r.last IS NOT NULL AND e.t - r.last < 86400000000 AS shut) x) SELECT key, "at", id, blocked FROM r""")
def lockouts(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"))
    return A.lockouts(e, 3, 24 * 3600)


@query("""WITH s AS (SELECT user_id AS turn, event_type AS key, event_id AS seq, CASE WHEN value > 90 THEN 'emergency' WHEN value > 60 THEN 'urgent' ELSE 'routine' END AS urgency FROM events)
SELECT turn, key, min(seq) AS seq, CASE WHEN bool_or(urgency = 'emergency') THEN 'emergency' WHEN bool_or(urgency = 'urgent') THEN 'urgent' ELSE 'routine' END AS urgency, count(*) AS n FROM s GROUP BY ALL""")
def adds_once(s: SparkSession, d: str) -> DataFrame:
    urgency = F.when(F.col("value") > 90, "emergency").when(F.col("value") > 60, "urgent").otherwise("routine")
    return A.adds_once(table(s, d, "events").select(F.col("user_id").alias("turn"), F.col("event_type").alias("key"), F.col("event_id").alias("seq"), urgency.alias("urgency")))


def _states(s: SparkSession, d: str) -> DataFrame:
    """Owner states made of events: signals by first time, an override from purchases, notes from the last props."""
    e = table(s, d, "events")
    firsts = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    sig = firsts.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]).alias("signals"))
    rest = e.groupBy("user_id").agg(F.max(F.when((F.col("event_type") == "purchase") & (F.col("user_id") % 3 == 0), True)).alias("override"), F.max_by("props", "event_id").alias("notes"), F.max((F.col("user_id") % 7 == 0)).alias("hidden"), F.max("event_id").alias("updated_at"))
    return sig.join(rest, "user_id").select(F.col("user_id").cast("string").alias("owner_id"), "signals", "override", "notes", "hidden", "updated_at")


ST = """f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL), g AS (SELECT user_id, list(event_type ORDER BY first) AS signals FROM f GROUP BY 1),
e AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' AND user_id % 3 = 0 THEN true END) AS override, arg_max(props, event_id) AS notes, user_id % 7 = 0 AS hidden, max(event_id) AS updated_at FROM events GROUP BY user_id),
st AS (SELECT CAST(user_id AS VARCHAR) AS owner_id, signals, override, notes, hidden, updated_at FROM g JOIN e USING (user_id))"""


@query(f"""WITH {ST}, o AS (SELECT * FROM st WHERE owner_id = '2'), n AS (SELECT * FROM st WHERE owner_id = '5')
SELECT owner_id, array_to_string(signals, ',') AS signals, coalesce(override, false) AS override, hidden, updated_at FROM st WHERE owner_id NOT IN ('2', '5')
UNION ALL SELECT '5', array_to_string(list_concat(n.signals, list_filter(o.signals, lambda x: NOT list_contains(n.signals, x))), ','), coalesce(n.override, o.override, false), n.hidden OR o.hidden, greatest(n.updated_at, o.updated_at) FROM o, n""")
def owner_states_merged(s: SparkSession, d: str) -> DataFrame:
    out = A.merge_owner(_states(s, d), "2", "5")
    return out.select("owner_id", F.array_join("signals", ",").alias("signals"), F.coalesce("override", F.lit(False)).alias("override"), "hidden", "updated_at")


@query(f"""WITH {ST}, c AS (SELECT CAST(user_id AS VARCHAR) AS owner_id, arg_max('note ' || event_id, event_id) AS v FROM events WHERE event_type = 'error' GROUP BY 1) SELECT st.owner_id, coalesce(v, notes) AS notes, updated_at FROM st LEFT JOIN c USING (owner_id)""")
def owner_notes_set(s: SparkSession, d: str) -> DataFrame:
    ch = table(s, d, "events").filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("owner_id"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("value"), F.col("event_id").alias("at"))
    return A.set_field(_states(s, d), ch, "notes").select("owner_id", "notes", "updated_at")


@query(f"SELECT id, CASE WHEN regexp_matches(title, '^[=+@-]') THEN '''' || title ELSE title END AS title FROM threads")
def csv_safe_export(s: SparkSession, d: str) -> DataFrame:
    return _threads(s, d).select("id", T.csv_safe(F.col("title")).alias("title"))
