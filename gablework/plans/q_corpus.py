"""Corpus queries: identity, duplicates, upkeep, windows, boilerplate, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as win

from ..functions import text as T
from ..functions import urls as U
from ..operators import corpus as C
from ..session import table
from ..sources import transcripts
from .registry import query


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks")


WORDS = "len(list_filter(regexp_split_to_array(text, '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> ''))"


@query("SELECT doc_id, kind || '-' || left(sha1(kind || ':' || locator), 16) AS id, sha256(text) AS content_hash FROM documents")
def doc_identity_hashes(s: SparkSession, d: str) -> DataFrame:
    return C.identified(_docs(s, d)).select("doc_id", "id", "content_hash")


@query("""WITH d AS (SELECT doc_id, id, sha256(text) AS h, doc_id AS seq FROM documents), st AS (SELECT id, CASE WHEN doc_id % 4 = 0 THEN sha256(text || 'x') ELSE h END AS h FROM d JOIN documents USING (doc_id, id) WHERE doc_id % 2 = 0),
bh AS (SELECT h, min(id) AS lo, max(id) AS hi FROM st GROUP BY h), x AS (SELECT d.*, st.h AS old, bh.lo, bh.hi, first_value(d.id) OVER (PARTITION BY d.h ORDER BY d.seq, d.id) AS f FROM d LEFT JOIN st ON st.id = d.id LEFT JOIN bh ON bh.h = d.h),
t AS (SELECT *, CASE WHEN lo <> id THEN lo WHEN hi <> id THEN hi WHEN f <> id THEN f END AS tw FROM x)
SELECT id, CASE WHEN old IS NOT DISTINCT FROM h THEN 'skipped' WHEN tw IS NOT NULL THEN 'duplicate' WHEN old IS NOT NULL THEN 'updated' ELSE 'added' END AS outcome, CASE WHEN old IS DISTINCT FROM h THEN tw END AS twin FROM t""")
def exact_dedup_outcomes(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d).select("doc_id", "id", T.content_hash(F.col("text")).alias("content_hash"), F.col("doc_id").alias("seq"), "text")
    stored = docs.filter("doc_id % 2 = 0").select("id", F.when(F.col("doc_id") % 4 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    return C.ingest_outcomes(docs.drop("text", "doc_id"), stored).select("id", "outcome", "twin")


@query("""WITH t AS (SELECT id, first_value(id) OVER (PARTITION BY sha256(text) ORDER BY locator, id) AS twin FROM documents) SELECT * FROM t WHERE id <> twin""")
def text_twins(s: SparkSession, d: str) -> DataFrame:
    return C.twins(_docs(s, d).withColumn("content_hash", T.content_hash(F.col("text"))))


@query("SELECT id, CASE WHEN doc_id % 10 = 0 THEN 'updated' ELSE title END AS title FROM documents WHERE kind <> 'podcast' OR doc_id % 10 = 0")
def documents_upserted(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    stored = docs.filter("kind <> 'podcast'").select("id", "title")
    return C.upsert(stored, docs.filter("doc_id % 10 = 0").select("id", F.lit("updated").alias("title")))


@query("SELECT c.id FROM chunks c WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'es')")
def chunks_after_removal(s: SparkSession, d: str) -> DataFrame:
    return C.remove(_chunks(s, d), _docs(s, d).filter("lang = 'es'"), "doc_id").select("id")


@query("SELECT id FROM chunks WHERE embedding IS NULL OR embedding_model IS DISTINCT FROM 'minnow-embed-64'")
def chunks_missing_embeddings(s: SparkSession, d: str) -> DataFrame:
    return C.missing_embeddings(_chunks(s, d), "minnow-embed-64").select("id")


@query("WITH m AS (SELECT * FROM chunks WHERE embedding_model = 'pebble-48' AND len(embedding) > 0) SELECT id, len(embedding)::INTEGER AS dim FROM m WHERE len(embedding) = (SELECT arg_min(len(embedding), (doc_id, idx)) FROM m)")
def embeddings_matrix(s: SparkSession, d: str) -> DataFrame:
    return C.usable_embeddings(_chunks(s, d), "pebble-48").select("id", F.size("embedding").alias("dim"))


@query("SELECT id, CASE WHEN e THEN 'fresh' ELSE embedding_model END AS embedding_model, CASE WHEN e THEN 2 ELSE coalesce(len(embedding), -1) END::INTEGER AS dim FROM (SELECT *, embedding IS NULL AS e FROM chunks)")
def embeddings_set(s: SparkSession, d: str) -> DataFrame:
    ch = _chunks(s, d)
    fresh = ch.filter("embedding is null").select("id", F.array(F.lit(0.5), F.lit(0.5)).cast("array<float>").alias("embedding"))
    return C.set_embeddings(ch, fresh, "fresh").select("id", "embedding_model", F.size("embedding").alias("dim"))


@query("SELECT id FROM documents WHERE kind IN ('website', 'podcast') AND doc_id % 5 <> 1 AND source <> 'porch-talk'")
def orphan_documents(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    return C.orphans(docs.select("id", "kind", "source"), docs.filter("doc_id % 5 = 1 and kind in ('website', 'podcast')").select("id", "kind"), F.col("source") != "porch-talk").select("id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunks)")
def documents_without_chunks(s: SparkSession, d: str) -> DataFrame:
    return C.without_chunks(_docs(s, d), _chunks(s, d)).select("doc_id")


@query("""WITH e AS (SELECT user_id AS doc_id, event_id AS no, epoch_us(ts) / 1000000.0::DOUBLE AS start, event_type AS text FROM events),
a AS (SELECT *, start - min(start) OVER (PARTITION BY doc_id) AS pos FROM e), w AS (SELECT a.*, w.w FROM a, (SELECT unnest(range(0, 60)) AS w) w WHERE pos >= w.w * 64800.0 AND pos < w.w * 64800.0 + 86400.0),
g AS (SELECT doc_id, w, min(no) AS first_no, max(no) AS last_no, array_to_string(list(text ORDER BY no), ' ') AS text FROM w GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, first_no, last_no ORDER BY w) AS n FROM g)
SELECT doc_id, w AS window_no, first_no, last_no, text FROM f WHERE n = 1""")
def av_windows(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("no"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start"), F.col("event_type").alias("text"))
    return C.hopping_windows(e.withColumn("end", F.col("start")), width=86400.0, overlap=21600.0).select("doc_id", "window_no", "first_no", "last_no", "text")


#: Rows (doc_id, no, start, end, text) of the JSON segments of recordings.
SEG = r"""j AS (SELECT doc_id, TRY_CAST(segments_json AS JSON) AS j FROM documents WHERE kind <> 'website'),
a AS (SELECT doc_id, CASE WHEN json_type(j) = 'ARRAY' THEN j WHEN json_type(j, '$.segments') = 'ARRAY' THEN j -> '$.segments' WHEN json_type(j, '$.snippets') = 'ARRAY' THEN j -> '$.snippets' END AS l FROM j),
i AS (SELECT doc_id, l, unnest(range(0, CAST(json_array_length(l) AS BIGINT))) AS k FROM a WHERE l IS NOT NULL),
f AS (SELECT doc_id, k, coalesce(TRY_CAST(json_extract_string(l, '$[' || k || '].start') AS DOUBLE), 0) AS s, TRY_CAST(json_extract_string(l, '$[' || k || '].end') AS DOUBLE) AS e, TRY_CAST(json_extract_string(l, '$[' || k || '].duration') AS DOUBLE) AS dur, trim(coalesce(json_extract_string(l, '$[' || k || '].text'), '')) AS text FROM i),
seg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS no, s AS start, greatest(s, coalesce(e, s + dur, s)) AS "end", text FROM f WHERE text <> '')"""


def _segments(s: SparkSession, d: str) -> DataFrame:
    """Timed segments of recordings, from their JSON lists."""
    rows = _docs(s, d).filter("kind <> 'website'").select("doc_id", F.posexplode(transcripts.json_segments(F.coalesce("segments_json", F.lit("[]")))).alias("no", "x"))
    return rows.select("doc_id", F.col("no").cast("long").alias("no"), "x.start", "x.end", "x.text")


@query(f"""WITH {SEG}, x AS (SELECT *, trim(regexp_replace(regexp_replace(text, '[\\[(]\\s*[A-Za-z,''-]+(?: +[A-Za-z,''-]+){{0,2}}\\s*[\\])]', ' ', 'g'), '\\s+', ' ', 'g')) AS t, start - min(start) OVER (PARTITION BY doc_id) AS pos FROM seg),
w AS (SELECT x.*, unnest(range(greatest(0, CAST(floor((pos - 120) / 105.0::DOUBLE) AS BIGINT) + 1), CAST(floor(pos / 105.0::DOUBLE) AS BIGINT) + 1)) AS window_no FROM x),
g AS (SELECT doc_id, window_no, min(start) AS start, greatest(max("end"), min(start)) AS "end", coalesce(array_to_string(list(t ORDER BY no) FILTER (WHERE t <> ''), ' '), '') AS text, min(no) AS first_no, max(no) AS last_no FROM w WHERE pos >= window_no * 105.0 AND pos < window_no * 105.0 + 120 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, first_no, last_no ORDER BY window_no) AS nth FROM g) SELECT doc_id, window_no, start, "end", text, first_no, last_no FROM n WHERE nth = 1 AND text <> ''""")
def recording_windows(s: SparkSession, d: str) -> DataFrame:
    return C.hopping_windows(_segments(s, d), width=120.0)


@query(f"""WITH RECURSIVE {SEG}, r AS (
  SELECT doc_id, no, start, "end", text, 0 AS group_no FROM seg WHERE no = 0
  UNION ALL SELECT s.doc_id, s.no, CASE WHEN x.apart THEN s.start ELSE r.start END, CASE WHEN x.apart THEN s."end" ELSE greatest(r."end", s."end") END, CASE WHEN x.apart THEN s.text ELSE r.text || ' ' || s.text END, CASE WHEN x.apart THEN r.group_no + 1 ELSE r.group_no END
  FROM r JOIN seg s ON s.doc_id = r.doc_id AND s.no = r.no + 1, LATERAL (SELECT s."end" - r.start >= 30 OR (s.start = 0 AND s."end" = 0) AS apart) x
) SELECT doc_id, group_no, arg_max(start, no) AS start, arg_max("end", no) AS "end", arg_max(text, no) AS text FROM r GROUP BY doc_id, group_no""")
def merge_segments(s: SparkSession, d: str) -> DataFrame:
    return C.merged_segments(_segments(s, d), 30.0)


@query()
def text_chunks(s: SparkSession, d: str) -> DataFrame:
    return C.passages(_docs(s, d))


@query("""WITH RECURSIVE c AS (SELECT embedding_model AS "group", row_number() OVER (PARTITION BY embedding_model ORDER BY doc_id, idx) AS no, CAST(floor(length(text) / 4) AS INTEGER) AS tokens FROM chunks),
r AS (SELECT "group", no, tokens, 0 AS batch, 1 AS n, tokens AS total FROM c WHERE no = 1
  UNION ALL SELECT c."group", c.no, c.tokens, CASE WHEN r.n + 1 > 128 OR r.total + c.tokens > 10000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n + 1 > 128 OR r.total + c.tokens > 10000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n + 1 > 128 OR r.total + c.tokens > 10000 THEN c.tokens ELSE r.total + c.tokens END
  FROM r JOIN c ON c."group" IS NOT DISTINCT FROM r."group" AND c.no = r.no + 1) SELECT "group", no, tokens, batch FROM r""")
def embed_batches(s: SparkSession, d: str) -> DataFrame:
    c = _chunks(s, d).select(F.col("embedding_model").alias("group"), F.row_number().over(win.Window.partitionBy("embedding_model").orderBy("doc_id", "idx")).alias("no"), T.approx_tokens(F.col("text")).alias("tokens"))
    return C.next_batches(c, most_items=128, most_tokens=10_000)


_TRIM = "regexp_replace(x, '^[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+|[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '', 'g')"
_SHARED = f"""l AS (SELECT source, doc_id, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: {_TRIM}))) AS line FROM documents),
n AS (SELECT source, line, count(*) AS n_docs FROM l WHERE line <> '' GROUP BY ALL HAVING count(*) >= 3), z AS (SELECT source, count(*) AS n_source FROM documents GROUP BY 1)"""


@query(f"WITH {_SHARED} SELECT source, line, n_docs FROM n JOIN z USING (source) WHERE n_docs >= floor(n_source * 0.4) AND n_source >= 3")
def line_boilerplate(s: SparkSession, d: str) -> DataFrame:
    return C.shared_lines(_docs(s, d)).select("source", "line", "n_docs")


@query(f"""WITH {_SHARED}, sh AS (SELECT source, line FROM n JOIN z USING (source) WHERE n_docs >= floor(n_source * 0.4) AND n_source >= 3),
a AS (SELECT doc_id, source, generate_subscripts(p, 1) AS no, unnest(p) AS x FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents)),
k AS (SELECT doc_id, array_to_string(list(x ORDER BY no) FILTER (WHERE sh.line IS NULL), chr(10)) AS text FROM a LEFT JOIN sh ON sh.source = a.source AND sh.line = {_TRIM} GROUP BY doc_id)
SELECT doc_id, CAST({WORDS} AS INTEGER) AS words, {WORDS} < 40 AS hollow FROM (SELECT doc_id, coalesce(text, '') AS text FROM k)""")
def boilerplate_stripped(s: SparkSession, d: str) -> DataFrame:
    return C.strip_shared_lines(_docs(s, d)).select("doc_id", "words", "hollow")


@query(f"SELECT doc_id, CAST({WORDS} AS INTEGER) AS words FROM documents WHERE {WORDS} < 40")
def thin_documents(s: SparkSession, d: str) -> DataFrame:
    return C.thin_documents(_docs(s, d))


@query("""SELECT trim(string_split(reason, ':')[1]) AS reason, count(*) AS n FROM (SELECT CASE WHEN lang IS NULL THEN 'no language: ' || id WHEN lang = 'und' THEN ' language unknown : ' || id ELSE 'bad date: ' || coalesce(published_at, '') END AS reason
FROM documents WHERE lang IS NULL OR lang = 'und' OR published_at IS NULL OR NOT regexp_full_match(published_at, '\\d{4}-\\d{2}-\\d{2}')) GROUP BY 1""")
def failure_summary(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d).filter("lang is null or lang = 'und' or published_at is null or not published_at rlike '^\\\\d{4}-\\\\d{2}-\\\\d{2}$'")
    reason = F.when(F.col("lang").isNull(), F.concat(F.lit("no language: "), "id")).when(F.col("lang") == "und", F.concat(F.lit(" language unknown : "), "id")).otherwise(F.concat(F.lit("bad date: "), F.coalesce("published_at", F.lit(""))))
    return C.failure_summary(docs.select(reason.alias("reason")))


@query("""WITH q AS (SELECT DISTINCT * FROM questions_log), m AS (SELECT embedding_model, count(*) AS n FROM chunks WHERE embedding_model IS NOT NULL GROUP BY 1)
SELECT (SELECT count(*) FILTER (WHERE kind = 'website') FROM documents) AS website_documents, (SELECT count(*) FILTER (WHERE kind = 'youtube') FROM documents) AS youtube_documents, (SELECT count(*) FILTER (WHERE kind = 'podcast') FROM documents) AS podcast_documents,
(SELECT count(*) FROM chunks) AS chunks, (SELECT count(embedding) FROM chunks) AS embedded, (SELECT embedding_model FROM m ORDER BY n DESC, embedding_model DESC LIMIT 1) AS model, (SELECT count(*) FROM q) AS questions, (SELECT count(*) FROM q WHERE not_covered) AS gaps, (SELECT CAST(coalesce(sum(input_tokens + output_tokens), 0) AS BIGINT) FROM q) AS tokens""")
def kb_stats(s: SparkSession, d: str) -> DataFrame:
    return C.store_stats(_docs(s, d), _chunks(s, d), table(s, d, "questions_log").dropDuplicates(["id"]))


@query(f"""WITH {_SHARED}, h AS (SELECT sha256(text), count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)
SELECT 'documents' AS "check", count(*) AS value FROM documents UNION ALL SELECT 'thin documents', count(*) FROM documents WHERE {WORDS} < 40 UNION ALL SELECT 'texts stored more than once', count(*) FROM h UNION ALL SELECT 'most copies of a text', coalesce(max(n), 0) FROM h
UNION ALL SELECT 'documents without passages', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunks) UNION ALL SELECT 'passages without a vector', count(*) FROM chunks WHERE embedding IS NULL
UNION ALL SELECT 'long lines shared within a source', count(*) FROM n JOIN z USING (source) WHERE n_docs >= floor(n_source * 0.25) AND n_source >= 3 AND length(line) > 60 UNION ALL SELECT 'passages without a document', count(*) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def corpus_audit(s: SparkSession, d: str) -> DataFrame:
    return C.audit(_docs(s, d), _chunks(s, d))


@query(r"""WITH u AS (SELECT doc_id, trim(locator) AS u FROM documents), p AS (SELECT doc_id, u, lower(regexp_extract(u, '^([A-Za-z][\w+.-]*)://', 1)) AS scheme, lower(regexp_extract(u, '^[A-Za-z][\w+.-]*://([^/?#]*)', 1)) AS host,
regexp_replace(regexp_extract(u, '^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, list_sort(list_filter(string_split(regexp_extract(u, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND lower(string_split(p, '=')[1]) NOT IN ('fbclid','gclid','mc_cid','mc_eid','igshid','ref','ref_src','_ga'))) AS q FROM u)
SELECT doc_id, CASE WHEN scheme <> '' THEN scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS url, regexp_replace(host, '^www\.', '') AS host FROM p""")
def canonical_urls(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", U.canonical(F.col("locator")).alias("url"), U.host_key(F.col("locator")).alias("host"))


@query("SELECT kind, id, doc_id FROM documents WHERE kind <> 'website'")
def list_documents(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).filter("kind <> 'website'").select("kind", "id", "doc_id")


@query("SELECT source, kind, count(*) AS n, count(DISTINCT channel) AS channels FROM documents GROUP BY ALL")
def source_counts(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).groupBy("source", "kind").agg(F.count("*").alias("n"), F.countDistinct("channel").alias("channels"))
