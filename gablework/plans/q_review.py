"""Queries on places and risks in questions, labels of proposals, notes, answers, and typed input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contact, dates, deals, flags, money, titles
from ..functions import text as T
from ..operators import activity as A
from ..operators import facts as X
from ..operators import ledger as L
from ..operators import retrieval as R
from ..session import table
from ..sources import transcripts
from . import q_facts, q_retrieval
from .q_facts import CAND, KEPT, PLACES, SENT, TOK, terms
from .registry import query

HOME, REGION, CITIES, STATES = ("tannery", "beacon row"), ("larkfield", "oakparque", "dunmere"), ("fort carrow", "san telmo"), ("garland triangle", "humboldt fields", "jubilee park", "velvet mile")
BEFORE, NOUNS, SUFFIXES = ("in", "from", "to", "near", "en", "de"), ("listing", "office", "file", "market"), ("ave", "st", "street", "blvd")
TERMS, PHRASES = ("tenant", "applicant", "night porter", "inquilin"), ("changed the locks", "shut off the")
ACTS = r"\b(?:refuse|reject|ask|sign)\b|\b(?:keep|screen|turn)\s+(?:\w+\s+){0,5}?(?:out|away)\b|\b(?:contest|paga|rechaz)\w*"
RENT, PENDING, SECTION = r"(?i)\b(?:rent|rents|rental|asking)\b", r"(?i)\b(?:would|proposed|draft|not yet|still|considering)\b", r"(?i)\b(?:section|chapter|ordinance)\s+\d|\b\d{1,3}-\d{1,2}-\d{2,4}\b"
STRONG, WEAK, KEY_PHRASES = ("tenant", "tenants", "boiler", "lease"), ("owner", "repair", "heat", "roof", "water", "property"), ("coach house", "gas meter", "rent roll")
NOTICE = r"(?i)\b(?:slow work|put it in writing|call us)\b"

FOLD = "trim(regexp_replace(lower(translate(coalesce({c}, ''), '‘’“”áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÉÈÊËÍÓÖÚÜÑÇ', '''''\"\"aaaaaaeeeeiiiiooooouuuuncaaaaeeeeioouunc')), '[\\s\\x{{85}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g'))"
_any = "|".join
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
Q = "q AS (SELECT DISTINCT * FROM questions_log)"


def _questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "questions_log").dropDuplicates(["id"])


@query(f"""WITH {Q}, f AS (SELECT id, {FOLD.format(c='question')} AS t FROM q), b AS (SELECT *, regexp_replace(t, '\\b(?:{_any(STATES)})\\s+(?:{_any(SUFFIXES)})\\b', ' ', 'g') AS b FROM f)
SELECT id, CASE WHEN regexp_matches(t, '{_any(CITIES)}') OR regexp_matches(b, '\\b(?:{_any(BEFORE)})\\s+(?:{_any(STATES)})\\b|\\b(?:{_any(STATES)})\\s+(?:{_any(NOUNS)})\\b') THEN 'outside' WHEN regexp_matches(t, '{_any(REGION)}') AND NOT regexp_matches(t, '{_any(HOME)}') THEN 'region' END AS place FROM b""")
def question_places(s: SparkSession, d: str) -> DataFrame:
    place = flags.place_flag(F.col("question"), home=HOME, region=REGION, cities=CITIES, states=STATES, before=BEFORE, nouns=NOUNS, suffixes=SUFFIXES)
    return _questions(s, d).select("id", place.alias("place"))


def _risk_sql(size: int) -> str:
    named = "^(?:" + "|".join(" ".join(w + "(?:s|es)?" for w in x.split()) for x in TERMS if len(x.split()) == size) + ")$"
    return f"len(list_filter(range(1, len(w) - {size} + 2), lambda i: regexp_matches(array_to_string(w[i:i + {size} - 1], ' '), '{named}') AND regexp_matches(array_to_string(w[greatest(i - 12, 1):i + {size} + 11], ' '), '{ACTS}'))) > 0"


@query(f"""WITH {Q}, f AS (SELECT id, {FOLD.format(c='question')} AS t FROM q), w AS (SELECT *, regexp_extract_all(t, '[a-z0-9'']+') AS w FROM f)
SELECT id, regexp_matches(t, '{_any(PHRASES)}') OR {_risk_sql(1)} OR {_risk_sql(2)} AS risky FROM w""")
def question_risk(s: SparkSession, d: str) -> DataFrame:
    return _questions(s, d).select("id", flags.risk(F.col("question"), phrases=PHRASES, terms=TERMS, acts=ACTS).alias("risky"))


def _raws(s: SparkSession, d: str) -> DataFrame:
    """Proposals with a unit, a citation and an address, made of the passage's number."""
    p = X.proposals(q_facts._passages(s, d), PLACES, binding=q_facts.BIND)
    even = F.col("sentence_no") % 2 == 0
    return p.select(
        "chunk_id", "sentence_no", "kind", "rule", F.col("rule").alias("topic"), F.when(even, "asking").otherwise("each").alias("unit"), F.col("rule").alias("quote"), F.when(even, "section 5").otherwise("x").alias("citation"), F.lit("x").alias("source"), "low", "high"
    )


@query(f"""WITH {CAND}, {SENT}, {KEPT}, {TOK}, r AS (SELECT chunk_id, CAST(sentence_no AS INTEGER) AS sentence_no, sentence, a IS NOT NULL AS cost, coalesce(a, 0) <> 0 OR coalesce(b, 0) <> 0 AS priced, CASE WHEN sentence_no % 2 = 0 THEN 'asking' ELSE 'each' END AS unit FROM y)
SELECT chunk_id, sentence_no, NOT cost OR priced AS has_price, cost AND regexp_matches(sentence || ' ' || unit, '{RENT}') AS is_rent, regexp_matches(sentence, '{PENDING}') AS is_pending, sentence_no % 2 = 0 OR regexp_matches(sentence, '{SECTION}') AS cites FROM r""")
def proposal_labels(s: SparkSession, d: str) -> DataFrame:
    return X.labelled(_raws(s, d), rent=RENT, pending=PENDING, section=SECTION).select("chunk_id", "sentence_no", "has_price", "is_rent", "is_pending", "cites")


@query(f"""WITH t AS (SELECT id, lower(regexp_extract(coalesce(text, ''), '(?i)\\b({_any(KEY_PHRASES)})\\b', 1)) AS p, list_sort(list_filter({terms('text')}, lambda x: list_contains({_list(STRONG)}, x))) AS s, list_sort(list_filter({terms('text')}, lambda x: list_contains({_list(WEAK)}, x))) AS w FROM chunks)
SELECT id, p <> '' OR len(s) > 0 OR len(w) > 1 AS on_topic, CASE WHEN p <> '' THEN 'the phrase "' || p || '"' WHEN len(s) > 0 THEN 'the word ' || array_to_string(s, ', ') WHEN len(w) > 1 THEN 'the words ' || array_to_string(w, ', ') WHEN len(w) = 1 THEN 'only ' || w[1] || ', which needs a second word' ELSE 'nothing on the topic' END AS why FROM t""")
def passage_topicality(s: SparkSession, d: str) -> DataFrame:
    on = X.topicality(F.coalesce("text", F.lit("")), phrases=KEY_PHRASES, strong=STRONG, weak=WEAK)
    return table(s, d, "chunks").select("id", on.alias("x")).select("id", "x.*")


@query("""WITH d AS (SELECT title, arg_max(published_at, doc_id) AS dated FROM documents WHERE nullif(trim(published_at), '') IS NOT NULL GROUP BY title) SELECT c.id, d.dated FROM chunks c JOIN documents x USING (doc_id) LEFT JOIN d ON d.title = x.title""")
def proposals_dated(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    made = table(s, d, "chunks").select("id", "doc_id").join(docs.select("doc_id", "title"), "doc_id").select("id", "title")
    return X.dated_by_title(made, docs).select("id", "dated")


@query(f"""WITH {CAND}, {SENT}, {KEPT}, e AS (SELECT chunk_id, CAST(sentence_no AS INTEGER) AS sentence_no, text, CASE WHEN sentence_no % 3 = 1 THEN 'so ' || sentence ELSE sentence END AS quote FROM s)
SELECT chunk_id, sentence_no, CASE WHEN sentence_no % 3 = 2 THEN 'no passage' WHEN length(quote) > 15 AND contains(trim(regexp_replace(lower(text), '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')), trim(regexp_replace(lower(quote), '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))) THEN 'kept' ELSE 'not its words' END AS outcome FROM e""")
def quotes_dispatched(s: SparkSession, d: str) -> DataFrame:
    """Sentences as a model's entries: every third with words of its own, every third of a passage that isn't there."""
    p = q_facts._passages(s, d)
    n = F.col("sentence_no") % 3
    made = X.rule_sentences(p, binding=q_facts.BIND).select(
        "chunk_id", "sentence_no", F.when(n == 2, F.concat("chunk_id", F.lit("?"))).otherwise(F.col("chunk_id")).alias("passage"), F.when(n == 1, F.concat(F.lit("so "), "sentence")).otherwise(F.col("sentence")).alias("quote")
    )
    return X.dispatched(made, p.select(F.col("chunk_id").alias("passage"), "text")).select("chunk_id", "sentence_no", "outcome")


@query(f"""WITH {q_retrieval._CORPUS}, {q_retrieval._EPISODES}, r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM kept),
k AS (SELECT r.query_id, r.chunk_id, x.title, trim(regexp_replace(c.text, '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY r.query_id ORDER BY rank, r.chunk_id) AS place FROM r JOIN chunks c ON c.id = r.chunk_id JOIN documents x USING (doc_id) WHERE rank <= 32 AND x.kind = 'website')
SELECT query_id, chunk_id, CAST(place AS INTEGER) AS place, CASE WHEN length(t) > 200 THEN rtrim(left(t, 200)) || '…' ELSE t END AS quote, '— ' || coalesce(title, 'untitled') AS said_in FROM k WHERE place <= 3""")
def topic_quotes(s: SparkSession, d: str) -> DataFrame:
    chunks = q_retrieval._chunks(s, d)
    found = R.retrieve(chunks, q_retrieval._questions(s, d), q_retrieval._vectors(s, d), k=32).select("query_id", "chunk_id", "rank")
    texts = table(s, d, "chunks").select(F.col("id").alias("chunk_id"), "text")
    return R.quotes_of(found.join(chunks.select("chunk_id", "doc_id", "kind"), "chunk_id"), texts, table(s, d, "documents").select("doc_id", "title"), kind="website", k=3, chars=200)


@query("""WITH e AS (SELECT DISTINCT * FROM log_entries), n AS (SELECT id, trim(regexp_replace(CASE length(what) % 3 WHEN 0 THEN coalesce(vendor, '') || '. From: ' || what WHEN 1 THEN 'From: ' || what ELSE what END, '\\s+', ' ', 'g')) AS n FROM e WHERE what IS NOT NULL)
SELECT id, CASE WHEN regexp_matches(n, '^(?:.*?[.;:!?]\\s)?From:\\s') THEN trim(regexp_extract(n, '^(?:(.*?[.;:!?])\\s)?From:\\s(.*)$', 2)) ELSE '' END AS quote, CASE WHEN regexp_matches(n, '^(?:.*?[.;:!?]\\s)?From:\\s') THEN trim(regexp_extract(n, '^(?:(.*?[.;:!?])\\s)?From:\\s(.*)$', 1)) ELSE n END AS comment FROM n""")
def notes_split(s: SparkSession, d: str) -> DataFrame:
    k = F.length("what") % 3
    note = F.when(k == 0, F.concat(F.coalesce("vendor", F.lit("")), F.lit(". From: "), "what")).when(k == 1, F.concat(F.lit("From: "), "what")).otherwise(F.col("what"))
    return L.entries(table(s, d, "log_entries")).filter("what is not null").select("id", T.split_note(note).alias("x")).select("id", "x.*")


@query(f"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\\s*[—–]\\s*', ' - ', 'g'), '[ \\t]{{2,}}', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL), a AS (SELECT doc_id, t, string_split(rtrim(t), chr(10) || chr(10)) AS p FROM p),
k AS (SELECT *, list_filter(string_split(regexp_replace(p[-1], '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda x: NOT regexp_matches(x, '{NOTICE}')) AS k FROM a)
SELECT doc_id, CASE WHEN NOT regexp_matches(p[-1], '{NOTICE}') THEN t WHEN len(k) > 0 THEN array_to_string(list_append(p[1:len(p) - 1], trim(array_to_string(k, ' '))), chr(10) || chr(10)) WHEN len(p) > 1 THEN array_to_string(p[1:len(p) - 1], chr(10) || chr(10)) ELSE t END AS text FROM k""")
def answers_plain(s: SparkSession, d: str) -> DataFrame:
    """Texts play the answers: plain punctuation, and no standing notice at the end."""
    plain = T.plain_punctuation(F.col("text"))
    return table(s, d, "documents").filter("text is not null").select("doc_id", plain.alias("t")).select("doc_id", T.without_notice(F.col("t"), NOTICE).alias("text"))


@query(f"""WITH {Q}, f AS (SELECT *, {FOLD.format(c='question')} AS t FROM q), s AS (SELECT *, t = '' OR (regexp_matches(t, '^(?:hi|hello|hey|thanks|thank you|hola|gracias|bye)\\b') AND len(list_filter(string_split(t, ' '), lambda x: x <> '')) <= 8) AS talk FROM f)
SELECT id, NOT talk AND (coalesce(coverage IN ('none', 'weak'), false) OR contains({FOLD.format(c='flags_json')}, 'legal')) AS gap FROM s""")
def gaps_by_rule(s: SparkSession, d: str) -> DataFrame:
    return _questions(s, d).select("id", flags.not_covered(F.col("question"), F.col("coverage"), F.col("flags_json"), "legal").alias("gap"))


@query("""WITH r AS (SELECT id, CASE WHEN units % 5 = 4 THEN ' ' ELSE trim(regexp_replace(coalesce(label, ''), '[\\s\\x{00}-\\x{1f}\\x{7f}\\x{a0}]+', ' ', 'g')) END AS label, CASE WHEN units IS NULL THEN '' WHEN units % 7 = 3 THEN 'two' WHEN units % 7 = 5 THEN CAST(units * 1000 AS VARCHAR) WHEN units % 7 = 6 THEN '0' ELSE units || '.5' END AS u FROM properties),
n AS (SELECT id, trim(left(label, 120)) AS label, u, TRY_CAST(u AS DOUBLE) AS n FROM r), b AS (SELECT *, CASE WHEN label = '' THEN 'label' WHEN u NOT IN ('', '0') AND n IS NULL THEN 'units is no number' WHEN u NOT IN ('', '0') AND (floor(n) < 1 OR floor(n) > 5000) THEN 'units out of range' END AS problem FROM n)
SELECT id, label, CASE WHEN problem IS NULL AND u NOT IN ('', '0') THEN CAST(floor(n) AS INTEGER) END AS units, problem FROM b""")
def properties_validated(s: SparkSession, d: str) -> DataFrame:
    u = F.col("units")
    typed = F.when(u.isNull(), "").when(u % 7 == 3, "two").when(u % 7 == 5, (u * 1000).cast("string")).when(u % 7 == 6, "0").otherwise(F.concat(u.cast("string"), F.lit(".5")))
    raw = table(s, d, "properties").select("id", F.when(u % 5 == 4, " ").otherwise(F.col("label")).alias("label"), typed.alias("units"))
    return L.validate_properties(raw)


@query("""WITH i AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) - 50000 AS p, (o_orderkey % 13) / 10.0 AS r, o_orderkey % 60 AS y, CASE WHEN o_orderkey % 11 = 0 THEN -1.0 ELSE 1.0 END AS c FROM orders)
SELECT o_orderkey, CASE WHEN p <= 0 THEN 'price must be greater than zero' WHEN NOT (y BETWEEN 1 AND 50) THEN 'years must be between 1 and 50' WHEN NOT (r BETWEEN 0 AND 1) THEN 'rate must be between 0 and 1' WHEN c < 0 THEN 'costs cannot be negative' END AS problem FROM i""")
def deals_checked(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    wrong = deals.problem(price=F.col("o_totalprice").cast("double") - 50000, rate=(k % 13) / 10, years=k % 60, amounts={"costs": F.when(k % 11 == 0, -1.0).otherwise(1.0)})
    return table(s, d, "orders").select("o_orderkey", wrong.alias("problem"))


@query(r"""SELECT id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '\[[^\]]*\]|\([^)]*\)|[♪♫]', ' ', 'g'), '\s+', ' ', 'g')) AS caption,
trim(left(trim(regexp_replace(coalesce(text, ''), '[\s\x{00}-\x{1f}\x{7f}\x{a0}]+', ' ', 'g')), 80)) AS line, regexp_replace(id, '[^A-Za-z0-9_-]', '', 'g') AS segment FROM chunks""")
def chunk_captions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("id", T.caption(F.col("text")).alias("caption"), F.trim(T.flat(F.col("text"), 80)).alias("line"), T.safe_segment(F.col("id")).alias("segment"))


@query("""WITH c AS (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS lo, CASE WHEN p_size % 3 = 0 THEN CAST(p_retailprice AS DOUBLE) ELSE CAST(p_retailprice AS DOUBLE) + p_size END AS hi, CASE WHEN p_size % 5 = 0 THEN 'hours' ELSE 'each' END AS unit FROM part),
f AS (SELECT *, regexp_replace(regexp_replace(printf('%,.2f', lo), '0+$', ''), '\\.$', '') AS a, regexp_replace(regexp_replace(printf('%,.2f', hi), '0+$', ''), '\\.$', '') AS b, CASE WHEN unit = 'hours' THEN '' ELSE '$' END AS s FROM c)
SELECT p_partkey, CASE WHEN lo = hi THEN s || a ELSE s || a || '–' || b END AS cost FROM f""")
def cost_ranges(s: SparkSession, d: str) -> DataFrame:
    lo = F.col("p_retailprice").cast("double")
    hi = F.when(F.col("p_size") % 3 == 0, lo).otherwise(lo + F.col("p_size"))
    return table(s, d, "part").select("p_partkey", money.money_range(lo, hi, F.when(F.col("p_size") % 5 == 0, "hours").otherwise("each")).alias("cost"))


@query("""WITH a AS (SELECT id, 'first [S' || idx || '] then [S3], [S' || idx || '] and [S0] or [S12345].' AS t FROM chunks), m AS (SELECT id, t, list_filter(list_transform(regexp_extract_all(t, '\\[S(\\d{1,4})\\]', 1), lambda x: CAST(x AS INTEGER)), lambda x: x >= 1 AND x <= 9) AS m FROM a)
SELECT id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ',') AS markers, trim(regexp_replace(t, '[ \\t]*\\[S\\d{1,4}\\]', '', 'g')) AS bare FROM m""")
def answer_markers(s: SparkSession, d: str) -> DataFrame:
    n = F.col("idx").cast("string")
    t = F.concat(F.lit("first [S"), n, F.lit("] then [S3], [S"), n, F.lit("] and [S0] or [S12345]."))
    return table(s, d, "chunks").select("id", F.array_join(T.markers(t, F.lit(9)).cast("array<string>"), ",").alias("markers"), T.without_markers(t).alias("bare"))


_FIG = "list_transform(list_transform(regexp_extract_all(coalesce({c}, ''), '\\$\\s?\\d[\\d,]*(?:\\.\\d+)?|\\d+(?:\\.\\d+)?\\s?%'), lambda x: regexp_replace(x, '[,\\s]', '', 'g')), lambda x: regexp_replace(regexp_replace(x, '(\\.\\d*?)0+(%?)$', '\\1\\2'), '\\.(%?)$', '\\1'))"


@query(f"""WITH x AS (SELECT c.id, {_FIG.format(c='c.text')} AS a, {_FIG.format(c='d.text')} AS b FROM chunks c JOIN documents d USING (doc_id)) SELECT id, array_to_string(list_sort(list_distinct(list_filter(a, lambda v: NOT list_contains(b, v)))), ',') AS figures FROM x""")
def stale_figures(s: SparkSession, d: str) -> DataFrame:
    """Figures of passages that their documents no longer show."""
    docs = table(s, d, "documents").select("doc_id", F.col("text").alias("page"))
    both = table(s, d, "chunks").select("id", "doc_id", "text").join(docs, "doc_id")
    return both.select("id", F.array_join(F.array_sort(F.array_distinct(X.new_figures(F.col("text"), F.col("page")))), ",").alias("figures"))


@query("""WITH a AS (SELECT event_id AS key, 0 AS l, event_id AS place FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, 1, -event_id FROM events WHERE user_id % 2 = 0) SELECT key, CAST(l AS INTEGER) AS from_list, place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY l, place) AS n FROM a) WHERE n = 1""")
def lists_joined(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return A.concat_distinct([e.filter("event_type = 'purchase'").select(F.col("event_id").alias("key"), F.col("event_id").alias("place")), e.filter("user_id % 2 = 0").select(F.col("event_id").alias("key"), (-F.col("event_id")).alias("place"))], "key")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'en-us' WHEN doc_id % 4 = 1 THEN 'es' WHEN doc_id % 4 = 2 THEN 'de' END AS picked FROM documents""")
def tracks_picked(s: SparkSession, d: str) -> DataFrame:
    """English in any form, then Spanish, then whatever has the bare language."""
    t = lambda *codes: F.array(*(F.struct(F.lit(c).alias("code"), F.lit(c).alias("url")) for c in codes))
    k = F.col("doc_id") % 4
    tracks = F.when(k == 0, t("es", "en-us")).when(k == 1, t("de", "es")).when(k == 2, t("fr", "de")).otherwise(t("fr"))
    return table(s, d, "documents").select("doc_id", transcripts.pick_track(tracks, ["en", "es", "de-AT"]).alias("picked"))


@query("""WITH c AS (SELECT doc_id, idx, floor(greatest(start_time, 0)) AS a, floor(greatest(end_time, 0)) AS b, regexp_replace(substr(text, 1, 30), '[^A-Za-z ]', '', 'g') AS t FROM chunks WHERE start_time IS NOT NULL AND end_time IS NOT NULL AND start_time < 360000),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS no, CAST(a AS DOUBLE) AS start, CAST(b AS DOUBLE) AS "end", trim(regexp_replace(t, ' +', ' ', 'g')) AS text FROM c WHERE trim(t) <> '') SELECT doc_id, CAST(no AS INTEGER) AS no, start, "end", text FROM r""")
def cues_parsed(s: SparkSession, d: str) -> DataFrame:
    """Passages of recordings written as SubRip files and read again."""
    stamp = lambda c: F.format_string("%02d:%02d:%02d,000", F.floor(c / 3600).cast("int"), F.floor(c % 3600 / 60).cast("int"), (c % 60).cast("int"))
    c = table(s, d, "chunks").filter("start_time is not null and end_time is not null and start_time < 360000")
    text = F.regexp_replace(F.substring("text", 1, 30), "[^A-Za-z ]", "")
    cue = F.concat(F.col("idx").cast("string"), F.lit("\n"), stamp(F.floor(F.greatest("start_time", F.lit(0)))), F.lit(" --> "), stamp(F.floor(F.greatest("end_time", F.lit(0)))), F.lit("\n"), text)
    files = c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", cue.alias("cue")))), lambda x: x["cue"]), "\n\n").alias("text")).withColumn("suffix", F.lit("srt"))
    return transcripts.parse(files).select("doc_id", F.posexplode("segments").alias("no", "x")).select("doc_id", "no", "x.*")


@query("""WITH d AS (SELECT doc_id, n_chars AS n FROM documents), t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN (n // 3600) || ':' || (n % 3600 // 60) || ':' || (n % 60) WHEN 1 THEN (n // 60) || ':' || (n % 60) WHEN 2 THEN CAST(n AS VARCHAR) ELSE 'soon' END AS typed, n FROM d)
SELECT doc_id, typed, CASE WHEN doc_id % 4 < 3 THEN CAST(n AS DOUBLE) END AS seconds FROM t""")
def durations_read(s: SparkSession, d: str) -> DataFrame:
    n, k = F.col("n_chars"), F.col("doc_id") % 4
    text = lambda c: F.floor(c).cast("string")
    typed = F.when(k == 0, F.concat_ws(":", text(n / 3600), text(n % 3600 / 60), text(n % 60))).when(k == 1, F.concat_ws(":", text(n / 60), text(n % 60))).when(k == 2, n.cast("string")).otherwise("soon")
    return table(s, d, "documents").select("doc_id", typed.alias("typed")).select("doc_id", "typed", dates.duration_seconds(F.col("typed")).alias("seconds"))


@query("""WITH s AS (SELECT session_id, min(asked_at) AS began, max(asked_at) AS last FROM (SELECT DISTINCT * FROM questions_log) WHERE session_id IS NOT NULL GROUP BY 1), a AS (SELECT id, lower(trim(email)) AS email, (ascii(right(id, 1)) + length(coalesce(email, ''))) % 97 AS slot FROM accounts),
t AS (SELECT session_id, last, ascii(right(session_id, 1)) % 97 AS slot FROM s), f AS (SELECT slot, min(id) AS id FROM a GROUP BY 1)
SELECT t.session_id, f.id AS account_id FROM t JOIN f USING (slot) WHERE t.last > TIMESTAMP '2024-01-01'""")
def session_accounts(s: SparkSession, d: str) -> DataFrame:
    """The account behind each session that hasn't expired; slots stand in for tokens."""
    sessions = A.questions_once(table(s, d, "questions_log")).filter("session_id is not null").groupBy("session_id").agg(F.max("asked_at").alias("expires_at"))
    sessions = sessions.withColumn("slot", F.ascii(F.right("session_id", F.lit(1))) % 97)
    slot = (F.ascii(F.right("id", F.lit(1))) + F.length(F.coalesce("email", F.lit("")))) % 97
    accounts = table(s, d, "accounts").select("id", slot.alias("slot")).groupBy("slot").agg(F.min("id").alias("account_id"))
    return A.live_sessions(sessions, accounts, F.to_timestamp(F.lit("2024-01-01")), "slot").select("session_id", "account_id")


@query("""SELECT id, lower(trim(email)) AS email, contains(lower(email), '@mail.example') AS listed FROM accounts WHERE email IS NOT NULL""")
def listed_domains(s: SparkSession, d: str) -> DataFrame:
    e = F.lower(F.trim("email"))
    return table(s, d, "accounts").filter("email is not null").select("id", e.alias("email"), contact.disposable(e, ["mail.example"]).alias("listed"))


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z]+'), lambda x: length(x) > 3) AS t FROM documents),
k AS (SELECT doc_id, t, list_transform(t, lambda x: CASE WHEN regexp_matches(regexp_replace(regexp_replace(x, 'ies$', 'y'), 'sses$', 'ss'), '[^sui]s$') THEN left(regexp_replace(regexp_replace(x, 'ies$', 'y'), 'sses$', 'ss'), length(regexp_replace(regexp_replace(x, 'ies$', 'y'), 'sses$', 'ss')) - 1) ELSE regexp_replace(regexp_replace(x, 'ies$', 'y'), 'sses$', 'ss') END) AS k FROM t)
SELECT doc_id, array_to_string(list_filter(t, lambda x, i: list_position(k, k[i]) = i), ' ') AS stems FROM k""")
def title_stems(s: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) > 3)
    return table(s, d, "documents").select("doc_id", words.alias("t")).select("doc_id", F.array_join(titles.distinct_stems(F.col("t")), " ").alias("stems"))
