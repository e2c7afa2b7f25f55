"""Fact queries. Documents play the rules: their dates are the interval in force, their titles what is matched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T
from ..functions.text import NOISE
from ..operators import facts as X
from ..session import table
from .q_corpus import _TRIM
from .registry import query

AS_OF = "2022-07-01"
BIND = r"\b(?:should|must|needs about|usually asks|is normal)\b"
PLACES = ("Larkfield", "Dunmere Park", "Lower Tannery", "Upper Tannery", "Beacon Row", "Oakparque")
_NOISE = ", ".join(f"'{w}'" for w in NOISE)


def terms(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9áéíóúñü]+'), lambda t: length(t) > 2 AND t NOT IN ({_NOISE})))"


def _rules(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    return docs.select("doc_id", F.col("title").alias("text"), dates.iso_day(F.col("published_at")).alias("effective_from"), F.when(F.col("doc_id") % 3 == 0, F.to_date("updated_at")).alias("effective_to"))


RULES = "r AS (SELECT doc_id, title AS text, CASE WHEN regexp_full_match(trim(published_at), '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(trim(published_at) AS DATE) END AS a, CASE WHEN doc_id % 3 = 0 THEN CAST(updated_at AS DATE) END AS b FROM documents)"


@query(f"WITH {RULES} SELECT doc_id FROM r WHERE (a IS NULL OR a <= DATE '{AS_OF}') AND (b IS NULL OR b >= DATE '{AS_OF}')")
def facts_in_force(s: SparkSession, d: str) -> DataFrame:
    return X.in_force(_rules(s, d), F.to_date(F.lit(AS_OF))).select("doc_id")


@query("""WITH e AS (SELECT DISTINCT * FROM log_entries), y AS (SELECT id, list_max(list_transform(regexp_extract_all(coalesce(what, ''), '\\b(20\\d{2})\\b', 1), lambda x: CAST(x AS INTEGER))) AS year FROM e WHERE regexp_matches(coalesce(what, ''), 'case|permit|order|invoice'))
SELECT id, year FROM y WHERE year IS NULL OR 2026 - year >= 2""")
def stale_facts(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "log_entries").dropDuplicates(["id"]).select("id", F.coalesce("what", F.lit("")).alias("text"), F.lit(None).cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    return X.stale(rows, F.to_date(F.lit("2026-03-01")), pattern="case|permit|order|invoice").select("id", "year")


@query(f"""WITH q AS (SELECT DISTINCT * FROM questions_log WHERE id % 100 = 0), a AS (SELECT DISTINCT id AS query_id, unnest({terms('question')}) AS term FROM q), f AS (SELECT doc_id AS fact_id, unnest({terms('title')}) AS term FROM documents),
m AS (SELECT query_id, fact_id, count(*) AS overlap FROM a JOIN f USING (term) GROUP BY ALL) SELECT query_id, fact_id, overlap, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, fact_id) AS place FROM m) WHERE place <= 8""")
def fact_selection(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "questions_log").dropDuplicates(["id"]).filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    return X.matching_facts(q, table(s, d, "documents").select(F.col("doc_id").alias("fact_id"), F.col("title").alias("text")))


def _passages(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").select(F.col("id").alias("chunk_id"), "doc_id", "text")
    read = c.filter("doc_id % 7 = 0").select("chunk_id")
    return X.candidates(c, table(s, d, "documents"), read, kinds=("website",), binding=BIND)


CAND = f"p AS (SELECT c.id AS chunk_id, c.text FROM chunks c JOIN documents d USING (doc_id) WHERE d.kind = 'website' AND doc_id % 7 <> 0 AND regexp_matches(c.text, '\\d') AND regexp_matches(c.text, '{BIND}'))"
SENT = "s0 AS (SELECT chunk_id, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]?'), lambda x: " + _TRIM + "), lambda x: x <> '') AS l FROM p), s1 AS (SELECT chunk_id, text, generate_subscripts(l, 1) - 1 AS sentence_no, unnest(l) AS sentence FROM s0)"
KEPT = f"s AS (SELECT * FROM s1 WHERE length(sentence) BETWEEN 40 AND 320 AND regexp_matches(sentence, '\\d') AND regexp_matches(sentence, '{BIND}'))"


@query(f"WITH {CAND} SELECT chunk_id FROM p")
def mining_candidates(s: SparkSession, d: str) -> DataFrame:
    return _passages(s, d).select("chunk_id")


@query(f"WITH {CAND}, {SENT}, {KEPT} SELECT chunk_id, CAST(sentence_no AS INTEGER) AS sentence_no, sentence FROM s")
def rule_sentences(s: SparkSession, d: str) -> DataFrame:
    return X.rule_sentences(_passages(s, d), binding=BIND)


#: The tokens of a sentence and the place of the first dollar sign, as the price is read.
TOK = r"""t AS (SELECT *, regexp_extract_all(sentence, '\$|\d[\d,.]*\d|\d|[A-Za-z]+|[^\sA-Za-z\d$]') AS t FROM s), u AS (SELECT *, list_position(t, '$') AS d FROM t),
v AS (SELECT *, CASE WHEN d > 0 THEN TRY_CAST(replace(t[d + 1], ',', '') AS DOUBLE) * CASE WHEN lower(t[d + 2]) = 'k' THEN 1000 ELSE 1 END END AS a, d + 2 + CASE WHEN lower(t[d + 2]) = 'k' THEN 1 ELSE 0 END AS w FROM u),
x AS (SELECT *, w + 1 + CASE WHEN t[w + 1] = '$' THEN 1 ELSE 0 END AS j FROM v),
y AS (SELECT chunk_id, sentence_no, sentence, a, CASE WHEN lower(t[w]) IN ('to', 'and', '-', '–') THEN TRY_CAST(replace(t[j], ',', '') AS DOUBLE) * CASE WHEN lower(t[j + 1]) = 'k' THEN 1000 ELSE 1 END END AS b FROM x)"""


@query(f"WITH {CAND}, {SENT}, {KEPT}, {TOK} SELECT chunk_id, CAST(sentence_no AS INTEGER) AS sentence_no, CASE WHEN a IS NULL THEN 'rule' ELSE 'cost' END AS kind, least(a, coalesce(b, a)) AS low, greatest(a, coalesce(b, a)) AS high FROM y")
def proposals(s: SparkSession, d: str) -> DataFrame:
    return X.proposals(_passages(s, d), PLACES, binding=BIND).select("chunk_id", "sentence_no", "kind", "low", "high")


def _ordered(c: str) -> str:
    """Distinct terms in the order of their first places."""
    return f"list_filter(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9áéíóúñü]+'), lambda t: length(t) > 2 AND t NOT IN ({_NOISE})), lambda x, i: list_position(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9áéíóúñü]+'), lambda t: length(t) > 2 AND t NOT IN ({_NOISE})), x) = i)"


def _place(c: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({c}), '{p.lower()}') THEN '{p}'" for p in PLACES) + " END"


_FLAT = "trim(regexp_replace(lower({c}), '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"
GROUPS = f"""{CAND}, {SENT}, {KEPT}, {TOK}, raw AS (SELECT y.chunk_id || '#' || y.sentence_no AS id, CASE WHEN a IS NULL THEN 'rule' ELSE 'cost' END AS kind, y.sentence AS rule, array_to_string((list_filter({_ordered('y.sentence')}, lambda w: NOT regexp_full_match(w, '\\d+')))[1:4], ' ') AS topic,
  coalesce({_place('y.sentence')}, {_place('p.text')}, '') AS jur, y.chunk_id AS source FROM y JOIN p USING (chunk_id)),
k AS (SELECT *, list_sort({terms('topic')}) AS words, kind || '|' || {_FLAT.format(c='jur')} || '|' || array_to_string(list_sort(list_distinct(regexp_extract_all(rule, '\\d+(?:[.,]\\d+)?'))), ',') AS nk, kind || '|' || {_FLAT.format(c='rule')} AS fp FROM raw),
f AS (SELECT *, nk || '|' || array_to_string(words, ' ') AS fact FROM k), lab AS (SELECT DISTINCT nk, fact, words FROM f WHERE len(words) > 0),
edge AS (SELECT DISTINCT x.fact AS a, y.fact AS b FROM f x JOIN f y ON x.fp = y.fp AND x.fact <> y.fact UNION SELECT x.fact, y.fact FROM lab x JOIN lab y ON x.nk = y.nk AND x.fact <> y.fact AND list_has_all(y.words, x.words) UNION SELECT y.fact, x.fact FROM lab x JOIN lab y ON x.nk = y.nk AND x.fact <> y.fact AND list_has_all(y.words, x.words)),
reach AS (SELECT DISTINCT fact AS root, fact AS node FROM f UNION SELECT r.root, e.b FROM reach r JOIN edge e ON e.a = r.node), comp AS (SELECT node AS fact, min(root) AS g FROM reach GROUP BY 1),
g AS (SELECT g, count(*) AS support, count(DISTINCT source) AS sources, arg_max(struct_pack(id := id, rule := rule, topic := topic, words := words), struct_pack(a := least(length(rule), 400), b := source, c := id)) AS lead FROM f JOIN comp USING (fact) GROUP BY g),
gw AS (SELECT g, unnest(lead.words) AS w FROM g), cnt AS (SELECT w, count(*) AS n FROM gw GROUP BY 1), cap AS (SELECT greatest(2, CAST(floor(count(*) * 0.4) AS BIGINT)) AS c FROM g),
sub AS (SELECT g, arg_min(w, struct_pack(a := CASE WHEN n > c THEN 1 ELSE 0 END, b := CASE WHEN n <= c THEN -n ELSE 0 END, d := w)) AS subject FROM gw JOIN cnt USING (w), cap GROUP BY g),
kt AS (SELECT DISTINCT unnest({terms('canonical')}) AS w FROM ref_values), kn AS (SELECT g, count(*) >= 2 AS known FROM gw JOIN kt USING (w) GROUP BY g),
ask AS (SELECT DISTINCT id, unnest({terms('question')}) AS w FROM questions_log WHERE not_covered), gt AS (SELECT DISTINCT g, unnest({terms("lead.topic || ' ' || lead.rule")}) AS w FROM g),
wa AS (SELECT DISTINCT g, true AS wanted FROM (SELECT g, id FROM gt JOIN ask USING (w) GROUP BY g, id HAVING count(*) >= 2)),
o AS (SELECT support, sources, lead.id AS lead_id, lead.topic AS topic, coalesce(subject, 'other') AS subject, coalesce(known, false) AS known, coalesce(wanted, false) AS wanted, false AS cited FROM g LEFT JOIN sub USING (g) LEFT JOIN kn USING (g) LEFT JOIN wa USING (g))"""


@query(f"""WITH RECURSIVE {GROUPS} SELECT *, CAST(sum(support) OVER w AS BIGINT) AS weight, bool_or(wanted) OVER w AS asked_for, bool_or(cited) OVER w AS has_cite, CAST(row_number() OVER (PARTITION BY known, subject ORDER BY wanted DESC, cited DESC, support DESC, topic, lead_id) AS INTEGER) AS place FROM o WINDOW w AS (PARTITION BY known, subject)""")
def proposal_groups(s: SparkSession, d: str) -> DataFrame:
    raws = X.proposals(_passages(s, d), PLACES, binding=BIND).select(F.concat_ws("#", "chunk_id", F.col("sentence_no").cast("string")).alias("id"), "kind", "rule", "topic", "jurisdiction", F.lit("").alias("citation"), F.col("chunk_id").alias("source"))
    known = table(s, d, "ref_values").select(F.explode(T.terms(F.col("canonical"))).alias("term"))
    asked = table(s, d, "questions_log").dropDuplicates(["id"]).filter("not_covered").select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    return X.review_order(X.grouped_proposals(raws, known, asked)).drop("group_id")


@query(f"WITH {CAND} SELECT count(*) AS passages, CAST(ceil((sum(least(length(text), 1200)) / 3.6::DOUBLE + ceil(count(*) / 12.0::DOUBLE) * 500) * 1.25::DOUBLE) AS BIGINT) AS input_tokens, CAST(ceil((count(*) * 120 + ceil(count(*) / 12.0::DOUBLE) * 200) * 1.25::DOUBLE) AS BIGINT) AS output_tokens FROM p")
def mining_estimate(s: SparkSession, d: str) -> DataFrame:
    return X.mining_estimate(_passages(s, d))


TIERS = ((1, "North", r"\bnorth\b|heights|upper"), (2, "South", r"\bsouth\b|lower"), (3, "Water", r"port|harbor|springs|landing"))


@query("""WITH l AS (SELECT ref_id, canonical AS label FROM ref_values), h AS (SELECT ref_id, label, list_filter([CASE WHEN regexp_matches(lower(label), '\\bnorth\\b|heights|upper') THEN {'tier': 1, 'heading': 'North'} END, CASE WHEN regexp_matches(lower(label), '\\bsouth\\b|lower') THEN {'tier': 2, 'heading': 'South'} END,
CASE WHEN regexp_matches(lower(label), 'port|harbor|springs|landing') THEN {'tier': 3, 'heading': 'Water'} END], lambda x: x IS NOT NULL) AS f FROM l), e AS (SELECT ref_id, label, unnest(CASE WHEN len(f) > 0 THEN f ELSE [{'tier': 99, 'heading': 'Other'}] END) AS x FROM h) SELECT ref_id, label, CAST(x.tier AS INTEGER) AS tier, x.heading AS heading FROM e""")
def jurisdiction_headings(s: SparkSession, d: str) -> DataFrame:
    return X.headings(table(s, d, "ref_values").select("ref_id", F.col("canonical").alias("label")), TIERS)


@query("""WITH e AS (SELECT DISTINCT * FROM log_entries), x AS (SELECT id, 'email' AS kind, unnest(list_distinct(regexp_extract_all(coalesce(what, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}'))) AS value FROM e
UNION ALL SELECT id, 'phone', unnest(list_distinct(regexp_extract_all(coalesce(what, ''), '(?:\\+?1[\\s.–-]?)?(?:\\(\\d{3}\\)\\s?|\\d{3}[\\s./–-]?)\\d{3}[\\s.–-]?\\d{4}'))) FROM e
UNION ALL SELECT id, 'street', unnest(list_distinct(regexp_extract_all(coalesce(what, ''), '\\b\\d{2,5}(?:-\\d{2,5})?\\s+(?:[NSEW]\\.?\\s+|North\\s+|South\\s+|East\\s+|West\\s+)?[A-Z][\\w-]+\\s+(?:St|Ave|Avenue|Street|Blvd|Road|Rd|Ln|Lane|Ct|Court|Pl|Place|Pkwy|Terrace)\\b'))) FROM e) SELECT * FROM x""")
def pii_scan(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "log_entries").dropDuplicates(["id"]).select("id", F.coalesce("what", F.lit("")).alias("text"))
    return X.pattern_details(rows)
