"""Scalar functions over whole columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contact, dates, deals, flags, money
from ..functions import text as T
from ..functions import urls as U
from ..session import table
from .q_activity import title_sql
from .q_facts import terms
from .q_retrieval import toks
from .registry import query


@query(f"SELECT id, {title_sql('question')} AS title FROM (SELECT DISTINCT * FROM questions_log)")
def question_titles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "questions_log").dropDuplicates(["id"]).select("id", T.thread_title(F.col("question")).alias("title"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), '-') AS slug, CAST(floor(length(text) / 4) AS INTEGER) AS tokens FROM documents")
def title_slugs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.slug(F.col("title")).alias("slug"), T.approx_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, array_to_string({toks('title')}, ' ') AS tokens, array_to_string(list_sort({terms('title')}), ' ') AS terms FROM documents")
def title_tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.array_join(T.tokens(F.col("title")), " ").alias("tokens"), F.array_join(F.array_sort(T.terms(F.col("title"))), " ").alias("terms"))


@query("""WITH c AS (SELECT id, CAST(floor(greatest(start_time, 0)) AS BIGINT) AS t FROM chunks WHERE start_time IS NOT NULL) SELECT id, CASE WHEN t >= 3600 THEN printf('%d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60) ELSE printf('%d:%02d', t // 60, t % 60) END AS clock FROM c""")
def chunk_clocks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").filter("start_time is not null").select("id", dates.clock(F.col("start_time")).alias("clock"))


@query("""WITH c AS (SELECT c.id, CAST(floor(greatest(c.start_time, 0)) AS BIGINT) AS t, d.link FROM chunks c JOIN documents d USING (doc_id) WHERE c.start_time IS NOT NULL)
SELECT id, CASE WHEN link IS NULL OR NOT regexp_matches(link, '^https?://', 'i') THEN NULL WHEN regexp_matches(link, '//([^/]*\\.)?(youtube|video|youtu)\\.[^/]+/|//youtu\\.be/', 'i') THEN link || CASE WHEN contains(link, '?') THEN '&t=' ELSE '?t=' END || t ELSE link END AS link FROM c""")
def deep_links(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").filter("start_time is not null").select("id", "doc_id", "start_time").join(table(s, d, "documents").select("doc_id", "link"), "doc_id")
    return c.select("id", T.deep_link(F.col("link"), F.col("start_time")).alias("link"))


@query("""WITH e AS (SELECT DISTINCT * FROM log_entries), f AS (SELECT id, list_distinct(list_transform(list_transform(regexp_extract_all(coalesce(what, ''), '\\$\\s?\\d[\\d,]*(?:\\.\\d+)?|\\d+(?:\\.\\d+)?\\s?%'), lambda x: regexp_replace(x, '[,\\s]', '', 'g')), lambda x: regexp_replace(regexp_replace(x, '(\\.\\d*?)0+(%?)$', '\\1\\2'), '\\.(%?)$', '\\1'))) AS f FROM e)
SELECT id, array_to_string(list_sort(f), ' ') AS figures FROM f WHERE len(f) > 0""")
def entry_figures(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "log_entries").dropDuplicates(["id"]).select("id", T.figures(F.col("what")).alias("f"))
    return rows.filter(F.size("f") > 0).select("id", F.array_join(F.array_sort("f"), " ").alias("figures"))


@query("""WITH a AS (SELECT id, regexp_replace(coalesce(phone, ''), '\\D', '', 'g') AS g, lower(trim(email)) AS e FROM accounts), t AS (SELECT id, e, CASE WHEN length(g) = 11 AND starts_with(g, '1') THEN substr(g, 2) ELSE g END AS t FROM a)
SELECT id, CASE WHEN regexp_full_match(t, '[2-9]\\d{2}[2-9]\\d{6}') AND NOT regexp_matches(t, '^.11|^\\d{3}.11|^0{10}$|^1{10}$|^2{10}$|^3{10}$|^4{10}$|^5{10}$|^6{10}$|^7{10}$|^8{10}$|^9{10}$') THEN t END AS phone, CASE WHEN regexp_full_match(e, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}') AND NOT contains(e, '..') THEN e END AS email FROM t""")
def contact_forms(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "accounts").select("id", contact.us_phone(F.col("phone")).alias("phone"), contact.email(F.col("email")).alias("email"))


_AM = "lower(regexp_replace(trim(raw), '[$,\\s]', '', 'g'))"


@query(f"""WITH e AS (SELECT DISTINCT * FROM log_entries), x AS (SELECT id, unnest(regexp_extract_all(coalesce(what, ''), '\\$[\\d,.]+k?')) AS raw FROM e), n AS (SELECT id, raw, {_AM} AS p FROM x), v AS (SELECT id, raw, CASE WHEN regexp_full_match(regexp_replace(p, 'k$', ''), '\\d+(\\.\\d+)?|\\.\\d+') THEN CAST(regexp_replace(p, 'k$', '') AS DECIMAL(28,6)) * CASE WHEN ends_with(p, 'k') THEN 1000 ELSE 1 END END AS v FROM n)
SELECT id, raw, CAST(CASE WHEN v >= 0 AND v <= 10000000 THEN round(v, 2) END AS DOUBLE) AS amount FROM v""")
def amounts_parsed(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "log_entries").dropDuplicates(["id"]).select("id", F.explode(F.regexp_extract_all(F.coalesce("what", F.lit("")), F.lit(r"\$[\d,.]+k?"), F.lit(0))).alias("raw"))
    return x.select("id", "raw", money.parse_amount(F.col("raw")).cast("double").alias("amount"))


@query("SELECT o_orderkey, round(p * r * g / (g - 1), 2) AS payment, p * 0.01 <= o_totalprice / 90 AS one_percent FROM (SELECT o_orderkey, o_totalprice, o_totalprice * 0.8 AS p, 0.065::DOUBLE / 12 AS r, pow(1 + 0.065::DOUBLE / 12, 360) AS g FROM orders)")
def mortgage_payments(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    loan = F.col("o_totalprice") * 0.8
    return o.select("o_orderkey", deals.level_payment(loan, F.lit(0.065), F.lit(30)).alias("payment"), deals.one_percent(loan, F.col("o_totalprice") / 90).alias("one_percent"))


def _half_up(x: str, places: int) -> str:
    """A double rounded as its decimal digits are, half up."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 16)), {places}) AS DOUBLE)"


@query(f"""WITH a AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS p FROM orders), b AS (SELECT *, {_half_up('p * 0.75::DOUBLE', 2)} AS loan, p * 0.011::DOUBLE AS rent, p * 0.003::DOUBLE AS costs FROM a),
c AS (SELECT *, CASE WHEN loan <= 0 THEN 0.0::DOUBLE ELSE {_half_up('loan * (0.065::DOUBLE / 12) * pow(1 + 0.065::DOUBLE / 12, 360) / (pow(1 + 0.065::DOUBLE / 12, 360) - 1)', 2)} END AS debt, {_half_up('rent * 0.95::DOUBLE', 2)} AS income FROM b),
e AS (SELECT *, {_half_up('income - costs', 2)} AS op FROM c), f AS (SELECT *, {_half_up('op - debt', 2)} AS flow, op * 12 AS noi FROM e)
SELECT o_orderkey, loan, debt, flow, {_half_up('noi', 2)} AS noi, CASE WHEN p <= 0 THEN 0.0 ELSE {_half_up('noi / p', 4)} END AS cap_rate, CASE WHEN p <= 0 THEN 0.0 ELSE {_half_up('round(flow * 12, 2) / (p * 0.25::DOUBLE + p * 0.02::DOUBLE)', 4)} END AS cash_on_cash,
CASE WHEN debt <= 0 THEN 0.0 ELSE {_half_up('noi / (debt * 12)', 2)} END AS debt_cover, CASE WHEN rent <= 0 THEN 0.0 ELSE {_half_up('(costs + debt) / rent', 4)} END AS break_even, p > 0 AND rent >= p * 0.01::DOUBLE AS one_percent FROM f""")
def deal_analysis(s: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice")
    a = deals.analysis(price, F.lit(0.25), F.lit(0.065), F.lit(30), price * 0.011, F.lit(0.05), price * 0.003, price * 0.02)
    return table(s, d, "orders").select("o_orderkey", a.alias("a")).select("o_orderkey", "a.*")


@query("""WITH q AS (SELECT DISTINCT * FROM questions_log), f AS (SELECT id, trim(regexp_replace(lower(translate(question, '‘’“”áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÉÈÊËÍÓÖÚÜÑÇ', '''''""aaaaaaeeeeiiiiooooouuuuncaaaaeeeeioouunc')), '[\\s\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', ' ', 'g')) AS t FROM q)
SELECT id, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(t, 'lease|contrato|agreement') THEN 'legal' END, CASE WHEN regexp_matches(t, 'who pays|quien paga') THEN 'money' END, CASE WHEN regexp_matches(t, '\\b(?:vacancy|vacancies)(?:s|es)?\\b') THEN 'vacancy' END], lambda x: x IS NOT NULL)), ',') AS flags FROM f""")
def question_flags(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "questions_log").dropDuplicates(["id"])
    c = F.col("question")
    rules = {"legal": flags.any_phrase(c, ("lease", "contrato", "agreement")), "money": flags.any_phrase(c, ("who pays", "quien paga")), "vacancy": flags.any_word(c, ("vacancy", "vacancies"))}
    return q.select("id", F.array_join(flags.flags(c, rules), ",").alias("flags"))


@query("""WITH q AS (SELECT DISTINCT * FROM questions_log), f AS (SELECT id, question, coalesce(trim(regexp_replace(lower(translate(question, '‘’“”áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÉÈÊËÍÓÖÚÜÑÇ', '''''""aaaaaaeeeeiiiiooooouuuuncaaaaeeeeioouunc')), '[\\s\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', ' ', 'g')), '') AS t FROM q),
w AS (SELECT *, len(list_filter(regexp_split_to_array(t, ' +'), lambda x: x <> '')) AS n FROM f),
s AS (SELECT *, t = '' OR (regexp_matches(t, '^(?:hi|hello|hey|thanks|thank you|hola|gracias|bye)\\b') AND n <= 8) AS small_talk FROM w)
SELECT id, regexp_matches(t, '\\b(?:tenant|applicant|inquilin)\\w*(?:\\W+\\w+){0,11}\\W+(?:ask|refus|paga)\\w*|\\b(?:ask|refus|paga)\\w*(?:\\W+\\w+){0,11}\\W+(?:tenant|applicant|inquilin)\\w*') AS near, small_talk,
regexp_matches(t, '^(?:and|but|what about|how about|also|y|pero)\\b') OR regexp_matches(t, '^(?:it|that|this|they|those|these|he|she|eso|esto)\\b') OR n < 10 AS follow_up,
CASE WHEN small_talk THEN 'low' WHEN regexp_matches(t, '\\b(?:checklist|letter)(?:s|es)?\\b') OR n > 60 THEN 'high' ELSE 'default' END AS effort FROM s""")
def question_nearness(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "questions_log").dropDuplicates(["id"])
    c = F.col("question")
    return q.select("id", flags.near(c, ("tenant", "applicant", "inquilin"), ("ask", "refus", "paga"), 12).alias("near"), flags.small_talk(c).alias("small_talk"), flags.follow_up(c).alias("follow_up"), flags.effort(c, ("checklist", "letter")).alias("effort"))


@query("SELECT doc_id, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS title FROM documents")
def escaped_titles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.escape_text(F.col("title")).alias("title"))


@query("""SELECT doc_id, month(day) * 100 + day(day) >= 915 OR month(day) * 100 + day(day) <= 601 AS heat FROM (SELECT doc_id, TRY_CAST(published_at AS DATE) AS day FROM documents WHERE regexp_full_match(published_at, '\\d{4}-\\d{2}-\\d{2}')) WHERE day IS NOT NULL""")
def heat_season(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").filter(r"published_at rlike '^\\d{4}-\\d{2}-\\d{2}$'").select("doc_id", dates.iso_day(F.col("published_at")).alias("day")).filter("day is not null")
    return rows.select("doc_id", dates.in_season(F.col("day"), (9, 15), (6, 1)).alias("heat"))


@query("""SELECT id, CASE WHEN length(o) > 220 THEN rtrim(left(o, 219)) || '…' ELSE o END AS quote FROM (SELECT id, trim(string_split(trim(regexp_replace(trim(text), '^(>>\\s*)+', '')), '>>')[1]) AS o FROM chunks)""")
def chunk_quotes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("id", T.quote(F.col("text")).alias("quote"))


@query("SELECT doc_id, regexp_full_match(coalesce(link, ''), '.*[?&]v=[A-Za-z0-9_-]{11}.*') AS has_video, regexp_extract(coalesce(link, ''), '[?&]v=([A-Za-z0-9_-]{11})($|[^A-Za-z0-9_-])', 1) AS video FROM documents WHERE kind = 'youtube'")
def video_ids(s: SparkSession, d: str) -> DataFrame:
    v = U.video_id(F.col("link"))
    return table(s, d, "documents").filter("kind = 'youtube'").select("doc_id", v.isNotNull().alias("has_video"), F.coalesce(v, F.lit("")).alias("video"))
