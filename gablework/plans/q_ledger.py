"""Ledger queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..session import table
from .registry import query

TODAY = "2026-03-15"

#: Entries in SQL: deliveries are copies, so distinct rows are distinct ids.
E = "entries AS (SELECT DISTINCT * FROM log_entries)"
DAY = "CASE WHEN regexp_full_match(trim(happened_on), '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(trim(happened_on) AS DATE) END"
C = "CAST(amount AS DECIMAL(18,2))"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.entries(table(spark, sf_dir, "log_entries"))


_IO = f"""CAST(coalesce(sum(CASE WHEN kind IN ('income') THEN {C} END), 0) AS DOUBLE) AS money_in,
  CAST(coalesce(sum(CASE WHEN kind IN ('expense','bill') THEN {C} END), 0) AS DOUBLE) AS money_out,
  CAST(coalesce(sum(CASE WHEN kind IN ('income') THEN {C} END), 0) - coalesce(sum(CASE WHEN kind IN ('expense','bill') THEN {C} END), 0) AS DOUBLE) AS net"""


@query(f"""
WITH {E}, d AS (SELECT *, {DAY} AS day FROM entries), m AS (SELECT strftime(unnest(generate_series(DATE '2025-04-01', DATE '2026-03-01', INTERVAL 1 MONTH)), '%Y-%m') AS month),
f AS (SELECT owner_id, month FROM (SELECT DISTINCT owner_id FROM d), m),
s AS (SELECT owner_id, strftime(day, '%Y-%m') AS month, {_IO} FROM d WHERE day >= DATE '2025-04-01' AND day < DATE '2026-04-01' GROUP BY 1, 2)
SELECT owner_id, month, coalesce(money_in, 0) AS money_in, coalesce(money_out, 0) AS money_out, coalesce(net, 0) AS net FROM f LEFT JOIN s USING (owner_id, month)
""")
def ledger_monthly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.monthly_totals(_entries(spark, sf_dir), last_month="2026-03", months=12)


@query(f"""
WITH {E}, d AS (SELECT CAST(o_custkey AS VARCHAR) AS owner_id, CASE o_orderstatus WHEN 'F' THEN 'income' WHEN 'O' THEN 'expense' ELSE 'bill' END AS kind, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS day FROM orders),
m AS (SELECT strftime(unnest(generate_series(DATE '1998-09-01', DATE '2001-08-01', INTERVAL 1 MONTH)), '%Y-%m') AS month), s AS (SELECT strftime(day, '%Y-%m') AS month, {_IO} FROM d WHERE day >= DATE '1998-09-01' AND day < DATE '2001-09-01' GROUP BY 1)
SELECT month, coalesce(money_in, 0) AS money_in, coalesce(money_out, 0) AS money_out, coalesce(net, 0) AS net FROM m LEFT JOIN s USING (month)
""")
def orders_monthly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "income").when(F.col("o_orderstatus") == "O", "expense").otherwise("bill")
    rows = o.select(F.lit("all").alias("owner_id"), kind.alias("kind"), F.col("o_totalprice").alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("happened_on"))
    return L.monthly_totals(rows, last_month="2001-08", months=36).drop("owner_id")


@query(f"WITH {E} SELECT kind, CAST(sum({C}) AS DOUBLE) AS total, count(*) AS n FROM entries WHERE amount IS NOT NULL GROUP BY kind")
def ledger_totals_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.totals_by_kind(_entries(spark, sf_dir))


@query(f"WITH {E} SELECT owner_id, {_IO} FROM entries WHERE amount IS NOT NULL GROUP BY owner_id")
def ledger_totals_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.totals(_entries(spark, sf_dir), ("owner_id",))


@query(f"""
WITH {E}, t AS (SELECT owner_id, coalesce(property_id, '') AS property_id, {_IO} FROM entries WHERE amount IS NOT NULL GROUP BY 1, 2),
p AS (SELECT owner_id, id AS property_id, trim(label) AS label FROM properties),
k AS (SELECT p.owner_id, p.property_id, p.label, coalesce(money_in, 0) AS money_in, coalesce(money_out, 0) AS money_out, coalesce(net, 0) AS net FROM p LEFT JOIN t USING (owner_id, property_id)),
u AS (SELECT owner_id, CAST(sum(CAST(money_in AS DECIMAL(18,2))) AS DOUBLE) AS money_in, CAST(sum(CAST(money_out AS DECIMAL(18,2))) AS DOUBLE) AS money_out, CAST(sum(CAST(net AS DECIMAL(18,2))) AS DOUBLE) AS net
  FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.owner_id = t.owner_id AND p.property_id = t.property_id) GROUP BY owner_id)
SELECT * FROM k UNION ALL SELECT owner_id, '', 'Unassigned', money_in, money_out, net FROM u WHERE money_in <> 0 OR money_out <> 0
""")
def ledger_by_property_unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.totals_by_property(_entries(spark, sf_dir), table(spark, sf_dir, "properties"))


@query(f"WITH {E} SELECT id, kind, status, happened_on FROM entries WHERE kind IN ('maintenance', 'bill') AND happened_on >= '2024-06-01' ORDER BY happened_on DESC NULLS LAST, created_at DESC NULLS LAST, id LIMIT 5000")
def ledger_list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.listing(_entries(spark, sf_dir), kinds=("maintenance", "bill"), since="2024-06-01", limit=9999).select("id", "kind", "status", "happened_on")


@query(f"WITH {E} SELECT id, what, vendor FROM entries WHERE lower(what) LIKE '%boiler%' OR lower(vendor) LIKE '%boiler%'")
def ledger_find_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.find(_entries(spark, sf_dir), "Boiler").select("id", "what", "vendor")


_RANK = "CASE urgency WHEN 'emergency' THEN 0 WHEN 'urgent' THEN 1 ELSE 2 END"


@query(f"""WITH {E} SELECT id, owner_id, urgency, row_number() OVER (PARTITION BY owner_id ORDER BY {_RANK}, happened_on NULLS FIRST, created_at NULLS FIRST, id)::INTEGER AS place
FROM entries WHERE kind = 'maintenance' AND status = 'open'""")
def open_items_worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.open_items(_entries(spark, sf_dir)).select("id", "owner_id", "urgency", "place")


@query(f"""WITH {E} SELECT id, owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY closed_at DESC NULLS LAST, created_at DESC NULLS LAST, id)::INTEGER AS place
FROM entries WHERE kind = 'maintenance' AND status = 'done'""")
def maintenance_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.maintenance_history(_entries(spark, sf_dir)).select("id", "owner_id", "place")


@query(f"WITH {E}, p AS (SELECT id AS property_id, trim(label) AS property_label FROM properties) SELECT e.id, coalesce(property_label, '') AS property_label FROM entries e LEFT JOIN p USING (property_id)")
def ledger_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_labels(_entries(spark, sf_dir), table(spark, sf_dir, "properties")).select("id", "property_label")


@query(f"""WITH {E} SELECT owner_id, count(*) AS n_entries, count(*) FILTER (WHERE kind = 'maintenance' AND status = 'open') AS n_open FROM entries GROUP BY owner_id""")
def ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).groupBy("owner_id").agg(F.count("*").alias("n_entries"), F.count_if((F.col("kind") == "maintenance") & (F.col("status") == "open")).alias("n_open"))


@query(f"""WITH {E} SELECT id FROM entries WHERE kind IN ('income','expense','bill') OR coalesce(amount, 0) <> 0""")
def ledger_money_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.money_entries(_entries(spark, sf_dir)).select("id")


@query(f"""
WITH {E}, hit AS (SELECT *, kind = 'maintenance' AND urgency = 'urgent' AS h FROM entries)
SELECT id, kind, CASE WHEN h THEN 'done' ELSE status END AS status, what, amount FROM hit
UNION ALL SELECT id || ':cost', 'expense', '', 'Completed: ' || what, amount FROM hit WHERE h AND status <> 'done' AND amount IS NOT NULL
""")
def ledger_close_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir)
    return L.close_maintenance(rows, rows.filter("urgency = 'urgent'"), F.to_timestamp(F.lit(TODAY))).select("id", "kind", "status", "what", "amount")


@query(f"""WITH {E} SELECT id, CASE owner_id WHEN 'browser:00000150' THEN 'account:acc00a1c59b00' ELSE owner_id END AS owner_id FROM entries""")
def ledger_reassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reassign(_entries(spark, sf_dir), "browser:00000150", "account:acc00a1c59b00").select("id", "owner_id")


@query(f"""
WITH {E}, w AS (SELECT id, lower(trim(coalesce(happened_on, ''))) AS w FROM entries), s AS (SELECT id, w, CASE WHEN regexp_full_match(w, '\\d{{1,2}}/\\d{{1,2}}(/(\\d{{2}}|\\d{{4}}))?') THEN string_split(w, '/') END AS p FROM w),
y AS (SELECT id, w, p, CASE WHEN p IS NULL THEN NULL WHEN len(p) = 2 THEN 2026 WHEN CAST(p[3] AS INTEGER) < 100 THEN CAST(p[3] AS INTEGER) + 2000 ELSE CAST(p[3] AS INTEGER) END AS y FROM s)
SELECT id, CAST(CASE WHEN w IN ('today', 'hoy', '') THEN DATE '{TODAY}' WHEN w IN ('yesterday', 'ayer') THEN DATE '{TODAY}' - 1
  WHEN regexp_full_match(w, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND TRY_CAST(w AS DATE) IS NOT NULL THEN TRY_CAST(w AS DATE)
  WHEN p IS NOT NULL THEN coalesce(TRY_CAST(printf('%04d-%02d-%02d', y, CAST(p[1] AS INTEGER), CAST(p[2] AS INTEGER)) AS DATE), DATE '{TODAY}') ELSE DATE '{TODAY}' END AS VARCHAR) AS day FROM y
""")
def ledger_parsed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import dates

    return _entries(spark, sf_dir).select("id", dates.parse_day(F.col("happened_on"), F.to_date(F.lit(TODAY))).cast("string").alias("day"))


@query(f"""
WITH {E}, p AS (SELECT owner_id, id AS property_id, lower(trim(label)) AS label, lower(trim(city)) AS city, created_at, count(*) OVER (PARTITION BY owner_id) AS n FROM properties),
a AS (SELECT e.id AS ask_id, e.owner_id, coalesce(q.label, '') AS text FROM entries e LEFT JOIN properties q ON q.id = e.property_id),
r AS (SELECT ask_id, p.property_id, p.created_at, CASE WHEN trim(text) = p.property_id THEN 1 WHEN t <> '' AND t = p.label THEN 2 WHEN length(t) > 3 AND contains(p.label, t) OR length(p.label) > 3 AND contains(t, p.label) THEN 3 WHEN t <> '' AND t = p.city THEN 4 WHEN t = '' AND n = 1 THEN 5 END AS rank
  FROM (SELECT *, lower(trim(text)) AS t FROM a) a JOIN p USING (owner_id))
SELECT ask_id, property_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY rank, created_at NULLS FIRST, property_id) AS nth FROM r WHERE rank IS NOT NULL) WHERE nth = 1
""")
def ledger_resolved_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = table(spark, sf_dir, "properties")
    asked = _entries(spark, sf_dir).join(props.select(F.col("id").alias("property_id"), F.col("label").alias("text")), "property_id", "left")
    return L.resolve_property(asked.select(F.col("id").alias("ask_id"), "owner_id", F.coalesce("text", F.lit("")).alias("text")), props)


@query(f"""
WITH {E} SELECT id, concat_ws(' | ', happened_on, kind, nullif(trim(what), ''), CASE WHEN amount IS NOT NULL THEN '$' || CAST({C} AS VARCHAR) END, nullif(trim(vendor), ''),
  CASE WHEN {DAY} IS NOT NULL THEN CAST(DATE '{TODAY}' - {DAY} AS VARCHAR) || ' days ago' END) AS line FROM entries
""")
def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.one_line(_entries(spark, sf_dir), F.to_date(F.lit(TODAY)))


_SAID = "trim(regexp_replace(coalesce(what, ''), '[\\s\\x{00}-\\x{1f}\\x{7f}]+', ' ', 'g'))"
_KINDS = "', '".join(L.KINDS)


@query(f"""WITH {E}, v AS (SELECT lower(unnest(list_concat([canonical], aliases))) AS a, canonical FROM ref_values WHERE field = 'log_entries.kind'), w AS (SELECT *, lower(trim(coalesce(kind, ''))) AS k, lower(trim(coalesce(happened_on, ''))) AS w FROM entries),
s AS (SELECT *, CASE WHEN regexp_full_match(w, '\\d{{1,2}}/\\d{{1,2}}(/(\\d{{2}}|\\d{{4}}))?') THEN string_split(w, '/') END AS p FROM w),
y AS (SELECT s.*, CASE WHEN p IS NULL THEN NULL WHEN len(p) = 2 THEN 2026 WHEN CAST(p[3] AS INTEGER) < 100 THEN CAST(p[3] AS INTEGER) + 2000 ELSE CAST(p[3] AS INTEGER) END AS y, coalesce(v.canonical, CASE WHEN k IN ('{_KINDS}') THEN k ELSE 'note' END) AS kd FROM s LEFT JOIN v ON v.a = s.k)
SELECT id, owner_id, kd AS kind, left({_SAID}, 400) AS what, CASE WHEN amount >= 0 AND amount <= 10000000 THEN CAST(round(CAST(CAST(amount AS VARCHAR) AS DECIMAL(28,6)), 2) AS DOUBLE) END AS amount,
CASE WHEN lower(trim(coalesce(status, ''))) IN ('open', 'done') THEN lower(trim(status)) WHEN kd = 'maintenance' THEN 'open' ELSE '' END AS status,
CASE WHEN kd <> 'maintenance' THEN '' WHEN lower(trim(coalesce(urgency, ''))) IN ('routine', 'urgent', 'emergency') THEN lower(trim(urgency)) ELSE 'routine' END AS urgency,
CAST(CASE WHEN w IN ('today', 'hoy', '') THEN DATE '{TODAY}' WHEN w IN ('yesterday', 'ayer') THEN DATE '{TODAY}' - 1 WHEN regexp_full_match(w, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND TRY_CAST(w AS DATE) IS NOT NULL THEN TRY_CAST(w AS DATE)
  WHEN p IS NOT NULL THEN coalesce(TRY_CAST(printf('%04d-%02d-%02d', y, CAST(p[1] AS INTEGER), CAST(p[2] AS INTEGER)) AS DATE), DATE '{TODAY}') ELSE DATE '{TODAY}' END AS VARCHAR) AS happened_on,
CASE WHEN {_SAID} = '' THEN 'nothing said' WHEN amount IS NOT NULL AND NOT (amount >= 0 AND amount <= 10000000) THEN 'amount' END AS problem FROM y""")
def ledger_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "ref_values").filter("field = 'log_entries.kind'").limit(L.MAX_ROWS + 1).collect()
    if len(refs) > L.MAX_ROWS:
        raise ValueError(f"more than {L.MAX_ROWS} kinds are listed")
    synonyms = {a.lower(): r.canonical for r in refs for a in [r.canonical, *r.aliases]}
    out = L.validate(_entries(spark, sf_dir), F.to_date(F.lit(TODAY)), synonyms)
    return out.withColumn("amount", F.col("amount").cast("double")).withColumn("happened_on", F.col("happened_on").cast("string"))
