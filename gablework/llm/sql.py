"""The same queries as SQL, where SQL can state them over whole tables."""

from __future__ import annotations

_LINES = """
WITH cut AS (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents WHERE source IS NOT NULL),
lines AS (SELECT doc_id, source, CAST(unnest(generate_series(0, len(a) - 1)) AS INTEGER) AS line_no, unnest(a) AS line FROM cut),
keyed AS (SELECT doc_id, source, line_no, regexp_replace(lower(line), '[^\\p{L}]+', '', 'g') AS k FROM lines),
sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
often AS (
  SELECT k.source, k.k FROM keyed k JOIN sizes s USING (source) WHERE k.k <> ''
  GROUP BY k.source, k.k, s.n HAVING count(DISTINCT k.doc_id) >= 3 AND count(DISTINCT k.doc_id) * 100 >= s.n * 20
)"""

P4_FOUND = _LINES + " SELECT k.doc_id, k.line_no FROM keyed k JOIN often o USING (source, k)"


_SPACE = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"

P1_FOUND = f"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, unnest(generate_series(0, len(a) - 1)) AS i, unnest(a) AS x FROM cut),
counted AS (SELECT doc_id, i, len(list_filter(regexp_split_to_array(x, '{_SPACE}'), lambda w: w <> '')) AS n FROM lines),
marked AS (SELECT *, n > 0 AND coalesce(lag(n) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS opens FROM counted),
paras AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS para_no FROM marked)
SELECT doc_id, CAST(para_no AS INTEGER) AS para_no FROM paras WHERE n > 0 GROUP BY doc_id, para_no HAVING sum(n) > 350"""


P4_CLEANED = _LINES.replace("SELECT doc_id, source, string_split", "SELECT doc_id, source, published_at, string_split").replace("lines AS (SELECT doc_id, source, CAST", "lines AS (SELECT doc_id, source, published_at, CAST").replace(
    "keyed AS (SELECT doc_id, source, line_no, regexp", "keyed AS (SELECT doc_id, source, published_at, line, line_no, regexp"
) + """,
texts AS (
  SELECT doc_id, source, any_value(nullif(trim(published_at), '')) AS date, string_agg(k, chr(31) ORDER BY line_no) AS seq FROM keyed WHERE k <> '' GROUP BY doc_id, source
),
clusters AS (SELECT source, seq, min(date) AS date FROM texts GROUP BY source, seq),
held AS (SELECT DISTINCT k.source, k.k, t.seq FROM keyed k JOIN texts t USING (doc_id, source) WHERE k.k <> ''),
gone AS (
  SELECT h.source, h.k FROM held h JOIN often o USING (source, k) JOIN clusters c ON h.source = c.source AND h.seq = c.seq
  GROUP BY h.source, h.k HAVING count(*) >= 3 AND count(DISTINCT coalesce(c.date, c.seq)) >= 3
),
kept AS (
  SELECT k.doc_id, string_agg(k.line, chr(10) ORDER BY k.line_no) AS clean_text FROM keyed k LEFT JOIN gone g ON k.source = g.source AND k.k = g.k
  WHERE g.k IS NULL GROUP BY k.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN d.source IS NULL THEN d.text ELSE coalesce(x.clean_text, '') END AS clean_text FROM documents d LEFT JOIN kept x USING (doc_id)"""


_NEAR = """v AS (SELECT DISTINCT ON (id) id, doc_id, embedding_model AS m, CAST(embedding AS DOUBLE[]) AS e FROM chunks WHERE id IS NOT NULL AND embedding_model IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v), u AS (SELECT * FROM n WHERE norm > 0 AND isfinite(norm)),
s AS (SELECT a.id AS x, a.doc_id, b.id AS y, round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 6) AS s FROM u a JOIN u b ON a.m = b.m AND len(a.e) = len(b.e) AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS nth FROM s)"""
P5_FOUND = f"WITH {_NEAR} SELECT DISTINCT least(x, y) AS chunk_a, greatest(x, y) AS chunk_b FROM r WHERE nth <= 5 AND s >= 0.95"
P5_JOIN_RECALL = f"WITH {_NEAR}, p AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM r WHERE nth <= 5 AND s >= 0.95 AND doc_id % 100 = 0) SELECT count(*) AS n_pairs, count(*) AS n_found FROM p"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p4_cleaned": P4_CLEANED, "p4_found": P4_FOUND, "p5_found": P5_FOUND, "p5_join_recall": P5_JOIN_RECALL}
