"""Retrieval queries. Questions: the titles of documents whose doc_id is divisible by 100, with their first chunk's vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS
from ..operators import retrieval as R
from ..session import table
from .registry import query

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)


def toks(col: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower(coalesce({col}, '')), '[a-z0-9'']+'), lambda t: regexp_replace(trim(t, ''''), '''s$', '')), lambda t: t <> '' AND t NOT IN ({_STOP}))"


_CORPUS = f"""
c AS (SELECT c.id AS chunk_id, c.doc_id, c.text, c.embedding_model AS model, c.embedding, d.kind, d.episode, d.channel FROM chunks c JOIN documents d USING (doc_id)),
tk AS (SELECT chunk_id, {toks('text')} AS toks FROM c), co AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tk),
po AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS term FROM tk) GROUP BY ALL),
i0 AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM po, co GROUP BY term),
di AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0),
q AS (SELECT CAST(doc_id AS VARCHAR) AS query_id, title AS text FROM documents WHERE doc_id % 100 = 0),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({toks('text')}) AS term FROM q) GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN di USING (term) JOIN po USING (term), co GROUP BY ALL HAVING score > 0),
lx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM bm),
ov AS (SELECT query_id, chunk_id, CAST(count(*) AS DOUBLE) AS score FROM qt JOIN po USING (term) GROUP BY ALL),
qv AS (SELECT CAST(doc_id AS VARCHAR) AS query_id, embedding_model AS model, embedding::DOUBLE[] AS v FROM chunks WHERE doc_id % 100 = 0 AND idx = 0 AND len(embedding) > 0),
cs AS (SELECT query_id, chunk_id, list_cosine_similarity(v, c.embedding::DOUBLE[]) AS score FROM qv JOIN c ON qv.model = c.model AND len(qv.v) = len(c.embedding)
  WHERE list_aggregate(list_transform(v, lambda x: x * x), 'sum') > 0 AND list_aggregate(list_transform(c.embedding::DOUBLE[], lambda x: x * x), 'sum') > 0),
vr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM cs) WHERE rank <= 200 AND score > 0),
fu AS (SELECT coalesce(lx.query_id, vr.query_id) AS query_id, coalesce(lx.chunk_id, vr.chunk_id) AS chunk_id, lx.rank AS lexical_rank, vr.rank AS vector_rank,
  coalesce(1.0::DOUBLE / (60 + lx.rank), 0) + coalesce(1.0::DOUBLE / (60 + vr.rank), 0) AS score FROM lx FULL JOIN vr ON lx.query_id = vr.query_id AND lx.chunk_id = vr.chunk_id)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "kind", "episode", "channel")
    c = table(spark, sf_dir, "chunks").select(F.col("id").alias("chunk_id"), "doc_id", "text", F.col("embedding_model").alias("model"), "embedding")
    return c.join(d, "doc_id")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id % 100 = 0").select(F.col("doc_id").cast("string").alias("query_id"), F.col("title").alias("text"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").filter("doc_id % 100 = 0 and idx = 0").select(F.col("doc_id").cast("string").alias("id"), F.col("embedding_model").alias("model"), "embedding")


@query(f"WITH t AS (SELECT DISTINCT doc_id, unnest({toks('text')}) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY term")
def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.term_document_frequency(table(spark, sf_dir, "documents"))


@query(f"WITH {_CORPUS} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM lx WHERE rank <= 8")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = R.build_index(_chunks(spark, sf_dir))
    return R.bm25_topk(index, _questions(spark, sf_dir), 8).select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


@query(f"WITH {_CORPUS} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ov) WHERE rank <= 8")
def overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overlap_topk(R.build_index(_chunks(spark, sf_dir)), _questions(spark, sf_dir), 8)


@query(f"WITH {_CORPUS} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM vr WHERE rank <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).select(F.col("chunk_id").alias("id"), "model", "embedding")
    return R.ranked(R.cosine(_vectors(spark, sf_dir), rows), 10).select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


@query(f"WITH {_CORPUS} SELECT query_id, chunk_id, CAST(lexical_rank AS INTEGER) AS lexical_rank, CAST(vector_rank AS INTEGER) AS vector_rank, round(score, 7) AS score FROM fu")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fusion(_chunks(spark, sf_dir), _questions(spark, sf_dir), _vectors(spark, sf_dir))


_EPISODES = """
m AS (SELECT f.*, c.doc_id, c.kind, c.episode, c.channel FROM fu f JOIN c USING (chunk_id)),
g AS (SELECT query_id, episode, count(DISTINCT kind) > 1 AND count(DISTINCT doc_id) > 1 AS mixed FROM m WHERE episode IS NOT NULL GROUP BY ALL),
b AS (SELECT m.*, coalesce(mixed, false) AS mixed, row_number() OVER (PARTITION BY m.query_id, m.episode ORDER BY kind = 'youtube' DESC, round(score, 9) DESC, chunk_id) AS n FROM m LEFT JOIN g USING (query_id, episode)),
kept AS (SELECT * FROM b WHERE NOT mixed OR n = 1)"""


@query(f"WITH {_CORPUS}, {_EPISODES} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM kept) WHERE rank <= 8")
def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retrieve(_chunks(spark, sf_dir), _questions(spark, sf_dir), _vectors(spark, sf_dir)).select("query_id", "chunk_id", "rank")


@query(f"""WITH {_CORPUS}, m AS (SELECT f.*, c.doc_id FROM fu f JOIN c USING (chunk_id) WHERE kind IN ('youtube', 'podcast') AND contains(lower(channel), 'desk')),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 9) DESC, chunk_id) AS n FROM m)
SELECT query_id, doc_id, chunk_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM b WHERE n = 1) WHERE place <= 5""")
def find_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.moments(_chunks(spark, sf_dir), _questions(spark, sf_dir), _vectors(spark, sf_dir), limit=5, channel="Desk")


@query(f"""WITH {_CORPUS}, w AS (SELECT query_id, list_distinct({toks('text')}) AS want FROM q),
l AS (SELECT query_id, max(score) AS b, count(*) AS p FROM bm GROUP BY 1), o AS (SELECT query_id, max(score) AS held FROM ov GROUP BY 1), v AS (SELECT query_id, max(score) AS cos FROM vr GROUP BY 1), h AS (SELECT DISTINCT query_id, true AS hv FROM qv),
s AS (SELECT w.query_id, coalesce(b, 0) AS b, coalesce(p, 0) AS p, coalesce(cos, 0) AS cos, coalesce(hv, false) AS hv, len(want) > 0 AS ht, CASE WHEN len(want) > 0 THEN coalesce(held, 0) / len(want) ELSE 0 END AS r
  FROM w LEFT JOIN l USING (query_id) LEFT JOIN o USING (query_id) LEFT JOIN v USING (query_id) LEFT JOIN h USING (query_id))
SELECT query_id, p AS positives, CASE WHEN NOT (ht AND b > 0) AND NOT (hv AND cos >= 0.35) THEN CASE WHEN ht AND r >= 0.6 THEN 'weak' ELSE 'none' END WHEN b < 2 AND NOT (hv AND cos >= 0.35) THEN 'none' WHEN b < 5 AND cos < 0.5 THEN 'weak' WHEN p < 2 AND NOT (hv AND cos >= 0.5) THEN 'weak' ELSE 'covered' END AS coverage FROM s""")
def coverage_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.verdicts(_chunks(spark, sf_dir), _questions(spark, sf_dir), _vectors(spark, sf_dir)).select("query_id", "positives", "coverage")


@query(f"""WITH {_CORPUS}, tf AS (SELECT doc_id, term, sum(tf) AS tf FROM po JOIN c USING (chunk_id) GROUP BY ALL), df AS (SELECT term, count(*) AS docs FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS n FROM c),
s AS (SELECT doc_id, term, round((1 + ln(tf)) * idf, 6) AS score FROM tf JOIN df USING (term) JOIN di USING (term), n WHERE tf >= 3 AND length(term) >= 4 AND NOT regexp_full_match(term, '[0-9]+') AND idf > 0
  AND docs >= CASE WHEN n >= 50 THEN 3 ELSE 1 END AND docs <= greatest(CASE WHEN n >= 50 THEN 3 ELSE 1 END, floor(n * 0.25)))
SELECT doc_id, term, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS place FROM s) WHERE place <= 6""")
def distinctive_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinctive_terms(_chunks(spark, sf_dir))
