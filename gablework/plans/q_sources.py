"""Queries on sources and packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as win

from ..operators import packs as P
from ..session import table
from ..functions import urls as U
from ..sources import feeds, html, transcripts
from .q_corpus import SEG, WORDS
from .registry import query


@query(f"""WITH {SEG}, t AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), '\\n\\s*\\n') AS p FROM documents WHERE kind <> 'website' AND coalesce(length(segments_json), 0) <= 2 AND trim(coalesce(text, '')) <> ''),
x AS (SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(list_transform(p, lambda y: trim(regexp_replace(y, '\\s+', ' ', 'g')))) AS text FROM t)
SELECT doc_id, CAST(no AS INTEGER) AS no, start, "end", text FROM seg UNION ALL SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER), 0.0, 0.0, text FROM x WHERE text <> ''""")
def parsed_segments(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").filter("kind <> 'website'").select("doc_id", F.when(F.length("segments_json") > 2, "json").otherwise("txt").alias("suffix"), F.when(F.length("segments_json") > 2, F.col("segments_json")).otherwise(F.col("text")).alias("text"))
    return transcripts.parse(docs).select("doc_id", F.posexplode("segments").alias("no", "x")).select("doc_id", "no", "x.*")


@query("""WITH x AS (SELECT DISTINCT locator AS url FROM documents WHERE kind = 'website') SELECT url FROM x WHERE contains(url, '/blog/') AND url NOT IN (SELECT locator FROM documents WHERE doc_id % 4 = 0)""")
def sitemap_diff(s: SparkSession, d: str) -> DataFrame:
    """All addresses of posts against a made-up store that has a fourth of the documents."""
    docs = table(s, d, "documents")
    listed = docs.filter("kind = 'website'").select(F.col("locator").alias("url"))
    return feeds.sitemap_gaps(listed, docs.filter("doc_id % 4 = 0"), "/blog/")


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Pages of HTML made of documents: their lines as paragraphs, and links to the next documents of their site."""
    docs = table(s, d, "documents").filter("kind = 'website'").select("doc_id", F.col("locator").alias("url"), "title", "text", "source")
    w = win.Window.partitionBy("source").orderBy("doc_id")
    linked = docs.withColumn("a", F.lead("url", 1).over(w)).withColumn("b", F.lead("url", 3).over(w))
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<p>"), esc(x), F.lit("</p>"))), "")
    link = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("<a href='"), F.col(c), F.lit("#top'>next</a>"))).otherwise("")
    return linked.select("url", F.concat(F.lit("<html><head><title>"), esc(F.col("title")), F.lit("</title></head><body><nav><p>Menu</p>"), link("a"), link("b"), F.lit("</nav>"), body, F.lit("</body></html>")).alias("html"))


@query("""WITH l AS (SELECT locator, title, generate_subscripts(a, 1) AS k, unnest(a) AS x FROM (SELECT locator, title, string_split(text, chr(10)) AS a FROM documents WHERE kind = 'website')),
b AS (SELECT locator, k, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS x FROM l),
u AS (SELECT locator, x, min(k) AS k FROM b WHERE x <> '' GROUP BY ALL), t AS (SELECT locator, string_agg(x, chr(10) || chr(10) ORDER BY k) AS text FROM u GROUP BY locator)
SELECT d.locator AS url, CASE WHEN trim(coalesce(d.title, '')) = '' THEN d.locator ELSE trim(regexp_replace(d.title, '\\s+', ' ', 'g')) END AS title, coalesce(t.text, '') AS text FROM documents d LEFT JOIN t USING (locator) WHERE kind = 'website'""")
def html_main_text(s: SparkSession, d: str) -> DataFrame:
    return html.extract(_pages(s, d)).select("url", "title", "text")


@query("""WITH l AS (SELECT locator AS url, lead(locator, 1) OVER w AS a, lead(locator, 3) OVER w AS b FROM documents WHERE kind = 'website' WINDOW w AS (PARTITION BY source ORDER BY doc_id)) SELECT url, regexp_replace(a, '\\?utm_.*$', '') AS link FROM l WHERE a IS NOT NULL UNION SELECT url, regexp_replace(b, '\\?utm_.*$', '') FROM l WHERE b IS NOT NULL""")
def page_links(s: SparkSession, d: str) -> DataFrame:
    return html.discovered(html.extract(_pages(s, d)))


@query("""WITH RECURSIVE p AS (SELECT source, regexp_replace(locator, '\\?utm_.*$', '') AS url, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE kind = 'website'),
l AS (SELECT DISTINCT a.url, b.url AS link FROM p a JOIN p b ON a.source IS NOT DISTINCT FROM b.source AND b.n // 2 = a.n),
r AS (SELECT url, 0 AS hops FROM p WHERE n = 1 UNION SELECT l.link, r.hops + 1 FROM r JOIN l ON l.url = r.url WHERE r.hops < 40)
SELECT url, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY url""")
def crawl_hops(s: SparkSession, d: str) -> DataFrame:
    """From the first page of every site at once, until no page is new; page n of a site links to its pages 2n and 2n + 1."""
    w = win.Window.partitionBy("source").orderBy("doc_id")
    at = table(s, d, "documents").filter("kind = 'website'").select("source", U.canonical(F.col("locator")).alias("url"), F.row_number().over(w).alias("n"))
    child = at.select("source", F.col("url").alias("link"), F.floor(F.col("n") / 2).cast("int").alias("n"))
    made = at.join(child, ["source", "n"], "left").groupBy("url").agg(F.concat_ws("", F.transform(F.collect_set("link"), lambda x: F.concat(F.lit("<a href='"), x, F.lit("'>x</a>")))).alias("html"))
    links = html.discovered(html.extract(made))
    return html.crawl_order(links, at.filter("n = 1").select("url"))


@query(f"""SELECT CASE WHEN kind <> 'website' THEN 'recordings' WHEN contains(locator, '/blog/') THEN 'posts' ELSE 'pages' END AS section, count(*) AS documents, CAST(sum({WORDS}) AS BIGINT) AS words FROM documents GROUP BY 1""")
def pack_coverage(s: SparkSession, d: str) -> DataFrame:
    return P.coverage(table(s, d, "documents"))


@query("""WITH RECURSIVE x AS (SELECT doc_id, CASE WHEN kind <> 'website' THEN 'recordings' WHEN contains(locator, '/blog/') THEN 'posts' ELSE 'pages' END AS section, CASE WHEN kind <> 'website' THEN coalesce(TRY_CAST(episode AS INTEGER), -1) END AS number, published_at, lower(title) AS name,
length(concat_ws(chr(10), '### ' || coalesce(nullif(trim(title), ''), 'Untitled'), nullif(trim(link), ''), nullif(trim(published_at), ''), '', trim(text))) + 2 AS chars FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY number NULLS FIRST, CASE WHEN section = 'posts' THEN published_at END DESC NULLS LAST, name NULLS FIRST, doc_id) AS n FROM x),
r AS (SELECT section, doc_id, chars, n, 0 AS part, chars AS size FROM o WHERE n = 1
  UNION ALL SELECT o.section, o.doc_id, o.chars, o.n, CASE WHEN r.size + o.chars > 400000 THEN r.part + 1 ELSE r.part END, CASE WHEN r.size + o.chars > 400000 THEN o.chars ELSE r.size + o.chars END FROM r JOIN o ON o.section = r.section AND o.n = r.n + 1)
SELECT section, doc_id, chars, CAST(part AS BIGINT) AS part FROM r""")
def pack_parts(s: SparkSession, d: str) -> DataFrame:
    return P.packed(P.rendered(table(s, d, "documents")), 400_000)


@query("""WITH d AS (SELECT doc_id, kind, title, row_number() OVER (PARTITION BY kind ORDER BY coalesce(TRY_CAST(episode AS INTEGER), -1) DESC, published_at DESC NULLS LAST, title DESC NULLS LAST, doc_id DESC) AS place FROM documents WHERE kind IN ('youtube', 'podcast') AND contains(lower(title), 'boiler'))
SELECT doc_id, kind, CAST(place AS INTEGER) AS place FROM d""")
def episode_catalogue(s: SparkSession, d: str) -> DataFrame:
    from ..operators import episodes as E

    return E.catalogue(table(s, d, "documents"), guest="boiler").select("doc_id", "kind", "place")


@query()
def episode_moments(s: SparkSession, d: str) -> DataFrame:
    from ..operators import episodes as E
    from ..operators import retrieval as R

    docs = table(s, d, "documents").filter("kind <> 'website'").select("doc_id", "title", "link")
    chunks = table(s, d, "chunks").select(F.col("id").alias("chunk_id"), "doc_id", "text", "start_time")
    found = chunks.join(docs, "doc_id").withColumn("query_id", F.lit("all"))
    return E.moments(found, R.distinctive_terms(chunks.select("chunk_id", "doc_id", "text"), limit=10))


@query("SELECT source, kind AS method, count(*) AS n, round(sum(coalesce(TRY_CAST(episode AS DOUBLE) / 60, 60)), 4) AS minutes FROM documents GROUP BY ALL")
def ingest_plan(s: SparkSession, d: str) -> DataFrame:
    from ..operators import corpus as C

    items = table(s, d, "documents").select("source", F.col("kind").alias("method"), F.col("episode").try_cast("double").alias("seconds"))
    return C.ingest_plan(items).withColumn("minutes", F.round("minutes", 4))


@query("""WITH h AS (SELECT DISTINCT source FROM documents WHERE kind = 'website'), x AS (SELECT doc_id, regexp_extract(locator, '^https?://(?:www\\.)?([^/?#:]*)', 1) AS host FROM documents UNION SELECT doc_id, regexp_extract(link, '^https?://(?:www\\.)?([^/?#:]*)', 1) FROM documents WHERE link IS NOT NULL)
SELECT regexp_replace(source, '^www\\.', '') AS host, count(x.doc_id) AS documents FROM h LEFT JOIN x ON x.host = regexp_replace(source, '^www\\.', '') GROUP BY 1""")
def source_findings(s: SparkSession, d: str) -> DataFrame:
    from ..operators import corpus as C

    docs = table(s, d, "documents")
    return C.source_findings(docs.filter("kind = 'website'").select(F.concat(F.lit("https://"), "source", F.lit("/")).alias("url")), docs)
