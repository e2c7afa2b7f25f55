"""Queries on feeds, lists, sitemaps, chaptered codes and reports; their inputs are written from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flags, titles
from ..functions import text as T
from ..operators import corpus as C
from ..operators import ledger as L
from ..session import table
from ..sources import feeds
from .q_review import FOLD
from .registry import query


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def _episodes(s: SparkSession, d: str) -> DataFrame:
    """Items of a feed: the audio file is the second enclosure of every third one, and missing in every fifth."""
    file = lambda kind, end: F.struct(F.concat(F.lit("u"), F.col("doc_id").cast("string"), F.lit(end)).alias("url"), F.lit(kind).alias("type"))
    sound, picture = file("audio/mpeg", ".mp3"), file("image/png", ".png")
    k = F.col("doc_id")
    held = F.when(k % 5 == 0, F.array(picture)).when(k % 3 == 0, F.array(picture, sound)).otherwise(F.array(sound, picture))
    return _docs(s, d).filter("kind = 'podcast'").select(
        F.col("id").alias("guid"), "title", (k % 50).cast("int").alias("number"), held.alias("enclosures"), F.concat((k % 90).cast("string"), F.lit(":30")).alias("duration"), F.col("published_at").alias("published")
    )


@query("""SELECT id AS guid, CAST(doc_id % 50 AS INTEGER) AS number, 'u' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.png' ELSE '.mp3' END AS audio, CAST(doc_id % 90 * 60 + 30 AS DOUBLE) AS seconds FROM documents WHERE kind = 'podcast' AND (contains(lower(title), 'boiler') OR doc_id % 50 = 7)""")
def feed_episodes(s: SparkSession, d: str) -> DataFrame:
    return feeds.episodes(_episodes(s, d), include=("Boiler", "7")).select("guid", "number", "audio", "seconds")


@query("""WITH e AS (SELECT id, title, doc_id % 50 AS n, doc_id FROM documents WHERE kind = 'podcast'), m AS (SELECT * FROM e WHERE doc_id % 9 = 0), o AS (SELECT * FROM e WHERE doc_id % 9 <> 0)
SELECT id AS guid FROM m UNION ALL SELECT id FROM o WHERE (title IS NULL OR lower(trim(title)) NOT IN (SELECT lower(trim(title)) FROM m WHERE trim(title) <> '')) AND (n IS NULL OR n NOT IN (SELECT n FROM m WHERE n IS NOT NULL))""")
def episodes_merged(s: SparkSession, d: str) -> DataFrame:
    """Episodes typed by hand (every ninth) and those of the feed that none of them is."""
    e = _docs(s, d).filter("kind = 'podcast'").select(F.col("id").alias("guid"), "title", (F.col("doc_id") % 50).alias("number"), "doc_id")
    return feeds.merged_episodes(e.filter("doc_id % 9 = 0"), e.filter("doc_id % 9 <> 0")).select("guid")


@query("""WITH v AS (SELECT doc_id, 'vid' || lpad(CAST(doc_id // 2 AS VARCHAR), 8, '0') AS v, doc_id % 200 AS seconds FROM documents WHERE kind = 'youtube')
SELECT v AS video_id, doc_id AS place FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY doc_id) AS n FROM v WHERE doc_id % 7 <> 0 AND (doc_id % 11 = 0 OR seconds > 60)) WHERE n = 1""")
def channel_listing(s: SparkSession, d: str) -> DataFrame:
    """Videos of a listing that has every second one twice, shorts by link and by length, and unknown lengths."""
    k = F.col("doc_id")
    vid = F.concat(F.lit("vid"), F.lpad(F.floor(k / 2).cast("string"), 8, "0"))
    url = F.when(k % 7 == 0, F.concat(F.lit("https://www.youtube.com/shorts/"), vid)).otherwise(F.concat(F.lit("https://www.youtube.com/watch?v="), vid))
    listing = _docs(s, d).filter("kind = 'youtube'").select(url.alias("url"), "title", F.when(k % 11 != 0, k % 200).alias("duration"), k.alias("place"))
    return feeds.channel_videos(listing).select("video_id", "place")


@query("""SELECT locator AS url, CASE WHEN doc_id % 2 = 0 THEN trim(regexp_replace(title, '[|#\\n\\r]', '', 'g')) END AS title FROM documents WHERE doc_id % 3 <> 0 AND NOT contains(locator, '#')""")
def listed_urls(s: SparkSession, d: str) -> DataFrame:
    """Lines of a list: every third is a comment, every second has a title behind a bar."""
    k, said = F.col("doc_id"), F.trim(F.regexp_replace("title", "[|#\n\r]", ""))
    line = F.when(k % 3 == 0, F.concat(F.lit("# "), "locator")).when(k % 2 == 0, F.concat("locator", F.lit(" | "), said, F.lit("  # seen"))).otherwise(F.concat(F.lit("  "), "locator"))
    return feeds.url_list(_docs(s, d).filter("not contains(locator, '#')").select(line.alias("value")))


@query("""SELECT 'file:town-municipal-code#' || doc_id AS locator, 'Town chapter ' || doc_id || ' ' || trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS title FROM documents WHERE length('CHAPTER ' || doc_id || chr(10) || trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) || chr(10) || 'Be it so.') >= 40 AND trim(coalesce(title, '')) <> ''""")
def code_chapters(s: SparkSession, d: str) -> DataFrame:
    """A chaptered code for each source, with a chapter for each document; chapters of hardly more than a heading are left out."""
    said = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " "))
    part = F.concat(F.lit("CHAPTER "), F.col("doc_id").cast("string"), F.lit("\n"), said, F.lit("\nBe it so.\n"))
    texts = _docs(s, d).filter("trim(coalesce(title, '')) <> ''").groupBy(F.coalesce("source", F.lit("")).alias("doc"), (F.col("doc_id") % 64).alias("volume")).agg(F.array_join(F.collect_list(part), "").alias("text"))
    return feeds.chapter_documents(texts.select("doc", "text"), "Town").select("locator", "title")


@query("""SELECT locator AS url FROM documents WHERE kind = 'website' AND source IS NOT NULL""")
def sitemap_walk(s: SparkSession, d: str) -> DataFrame:
    """An index of sitemaps, one for each source, which lists the source's pages."""
    pages = _docs(s, d).filter("kind = 'website' and source is not null")
    loc = lambda c: F.concat(F.lit("<loc>"), F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("</loc>"))
    maps = pages.groupBy("source", (F.col("doc_id") % 64).alias("part")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(loc(F.col("locator"))), ""), F.lit("</urlset>")).alias("xml"))
    maps = maps.select(F.concat("source", F.lit("/"), F.col("part").cast("string")).alias("page"), "xml")
    index = maps.agg(F.lit("top").alias("page"), F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(loc(F.col("page"))), ""), F.lit("</sitemapindex>")).alias("xml")).select("page", F.regexp_replace("xml", "<sitemapindex>", "<sitemapindex><sitemap>").alias("xml"))
    return feeds.sitemap_urls(index.union(maps), "top")


@query("""SELECT source AS host, 'https://' || source || '/map' || n || '.xml' AS sitemap FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), (SELECT unnest([1, 2]) AS n)""")
def robots_listed(s: SparkSession, d: str) -> DataFrame:
    line = lambda n: F.concat(F.lit("Sitemap: https://"), "source", F.lit(f"/map{n}.xml\n"))
    robots = _docs(s, d).filter("source is not null").select("source").distinct().select(F.col("source").alias("host"), F.concat(F.lit("User-agent: *\n"), line(1), F.lit("Disallow: /x\n  "), line(2)).alias("text"))
    return feeds.robots_sitemaps(robots)


@query("""WITH f AS (SELECT locator, CASE WHEN lang IS NULL THEN 'no language' ELSE 'short' END || ': ' || n_chars AS reason FROM documents WHERE (lang IS NULL OR n_chars < 400) AND NOT contains(locator, ' '))
SELECT locator, reason FROM f WHERE locator IN (SELECT locator FROM documents WHERE kind = 'website')""")
def report_read_back(s: SparkSession, d: str) -> DataFrame:
    """A report of failures is written, and the reasons of the website's addresses are read back from it."""
    docs = _docs(s, d)
    failed = docs.filter("(lang is null or n_chars < 400) and not contains(locator, ' ')")
    report = C.failure_report(failed.select("locator", F.concat(F.when(F.col("lang").isNull(), "no language").otherwise("short"), F.lit(": "), F.col("n_chars").cast("string")).alias("reason")))
    return C.reasons_from_report(report, docs.filter("kind = 'website'").select("locator"))


@query("""WITH t AS (SELECT doc_id, 'Episode ' || doc_id || ': with ' || array_to_string(speakers[2:], ' and ') AS t, speakers FROM documents WHERE kind <> 'website' AND len(speakers) > 1),
n AS (SELECT doc_id, list_filter(speakers[2:4], lambda x: regexp_full_match(x, '\\p{Lu}[\\p{L}''’.-]*(?: \\p{Lu}[\\p{L}''’.-]*){1,3}')) AS n FROM t)
SELECT doc_id, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), '|') AS guests FROM n""")
def guests_named(s: SparkSession, d: str) -> DataFrame:
    """Titles that name a recording's guests, and the guests read from them; the first speaker is the host."""
    rows = _docs(s, d).filter("kind <> 'website' and size(speakers) > 1")
    title = F.concat(F.lit("Episode "), F.col("doc_id").cast("string"), F.lit(": with "), F.array_join(F.slice("speakers", F.lit(2), F.size("speakers")), " and "))
    return rows.select("doc_id", F.array_join(titles.guests(title, F.slice("speakers", 1, 1)), "|").alias("guests"))


TOPICS = {"money": ("rent", "deposit", "paid"), "repairs": ("boiler", "leak", "roof"), "selling": ("listing", "buyer", "closing"), "tired": ("finally gave out", "phone calls", "nobody picks up")}


@query("SELECT id, " + ", ".join(f"coalesce(regexp_matches({FOLD.format(c='what')}, '{'|'.join(v)}'), false) AS {k}" for k, v in TOPICS.items()) + " FROM (SELECT DISTINCT * FROM log_entries)")
def entry_topics(s: SparkSession, d: str) -> DataFrame:
    """Topics of entries by lists of phrases, one flag a list."""
    e = L.entries(table(s, d, "log_entries"))
    return e.select("id", *(F.coalesce(flags.any_phrase(F.col("what"), v), F.lit(False)).alias(k) for k, v in TOPICS.items()))


@query("""SELECT doc_id, CASE WHEN d.length > 0 THEN d.head END AS head FROM (SELECT doc_id, {'length': length(coalesce(title, '')), 'head': CASE WHEN length(trim(regexp_replace(title, '\\s+', ' ', 'g'))) > 40 THEN left(trim(regexp_replace(title, '\\s+', ' ', 'g')), 39) || '…' ELSE trim(regexp_replace(title, '\\s+', ' ', 'g')) END} AS d FROM (SELECT doc_id, replace(replace(replace(replace(title, '&', '+'), '<', '('), '>', ')'), '"', '') AS title FROM documents))""")
def attributes_escaped(s: SparkSession, d: str) -> DataFrame:
    bare = F.replace(F.replace(F.replace(F.replace("title", F.lit("&"), F.lit("+")), F.lit("<"), F.lit("(")), F.lit(">"), F.lit(")")), F.lit('"'), F.lit(""))
    return _docs(s, d).select("doc_id", F.when(F.length(bare) > 0, T.escape_attr(bare, 40)).alias("head"))
