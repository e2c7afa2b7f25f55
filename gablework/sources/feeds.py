"""Feeds, url lists, sitemaps and chaptered codes as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as win

from ..functions import dates
from ..functions import text as T
from ..functions import urls as U


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files, by the built-in XML reader."""
    return spark.read.format("xml").option("rowTag", "item").load(path)


def episodes(items: DataFrame, *, include: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """(guid, title, number, audio, seconds, published_at) of items (guid, title, number, enclosures, duration, published, at).

    include: parts of titles, or episode numbers. Of the enclosures the first audio one counts, else the first. The cut comes last.
    """
    audio = F.coalesce(F.try_element_at(F.filter("enclosures", lambda e: e["type"].startswith("audio/")), F.lit(1)), F.try_element_at("enclosures", F.lit(1)))["url"]
    out = items.select("guid", "title", "number", audio.alias("audio"), dates.duration_seconds(F.col("duration")).alias("seconds"), F.col("published").alias("published_at"))
    if include:
        hit = F.lit(False)
        for x in include:
            hit = hit | (F.col("number").cast("string") == x if x.isdigit() else F.lower("title").contains(x.lower()))
        out = out.filter(hit)
    out = out.orderBy(F.col("published_at").desc_nulls_last(), "guid")
    return out.limit(most) if most else out


def merged_episodes(manual: DataFrame, feed: DataFrame) -> DataFrame:
    """manual episodes, and those of the feed whose number and title none of them has. Both: (number, title, ...)."""
    named = manual.select(F.lower(F.trim("title")).alias("_t")).filter("_t <> ''").distinct()
    counted = manual.select(F.col("number").alias("_n")).filter("_n is not null").distinct()
    rest = feed.withColumn("_t", F.lower(F.trim("title"))).join(named, "_t", "left_anti").withColumn("_n", F.col("number"))
    return manual.unionByName(rest.join(counted, "_n", "left_anti").drop("_t", "_n"))


def url_list(lines: DataFrame) -> DataFrame:
    """(url, title) of lines `url` or `url | title`; # starts a comment."""
    bare = F.trim(F.regexp_replace("value", r"(^|\s)#.*$", ""))
    parts = F.split(bare, r"\s*\|\s*", 2)
    return lines.filter(bare != "").select(parts[0].alias("url"), F.try_element_at(parts, F.lit(2)).alias("title"))


def channel_videos(listing: DataFrame, *, most: int | None = None, short_seconds: int = 60) -> DataFrame:
    """(video_id, title) of a channel's listing (url, title, duration, place): valid ids, first seen, no shorts, and only then the cut.

    A video is short by its link or a known duration; an unknown duration doesn't make it one.
    """
    rows = listing.withColumn("video_id", U.video_id(F.col("url"))).filter("video_id is not null")
    rows = rows.filter(~F.col("url").contains("/shorts/") & ~F.coalesce(F.col("duration") <= short_seconds, F.lit(False)))
    first = rows.withColumn("_n", F.row_number().over(win.Window.partitionBy("video_id").orderBy("place"))).filter("_n = 1").drop("_n").orderBy("place")
    return (first.limit(most) if most else first).select("video_id", "title", "place")


def merged_videos(sources: Sequence[DataFrame], skip: DataFrame) -> DataFrame:
    """(url, title, video_id): lists of videos, earlier lists first, one row an id, without those to skip; unreadable links stay."""
    out = None
    for i, s in enumerate(sources):
        part = s.select("url", "title").withColumn("_list", F.lit(i)).withColumn("_seq", F.monotonically_increasing_id())
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("video_id", U.video_id(F.col("url")))
    first = win.Window.partitionBy(F.coalesce("video_id", "url")).orderBy("_list", "_seq")
    out = out.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return out.join(skip.select("video_id").distinct(), "video_id", "left_anti").select("url", "title", "video_id")


def chapters(texts: DataFrame) -> DataFrame:
    """(doc, number, title, body): parts of texts (doc, text) at lines CHAPTER <number>; the title is the next line that isn't blank."""
    marked = F.split(F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), r"(?m)^(?=[ \t]*CHAPTER[ \t]+[\w.-]+[ \t]*$)", "\u0001"), "\u0001")
    parts = F.filter(marked, lambda p: p.rlike(r"^[ \t]*CHAPTER[ \t]+[\w.-]+[ \t]*(\n|$)"))
    rows = texts.select("doc", F.explode(parts).alias("p"))
    return rows.select("doc", F.regexp_extract("p", r"^[ \t]*CHAPTER[ \t]+([\w.-]+)", 1).alias("number"), F.trim(F.regexp_extract("p", r"^[^\n]*\n\s*([^\n]*)", 1)).alias("title"), F.trim("p").alias("body"))


def chapter_documents(texts: DataFrame, jurisdiction: str, least: int = 40) -> DataFrame:
    """One document for each chapter that holds more than a heading."""
    slug = "-".join(jurisdiction.lower().split())
    rows = chapters(texts).filter(F.length("body") >= least)
    return rows.select(F.concat(F.lit(f"file:{slug}-municipal-code#"), "number").alias("locator"), F.concat_ws(" ", F.lit(jurisdiction), F.lit("chapter"), "number", "title").alias("title"), F.col("body").alias("text"))


def sitemap_links(pages: DataFrame) -> DataFrame:
    """(page, loc, is_index): what sitemaps (page, xml) list."""
    locs = F.transform(F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return pages.select("page", F.explode(locs).alias("loc"), F.lower("xml").contains("<sitemap").alias("is_index"))


def sitemap_urls(pages: DataFrame, start: str, depth: int = 5) -> DataFrame:
    """(url): pages reachable from a sitemap through index files, at most so deep; each file once."""
    links = sitemap_links(pages)
    seen = links.sparkSession.createDataFrame([(start,)], "page string")
    level, found = seen, None
    for _ in range(depth):
        here = links.join(level, "page")
        urls = here.filter("not is_index").select(F.col("loc").alias("url"))
        found = urls if found is None else found.union(urls)
        level = here.filter("is_index").select(F.col("loc").alias("page")).distinct().join(seen, "page", "left_anti")
        seen = seen.union(level)
    return found.distinct()


def sitemap_gaps(listed: DataFrame, stored: DataFrame, section: str = "") -> DataFrame:
    """(url): canonical listed pages of a section that aren't stored. listed: (url); stored: (locator)."""
    want = listed.select(U.canonical(F.col("url")).alias("url")).filter(F.col("url").isNotNull() & F.contains("url", F.lit(section))).distinct()
    return want.join(stored.select(U.canonical(F.col("locator")).alias("url")).distinct(), "url", "left_anti")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(host, sitemap) of robots files (host, text)."""
    return robots.select("host", F.explode(F.transform(F.regexp_extract_all("text", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1)), lambda u: u)).alias("sitemap"))


def transcript_for(episodes_: DataFrame, files: DataFrame) -> DataFrame:
    """(guid, path): the file that belongs to an episode (guid, number, title): its number in the name, else four fifths of the title's longer words.

    Files (path) are met through numbers and words of their names, not one by one; of several the first by name counts.
    """
    stem = F.lower(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))
    f = files.select("path", stem.alias("stem"))
    by_no = episodes_.filter("number is not null").select("guid", F.col("number").cast("string").alias("w")).join(f.select("path", F.explode(F.array_distinct(F.regexp_extract_all("stem", F.lit(r"\d+"), F.lit(0)))).alias("w")), "w").select("guid", "path", F.lit(0).alias("rank"))
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.length(x) > 2))
    e = episodes_.select("guid", words.alias("ws")).filter("size(ws) >= 2")
    met = e.select("guid", F.size("ws").alias("n"), F.explode("ws").alias("w")).join(f.select("path", F.explode(F.array_distinct(F.regexp_extract_all("stem", F.lit("[a-z0-9]+"), F.lit(0)))).alias("w")), "w")
    by_title = met.groupBy("guid", "path", "n").agg(F.count("*").alias("hit")).filter(F.col("hit") >= F.col("n") * 0.8).select("guid", "path", F.lit(1).alias("rank"))
    return by_no.union(by_title).groupBy("guid").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def slug_locator(number, title):  # noqa: ANN001, ANN201
    """The locator of an episode without a link: its number, else its title as a slug."""
    return F.concat(F.lit("episode:"), F.coalesce(number.cast("string"), T.slug(title)))
