"""The catalogue of recordings and of moments in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as win

from ..functions import dates, titles
from ..functions import text as T


def catalogue(docs: DataFrame, *, guest: str | None = None, kinds: tuple[str, ...] = ("youtube", "podcast"), limit: int | None = None) -> DataFrame:
    """(doc_id, title, guests, episode, published_at, place) of recordings, by episode number, date and title, all descending.

    guest: part of a guest's name or of the title.
    """
    out = docs.filter(F.col("kind").isin(*kinds)).withColumn("guests", titles.guests(F.col("title"), F.col("speakers")))
    if guest:
        out = out.filter(F.lower(F.array_join("guests", ", ")).contains(guest.lower()) | F.lower("title").contains(guest.lower()))
    number = F.coalesce(F.col("episode").try_cast("int"), F.lit(-1))
    keys = [number.desc(), F.col("published_at").desc_nulls_last(), F.col("title").desc_nulls_last(), F.col("doc_id").desc()]
    if limit:
        out = out.orderBy(*keys).limit(limit)
    # places by kind: no single order over all recordings
    place = F.row_number().over(win.Window.partitionBy("kind").orderBy(*keys))
    return out.select("doc_id", "kind", "title", "guests", "episode", "published_at", place.alias("place"))


def moments(found: DataFrame, topics: DataFrame, *, most_topics: int = 6) -> DataFrame:
    """(query_id, chunk_id, link, at, topics, quote) of found passages (query_id, chunk_id, doc_id, link, title, start_time, text) and topics (doc_id, term, place).

    Topics that the title names already, or that share a stem, are left out.
    """
    by = topics.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("terms"))
    said = T.tokens(F.col("title"))
    fresh = F.slice(titles.distinct_stems(F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: ~F.array_contains(said, t))), 1, most_topics)
    out = found.join(by, "doc_id", "left")
    return out.select("query_id", "chunk_id", T.deep_link(F.col("link"), F.col("start_time")).alias("link"), dates.clock(F.col("start_time")).alias("at"), fresh.alias("topics"), T.quote(F.col("text")).alias("quote"))
