"""Problem 4: lines repeated across the documents of one source.

Copies of a document within a source are collapsed into a cluster first. A line is then counted once a cluster, weighted by the
cluster's documents for the share of the source, and over distinct clusters and publication dates. A case is told by the share of documents; the cleaning
takes a line out only if it also stands in several distinct texts of several dates, so neither copies nor an article republished on one day with
changes look like boilerplate. A cluster has the first of its dates; one without any counts as a date of its own. Two lines are the same if their
letters agree, ignoring case.

Null or blank text holds no line of letters but counts as a document of its source; documents without a source are no case.
Only hashes of lines are shuffled (96 bits each), never their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, join_sized

SHARE_PERCENT, LEAST_DOCUMENTS = 20, 3


def line_key(line: Column) -> Column:
    """The letters of a line in lower case; empty if it has none."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def _keys(docs: DataFrame, *more: str) -> DataFrame:
    """docs with lines: an array of (no, k1, k2) of the lines that hold letters."""
    parts = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    keyed = F.transform(parts, lambda x, i: F.struct(i.alias("no"), line_key(x).alias("k")))
    kept = F.filter(keyed, lambda x: x["k"] != "")
    hashed = F.transform(kept, lambda x: F.struct(x["no"].cast("int").alias("no"), F.xxhash64(x["k"]).alias("k1"), F.hash(x["k"]).alias("k2")))
    return docs.select("doc_id", "source", *more, hashed.alias("lines"))


def clusters_of(docs: DataFrame) -> DataFrame:
    """(source, c1, c2, copies, date, keys) of the distinct texts of each source: their documents, first date and lines."""
    keyed = _keys(docs.filter("source is not null"), "published_at")
    distinct = F.array_distinct(F.transform("lines", lambda x: F.struct(x["k1"].alias("k1"), x["k2"].alias("k2"))))
    # the order of lines matters for a copy, blank lines and their numbers do not
    whole = F.transform("lines", lambda x: F.struct(x["k1"], x["k2"]))
    # a cluster's keys travel once, 12 bytes a line; counts by line are then combined on the map side, also those of a hot source
    return (
        keyed.filter(F.size("lines") > 0)
        .select("source", F.xxhash64(whole).alias("c1"), F.hash(whole).alias("c2"), F.expr("nullif(trim(published_at), '')").alias("date"), distinct.alias("keys"))
        .groupBy("source", "c1", "c2")
        .agg(F.count("*").alias("copies"), F.min("date").alias("date"), F.first("keys").alias("keys"))
    )


def repeated_lines(docs: DataFrame, clusters: DataFrame, *, share_percent: int = SHARE_PERCENT, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(source, k1, k2, n_docs, n_clusters, n_source) of lines in at least share_percent % of a source's documents.

    n_docs: documents that hold the line; n_clusters: distinct texts among them.
    """
    sizes = docs.filter("source is not null").groupBy("source").agg(F.count("*").alias("n_source"))
    counted = (
        clusters.select("source", "copies", F.explode("keys").alias("key"))
        .groupBy("source", F.col("key.k1").alias("k1"), F.col("key.k2").alias("k2"))
        .agg(F.sum("copies").alias("n_docs"), F.count("*").alias("n_clusters"))
    )
    counted = counted.filter(F.col("n_docs") >= least)
    return join_sized(counted, cut(sizes), ["source"], salt=F.col("k2")).filter(F.col("n_docs") * 100 >= F.col("n_source") * share_percent)


def dated_lines(docs: DataFrame, *, share_percent: int = SHARE_PERCENT, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """repeated_lines with n_dates: the distinct publication dates of the texts that hold the line."""
    clusters = cut(clusters_of(docs))
    often = cut(repeated_lines(docs, clusters, share_percent=share_percent, least=least))
    lines = clusters.select("source", F.coalesce("date", F.concat_ws(":", "c1", "c2")).alias("date"), F.explode("keys").alias("key")).select("source", "date", "key.k1", "key.k2")
    # only the few repeated lines go on to be counted by date, and equal dates collapse on the map side
    dates = join_sized(lines, often.select("source", "k1", "k2"), ["source", "k1", "k2"], "left_semi", salt=F.hash("date")).distinct()
    return often.join(dates.groupBy("source", "k1", "k2").agg(F.count("*").alias("n_dates")), ["source", "k1", "k2"])


def find_repeated_lines(docs: DataFrame, *, share_percent: int = SHARE_PERCENT, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc_id, line_no, n_docs, n_clusters) of each occurrence of a repeated line; line numbers count from 0."""
    often = cut(repeated_lines(docs, clusters_of(docs), share_percent=share_percent, least=least).select("source", "k1", "k2", "n_docs", "n_clusters"))
    lines = _keys(docs.filter("source is not null")).select("doc_id", "source", F.explode("lines").alias("x")).select("doc_id", "source", "x.*")
    return join_sized(lines, often, ["source", "k1", "k2"], salt=F.col("doc_id")).select("doc_id", F.col("no").alias("line_no"), "n_docs", "n_clusters")


def strip_repeated_lines(docs: DataFrame, *, share_percent: int = SHARE_PERCENT, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """docs with a column clean_text: text without its repeated lines.

    A line goes only if it is repeated over at least `least` distinct texts and `least` publication dates, so that the copies of one article stay whole.
    """
    gone = dated_lines(docs, share_percent=share_percent, least=least).filter((F.col("n_clusters") >= least) & (F.col("n_dates") >= least))
    # a source has few such lines (each is in a fifth of its documents), and they come to the texts: no text is shuffled while sources are few
    lists = cut(gone.groupBy("source").agg(F.collect_list(F.struct("k1", "k2")).alias("_gone")))
    joined = join_sized(docs, lists, ["source"], "left", salt=F.xxhash64("doc_id"))
    key = lambda x: F.struct(F.xxhash64(line_key(x)).alias("k1"), F.hash(line_key(x)).alias("k2"))
    kept = F.filter(F.split("text", "\n"), lambda x: ~((line_key(x) != "") & F.array_contains("_gone", key(x))))
    return joined.withColumn("clean_text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("_gone")
