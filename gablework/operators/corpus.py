"""Documents, passages and their upkeep: identity, duplicates, merges, orphans, windows, boilerplate, quality findings.

A stored document is (id, kind, locator, title, text, content_hash, ...); passages refer to it by doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as win

from ..functions import text as T
from ..session import cut, join_sized


def identified(docs: DataFrame) -> DataFrame:
    """docs with the id that kind and locator give and the hash of the text."""
    return docs.withColumn("id", T.document_id(F.col("kind"), F.col("locator"))).withColumn("content_hash", T.content_hash(F.col("text")))


def ingest_outcomes(arriving: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """arriving (id, content_hash, seq) with outcome and twin: what storing the rows in order of seq would do.

    skipped: stored with the same hash; duplicate: the hash is stored, or arrives earlier, under another id (twin: the least such id);
    updated: stored with another hash; added otherwise. Of one id arriving twice the first counts, the rest is skipped.
    """
    arriving = arriving.withColumn("_nth", F.row_number().over(win.Window.partitionBy("id").orderBy("seq")))
    by_id = stored.select("id", F.col("content_hash").alias("_old"))
    by_hash = stored.groupBy("content_hash").agg(F.min("id").alias("_twin"), F.max("id").alias("_other"))
    # the first of each hash is found by aggregation, and only hashes that come twice are joined: a hot hash is no one's task
    firsts = arriving.groupBy("content_hash").agg(F.min(F.struct("seq", "id")).alias("_f"), F.count("*").alias("_c")).filter("_c > 1").select("content_hash", F.col("_f.id").alias("_first"))
    out = join_sized(join_sized(arriving.join(by_id, "id", "left"), cut(by_hash), ["content_hash"], "left", salt=F.xxhash64("id")), cut(firsts), ["content_hash"], "left", salt=F.xxhash64("id"))
    twin = F.when(F.col("_twin") != F.col("id"), F.col("_twin")).when(F.col("_other") != F.col("id"), F.col("_other")).when(F.col("_first") != F.col("id"), F.col("_first"))
    same = F.col("_old").eqNullSafe(F.col("content_hash"))
    outcome = (
        F.when(F.col("_nth") > 1, "skipped").when(same & F.lit(not force), "skipped").when(twin.isNotNull(), "duplicate").when(F.col("_old").isNotNull(), "updated").otherwise("added")
    )
    return out.withColumn("outcome", outcome).withColumn("twin", F.when(F.col("outcome") == "duplicate", twin)).drop("_old", "_twin", "_other", "_first", "_nth")


def upsert(stored: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """stored with all rows of the keys in fresh replaced by fresh."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def remove(stored: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti")


def set_embeddings(chunks: DataFrame, fresh: DataFrame, model: str) -> DataFrame:
    """chunks with the vectors of fresh (id, embedding) and their model; unknown ids are ignored."""
    new = fresh.groupBy("id").agg(F.max("embedding").alias("_v"))  # one and the same of several
    out = chunks.join(new, "id", "left")
    return out.withColumn("embedding_model", F.when(F.col("_v").isNotNull(), model).otherwise(F.col("embedding_model"))).withColumn("embedding", F.coalesce("_v", "embedding")).drop("_v").select(*chunks.columns)


def missing_embeddings(chunks: DataFrame, model: str) -> DataFrame:
    """Passages without a vector of this model."""
    return chunks.filter(F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(F.lit(model)))


def usable_embeddings(chunks: DataFrame, model: str) -> DataFrame:
    """Vectors of one model that have the length of its first one (by document and number)."""
    mine = chunks.filter((F.col("embedding_model") == model) & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    dim = mine.agg(F.min_by(F.size("embedding"), F.struct("doc_id", "idx")).alias("_dim"))
    return mine.crossJoin(F.broadcast(dim)).filter(F.size("embedding") == F.col("_dim")).drop("_dim")  # one row


def orphans(stored: DataFrame, seen: DataFrame, scope: Column | None = None) -> DataFrame:
    """Stored documents of the kinds just gone through that weren't met again, within a scope."""
    kinds = seen.select("kind").distinct()
    out = stored.join(F.broadcast(kinds), "kind", "left_semi").join(seen.select("id").distinct(), "id", "left_anti")  # a kind is one of a few
    return out.filter(scope) if scope is not None else out


def without_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    return docs.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")


def twins(docs: DataFrame) -> DataFrame:
    """(id, twin): of documents that share a text, all but the least locator with the id of that one."""
    firsts = docs.groupBy("content_hash").agg(F.min(F.struct("locator", "id")).alias("f"), F.count("*").alias("c")).filter("c > 1").select("content_hash", F.col("f.id").alias("twin"))
    out = join_sized(docs.select("id", "content_hash"), cut(firsts), ["content_hash"], salt=F.xxhash64("id"))
    return out.filter("id <> twin").select("id", "twin")


def hopping_windows(segments: DataFrame, *, width: float, overlap: float = 15.0) -> DataFrame:
    """(doc_id, window_no, start, end, text, first_no, last_no): overlapping windows of timed segments (doc_id, no, start, end, text).

    Windows of a document begin at its first segment and move by width less the overlap (at most half the width). A segment is in
    the windows its start falls into, told by arithmetic. A window of the same first and last segment as an earlier one is dropped,
    and so is one without text. A document may be of any length: a segment is in at most width / step windows.
    """
    step = max(width - min(overlap, width / 2), 1e-3)
    doc = win.Window.partitionBy("doc_id")
    hi, lo = F.floor(F.col("_at") / step), F.floor((F.col("_at") - width) / step) + 1
    inside = segments.withColumn("_at", F.col("start") - F.min("start").over(doc)).withColumn("window_no", F.explode(F.sequence(F.greatest(lo, F.lit(0)), F.greatest(hi, F.lit(0)))))
    inside = inside.filter((F.col("_at") >= F.col("window_no") * step) & (F.col("_at") < F.col("window_no") * step + width))
    texts = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("no", T.segment_text(F.col("text")).alias("t")))), lambda s: s["t"]), lambda t: t != ""), " ")
    out = inside.groupBy("doc_id", "window_no").agg(F.min("start").alias("start"), F.greatest(F.max("end"), F.min("start")).alias("end"), texts.alias("text"), F.min("no").alias("first_no"), F.max("no").alias("last_no"))
    first = win.Window.partitionBy("doc_id", "first_no", "last_no").orderBy("window_no")
    return out.withColumn("_n", F.row_number().over(first)).filter("_n = 1 and text <> ''").drop("_n")


def merged_segments(segments: DataFrame, seconds: float) -> DataFrame:
    """(doc_id, group_no, start, end, text): consecutive segments merged while they end within `seconds` of the group's start.

    The fold runs over each document's segments as an array, inside the JVM. Documents without times keep their segments.
    """
    rows = F.array_sort(F.collect_list(F.struct("no", "start", "end", "text")))
    init = F.array().cast("array<struct<no:bigint,start:double,end:double,text:string>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fresh = F.struct(s["no"].cast("bigint").alias("no"), s["start"].cast("double").alias("start"), s["end"].cast("double").alias("end"), s["text"].alias("text"))
        joined = F.struct(last["no"].alias("no"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).cast("double").alias("end"), F.concat_ws(" ", last["text"], s["text"]).alias("text"))
        apart = (F.size(acc) == 0) | (s["end"] - last["start"] >= seconds) | ((s["start"] == 0) & (s["end"] == 0))
        return F.when(apart, F.concat(acc, F.array(fresh))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined)))

    folded = segments.groupBy("doc_id").agg(F.aggregate(rows, init, step).alias("g"))
    return folded.select("doc_id", F.posexplode("g").alias("group_no", "s")).select("doc_id", "group_no", "s.start", "s.end", "s.text")


def next_batches(items: DataFrame, *, most_items: int, most_tokens: int) -> DataFrame:
    """items (group, no, tokens) with batch: greedy runs under both caps, at least one item each, in order of no.

    Batches of a group depend on all before; a group is streamed through one task in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch, n, total = None, 0, 0, 0
        for b in batches:
            out = []
            for g, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if g != now:
                    now, batch, n, total = g, 0, 0, 0
                if n and (n + 1 > most_items or total + t > most_tokens):
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + t
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(out, pa.int32())], names=["group", "no", "tokens", "batch"])

    kinds = dict(items.dtypes)
    ordered = items.select("group", "no", "tokens").repartition("group").sortWithinPartitions("group", "no")
    return ordered.mapInArrow(run, f"group {kinds['group']}, no {kinds['no']}, tokens {kinds['tokens']}, batch int")


_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+")


def passages(docs: DataFrame, *, target: int = 350, overlap: int = 60) -> DataFrame:
    """(doc_id, idx, text, start_char, end_char): passages packed greedily from paragraphs.

    Paragraphs of over one and a half times the target are taken apart into sentences, and those into runs of words. Units are packed
    until the next would pass the target; each further passage is led by the last `overlap` words before it, which don't count.
    """
    overlap = min(overlap, target - 1)

    def units(text: str) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []

        def add(a: int, b: int) -> None:
            piece = text[a:b]
            a, b = a + len(piece) - len(piece.lstrip()), b - (len(piece) - len(piece.rstrip()))
            if a < b:
                out.append((a, b, len(text[a:b].split())))

        at = 0
        for gap in [*re.finditer(r"\n[^\S\n]*\n\s*", text), None]:
            a, b = at, gap.start() if gap else len(text)
            at = gap.end() if gap else at
            if len(text[a:b].split()) <= target * 1.5:
                add(a, b)
                continue
            here = a
            for stop in [*_SENTENCE.finditer(text, a, b), None]:
                x, y = here, stop.start() if stop else b
                here = stop.end() if stop else here
                if len(text[x:y].split()) <= target * 1.5:
                    add(x, y)
                else:
                    found = list(re.finditer(r"\S+", text[x:y]))
                    for k in range(0, len(found), target):
                        run_ = found[k : k + target]
                        add(x + run_[0].start(), x + run_[-1].end())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                groups: list[list[tuple[int, int, int]]] = []
                size = 0
                for u in units(text or ""):
                    if groups and size + u[2] <= target:
                        groups[-1].append(u)
                        size += u[2]
                    else:
                        groups.append([u])
                        size = u[2]
                lead, lead_at = "", 0
                for k, g in enumerate(groups):
                    body = "\n\n".join(text[x:y] for x, y, _ in g)
                    start, end = (lead_at if lead else g[0][0]), g[-1][1]
                    rows.append((i, k, f"{lead}\n\n{body}" if lead else body, start, end))
                    lead = " ".join(body.split()[-overlap:]) if overlap else ""
                    lead_at = max(start, end - len(lead))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "idx", "text", "start_char", "end_char"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, idx int, text string, start_char int, end_char int")


def shared_lines(docs: DataFrame, *, share: float = 0.4, least: int = 3, longest: int | None = None, shortest: int = 0, by: str = "source") -> DataFrame:
    """(by, line, n_docs, n_source) of trimmed lines in at least max(least, share of the group's documents) of a group's documents."""
    lines = docs.select(by, "doc_id", F.explode(F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))))).alias("line")).filter("line <> ''")
    if longest:
        lines = lines.filter(F.length("line") <= longest)
    if shortest:
        lines = lines.filter(F.length("line") > shortest)
    n = lines.groupBy(by, "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= least)
    sizes = docs.groupBy(by).agg(F.count("*").alias("n_source"))
    return join_sized(n, cut(sizes), [by], salt=F.hash("line")).filter((F.col("n_docs") >= F.floor(F.col("n_source") * share)) & (F.col("n_source") >= 3))


def strip_shared_lines(docs: DataFrame, *, share: float = 0.4, least: int = 3, thin: int = 40) -> DataFrame:
    """(doc_id, text, words, hollow): documents without their source's shared lines; hollow if fewer than `thin` words are left."""
    shared = cut(shared_lines(docs, share=share, least=least).select("source", "line"))
    # each line is in a large share of its source's documents, so a source has few; the lists come to the texts, no text is shuffled while sources are few
    lists = cut(shared.groupBy("source").agg(F.collect_set("line").alias("gone")))
    out = join_sized(docs.select("doc_id", "source", "text"), lists, ["source"], "left", salt=F.xxhash64("doc_id"))
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    kept = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~F.array_contains(F.coalesce("gone", F.array().cast("array<string>")), bare(x)))
    out = out.select("doc_id", F.array_join(kept, "\n").alias("text"))
    return out.withColumn("words", T.word_count(F.col("text"))).withColumn("hollow", F.col("words") < thin)


def thin_documents(docs: DataFrame, least: int = 40) -> DataFrame:
    return docs.select("doc_id", T.word_count(F.col("text")).alias("words")).filter(F.col("words") < least)


def failure_summary(failures: DataFrame) -> DataFrame:
    """(reason, n): failures by what stands before the first colon of their reason."""
    return failures.groupBy(F.trim(F.split("reason", ":")[0]).alias("reason")).agg(F.count("*").alias("n"))


def store_stats(docs: DataFrame, chunks: DataFrame, log: DataFrame) -> DataFrame:
    """One row on a corpus: documents by kind, passages, vectors and their prevailing model, questions, gaps, tokens."""
    kinds = ("website", "youtube", "podcast")
    d = docs.agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_documents") for k in kinds))
    models = chunks.filter("embedding_model is not null").groupBy("embedding_model").agg(F.count("*").alias("n")).agg(F.max_by("embedding_model", F.struct("n", "embedding_model")).alias("model"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
    q = log.agg(F.count("*").alias("questions"), F.count_if("not_covered").alias("gaps"), F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).alias("tokens"))
    return d.crossJoin(c).crossJoin(models).crossJoin(q)  # one row each


def audit(docs: DataFrame, chunks: DataFrame, *, thin: int = 40, long_line: int = 60, share: float = 0.25) -> DataFrame:
    """(check, value): findings on a corpus as counts, each from one pass over its table."""
    hashes = docs.groupBy(T.content_hash(F.col("text")).alias("h")).agg(F.count("*").alias("n")).filter("n > 1")
    furniture = shared_lines(docs, share=share, least=3, shortest=long_line)
    one = lambda df, name, expr: df.agg(expr.cast("long").alias("value")).select(F.lit(name).alias("check"), "value")
    parts = [
        one(docs, "documents", F.count("*")), one(thin_documents(docs, thin), "thin documents", F.count("*")), one(hashes, "texts stored more than once", F.count("*")), one(hashes, "most copies of a text", F.coalesce(F.max("n"), F.lit(0))),
        one(without_chunks(docs, chunks), "documents without passages", F.count("*")), one(chunks, "passages without a vector", F.count_if(F.col("embedding").isNull())), one(furniture, "long lines shared within a source", F.count("*")),
        one(chunks.join(docs.select("doc_id"), "doc_id", "left_anti"), "passages without a document", F.count("*")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ingest_plan(items: DataFrame) -> DataFrame:
    """(source, method, n, minutes) of what is planned: items (source, method, seconds); an unknown length counts as an hour."""
    return items.groupBy("source", "method").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("seconds") / 60, F.lit(60.0))).alias("minutes"))


def source_findings(listed: DataFrame, docs: DataFrame) -> DataFrame:
    """(host, documents) of listed links' hosts, also through the links that redirects led from. listed: (url); docs: (locator, link)."""
    from ..functions import urls as U

    hosts = listed.select(U.host_key(F.col("url")).alias("host")).distinct()
    by_locator = docs.select(U.host_key(F.col("locator")).alias("host"), "doc_id")
    by_link = docs.filter("link is not null").select(U.host_key(F.col("link")).alias("host"), "doc_id")
    n = by_locator.union(by_link).distinct().groupBy("host").agg(F.count("*").alias("documents"))
    return hosts.join(n, "host", "left").select("host", F.coalesce("documents", F.lit(0)).alias("documents"))


def failure_report(failures: DataFrame) -> DataFrame:
    """(line_no, line): a report of failures (locator, reason), grouped by reason: a head, then its locators."""
    head = F.trim(F.split("reason", ":")[0])
    groups = failures.groupBy(head.alias("h")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.concat(F.lit("  "), "locator", F.lit(": "), "reason"))).alias("rows"))
    lines = groups.select("h", F.posexplode(F.concat(F.array(F.concat(F.col("n").cast("string"), F.lit(" x "), "h")), "rows")).alias("line_no", "line"))
    return lines


def reasons_from_report(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(locator, reason): reasons of wanted locators read back from a report's lines."""
    parts = lines.filter(F.col("line").startswith("  ")).select(F.regexp_extract("line", r"^  (\S+): (.*)$", 1).alias("locator"), F.regexp_extract("line", r"^  (\S+): (.*)$", 2).alias("reason"))
    return parts.join(wanted.select("locator").distinct(), "locator").groupBy("locator").agg(F.min("reason").alias("reason"))
