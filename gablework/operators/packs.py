"""Export packs: documents rendered as sections of text and packed into parts of bounded size."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut


def sections(docs: DataFrame) -> DataFrame:
    """docs with section and its sort key: pages by title, posts (blog links) by date, recordings by episode number."""
    section = F.when(F.col("kind") != "website", "recordings").when(F.col("locator").contains("/blog/"), "posts").otherwise("pages")
    number = F.coalesce(F.col("episode").try_cast("int"), F.lit(-1))
    out = docs.withColumn("section", section).withColumn("number", F.when(F.col("section") == "recordings", number))
    return out.withColumn("date", F.when(F.col("section") == "posts", F.col("published_at"))).withColumn("name", F.lower("title"))


#: The order of a pack: a section is in one order over all its documents.
ORDER = (F.asc, "section"), (F.asc, "number"), (F.desc_nulls_last, "date"), (F.asc, "name"), (F.asc, "doc_id")


def rendered(docs: DataFrame) -> DataFrame:
    """(section, number, date, name, doc_id, block, words): each document under its heading, with its link and date if it has them."""
    head = F.concat(F.lit("### "), F.coalesce(F.expr("nullif(trim(title), '')"), F.lit("Untitled")))
    body = F.concat_ws("\n", head, F.expr("nullif(trim(link), '')"), F.expr("nullif(trim(published_at), '')"), F.lit(""), F.trim("text"))
    return sections(docs).select("section", "number", "date", "name", "doc_id", body.alias("block"), T.word_count(F.col("text")).alias("words"))


def fold_table(chars: np.ndarray, limit: int) -> tuple[list[int], list[int], list[int], int]:
    """(upto, parts, size, total) of a range of blocks: what it does to any part that is open at its start.

    If the first block that no longer fits is i, a part begins there, `parts[i]` more follow and the last is of `size[i]`. Only the blocks
    that fit in one part, and one more, can be the first that doesn't; upto[i] is the sum of sizes with block i.
    """
    before = np.concatenate(([0], np.cumsum(chars)))
    n = len(chars)
    # the part that begins with block i ends before block nxt[i]; a block always fits in a part of its own
    nxt = np.maximum(np.searchsorted(before, before[:-1] + limit, side="right") - 1, np.arange(n) + 1)
    parts, size = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        j = int(nxt[i])
        parts[i], size[i] = (parts[j] + 1, size[j]) if j < n else (0, int(before[n] - before[i]))
    most = min(n, int(np.searchsorted(before[1:], limit, side="right")) + 1)
    return before[1 : most + 1].tolist(), parts[:most], size[:most], int(before[n])


def after(table: tuple[list[int], list[int], list[int], int], part: int, size: int, limit: int) -> tuple[int, int]:
    """The part and its size that are open at the end of a range, from those at its start; a size of 0: no part is open yet."""
    upto, parts, sizes, total = table
    if not size:
        return part + parts[0], sizes[0]
    i = bisect_right(upto, limit - size)
    return (part, size + total) if i == len(upto) else (part + 1 + parts[i], sizes[i])


def packed(blocks: DataFrame, part_chars: int, ranges: int | None = None) -> DataFrame:
    """(section, doc_id, chars, part): blocks in order into parts of at most part_chars; a longer block is a part of its own.

    A part depends on all before it. Blocks are sorted over the cluster by ranges; each range first tells what it does to any part that is open
    at its start (see fold_table; no more rows than blocks fit in a part), the driver carries the open part through the ranges, and each range is
    packed from there. Only sizes travel.
    """
    order = [f(c) for f, c in ORDER]
    sizes = blocks.select("section", "number", "date", "name", "doc_id", (F.length("block") + 2).cast("long").alias("chars"))
    ordered = (sizes.repartitionByRange(ranges, *order) if ranges else sizes.repartitionByRange(*order)).sortWithinPartitions(*order)
    ordered = cut(ordered.select("section", "doc_id", "chars", F.spark_partition_id().alias("range")))

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[np.ndarray]] = {}
        for pdf in batches:
            for key, part in pdf.groupby(["range", "section"], sort=False):
                held.setdefault(key, []).append(part["chars"].to_numpy())
        rows = [(int(r), s, *fold_table(np.concatenate(c), part_chars)) for (r, s), c in held.items()]
        yield pd.DataFrame(rows, columns=["range", "section", "upto", "parts", "sizes", "total"])

    told = ordered.select("range", "section", "chars").mapInPandas(tell, "range int, section string, upto array<long>, parts array<long>, sizes array<long>, total long")
    start: dict[tuple[int, str], tuple[int, int]] = {}
    now: dict[str, tuple[int, int]] = {}
    for r in told.orderBy("range").toLocalIterator():
        start[r.range, r.section] = now.get(r.section, (0, 0))
        now[r.section] = after((r.upto, r.parts, r.sizes, r.total), *start[r.range, r.section], part_chars)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, part, size = None, 0, 0
        for pdf in batches:
            out = []
            for key, n in zip(zip(pdf["range"], pdf["section"], strict=True), pdf["chars"], strict=True):
                if key != now:
                    now, (part, size) = key, start[key]
                if size and size + n > part_chars:
                    part, size = part + 1, 0
                size += n
                out.append(part)
            yield pdf[["section", "doc_id", "chars"]].assign(part=out)

    return ordered.mapInPandas(run, "section string, doc_id long, chars long, part long")


def coverage(docs: DataFrame) -> DataFrame:
    """(section, documents, words) of a pack."""
    return rendered(docs).groupBy("section").agg(F.count("*").alias("documents"), F.sum("words").alias("words"))
