"""Problem 10: documents with template residue, filler or messages in place of content.

Fields of a template that stand in a text's own words (not those it merely mentions) make a document a case by themselves. All else is found
from near-duplicates: documents without a paragraph of ordinary prose are taken apart into units, the normalised lines that are left
after their host's furniture. Units go into partitioned SimHash tables; pairs within the Hamming distance that share a table's key are
candidates. Similar units can be farther apart in SimHash, so units that share one of their rarest shingles are candidates too: with as many of
the rarest as the similarity leaves room to miss, and one more, no similar pair is lost. All candidates are verified by similarity of
their five-word shingles. Units that stand in one document are linked as well: a page without content is made of messages.

Labels are trusted on three grounds: a small labelled table of messages (SEEDS), which take part as units; filler, told by its form; and a class of
near-duplicates that is the whole content of documents with several titles (one text can't be about them all). They spread through the connected
components. A document is residue if it has fields, or if it has a labelled unit and no other content.

Null and empty texts are no case (there is nothing to leave out of them). Copies have equal results, one row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import cut, join_sized
from . import pages

#: A 64-bit SimHash is cut into BLOCKS blocks; a table is keyed by all but MOST_BITS of them (about 32 bits). Two hashes within
#: MOST_BITS of each other agree in one table at least.
BLOCKS, MOST_BITS, SIMILARITY, SHINGLE = 6, 3, 0.8, 5
TABLES = tuple(combinations(range(BLOCKS), BLOCKS - MOST_BITS))

#: What a field of a template is called between its marks.
_NAME = r"[^\W\d_](?:[\w.]|[ \t\xa0](?=[^\W\d_])){0,30}?"
_FIELD = re.compile(
    r"\{\{\s?" + _NAME + r"\s?\}\}|\$\{\s?" + _NAME + r"\s?\}|\{%\s?" + _NAME + r"\s?%\}|\[\[\s?" + _NAME + r"\s?\]\]|<<\s?" + _NAME + r"\s?>>|«\s?" + _NAME + r"\s?»"
    r"|%" + _NAME + r"%|__" + _NAME + r"__|##?" + _NAME + r"##?(?!\w)|@@[^\W\d_][\w.]*"
    r"|(?P<weak>\{\s?" + _NAME + r"\s?\}|\[" + _NAME + r"\]|<" + _NAME + r">)"
)
_MENTION_BEFORE = re.compile(r"(?i)(?:\b(?:says|reads|still (?:has|says|shows|holds)|marked|labelled|labeled|named|called|the (?:field|tag|placeholder|word|words|code)|dice|diga|lleva|el campo|la palabra)\s*[:,]?\s*[\"'“‘«]?)$")
_MENTION_AFTER = re.compile(r"(?i)^[\"'”’»]?,?\s*(?:(?:still )?(?:printed|written|left|showing) (?:in|on)|write it|en lugar de|impreso|escrito)")
#: Annotations and marks of transcripts, which are no fields.
_NOT_FIELD = re.compile(r"(?i)^[\[<{(]+(?:music|inaudible|applause|laughs?|laughter|risas|m[uú]sica|aplausos|crosstalk|host|sic|v |i|b|p|br|em|strong|div|span|\w|edit|video|image|photo)\b")

#: Units of one key that meet in one place; keys of more are cut into blocks of that many.
KEY_BLOCK = 500

#: The labelled table: common messages of web servers, portals and editors, as units (lower case, without numbers and marks).
SEEDS = (
    "page not found", "internal server error", "access denied", "forbidden", "bad gateway", "service unavailable", "too many requests", "please enable javascript to continue", "lorem ipsum dolor sit amet",
    "lorem ipsum", "coming soon", "under construction", "loading", "acceso denegado", "página no encontrada", "transcript unavailable", "no transcript available", "undefined", "null",
)
#: Titles under which one class must be the whole content.
TITLES = 3


def has_fields(text: str, website: bool = True) -> bool:
    """Whether fields of a template stand in the text's own words."""
    for m in _FIELD.finditer(text):
        g = m.group()
        if m.group("weak") and not website or _NOT_FIELD.match(g):
            continue
        inner = re.sub(r"[^\w. ]", "", g)
        if len(inner.split()) > 4 or len(inner) < 2:
            continue
        if _MENTION_BEFORE.search(text[max(0, m.start() - 40) : m.start()]) or _MENTION_AFTER.search(text[m.end() : m.end() + 30]):
            continue
        if g[:1] == "#" and not re.fullmatch(r"##?[A-Z_.]{3,}##?", g):
            continue
        return True
    return False


def trusted(unit: str) -> bool:
    """Whether a unit's form makes it filler: words repeated without end, or a run of words of which none builds sentences."""
    words = unit.split()
    if len(words) >= 2 and len(set(words)) * 2 <= len(words) and not any(w in pages.FUNCTION_WORDS for w in words):
        return True
    if words and all(len(set(w)) == 1 and len(w) > 1 for w in words):
        return True
    return len(words) >= 6 and not any(w in pages.FUNCTION_WORDS for w in words) and len(set(words)) < 40 and _latin(words)


def _latin(words: list[str]) -> bool:
    ends = sum(w.endswith(("um", "us", "am", "em", "or", "it", "et", "is", "at", "tu", "ca", "ra", "ur", "ar", "ix", "io", "ig", "ntu", "pra", "que")) for w in words)
    return ends * 2 >= len(words)


def simhash(unit: str) -> int:
    """64 bits over the unit's trigrams of characters."""
    padded = f"  {unit} "
    h = np.fromiter((xxhash.xxh64_intdigest(padded[i : i + 3]) for i in range(len(padded) - 2)), np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0) * 2 > len(h)
    return int(np.packbits(bits).view(np.uint64)[0])


def shingles(unit: str) -> set[str]:
    w = unit.split()
    return {" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} or {unit}


def similar(a: str, b: str) -> bool:
    x, y = shingles(a), shingles(b)
    return len(x & y) >= SIMILARITY * len(x | y)


def table_keys(sim: int) -> list[int]:
    """The key of a hash in each table, the table's number in its upper bits."""
    edge = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    block = [sim >> edge[i] & (1 << edge[i + 1] - edge[i]) - 1 for i in range(BLOCKS)]
    out = []
    for t, chosen in enumerate(TABLES):
        key = t
        for c in chosen:
            key = key << 11 | block[c]
        out.append(key)
    return out


def hashed_units(units: DataFrame) -> DataFrame:
    """(unit_id, unit, trusted, sim, keys, grams) of distinct units; unit_id is a hash of the unit, grams are those of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, seeds = b.column(0).to_pylist(), set(SEEDS)
            ids = [xxhash.xxh64_intdigest(u) - (1 << 63) for u in texts]
            sims = [simhash(u) for u in texts]
            keys = pa.array([table_keys(x) for x in sims], pa.list_(pa.int64()))
            grams = pa.array([[xxhash.xxh64_intdigest(g) - (1 << 63) for g in shingles(u)] for u in texts], pa.list_(pa.int64()))
            signed = pa.array([x - (1 << 64) if x >> 63 else x for x in sims], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array([u in seeds or trusted(u) for u in texts], pa.bool_()), signed, keys, grams], names=["unit_id", "unit", "trusted", "sim", "keys", "grams"])

    return units.select("unit").distinct().mapInArrow(run, "unit_id long, unit string, trusted boolean, sim long, keys array<long>, grams array<long>")


def rarest_grams(hashed: DataFrame) -> DataFrame:
    """(unit_id, n, gram): of a unit's n shingles the rarest, by the number of units that hold them, without those of one unit only.

    Two sets of a similarity of at least t have t * n of the n shingles of either in common, so in any one order of all shingles they share one
    of the first n - t * n + 1.
    """
    grams = hashed.select("unit_id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    often = cut(grams.groupBy("gram").agg(F.count("*").alias("f")).filter("f > 1"))
    shared = join_sized(grams, often, ["gram"], salt=F.col("unit_id")).groupBy("unit_id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "gram"))).alias("held"))
    # shingles of this unit only are the rarest and take the first places
    first = F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9) + 1 - (F.col("n") - F.size("held"))
    return shared.select("unit_id", "n", F.explode(F.slice("held", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("x")).select("unit_id", "n", "x.gram")


def met_in_keys(keyed: DataFrame, most: int = KEY_BLOCK) -> DataFrame:
    """(a, b) of units that share a key, a < b; keyed: (unit_id, key). A key of many units is cut into blocks, each pair of which is a task's share.

    No key is gathered in one place: members are dealt to blocks by hash, and a block meets each other block of its key once.
    """
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / most).cast("int").alias("blocks")))
    placed = join_sized(keyed, sizes, ["key"], salt=F.col("unit_id")).withColumn("block", F.pmod(F.xxhash64("unit_id"), F.col("blocks")).cast("int"))
    # block i meets block j >= i under (key, i, j)
    left = placed.select("key", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("unit_id").alias("x"))
    right = placed.select("key", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("unit_id").alias("y"))
    met = left.join(right, ["key", "i", "j"]).filter("x <> y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_pairs(hashed: DataFrame) -> DataFrame:
    """(a, b) of near-duplicate units, verified; a < b. Units are distinct texts, so copies don't crowd a key."""
    sims = hashed.select("unit_id", "sim")
    met = met_in_keys(hashed.select("unit_id", F.explode("keys").alias("key")))
    a, b = (sims.select(F.col("unit_id").alias(u), F.col("sim").alias(f"s{u}")) for u in "ab")
    met = met.join(a, "a").join(b, "b").filter(F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= MOST_BITS).select("a", "b")
    rare = cut(rarest_grams(hashed))
    shared = met_in_keys(rare.select("unit_id", F.col("gram").alias("key")))
    n = hashed.select("unit_id", F.size("grams").alias("n"))
    a, b = (n.select(F.col("unit_id").alias(u), F.col("n").alias(f"n{u}")) for u in "ab")
    sizes = F.least("na", "nb") >= F.greatest("na", "nb") * SIMILARITY - 1e-9
    met = met.union(shared.join(a, "a").join(b, "b").filter(sizes).select("a", "b")).distinct()
    text = hashed.select("unit_id", "unit")
    met = met.join(text.withColumnsRenamed({"unit_id": "a", "unit": "ua"}), "a").join(text.withColumnsRenamed({"unit_id": "b", "unit": "ub"}), "b").select("a", "ua", "b", "ub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [i for i, (x, y) in enumerate(zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)) if similar(x, y)]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def field_documents(docs: DataFrame) -> DataFrame:
    """(doc_id) of documents with fields in their own words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [i for i, text, kind in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True) if has_fields(text, kind == "website")]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["doc_id"])

    # one of the marks must be there; tells most texts apart without Python
    marked = docs.filter("text is not null").filter(F.col("text").rlike(r"[{}%<«\[]|__|##|@@|#[A-Z]"))
    return marked.select("doc_id", "text", "kind").mapInArrow(run, "doc_id long").distinct()


def content_units(lines: DataFrame) -> DataFrame:
    """(doc_id, unit, prose: whether it reads like content) of documents without prose, after the furniture of their hosts; lines: pages.label_lines."""
    left = F.col("bare") & ((F.col("role").isin("para", "sentence", "phrase", "short") & (F.col("place") != "out")) | (F.col("role") == "shared")) & (F.col("unit") != "")
    return lines.filter(left).groupBy("doc_id", "unit").agg(F.max(F.col("role").isin("para", "sentence")).alias("prose"))


def unit_classes(units: DataFrame, titles: DataFrame, *, least_titles: int = TITLES) -> DataFrame:
    """(unit, class_id, near_id, seeded, spread, residue) of distinct units of content_units; titles: (doc_id, title).

    near_id: component of near-duplicates; class_id: of these and of classes that stand in one document. A class without a trusted label under one title
    only has no part in the latter, because it may be that document's content. seeded: whether the unit's own label is trusted; spread: whether its class is the whole of
    documents of several titles; residue: whether there is either in its component.
    """
    seeds = units.sparkSession.createDataFrame([(x,) for x in SEEDS], "unit string")
    hashed = cut(hashed_units(units.select("unit").union(seeds)))
    near = components(near_pairs(hashed))
    named = cut(hashed.select("unit", "unit_id", "trusted").join(near, F.col("unit_id") == near.node, "left").select("unit", "trusted", F.coalesce("class_id", "unit_id").alias("near_id")))
    of_docs = cut(units.join(named, "unit").join(titles, "doc_id").select("doc_id", "title", "near_id").distinct())
    several = of_docs.groupBy("near_id").agg(F.countDistinct("title").alias("titles")).filter("titles > 1").select("near_id").union(named.filter("trusted").select("near_id")).distinct()
    whole = of_docs.groupBy("doc_id", "title").agg(F.min("near_id").alias("near_id"), F.max("near_id").alias("other")).filter("near_id = other")
    spread = whole.groupBy("near_id").agg(F.countDistinct("title").alias("titles")).filter(F.col("titles") >= least_titles).select("near_id", F.lit(True).alias("spread"))
    # a star a document, from its least class; equal stars collapse, so a message in a third of all documents is no hot node
    linked = cut(of_docs.join(several, "near_id", "left_semi").select("doc_id", "near_id"))
    least = linked.groupBy("doc_id").agg(F.min("near_id").alias("a"))
    star = linked.join(least, "doc_id").filter("a <> near_id").select("a", F.col("near_id").alias("b")).distinct()
    joined = components(star).withColumnRenamed("node", "near_id")
    labelled = named.join(spread, "near_id", "left").join(joined, "near_id", "left")
    labelled = cut(labelled.select("unit", "near_id", F.col("trusted").alias("seeded"), F.coalesce("spread", F.lit(False)).alias("spread"), F.coalesce("class_id", "near_id").alias("class_id")))
    labels = cut(labelled.groupBy("class_id").agg(F.max(F.col("seeded") | F.col("spread")).alias("residue")))
    return join_sized(labelled, labels, ["class_id"], salt=F.xxhash64("unit")).select("unit", "class_id", "near_id", "seeded", "spread", "residue")


def residue_documents(docs: DataFrame, lines: DataFrame, *, least_titles: int = TITLES) -> DataFrame:
    """(doc_id, how) of the cases among docs; lines: their labelled lines (pages.label_lines), of recordings too.

    how: `field`; `seed` if a unit's own label is trusted; `spread` if a class of near-duplicates is the content of several titles; `component` if the
    label came from other units. A document that has items or prose beside, without a label, is content.
    """
    units = cut(content_units(lines))
    classes = cut(unit_classes(units, docs.select("doc_id", "title"), least_titles=least_titles))
    judged = units.join(classes, "unit").groupBy("doc_id").agg(*(F.max(c).alias(c) for c in ("residue", "seeded", "spread")), F.max(F.col("prose") & ~F.col("residue")).alias("content"))
    items = lines.filter("bare and role = 'item' and article").select("doc_id").distinct()
    how = F.when(F.col("seeded"), "seed").when(F.col("spread"), "spread").otherwise("component")
    found = judged.filter("residue and not content").join(items, "doc_id", "left_anti").select("doc_id", how.alias("how"))
    return field_documents(docs).withColumn("how", F.lit("field")).unionByName(found).groupBy("doc_id").agg(F.max_by("how", F.col("how") == "field").alias("how"))
