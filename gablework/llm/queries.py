"""Queries of the training-data operators over whole tables. Names: p<problem>_<what>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import canonical, forest, lines, mix, pack, pages, pii, residue, split, tokens, turns

FIELDS = {"log_entries.kind": "kind", "log_entries.vendor": "vendor"}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oversized_paragraphs(table(spark, sf_dir, "documents"))


def p1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(table(spark, sf_dir, "documents"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.free_texts(*(table(spark, sf_dir, t) for t in ("questions_log", "ratings", "log_entries", "threads")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_details(_texts(spark, sf_dir)).select("field", "row_key", "msg_no", "start_char", "pii_kind")


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact_details(_texts(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.speaker_turns(table(spark, sf_dir, "documents")).select("doc_id", "start_ms", "speaker").distinct()


def p3_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.speaker_turns(table(spark, sf_dir, "documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.find_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no")


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.strip_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "clean_text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_join(table(spark, sf_dir, "chunks")).select("chunk_a", "chunk_b")


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries: the vectors of documents whose doc_id is divisible by 100; rows: all usable vectors."""
    chunks = table(spark, sf_dir, "chunks")
    rows = cut(forest.vectors(chunks).dropDuplicates(["id"]))
    return cut(rows.join(chunks.filter("doc_id % 100 = 0").select("id").distinct(), "id", "left_semi")), rows


def p5_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(*_searched(spark, sf_dir))


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.recall(*_searched(spark, sf_dir))


def p5_join_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: of the pairs that the stated queries make by brute force, how many the join has."""
    queries_, rows = _searched(spark, sf_dir)
    exact = forest.search(queries_, rows, exact=True).filter("similarity >= 0.95 - 1e-7")
    true = exact.select(F.least("query", "found").alias("chunk_a"), F.greatest("query", "found").alias("chunk_b")).distinct()
    met = true.join(p5_found(spark, sf_dir).withColumn("hit", F.lit(1)), ["chunk_a", "chunk_b"], "left")
    return met.agg(F.count("*").alias("n_pairs"), F.count("hit").alias("n_found"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("kind = 'website'")
    lines_ = pages.label_lines(docs)
    gone = residue.residue_documents(docs, lines_)
    return lines_.filter(~F.col("article")).join(gone, "doc_id", "left_anti").select("doc_id", "line_no")


def p6_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("kind = 'website'")
    kept = pages.label_lines(docs).filter("article").groupBy("doc_id").agg(F.collect_set("line_no").alias("kept"))
    body = F.filter(F.split("text", "\n"), lambda x, i: F.array_contains("kept", i.cast("int")))
    return docs.join(kept, "doc_id").select("doc_id", F.array_join(body, "\n").alias("article"))


def p6_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each vote decides: templates, containers, and line paths against what the page alone says."""
    lines_ = pages.label_lines(table(spark, sf_dir, "documents"))
    by = F.when(F.col("role") == "common", "template").when(F.col("place") == "out", "container").when(F.col("alone") != F.col("article"), "path").otherwise("page")
    return lines_.groupBy(by.alias("decided_by"), "article").agg(F.count("*").alias("n_lines"))


def _residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return residue.residue_documents(docs, pages.label_lines(docs, website_only=False))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residue(spark, sf_dir).select("doc_id")


def p10_grounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents were found by their fields, by a trusted label of their own and through a class."""
    return _residue(spark, sf_dir).groupBy("how").agg(F.count("*").alias("n_docs"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document that is made of units: its units' class, how many classes of near-duplicates they fall into, and the label."""
    docs = table(spark, sf_dir, "documents")
    units = cut(residue.content_units(pages.label_lines(docs, website_only=False)))
    named = units.join(residue.unit_classes(units, docs.select("doc_id", "title")), "unit")
    return named.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.countDistinct("near_id").alias("n_classes"), F.max(F.col("residue").cast("int")).alias("residue"))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "ref_values")
    parts = [
        canonical.map_values(table(spark, sf_dir, "log_entries"), refs, FIELDS),
        canonical.map_values(table(spark, sf_dir, "properties"), refs, {"properties.city": "city"}),
        canonical.map_values(table(spark, sf_dir, "accounts"), refs, {"accounts.neighborhood": "neighborhood"}),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("field", "row_key", "ref_id")


def p7_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).filter("ref_id = 0").groupBy("field", "value").agg(F.count("*").alias("n_rows"))


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(tokens.count_tokens(table(spark, sf_dir, "documents")))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.fill(cut(p8_packing(spark, sf_dir)))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(tokens.count_tokens(table(spark, sf_dir, "documents"), keep=("doc_id", "source", "kind", "lang")))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(_counted(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]


def p9_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(_counted(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p9_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report for as many tokens as the listed sources hold in all: most need their shares, the small ones reach their passes."""
    docs, targets = _counted(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    total = docs.join(targets.select("source").distinct(), "source", "left_semi").agg(F.sum("n_tokens")).first()[0] or 0
    return mix.mix(docs, targets, total_tokens=float(total))[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in sorted(globals().items()) if k[:1] == "p" and k[1:2].isdigit() and callable(v)}
