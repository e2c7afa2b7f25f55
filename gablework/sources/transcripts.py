"""Transcript files of several formats as timed segments, parsed from a column of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T

_SEGMENT = "array<struct<text:string,start:string,end:string,duration:string>>"


def read_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, suffix, text) of whole files; a byte-order mark goes, bytes that can't be read become replacement signs."""
    raw = spark.read.format("binaryFile").load(glob)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return raw.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"), text.alias("text"))


def _stamp(c: Column) -> Column:
    return dates.duration_seconds(F.replace(c, F.lit(","), F.lit(".")))


def cues(text: Column) -> Column:
    """Segments of SRT and WebVTT: blocks with an arrow; texts are cleaned, empty cues dropped."""
    blocks = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n[ \t]*\n+"), lambda b: b.contains("-->"))
    made = F.transform(
        blocks,
        lambda b: F.struct(
            _stamp(F.regexp_extract(b, r"(\d[\d:.,]*)[ \t]*-->", 1)).alias("start"), _stamp(F.regexp_extract(b, r"-->[ \t]*(\d[\d:.,]*)", 1)).alias("end"),
            T.caption(F.regexp_replace(F.regexp_extract(b, r"(?s)-->[^\n]*\n(.*)", 1), "\n", " ")).alias("text"),
        ),
    )
    return F.filter(made, lambda s: s["text"] != "")


def json_segments(text: Column) -> Column:
    """Segments of JSON: a list, or an object with segments, else snippets; end, else start and duration; never before start."""
    raw = F.coalesce(F.when(F.trim(text).startswith("["), F.from_json(text, _SEGMENT)), F.from_json(F.get_json_object(text, "$.segments"), _SEGMENT), F.from_json(F.get_json_object(text, "$.snippets"), _SEGMENT))
    start = lambda s: F.coalesce(s["start"].try_cast("double"), F.lit(0.0))
    end = lambda s: F.greatest(start(s), F.coalesce(s["end"].try_cast("double"), start(s) + s["duration"].try_cast("double"), start(s)))
    made = F.transform(F.coalesce(raw, F.array().cast(_SEGMENT)), lambda s: F.struct(start(s).alias("start"), end(s).alias("end"), F.trim(F.coalesce(s["text"], F.lit(""))).alias("text")))
    return F.filter(made, lambda s: s["text"] != "")


def paragraphs(text: Column) -> Column:
    """Segments of plain text: its paragraphs, without times."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), p.alias("text")))


def parse(files: DataFrame) -> DataFrame:
    """files (suffix, text, ...) with segments, and problem where the suffix isn't known; blank files have none."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:double,end:double,text:string>>")
    segs = F.when(F.trim(text) == "", none).when(F.col("suffix").isin("srt", "vtt"), cues(text)).when(F.col("suffix") == "json", json_segments(text)).when(F.col("suffix") == "txt", paragraphs(text)).otherwise(none)
    return files.withColumn("segments", segs).withColumn("problem", F.when(~F.col("suffix").isin("srt", "vtt", "json", "txt"), F.concat(F.lit("unknown transcript format: "), "suffix")))


def pick_track(tracks: Column, wanted: list[str]) -> Column:
    """The track (code, url) of the first wanted language there is: the code itself, a regional form, then the bare language."""
    rank = lambda t: F.least(*(F.when(F.lower(t["code"]) == w.lower(), i * 3).when(F.lower(t["code"]).startswith(w.lower() + "-"), i * 3 + 1).when(F.lower(t["code"]) == w.lower().split("-")[0], i * 3 + 2).otherwise(9999) for i, w in enumerate(wanted)), F.lit(9999))
    ranked = F.array_sort(F.filter(F.transform(tracks, lambda t, i: F.struct(rank(t).alias("r"), i.alias("i"), t["url"].alias("url"))), lambda x: x["r"] < 9999))
    return F.try_element_at(ranked, F.lit(1))["url"]
