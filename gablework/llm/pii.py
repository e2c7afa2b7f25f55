"""Problem 2: personal details in free text, found by a conditional random field and replaced with typed placeholders.

The field is trained on the driver from the small labelled table of pii_labels (ROWS sentences, a documented bound; a few seconds)
and sent to the tasks (about 2 MB). Texts are cut into sentences; a sentence that a worker has seen keeps its result, so that
often repeated text costs a lookup. Details never span sentences.

Null and empty texts hold no detail. Repeated rows give one case. Details at one position are of one kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pii_labels
from .crf import Crf, tokens

ROWS = 6000
#: Sentences remembered by a worker before the memory is emptied; it only saves work.
MEMO = 400_000
#: Texts decoded at once.
BLOCK = 2000
PLACEHOLDER = {k: f"[{k.upper()}]" for k in pii_labels.KINDS}

_TITLE = re.compile(r"(?i)^(?:mr|mrs|ms|miss|dr|prof|sr|sra|srta|don|doña|señor|señora)\.?\s+(?=\S)")
#: A sentence ends after a word of two letters or more and a mark, before white space; titles and street endings don't end one.
_SENTENCE = re.compile(r"(?<=\w\w[.!?;])\s+(?=\S)")
_OPEN_END = re.compile(r"(?i)(?:^|\W)(?:mr|mrs|ms|dr|prof|sr|sra|srta|st|ave|av|blvd|rd|ln|ct|pl|ter|pkwy|apt|no|nos|vs|etc|rev|jr|tel|num|núm|calz|co|inc|d\.l)\.$")


def labels() -> list[str]:
    return ["O", *(f"{p}-{k}" for k in pii_labels.KINDS for p in "BI")]


def tagged(text: str, marks: list[tuple[int, int, str]]) -> tuple[list[str], list[str]]:
    words, tags = [], []
    for w, a, b in tokens(text):
        tag = "O"
        for s, e, kind in marks:
            if a < e and b > s:
                tag = ("B-" if a <= s else "I-") + kind
                break
        words.append(w)
        tags.append(tag)
    return words, tags


@cache
def trained(rows: int = ROWS, seed: int = 5) -> Crf:
    table = [tagged(*r) for r in pii_labels.labelled(rows, seed)]
    return Crf(labels()).train([w for w, _ in table], [t for _, t in table], epochs=10)


def sentences(text: str) -> list[tuple[int, str]]:
    out, start = [], 0
    for m in _SENTENCE.finditer(text):
        if _OPEN_END.search(text[max(start, m.start() - 8) : m.start()]):
            continue
        out.append((start, text[start : m.start()]))
        start = m.end()
    out.append((start, text[start:]))
    return out


def spans(text: str, toks: list[tuple[str, int, int]], path: list[int], names: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the labelled runs, trimmed to what belongs to the detail."""
    out: list[list] = []
    for (w, a, b), k in zip(toks, path, strict=True):
        name = names[k]
        if name == "O":
            continue
        kind = name[2:]
        if out and out[-1][2] == kind and name[0] == "I" and text[out[-1][1] : a].strip() == "":
            out[-1][1] = b
        else:
            out.append([a, b, kind])
    kept = []
    for a, b, kind in out:
        if kind == "person_name":
            m = _TITLE.match(text[a:b])
            a += m.end() if m else 0
            said = re.sub(r"['’][sS]$", "", text[a:b].rstrip(" .,;:!?-"))
        else:
            said = text[a:b].rstrip(" ,;:!?") if kind == "street_address" else text[a:b].rstrip(" .,;:!?-/")
        lead = len(said) - len(said.lstrip(" ,;:-/" if kind != "phone" else " ,;:-/"))
        a, said = a + lead, said[lead:]
        if kind == "phone" and a and text[a - 1] in "+(":
            a, said = a - 1, text[a - 1] + said
        if not said or kind == "person_name" and len(re.findall(r"[^\W\d_]", said)) < 2:
            continue
        if kind in ("phone", "street_address") and not re.search(r"\d|\b(?:zero|one|two|three|four|five|six|seven|eight|nine|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve)\b", said.lower()):
            continue
        kept.append((a, a + len(said), kind))
    return kept


class Finder:
    def __init__(self, crf: Crf):
        self.crf, self.memo = crf, {}

    def __call__(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        cut = [sentences(t) if t else [] for t in texts]
        new = list({s for c in cut for _, s in c if s not in self.memo})
        toks = [tokens(s) for s in new]
        for s, t, p in zip(new, toks, self.crf.decode([[w for w, _, _ in t] for t in toks]), strict=True):
            self.memo[s] = tuple(spans(s, t, p, self.crf.labels)) if any(p) else ()
        return [[(a + at, b + at, k) for at, s in c for a, b, k in self.memo[s]] for c in cut]


_FINDERS: dict[tuple[int, int], Finder] = {}


def free_texts(questions: DataFrame, ratings: DataFrame, log_entries: DataFrame, threads: DataFrame) -> DataFrame:
    """(field, row_key, msg_no, text) of all fields in which owners type."""
    zero = F.lit(0).alias("msg_no")
    parts = [
        questions.select(F.lit("questions_log.question").alias("field"), F.col("id").cast("string").alias("row_key"), zero, F.col("question").alias("text")),
        ratings.select(F.lit("ratings.note").alias("field"), F.concat_ws(":", "thread_id", F.col("turn").cast("string")).alias("row_key"), zero, F.col("note").alias("text")),
        log_entries.select(F.lit("log_entries.what").alias("field"), F.col("id").alias("row_key"), zero, F.col("what").alias("text")),
        threads.select(F.lit("threads.messages").alias("field"), F.col("id").alias("row_key"), F.posexplode("messages").alias("msg_no", "m")).select("field", "row_key", "msg_no", F.col("m.content").alias("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("text is not null and row_key is not null")


def _run(texts: DataFrame, schema: str, emit, rows: int):  # noqa: ANN001, ANN202
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(trained(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (shared.id if hasattr(shared, "id") else 0, rows)
        find = _FINDERS.get(key)
        if find is None:
            find = _FINDERS[key] = Finder(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                yield emit(part, find(part.column(3).to_pylist()))

    return texts.select("field", "row_key", "msg_no", "text").mapInArrow(run, schema)


def find_details(texts: DataFrame, *, rows: int = ROWS) -> DataFrame:
    """(field, row_key, msg_no, start_char, end_char, pii_kind) of texts (field, row_key, msg_no, text), once each."""

    def emit(part: pa.RecordBatch, found: list[list[tuple[int, int, str]]]) -> pa.RecordBatch:
        at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
        flat = [x for f in found for x in f]
        cols = [part.column(i).take(at) for i in range(3)]
        cols += [pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["field", "row_key", "msg_no", "start_char", "end_char", "pii_kind"])

    found = _run(texts, "field string, row_key string, msg_no int, start_char int, end_char int, pii_kind string", emit, rows)
    return found.dropDuplicates(["field", "row_key", "msg_no", "start_char", "pii_kind"])


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, k in found:
        out += [text[at:a], PLACEHOLDER[k]]
        at = b
    return "".join(out) + text[at:]


def redact_details(texts: DataFrame, *, rows: int = ROWS) -> DataFrame:
    """texts with clean_text: each detail replaced with its placeholder, all else as it was."""

    def emit(part: pa.RecordBatch, found: list[list[tuple[int, int, str]]]) -> pa.RecordBatch:
        clean = [redact(t, f) if f else t for t, f in zip(part.column(3).to_pylist(), found, strict=True)]
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(clean, pa.string())], names=["field", "row_key", "msg_no", "clean_text"])

    return _run(texts, "field string, row_key string, msg_no int, clean_text string", emit, rows)
