"""Problem 1: cut oversized items into overlapping passages at natural boundaries.

Every word end is a boundary. Each boundary is joined to its farthest legal successor: the last natural boundary (end of a
sentence, line or paragraph) no more than limit - overlap words on, or the word exactly that far on where there is none. A boundary
that leaves a passage with fewer than FRESH words of its own doesn't count, unless the item ends there. The
successor table is then squared again and again (pointer doubling), so that all cuts of a greedy walk are known after
log2(cuts) rounds, for all items of a batch at once, without walking any of them.

Null and blank texts give no passage. Repeated rows give repeated passages. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

LIMIT, OVERLAP, FRESH = 350, 60, 30
#: Code points of text scanned at once; bounds the memory of a task. One text is never cut for it.
BLOCK_CHARS = 4_000_000

_STAMP = re.compile(r"(?m)^[ \t]*[\[(]?(?:(\d{1,3}):)?(\d{1,3}):(\d{2})(?:[.,](\d{1,3}))?[\])]?(?=$|[ \t\r]|\s*-->)")
_AT = {W.PLAIN: "word", W.SENTENCE: "sentence", W.LINE: "line", W.PARAGRAPH: "paragraph"}


def greedy_cuts(item: np.ndarray, natural: np.ndarray, limit: int, overlap: int, fresh: int = 1) -> np.ndarray:
    """Word ends (indices one past the word) at which the greedy walk cuts each item, by pointer doubling.

    item: of each word, non-decreasing. natural: whether a natural boundary follows the word. fresh: words that a passage must have of its own
    to end at one. The end of an item is a cut.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    n = len(item)
    if not n:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
    stop = np.append(first[1:], n)
    end = np.repeat(stop, stop - first)
    # floor[i]: the last natural boundary at or before i, as a word end
    floor = np.maximum.accumulate(np.concatenate(([0], np.where(natural, np.arange(1, n + 1), 0))))
    at = np.arange(n + 1)
    bound = np.append(end, n)  # of a cut at i the item's end; only cuts inside an item are looked up
    reach = np.minimum(at + (limit - overlap), bound)
    succ = np.where(reach == bound, bound, np.where(floor[reach] >= at + fresh, floor[reach], reach))
    succ[stop] = stop  # item ends point to themselves
    reach0 = np.minimum(first + limit, stop)
    root = np.where(reach0 == stop, stop, np.where(floor[reach0] >= first + fresh, floor[reach0], reach0))
    cuts = np.unique(root)
    while True:
        more = np.unique(np.concatenate((cuts, succ[cuts])))
        if len(more) == len(cuts):
            return cuts
        cuts, succ = more, succ[succ]


def pieces(texts: list[str | None], limit: int, overlap: int, unit: str, oversized_only: bool) -> dict[str, np.ndarray]:
    """Pieces of all texts: doc (index), para, piece, start, end (code points), n_words, at."""
    w = W.scan(texts)
    item = w.doc.astype(np.int64)
    if unit == "paragraph":
        item = np.cumsum(np.append(0, (w.doc[1:] != w.doc[:-1]) | (w.para[1:] != w.para[:-1]))) if len(w.doc) else item
    elif unit != "document":
        raise ValueError("unit must be document or paragraph")
    if oversized_only and len(item):
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        sizes = np.diff(np.append(first, len(item)))
        keep = np.repeat(sizes > limit, sizes)
        w = W.Words(w.doc[keep], w.start[keep], w.end[keep], w.after[keep], w.para[keep])
        item = item[keep]
    cuts = greedy_cuts(item, w.after > W.PLAIN, limit, overlap, max(1, min(FRESH, (limit - overlap) // 4)))
    last = cuts - 1
    of = item[last] if len(cuts) else item
    new = np.append(True, of[1:] != of[:-1]) if len(cuts) else np.zeros(0, bool)
    item_first = np.searchsorted(item, of)
    begin = np.where(new, item_first, np.append(0, cuts[:-1] - overlap)) if len(cuts) else cuts
    begin = np.maximum(begin, item_first)
    number = np.arange(len(cuts)) - np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(cuts))))
    return {
        "doc": w.doc[last] if len(cuts) else cuts, "para": w.para[begin] if len(cuts) else cuts, "piece": number, "start": w.start[begin] if len(cuts) else cuts,
        "end": w.end[last] if len(cuts) else cuts, "n_words": cuts - begin, "at": w.after[last] if len(cuts) else cuts,
    }


def _segments(raw: str | None) -> list[tuple[float, str]]:
    """(start, text) of JSON segments: a list, or an object holding one; numbers may be strings; anything unusable is left out."""
    try:
        found = json.loads(raw) if raw else []
    except ValueError:
        return []
    if isinstance(found, dict):
        found = found.get("segments") or found.get("snippets") or next((v for v in found.values() if isinstance(v, list)), [])
    out = []
    for s in found if isinstance(found, list) else []:
        if isinstance(s, dict) and isinstance(s.get("text"), str) and s["text"].strip():
            try:
                out.append((float(s.get("start")), s["text"]))
            except (TypeError, ValueError):
                continue
    return out


def time_index(text: str, raw: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points at which timed segments (else stamped cues) of a transcript begin, ascending, and their seconds."""
    at, secs, cursor = [], [], 0
    segs = _segments(raw)
    for start, said in sorted(segs, key=lambda s: s[0]):
        k = text.find(said.strip(), cursor)
        if k >= 0:
            at.append(k)
            secs.append(start)
            cursor = k + len(said.strip())
    if not segs:
        for m in _STAMP.finditer(text):
            h, mi, s, frac = m.groups()
            if text.rfind("-->", max(0, m.start() - 6), m.start()) >= 0:
                continue
            at.append(m.start())
            secs.append(int(h or 0) * 3600 + int(mi) * 60 + int(s) + (int(frac.ljust(3, "0")) / 1000 if frac else 0.0))
    return np.array(at, np.int64), np.array(secs, np.float64)


_SCHEMA = "doc_id long, para_no int, piece_no int, start_char int, end_char int, start_time double, n_words int, cut_at string"


def split_oversized(docs: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP, unit: str = "document", oversized_only: bool = False) -> DataFrame:
    """Passages of documents (doc_id, text, kind, segments_json), or of each of their paragraphs.

    Each passage has at most `limit` words, begins with the last `overlap` words of the one before and ends at the farthest
    natural boundary that the limit allows, else after a word (cut_at tells which). start_char and end_char are code points of
    text. start_time is, for recordings, the start of the timed segment or stamped cue that holds the first word, else null.
    para_no is that of the passage's first word. oversized_only leaves out items within the limit.
    """
    cols = ["doc_id", "text", "kind", "segments_json"]
    docs = docs.select(*(F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in cols))
    if oversized_only:  # n words need n - 1 white spaces between them
        docs = docs.filter(F.length("text") >= 2 * limit + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, kinds, segs = (b.column(i).to_pylist() for i in range(4))
            lo = 0
            while lo < len(ids):
                hi, size = lo, 0
                while hi < len(ids) and (hi == lo or size + len(texts[hi] or "") <= BLOCK_CHARS):
                    size += len(texts[hi] or "")
                    hi += 1
                p = pieces(texts[lo:hi], limit, overlap, unit, oversized_only)
                if len(p["doc"]):
                    times = np.full(len(p["doc"]), np.nan)
                    for d in np.unique(p["doc"]):
                        if (kinds[lo + d] or "website") != "website":
                            where, secs = time_index(texts[lo + d], segs[lo + d])
                            if len(where):
                                mine = np.flatnonzero(p["doc"] == d) if len(p["doc"]) < 64 else np.arange(*np.searchsorted(p["doc"], [d, d + 1]))
                                k = np.searchsorted(where, p["start"][mine], side="right") - 1
                                times[mine] = np.where(k >= 0, secs[np.maximum(k, 0)], secs[0])
                    i32 = lambda a: pa.array(a.astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[lo + d] for d in p["doc"]], pa.int64()), i32(p["para"]), i32(p["piece"]), i32(p["start"]), i32(p["end"]),
                            pa.array(times, mask=np.isnan(times)), i32(p["n_words"]), pa.array([_AT[a] for a in p["at"]]),
                        ],
                        names=["doc_id", "para_no", "piece_no", "start_char", "end_char", "start_time", "n_words", "cut_at"],
                    )
                lo = hi

    return docs.mapInArrow(run, _SCHEMA)


def oversized_paragraphs(docs: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, para_no) of the paragraphs that had to be cut, once each."""
    cut = split_oversized(docs, limit=limit, overlap=overlap, unit="paragraph", oversized_only=True)
    return cut.filter("piece_no = 1").select("doc_id", "para_no")
