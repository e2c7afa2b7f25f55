"""Offsets of words, lines and paragraphs over a batch of texts, with numpy.

A word is a run of characters between white space of any Unicode kind; positions are in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(0x3002, dtype=bool)
_SPACE[[c for c in range(0x3002) if chr(c).isspace()]] = True
_SENTENCE_END = np.zeros(0x2100, dtype=bool)
_SENTENCE_END[[ord(c) for c in ".!?…"]] = True
_CLOSER = np.zeros(0x2100, dtype=bool)
_CLOSER[[ord(c) for c in "\"')]}»”’"]] = True

#: What follows a word: nothing special, the end of a sentence, of a line, of a paragraph.
PLAIN, SENTENCE, LINE, PARAGRAPH = 0, 1, 2, 3


@dataclass
class Words:
    """Words of a batch of texts, in order. doc: index of the text; start, end: code points within it; after: see above."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    after: np.ndarray
    para: np.ndarray


def _in(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return table[np.minimum(codes, len(table) - 1)] & (codes < len(table))


def scan(texts: list[str | None]) -> Words:
    """All words of the texts. None counts as an empty text."""
    # a newline between texts separates their words; its own position belongs to no text
    parts = [t or "" for t in texts]
    sizes = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
    bases = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1] if len(parts) else np.zeros(0, np.int64)
    codes = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = _in(_SPACE, codes)
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        e = np.zeros(0, np.int64)
        return Words(e, e, e, e.astype(np.int8), e)
    doc = np.searchsorted(bases, starts, side="right") - 1
    lines = np.cumsum(codes == 10)
    last = np.append(doc[1:] != doc[:-1], True)
    nxt = np.append(starts[1:], starts[-1])
    gaps = np.where(last, 2, lines[nxt] - lines[ends - 1])
    tail = codes[ends - 1]
    closed = _in(_CLOSER, tail) & (ends - starts > 1)
    tail = np.where(closed, codes[np.maximum(ends - 2, 0)], tail)
    after = np.where(gaps >= 2, PARAGRAPH, np.where(gaps == 1, LINE, np.where(_in(_SENTENCE_END, tail), SENTENCE, PLAIN))).astype(np.int8)
    breaks = np.concatenate(([0], np.cumsum(after[:-1] == PARAGRAPH)))
    first = np.append(True, doc[1:] != doc[:-1])
    para = breaks - np.repeat(breaks[first], np.diff(np.append(np.flatnonzero(first), len(doc))))
    base = bases[doc]
    return Words(doc, starts - base, ends - base, after, para)
