"""Problem 3: transcripts into clean, ordered speaker turns.

A transcript is read as timed segments (JSON of several shapes, else stamped cues in the text), put in time order, with repeated
copies dropped. Boosted trees decide at every pair of adjacent segments, and wherever something within one may be a label or a mark of change,
whether the speaker changes there: from the form of what stands there, how its words compare with the names (none of the comparisons
decides by itself), the gap before it and its context. Labels are then normalised to the document's speakers. Annotations are dropped. Words that can
be fillers are told from the same words in earnest by a second set of trees, token by token, from the word, its marks and its neighbours.

Documents without speakers, segments and stamps give no turn, as do error messages in place of a transcript. Null texts and JSON
that can't be read count as missing. Speech before any label is the host's. Repeated rows give repeated turns.
"""

from __future__ import annotations

import json
import random
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canonical import edits
from .gbdt import Boosted
from .pages import FUNCTION_WORDS
from .pii_labels import Filler

#: Labelled transcripts from which the trees are trained on the driver.
TRAIN_TRANSCRIPTS = 240
#: Labelled sentences from which the trees for fillers are trained.
TRAIN_SENTENCES = 6000

#: Words that can be fillers, English and Spanish; the first six only in part.
FILLERS = ("you know", "i mean", "o sea", "like", "este", "pues", "um", "umm", "uh", "uhm", "er", "erm", "ah", "eh", "mm", "hmm", "mhm")
_FILLER = re.compile(r"(?i)(?<![\w'’-])(?:" + "|".join(f.replace(" ", r"\s+") for f in FILLERS) + r")(?![\w'’-]),?")
_ANNOTATION = re.compile(r"\[[^\]\n]{0,60}\]|\([^()\n\d]{1,60}\)|\*[^*\n]{1,40}\*|<[^<>\n]{1,60}>|[♪♫]+")
_WORD = re.compile(r"[^\W_]")
_STAMP = re.compile(
    r"(?m)^[ \t]*(?:\d+[ \t]*\r?\n[ \t]*)?(?P<a>\d{1,3}:\d{2}:\d{2}[.,]\d{1,3}|\d{1,2}:\d{2}[.,]\d{3})[ \t]*-->[^\n]*\n?"
    r"|(?m:^)[ \t]*[\[(]?(?P<b>\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?)[\])]?[ \t]*(?:[-–—|][ \t]+|:[ \t]+)?(?=[ \t\r\n\S]|$)"
)
#: What may be a label or a mark of change.
_MARK = re.compile(r">>+|<v[ .][^<>\n]{1,60}>|\[[^\]\n]{1,40}\]|\([^()\n]{1,40}\)|(?<=[\w.])[ \t]?:(?!\d)|(?<=[\w.])[ \t]+[-–—](?=[ \t])")
_NAME_WORDS = re.compile(r"[^\W\d_][\w'’-]*\.?")
_HOST = {"host", "anfitrion", "anfitriona", "presentador", "presentadora", "conductor", "conductora", "moderator", "moderador"}
_CUE_TEXT = re.compile(r"(?i)^\s*(?:kind|language|webvtt|note)\b.*$")


def seconds(stamp: str) -> float:
    total = 0.0
    for part in stamp.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def segments(text: str | None, raw: str | None) -> list[tuple[int, str]]:
    """(start in ms, text) in time order, repeated copies dropped; empty if nothing is timed."""
    try:
        found = json.loads(raw) if raw else []
    except ValueError:
        found = []
    if isinstance(found, dict):
        found = found.get("segments") or found.get("snippets") or next((v for v in found.values() if isinstance(v, list)), [])
    out: list[tuple[int, str]] = []
    for s in found if isinstance(found, list) else []:
        if isinstance(s, dict) and isinstance(s.get("text"), str) and s["text"].strip():
            try:
                out.append((round(float(s.get("start")) * 1000), s["text"].strip()))
            except (TypeError, ValueError, OverflowError):
                continue
    if not out and text:
        stamps = list(_STAMP.finditer(text))
        for m, nxt in zip(stamps, [*stamps[1:], None]):  # noqa: B905
            said = text[m.end() : nxt.start() if nxt else len(text)].strip()
            if said:
                out.append((round(seconds(m["a"] or m["b"]) * 1000), " ".join(said.split())))
    seen: set[tuple[int, str]] = set()
    kept = []
    for s in sorted(out, key=lambda s: s[0]):  # stable: equal times keep their order
        if s not in seen:
            seen.add(s)
            kept.append(s)
    return kept


def near(a: str, b: str) -> bool:
    """One typing error apart at most, in a word of five letters or more that begins or ends alike."""
    return len(a) >= 5 and abs(len(a) - len(b)) < 2 and (a[:2] == b[:2] or a[-2:] == b[-2:]) and edits(a, b, 1) <= 1


def fold(name: str) -> list[str]:
    plain = name.lower()
    if not plain.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
    return re.findall(r"[\w'’-]+", plain)


class Speakers:
    """Names of one recording, host first."""

    def __init__(self, names: list[str]):
        self.names = names
        self.parts = [fold(n) for n in names]
        self.memo: dict[str, tuple[float, int]] = {}
        self.compared: dict[str, tuple[int, ...]] = {}

    def compare(self, label: str) -> tuple[int, ...]:
        """How the words of a label compare with the names, each by itself: speakers that have the first word, the last, one nearly, by an initial; the host's word; all words a name."""
        got = self.compared.get(label)
        if got is None:
            w = fold(label)
            if not w or len(w) > 5:
                got = (0,) * 6
            else:
                parts = [p for p in self.parts if p]
                got = (
                    sum(w[0] in p for p in parts), sum(w[-1] in p for p in parts), sum(near(w[0], q) or near(w[-1], q) for p in parts for q in (p[0], p[-1])),
                    sum(len(w[0]) == 1 and w[0] == p[0][:1] or len(w[-1]) == 1 and w[-1] == p[-1][:1] for p in parts), int(w[0] in _HOST), sum(w == p for p in parts),
                )
            self.compared[label] = got
        return got

    def match(self, label: str) -> tuple[float, int]:
        """How well a label names a speaker (0 to 1), and which; a label that fits two equally is worth less."""
        got = self.memo.get(label)
        if got is None:
            got = self.memo[label] = self._match(fold(label))
        return got

    def _match(self, words: list[str]) -> tuple[float, int]:
        if not words or len(words) > 4:
            return 0.0, -1
        if len(words) == 1 and words[0] in _HOST:
            return 0.95, 0
        scores = []
        for i, parts in enumerate(self.parts):
            if not parts:
                continue
            if words == parts:
                s = 1.0
            elif len(words) == 1:
                w = words[0]
                s = 0.9 if w in (parts[0], parts[-1]) else 0.8 if w in parts else 0.7 if near(w, parts[0]) or near(w, parts[-1]) else 0.0
            else:
                a, b = words[0], words[-1]
                first = 1.0 if a == parts[0] else 0.9 if len(a) == 1 and a == parts[0][:1] else 0.7 if near(a, parts[0]) else 0.0
                last = 1.0 if b == parts[-1] else 0.9 if len(b) == 1 and b == parts[-1][:1] else 0.7 if near(b, parts[-1]) else 0.0
                s = min(first, last) if max(first, last) >= 0.7 and max(len(a), len(b)) > 1 else 0.0
                if not s and set(words) <= set(parts):
                    s = 0.8
            scores.append((s, -i))
        scores.sort(reverse=True)
        if not scores or not scores[0][0]:
            return 0.0, -1
        best, tie = scores[0], len(scores) > 1 and scores[1][0] == scores[0][0]
        return (best[0] - 0.25 if tie else best[0]), -best[1]


ARTICLES = frozenset("a an the el la los las un una unos unas".split())
FORMS = ("arrows", "voice", "square", "round", "colon", "dash", "none")
NONE = (0,) * 6


class Transcript:
    """Joined segments with the places where the speaker may change."""

    def __init__(self, segs: list[tuple[int, str]], speakers: list[str]):
        self.starts, at, parts = [], 0, []
        for _, said in segs:
            self.starts.append(at)
            parts.append(said)
            at += len(said) + 1
        self.text, self.ms = " ".join(parts), [ms for ms, _ in segs]
        self.who = Speakers(speakers)
        found = [c for m in _MARK.finditer(self.text) if (c := self._mark(m))]
        # adjacent segments with nothing between them are decided on as well
        begun = {self.starts[self.segment(c[0])] for c in found if c[0] - self.starts[self.segment(c[0])] < 3}
        bare = [(at, at, 6, 0.0, -1, 0) for at in self.starts[1:] if at not in begun]
        self.marks = sorted(found + bare, key=lambda c: c[0])
        self.loose = [(m.start(), m.end()) for m in _FILLER.finditer(self.text)]
        self.drop: dict[int, int] = dict(self.loose)

    def segment(self, at: int) -> int:
        return max(0, bisect_right(self.starts, at) - 1)

    def _mark(self, m: re.Match) -> tuple | None:
        """(start, end, form, quality, speaker, words of the label)"""
        g, text = m.group(), self.text
        if g[0] == ">":
            return m.start(), m.end(), 0, 0.0, -1, 0
        if g[0] == "<":
            return m.start(), m.end(), 1, *self.who.match(g[2:-1]), 2
        if g[0] in "[(":
            q, who = self.who.match(g[1:-1])
            return (m.start(), m.end(), 2 if g[0] == "[" else 3, q, who, len(g.split())) if q else None
        form = 4 if g.strip() == ":" else 5
        before = [w for w in _NAME_WORDS.finditer(text, max(0, m.start() - 60), m.start())]
        best = (0.0, -1, m.start(), 0)
        for n in range(1, min(4, len(before)) + 1):
            a = before[-n].start()
            label = text[a : m.start()]
            if not re.fullmatch(r"[\w'’.\- ]+", label):
                break
            q, who = self.who.match(label)
            if q >= best[0] and q:
                best = (q, who, a, n)
        if form == 5 and best[0] == 0 or form == 4 and not before:
            return None
        return best[2], m.end(), form, best[0], best[1], best[3]

    def features(self) -> np.ndarray:
        """Of every place: form, words, place in the segment, gap, context, and the comparisons of the label's words with the names."""
        out, text = [], self.text
        prev_end = -1
        ended = sum(text[at - 2 : at - 1] in ".!?" for at in self.starts[1:]) / max(1, len(self.starts) - 1)  # how far the transcript has marks at all
        labelled = sum(m[2] < 6 and m[3] > 0 for m in self.marks) / len(self.starts)
        for a, b, form, quality, _, words in self.marks:
            k = self.segment(a)
            label = text[a:b]
            lead = text[max(0, a - 3) : a].rstrip()
            gap = (self.ms[k] - self.ms[k - 1]) / 1000 if k else 0.0
            tail = text[b : b + 2].lstrip()
            same = self.who.compare(label.strip("[]()<>:-–— \tv")) if form not in (0, 6) else NONE
            out.append(
                (
                    form, words, a == self.starts[k], min(gap, 30.0), not lead or lead[-1] in ".!?…", lead[-2:] == ">>", lead[-1:] in ("-", "–"), label[:1].isupper(),
                    label.isupper(), tail[:1].isupper(), len(self.who.names), a - prev_end < 3, len(label), ended, labelled, *same,
                )
            )
            prev_end = b if form != 6 else prev_end
        return np.array(out, np.float64).reshape(len(out), 21)

    def filler_features(self) -> np.ndarray:
        """Of every word that can be a filler: which, its marks, and its neighbours."""
        out, text, last = [], self.text, -9
        for i, (a, b) in enumerate(self.loose):
            said = text[a:b]
            before, after = text[max(0, a - 24) : a].split(), text[b : b + 24].split()
            prev, nxt = (before[-1] if before else ""), (after[0] if after else "")
            out.append(
                (
                    FILLERS.index(" ".join(said.lower().rstrip(",").split())), said.endswith(","), prev[-1:] == ",", not prev or prev[-1] in ".!?…:>)]", said[:1].isupper(), prev.lower().strip(",.") in FUNCTION_WORDS, prev.lower() in ARTICLES,
                    nxt.lower().strip(",.") in FUNCTION_WORDS, a - last < 3, i + 1 < len(self.loose) and self.loose[i + 1][0] - b < 3, a == self.starts[self.segment(a)], nxt[:1].isupper(), not nxt or nxt[0] in ".,;",
                )
            )
            last = b
        return np.array(out, np.float64).reshape(len(out), 13)


def synthetic(count: int, seed: int) -> list[tuple[Transcript, list[bool]]]:
    """Labelled transcripts of invented speakers and words: of each mark, whether it is a speaker's label."""
    r, f = random.Random(seed), Filler(seed)
    out = []
    for _ in range(count):
        names = [f"{f.word(1, 3)} {f.surname()}" for _ in range(r.choice([2, 2, 2, 3, 4]))]
        full = r.random() < 0.6
        segs, truth, ms, at = [], set(), r.randint(0, 9000), 0
        for _turn in range(r.randint(4, 14)):
            n = r.choice(names)
            first, last = n.split()[0], n.split()[-1]
            label = r.choice(
                [f"{first}:", f"{first.lower()}:", f"{first.upper()}:", f"{n}:", f"{n.upper()} :", f"{first[0]}. {last}:", f"{first} {last[0]}.:", f"- {last}:", f"{n} -", f"[{first}]", f"({last.upper()})", f"<v {n}>", f">> {first.upper()}:", f">>{n}:", ">>", "Host:", "[Host]", "HOST:"]
            )
            said = []
            for _s in range(r.randint(1, 3)):
                p = f.prose()
                k = r.random()
                if k < 0.25:
                    p = r.choice(["Note: ", "Step two: ", "Quick question: ", "so bottom line: ", "Here's the thing: ", f"{f.word().lower()} {f.word().lower()}: ", f"{f.word()}: "]) + p
                elif k < 0.33 and full:  # told of somebody, in a text that has marks
                    p += " and " + r.choice(["I told", "he said to", "we asked", "then came", "so I wrote to", "thanks to"]) + f" {r.choice(names).split()[r.choice([0, -1])]}" + r.choice([": ", ": ", " - "]) + f.prose().lower()
                elif k < 0.4:
                    p += r.choice([" (laughs)", " [music]", " *door slams*", " [Applause]", f" as {r.choice(names).split()[0]} said", f" {f.word().lower()} - {f.word().lower()}", f" {r.choice(names).split()[0]} and {f.word()}"])
                said.append(p + ("." if full and r.random() < 0.9 else ""))
            words = " ".join(said)
            cut = r.random() < 0.7
            pieces = [label + " " + words] if cut or not segs else []
            if not pieces:  # in the middle of a segment
                ms0, last_text = segs.pop()
                at -= len(last_text) + 1
                pieces = [last_text + " " + label + " " + words]
                base = len(last_text) + 1
            else:
                base = 0
            truth.add(at + base + len(label))
            if r.random() < 0.2:  # read matter between, with marks in any transcript
                pieces.append(f"{f.word()} {f.prose().lower()}.")
            for p in pieces:
                segs.append((ms, p))
                at += len(p) + 1
                ms += r.randint(1500, 9000)
        t = Transcript(segs, names)
        out.append((t, [m[2] == 0 or m[2] < 6 and m[1] in truth for m in t.marks]))
    return out


def synthetic_fillers(count: int, seed: int) -> list[tuple[Transcript, list[bool]]]:
    """Labelled sentences of invented words: of each word that can be a filler, whether it is one."""
    r, f = random.Random(seed), Filler(seed)
    earnest = (
        "it looked like {w} {w}|it was nothing like the {w} {w}|Like every {w} it {w}|de este {w} y {w}|en este {w} y en {c} {w}|Este {w} {w} fue de la {w}|por este {w} {w}|do you know {w} or {w}|"
        "what I mean is {w}|did I mean {w}|that feels like a {w}|would like to {w} it|Did you know {w} then"
    ).split("|")
    common = "the a of to and for in on with is was el la de un y en que por se".split()
    out = []
    for _ in range(count):
        k = r.random()
        words = f.prose().split()
        if r.random() < 0.5:
            words = " ".join(words).lower().split()
        marks: list[str] = list(words)
        if k < 0.85:
            for _n in range(r.choice([1, 1, 2])):
                at = r.randint(0, len(marks))
                x = r.choice(FILLERS).replace("i mean", "I mean")
                if r.random() < 0.1 and at == 0:
                    x = x.capitalize()
                marks.insert(at, "\0" + x + r.choice(["", "", ","] if x in ("um", "uh") or r.random() < 0.4 else [""]) if not x[0].isupper() or x == "I mean" else "\0" + x + ",")
        else:
            said = re.sub(r"\{(\w)\}", lambda m: r.choice(common) if m.group(1) == "c" else f.word(1, 3).lower(), r.choice(earnest))
            marks = (marks[: r.randint(0, 3)] if not said[0].isupper() else []) + said.split() + marks[:4]
        text, at, truth = "", 0, set()
        for w in marks:
            if w[0] == "\0":
                truth.add(len(text))
                w = w[1:]
            text += w + " "
        t = Transcript([(0, text.strip() + r.choice(["", "."]))], ["A B"])
        out.append((t, [a in truth for a, _ in t.loose]))
    return out


@cache
def trained(count: int = TRAIN_TRANSCRIPTS, seed: int = 21) -> Boosted:
    table = synthetic(count, seed)
    x = np.concatenate([t.features() for t, _ in table])
    y = np.concatenate([np.array(truth, bool) for _, truth in table])
    return Boosted().fit(x, y)


@cache
def trained_fillers(count: int = TRAIN_SENTENCES, seed: int = 22) -> Boosted:
    table = synthetic_fillers(count, seed)
    x = np.concatenate([t.filler_features() for t, _ in table])
    y = np.concatenate([np.array(truth, bool) for _, truth in table])
    return Boosted(bins=32).fit(x, y)


def first_word(t: Transcript, lo: int, hi: int) -> int:
    """Where the first word of speech in the transcript's text[lo:hi] begins, or -1."""
    at, text = lo, t.text
    while at < hi:
        m = _WORD.search(text, at, hi)
        if not m:
            return -1
        # what stands before the word may open an annotation that holds it
        note = _ANNOTATION.search(text, at, hi)
        if note and note.start() < m.start():
            at = note.end()
            continue
        end = t.drop.get(m.start(), 0)
        if not end or end > hi:
            return m.start()
        at = end
    return -1


def clean(t: Transcript, lo: int, hi: int) -> str:
    """Speech in text[lo:hi] without annotations and fillers."""
    parts, at = [], lo
    for a, b in t.loose[bisect_left(t.loose, (lo, 0)) :]:
        if b > hi:
            break
        if a in t.drop:
            parts.append(t.text[at:a])
            at = b
    parts.append(t.text[at:hi])
    out = _ANNOTATION.sub(" ", " ".join(parts).replace(">>", " "))
    return re.sub(r"\s+([,.;:!?])", r"\1", " ".join(out.split())).strip(" -–—,")


def turns(t: Transcript, keep: np.ndarray, text: bool = True) -> list[tuple[int, str, str | None]]:
    """(start in ms, speaker, clean text if wanted), given which marks count."""
    two = len(t.who.names) == 2
    stops = [(m, k) for m, k in zip(t.marks, keep, strict=True)]
    runs: list[list] = []  # speaker, ms, [texts]
    speaker, pending, at = -1, -1, 0
    spans: list[tuple[int, int, int | None]] = []  # start, end, what a mark before the span asks for
    ask: int | None = None
    for (a, b, form, _, who, _), k in stops:
        if not k or a < at or form == 6:  # a change that nothing names goes on with the present speaker
            continue
        spans.append((at, a, ask))
        at, ask = b, (-2 if form == 0 else who)
        if form != 0 and who < 0:
            ask = None
    spans.append((at, len(t.text), ask))
    for lo, hi, want in spans:
        if want is not None:
            if want == -2:
                pending = (1 - speaker if speaker >= 0 else pending) if two else pending
            else:
                pending = want
        w = first_word(t, lo, hi)
        if w < 0:
            continue
        now = pending if pending >= 0 else speaker if speaker >= 0 else 0
        pending = -1
        if now != speaker or not runs:
            runs.append([now, t.ms[t.segment(w)], []])
            speaker = now
        runs[-1][2].append((lo, hi))
    return [(ms, t.who.names[who], " ".join(clean(t, *x) for x in said) if text else None) for who, ms, said in runs]


_SCHEMA = "doc_id long, turn_no int, start_ms long, speaker string, text string"


def speaker_turns(docs: DataFrame, *, transcripts: int = TRAIN_TRANSCRIPTS, text: bool = True) -> DataFrame:
    """Turns of the recordings among docs (doc_id, kind, text, segments_json, speakers); without text, text is null."""
    docs = docs.filter("kind <> 'website' and size(speakers) > 0").select("doc_id", "text", "segments_json", "speakers")
    shared = docs.sparkSession.sparkContext.broadcast((trained(transcripts), trained_fillers()))  # some 100 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, filler_trees = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                ids, read = [], []
                for i, text, raw, names in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                    segs = segments(text, raw)
                    names = [n for n in names if n and n.strip()]
                    if segs and names:
                        ids.append(i)
                        read.append(Transcript(segs, names))
                x = [t.features() for t in read]
                p = trees.predict(np.concatenate(x)) > 0.5 if x else np.zeros(0, bool)
                x = [t.filler_features() for t in read]
                filler = filler_trees.predict(np.concatenate(x)) > 0.5 if x else np.zeros(0, bool)
                at = 0
                for t in read:
                    t.drop = {a: e for (a, e), yes in zip(t.loose, filler[at : at + len(t.loose)], strict=True) if yes}
                    at += len(t.loose)
                at, rows = 0, []
                for i, t in zip(ids, read, strict=True):
                    n = len(t.marks)
                    rows += [(i, k, *turn) for k, turn in enumerate(turns(t, p[at : at + n], text))]
                    at += n
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "turn_no", "start_ms", "speaker", "text"])

    return docs.mapInArrow(run, _SCHEMA)
