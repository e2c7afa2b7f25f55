"""Problem 7: values typed freely, mapped to the entries of a canonical list.

A multi-pattern automaton over the canonical names and aliases of a field finds mentions embedded in a value; the longest of
those that don't overlap wins. What is left goes to a token-set similarity that allows for typing errors and abbreviations.

Null and blank values and those spelled exactly as a canonical value give no row. Everything else gives one, with ref_id 0 if
nothing fits or two entries fit equally well. Repeated rows with one key give one row. The list itself must be bounded
(MAX_REFS rows); a longer one raises.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The canonical list is broadcast: about 200 bytes a row, 20 MB in all at most.
MAX_REFS = 100_000
#: Values remembered by a worker; beyond it the memory is emptied. It only saves work.
MEMO = 200_000
#: Words around a name that say nothing about which one is meant, by field.
AFFIXES = {
    "log_entries.vendor": "llc inc co ltd corp and sons invoice the",
    "properties.city": "city of town village the il illinois near in",
    "accounts.neighborhood": "the around near in area neighborhood neighbourhood chi chicago by",
    "log_entries.kind": "the a an",
}


def normal(value: str) -> str:
    """Lower case without accents; everything but letters, digits and & is a space."""
    v = unicodedata.normalize("NFKD", value.lower().replace("&", " and "))
    v = "".join(c for c in v if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w]+|_", " ", v).split())


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between a and b, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        if min(new) > most and min(row) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def is_short_for(a: str, b: str) -> bool:
    """Whether a abbreviates b: shorter, the same first letter, its letters in b's order."""
    if not a or len(a) >= len(b) or a[0] != b[0]:
        return False
    it = iter(b)
    return all(c in it for c in a)


class Matcher:
    """Maps values of one field to ref_id."""

    def __init__(self, field: str, refs: list[tuple[int, str, list[str] | None]]):
        self.affix = set(AFFIXES.get(field, "").split())
        self.names: list[tuple[int, list[str]]] = []
        self.auto = ahocorasick.Automaton()
        seen: dict[str, int] = {}
        for ref, canonical, aliases in sorted(refs, key=lambda r: r[0]):
            for name in [canonical, *(aliases or [])]:
                key = normal(name or "")
                if key and key not in seen:
                    seen[key] = ref
                    self.names.append((ref, key.split()))
                    self.auto.add_word(f" {key} ", (ref, len(key)))
        self.auto.make_automaton()
        self.exact = seen
        self.words = sorted({w for _, ws in self.names for w in ws})
        self.grams: dict[str, list[int]] = {}
        for k, w in enumerate(self.words):
            for g in self._grams(w):
                self.grams.setdefault(g, []).append(k)
        self.by_word: dict[str, list[int]] = {}
        for k, (_, ws) in enumerate(self.names):
            for w in set(ws):
                self.by_word.setdefault(w, []).append(k)
        self._near: dict[str, list[tuple[str, float]]] = {}

    @staticmethod
    def _grams(w: str) -> set[str]:
        p = f"^{w}$"
        return {p[i : i + 2] for i in range(len(p) - 1)} | set(w[:1])

    def near(self, token: str) -> list[tuple[str, float]]:
        """Words of the list that a token may stand for, with a similarity from 0 to 1."""
        got = self._near.get(token)
        if got is None:
            if len(self._near) > MEMO:
                self._near.clear()
            found = {}
            for k in {k for g in self._grams(token) for k in self.grams.get(g, ())}:
                w = self.words[k]
                size = max(len(w), len(token))
                most = 0 if size < 3 else 1 if size < 6 else 3
                d = edits(token, w, most)
                if d <= most:
                    found[w] = 1 - d / size
                elif is_short_for(token, w):
                    found[w] = 0.8
            got = self._near[token] = sorted(found.items())
        return got

    def mention(self, value: str) -> int:
        """ref_id of the longest embedded mention, 0 if there is none or it is ambiguous."""
        if not self.exact:
            return 0
        hits = sorted(((size, end - size, ref) for end, (ref, size) in self.auto.iter(f" {value} ")), key=lambda h: (-h[0], h[1]))
        taken: list[tuple[int, int]] = []
        won: list[tuple[int, int]] = []
        for size, start, ref in hits:
            if all(start >= b or start + size <= a for a, b in taken):
                taken.append((start, start + size))
                won.append((size, ref))
        if not won or (len({r for s, r in won if s == won[0][0]}) > 1):
            return 0
        return won[0][1]

    def similar(self, value: str) -> int:
        """ref_id of the entry whose words best cover the value's, 0 if none does well or two do equally well."""
        tokens = value.split()
        plain = [t not in self.affix for t in tokens]
        # a word that usually says nothing stands for itself only
        near = [dict(self.near(t)) if own else {t: 1.0} if t in self.by_word else {"company": 0.8} if t == "co" and "company" in self.by_word else {} for t, own in zip(tokens, plain, strict=True)]
        sure = {w for n in near for w in n}
        best: dict[int, float] = {}
        for k in {k for w in sure for k in self.by_word[w]}:
            ref, ws = self.names[k]
            free, total, letters = set(range(len(tokens))), 0.0, 0
            for w in ws:
                s, i = max(((near[i].get(w, 0.0), -i) for i in free), default=(0.0, 0))
                if not s:
                    total = -1
                    break
                total += s
                letters += len(tokens[-i])
                free.discard(-i)
            if total < 0 or letters < 2:  # a single letter names nothing
                continue
            score = total / len(ws) - 0.3 * sum(plain[i] for i in free)
            best[ref] = max(best.get(ref, 0.0), score)
        top = sorted(best.items(), key=lambda b: (-b[1], b[0]))
        if not top or top[0][1] < 0.62 or len(top) > 1 and top[0][1] - top[1][1] < 0.02:
            return 0
        return top[0][0]

    def match(self, value: str) -> int:
        v = normal(value)
        if not v:
            return 0
        return self.exact.get(v) or self.mention(v) or self.similar(v)


#: Automata of a worker, by the token of the call that they are for.
_TOOLS: dict[str, dict] = {}


def map_values(rows: DataFrame, refs: DataFrame, fields: dict[str, str], key: str = "id") -> DataFrame:
    """(field, row_key, value, ref_id) for the free values of rows. fields: name in refs.field -> column of rows."""
    listed = refs.filter(F.col("field").isin(*fields)).select("ref_id", "field", "canonical", "aliases").limit(MAX_REFS + 1).collect()
    if len(listed) > MAX_REFS:
        raise ValueError(f"the canonical list has more than {MAX_REFS} rows")
    by: dict[str, list[tuple[int, str, list[str] | None]]] = {f: [] for f in fields}
    for r in listed:
        if r.canonical is not None:
            by[r.field].append((r.ref_id, r.canonical, r.aliases))
    names, token = list(fields), uuid.uuid4().hex
    shared = rows.sparkSession.sparkContext.broadcast(by)  # at most MAX_REFS rows, sent once to an executor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _TOOLS.get(token)
        if tools is None:  # a worker builds its automata once for all its tasks
            _TOOLS.clear()
            tools = _TOOLS[token] = {f: (Matcher(f, shared.value[f]), {c for _, c, _ in shared.value[f]}, {}) for f in names}
        for b in batches:
            keys = b.column(0).to_pylist()
            for i, f in enumerate(names, 1):
                matcher, canonical, memo = tools[f]
                out_k, out_v, out_r = [], [], []
                for k, v in zip(keys, b.column(i).to_pylist(), strict=True):
                    if k is None or v is None or v in canonical or not v.strip():
                        continue
                    ref = memo.get(v)
                    if ref is None:
                        if len(memo) > MEMO:
                            memo.clear()
                        ref = memo[v] = matcher.match(v)
                    out_k.append(k)
                    out_v.append(v)
                    out_r.append(ref)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * len(out_k), pa.string()), pa.array(out_k, pa.string()), pa.array(out_v, pa.string()), pa.array(out_r, pa.int64())],
                    names=["field", "row_key", "value", "ref_id"],
                )

    text: list[Column] = [F.col(key).cast("string"), *(F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(fields.values()))]
    # rows without a free value are left out before Python; several spellings under one key: the first in order counts
    mapped = rows.select(*text).mapInArrow(run, "field string, row_key string, value string, ref_id long")
    return mapped.groupBy("field", "row_key").agg(F.min_by("ref_id", "value").alias("ref_id"), F.min("value").alias("value")).select("field", "row_key", "value", "ref_id")
