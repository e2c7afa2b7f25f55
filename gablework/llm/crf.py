"""A linear-chain conditional random field: trained by Adam on small tables, decoded by Viterbi in numpy batches.

Every feature belongs to one token (its word, shape, affixes) seen from a distance of up to three tokens, or to the pair of shapes
of two neighbours. The score of a token is thus a sum of rows that are computed once for each distinct token and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

TOKEN = re.compile(r"\d{1,3}(?:,\d{3})+(?!\w)|[+#]?\w(?:[\w@+.'’/\-–—]*\w)?|\S")
#: Weights are the mean of those after each of the last epochs.
AVERAGED = 5
#: Sentences in which a word must stand to have features of its own; invented names must not.
KNOWN = 5
REACH = (-3, -2, -1, 0, 1, 2, 3)
#: Distinct tokens remembered by a worker before the memory is emptied; it only saves work.
MEMO = 300_000


def tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text)]


def shape(word: str) -> str:
    """Classes of characters, runs longer than four cut: Xxxxx, ddd-ddd-dddd."""
    s = "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else "-" if c in "–—-" else c for c in word)
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1", s)


def brief(word: str) -> str:
    """The shape with every run cut to one; digits keep a run length of up to five."""
    return re.sub(r"([Xx@.'’/+_#-])\1+", r"\1", re.sub(r"d{5,}", "ddddd", shape(word)))


def token_features(word: str, near: bool, at: int, known: set[str]) -> list[str]:
    """known: the words with a feature of their own; all others share one for each brief shape."""
    low, b = word.lower(), brief(word)
    out = [f"{at}w={low}" if low in known else f"{at}u={b}", f"{at}b={b}"]
    if near:
        out += [f"{at}s={shape(word)}", f"{at}n={min(len(low), 9)}"]
        if "@" in low[1:-1]:
            out.append("0@")
        digits = sum(c.isdigit() for c in low)
        out.append(f"0d={min(digits, 12)}")
    return out


class Crf:
    def __init__(self, labels: Sequence[str]):
        self.labels = list(labels)
        self.index: dict[str, int] = {}
        self.known: set[str] = set()
        self.weights = np.zeros((0, len(self.labels)), np.float32)
        self.trans = np.zeros((len(self.labels), len(self.labels)), np.float32)
        self.start = np.zeros(len(self.labels), np.float32)
        self._reset()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[:1] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def _reset(self) -> None:
        k = len(self.labels)
        self._types: dict[str, int] = {}
        self._shapes: dict[str, int] = {}
        self._shape_of = np.zeros(1024, np.int32)
        self._rows = np.zeros((1024, len(REACH), k), np.float32)
        self._pairs: dict[int, int] = {}
        self._pair_rows = np.zeros((256, 2, k), np.float32)

    # features of one sentence, as lists of names per token; used in training
    def _names(self, words: Sequence[str]) -> list[list[str]]:
        out: list[list[str]] = []
        for i in range(len(words)):
            f = ["first"] if i == 0 else []
            for r in REACH:
                if 0 <= i + r < len(words):
                    f += token_features(words[i + r], r == 0, r, self.known)
            if i:
                f.append(f"<{brief(words[i - 1])}|{brief(words[i])}")
            if i + 1 < len(words):
                f.append(f">{brief(words[i])}|{brief(words[i + 1])}")
            out.append(f)
        return out

    def train(self, sentences: list[list[str]], tags: list[list[str]], *, epochs: int = 12, batch: int = 64, rate: float = 0.08, l2: float = 5e-5, seed: int = 3) -> "Crf":
        k, at = len(self.labels), {t: i for i, t in enumerate(self.labels)}
        count: dict[str, int] = {}
        for s in sentences:
            for w in s:
                count[w.lower()] = count.get(w.lower(), 0) + 1
        self.known = {w for w, n in count.items() if n >= KNOWN}
        named, count = [self._names(s) for s in sentences], {}
        for s in named:
            for t in s:
                for f in t:
                    count[f] = count.get(f, 0) + 1
        self.index = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n > 1))}
        feats = [[np.array([self.index[f] for f in t if f in self.index], np.int32) for t in s] for s in named]
        gold = [np.array([at[t] for t in s], np.int64) for s in tags]
        w, tr, st = np.zeros((len(self.index), k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32)
        params, moments = [w, tr, st], [[np.zeros_like(p) for p in (w, tr, st)] for _ in range(2)]
        rng, step, mean = np.random.default_rng(seed), 0, [np.zeros_like(p) for p in params]
        for epoch in range(epochs):
            order = rng.permutation(len(feats))
            lr = rate * (1 - 0.8 * epoch / epochs)
            for lo in range(0, len(order), batch):
                picked = [i for i in order[lo : lo + batch] if len(gold[i])]
                size = max(len(gold[i]) for i in picked)
                n = len(picked)
                mask = np.zeros((n, size), bool)
                y = np.zeros((n, size), np.int64)
                ids, owner, starts, at_ids = [], [], [], 0
                for b, i in enumerate(picked):
                    mask[b, : len(gold[i])] = True
                    y[b, : len(gold[i])] = gold[i]
                    for t, f in enumerate(feats[i]):
                        ids.append(f)
                        owner.append(b * size + t)
                        starts.append(at_ids)
                        at_ids += len(f)
                ids_a, owner_a = np.concatenate(ids), np.array(owner)
                e = np.zeros((n * size, k), np.float32)
                e[owner_a] = np.add.reduceat(w[ids_a], starts)
                e = e.reshape(n, size, k)
                ge, gt, gs = self._gradient(e, y, mask, tr, st)
                gw = np.zeros_like(w)
                by = np.argsort(ids_a, kind="stable")
                touched, first = np.unique(ids_a[by], return_index=True)
                gw[touched] = np.add.reduceat(np.repeat(ge.reshape(-1, k)[owner_a], np.diff([*starts, at_ids]), axis=0)[by], first)
                step += 1
                for j, (p, g) in enumerate(zip(params, (gw, gt, gs), strict=True)):
                    g = g / n + l2 * p
                    m, v = moments[0][j], moments[1][j]
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.99
                    v += 0.01 * g * g
                    p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            if epoch >= epochs - AVERAGED:
                for total, p in zip(mean, params, strict=True):
                    total += p / min(AVERAGED, epochs)
        self.weights, self.trans, self.start = mean
        self._reset()
        return self

    @staticmethod
    def _gradient(e: np.ndarray, y: np.ndarray, mask: np.ndarray, tr: np.ndarray, st: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradient of the negative log likelihood by forward and backward sums."""

        def lse(a: np.ndarray, axis: int) -> np.ndarray:
            top = a.max(axis=axis, keepdims=True)
            return np.log(np.exp(a - top).sum(axis=axis)) + np.squeeze(top, axis)

        n, size, k = e.shape
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = st + e[:, 0]
        for t in range(1, size):
            a = lse(alpha[:, t - 1][:, :, None] + tr, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
        for t in range(size - 2, -1, -1):
            b = lse(tr + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], b, 0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        hot = np.eye(k, dtype=np.float32)[y] * mask[:, :, None]
        gt = np.zeros_like(tr)
        for t in range(1, size):
            m = mask[:, t]
            if m.any():
                joint = alpha[m, t - 1][:, :, None] + tr + (e[m, t] + beta[m, t])[:, None, :] - z[m][:, None, None]
                gt += np.exp(joint).sum(0)
                np.add.at(gt, (y[m, t - 1], y[m, t]), -1)
        return p - hot, gt, (p[:, 0] - hot[:, 0]).sum(0)

    def _type(self, word: str) -> int:
        i = self._types.get(word)
        if i is None:
            i = self._types[word] = len(self._types)
            if i == len(self._rows):
                self._rows = np.concatenate((self._rows, np.zeros_like(self._rows)))
                self._shape_of = np.concatenate((self._shape_of, np.zeros_like(self._shape_of)))
            b = brief(word)
            self._shape_of[i] = self._shapes.setdefault(b, len(self._shapes))
            for r in REACH:
                ids = [self.index[f] for f in token_features(word, r == 0, r, self.known) if f in self.index]
                self._rows[i, r - REACH[0]] = self.weights[ids].sum(0) if ids else 0
        return i

    def _pair(self, a: int, b: int) -> int:
        key = a << 32 | b
        i = self._pairs.get(key)
        if i is None:
            i = self._pairs[key] = len(self._pairs)
            if i == len(self._pair_rows):
                self._pair_rows = np.concatenate((self._pair_rows, np.zeros_like(self._pair_rows)))
            x, y = self._shape_names[a], self._shape_names[b]
            for side, f in ((0, f"<{x}|{y}"), (1, f">{x}|{y}")):
                self._pair_rows[i, side] = self.weights[self.index[f]] if f in self.index else 0
        return i

    def decode(self, sentences: list[list[str]], block: int = 4096) -> list[list[int]]:
        """The best label indices of each sentence."""
        if len(self._types) > MEMO:
            self._reset()
        out: list[list[int]] = [[] for _ in sentences]
        order = sorted((i for i in range(len(sentences)) if sentences[i]), key=lambda i: len(sentences[i]))
        lo = 0
        while lo < len(order):
            hi = lo + max(1, min(block, 200_000 // len(sentences[order[min(lo + block, len(order)) - 1]])))
            part = order[lo:hi]
            for i, row in zip(part, self._viterbi([sentences[i] for i in part]), strict=True):
                out[i] = row
            lo += len(part)
        return out

    def _viterbi(self, sentences: list[list[str]]) -> list[list[int]]:
        sizes = np.array([len(s) for s in sentences])
        n, size, k = len(sentences), int(sizes.max()), len(self.labels)
        types = np.full((n, size), -1, np.int64)
        for b, s in enumerate(sentences):
            types[b, : len(s)] = [self._type(w) for w in s]
        mask = types >= 0
        safe = np.where(mask, types, 0)
        e = np.zeros((n, size, k), np.float32)
        for j, r in enumerate(REACH):  # the token at t + r lends its row j to t
            if abs(r) >= size:
                continue
            lent = self._rows[safe, j] * mask[:, :, None]
            if r < 0:
                e[:, -r:] += lent[:, :r]
            elif r > 0:
                e[:, :-r] += lent[:, r:]
            else:
                e += lent
        if "first" in self.index:
            e[:, 0] += self.weights[self.index["first"]]
        if size > 1:
            self._shape_names = list(self._shapes)
            sh = self._shape_of[safe]
            keys = (sh[:, :-1].astype(np.int64) << 32) | sh[:, 1:]
            both = mask[:, 1:]
            found, back = np.unique(keys[both], return_inverse=True)
            rows = np.array([self._pair(int(u >> 32), int(u & 0xFFFFFFFF)) for u in found], np.int64)[back]
            e[:, 1:][both] += self._pair_rows[rows, 0]
            left = np.zeros((n, size - 1, k), np.float32)
            left[both] = self._pair_rows[rows, 1]
            e[:, :-1] += left
        score = self.start + e[:, 0]
        back_at = np.zeros((n, size, k), np.int8)
        for t in range(1, size):
            s = score[:, :, None] + self.trans
            best = s.argmax(1)
            new = np.take_along_axis(s, best[:, None], 1)[:, 0] + e[:, t]
            live = mask[:, t, None]
            back_at[:, t] = np.where(live, best, np.arange(k))
            score = np.where(live, new, score)
        path = np.zeros((n, size), np.int8)
        path[:, -1] = score.argmax(1)
        for t in range(size - 1, 0, -1):
            path[:, t - 1] = back_at[np.arange(n), t, path[:, t]]
        return [path[b, :m].tolist() for b, m in enumerate(sizes)]
