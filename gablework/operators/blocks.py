"""Scores of questions against a corpus in blocks of both: what leaves a block is what is asked for, not every pair."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Rows of a corpus that one task may hold when whole rankings are asked for (about 150 bytes and 4 for each asked token), rows
#: of a lane otherwise, questions of a block and asked terms that are sent to the workers.
FULL_ROWS, LANE_ROWS, QUESTIONS, TERMS = 1_000_000, 131_072, 256, 2_000_000
#: Rows of a piece, at most 65,536: what is needed while one is made goes with its size.
PIECE = 16_384


def order_keys(scores: np.ndarray, places: int) -> np.ndarray:
    """Scores rounded to so many places, halves up, as integers."""
    return np.floor(scores * 10.0**places + 0.5).astype(np.int64)


def best_first(keys: np.ndarray, k: int | None = None) -> np.ndarray:
    """Positions of the k largest keys (all without k), largest first, equal ones by position."""
    if k is not None and k < len(keys):
        kth = np.partition(keys, len(keys) - k)[len(keys) - k]
        more, same = np.flatnonzero(keys > kth), np.flatnonzero(keys == kth)
        at = np.sort(np.concatenate([more, same[: k - len(more)]]))
    else:
        at = np.arange(len(keys))
    return at[np.argsort(-keys[at], kind="stable")]


class Cell:
    """The rows of one block in the order of their ids, with the postings of asked terms in pieces, each by term. Rows come in any order."""

    def __init__(self, terms: list[str], avgdl: float, k1: float, b: float) -> None:
        self.code, self.kind, self.norm = {t: i for i, t in enumerate(terms)}, code_type(len(terms)), (avgdl, k1, b)
        self.pieces: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.parts: list[pa.RecordBatch] = []
        self.wait: list[pa.RecordBatch] = []
        self.n = self.waiting = 0

    def add(self, rows: pa.RecordBatch) -> None:
        """Takes rows; call done() after the last."""
        self.wait.append(rows)
        self.waiting += len(rows)
        # row numbers in a piece are of 16 bits
        while self.waiting >= PIECE:
            part = pa.Table.from_batches(self.wait)
            self._piece(part.slice(0, PIECE))
            self.wait, self.waiting = part.slice(PIECE).to_batches(), self.waiting - PIECE

    def _piece(self, part: pa.Table) -> None:
        avgdl, k1, b = self.norm
        body = part["body"].combine_chunks()
        lengths = pc.binary_length(body).to_numpy(zero_copy_only=False) // self.kind().itemsize
        codes, row = np.frombuffer(b"".join(body.to_pylist()), self.kind), np.repeat(np.arange(len(part), dtype=np.uint16), lengths)
        first = np.ones(len(codes), bool)
        first[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
        starts = np.flatnonzero(first)
        tf = np.diff(starts, append=len(codes))
        tf = tf.astype(np.min_scalar_type(int(tf.max(initial=0))))  # their part of the score is made when it is asked for
        codes, row = codes[starts], row[starts]
        norm = k1 * (1 - b + b * part["dl"].to_numpy().astype(np.float64) / avgdl)
        by = np.argsort(codes, kind="stable")
        self.pieces.append((self.n, np.searchsorted(codes[by], np.arange(len(self.code) + 1)), row[by], tf[by], norm))
        self.parts += part.drop_columns(["body", "dl"]).combine_chunks().to_batches()
        self.n += len(part)

    def done(self) -> Cell:
        if self.waiting:
            self._piece(pa.Table.from_batches(self.wait))
        rows = pa.Table.from_batches(self.parts)
        order = pc.sort_indices(rows["chunk_id"])
        self.rows, self.order = rows.take(order).combine_chunks(), order.to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids = self.rows["chunk_id"].combine_chunks()
        self.parts = self.wait = []
        return self

    def scores(self, terms: list[str], weights: list[float], counts: bool = False) -> np.ndarray:
        """The BM25 score of every row; with counts, how many of the terms it holds."""
        out, k1 = np.zeros(self.n), self.norm[1]
        asked = [(self.code[t], w) for t, w in zip(terms, weights, strict=True)]
        for at, starts, rows, times, norm in self.pieces:
            own = out[at : at + len(norm)]
            for t, w in asked:
                lo, hi = starts[t], starts[t + 1]
                if lo < hi:
                    row, tf = rows[lo:hi], times[lo:hi].astype(np.float64)
                    own[row] += 1.0 if counts else w * (tf * (k1 + 1) / (tf + norm[row]))
        return out[self.order]


def code_type(terms: int) -> type:
    return np.uint16 if terms <= 65_536 else np.uint32


def packed(toks: DataFrame, terms: list[str]) -> DataFrame:
    """toks (chunk_id, said, ...) with dl and, in place of said, body: the numbers of the asked terms in it, in order, as bytes."""
    rest = [f for f in toks.schema.fields if f.name != "said"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", dl int, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind = pa.array(terms, pa.string()), code_type(len(terms))
        for x in batches:
            lists = pc.split_pattern(x.column("said").cast(pa.string()), " ")
            flat, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            dl = np.where(pc.equal(x.column("said"), "").to_numpy(zero_copy_only=False), 0, lengths).astype(np.int32)
            code = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(x)), lengths)
            both = np.sort((row * max(1, len(terms)) + code)[code >= 0])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[code >= 0], minlength=len(x)))]) * kind().itemsize
            bodies = (both % max(1, len(terms))).astype(kind).tobytes()
            body = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(bodies)])
            yield pa.RecordBatch.from_arrays([*(x.column(f.name) for f in rest), pa.array(dl), body], names=[*(f.name for f in rest), "dl", "body"])

    return toks.mapInArrow(run, schema)


def stored(rows: DataFrame, ask: str | None = None) -> DataFrame:
    """rows as few large ones, without column ask: (_ask: its value, none without it; part: rows in Arrow's form, compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for own in pc.unique(x.column(ask)).to_pylist() if ask else [None]:
                some, sink = x.filter(pc.equal(x.column(ask), own)).drop_columns([ask]) if ask else x, pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(some)
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_ask", "part"])

    return rows.mapInArrow(run, "_ask int, part binary")


def in_blocks(
    toks: DataFrame, corpus: DataFrame, asked: DataFrame, emit: Callable[[Cell, pa.Table], Iterator[dict]], schema: str, *, k1: float, b: float, whole: bool = False,
    near: DataFrame | None = None, lane_rows: int = LANE_ROWS, questions: int = QUESTIONS,
) -> DataFrame:
    """What emit gives for the questions of each block: columns by name, in batches.

    toks: (chunk_id, said, ...); corpus: its row (n, avgdl); asked: (query_id, term, qtf, idf); near: (query_id, chunk_id, rank),
    the few ranked rows of another search. The corpus is dealt into lanes and copied once for each block of questions (whole: it is
    stored once, and read by the task of each block); a task holds one lane and takes the block's questions one by one.
    """
    terms = sorted(r.term for r in asked.select("term").distinct().limit(TERMS + 1).collect())
    if len(terms) > TERMS:
        raise ValueError(f"more than {TERMS} different terms are asked for")
    said = corpus.first()
    n, avgdl = said["n"], said["avgdl"] or 1.0
    # a question's terms are as many as its own text has; its near rows are capped by the search
    each = asked.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("qtf") * F.col("idf")).alias("weights"))
    if near is not None:
        close = near.groupBy("query_id").agg(F.collect_list(F.struct(F.col("chunk_id").alias("id"), F.col("rank").cast("int").alias("rank"))).alias("near"))
        each = each.join(close, "query_id", "full_outer")
    lanes, asks = max(1, -(-n // lane_rows)), max(1, -(-each.count() // questions))
    numbers = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    lane = F.pmod(F.xxhash64("chunk_id"), F.lit(lanes)).cast("int")
    block = F.pmod(F.xxhash64("query_id"), F.lit(asks)).cast("int")
    if whole:
        parts = cut(stored(packed(toks, terms)).unionByName(stored(each.withColumn("_ask", block).repartitionById(asks, F.col("_ask")), "_ask")))
        # the product with the blocks' numbers, one in a partition, is read part by part in each block's task; nothing is shuffled
        tasks = toks.sparkSession.range(0, asks, 1, asks).withColumnRenamed("id", "_block").hint("shuffle_replicate_nl")
        return parts.coalesce(1).join(tasks, F.expr("_ask is null or _ask = _block")).select("_ask", "part").mapInArrow(_held(terms, avgdl, k1, b, emit), schema)
    placed = packed(toks, terms).withColumn("_ask", numbers(asks)).withColumn("_cell", F.col("_ask") * lanes + lane).withColumn("_asks", F.lit(False))
    wanted = each.withColumn("_ask", block).withColumn("_lane", numbers(lanes)).withColumn("_cell", F.col("_ask") * lanes + F.col("_lane")).withColumn("_asks", F.lit(True)).drop("_lane")
    both = placed.drop("_ask").unionByName(wanted.drop("_ask"), allowMissingColumns=True).repartitionById(asks * lanes, F.col("_cell")).sortWithinPartitions("_asks")
    row_names, question_names = placed.drop("_ask", "_cell", "_asks").columns, each.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ready = Cell(terms, avgdl, k1, b), False
        for x in batches:
            rows = int((~x.column("_asks").to_numpy(zero_copy_only=False)).sum())  # they come before the questions
            if rows:
                cell.add(x.slice(0, rows).select(row_names))
            if rows < len(x) and (cell.n or cell.waiting):
                if not ready:
                    cell, ready = cell.done(), True
                for out in emit(cell, pa.Table.from_batches([x.slice(rows).select(question_names)])):
                    yield pa.RecordBatch.from_pydict(out)

    return both.mapInArrow(run, schema)


def _held(terms: list[str], avgdl: float, k1: float, b: float, emit: Callable[[Cell, pa.Table], Iterator[dict]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with the stored parts (see stored) of the corpus and of its questions, in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asked = Cell(terms, avgdl, k1, b), []
        trim()
        for x in batches:
            for ask, part in zip(x.column("_ask").to_pylist(), x.column("part"), strict=True):
                for rows in pa.ipc.open_stream(part.as_buffer()):
                    if ask is None:
                        cell.add(rows)
                    else:
                        asked.append(rows)
        if asked and (cell.n or cell.waiting):
            x = part = rows = None  # the parts as they came
            cell = cell.done()
            trim()
            for rows in asked:
                for out in emit(cell, pa.Table.from_batches([rows])):
                    yield pa.RecordBatch.from_pydict(out)
        cell = asked = x = part = rows = None
        trim()

    return run


def trim() -> None:
    """Gives back freed memory: a worker waits for its next task while others hold a corpus."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def top(k: int, *, counts: bool = False, places: int = 6) -> Callable[[Cell, pa.Table], Iterator[dict]]:
    """The k best rows of each question in a block: query_id, chunk_id, score."""

    def emit(cell: Cell, asked: pa.Table) -> Iterator[dict]:
        qs, ats, scores = [], [], []
        for q in asked.to_pylist():
            s = cell.scores(q["terms"] or [], q["weights"] or [], counts)
            found = np.flatnonzero(s > 0)
            at = found[best_first(order_keys(s[found], places), k)]
            qs += [q["query_id"]] * len(at)
            ats.append(at)
            scores.append(s[at])
        if qs:
            yield {"query_id": pa.array(qs, pa.string()), "chunk_id": cell.ids.take(pa.array(np.concatenate(ats))), "score": pa.array(np.concatenate(scores))}

    return emit


def summed(cell: Cell, asked: pa.Table) -> Iterator[dict]:
    """Of each question in a block, the best score, the number of positive ones and the most terms that a row holds."""
    out: dict[str, list] = {"query_id": [], "top_bm25": [], "positives": [], "held": []}
    for q in asked.to_pylist():
        s, held = (cell.scores(q["terms"] or [], q["weights"] or [], c) for c in (False, True))
        for name, x in zip(out, (q["query_id"], float(s.max()), int((s > 0).sum()), float(held.max())), strict=True):
            out[name].append(x)
    yield {k: pa.array(v, {"query_id": pa.string(), "positives": pa.int64()}.get(k, pa.float64())) for k, v in out.items()}


class Fused:
    """Both ranks and the fused score of one question's rows: at (positions in the cell), lexical and vector (0: none), score."""

    def __init__(self, cell: Cell, q: dict, near: np.ndarray, k: int) -> None:
        s = cell.scores(q["terms"] or [], q["weights"] or [])
        found = np.flatnonzero(s > 0)
        lexical, vector = np.zeros(cell.n, np.int32), np.zeros(cell.n, np.int32)
        # the key and the place in one integer sort faster than a stable sort of the keys
        keys = -order_keys(s[found], 6)
        width = max(1, int(cell.n).bit_length())
        if len(found) and int(-keys.min()) < 1 << (62 - width):
            found = np.sort((keys << width) | found) & ((1 << width) - 1)
        else:
            found = found[np.argsort(keys, kind="stable")]
        lexical[found] = np.arange(1, len(found) + 1)
        vector[near] = [x["rank"] for x in q["near"] or []]
        self.at = np.flatnonzero((lexical > 0) | (vector > 0))
        self.lexical, self.vector = lexical[self.at], vector[self.at]
        part = lambda r: np.where(r > 0, 1.0 / (k + r), 0.0)
        self.score = part(self.lexical) + part(self.vector)


def fused(cell: Cell, asked: pa.Table, k: int) -> Iterator[tuple[str, Fused]]:
    """The questions of a block with their fused rankings."""
    qs = asked.to_pylist()
    near = [x["id"] for q in qs for x in q["near"] or []]
    at = pc.index_in(pa.array(near, pa.string()), value_set=cell.ids)
    if at.null_count:
        raise ValueError("a near row is not in the corpus")
    at, done = at.to_numpy(zero_copy_only=False).astype(np.int64), 0
    for q in qs:
        size = len(q["near"] or [])
        yield q["query_id"], Fused(cell, q, at[done : done + size], k)
        done += size


def all_fused(k: int, places: int, rows: int = 65_536) -> Callable[[Cell, pa.Table], Iterator[dict]]:
    """Every row of every question: query_id, chunk_id, lexical_rank, vector_rank, score rounded to so many places."""

    def emit(cell: Cell, asked: pa.Table) -> Iterator[dict]:
        for name, f in fused(cell, asked, k):
            for lo in range(0, len(f.at), rows):
                own = slice(lo, lo + rows)
                ranks = [pa.array(x[own], pa.int32(), mask=x[own] == 0) for x in (f.lexical, f.vector)]
                score = np.floor(f.score[own] * 10.0**places + 0.5) / 10.0**places
                at = pa.array(f.at[own])
                yield {"query_id": pa.repeat(pa.scalar(name, pa.string()), len(at)), "chunk_id": cell.ids.take(at), "lexical_rank": ranks[0], "vector_rank": ranks[1], "score": pa.array(score)}

    return emit


def _codes(cell: Cell, name: str) -> tuple[np.ndarray, list]:
    """Numbers of a column's values, -1 for null, and the values."""
    if not hasattr(cell, f"_{name}"):
        x = cell.rows[name].combine_chunks().dictionary_encode()
        setattr(cell, f"_{name}", (pc.fill_null(x.indices, -1).to_numpy(zero_copy_only=False), x.dictionary.to_pylist()))
    return getattr(cell, f"_{name}")


def one_per_episode(cell: Cell, f: Fused) -> np.ndarray:
    """Which of the rows stay when an episode under several kinds and documents keeps its best video chunk, else its best chunk."""
    (episode, names), (kind, kinds), (doc, _) = (_codes(cell, x) for x in ("episode", "kind", "doc_id"))
    e, own = episode[f.at], kind[f.at]
    seen = [np.bincount(e[(own == k) & (e >= 0)], minlength=len(names)) > 0 for k in range(len(kinds))]
    several = np.sum(seen, axis=0) > 1 if seen else np.zeros(len(names), bool)
    keep = np.ones(len(f.at), bool)
    sub = np.flatnonzero((e >= 0) & several[e]) if len(names) else np.empty(0, np.int64)
    if len(sub):
        docs, es = doc[f.at[sub]], e[sub]
        low, high = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), -1)
        there = docs >= 0
        np.minimum.at(low, es[there], docs[there])
        np.maximum.at(high, es[there], docs[there])
        sub = sub[(low != high)[es]]
        es = e[sub]
        video = np.where(own[sub] < 0, 0, np.where(own[sub] == (kinds.index("youtube") if "youtube" in kinds else -2), 2, 1))
        by = np.lexsort((sub, -order_keys(f.score[sub], 9), -video, es))
        first = np.ones(len(by), bool)
        first[1:] = es[by][1:] != es[by][:-1]
        keep[sub] = False
        keep[sub[by[first]]] = True
    return keep


def retrieved(k: int, rrf: int) -> Callable[[Cell, pa.Table], Iterator[dict]]:
    """The k best rows of each question after one_per_episode: query_id, chunk_id, rank, score, lexical_rank, vector_rank."""

    def emit(cell: Cell, asked: pa.Table) -> Iterator[dict]:
        for name, f in fused(cell, asked, rrf):
            left = np.flatnonzero(one_per_episode(cell, f))
            best = left[best_first(order_keys(f.score[left], 9), k)]
            ranks = [pa.array(x[best], pa.int32(), mask=x[best] == 0) for x in (f.lexical, f.vector)]
            yield {"query_id": pa.repeat(pa.scalar(name, pa.string()), len(best)), "chunk_id": cell.ids.take(pa.array(f.at[best])), "rank": pa.array(np.arange(1, len(best) + 1), pa.int32()), "score": pa.array(f.score[best]), "lexical_rank": ranks[0], "vector_rank": ranks[1]}

    return emit


def best_per_document(limit: int, rrf: int) -> Callable[[Cell, pa.Table], Iterator[dict]]:
    """The best row of each document of each question, of rows whose column wanted is true, then the best documents: query_id, doc_id, chunk_id, place."""

    def emit(cell: Cell, asked: pa.Table) -> Iterator[dict]:
        wanted = pc.fill_null(cell.rows["wanted"].combine_chunks(), False).to_numpy(zero_copy_only=False)
        docs = _codes(cell, "doc_id")
        for name, f in fused(cell, asked, rrf):
            left = np.flatnonzero(wanted[f.at])
            by, taken, seen = best_first(order_keys(f.score[left], 9)), [], set()
            for i in by:
                at = f.at[left[i]]
                if docs[0][at] not in seen:
                    seen.add(docs[0][at])
                    taken.append(at)
                    if len(taken) == limit:
                        break
            yield {"query_id": pa.repeat(pa.scalar(name, pa.string()), len(taken)), "doc_id": cell.rows["doc_id"].combine_chunks().take(pa.array(taken, pa.int64())), "chunk_id": cell.ids.take(pa.array(taken, pa.int64())), "place": pa.array(np.arange(1, len(taken) + 1), pa.int32())}

    return emit
