"""Problem 5: the most similar vectors of every vector, by a hash-prefix forest.

Every vector gets, for each tree, a long hash string: the signs of its products with random directions. A tree is the sorted array
of its strings. Going down a tree, a vector comes to its longest prefix that other vectors share. From there all trees are climbed in step,
bit by bit, and the vectors that share the shorter prefixes join the candidates, until there are enough of them.

Two uses:
- near_join: for all vectors at once. Each tree is sorted over the cluster by ranges of bounded size, so no key or group can crowd a task; only
  buckets at the edge of a range are cut, in one tree, and each tree has other edges. The first pass tells every vector's bucket sizes by depth in every tree;
  summed over the trees they give the depth at which it stops. The second pass takes the buckets of that depth. Candidates whose strings differ
  in too many bits to reach the wanted cosine are dropped at once (by more than six standard deviations), the rest is verified exactly. A row
  with `crowd` near candidates may have more than its buckets show: such rows and what they met are joined into crowds, and a crowd is searched
  exactly, block by block. A bucket over eight times what is enough (strings that no direction tells apart) is only looked into far
  enough to see that its rows are crowded.
- search: a stated query set against all rows, in blocks: every block of rows is a forest of its own, a query climbs until it has met the share
  `candidates` of the block, and the best k of all blocks remain.

Vectors are compared within groups of the same model and length. Null, empty, not finite and zero vectors and those without a model
are left out. An id that comes with several vectors counts with each. Equal directions (components to 1/65536) are collapsed before the join: a class of copies is represented by its least id and expanded
again at the end, each member with the five copies of least id. Ties of similarity (to six places) go to the lesser id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as win

from ..operators.graph import components
from ..session import cut, join_sized

TREES, BITS, SEED = 16, 64, 17
#: Candidates (of all trees, copies of one counted apart) at which a vector stops going up, and near ones at which it counts as crowded.
ENOUGH, CROWD = 320, 12
#: Places of trees that a task sorts and holds at once.
TASK_ROWS = 300_000
#: Hash strings of so many trees together estimate the angle of a pair.
SKETCH = 4
#: Rows and queries of a block of the search, and the share of its rows that a query looks at.
BLOCK, QUERY_BLOCK, CANDIDATES = 16_384, 4096, 0.5
#: Rows of a block of a crowd, and how finely directions are told apart when copies are collapsed.
CROWD_BLOCK, GRID = 8_192, 65_536


def directions(dim: int, trees: int = TREES, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, trees * BITS)).astype(np.float32)


def strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Hash strings (rows x trees) of unit vectors, as unsigned integers whose order is that of the strings."""
    bits = np.packbits(x @ planes > 0, axis=1)
    return bits.view(">u8").astype(np.uint64).reshape(len(x), -1)


def vectors(chunks: DataFrame, *, trees: int = TREES) -> DataFrame:
    """(id, model, dim, unit: float32 bytes, same: digest of the rounded direction, h: array of hash strings as signed longs) of the usable vectors, once each id."""
    usable = chunks.filter("id is not null and embedding_model is not null and size(embedding) > 0").select("id", "embedding_model", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            col = b.column(2)
            sizes = np.asarray(col.value_lengths())
            flat = np.asarray(col.flatten().fill_null(np.nan), np.float32)
            at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = flat[at[rows][:, None] + np.arange(dim)].astype(np.float64)
                norm = np.sqrt((x * x).sum(1))
                ok = np.isfinite(norm) & (norm > 0)
                rows, x = rows[ok], (x[ok] / norm[ok][:, None]).astype(np.float32)
                if not len(rows):
                    continue
                if dim not in planes:
                    planes[dim] = directions(int(dim), trees)
                h = strings(x, planes[dim])
                take = pa.array(rows, pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, trees), pa.int32()), pa.array(h.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(np.full(len(rows), dim), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()),
                     pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in np.rint(x * GRID).astype(np.int32)], pa.binary()), lists], names=["id", "model", "dim", "unit", "same", "h"]
                )

    return usable.mapInArrow(run, "id string, model string, dim int, unit binary, same binary, h array<long>")


def _sorted_trees(rows: DataFrame, parts: int, *more: object) -> DataFrame:
    """(node, grp, tree, key, more) of rows (node, grp, h, more): each tree's array in the order of its strings, cut into ranges of the cluster."""
    each = rows.select("node", "grp", F.posexplode("h").alias("tree", "key"), *more)
    # signed longs sort as their strings do once the sign bit is flipped; the node makes rows of one string divisible
    each = each.withColumn("key", F.col("key").bitwiseXOR(F.lit(-(2**63))))
    order = ["tree", "grp", "key", "node"]
    return each.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _whole(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """A task's range as one matrix of longs; its size is bounded by TASK_ROWS and the evenness of ranges."""
    got = [np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(b.num_columns)], 1) for b in batches]
    return np.concatenate(got) if got else np.zeros((0, 5 + SKETCH), np.int64)


def common_prefix(m: np.ndarray) -> np.ndarray:
    """Bits that each row's string has in common with the next row's; -1 between trees or groups."""
    x = (m[1:, 3] ^ m[:-1, 3]).view(np.uint64)
    high = np.zeros(len(x), np.int8)
    for step in (32, 16, 8, 4, 2, 1):  # position of the highest bit that differs
        big = x >> np.uint64(step) > 0
        high[big] += step
        x = np.where(big, x >> np.uint64(step), x)
    out = np.where(x > 0, BITS - 1 - high, BITS).astype(np.int8)
    out[(m[1:, 1] != m[:-1, 1]) | (m[1:, 2] != m[:-1, 2])] = -1
    return out


def _sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every `width` places in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x, have = pick(x[:-step], x[step:]), have + step
    return x


def profile(lcp: np.ndarray, steps: int) -> np.ndarray:
    """Of each of len(lcp) + 1 sorted rows, for j = 1 .. steps: the longest prefix that 2 ** j rows share with it (0: there is none)."""
    n, out = len(lcp) + 1, []
    for j in range(1, steps + 1):
        size = 2**j
        if n < size:
            out.append(np.zeros(n, np.int8))
            continue
        held = _sliding(lcp, size - 1, np.minimum)  # the prefix of each run of `size` rows
        edge = np.full(size - 1, -1, np.int8)
        out.append(np.maximum(_sliding(np.concatenate((edge, held, edge)), size, np.maximum), 0))
    return np.stack(out, 1)


def _ascent(slim: DataFrame, enough: int, trees: int, parts: int) -> DataFrame:
    """(node, grp, depth): the prefix length at which a row stops, having gone up all trees in step until they show it `enough` rows."""
    steps = max(2, int(np.ceil(np.log2(enough))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _whole(batches)
        if not len(m):
            return
        p = profile(common_prefix(m), steps).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(m[:, 0]), pa.array(m[:, 1].astype(np.int32)), pa.array([r.tobytes() for r in p], pa.binary())], names=["node", "grp", "p"])

    shown = _sorted_trees(slim, parts).select("node", "grp", "tree", "key").mapInArrow(run, "node long, grp int, p binary")

    def stop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            joined = b"".join(x for t in lists.to_pylist() for x in t)
            sizes = np.asarray(lists.value_lengths())
            p = np.frombuffer(joined, np.uint8).reshape(-1, steps)
            row = np.repeat(np.arange(b.num_rows), sizes)
            depth = np.zeros(b.num_rows, np.int32)
            for d in range(BITS, 0, -1):  # all trees go up together
                seen = np.bincount(row, ((p >= d) * 2.0 ** np.arange(1, steps + 1)).max(1), b.num_rows)
                depth = np.where((depth == 0) & (seen >= enough), d, depth)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(depth)], names=["node", "grp", "depth"])

    return shown.groupBy("node", "grp").agg(F.collect_list("p").alias("p")).mapInArrow(stop, "node long, grp int, depth int")


def _bucket_pairs(m: np.ndarray, most_bits: int, most_rows: int, some: int, block: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Pairs (a < b) of rows that share a prefix of the depth at which one of them stopped, near by their sketches; m: node, grp, tree, key, depth, words."""
    n = len(m)
    if n < 2:
        return
    lcp, words, depth = common_prefix(m), m[:, 5:].view(np.uint64), m[:, 4]
    lo, hi = np.arange(n), np.arange(n) + 1
    for d in np.unique(depth):
        edge = np.concatenate(([0], np.flatnonzero(lcp < d) + 1, [n]))
        mine = np.flatnonzero(depth == d)
        at = np.searchsorted(edge, mine, side="right")
        lo[mine], hi[mine] = edge[at - 1], edge[at]
    vast, here = hi - lo > most_rows, np.arange(n)
    lo, hi = np.where(vast, np.maximum(lo, here - some), lo), np.where(vast, np.minimum(hi, here + some + 1), hi)
    total = np.cumsum(hi - lo)
    begin = 0
    while begin < n:  # as many rows at a time as make a block of pairs
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + block, side="right")))
        size = (hi - lo)[begin:end]
        i = np.repeat(np.arange(begin, end), size)
        j = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[begin:end], size)
        other = i != j
        i, j = i[other], j[other]
        bits = np.zeros(len(i), np.uint16)
        for w in range(words.shape[1]):
            bits += np.bitwise_count(words[i, w] ^ words[j, w])
        near = bits <= most_bits
        a, b = m[i[near], 0], m[j[near], 0]
        both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
        begin = end


def near_join(chunks: DataFrame, *, k: int = 5, cosine: float = 0.95, trees: int = TREES, candidates: int = ENOUGH, crowd: int = CROWD) -> DataFrame:
    """(chunk_a, chunk_b, similarity): pairs of at least the cosine, one among the k most similar of the other; a < b."""
    all_rows = cut(vectors(chunks, trees=trees).withColumn("node", F.xxhash64("id")))
    # classes of equal directions; rounding makes scaled copies equal, but for the few at an edge of the grid. Vectors stay where they are: what travels
    # is their hash here, their hash strings below, and the vectors of verified candidates at the end
    whole = all_rows.select("id", "node", "model", "dim", "same")
    rep = cut(whole.groupBy("model", "dim", "same").agg(F.min("id").alias("rep"), (F.min("id") < F.max("id")).alias("several")))
    chosen = rep.select(F.xxhash64("rep").alias("node")).distinct()
    group = F.hash("model", "dim").alias("grp")
    slim = cut(all_rows.select("node", group, "h").join(chosen, "node", "left_semi").dropDuplicates(["node", "grp"]))
    angle = float(np.arccos(np.clip(cosine, -1, 1)) / np.pi)
    most_bits = int(np.ceil(SKETCH * BITS * angle + 6 * np.sqrt(SKETCH * BITS * angle * (1 - angle))))
    parts = max(slim.sparkSession.sparkContext.defaultParallelism, -(-slim.count() * trees // TASK_ROWS))
    sketch = [F.col("h")[t].alias(f"w{t}") for t in range(SKETCH)]
    climbed = _sorted_trees(slim.join(_ascent(slim, candidates, trees, parts), ["node", "grp"]), parts, "depth", *sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _bucket_pairs(_whole(batches), most_bits, 8 * candidates, 2 * crowd)

    met = cut(climbed.mapInArrow(run, "a long, b long").distinct())
    crowded = cut(met.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count().filter(F.col("count") >= crowd).select("node"))
    some = not crowded.isEmpty()
    # only rows that are in a candidate pair are joined; rows alone are in less than `crowd` of them, crowded rows in about as many as they have candidates
    named = cut(met.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    side = join_sized(all_rows.select("node", "id", "unit", "model", "dim"), named, ["node"], salt=F.lit(0), salts=1).dropDuplicates(["node", "model", "dim"])
    as_ = lambda n: side.select(*(F.col(c).alias(f"{n}_{c}") for c in side.columns))
    alone = met
    if some:  # pairs with a crowded row are left to the search of its crowd
        for end in ("a", "b"):
            alone = alone.join(crowded.select(F.col("node").alias(end)), end, "left_anti")
    both = alone.select("a", "b").join(as_("x"), F.col("a") == F.col("x_node")).join(as_("y"), F.col("b") == F.col("y_node")).filter("x_model = y_model and x_dim = y_dim")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [float(np.frombuffer(x, np.float32).astype(np.float64) @ np.frombuffer(y, np.float32)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            keep = pa.array([i for i, v in enumerate(s) if v >= cosine - 1e-7], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(s, pa.float64()).take(keep)], names=["x", "y", "similarity"])

    pairs = cut(both.select("x_id", "y_id", "x_unit", "y_unit").mapInArrow(verify, "x string, y string, similarity double"))
    if some:
        edges = met.join(crowded.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b").union(met.join(crowded.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b"))
        pairs = cut(pairs.union(crowd_pairs(side.join(components(edges), "node"), k=k, cosine=cosine)).groupBy("x", "y").agg(F.max("similarity").alias("similarity")))
    members = whole.join(rep.filter("several"), ["model", "dim", "same"]).select("rep", "id").distinct()
    return expand(pairs, cut(members), k)


def crowd_pairs(rows: DataFrame, *, k: int, cosine: float, block: int = CROWD_BLOCK) -> DataFrame:
    """(x, y, similarity): each row's k + 1 best of every block of its crowd, by brute force; rows: (class_id, id, model, dim, unit).

    Every block meets every block of its crowd in a task of its own, so a crowd of any size needs two blocks' memory a task; the work is its square.
    """
    rows = cut(rows.select("class_id", "id", "model", "dim", "unit"))
    shards = rows.groupBy("class_id").agg(F.ceil(F.count("*") / block).cast("int").alias("shards"))
    placed = rows.join(shards, "class_id").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    left = placed.select("class_id", F.col("shard").alias("i"), every.alias("j"), "id", "model", "dim", "unit")
    # other names: both sides stem from one plan
    right = placed.select(F.col("class_id").alias("r_class_id"), every.alias("r_i"), F.col("shard").alias("r_j"), *(F.col(c).alias(f"r_{c}") for c in ("id", "model", "dim", "unit")))

    def run(key: tuple, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"x": pd.Series(dtype=str), "y": pd.Series(dtype=str), "similarity": pd.Series(dtype=float)})]
        r = r.sort_values("r_id")
        for (model, dim), qs in q.groupby(["model", "dim"]):
            rs = r[(r.r_model == model) & (r.r_dim == dim)]
            if not len(rs):
                continue
            y, y_ids = np.stack([np.frombuffer(u, np.float32) for u in rs.r_unit]).astype(np.float64), rs.r_id.to_numpy()
            # ids ascend, so a place taken off a rounded similarity breaks ties by id
            place, most = np.arange(len(rs)) * 1e-12, min(k + 2, len(rs))
            for lo in range(0, len(qs), 256):
                part = qs.iloc[lo : lo + 256]
                s = np.stack([np.frombuffer(u, np.float32) for u in part.unit]).astype(np.float64) @ y.T
                top = np.argpartition(place - np.round(s, 6), most - 1, axis=1)[:, :most]
                at = np.repeat(np.arange(len(part)), most)
                x_ids, found, near = part.id.to_numpy()[at], y_ids[top.ravel()], s[at, top.ravel()]
                keep = (near >= cosine - 1e-7) & (x_ids != found)
                out.append(pd.DataFrame({"x": x_ids[keep], "y": found[keep], "similarity": near[keep]}))
        return pd.concat(out)

    met = left.groupBy("class_id", "i", "j").cogroup(right.groupBy("r_class_id", "r_i", "r_j")).applyInPandas(run, "x string, y string, similarity double")
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "similarity")


def expand(pairs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Pairs of single rows from pairs of classes (x, y, similarity) and the members of classes of several (rep, id)."""
    # of a class at most k + 1 members can be among the k most similar of another row: those of least id
    firsts = smallest(members, k + 1)
    directed = pairs.select(F.col("x").alias("rep"), F.col("y").alias("other"), "similarity").union(pairs.select(F.col("y").alias("rep"), F.col("x").alias("other"), "similarity"))
    other = directed.join(firsts.select(F.col("rep").alias("other"), "least"), "other", "left").select(
        "rep", F.round("similarity", 6).alias("near"), "similarity", F.explode(F.coalesce("least", F.array("other"))).alias("found")
    )
    # copies of a row are its most similar rows; they come with similarity 1
    own = firsts.select("rep", F.lit(1.0).alias("near"), F.lit(1.0).alias("similarity"), F.explode("least").alias("found"))
    ranked = other.unionByName(own).withColumn("nth", F.row_number().over(win.Window.partitionBy("rep").orderBy(F.col("near").desc(), "found"))).filter(F.col("nth") <= k + 1)
    lists = ranked.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("nth", "found", "similarity"))).alias("best"))
    each = members.join(lists, "rep").select("id", "best").union(lists.join(members.select("rep").distinct(), "rep", "left_anti").select(F.col("rep").alias("id"), "best"))
    # a member's list is its class's without itself
    own_list = F.slice(F.filter("best", lambda x: x["found"] != F.col("id")), 1, k)
    flat = each.select("id", F.explode(own_list).alias("b")).select("id", "b.found", "b.similarity")
    return flat.groupBy(F.least("id", "found").alias("chunk_a"), F.greatest("id", "found").alias("chunk_b")).agg(F.max("similarity").alias("similarity"))


def smallest(members: DataFrame, n: int) -> DataFrame:
    """(rep, least): the n least ids of each class, found in two steps so that no task holds a large class."""
    salted = win.Window.partitionBy("rep", "salt").orderBy("id")
    first = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("nth", F.row_number().over(salted)).filter(F.col("nth") <= n)
    second = first.withColumn("nth", F.row_number().over(win.Window.partitionBy("rep").orderBy("id"))).filter(F.col("nth") <= n)
    return second.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("least"))


def search(queries: DataFrame, rows: DataFrame, *, k: int = 5, trees: int = TREES, candidates: float = CANDIDATES, block: int = BLOCK, query_block: int = QUERY_BLOCK, exact: bool = False) -> DataFrame:
    """(query, found, similarity, nth) of the k most similar rows of each query; both of vectors(). exact: by brute force in the same blocks."""
    shards, asks = max(1, -(-rows.count() // block)), max(1, -(-queries.count() // query_block))
    # other names: both sides may stem from one plan
    placed = rows.select(*(F.col(c).alias(f"r_{c}") for c in ("id", "model", "dim", "unit", "h")), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("ask"))
    asked = queries.select("id", "model", "dim", "unit", "h", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(asks)).cast("int").alias("ask"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def run(key: tuple, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if not len(q) or not len(r):
            return pd.DataFrame(out, columns=["query", "found", "similarity"])
        for (model, dim), qs in q.groupby(["model", "dim"]):
            rs = r[(r.r_model == model) & (r.r_dim == dim)]
            if not len(rs):
                continue
            x = np.stack([np.frombuffer(u, np.float32) for u in rs.r_unit])
            hx = np.stack(rs.r_h.to_numpy()).view(np.uint64)
            ids = rs.r_id.to_numpy()
            want = len(rs) if exact else min(len(rs), max(64, int(np.ceil(candidates * len(rs)))))
            order = [np.argsort(hx[:, t], kind="stable") for t in range(trees)]
            for qid, unit, h in zip(qs.id, qs.unit, qs.h, strict=True):
                v = np.frombuffer(unit, np.float32)
                at = np.arange(len(rs)) if want == len(rs) else climb(np.asarray(h).view(np.uint64), hx, order, want)
                s = (x[at] @ v).astype(np.float64)
                mine = ids[at] != qid
                at, s = at[mine], s[mine]
                top = np.argpartition(-s, min(k + 8, len(s)) - 1)[: k + 8] if len(s) > k + 8 else np.arange(len(s))
                out += [(qid, ids[at[i]], s[i]) for i in top]
        return pd.DataFrame(out, columns=["query", "found", "similarity"])

    met = asked.groupBy("shard", "ask").cogroup(placed.groupBy("shard", "ask")).applyInPandas(run, "query string, found string, similarity double")
    near = F.round("similarity", 6)
    return met.withColumn("nth", F.row_number().over(win.Window.partitionBy("query").orderBy(near.desc(), "found"))).filter(F.col("nth") <= k)


def climb(h: np.ndarray, hx: np.ndarray, order: list[np.ndarray], want: int) -> np.ndarray:
    """Rows that share the longest prefixes with a query in any tree: all trees go up one bit at a time until enough are met."""
    taken, keys = np.zeros(len(hx), bool), [hx[o, t] for t, o in enumerate(order)]
    held = [(0, 0)] * len(order)
    # the longest prefix in any tree is shared with a neighbour of the query's place
    places = [int(np.searchsorted(k, v)) for k, v in zip(keys, h, strict=True)]
    first = max(BITS - int(k[i] ^ v).bit_length() for k, v, p in zip(keys, h, places, strict=True) for i in (p - 1, p) if 0 <= i < len(k))
    for depth in range(first, -1, -1):
        shift = np.uint64(BITS - depth)
        for t, o in enumerate(order):
            if depth:
                lo = (h[t] >> shift) << shift if depth < BITS else h[t]
                hi = lo | ((np.uint64(1) << shift) - np.uint64(1)) if depth < BITS else h[t]
                a, b = int(np.searchsorted(keys[t], lo)), int(np.searchsorted(keys[t], hi, side="right"))
            else:
                a, b = 0, len(keys[t])
            if (a, b) != held[t]:
                taken[o[a:b]] = True
                held[t] = a, b
        if taken.sum() >= want:
            break
    return np.flatnonzero(taken)


def recall(queries: DataFrame, rows: DataFrame, *, k: int = 5, trees: int = TREES, candidates: float = CANDIDATES) -> DataFrame:
    """(model, dim, queries, recall): the share of the k most similar rows that the forest finds, against brute force."""
    found = search(queries, rows, k=k, trees=trees, candidates=candidates).select("query", "found", F.lit(1).alias("hit"))
    true = search(queries, rows, k=k, exact=True).select("query", "found")
    met = true.join(found, ["query", "found"], "left").join(queries.select(F.col("id").alias("query"), "model", "dim"), "query")
    return met.groupBy("model", "dim").agg(F.countDistinct("query").alias("queries"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
