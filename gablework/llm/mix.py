"""Problem 9: draw documents from sources so that token shares match targets.

Budgets are hierarchical: the targets are summed up a tree of domain (kind), language and source, the total goes down it in proportion,
and what a leaf can't supply within its passes is shared out among its siblings first, then among the siblings of its parent,
then of its domain. A leaf is a source's documents in one language; a source in several languages has a leaf under each, and its target is
divided by their tokens. Each leaf draws a prefix, in tokens, of its documents in seeded epochs: every epoch is an order of all the
leaf's documents by a hash of seed, epoch and document; whole epochs are taken first and a prefix of one more.

Without a given total the largest is taken at which no leaf that has documents falls short, so the reached shares match
the targets to within a document each; with a larger one small sources reach their passes and others take up what is left. A source that is listed
but has no documents has no domain, so its share goes to all. Sources that aren't listed, documents without tokens and null sources are
not drawn. Languages other than those of LANGUAGES count as one, unknown. A target listed twice counts once, by its larger share.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as win

from ..session import cut

#: Targets are read by the driver: a mixture has at most so many sources.
MAX_SOURCES = 100_000
#: Languages that are levels of the tree of their own.
LANGUAGES = ("en", "es")
#: Ranges of the hash order of a source's documents that are summed before one range is looked into.
RANGES = 4096


@dataclass
class Node:
    name: tuple[str, ...]
    weight: float = 0.0
    most: float = 0.0
    budget: float = 0.0
    children: list["Node"] = field(default_factory=list)


def share_out(node: Node, budget: float) -> None:
    """Give a budget to a node and down to its leaves; no node gets more than it can supply, siblings take up what is left."""
    node.budget = min(budget, node.most)
    open_, rest = [c for c in node.children if c.most > 0 and c.weight > 0], node.budget
    given = {id(c): 0.0 for c in node.children}
    while open_ and rest > 1e-9:
        weight = sum(c.weight for c in open_)
        full = [c for c in open_ if given[id(c)] + rest * c.weight / weight >= c.most]
        if not full:
            for c in open_:
                given[id(c)] += rest * c.weight / weight
            break
        for c in full:
            rest -= c.most - given[id(c)]
            given[id(c)] = c.most
        open_ = [c for c in open_ if c not in full]
    for c in node.children:
        share_out(c, given[id(c)])


def tree(leaves: list[tuple[tuple[str, str, str], float, float]]) -> Node:
    """leaves: ((domain, language, source), target weight, tokens it can supply)."""
    root, at = Node(()), {}
    at[()] = root
    for path, weight, most in leaves:
        for depth in range(1, 4):
            if path[:depth] not in at:
                at[path[:depth]] = Node(path[:depth])
                at[path[: depth - 1]].children.append(at[path[:depth]])
        for depth in range(4):
            at[path[:depth]].weight += weight
            at[path[:depth]].most += most
    return root


def budgets(leaves: list[tuple[tuple[str, str, str], float, float]], total: float | None = None) -> dict[tuple[str, ...], float]:
    """Tokens to draw from each leaf, by its path."""
    supplied = [(w, m) for _, w, m in leaves if m > 0 and w > 0]
    if not supplied:
        return {p: 0.0 for p, _, _ in leaves}
    root = tree(leaves)
    if total is None:  # the largest total at which nobody falls short: it grows until the first leaf is full
        lo, hi = 0.0, root.most
        for _ in range(60):
            mid = (lo + hi) / 2
            share_out(root, mid)
            short = any(n.budget >= n.most * (1 - 1e-12) for n in _leaves(root) if n.most > 0 and n.weight > 0)
            lo, hi = (lo, mid) if short else (mid, hi)
        total = lo
    share_out(root, total)
    return {n.name: n.budget for n in _leaves(root)}


def _leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in _leaves(c)] if node.children else [node]


def mix(docs: DataFrame, targets: DataFrame, *, total_tokens: float | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """Draw from docs (doc_id, source, kind, lang, n_tokens) by targets (source, target_share, max_passes).

    Returns the drawn rows (source, doc_id, n_tokens, epoch, passes: whole copies this row stands for) and the report, a row a leaf (source,
    domain, language, target_share, actual_share, drawn_tokens, budget_tokens, passes_used, max_passes); shares of a source's leaves add up to the source's.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.filter("source is not null and n_tokens > 0")
    language = F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise("")
    docs = docs.withColumn("domain", F.coalesce("kind", F.lit(""))).withColumn("language", language)
    leaf = ["source", "domain", "language"]
    of = docs.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    listed = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max_by("max_passes", F.struct("target_share", "max_passes")).alias("max_passes")).limit(MAX_SOURCES + 1)
    rows = [r for r in listed.join(of, "source", "left").collect() if r.source is not None]
    if len({r.source for r in rows}) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources are listed")
    held: dict[str, int] = {}
    for r in rows:
        held[r.source] = held.get(r.source, 0) + (r.tokens or 0)
    path = lambda r: (r.domain or "", r.language or "", r.source)
    weight = {path(r): max(0.0, r.target_share or 0.0) * (r.tokens / held[r.source] if r.tokens else 1.0) for r in rows}
    quota = budgets([(path(r), weight[path(r)], float((r.tokens or 0) * max(0, r.max_passes or 0))) for r in rows], total_tokens)
    plan = []
    for r in rows:
        passes = int(quota[path(r)] // r.tokens) if r.tokens else 0
        plan.append((r.source, r.domain or "", r.language or "", passes, quota[path(r)] - passes * (r.tokens or 0)))
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, domain string, language string, whole int, rest double"))  # leaves of at most MAX_SOURCES sources, 60 bytes each

    drawn = docs.join(plan_df, leaf).filter("whole > 0 or rest > 0")
    key = F.xxhash64("source", "doc_id", "whole", F.lit(seed))
    drawn = drawn.select(*leaf, "doc_id", "n_tokens", "whole", "rest", key.alias("key"), F.pmod(F.shiftrightunsigned(key, 40), F.lit(RANGES)).cast("int").alias("range"))
    # the prefix: sums by range of the hash order, then an order within ranges; a source is never in one task
    sums = drawn.filter("rest > 0").groupBy(*leaf, "range").agg(F.sum("n_tokens").alias("t"))
    before = sums.select(*leaf, "range", (F.sum("t").over(win.Window.partitionBy(*leaf).orderBy("range")) - F.col("t")).alias("before"))
    inner = F.sum("n_tokens").over(win.Window.partitionBy(*leaf, "range").orderBy("key", "doc_id").rowsBetween(win.Window.unboundedPreceding, -1))
    part = drawn.filter("rest > 0").join(before, [*leaf, "range"]).withColumn("upto", F.col("before") + F.coalesce(inner, F.lit(0)))
    # the document that crosses the budget is taken if more than half of it fits
    part = part.filter(F.col("upto") + F.col("n_tokens") / 2 <= F.col("rest")).select(*leaf, "doc_id", "n_tokens", F.col("whole").alias("epoch"), F.lit(1).alias("passes"))
    full = drawn.filter("whole > 0").select(*leaf, "doc_id", "n_tokens", F.lit(0).alias("epoch"), F.col("whole").alias("passes"))
    rows_drawn = cut(full.unionByName(part))

    got = rows_drawn.groupBy(*leaf).agg(F.sum(F.col("n_tokens") * F.col("passes")).alias("drawn_tokens"))
    facts = spark.createDataFrame(
        [(r.source, r.domain or "", r.language or "", weight[path(r)], r.max_passes, float(r.tokens or 0), quota[path(r)]) for r in rows],
        "source string, domain string, language string, target_share double, max_passes int, source_tokens double, budget_tokens double",
    )
    report = facts.join(got, leaf, "left").withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0)).cast("long"))
    whole = report.agg(F.sum("drawn_tokens").alias("_all"))
    report = report.crossJoin(whole).select(  # one row on the right
        "source", "domain", "language", "target_share", F.when(F.col("_all") > 0, F.col("drawn_tokens") / F.col("_all")).otherwise(0.0).alias("actual_share"), "drawn_tokens",
        F.round("budget_tokens").cast("long").alias("budget_tokens"), F.when(F.col("source_tokens") > 0, F.col("drawn_tokens") / F.col("source_tokens")).otherwise(0.0).alias("passes_used"), "max_passes",
    )
    return rows_drawn.drop("domain", "language"), report
