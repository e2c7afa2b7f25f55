"""Retrieval in blocks gives what joining every question with every posting gives, over lanes, blocks and ties."""

import random

import pytest
from pyspark.sql import functions as F

from gablework.operators import blocks
from gablework.operators import retrieval as R

WORDS = "boiler lease roof deposit rent gutter porch mold heat permit".split()


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(4)
    kinds = {d: r.choice(["youtube", "podcast", "website"]) for d in range(40)}
    rows = []
    for i in range(300):
        d = r.randrange(40)
        vec = [float(r.randrange(3)) for _ in range(4)] if r.random() < 0.9 else None  # many equal vectors
        text = " ".join(r.choices(WORDS, k=r.randrange(0, 7)))
        rows.append((f"c{r.randrange(10**6):06d}-{i}", d, kinds[d], None if kinds[d] == "website" else str(d % 5), r.choice(["Deed Desk", "Other", None]), text, "m", vec))
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id long, kind string, episode string, channel string, text string, model string, embedding array<float>")
    questions = spark.createDataFrame([(f"q{i}", " ".join(r.choices([*WORDS, "unheard"], k=i % 5))) for i in range(23)], "query_id string, text string")
    vectors = spark.createDataFrame([(f"q{i}", "m", [float(r.randrange(3)) for _ in range(4)]) for i in range(0, 23, 2)], "id string, model string, embedding array<float>")
    return chunks, questions, vectors


def rows(df, *cols):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect()), key=str)


@pytest.fixture()
def small(monkeypatch):
    """Several lanes, blocks and pieces also in a small corpus."""
    real = blocks.in_blocks
    monkeypatch.setattr(blocks, "PIECE", 64)
    monkeypatch.setattr(blocks, "in_blocks", lambda *a, **k: real(*a, **{"lane_rows": 70, "questions": 5, **k}))


@pytest.fixture()
def fused(tables):
    chunks, questions, vectors = tables
    near = R.ranked(R.cosine(vectors, chunks.select(F.col("chunk_id").alias("id"), "model", "embedding")))
    return R.fuse(R.ranked(R.bm25(R.build_index(chunks), questions)), near)


def no_pairs(monkeypatch):
    """The forms that join every question with every posting must not be called."""

    def fail(*a, **k):
        raise AssertionError("pairs are joined")

    monkeypatch.setattr(R, "bm25", fail)
    monkeypatch.setattr(R, "overlap", fail)


def test_bm25_topk(tables, small, monkeypatch):
    index = R.build_index(tables[0])
    want = rows(R.ranked(R.bm25(index, tables[1]), 8), "query_id", "chunk_id", "rank", "score")
    no_pairs(monkeypatch)
    assert rows(R.bm25_topk(index, tables[1], 8), "query_id", "chunk_id", "rank", "score") == want and want


def test_equal_vectors_go_by_id(spark):
    rows = spark.createDataFrame([(f"c{i:03d}", "m", [1.0, 1.0]) for i in reversed(range(60))], "id string, model string, embedding array<float>")
    got = R.cosine(spark.createDataFrame([("q", "m", [1.0, 0.0])], rows.schema), rows, k=5).collect()
    assert sorted(r.chunk_id for r in got) == [f"c{i:03d}" for i in range(5)]


def retrieved(fused, chunks, k):
    best = R.one_per_episode(fused.join(chunks.select("chunk_id", "doc_id", "kind", "episode"), "chunk_id"))
    place = F.row_number().over(R.win.Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k)


def test_retrieve(tables, small, fused, monkeypatch):
    cols = ("query_id", "chunk_id", "rank", "score", "lexical_rank", "vector_rank")
    want = rows(retrieved(fused, tables[0], 8), *cols)
    no_pairs(monkeypatch)
    assert rows(R.retrieve(*tables), *cols) == want and want


def test_verdicts(tables, small, monkeypatch):
    index = R.build_index(tables[0])
    lex = R.bm25(index, tables[1]).groupBy("query_id").agg(F.max("score").alias("b"), F.count("*").alias("n")).collect()
    held = R.overlap(index, tables[1]).groupBy("query_id").agg(F.max("score").alias("h")).collect()
    want = {r.query_id: len(set(r.text.split())) for r in tables[1].collect()}
    no_pairs(monkeypatch)
    got = {r.query_id: r for r in R.verdicts(*tables).collect()}
    b, n, h = {r.query_id: r.b for r in lex}, {r.query_id: r.n for r in lex}, {r.query_id: r.h for r in held}
    assert got.keys() == want.keys()
    for q, r in got.items():
        assert abs(r.top_bm25 - b.get(q, 0)) < 1e-9 and r.positives == n.get(q, 0) and abs(r.overlap_ratio - h.get(q, 0) / max(1, want[q])) < 1e-9


def test_moments(tables, small, fused, monkeypatch):
    found = fused.join(tables[0].select("chunk_id", "doc_id", "kind", "channel"), "chunk_id")
    cols = ("query_id", "doc_id", "chunk_id", "place")
    want = rows(R.best_per_document(found, limit=5, channel="Desk"), *cols)
    no_pairs(monkeypatch)
    assert rows(R.moments(*tables, limit=5, channel="Desk"), *cols) == want and want


def test_fusion(tables, small, fused, monkeypatch):
    cols = ("query_id", "chunk_id", "lexical_rank", "vector_rank", "score")
    want = rows(fused.withColumn("score", F.round("score", 7)), *cols)
    with monkeypatch.context() as m:
        m.setattr(blocks, "FULL_ROWS", 0)  # the form for a corpus that no task can hold
        assert rows(R.fusion(*tables), *cols) == want
    no_pairs(monkeypatch)
    assert rows(R.fusion(*tables), *cols) == want and want


def test_overlap_topk(tables, small, monkeypatch):
    index = R.build_index(tables[0])
    want = rows(R.ranked(R.overlap(index, tables[1]), 8), "query_id", "chunk_id", "rank", "score")
    no_pairs(monkeypatch)
    assert rows(R.overlap_topk(index, tables[1], 8), "query_id", "chunk_id", "rank", "score") == want and want


def test_topic_quotes(tables, small, fused, monkeypatch):
    chunks = tables[0]
    quotes = lambda found: rows(R.topic_quotes(found.select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", "kind", "text", F.lit("t").alias("title")), "chunk_id"), kind="website"), "query_id", "chunk_id", "place", "quote")
    want = quotes(retrieved(fused, chunks, 32))
    no_pairs(monkeypatch)
    assert quotes(R.retrieve(*tables, k=32)) == want and want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_copies_of_the_corpus_are_shuffled(tables, small):
    # 23 questions in blocks of 5: the corpus was copied into an exchange once for each
    assert "Exchange" not in plan(R.retrieve(*tables, k=32))


def test_long_counts_keep_their_value(spark):
    # a term said 70,000 times by one passage, among passages that say it a few times
    chunks = spark.createDataFrame([("c1", "boiler " * 70_000), ("c2", "boiler"), ("c3", "lease boiler boiler"), *((f"d{i}", "roof") for i in range(9))], "chunk_id string, text string")
    index, questions = R.build_index(chunks), spark.createDataFrame([("q", "boiler lease")], "query_id string, text string")
    want = rows(R.bm25(index, questions), "query_id", "chunk_id", "score")
    assert rows(R.bm25_topk(index, questions, 9), "query_id", "chunk_id", "score") == want and len(want) == 3


def test_texts_come_to_the_passages_that_are_quoted(spark, tables, fused, monkeypatch):
    chunks = tables[0].withColumn("text", F.concat(F.lit(" a  "), "text", F.lit(" b")))
    titles = spark.createDataFrame([(d, None if d % 3 == 0 else f"t{d}") for d in range(40)], "doc_id long, title string")
    found = retrieved(fused, chunks, 32).select("query_id", "chunk_id", "rank")
    cols = ("query_id", "chunk_id", "place", "quote", "said_in")
    want = rows(R.topic_quotes(found.join(chunks, "chunk_id").join(titles, "doc_id"), kind="website", chars=9), *cols)
    few = R.quotes_of(found.join(chunks.select("chunk_id", "doc_id", "kind"), "chunk_id"), chunks.select("chunk_id", "text"), titles, kind="website", chars=9)
    assert rows(few, *cols) == want and want
    assert "hashpartitioning" not in plan(few)
    real = R.join_sized
    monkeypatch.setattr(R, "join_sized", lambda *a, **k: real(*a, **{**k, "max_rows": 2}))  # the form for quotes that are not few
    assert rows(R.quotes_of(found.join(chunks.select("chunk_id", "doc_id", "kind"), "chunk_id"), chunks.select("chunk_id", "text"), titles, kind="website", chars=9), *cols) == want
