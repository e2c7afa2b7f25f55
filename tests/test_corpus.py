from pyspark.sql import functions as F

from gablework.functions import text as T
from gablework.functions import urls as U
from gablework.operators import corpus as C
from gablework.operators.graph import components


def test_outcomes(spark):
    stored = spark.createDataFrame([("s1", "h1"), ("s2", "h2")], "id string, content_hash string")
    arriving = spark.createDataFrame([("s1", "h1", 1), ("s2", "h9", 2), ("n1", "h1", 3), ("n2", "h5", 4), ("n3", "h5", 5), ("n2", "h5", 6)], "id string, content_hash string, seq int")
    got = sorted((r.id, r.seq, r.outcome, r.twin) for r in C.ingest_outcomes(arriving, stored).collect())
    assert got == [("n1", 3, "duplicate", "s1"), ("n2", 4, "added", None), ("n2", 6, "skipped", None), ("n3", 5, "duplicate", "n2"), ("s1", 1, "skipped", None), ("s2", 2, "updated", None)]


def test_windows_and_merging(spark):
    segs = spark.createDataFrame([(1, i, float(10 * i), float(10 * i + 9), f"w{i}") for i in range(6)] + [(2, 0, 0.0, 0.0, "a"), (2, 1, 0.0, 0.0, "b")], "doc_id long, no long, start double, end double, text string")
    got = {(r.doc_id, r.window_no): (r.first_no, r.last_no) for r in C.hopping_windows(segs, width=20.0, overlap=5.0).collect()}
    assert got[(1, 0)] == (0, 1) and got[(1, 1)] == (2, 3) and got[(1, 2)] == (3, 4) and (2, 0) in got
    merged = [(r.doc_id, r.group_no, r.text) for r in C.merged_segments(segs, 25.0).orderBy("doc_id", "group_no").collect()]
    assert merged == [(1, 0, "w0 w1"), (1, 1, "w2 w3"), (1, 2, "w4 w5"), (2, 0, "a"), (2, 1, "b")]


def test_passages(spark):
    text = "\n\n".join(" ".join(f"p{k}w{i}" for i in range(8)) for k in range(5)) + "\n\n" + ". ".join(" ".join(f"s{k}x{i}" for i in range(6)) for k in range(6)) + "."
    rows = C.passages(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), target=20, overlap=4).orderBy("idx").collect()
    assert {r.doc_id for r in rows} == {1}
    assert rows[1].text.split()[:4] == rows[0].text.split()[-4:]
    assert all(len(r.text.split()) <= 24 for r in rows)


def test_boilerplate(spark):
    docs = spark.createDataFrame([(i, "a", f"Menu\n own {i}\nFoot ") for i in range(5)] + [(9, "b", "Menu\nFoot")], "doc_id long, source string, text string")
    assert {(r.source, r.line) for r in C.shared_lines(docs).collect()} == {("a", "Menu"), ("a", "Foot")}
    assert {r.text for r in C.strip_shared_lines(docs).filter("doc_id = 3").collect()} == {" own 3"}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 102), (101, 103)]
    got = {r.node: r.class_id for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 104)} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_urls_and_text(spark):
    df = spark.createDataFrame([("HTTPS://WWW.Site.example/a/b/?utm_source=x&b=2&a=1#top",)], "u string")
    r = df.select(U.canonical(F.col("u")), U.host_key(F.col("u"))).first()
    assert r[0] == "https://www.site.example/a/b?a=1&b=2" and r[1] == "site.example"
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(T.tokens(F.lit("The owner's 'lease' isn't 2 late"))) == ["owner", "lease", "2", "late"]
    assert one(T.thread_title(F.lit("hello, please who pays for the very long and winding repair of the boiler in spring"))) == "Who pays for the very long and winding repair of the boiler"
    assert one(T.figures(F.lit("$1,200.50 or 5.0 % and $1200.5"))) == ["$1200.5", "5%"]
    assert one(T.markers(F.lit("a [S2] b [S1][S2] [S9]"), F.lit(3))) == [2, 1]
    assert one(T.document_id(F.lit("website"), F.lit("https://x"))).startswith("website-") and one(T.csv_safe(F.lit("=1+1"))) == "'=1+1"
