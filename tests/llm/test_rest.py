import numpy as np
import pytest

from gablework.llm import canonical, mix, pack, tokens

REFS = [(1, "v", "Ellowby Painting", []), (2, "v", "Ellowby Locksmiths", ["lock shop"]), (3, "v", "Larkfield", []), (4, "v", "Harrowgate North", None), (5, "v", "Harrowgate South", [])]


@pytest.mark.parametrize(
    ("value", "ref"),
    [("ellowby painting LLC", 1), ("Ellowby Paniting", 1), ("the lock shop (city)", 2), ("harowgate n.", 4), ("Harrowgate-S", 5), ("Harrowgate", 0), ("Ellowby Heating", 0), ("larkfeild", 3), ("gift", 0), ("??", 0), ("Larkfield and Harrowgate North", 4)],
)
def test_match(value, ref):
    m = canonical.Matcher("log_entries.vendor", [(r[0], r[2], r[3]) for r in REFS])
    assert m.match(value) == ref


def test_edits():
    assert canonical.edits("abc", "acb", 3) == 1 and canonical.edits("abc", "abc", 3) == 0 and canonical.edits("kitten", "sitting", 3) == 3 and canonical.edits("ab", "wxyz", 2) == 3


def test_map_values(spark):
    refs = spark.createDataFrame(REFS, "ref_id long, field string, canonical string, aliases array<string>")
    rows = spark.createDataFrame([("a", "Larkfield", 1), ("b", " larkfield", 1), ("b", " larkfield", 1), ("c", None, 1), ("d", "  ", 1), (None, "x", 1), ("e", "x" * 100_000, 1)], "id string, vendor string, ref_id int")
    out = {r.row_key: r.ref_id for r in canonical.map_values(rows, refs, {"v": "vendor"}).collect()}
    assert out == {"b": 3, "e": 0}
    assert canonical.map_values(rows, refs.limit(0), {"v": "vendor"}).filter("ref_id <> 0").count() == 0
    assert canonical.map_values(rows.limit(0), refs, {"v": "vendor"}).count() == 0


def test_pack(spark):
    r = np.random.default_rng(3)
    sizes = np.sort(r.integers(1, 900, 3000))[::-1]
    where = pack.assign(sizes, 2048)
    load = np.bincount(where, sizes)
    assert load.max() <= 2048 and sizes.sum() / (2048 * len(load)) > 0.99 and (where >= 0).all()
    rows = [(1, 5000), (2, 0), (3, None), (4, 2048), (5, 10), (6, 1), (7, 4096)]
    out = pack.pack(spark.createDataFrame(rows, "doc_id long, n_tokens int")).collect()
    parts = {d: sorted((p.start_token, p.n_tokens) for p in out if p.doc_id == d) for d in {p.doc_id for p in out}}
    assert parts == {1: [(0, 2048), (2048, 2048), (4096, 904)], 4: [(0, 2048)], 5: [(0, 10)], 6: [(0, 1)], 7: [(0, 2048), (2048, 2048)]}
    assert pack.pack(spark.createDataFrame([], "doc_id long, n_tokens int")).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world <|endoftext|>"), (4, "a" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    assert got[1] == got[2] == 0 and got[3] > 4 and got[4] > 1000


def test_budgets_redistribute():
    leaves = [(("web", "en", "a"), 0.4, 1000.0), (("web", "en", "b"), 0.2, 10.0), (("web", "es", "c"), 0.2, 1000.0), (("pod", "en", "d"), 0.2, 1000.0), (("", "", "e"), 0.0, 0.0)]
    got = mix.budgets(leaves, 500)
    got = {k[2]: v for k, v in got.items()}
    assert got["b"] == 10 and abs(got["a"] - (0.6 * 500 - 10)) < 1e-6 and abs(got["c"] - 100) < 1e-6 and abs(sum(got.values()) - 500) < 1e-6
    assert mix.budgets([(("web", "en", "a"), 1.0, 0.0)]) == {("web", "en", "a"): 0.0}


def test_shortage_at_each_level(spark):
    # web: en (a short, b takes it), es (both short, en takes the rest); pod: short as a whole, web takes the rest
    tokens_of = {("web", "en", "a"): 10, ("web", "en", "b"): 900, ("web", "es", "b"): 20, ("web", "es", "c"): 10, ("pod", "en", "d"): 30}
    docs = [(k * 1000 + i, s, d, lang, 1, "x") for k, ((d, lang, s), n) in enumerate(tokens_of.items()) for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, source string, kind string, lang string, n_tokens int, target_share string")
    t = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 1), ("c", 0.2, 1), ("d", 0.2, 1), ("gone", 0.1, 9)], "source string, target_share double, max_passes int")
    drawn, report = mix.mix(df, t, total_tokens=500.0)
    got = {(r.domain, r.language, r.source): r.drawn_tokens for r in report.collect()}
    assert got[("web", "en", "a")] == 10 and got[("web", "es", "c")] == 10 and got[("pod", "en", "d")] == 30
    assert abs(sum(got.values()) - 500) <= 2 and got[("web", "en", "b")] + got[("web", "es", "b")] == sum(got.values()) - 50
    assert drawn.columns == ["source", "doc_id", "n_tokens", "epoch", "passes"]
    # below the first shortage shares are exact
    _, small = mix.mix(df, t)
    share = {}
    for r in small.collect():
        share[r.source] = share.get(r.source, 0) + r.actual_share
    assert all(abs(share[s] - w) < 0.1 for s, w in (("a", 0.3), ("b", 0.3), ("c", 0.2), ("d", 0.2)))


def test_mix(spark):
    docs = [(i, "big" if i % 3 else "small", "website", "en", 10 + i % 7) for i in range(900)] + [(9000, None, "website", "en", 5), (9001, "other", "website", "en", 5)]
    df = spark.createDataFrame(docs, "doc_id long, source string, kind string, lang string, n_tokens int")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("none", 0.1, 3)], "source string, target_share double, max_passes int")
    drawn, report = mix.mix(df, t)
    r = {x.source: x for x in report.collect()}
    assert abs(r["big"].actual_share - 0.5 / 0.9) < 0.01 and r["none"].drawn_tokens == 0
    assert all(x.passes_used <= x.max_passes + 1e-9 for x in r.values())
    assert drawn.filter("source not in ('big', 'small')").count() == 0
    _, empty = mix.mix(df.limit(0), t)
    assert {x.drawn_tokens for x in empty.collect()} == {0}
