import datetime as dt
import math
import random

from pyspark.sql import functions as F

from gablework.functions import contact, deals, flags
from gablework.operators import activity as A
from gablework.operators import facts as X
from gablework.operators import retrieval as R
from gablework.sources import feeds, html, transcripts


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


def test_bm25_by_hand(spark):
    texts = {"c1": "boiler repair cost", "c2": "boiler boiler lease", "c3": "roof leak", "c4": "", "c5": "deposit rules"}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    got = {r.chunk_id: r.score for r in R.bm25(R.build_index(chunks), spark.createDataFrame([("q", "boiler boiler cost")], "query_id string, text string")).collect()}
    toks = {k: v.split() for k, v in texts.items()}
    n, avg = 5, sum(map(len, toks.values())) / 5
    df = {t: sum(t in v for v in toks.values()) for t in {x for v in toks.values() for x in v}}
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else mean / 4 for t, v in idf.items()}
    want = {}
    for k, v in toks.items():
        s = sum(q * idf[t] * v.count(t) * 2.5 / (v.count(t) + 1.5 * (0.25 + 0.75 * len(v) / avg)) for t, q in (("boiler", 2), ("cost", 1)))
        if s > 0:
            want[k] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fusion_and_episodes(spark):
    mk = lambda ids: spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(ids)], "query_id string, chunk_id string, rank int")
    s = {r.chunk_id: r.score for r in R.fuse(mk("abc"), mk("bac")).collect()}
    assert s["a"] == s["b"] > s["c"]
    rows = [("q", "1", "d1", "podcast", "7", 0.9), ("q", "2", "d2", "youtube", "7", 0.5), ("q", "3", "d3", "podcast", "8", 0.4), ("q", "4", "d4", "podcast", "8", 0.3), ("q", "5", "d5", "website", None, 0.2)]
    kept = R.one_per_episode(spark.createDataFrame(rows, "query_id string, chunk_id string, doc_id string, kind string, episode string, score double"))
    assert sorted(r.chunk_id for r in kept.collect()) == ["2", "3", "4", "5"]


def test_coverage(spark):
    v = lambda *a: one(spark, R.coverage(*(F.lit(x) for x in a)))
    assert v(9.0, True, 0.0, False, 3, 1.0) == "covered" and v(9.0, True, 0.0, False, 1, 1.0) == "weak" and v(0.0, True, 0.0, False, 0, 0.7) == "weak" and v(0.0, True, 0.0, False, 0, 0.5) == "none"
    assert v(0.0, False, 0.6, True, 0, 0.0) == "covered" and v(1.0, True, 0.1, True, 5, 1.0) == "none" and v(3.0, True, 0.4, True, 5, 1.0) == "weak"


def test_limits(spark):
    t = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    hits = spark.createDataFrame([("k", t(s), i) for i, s in enumerate([0, 10, 20, 30, 61, 62, 71, 200])] + [("j", t(5), 99)], "key string, at timestamp, id int")
    got = {r.id: r.allowed for r in A.sliding_limit(hits, 3, 60).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True, 99: True}
    tries = spark.createDataFrame([("k", t(i), i, False) for i in range(6)] + [("k", t(90), 9, True)], "key string, at timestamp, id int, ok boolean")
    assert {r.id: r.blocked for r in A.lockouts(tries).collect()} == {**{i: False for i in range(5)}, 5: True, 9: False}


def test_facts(spark):
    rules = spark.createDataFrame([(1, "rent 2019", None, None), (2, "rent", "2025-01-01", None), (3, "rent 2024", None, "2024-12-31")], "id int, text string, effective_from string, effective_to string")
    rules = rules.select("id", "text", F.to_date("effective_from").alias("effective_from"), F.to_date("effective_to").alias("effective_to"))
    day = lambda d: F.to_date(F.lit(d))
    assert {r.id for r in X.in_force(rules, day("2024-12-31")).collect()} == {1, 3}
    assert {r.id for r in X.in_force(rules, day("2025-01-01")).collect()} == {1, 2}
    assert {r.id for r in X.stale(rules, day("2025-06-01"), pattern="rent").collect()} == {1, 2}
    p = one(spark, X.price(F.lit("about $2k to $1,500 a unit")))
    assert (p.low, p.high) == (1500.0, 2000.0)
    assert one(spark, X.quote_is_real(F.lit("Return  the deposit in time"), F.lit("You must return the\ndeposit in TIME.")))


def test_groups(spark):
    s = "id string, kind string, rule string, topic string, jurisdiction string, citation string, source string"
    raws = [
        ("1", "rule", "Pay interest within 30 days", "deposit interest", "A", "", "x"), ("2", "rule", "pay  interest within 30 days", "other words", "A", "", "y"), ("3", "rule", "Interest is due in 30 days", "deposit interest", "a", "5-12", "z"),
        ("4", "rule", "Interest of 45 days", "deposit interest", "A", "", "x"), ("5", "rule", "Interest goes out after 30 days", "deposit interest yearly", "A", "", "w"), ("6", "rule", "Interest is due in 30 days", "deposit interest", "B", "", "v"),
    ]
    known = spark.createDataFrame([("deposit",), ("interest",)], "term string")
    asked = spark.createDataFrame([(1, "when is deposit interest paid")], "query_id int, text string")
    g = {r.lead_id: r for r in X.review_order(X.grouped_proposals(spark.createDataFrame(raws, s), known, asked)).collect()}
    assert {k: v.support for k, v in g.items()} == {"3": 5, "4": 1} or {k: v.support for k, v in g.items()} == {"3": 4, "4": 1, "6": 1}
    assert g["3"].known and g["3"].wanted and g["3"].cited


def test_packs_are_in_one_order(spark):
    from gablework.operators import packs as P

    r = random.Random(6)
    rows = []
    for i in r.sample(range(400_000), 500):
        kind, number, date = r.choice(["website", "website", "podcast"]), r.choice(["7", "12", None, "x"]), r.choice(["2020-01-01", "2021-05-05", None])
        rows.append((i, kind, r.choice(["/blog/", "/"]), number, date, r.choice(["Roof", "door", None, "Attic"]), None, "x" * r.choice([5, 40, 90, 400])))
    docs = spark.createDataFrame(rows, "doc_id long, kind string, locator string, episode string, published_at string, title string, link string, text string")
    section = lambda x: "recordings" if x[1] != "website" else "posts" if x[2] == "/blog/" else "pages"
    rows.sort(key=lambda x: (x[5] is not None, (x[5] or "").lower(), x[0]))
    rows.sort(key=lambda x: x[4] or "" if section(x) == "posts" else "", reverse=True)
    rows.sort(key=lambda x: int(x[3]) if section(x) == "recordings" and x[3] in ("7", "12") else -1)
    got = {x.doc_id: (x.section, x.part, x.chars) for x in P.packed(P.rendered(docs), 300, 9).collect()}
    want, state = {}, {}
    for x in rows:
        part, size = state.get(section(x), (0, 0))
        n = got[x[0]][2]
        part, size = (part + 1, n) if size and size + n > 300 else (part, size + n)
        state[section(x)] = part, size
        want[x[0]] = (section(x), part, n)
    assert got == want


def test_every_unanswered_question_counts(spark, tmp_path):
    from gablework.plans import q_facts

    text = "The owner should keep 30 days of deposit interest in the ledger of the house."
    spark.createDataFrame([("c1", 1, text)], "id string, doc_id long, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(1, "website", "t", "l", "2020-01-01")], "doc_id long, kind string, title string, link string, published_at string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("none",)], "canonical string").write.parquet(f"{tmp_path}/ref_values.parquet")
    asked = [(7, True, "is the deposit held with interest"), (100, True, "ledger"), (200, False, "keep the ledger of the house")]
    spark.createDataFrame(asked, "id long, not_covered boolean, question string").write.parquet(f"{tmp_path}/questions_log.parquet")
    assert [(r.wanted, r.asked_for) for r in q_facts.proposal_groups(spark, str(tmp_path)).collect()] == [(True, True)]


def test_wanted_as_one_by_one(spark):
    r = random.Random(4)
    words = [f"term{c}" for c in "abcdefghijkl"]
    groups = {g: set(r.sample(words, r.randint(1, 4))) for g in range(60)}
    asked = [(q, " ".join(r.sample(words, r.randint(0, 3)))) for q in range(12)]
    terms = spark.createDataFrame([(g, w) for g, t in groups.items() for w in sorted(t)], "group_id int, w string")
    got = {x.group_id for x in X.wanted_groups(terms, spark.createDataFrame(asked, "query_id int, text string")).collect()}
    want = {g for g, t in groups.items() if any(len(t & set(q.split())) >= 2 for _, q in asked)}
    assert got == want and 0 < len(want) < 60


def test_deals_and_flags(spark):
    pay = lambda p, r, y: one(spark, deals.level_payment(F.lit(p), F.lit(r), F.lit(y)))
    assert pay(225000.0, 0.065, 30) == 1422.15 and pay(120000.0, 0.0, 10) == 1000.0 and pay(0.0, 0.05, 30) == 0.0 and pay(1.0, 0.05, 0) == 0.0
    f = one(spark, deals.cash_flow(F.lit(3000.0), F.lit(0.05), F.lit(100.0), F.lit(900.0), F.lit(1400.0)))
    assert (f.income, f.operating, f.month, f.year) == (2950.0, 2050.0, 650.0, 7800.0)
    assert one(spark, deals.one_percent(F.lit(300000), F.lit(3000))) and not one(spark, deals.one_percent(F.lit(300000), F.lit(2999)))
    assert one(spark, deals.cap_rate(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, flags.near(F.lit("can I refuse families with children"), ("refus",), ("children",))) and not one(spark, flags.near(F.lit("refuse " + "x " * 20 + "children"), ("refus",), ("children",)))
    assert one(spark, contact.us_phone(F.lit("+1 (773) 254-0199"))) == "7732540199" and one(spark, contact.us_phone(F.lit("123-456-7890"))) is None


def test_sources(spark):
    files = spark.createDataFrame(
        [("srt", "1\n00:00:01,500 --> 00:00:03,000\n<i>Hello</i> [music]\n\n2\n00:00:04,000 --> 00:00:05,000\n[noise]\n"), ("json", '{"segments": [{"start": "2", "duration": 3, "text": "a"}]}'), ("txt", "one\n\n two \n"), ("doc", "x"), ("json", "{bad")], "suffix string, text string"
    )
    got = [(r.suffix, [(s.start, s.end, s.text) for s in r.segments], r.problem is not None) for r in transcripts.parse(files).collect()]
    assert got[0] == ("srt", [(1.5, 3.0, "Hello")], False) and got[1][1] == [(2.0, 5.0, "a")] and got[2][1] == [(0.0, 0.0, "one"), (0.0, 0.0, "two")] and got[3][2] and got[4][1] == []
    t, text, links = html.read_html("<title>T &amp; U</title><nav><p>x</p><a href='/n'>n</a></nav><h1>Head</h1><p>a  b</p><p>a b</p><ul><li>one<p>two</p></li></ul><script>p()</script>")
    assert t == "T & U" and text == "Head\n\na b\n\nonetwo" and links == ["/n"]
    maps = spark.createDataFrame([("m", "<sitemapindex><sitemap><loc>n</loc></sitemap></sitemapindex>"), ("n", "<urlset><loc> https://a/1 </loc><loc>https://a/2</loc></urlset>")], "page string, xml string")
    assert {r.url for r in feeds.sitemap_urls(maps, "m").collect()} == {"https://a/1", "https://a/2"}
    eps = spark.createDataFrame([("g1", 12, "The deposit talk"), ("g2", None, "Why roofs always leak")], "guid string, number int, title string")
    fs = spark.createDataFrame([("/t/ep-12.txt",), ("/t/why-roofs-leak-always.srt",), ("/t/112.txt",)], "path string")
    assert {r.guid: r.path for r in feeds.transcript_for(eps, fs).collect()} == {"g1": "/t/ep-12.txt", "g2": "/t/why-roofs-leak-always.srt"}
    ch = feeds.chapters(spark.createDataFrame([("d", "intro\nCHAPTER 5-12\n\nRents\nbody\nCHAPTER 6\nX")], "doc string, text string")).collect()
    assert [(c.number, c.title) for c in ch] == [("5-12", "Rents"), ("6", "X")]


def test_catalogue_runs_without_the_subpackage():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_titles_manifest_and_reports(spark, tmp_path):
    import pytest

    from gablework.functions import titles
    from gablework.operators import corpus as C
    from gablework.sources import manifest

    g = lambda t, h=("Ann Bell",): one(spark, titles.guests(F.lit(t), F.array(*(F.lit(x) for x in h))))
    assert g("Ep. 12: Roofs and rent with Jo Cray, Ann Bell and Sam O'Neil") == ["Jo Cray", "Sam O'Neil"]
    assert g("#7 - Jo Cray: how to fix a roof") == ["Jo Cray"] and g("How to fix a roof") == []
    assert one(spark, titles.distinct_stems(F.array(F.lit("roofs"), F.lit("roof"), F.lit("lease")))) == ["roofs", "lease"]
    p = tmp_path / "m.yaml"
    p.write_text("websites:\n  - url: https://a.example/?token=x\n")
    m = manifest.load_manifest(str(p))
    assert m.counts()["websites"] == 1 and m.warnings(spark).count() == 1
    p.write_text("websites:\n  - url: ftp://a\n")
    with pytest.raises(ValueError):
        manifest.load_manifest(str(p))
    p.write_text("ordinances:\n  - {id: a, rule: r, citation: '1-2', effective_from: 2024-01-01}\ncosts:\n  - {id: c, item: i, low: 1, high: 2}\n")
    rules, costs = manifest.load_facts(spark, str(p))
    assert rules.first().effective_from == "2024-01-01" and costs.first().high == 2.0
    assert manifest.load_facts(spark, str(tmp_path / "none.yaml"))[0].count() == 0
    f = spark.createDataFrame([("u1", "timeout: 30 s"), ("u2", "timeout: 9 s"), ("u3", "gone")], "locator string, reason string")
    report = C.failure_report(f)
    assert [r.line for r in report.filter("h = 'timeout'").orderBy("line_no").collect()] == ["2 x timeout", "  u1: timeout: 30 s", "  u2: timeout: 9 s"]
    assert C.reasons_from_report(report, f.filter("locator = 'u2'")).first().reason == "timeout: 9 s"
