"""Golden values and edge cases of labels, notes, places, risks, typed input and upkeep."""

import datetime as dt

from pyspark.sql import functions as F

from gablework.functions import deals, flags
from gablework.functions import text as T
from gablework.operators import activity as A
from gablework.operators import corpus as C
from gablework.operators import facts as X
from gablework.operators import ledger as L
from gablework.operators import upkeep as U
from gablework.sources import html


def col(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_prices(spark):
    got = col(spark, ["from $1,200 to $900", "$4k-5k", "$2.50 each", "costs 300", "", None, "$ and $7", "$40 then 50"], X.price)
    assert [tuple(x) if x else None for x in got] == [(900, 1200), (4000, 5000), (2.5, 2.5), None, None, None, None, (40, 40)]


def test_labels(spark):
    rows = [("cost", "the rule", "asking rent", None, "q", None, None, None, None), ("cost", "r", "roof", "each", "it would pass", "section 5", "s", 1.0, None), ("rule", "r section 9", None, None, None, "s", "s", None, None)]
    df = spark.createDataFrame(rows, "kind string, rule string, topic string, unit string, quote string, citation string, source string, low double, high double")
    got = [(r.has_price, r.is_rent, r.is_pending, r.cites) for r in X.labelled(df, rent=r"\brent\b", pending=r"\bwould\b", section=r"section \d").collect()]
    assert got == [(False, True, False, False), (True, False, True, True), (True, False, False, True)]
    assert X.labelled(df.limit(0), rent="a", pending="b", section="c").count() == 0


def test_topicality(spark):
    fn = lambda c: X.topicality(c, phrases=("coach house",), strong=("tenant", "lease"), weak=("roof", "repair"))
    got = [(x.on_topic, x.why) for x in col(spark, ["The Coach House", "a tenant and a lease", "roof repair", "roof", "x", ""], fn)]
    assert got == [(True, 'the phrase "coach house"'), (True, "the word lease, tenant"), (True, "the words repair, roof"), (False, "only roof, which needs a second word"), (False, "nothing on the topic"), (False, "nothing on the topic")]


def test_dates_and_quotes(spark):
    docs = spark.createDataFrame([(1, "T", "2020-01-01"), (2, "T", "2021-01-01"), (3, "T", " "), (4, None, "2022-01-01")], "doc_id int, title string, published_at string")
    props = spark.createDataFrame([("a", "T"), ("b", "U"), ("c", None)], "id string, title string")
    assert {r.id: r.dated for r in X.dated_by_title(props, docs).collect()} == {"a": "2021-01-01", "b": None, "c": None}
    entries = spark.createDataFrame([(1, "p", "Tenants must pay by noon"), (2, "p", "Tenants may pay by noon"), (3, "z", "x"), (4, "p", None)], "id int, passage string, quote string")
    passages = spark.createDataFrame([("p", "All  tenants MUST pay\nby noon.")], "passage string, text string")
    assert [r.outcome for r in X.dispatched(entries, passages).orderBy("id").collect()] == ["kept", "not its words", "no passage", "not its words"]


def test_notes_and_answers(spark):
    got = [tuple(x) for x in col(spark, ["From: it is so", "Wrong year. From: it is so", "mail From: bob", "", None, "only mine"], T.split_note)]
    assert got == [("it is so", ""), ("it is so", "Wrong year."), ("", "mail From: bob"), ("", ""), ("", ""), ("", "only mine")]
    assert col(spark, ["a — b–c  d"], T.plain_punctuation) == ["a - b - c d"]
    fn = lambda c: T.without_notice(c, "(?i)not legal advice")
    assert col(spark, ["Pay it.\n\nKeep it. This is not legal advice.", "Pay it.\n\nNot legal advice.", "Not legal advice.", "Pay it."], fn) == ["Pay it.\n\nKeep it.", "Pay it.", "Not legal advice.", "Pay it."]


def test_places_and_risks(spark):
    place = lambda c: flags.place_flag(c, home=("chicago",), region=("peoria",), cities=("boston",), states=("indiana", "texas"), before=("in", "en"), nouns=("law",), suffixes=("ave", "st"))
    assert col(spark, ["A flat in Boston", "a flat in Indiana", "on Indiana Ave", "in Indiana Ave", "Texas law", "Peoria", "Peoria or Chicago", None, ""], place) == ["outside", "outside", None, None, "outside", "region", None, None, None]
    risk = lambda c: flags.risk(c, phrases=("change the locks",), terms=("voucher", "section 8"), acts=r"\brefuse\b|\bkeep\s+(?:\w+\s+){0,5}?out\b")
    said = ["Can I refuse vouchers?", "how do I keep section 8 tenants out", "refuse " + "x " * 14 + "voucher", "I can change the locks", "voucher", None, "Section 8s, I refuse"]
    assert col(spark, said, risk) == [True, True, False, True, False, False, True]


def test_typed_input(spark):
    rows = [("a", " Flat\t1 ", "3.7"), ("b", " ", "2"), ("c", "x", "two"), ("d", "x", "0"), ("e", "x", None), ("f", "x", "9000"), ("g", None, "1"), ("h", "x", "-1")]
    got = {r.id: (r.units, r.problem) for r in L.validate_properties(spark.createDataFrame(rows, "id string, label string, units string")).collect()}
    assert got == {"a": (3, None), "b": (None, "label"), "c": (None, "units is no number"), "d": (None, None), "e": (None, None), "f": (None, "units out of range"), "g": (None, "label"), "h": (None, "units out of range")}
    df = spark.createDataFrame([(1, 100.0, 0.05, 30, 1.0), (2, 0.0, 0.05, 30, 1.0), (3, 100.0, 6.5, 30, 1.0), (4, 100.0, 0.05, 51, 1.0), (5, 100.0, 0.05, 30, -1.0), (6, None, 0.05, 30, 1.0)], "i int, p double, r double, y int, c double")
    wrong = [r.x for r in df.orderBy("i").select(deals.problem(price=F.col("p"), rate=F.col("r"), years=F.col("y"), amounts={"costs": F.col("c")}).alias("x")).collect()]
    assert [bool(x) for x in wrong] == [False, True, True, True, True, True] and wrong[4] == "costs cannot be negative"


def test_properties_resolved(spark):
    p = spark.createDataFrame([("p1", "o", "Oak Street 5", "Riverside", dt.datetime(2020, 1, 1)), ("p2", "o", "Elm", "Riverside", dt.datetime(2019, 1, 1)), ("p3", "solo", None, None, None)], "id string, owner_id string, label string, city string, created_at timestamp")
    asks = [("1", "o", "p1"), ("2", "o", "elm "), ("3", "o", "oak street"), ("4", "o", "RIVERSIDE"), ("5", "solo", None), ("6", "o", ""), ("7", "o", "oak street"), ("8", "nobody", "x"), ("9", "o", "oa")]
    got = {r.ask_id: (r.property_id, r.rank) for r in L.resolve_property(spark.createDataFrame(asks, "ask_id string, owner_id string, text string"), p).collect()}
    assert got == {"1": ("p1", 1), "2": ("p2", 2), "3": ("p1", 3), "4": ("p2", 4), "5": ("p3", 5), "7": ("p1", 3)}


def test_days_and_tails(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 10, m)
    log = spark.createDataFrame([(i, at(i % 3)) for i in range(9)] + [(99, dt.datetime(2024, 1, 2))], "id int, asked_at timestamp")
    got = {r.id: (r.nth, r.allowed) for r in A.daily_cap(log, 4).collect()}
    assert got[0] == (1, True) and got[6] == (3, True) and got[1] == (4, True) and got[4] == (5, False) and got[99] == (1, True)
    msg = lambda *t: [("user", x) for x in t]
    threads = spark.createDataFrame([("a", "o", at(0), msg("first words")), ("b", "o", at(1), msg("second", None)), ("c", "p", at(2), msg())], "id string, owner_id string, updated_at timestamp, messages array<struct<role string, content string>>")
    assert {r.owner_id: r.transcript for r in A.transcript_tail(threads, 16).collect()} == {"o": "…r: second\nuser: ", "p": ""}


def test_twins_and_outcomes(spark):
    docs = spark.createDataFrame([("b", "h", "l2"), ("a", "h", "l1"), ("c", "g", "l3"), ("d", None, "l4")], "id string, content_hash string, locator string")
    assert [(r.id, r.twin) for r in C.twins(docs).collect()] == [("b", "a")]
    assert C.twins(docs.limit(0)).count() == 0


def test_crawl_goes_on_until_nothing_is_new(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("z", "w")], "url string, link string")
    starts = spark.createDataFrame([("a",), ("x",)], "url string")
    assert {r.url: r.hops for r in html.crawl_order(links, starts).collect()} == {"a": 0, "b": 1, "c": 2, "x": 0, "y": 1}
    assert {r.url for r in html.crawl_order(links, starts, most_hops=1).collect()} == {"a", "b", "x", "y"}
    assert html.crawl_order(links, starts.limit(0)).count() == 0


def test_upkeep(spark):
    assert col(spark, ["HTTP 429", "No payment method; rate limit", "gone", None], U.failure_class) == ["limited", "unpaid", "other", "other"]
    none = U.run_summary(spark.createDataFrame([], "id string, outcome string")).first()
    assert tuple(none) == (0, 0, 0, 0, 0)
    found = spark.createDataFrame([(1, "page", ["x"]), (1, "file", []), (1, "cache", ["y"]), (2, "guess", ["z"]), (3, "page", None)], "video_id int, source string, segments array<string>")
    assert [(r.video_id, r.source) for r in U.first_source(found, ("file", "cache", "page")).collect()] == [(1, "cache")]
    t = lambda h: dt.datetime(2024, 1, 1, h)
    started = spark.createDataFrame([("a", "x", t(1)), ("a", "x", t(5)), ("b", "y", t(1))], "token string, account_id string, at timestamp")
    ended = spark.createDataFrame([("a", t(3)), ("b", t(2))], "token string, at timestamp")
    assert [(r.token, r.expires_at) for r in U.open_sessions(started, ended, 3600).collect()] == [("a", t(6))]
    assert col(spark, ["see p-1, p-2\n`p-2`", "", None], lambda c: U.undefined_ids(c, r"(p-\d+)", r"`(p-\d+)`")) == [["p-1"], [], None]


def test_picked(spark):
    g = spark.createDataFrame([("Roof", 3, False, True, False), ("roof", 1, False, True, True), ("lease", 5, True, False, True)], "topic string, support int, known boolean, wanted boolean, cited boolean")
    n = lambda **k: X.picked(g, **k).count()
    assert (n(), n(topic="ROOF"), n(least_support=2), n(most_support=3), n(new_only=True), n(wanted_only=True, cited_only=True), n(where=F.col("support") > 4)) == (3, 2, 2, 2, 2, 1, 1)
