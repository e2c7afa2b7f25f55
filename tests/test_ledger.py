import datetime as dt

from pyspark.sql import functions as F

from gablework.functions import dates, money
from gablework.operators import ledger as L

S = "id string, owner_id string, property_id string, kind string, what string, amount double, vendor string, status string, happened_on string, created_at timestamp, urgency string, photo_path string, closed_at timestamp"
T0 = dt.datetime(2025, 3, 1, 12)


def rows(spark):
    e = lambda i, kind, amount, day, **k: (i, k.get("owner", "o1"), k.get("prop", "p1"), kind, k.get("what", "boiler"), amount, k.get("vendor", "V"), k.get("status", ""), day, T0, k.get("urgency", ""), None, None)
    data = [
        e("a", "income", 1000.10, "2025-03-01"), e("a", "income", 1000.10, "2025-03-01"), e("b", "expense", 200.05, "2025-02-11"), e("c", "bill", 99.99, "2025-02-30"), e("d", "maintenance", 40.0, "2025-01-05", status="open", urgency="urgent"),
        e("e", "maintenance", None, "2025-01-01", status="open", urgency="emergency"), e("f", "note", None, None, prop=None), e("g", "income", 5.0, "2025-03-09", owner="o2", prop="zz"), e("h", "maintenance", 7.0, "2024-01-01", status="open"),
    ]
    return L.entries(spark.createDataFrame(data, S))


def test_totals(spark):
    t = {r.owner_id: (r.money_in, r.money_out, r.net) for r in L.totals(rows(spark), ("owner_id",)).collect()}
    assert t == {"o1": (1000.10, 300.04, 700.06), "o2": (5.0, 0.0, 5.0)}


def test_monthly(spark):
    m = {(r.owner_id, r.month): r.net for r in L.monthly_totals(rows(spark), last_month="2025-04", months=3).collect()}
    assert m == {("o1", "2025-02"): -200.05, ("o1", "2025-03"): 1000.10, ("o1", "2025-04"): 0.0, ("o2", "2025-02"): 0.0, ("o2", "2025-03"): 5.0, ("o2", "2025-04"): 0.0}


def test_queue_and_close(spark):
    r = rows(spark)
    assert [x.id for x in L.open_items(r).orderBy("place").collect()] == ["e", "d", "h"]
    out = L.close_maintenance(r, r.filter("id in ('d', 'e', 'a')"), F.lit("2025-05-01").cast("timestamp"))
    got = {x.id: (x.kind, x.status, x.amount) for x in out.collect()}
    assert got["d"] == ("maintenance", "done", 40.0) and got["d:cost"] == ("expense", "", 40.0) and "e:cost" not in got and got["a"][1] == ""
    again = L.close_maintenance(out, out.filter("id = 'd'"), F.lit("2025-06-01").cast("timestamp"))
    assert again.count() == out.count()


def test_by_property(spark):
    props = spark.createDataFrame([("p1", "o1", "First"), ("p2", "o1", "Second")], "id string, owner_id string, label string")
    got = {(r.owner_id, r.label): r.net for r in L.totals_by_property(rows(spark), props).collect()}
    assert got == {("o1", "First"): 700.06, ("o1", "Second"): 0.0, ("o2", "Unassigned"): 5.0}


def test_dates_and_money(spark):
    today = F.to_date(F.lit("2025-03-10"))
    days = ["today", "AYER", "2025-02-30", "2024-12-31", "3/4", "1/2/24", "13/40/2024", None, "soon"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(dates.parse_day(F.col("d"), today).cast("string"))
    assert [r[0] for r in df.collect()] == ["2025-03-10", "2025-03-09", "2025-03-10", "2024-12-31", "2025-03-04", "2024-01-02", "2025-03-10", "2025-03-10", "2025-03-10"]
    raw = ["$1,234.50", "2k", "-3", "abc", "20000000", "", "1.005"]
    df = spark.createDataFrame([(d,) for d in raw], "d string").select(money.parse_amount(F.col("d")).cast("double"))
    assert [r[0] for r in df.collect()] == [1234.5, 2000.0, None, None, None, None, 1.01]
    df = spark.createDataFrame([("1:02:03",), ("2:05",), ("7.5",), ("x",), ("1:2:3:4",)], "d string").select(dates.duration_seconds(F.col("d")))
    assert [r[0] for r in df.collect()] == [3723.0, 125.0, 7.5, None, None]


def test_list_and_find(spark):
    r = rows(spark)
    assert [x.id for x in L.listing(r, owner="o1", kinds=("income", "bill"), since="2025-01-01").collect()] == ["a", "c"]
    assert L.find(r, "BOIL_R").count() == 8
    v = {x.id: x for x in L.validate(r, F.to_date(F.lit("2025-03-10"))).collect()}
    assert v["d"].urgency == "urgent" and v["f"].happened_on == dt.date(2025, 3, 10) and v["a"].problem is None
