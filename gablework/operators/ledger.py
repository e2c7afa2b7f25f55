"""The ledger of owners' entries: validation, listing, totals, calendars and rewrites.

An entry is (id, owner_id, property_id, kind, what, amount, vendor, status, happened_on, created_at, urgency, photo_path,
closed_at). Entries may be delivered twice; `entries` keeps one of each id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as win

from ..functions import dates, money
from ..functions import text as T
from ..session import cut, join_sized

MONEY_IN, MONEY_OUT = ("income",), ("expense", "bill")
KINDS = ("expense", "bill", "income", "maintenance", "visit", "note")
URGENCIES = ("routine", "urgent", "emergency")
MAX_ROWS = 5000


def entries(raw: DataFrame) -> DataFrame:
    """One row an id: of different deliveries the one created last (ties by content)."""
    order = [F.col("created_at").desc_nulls_last(), F.xxhash64("what", "amount", "vendor", "status").desc()]
    return raw.withColumn("_n", F.row_number().over(win.Window.partitionBy("id").orderBy(*order))).filter("_n = 1").drop("_n")


def normalise_kind(kind: Column, synonyms: dict[str, str] | None = None) -> Column:
    """The canonical kind of a typed one by a map of synonyms; what isn't known is a note."""
    word = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    known = {**{k: k for k in KINDS}, **(synonyms or {})}
    mapped = F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), word)
    return F.coalesce(mapped, F.lit("note"))


def validate(raw: DataFrame, today: Column, synonyms: dict[str, str] | None = None) -> DataFrame:
    """Raw input as entries: kinds and statuses normalised, days parsed, amounts read; `problem` says why a row can't be stored.

    Maintenance without a status is open; urgency only belongs to maintenance.
    """
    kind = normalise_kind(F.col("kind"), synonyms)
    amount = money.parse_amount(F.col("amount").cast("string"))
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    urgency = F.lower(F.trim(F.coalesce("urgency", F.lit(""))))
    what = F.trim(F.regexp_replace(F.coalesce("what", F.lit("")), r"[\s\p{Cntrl}]+", " "))
    return raw.select(
        "id", "owner_id", kind.alias("kind"), F.left(what, F.lit(400)).alias("what"), amount.alias("amount"),
        F.when(status.isin("open", "done"), status).when(kind == "maintenance", "open").otherwise("").alias("status"),
        F.when(kind == "maintenance", F.when(urgency.isin(*URGENCIES), urgency).otherwise("routine")).otherwise("").alias("urgency"),
        dates.parse_day(F.col("happened_on"), today).alias("happened_on"),
        F.when(what == "", "nothing said").when(F.col("amount").isNotNull() & amount.isNull(), "amount").alias("problem"),
    )


def listing(
    rows: DataFrame, *, owner: str | None = None, prop: str | None = None, kinds: Sequence[str] | None = None, status: str | None = None, since: str | None = None, limit: int = 200
) -> DataFrame:
    """Entries by optional conditions, all of which must hold; newest first, at most MAX_ROWS. since: ISO day."""
    out = rows
    for name, value in (("owner_id", owner), ("property_id", prop), ("status", status)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    if kinds:
        out = out.filter(F.col("kind").isin(*kinds))
    if since:
        out = out.filter(F.col("happened_on") >= since)
    return out.orderBy(F.col("happened_on").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "id").limit(max(1, min(limit, MAX_ROWS)))


def find(rows: DataFrame, text: str, *, owner: str | None = None) -> DataFrame:
    """Entries whose what or vendor holds the text, ignoring case; % and _ are wildcards, as in LIKE."""
    pattern = f"%{text.lower()}%"
    out = rows.filter(F.lower("what").like(pattern) | F.lower("vendor").like(pattern))
    return out.filter(F.col("owner_id") == owner) if owner is not None else out


def _sum(kinds: Sequence[str]) -> Column:
    return F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), money.cents(F.col("amount")))), F.lit(0).cast(money.MONEY))


def totals(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """money_in, money_out and net, exact, per group. Maintenance amounts are neither."""
    out = rows.filter("amount is not null").groupBy(*by).agg(_sum(MONEY_IN).alias("i"), _sum(MONEY_OUT).alias("o"))
    return out.select(*by, F.col("i").cast("double").alias("money_in"), F.col("o").cast("double").alias("money_out"), (F.col("i") - F.col("o")).cast("double").alias("net"))


def totals_by_kind(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.filter("amount is not null").groupBy(*by, "kind").agg(money.total(F.col("amount")).alias("total"), F.count("*").alias("n"))


def monthly_totals(rows: DataFrame, *, last_month: str, months: int = 12, by: Sequence[str] = ("owner_id",)) -> DataFrame:
    """Totals of each of the `months` calendar months up to last_month (yyyy-MM), months without entries as zero.

    The calendar is made from a sequence and joined to the groups that have any entry, so it holds groups x months rows.
    """
    months = max(1, min(months, 60))
    day = dates.iso_day(F.col("happened_on"))
    end = F.to_date(F.lit(f"{last_month}-01"))
    span = rows.select(*by, "kind", "amount", F.date_format(F.trunc(day, "month"), "yyyy-MM").alias("month"), day.alias("day"))
    inside = span.filter((F.col("day") >= F.add_months(end, 1 - months)) & (F.col("day") < F.add_months(end, 1)))
    summed = inside.groupBy(*by, "month").agg(_sum(MONEY_IN).alias("i"), _sum(MONEY_OUT).alias("o"))
    calendar = F.explode(F.transform(F.sequence(F.add_months(end, 1 - months), end, F.expr("interval 1 month")), lambda m: F.date_format(m, "yyyy-MM"))).alias("month")
    frame = rows.select(*by).distinct().select(*by, calendar)
    zero = F.lit(0).cast(money.MONEY)
    out = frame.join(summed, [*by, "month"], "left").select(*by, "month", F.coalesce("i", zero).alias("i"), F.coalesce("o", zero).alias("o"))
    return out.select(*by, "month", F.col("i").cast("double").alias("money_in"), F.col("o").cast("double").alias("money_out"), (F.col("i") - F.col("o")).cast("double").alias("net"))


def with_labels(rows: DataFrame, properties: DataFrame) -> DataFrame:
    """rows with `property_label`, blank where the property isn't known."""
    known = properties.select(F.col("id").alias("property_id"), F.trim("label").alias("property_label"))
    return rows.join(known, "property_id", "left").withColumn("property_label", F.coalesce("property_label", F.lit("")))


def totals_by_property(rows: DataFrame, properties: DataFrame) -> DataFrame:
    """Totals of every property of every owner, zero where nothing was entered, and an owner's unassigned rest if not zero."""
    by = totals(rows.withColumn("property_id", F.coalesce("property_id", F.lit(""))), ("owner_id", "property_id"))
    frame = properties.select("owner_id", F.col("id").alias("property_id"), F.trim("label").alias("label"))
    known = frame.join(by, ["owner_id", "property_id"], "left").na.fill(0.0, ["money_in", "money_out", "net"])
    rest = by.join(frame.select("owner_id", "property_id"), ["owner_id", "property_id"], "left_anti")
    cents = [F.sum(F.col(c).cast(money.MONEY)).cast("double").alias(c) for c in ("money_in", "money_out", "net")]
    unassigned = rest.groupBy("owner_id").agg(*cents).filter("money_in <> 0 or money_out <> 0")
    return known.select("owner_id", "property_id", "label", "money_in", "money_out", "net").unionByName(
        unassigned.select("owner_id", F.lit("").alias("property_id"), F.lit("Unassigned").alias("label"), "money_in", "money_out", "net")
    )


def urgency_rank(urgency: Column) -> Column:
    return F.when(urgency == "emergency", 0).when(urgency == "urgent", 1).otherwise(2)


def open_items(rows: DataFrame, *, per_owner: int | None = None) -> DataFrame:
    """Open maintenance, worst first, then oldest; `place` is the position within the owner's queue."""
    order = [urgency_rank(F.col("urgency")), F.col("happened_on").asc_nulls_first(), F.col("created_at").asc_nulls_first(), F.col("id")]
    out = rows.filter("kind = 'maintenance' and status = 'open'").withColumn("place", F.row_number().over(win.Window.partitionBy("owner_id").orderBy(*order)))
    return out.filter(F.col("place") <= per_owner) if per_owner else out


def maintenance_history(rows: DataFrame) -> DataFrame:
    order = [F.col("closed_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("id")]
    done = rows.filter("kind = 'maintenance' and status = 'done'")
    return done.withColumn("place", F.row_number().over(win.Window.partitionBy("owner_id").orderBy(*order)))


def resolve_property(asked: DataFrame, properties: DataFrame) -> DataFrame:
    """(ask_id, property_id, rank) for asked rows (ask_id, owner_id, text): the owner's property that a text means.

    By rank: the id itself; the same label; a label that holds the text or is held by it (over three letters); the same city;
    a blank text means an owner's only property. Ties go to the property added first. Equal texts of an owner are asked once; all ranks but the
    third are equi-joins, and the third is only asked where no id or label is equal.
    """
    p = properties.select("owner_id", F.col("id").alias("property_id"), F.lower(F.trim("label")).alias("label"), F.lower(F.trim("city")).alias("city"), F.col("created_at").alias("added"))
    p = cut(p.repartition("owner_id"))
    texts = asked.select("owner_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    want = cut(texts.withColumn("t", F.lower(F.trim("text"))))
    hit = lambda rows, rank: rows.select("owner_id", "text", F.struct(F.lit(rank).alias("rank"), F.col("added").isNotNull().alias("known"), "added", "property_id").alias("hit"))
    by_id = hit(want.withColumn("property_id", F.trim("text")).join(p, ["owner_id", "property_id"]), 1)
    by_label = hit(want.filter("t <> ''").withColumn("label", F.col("t")).join(p, ["owner_id", "label"]), 2)
    sure = cut(by_id.union(by_label))
    open_ = want.filter("t <> ''").join(sure.select("owner_id", "text").distinct(), ["owner_id", "text"], "left_anti")
    held = (F.length("t") > 3) & F.contains("label", "t") | (F.length("label") > 3) & F.contains("t", "label")
    part = hit(open_.join(p, "owner_id").filter(held), 3)
    by_city = hit(open_.withColumn("city", F.col("t")).join(p, ["owner_id", "city"]), 4)
    single = p.groupBy("owner_id").agg(F.count("*").alias("n"), F.min("property_id").alias("property_id"), F.min("added").alias("added")).filter("n = 1")
    only = hit(want.filter("t = ''").join(single, "owner_id"), 5)
    best = cut(sure.union(part).union(by_city).union(only).groupBy("owner_id", "text").agg(F.min("hit").alias("hit")))
    met = join_sized(asked.withColumn("text", F.coalesce("text", F.lit(""))), best, ["owner_id", "text"], salt=F.xxhash64("ask_id"))
    return met.select("ask_id", "hit.property_id", "hit.rank")


def close_maintenance(rows: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """rows with the given maintenance entries done, and one expense for each that had an amount and wasn't done before."""
    hit = rows.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)) & (F.col("kind") == "maintenance"))
    closed = hit.withColumn("closed_at", F.when(F.col("_hit") & (F.col("status") != "done"), now).otherwise(F.col("closed_at"))).withColumn("status", F.when(F.col("_hit"), "done").otherwise(F.col("status")))
    cost = hit.filter("_hit and status <> 'done' and amount is not null").select(
        *(
            {"id": F.concat("id", F.lit(":cost")), "kind": F.lit("expense"), "what": F.concat(F.lit("Completed: "), "what"), "status": F.lit(""), "urgency": F.lit(""), "created_at": now, "closed_at": F.lit(None).cast("timestamp")}.get(c, F.col(c)).alias(c)
            for c in rows.columns
        )
    )
    return closed.select(*rows.columns).unionByName(cost)


def reassign(rows: DataFrame, old: str, new: str) -> DataFrame:
    """rows of one owner key under another; nothing changes if either is blank or both are the same."""
    if not old or not new or old == new:
        return rows
    return rows.withColumn("owner_id", F.when(F.col("owner_id") == old, new).otherwise(F.col("owner_id")))


def money_entries(rows: DataFrame) -> DataFrame:
    """What a money view shows: incomes, expenses, bills and everything with an amount. Filter before any limit."""
    return rows.filter(F.col("kind").isin(*MONEY_IN, *MONEY_OUT) | (F.coalesce("amount", F.lit(0.0)) != 0))


def one_line(rows: DataFrame, today: Column) -> DataFrame:
    """(id, line): an entry as a line of text: day, kind, what, amount, vendor, how many days ago."""
    day = dates.iso_day(F.col("happened_on"))
    parts = F.concat_ws(
        " | ", F.col("happened_on"), F.col("kind"), F.expr("nullif(trim(what), '')"), F.when(F.col("amount").isNotNull(), F.concat(F.lit("$"), money.cents(F.col("amount")).cast("string"))),
        F.expr("nullif(trim(vendor), '')"), F.when(day.isNotNull(), F.concat(F.datediff(today, day).cast("string"), F.lit(" days ago"))),
    )
    return rows.select("id", parts.alias("line"))


def validate_properties(raw: DataFrame, *, most_label: int = 120, most_units: int = 5000) -> DataFrame:
    """raw (id, label, units as typed) with clean label, units and problem: a label is needed; units are blank, 0 (both unknown) or 1 to most_units."""
    label = T.flat(F.col("label"), most_label)
    typed = F.trim(F.coalesce("units", F.lit("")))
    number = typed.try_cast("double")
    units = F.when(~typed.isin("", "0"), F.floor(number).cast("int"))
    bad = F.when(label == "", "label").when(~typed.isin("", "0") & number.isNull(), "units is no number").when((units < 1) | (units > most_units), "units out of range")
    return raw.select("id", label.alias("label"), F.when(bad.isNull(), units).alias("units"), bad.alias("problem"))


def cleaned(rows: DataFrame, *, most_what: int = 400, most_vendor: int = 120) -> DataFrame:
    """rows as they are shown: what and vendor without markup and control characters, cut to a length; null counts as blank."""
    show = lambda c, most: T.flat(T.without_markup(F.col(c)), most)
    return rows.withColumn("what", show("what", most_what)).withColumn("vendor", show("vendor", most_vendor))
