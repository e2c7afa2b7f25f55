"""Conversations, ratings, questions, outbox, visitors and limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as win

from ..functions import text as T
from ..session import cut

#: Seconds to wait after each failed delivery; the last holds for all later ones.
BACKOFF = (60, 300, 900, 3600, 21600)
MAX_ATTEMPTS = 6


def assemble_threads(messages: DataFrame) -> DataFrame:
    """(thread_id, owner_id, title, turns, messages, updated_at) from single messages (thread_id, owner_id, seq, role, content, at).

    Messages go by seq; a turn is a question of the user; the title comes from the first.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "role", "content")))
    out = messages.groupBy("thread_id", "owner_id").agg(ordered.alias("m"), F.count_if(F.col("role") == "user").cast("int").alias("turns"), F.max("at").alias("updated_at"))
    first = F.try_element_at(F.filter("m", lambda x: x["role"] == "user"), F.lit(1))["content"]
    return out.select("thread_id", "owner_id", T.thread_title(first).alias("title"), "turns", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), "updated_at")


def newest_per_owner(threads: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` threads of each owner."""
    order = [F.col("updated_at").desc_nulls_last(), F.col("id")]
    return threads.withColumn("place", F.row_number().over(win.Window.partitionBy("owner_id").orderBy(*order))).filter(F.col("place") <= keep)


def latest_ratings(ratings: DataFrame) -> DataFrame:
    """One rating for each owner, thread and turn: the one written last. Anything but up and down is dropped."""
    order = [F.col("created_at").desc_nulls_last(), F.col("rating"), F.col("note").asc_nulls_last()]
    known = ratings.filter(F.col("rating").isin("up", "down"))
    return known.withColumn("_n", F.row_number().over(win.Window.partitionBy("owner_id", "thread_id", "turn").orderBy(*order))).filter("_n = 1").drop("_n")


def rating_counts(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"))


def last_questions(threads: DataFrame, n: int) -> DataFrame:
    """(id, questions, last_answer): an owner's last n questions of a thread in order, and the last answer."""
    asked = F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["content"])
    said = F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: m["content"])
    tail = F.slice(asked, F.greatest(F.lit(1), F.size(asked) - n + 1), n)
    return threads.select("id", tail.alias("questions"), F.when(F.size(said) > 0, F.try_element_at(said, F.lit(-1))).alias("last_answer"))


def transcript_tail(threads: DataFrame, most: int) -> DataFrame:
    """(owner_id, transcript): all of an owner's messages, oldest thread first, cut to the last characters, a leading … if cut.

    Threads that lie before the last characters are left out before anything is gathered.
    """
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")
    later = win.Window.partitionBy("owner_id").orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc_nulls_last()).rowsBetween(win.Window.unboundedPreceding, -1)
    after = F.coalesce(F.sum(F.length(lines) + 1).over(later), F.lit(0))
    kept = threads.withColumn("_after", after).filter(F.col("_after") <= most)
    by = kept.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("updated_at", "id", lines.alias("t")))).alias("all"))
    whole = F.array_join(F.transform("all", lambda x: x["t"]), "\n")
    return by.select("owner_id", F.when(F.length(whole) > most, F.concat(F.lit("…"), F.right(whole, F.lit(most)))).otherwise(whole).alias("transcript"))


def recent_topics(threads: DataFrame, n: int = 3) -> DataFrame:
    """(owner_id, titles, turns): titles of an owner's newest n threads and the turns in them."""
    top = newest_per_owner(threads, n)
    return top.groupBy("owner_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]).alias("titles"), F.sum("turns").alias("turns"))


def questions_once(log: DataFrame) -> DataFrame:
    """The question log without rows delivered twice."""
    return log.dropDuplicates(["id"])


def gaps(log: DataFrame) -> DataFrame:
    """Questions not covered, newest first (`place`)."""
    order = [F.col("asked_at").desc_nulls_last(), F.col("id").desc()]
    # one order over all gaps: the rank by day first keeps each sort small
    day = F.to_date("asked_at")
    rows = log.filter("not_covered")
    per = rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    before = per.withColumn("newer", F.coalesce(F.sum("n").over(win.Window.orderBy(F.col("day").desc_nulls_last()).rowsBetween(win.Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = rows.withColumn("day", day).withColumn("r", F.row_number().over(win.Window.partitionBy("day").orderBy(*order)))
    return within.join(before, within.day.eqNullSafe(before.day)).drop("day").withColumn("place", (F.col("newer") + F.col("r")).cast("long")).drop("newer", "r")


def settle_declined(log: DataFrame) -> DataFrame:
    """not_covered cleared where the material did cover the question."""
    return log.withColumn("not_covered", F.col("not_covered") & ~F.coalesce(F.col("coverage") == "covered", F.lit(False)))


def questions_that_missed(log: DataFrame, ratings: DataFrame) -> DataFrame:
    """(question, why): uncovered questions and those whose answer was rated down, blank ones left out."""
    a = log.filter("not_covered").select("question", F.lit("gap").alias("why"))
    b = ratings.filter("rating = 'down'").select("question", F.lit("down").alias("why"))
    return a.unionAll(b).filter(F.trim("question") != "")


def usage(log: DataFrame, cap: int) -> DataFrame:
    """(session_id, n, over): questions of each session, and whether they went over the cap."""
    return log.filter("session_id is not null").groupBy("session_id").agg(F.count("*").alias("n")).withColumn("over", F.col("n") > cap)


def daily_cap(log: DataFrame, cap: int) -> DataFrame:
    """(id, day, nth, allowed): each question's running number within its UTC day, and whether it is within the cap."""
    # numbered by minute, on top of the day's earlier minutes: no task holds a day
    rows = log.select("id", "asked_at", F.to_date("asked_at").alias("day"), F.date_trunc("minute", "asked_at").alias("minute"))
    minutes = rows.groupBy("day", "minute").agg(F.count("*").alias("n"))
    before = minutes.select("minute", (F.sum("n").over(win.Window.partitionBy("day").orderBy("minute")) - F.col("n")).alias("before"))
    inside = F.row_number().over(win.Window.partitionBy("minute").orderBy("asked_at", "id"))
    out = rows.withColumn("inside", inside).join(cut(before), "minute")
    return out.select("id", F.col("day").cast("string").alias("day"), (F.col("before") + F.col("inside")).cast("int").alias("nth")).withColumn("allowed", F.col("nth") <= cap)


def first_signals(signals: DataFrame) -> DataFrame:
    """The first time each owner gave each signal. signals: (owner, signal, at)."""
    return signals.groupBy("owner", "signal").agg(F.min("at").alias("at"))


def outbox_counts(outbox: DataFrame) -> DataFrame:
    """total, delivered, gave_up (undelivered after all attempts) and waiting."""
    gone = F.col("delivered_at").isNotNull()
    up = ~gone & (F.col("attempts") >= MAX_ATTEMPTS)
    return outbox.agg(F.count("*").alias("total"), F.count_if(gone).alias("delivered"), F.count_if(up).alias("gave_up"), F.count_if(~gone & ~up).alias("waiting"))


def outbox_due(outbox: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    """The deliveries to try now, in order of id."""
    return outbox.filter(F.col("delivered_at").isNull() & (F.col("attempts") < MAX_ATTEMPTS) & (F.col("next_try_at") <= now)).orderBy("id").limit(limit)


def outbox_failed(outbox: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """outbox after failures (id, error): one attempt more, the next one after the backoff, the error's first 300 characters."""
    hit = failed.groupBy("id").agg(F.max("error").alias("_error"))
    waits = F.array(*(F.lit(b) for b in BACKOFF))
    out = outbox.join(hit, "id", "left")
    is_hit = F.col("_error").isNotNull()
    attempts = F.when(is_hit, F.col("attempts") + 1).otherwise(F.col("attempts"))
    wait = F.element_at(waits, F.least(F.col("attempts") + 1, F.lit(len(BACKOFF))).cast("int"))
    return out.select(
        *(c for c in outbox.columns if c not in ("attempts", "next_try_at", "last_error")), attempts.alias("attempts"),
        F.when(is_hit, F.timestamp_seconds(F.unix_timestamp(now) + wait)).otherwise(F.col("next_try_at")).alias("next_try_at"), F.when(is_hit, F.left("_error", F.lit(300))).otherwise(F.col("last_error")).alias("last_error"),
    )


def visitors_last_seen(threads: DataFrame, limit: int | None = None) -> DataFrame:
    """(owner_id, last_seen) of owners without an account, newest first."""
    out = threads.filter(F.col("owner_id").startswith("browser:")).groupBy("owner_id").agg(F.max("updated_at").alias("last_seen"))
    return out.orderBy(F.col("last_seen").desc_nulls_last(), "owner_id").limit(limit) if limit else out


def admin_rows(accounts: DataFrame, threads: DataFrame, titles: int = 5) -> DataFrame:
    """Accounts with their newest titles and number of threads, and then the owners without an account; one pass over threads."""
    top = newest_per_owner(threads, titles)
    by = top.groupBy("owner_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: F.coalesce(x["title"], F.lit(""))), " | ").alias("titles"))
    n = threads.groupBy("owner_id").agg(F.count("*").alias("threads"))
    seen = n.join(by, "owner_id", "left")
    mine = accounts.select(F.concat(F.lit("account:"), "id").alias("owner_id"), F.lower(F.trim("email")).alias("email"), "name")
    known = mine.join(seen, "owner_id", "left").select("owner_id", "email", "name", F.coalesce("titles", F.lit("")).alias("titles"), F.coalesce("threads", F.lit(0)).cast("long").alias("threads"))
    other = seen.filter(F.col("owner_id").startswith("browser:")).select("owner_id", F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("name"), "titles", "threads")
    return known.unionByName(other)


def merge_owner(states: DataFrame, old: str, new: str) -> DataFrame:
    """Owner states (owner_id, signals, override, notes, hidden, updated_at) with one owner's merged into another's.

    Signals: those of the new owner, then what the old one adds. Single values: the new owner's unless missing or blank. Hidden if either.
    """
    if not old or not new or old == new:
        return states
    filled = lambda c: F.when(F.trim(c) != "", c)
    both = states.filter(F.col("owner_id").isin(old, new)).groupBy(F.lit(new).alias("owner_id")).agg(
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((F.col("owner_id") != new).alias("late"), "signals"))), lambda x: x["signals"]))).alias("signals"),
        F.coalesce(F.max(F.when(F.col("owner_id") == new, F.col("override"))), F.max("override")).alias("override"),
        F.coalesce(F.max(F.when(F.col("owner_id") == new, filled(F.col("notes")))), F.max(filled(F.col("notes")))).alias("notes"),
        F.max("hidden").alias("hidden"), F.max("updated_at").alias("updated_at"),
    )
    return states.filter(~F.col("owner_id").isin(old, new)).unionByName(both)


def set_field(states: DataFrame, changes: DataFrame, field: str) -> DataFrame:
    """states with one field set by changes (owner_id, value, at): the last change counts, other fields and owners stay; new owners are added."""
    last = changes.groupBy("owner_id").agg(F.max_by("value", F.struct("at", "value")).alias("_v"))
    out = states.join(last, "owner_id", "full_outer")
    return out.withColumn(field, F.coalesce("_v", field)).drop("_v").select(*states.columns)


def unit_crossings(properties: DataFrame, least: int = 4) -> DataFrame:
    """(owner_id, id, before, after): the property with which an owner's units first reach `least`; unknown units count as one."""
    order = win.Window.partitionBy("owner_id").orderBy(F.col("created_at").asc_nulls_first(), "id")
    run = F.sum(F.coalesce("units", F.lit(1))).over(order.rowsBetween(win.Window.unboundedPreceding, 0))
    out = properties.select("owner_id", "id", F.coalesce("units", F.lit(1)).alias("u"), run.alias("after")).withColumn("before", F.col("after") - F.col("u"))
    return out.filter((F.col("before") < least) & (F.col("after") >= least)).select("owner_id", "id", "before", "after")


def digest(accounts: DataFrame, entries: DataFrame, properties: DataFrame, since: str, most_items: int = 5) -> DataFrame:
    """(owner_id, money_in, money_out, open_items, properties) of accounts with anything to tell since a day."""
    from . import ledger

    money = ledger.totals(entries.filter(F.col("happened_on") >= since), ("owner_id",)).drop("net")
    work = ledger.open_items(entries, per_owner=most_items).groupBy("owner_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "what"))), lambda x: x["what"]), "; ").alias("open_items"))
    count = properties.groupBy("owner_id").agg(F.count("*").alias("properties"))
    out = accounts.select(F.concat(F.lit("account:"), "id").alias("owner_id")).join(money, "owner_id", "left").join(work, "owner_id", "left").join(count, "owner_id", "left")
    out = out.select("owner_id", F.coalesce("money_in", F.lit(0.0)).alias("money_in"), F.coalesce("money_out", F.lit(0.0)).alias("money_out"), F.coalesce("open_items", F.lit("")).alias("open_items"), F.coalesce("properties", F.lit(0)).cast("long").alias("properties"))
    return out.filter("money_in <> 0 or money_out <> 0 or open_items <> ''")


def with_follow_up(log: DataFrame, is_follow_up: Column) -> DataFrame:
    """log with `query`: a follow-up question is asked together with the one before it in its session."""
    before = F.lag("question").over(win.Window.partitionBy("session_id").orderBy("asked_at", "id"))
    return log.withColumn("query", F.when(is_follow_up & before.isNotNull() & F.col("session_id").isNotNull(), F.concat_ws(" ", before, "question")).otherwise(F.col("question")))


def sliding_limit(hits: DataFrame, most: int, seconds: int) -> DataFrame:
    """(key, at, id, allowed): at most so many allowed hits of a key in any so many seconds; rejected hits don't count.

    Whether a hit is allowed depends on which were before it, so each key is folded in order of time. hits: (key, at, id).
    A key's hits are first cut into sessions at pauses of `seconds`, before which nothing is remembered; sessions are dealt to tasks and
    streamed through in order, so that a task only holds the last allowed hits of one.
    """
    t = F.col("at").cast("double")
    by = win.Window.partitionBy("key").orderBy("at", "id")
    marked = hits.withColumn("t", t).withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(by) >= seconds).cast("int"), F.lit(1)))
    grouped = marked.withColumn("session", F.sum("new").over(by.rowsBetween(win.Window.unboundedPreceding, 0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, deque()
        for pdf in batches:
            ok = []
            for key, x in zip(zip(pdf["key"], pdf["session"], strict=True), pdf["t"], strict=True):
                if key != now:
                    now, kept = key, deque()
                while kept and x - kept[0] >= seconds:
                    kept.popleft()
                ok.append(len(kept) < most)
                if ok[-1]:
                    kept.append(x)
            yield pdf[["key", "at", "id"]].assign(allowed=ok)

    kind = dict(hits.dtypes)
    folded = grouped.repartition("key", "session").sortWithinPartitions("key", "session", "t", "id")
    return folded.mapInPandas(run, f"key {kind['key']}, at {kind['at']}, id {kind['id']}, allowed boolean")


def lockouts(attempts: DataFrame, most: int = 5, seconds: int = 60) -> DataFrame:
    """(key, at, id, blocked): tries of a key with results; blocked after so many failures until so many seconds after the last one.

    A success clears the count, time doesn't. Blocked tries are not counted. attempts: (key, at, id, ok).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fails, last = None, 0, None
        for pdf in batches:
            out = []
            for key, at, good in zip(pdf["key"], pdf["at"], pdf["ok"], strict=True):
                if key != now:
                    now, fails, last = key, 0, None
                shut = fails >= most and last is not None and (at - last).total_seconds() < seconds
                out.append(shut)
                if not shut:
                    fails, last = (0, last) if good else (fails + 1, at)
            yield pdf[["key", "at", "id"]].assign(blocked=out)

    kind = dict(attempts.dtypes)
    folded = attempts.filter("key is not null").repartition("key").sortWithinPartitions("key", "at", "id")
    return folded.mapInPandas(run, f"key {kind['key']}, at {kind['at']}, id {kind['id']}, blocked boolean")


def adds_once(adds: DataFrame) -> DataFrame:
    """One row for each (turn, key) of repeated additions: the first one, with the most severe urgency said. adds: (turn, key, seq, urgency)."""
    severity = F.when(F.col("urgency") == "emergency", 2).when(F.col("urgency") == "urgent", 1).otherwise(0)
    return adds.groupBy("turn", "key").agg(F.min("seq").alias("seq"), F.max_by("urgency", F.struct(severity, -F.col("seq"))).alias("urgency"), F.count("*").alias("n"))


def concat_distinct(lists: Sequence[DataFrame], key: str) -> DataFrame:
    """Ordered union of lists (key, place): an item counts where it comes first."""
    out = None
    for i, part in enumerate(lists):
        p = part.withColumn("_list", F.lit(i))
        out = p if out is None else out.unionByName(p)
    first = win.Window.partitionBy(key).orderBy("_list", "place")
    return out.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").withColumnRenamed("_list", "from_list")


def live_sessions(sessions: DataFrame, accounts: DataFrame, now: Column, key: str) -> DataFrame:
    """sessions (key, expires_at, ...) that haven't expired, with the columns of their accounts (key, ...); a key without an account has no session."""
    return sessions.filter(F.col("expires_at") > now).join(accounts, key)
