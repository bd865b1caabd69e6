"""Keyed state: upserts with their merge rules, retention, weekly candidates, editions, subscribers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from headwater.functions import text as X

#: Differs from every key, null included.
_NO_KEY = "\0no key"


def upsert_news(log: DataFrame) -> DataFrame:
    """State after a log (id, seq, ts, title, image, url, heat): the last title, the last image that is not
    empty, the largest heat; url and first_seen keep their first values. Where the log has them, the last summary and the
    first source, column and published are carried too."""
    filled = F.when(F.coalesce("image", F.lit("")) != "", F.col("seq"))
    last = [F.max_by(c, "seq").alias(c) for c in ("summary",) if c in log.columns]
    first = [F.min_by(c, "seq").alias(c) for c in ("source", "column", "published") if c in log.columns]
    return log.groupBy("id").agg(
        *last,
        *first,
        F.max_by("title", "seq").alias("title"),
        F.max_by("image", filled).alias("image"),
        F.min_by("url", "seq").alias("url"),
        F.min("ts").alias("first_seen"),
        F.max("heat").alias("heat"),
    )


def merge_news(old: DataFrame, new: DataFrame) -> DataFrame:
    """One micro-batch into the state, by the same rules: old rows come before the batch."""
    first, later = old.withColumn("seq", F.lit(-1).cast("long")).withColumnRenamed("first_seen", "ts"), new
    return upsert_news(first.unionByName(later.select(*first.columns)))


def retain(state: DataFrame, now: Column, days: int = 30, column: str = "first_seen") -> DataFrame:
    return state.where(F.col(column) >= now - F.expr(f"interval {days} days"))


def weekly_candidates(state: DataFrame, now: Column, days: int = 7, limit: int = 400, per_column: int = 4) -> DataFrame:
    """The global limit comes before the places of each column."""
    order = [F.desc("heat"), F.desc("ts"), F.asc("id")]
    top = state.where(F.col("ts") >= now - F.expr(f"interval {days} days")).orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))).where(F.col("rank") <= per_column)


def upsert_subscribers(log: DataFrame) -> DataFrame:
    """Last name that is not empty, last phone that is not null, consent refreshed, created and source kept;
    every upsert resets the sync mark."""
    return log.groupBy("email").agg(
        F.max_by("name", F.when(F.coalesce("name", F.lit("")) != "", F.col("seq"))).alias("name"),
        F.max_by("phone", F.when(F.col("phone").isNotNull(), F.col("seq"))).alias("phone"),
        F.max("ts").alias("consent_at"),
        F.min("ts").alias("created_at"),
        F.min_by("source", "seq").alias("source"),
        F.lit(None).cast("timestamp").alias("synced_at"),
    )


def subscriber_errors(name: Column, email: Column, phone: Column, consent: Column) -> Column:
    """Codes of what is wrong, in a fixed order."""
    bad_name = (F.length(name) > 0) & ((F.length(name) < 2) | (F.length(name) > 80) | name.rlike(r"(?i)https?:|[<>@]"))
    bad_email = F.coalesce(~email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]{2,}$") | (F.length(email) > 254), F.lit(True))
    bad_phone = (F.coalesce(phone, F.lit("")) != "") & X.phone_e164(phone).isNull()
    codes = F.array(F.when(bad_name, F.lit("name")), F.when(bad_email, F.lit("email")), F.when(bad_phone, F.lit("phone")), F.when(~F.coalesce(consent, F.lit(False)), F.lit("consent")))
    return F.filter(codes, lambda c: c.isNotNull())


TRANSITIONS = {("draft", "send"): "sending", ("sending", "done"): "sent", ("sending", "fail"): "draft", ("sending", "later"): "scheduled"}


def fold_machine(events: DataFrame, transitions: dict[tuple[str, str], str], start: str) -> DataFrame:
    """(key, status, changes): the end of each key's walk through its events (key, seq, event) by seq.

    A run of events is a function from the state before it to the state after it and the number of changes between;
    functions of runs that follow each other compose, whatever came before them. So events are dealt out by ranges of (key, seq),
    each task folds its part of a key into one function of a few numbers, and a key's functions, one for each range
    that holds some of it, are composed in order. A key with most of the events is spread over many tasks.

    An event without a transition from the state changes nothing, and so does a null one; a null seq comes first;
    equal seqs are ordered by event; a null key is a key.
    """
    states = sorted({start, *(s for s, _ in transitions), *transitions.values()})
    at = {s: i for i, s in enumerate(states)}
    same = tuple(range(len(states)))
    #: For each event that ever does something where it leads from each state.
    moves = {event: tuple(at[transitions.get((s, event), s)] for s in states) for _, event in transitions}
    taken = {event: tuple(int((s, event) in transitions) for s in states) for event in moves}

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, to, count = _NO_KEY, None, list(same), [0] * len(same)
        done: list[tuple] = []
        for batch in batches:
            for k, seq, event in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != key:
                    if key is not _NO_KEY:
                        done.append((key, *first, to, count))
                    key, first, to, count = k, (seq, event), list(same), [0] * len(same)
                if event in moves:
                    step, took = moves[event], taken[event]
                    for s, now in enumerate(to):
                        count[s] += took[now]
                        to[s] = step[now]
            if len(done) > 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], arrow)
                done = []
        if key is not _NO_KEY:
            done.append((key, *first, to, count))
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], arrow)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, changes = _NO_KEY, at[start], 0
        for batch in batches:
            done = []
            for k, to, count in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if k != key:
                    if key is not _NO_KEY:
                        done.append((key, states[state], changes))
                    key, state, changes = k, at[start], 0
                state, changes = to[state], changes + count[state]
            yield pa.RecordBatch.from_pylist([dict(zip(ends, r, strict=True)) for r in done], arrow_end)
        if key is not _NO_KEY:
            yield pa.RecordBatch.from_pylist([dict(zip(ends, (key, states[state], changes), strict=True))], arrow_end)

    names, ends = ("key", "seq", "event", "to", "count"), ("key", "status", "changes")
    narrow = events.select("key", "seq", F.col("event").cast("string").alias("event"))
    kind = narrow.schema["key"].dataType
    folded = T.StructType([*narrow.schema, T.StructField("to", T.ArrayType(T.IntegerType())), T.StructField("count", T.ArrayType(T.LongType()))])
    told = T.StructType([T.StructField("key", kind), T.StructField("status", T.StringType()), T.StructField("changes", T.LongType())])
    arrow, arrow_end = to_arrow_schema(folded), to_arrow_schema(told)
    order = ["key", "seq", "event"]
    some = narrow.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(runs, folded)
    return some.repartition("key").sortWithinPartitions(*order).mapInArrow(compose, told)


def edition_status(events: DataFrame) -> DataFrame:
    """(edition, status, changes): a fold of each edition's events; an event counts only in its state."""
    return fold_machine(events.withColumnRenamed("edition", "key"), TRANSITIONS, "draft").withColumnRenamed("key", "edition")


def model_picks(candidates: DataFrame, picks: DataFrame, most: int = 8) -> DataFrame:
    """Picks (item_id, pos) that name a candidate, the first time each, ``most`` at most."""
    real = picks.join(candidates.select("item_id").distinct(), "item_id", "left_semi")
    first = real.groupBy("item_id").agg(F.min("pos").alias("pos"))
    return first.orderBy("pos", "item_id").limit(most)


def weekly_edition(candidates: DataFrame, picks: DataFrame, least: int = 3, most: int = 8) -> DataFrame:
    """The model's picks if enough are valid, else the hottest candidates; nothing below ``least`` candidates.

    Which it is, is part of the plan: both lists, ``most`` rows at most, meet one row of counts, so nothing runs before an action.
    """
    good = model_picks(candidates, picks, most).select("item_id", "pos")
    hottest = candidates.orderBy(F.desc("heat"), F.asc("item_id")).limit(most)
    hottest = hottest.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("heat"), F.asc("item_id")))).select("item_id", "pos")
    lists = good.withColumn("_picked", F.lit(True)).unionByName(hottest.withColumn("_picked", F.lit(False)))
    counts = candidates.limit(least).agg(F.count(F.lit(1)).alias("_there")).crossJoin(good.agg(F.count(F.lit(1)).alias("_valid")))  # one row each
    met = lists.crossJoin(F.broadcast(counts)).where((F.col("_there") >= least) & (F.col("_picked") == (F.col("_valid") >= least)))
    return met.select("item_id", "pos")


def upsert_drafts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, status, content, affected): new content replaces that of a draft and adds unknown keys as drafts;
    editions in any other status stay as they are. affected is 1 where the write took effect.

    old: (key, status, content), new: (key, content), one row for a key each.
    """
    both = old.join(new.withColumnRenamed("content", "_new").withColumn("_there", F.lit(True)), key, "full")
    takes = F.col("_there").isNotNull() & (F.coalesce("status", F.lit("draft")) == "draft")
    return both.select(key, F.coalesce("status", F.lit("draft")).alias("status"), F.when(takes, F.col("_new")).otherwise(F.col("content")).alias("content"), takes.cast("long").alias("affected"))


def catch_up(times: DataFrame, column: str, minute: int, zone: str = "America/Sao_Paulo") -> DataFrame:
    """(week, at): the first time in each ISO week at which the weekly task is due (Friday from ``minute`` on, or any
    time of the weekend, which makes up for a missed Friday); once a week."""
    local = F.from_utc_timestamp(column, zone)
    day, at = F.extract(F.lit("DAYOFWEEK_ISO"), local), F.hour(local) * 60 + F.minute(local)
    due = times.where((day > 5) | ((day == 5) & (at >= minute)))
    return due.groupBy(X.iso_week(local).alias("week")).agg(F.min(column).alias("at"))
