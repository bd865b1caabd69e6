"""Dedup by components, folds of composed functions, and dates: against sequential definitions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from headwater.functions import text as X
from headwater.operators import first_wins as fw
from headwater.operators import state


def greedy(rows):
    a, b, out = set(), set(), []
    for o, x, y in sorted(rows):
        if x not in a and y not in b:
            out.append(o)
            a.add(x)
            b.add(y)
    return out


def settled(spark, rows, bound):
    kept, report = fw.first_wins(spark.createDataFrame(rows, "o long, x string, y string"), "o", ("x", "y"), bound)
    return sorted(r.o for r in kept.collect()), report


def chain(n, by=""):
    """Rows that share one key with the row before and the other with the row after."""
    return [(i, f"{by}{(i + 1) // 2}", f"{by}{i // 2}") for i in range(n)]


@pytest.mark.parametrize("bound", [200_000, 40_000])
def test_long_chain_takes_few_steps(spark, bound):
    rows = chain(100_000)
    got, report = settled(spark, rows, bound)
    assert got == greedy(rows)
    assert report["peels"] == fw.PEELS and report["components"] == 1
    assert report["blocks"] == (0 if bound > 100_000 else 3)


def test_many_components_and_nulls(spark):
    rng = random.Random(4)
    rows = [(1000 * k + o, x, y) for k in range(40) for o, x, y in chain(30, f"{k}-")]
    rows += [(100_000 + i, f"r{rng.randint(0, 40)}", f"r{rng.randint(0, 40)}") for i in range(400)]
    rows += [(200_000 + i, None if i % 3 else f"n{i}", f"n{i % 7}" if i % 2 else None) for i in range(60)]
    got, report = settled(spark, rows, 50)
    assert got == greedy(rows)
    assert report["components"] >= 40


def test_components_by_hooks_and_halving(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(500)] + [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(300)] + [(5000, i) for i in range(5001, 5100)]
    table = spark.createDataFrame(links, "u long, v long").repartition(9)
    sets = fw._Sets()
    for x, y in links:
        sets.join(x, y)
    want = {x: sets.find(x) for x in list(sets.up) if sets.find(x) != x}
    for bound in (10, 100_000):
        assert {r.node: r.root for r in fw.components(table, bound).collect()} == want


def walk(events, transitions, start):
    out = {}
    for k, _, e in sorted(events, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "")):
        s, n = out.get(k, (start, 0))
        out[k] = (transitions[s, e], n + 1) if (s, e) in transitions else (s, n)
    return out


def test_hot_key_is_folded_over_many_tasks(spark):
    rng = random.Random(6)
    kinds = ["send", "done", "fail", "later", "noop", None]
    events = [("hot", i, rng.choice(kinds)) for i in range(120_000)] + [(k, rng.randint(0, 50), rng.choice(kinds)) for k in (None, "a", "b", "ü") for _ in range(200)] + [("a", None, "send")]
    rng.shuffle(events)
    table = spark.createDataFrame(events, "key string, seq long, event string").repartition(8)
    df = state.fold_machine(table, state.TRANSITIONS, "draft")
    assert {r.key: (r.status, r.changes) for r in df.collect()} == walk(events, state.TRANSITIONS, "draft")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    cycle = {("a", "x"): "b", ("b", "x"): "c", ("c", "x"): "a"}
    loop = spark.range(0, 300_000, 1, 8).select(F.lit(1).alias("key"), F.col("id").alias("seq"), F.lit("x").alias("event"))
    assert [tuple(r) for r in state.fold_machine(loop, cycle, "b").collect()] == [(1, "b", 300_000)]
    assert state.fold_machine(loop.limit(0), cycle, "b").count() == 0


@pytest.mark.parametrize(
    "raw,want",
    [
        ("Tue, 03 Sep 2024 10:00:45 GMT", "2024-09-03T10:00:45"), ("3 Sep 2024 10:00:45 EST", "2024-09-03T15:00:45"), ("03 set 2024 10:00:45 -0300", "2024-09-03T13:00:45"),
        ("2024-09-03T10:00:45.5+02:00", "2024-09-03T08:00:45.500"), ("2024-09-03T10:00:45.123Z", "2024-09-03T10:00:45.123"), ("2024-09-03T10:00Z", "2024-09-03T10:00"),
        ("September 3, 2024", "2024-09-03"), ("03 Sep 24 10:00 PDT", "2024-09-03T17:00"), ("Seg, 28 Set 2026 10:00:00 -0300", "2026-09-28T13:00"), ("segunda-feira, 2 de março de 2026 às 14:30", "2026-03-02T14:30"),
        ("Sep 3, 2024 12:05 AM", "2024-09-03T00:05"), ("03-Sep-99", "1999-09-03"), ("Thu, 5 Sep 2024 10:00:00 +0000 (UTC)", "2024-09-05T10:00"),
        ("31 Feb 2024", None), ("2024-09-03T10:00:00+25:00", None), ("3 Sep 2024 10:00:00 XYZ", None), ("2024-09-03 at noon", None), ("12:00", None), ("", None), (None, None),
    ],
)
def test_dates_with_zones_and_fractions(spark, raw, want):
    got = spark.range(1).select(F.unix_millis(X.parse_date(F.lit(raw))).alias("ms")).first().ms
    assert got == (None if want is None else round(dt.datetime.fromisoformat(want).replace(tzinfo=dt.UTC).timestamp() * 1000))
