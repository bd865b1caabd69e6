import itertools
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from headwater.llm import filter_audit as fa

SF = "/root/testdata/sf0.001"


def failed(text, smaller):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    bad = "A" if len(words) < 200 else ""
    bad += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    bad += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else ""
    bad += "D" if re.search(r"[#$%&*|]", text) else ""
    return bad + ("E" if smaller else "")


def brute(docs, labels):
    """Walks every order document by document."""
    rows = []
    for d, t, s in docs:
        smaller = d is not None and any(x is not None and x < d and (u or "") == (t or "") for x, u, _ in docs)
        rows.append((s or "", failed(t or "", smaller), any(x == d and q == 1 for x, q, _ in labels), any(x == d and q == 1 for x, _, q in labels)))
    out, removed_by = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = own, []
            for step, letter in enumerate(order, 1):
                hit, left = [r for r in left if letter in r[1]], [r for r in left if letter not in r[1]]
                late = sum(letter in r[1] for r in gone)
                gone = gone + hit
                removed_by[part, letter] = removed_by.get((part, letter), 0) + len(hit)
                out[part, order, step] = [len(left), len(hit), late, sum(r[1] == letter for r in own), sum(r[2] for r in hit), sum(r[3] for r in hit)]
    return {(p, o, s): (*v, removed_by[p, o[s - 1]]) for (p, o, s), v in out.items()}


def told(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


LONG = " ".join(f"w{i}" for i in range(300))
DOCS = [
    (5, LONG, "s"), (2, LONG, "t"), (2, LONG, "s"), (2, LONG, "s"), (None, LONG, "s"), (9, None, "s"), (8, "", None), (7, " \n\t", "t"),
    (1, "a " * 500, "s"), (3, LONG.upper() + " *", "s"), (4, "é" * 300_000, "t"), (6, "a|b " * 30_000, None), (10, LONG + "\x0b\x0cÉ Z", "t"), (11, LONG + " #", "u"),
]
LABELS = [(2, 1, 0), (2, 0, 1), (5, None, 1), (3, 1, None), (None, 1, 1), (77, 1, 1), (1, 1, 1)]


def test_audit_against_a_walk_of_every_order(spark):
    docs = spark.createDataFrame([(*r, "x", "y") for r in DOCS], "doc_id long, text string, source string, mask string, n string")
    labels = spark.createDataFrame([(*r, 0) for r in LABELS], "doc_id long, quality int, toxic int, part int")
    assert told(fa.audit(docs, labels)) == brute(DOCS, LABELS)


def test_query_has_the_columns_of_its_contract_and_the_rows_of_a_walk(spark):
    df = entry.queries()["op11_filter_interaction_audit"](spark, SF)
    assert dict(df.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | {c: "bigint" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert told(df) == brute(docs, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(docs, labels).count() == 0
    full = fa.audit(spark.createDataFrame(DOCS, docs.schema), labels)
    assert full.count() == 600 * 4 and full.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


@pytest.mark.parametrize("k", [1, 3])
def test_survivors_of_other_numbers_of_filters(spark, k):
    counts = spark.createDataFrame([("p", m, m + 1, m % 2, 1) for m in range(1 << k)], "part string, mask int, n long, good long, toxic long")
    alive = fa.survivors(counts, k).first().alive
    assert [a.n for a in alive] == [sum(m + 1 for m in range(1 << k) if not m & s) for s in range(1 << k)]
    steps = fa.order_steps(fa.survivors(counts, k), "ABC"[:k])
    assert steps.where("step = 1").select("filter_order").distinct().count() == {1: 1, 3: 6}[k]


def test_texts_are_read_once_and_no_python_runs(spark):
    df = entry.queries()["op11_filter_interaction_audit"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "text#" not in plan and os.path.basename(SF)
