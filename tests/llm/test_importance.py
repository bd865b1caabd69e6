import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from headwater.llm import importance as im

SF = "/root/testdata/sf0.001"


def grams(text, least=1, most=1):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return words, [" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, least=1, most=1, buckets=10_000, percent=10, least_words=20):
    code = lambda g: zlib.crc32(g.encode()) % buckets
    own, wanted = (Counter(code(g) for t in texts for g in grams(t, least, most)[1]) for texts in ([t for _, t in docs], target))
    total, total_wanted = own.total() + buckets, wanted.total() + buckets
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * total / ((own[b] + 1) * total_wanted))) for b in own}
    out = []
    for d, t in docs:
        words, found = grams(t, least, most)
        weight = sum(gain[code(g)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(found), weight, score, None, len(words) >= least_words])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def told(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def corpus():
    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(i % 60))) for i in range(400)]
    rows += [(None, "x " * 30), (None, None), (401, ""), (401, " - "), (402, "É1b c D\x01e"), (7, "same id " * 20), (8, rows[8][1]), (403, "long " * 100_000), (404, "z" * 1_000_000)]
    rows += [(500 + i % 3, "copy of one text " * 6) for i in range(300)]
    return rows


@pytest.mark.parametrize("least,most", [(1, 1), (1, 3), (2, 2)])
def test_against_brute_force(spark, least, most):
    rows, target = corpus(), ["w1 w2 w3", "W1 copy", None, "", "rare"]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, bucket int, score int").repartition(7)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    found = im.resample(docs, bench, least=least, most=most, percent=25)
    assert told(found) == brute(rows, target, least, most, percent=25)


def test_query_against_brute_force(spark):
    df = entry.queries()["op12_importance_resampling"](spark, SF)
    assert df.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    assert told(df) == brute(docs, target)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert im.resample(docs, bench).count() == 0
    rows = corpus()
    assert told(im.resample(spark.createDataFrame(rows, docs.schema), bench)) == brute(rows, [])


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 50).alias("score")).repartition(23)
    order = [F.desc("score"), F.asc("doc_id")]
    found = im.global_ranks(rows, order, "rank").orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 5001))
    assert [(r.score, r.doc_id) for r in found] == sorted(((r.score, r.doc_id) for r in found), key=lambda x: (-x[0], x[1]))


def test_scores_need_no_python_and_broadcast_the_gains_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = im.gains(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    plan = im.scored(docs, table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("BroadcastExchange") == 1
    assert table.count() <= im.BUCKETS
