"""Filters that read what rule packs promise, and the cache in the order of its keys."""

import glob
import json

from pyspark.sql import functions as F

from headwater.functions import text as X
from headwater.operators import curate, enrich, run

RULES = curate.Rules(block=r"(?i)\bcasino\b", offers=r"(?i)\d+% off", exclude_url={"s1": r"/video/"}, exclude_title={"s2": r"(?i)^live:"}, include_title={"s3": r"(?i)economy"})


def test_every_rule_blocks_in_the_filter_itself(spark):
    rows = [
        (1, "s1", "fine", None, "https://x.example/a", [], None), (2, "s1", "Casino night", "", "https://x.example/a", [], "blocked"), (3, "s1", "t", "a casino", "u", [], "blocked"),
        (4, "s1", "t", None, "https://x.example/best-casino-tips", [], "blocked"), (5, "s1", "t", None, "https://x.example/best%2Dcasino", None, "blocked"), (6, "s1", "t", None, "https://casino.example/a", ["news"], None),
        (7, "s1", "t", None, "https://x.example/a", ["Fun", "Casino"], "blocked"), (8, "s1", "t", "50% off today", None, [], "noise"), (9, "s1", "t", None, "https://x.example/video/1", [], "noise"),
        (10, "s9", "t", None, "https://x.example/video/1", [], None), (11, "s2", "Live: now", None, "u", [], "noise"), (12, "s9", "Live: now", None, "u", [], None), (13, "s3", "sports", None, "u", [], "excluded"), (14, "s3", "The economy", None, "u", [], None),
        (15, None, None, None, None, None, None), (16, "s3", None, None, None, None, "excluded"), (17, "s1", "Casino", "9% off", "https://x.example/video/", [], "blocked"),
    ]
    h = spark.createDataFrame(rows, "id int, source string, title string, summary string, url string, categories array<string>, want string").withColumn("date", F.lit(curate.ANCHOR).cast("timestamp"))
    got = {r.id: r.reason for r in h.withColumn("reason", curate.reason(h, RULES)).collect()}
    assert got == {r[0]: r[-1] for r in rows}
    bare = h.drop("categories", "url")
    assert bare.withColumn("reason", curate.reason(bare, RULES)).where("reason = 'blocked'").count() == 3
    undated = h.withColumn("date", F.when(F.col("id") > 2, F.col("date") - F.expr("interval 11 days")))
    assert {r.reason for r in undated.withColumn("reason", curate.reason(undated, RULES)).collect()} == {"undated", "old"}


def test_cache_is_written_in_the_order_of_its_keys(spark, tmp_path):
    path = f"{tmp_path}/cache"
    cache = spark.range(1000).select(F.sha1(F.col("id").cast("string")).alias("key"), F.col("id").alias("v")).repartition(7)

    def lines():
        return [line for name in sorted(glob.glob(f"{path}/part-*")) for line in open(name)]

    enrich.write_sorted_cache(cache, path, "key")
    first = lines()
    assert [json.loads(x)["key"] for x in first] == sorted(json.loads(x)["key"] for x in first) and len(first) == 1000
    enrich.write_sorted_cache(cache.withColumn("v", F.when(F.col("v") == 5, -1).otherwise(F.col("v"))), path, "key")
    assert sum(a != b for a, b in zip(first, lines(), strict=True)) == 1


def test_run_counts_on_the_way_and_reads_nothing_twice(spark):
    at = F.lit(curate.ANCHOR).cast("timestamp")
    rows = [
        (1, "s1", "One", "https://x.example/a?utm_source=q"), (2, "s1", "Other", "https://x.example/a#top"), (3, "s1", "one!", "https://x.example/b"), (4, "s2", "Casino", "https://x.example/c"),
        (5, None, "No source", "https://x.example/d"), (6, "s7", "Unknown feed", "https://x.example/e"), (7, "s2", "99% off", "https://x.example/f"), (8, "s1", "No url", None), (9, "s1", "No url either", None),
    ]
    h = spark.createDataFrame(rows, "doc_id long, source string, title string, url string").withColumn("summary", F.lit("")).withColumn("column", F.lit("en")).withColumn("date", at)
    made = run.radar_run(h, ["s1", "s2", "s3"], RULES, per_source=1)
    got = {r.source: (r.found, r.blocked, r.noise, r.duplicated, r.limited, r.used) for r in made.report.collect()}
    assert got == {"s1": (5, 0, 0, 3, 1, 1), "s2": (2, 1, 1, 0, 0, 0), "s3": (0,) * 6, "other": (2, 0, 0, 0, 0, 2)}
    assert {r.doc_id for r in made.items.collect()} == {1, 5, 6}
    assert {r.url for r in made.items.where("doc_id = 1").collect()} == {"https://x.example/a"}
    plan = made.report._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" not in plan and "Aggregate" not in plan
    empty = run.radar_run(h.limit(0), ["s1"], RULES)
    assert empty.items.count() == 0 and [tuple(r)[1:] for r in empty.report.collect()] == [(0,) * 9] * 2


def test_summaries_lose_footers_of_any_length(spark):
    cases = {
        "&lt;p&gt;Oi &lt;b&gt;mundo&lt;/b&gt;&lt;/p&gt; [&#8230;]": "Oi mundo…", "<p>Text</p> Read more " + "x " * 200: "Text", "A [...] b": "A [...] b", "A [...] ": "A…",
        "Body O post Um título apareceu primeiro em Sítio.": "Body", "Readmore is one word": "Readmore is one word", "a &lt; b": "a < b", "Leia mais": "", "": "", None: "",
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r.i: r.s for r in rows.select("i", X.clean_summary(F.col("t")).alias("s")).collect()}
    assert got == dict(enumerate(cases.values()))
