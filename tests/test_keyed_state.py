"""Keyed state with timers: changed keys only, expiry by event time and by the clock, restarts."""

import random
import time

from pyspark.sql import functions as F

from headwater.streaming import keyed_state as ks

DAY = 86_400_000
ROW = "id long, seq long, ts timestamp, title string, image string, url string, heat double"


def log(n, ids, first_day, days, seed):
    rng = random.Random(seed)
    return [(rng.randrange(ids), seed * 10_000 + i, first_day + rng.random() * days, rng.choice(["t", None, "u"]) and f"t{i}", rng.choice(["", None, f"i{i}"]), f"u{i}", rng.choice([None, float(i)])) for i in range(n)]


def put(spark, folder, rows):
    spark.createDataFrame([(a, b, d, *r) for a, b, d, *r in rows], ROW.replace("ts timestamp", "day double")).withColumn("ts", F.timestamp_micros((F.col("day") * 86_400_000_000).cast("long"))).select("id", "seq", "ts", "title", "image", "url", "heat").coalesce(1).write.mode("append").parquet(folder)


def merged(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        own = out.setdefault(r[0], dict(url=r[5], first=r[2], heat=None, image=None))
        own["title"] = r[3]
        own["image"] = r[4] or own["image"]
        own["first"] = min(own["first"], r[2])
        own["heat"] = max((h for h in (own["heat"], r[6]) if h is not None), default=None)
    return out


def source(spark, folder):
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(folder)


def test_state_expires_by_event_time_and_restarts(spark, tmp_path):
    folder, path = f"{tmp_path}/in", f"{tmp_path}/state"
    one = log(300, 60, 100, 8, 1) + [(1000, 5, 100.0, "old", None, "u", 1.0)]
    put(spark, folder, one)
    news = ks.expiring_news(spark, source(spark, folder), path, days=10, by_clock=False)
    got = {r.id: (r.title, r.image, r.url, r.heat) for r in news.read().collect()}
    assert got == {k: (v["title"], v["image"], v["url"], v["heat"]) for k, v in merged(one).items()}
    assert not ks.expiring_news(spark, source(spark, folder), path, days=10, by_clock=False).versions()[:-3]
    # A later file: keys first seen ten days before its end, less the day that rows may be late, leave.
    two = log(40, 8, 109, 3, 2)
    put(spark, folder, two)
    again = ks.expiring_news(spark, source(spark, folder), path, days=10, by_clock=False)
    end = max(r[2] for r in two) - 1
    want = {k: v for k, v in merged(one + two).items() if int(v["first"] * DAY) + 10 * DAY > int(end * DAY)}
    got = {r.id: (r.title, r.image, r.url, r.heat) for r in again.read().collect()}
    assert got == {k: (v["title"], v["image"], v["url"], v["heat"]) for k, v in want.items()}
    assert 1000 not in got and 0 < len(got) < 61


def test_only_changed_keys_leave_and_the_clock_expires_them(spark, tmp_path):
    folder, seen = f"{tmp_path}/in", []

    def run():
        with ks._rocksdb(spark):
            changes = ks.changed_news(source(spark, folder), 20_000)
            query = changes.writeStream.outputMode("update").foreachBatch(lambda b, n: seen.append(sorted((r.id, r.op) for r in b.collect()))).option("checkpointLocation", f"{tmp_path}/c").trigger(**ks.once(True)).start()
            query.awaitTermination()

    put(spark, folder, [(i, i, 1.0, "t", None, "u", 1.0) for i in range(5)])
    run()
    put(spark, folder, [(2, 20, 2.0, "t2", None, "u", 9.0)])
    run()
    assert seen == [[(i, "upsert") for i in range(5)], [(2, "upsert")]]
    time.sleep(21)
    put(spark, folder, [(7, 30, 2.0, "t", None, "u", 0.0)])
    run()
    gone = {i for batch in seen for i, op in batch if op == "expired"}
    assert gone == set(range(5)) and (7, "upsert") in seen[-1]
    put(spark, folder, [(2, 5, 3.0, "anew", None, "v", 0.5)])
    with ks._rocksdb(spark):
        rows = []
        ks.changed_news(source(spark, folder), 20_000).writeStream.outputMode("update").foreachBatch(lambda b, n: rows.extend(b.where("op = 'upsert'").collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(**ks.once(True)).start().awaitTermination()
    assert [(r.id, r.title, r.url, r.heat) for r in rows] == [(2, "anew", "v", 0.5)]
