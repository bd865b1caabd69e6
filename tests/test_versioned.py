"""The versioned table: what a merge rewrites, repeated batches, conflicts, expiry, old versions."""

import pytest
from pyspark.sql import functions as F

from headwater.operators import state
from headwater.sources import versioned
from headwater.sources.versioned import BucketTable, Conflict

SCHEMA = "id long, v long, at timestamp"


def rows(spark, ids, v, day=1):
    return spark.createDataFrame([(i, v) for i in ids], "id long, v long").withColumn("at", F.expr(f"timestamp'2024-01-{day:02d}'"))


def newest(old, new):
    return old.unionByName(new).groupBy("id").agg(F.max("v").alias("v"), F.min("at").alias("at"))


@pytest.fixture()
def table(spark, tmp_path):
    return BucketTable(spark, f"{tmp_path}/t", "id", SCHEMA, 16, "at")


def told(df):
    return {r.id: r.v for r in df.collect()}


def files(table, version):
    return {n: b["path"] for n, b in table.manifest(version)["buckets"].items()}


def test_a_merge_rewrites_the_touched_buckets_alone(spark, table):
    assert table.read().count() == 0 and table.versions() == []
    first = table.merge(rows(spark, range(4000), 1), newest, "w", 0)
    assert first["touched"] == 16 and first["rows_written"] == 4000 and first["bytes_kept"] == 0
    few = table.merge(rows(spark, [5], 2), newest, "w", 1)
    assert few["touched"] == 1 and few["bytes_written"] * 8 < first["bytes_written"] and few["bytes_kept"] * 8 > first["bytes_written"] * 7
    some = table.merge(rows(spark, [5, 6, 7], 3), newest, "w", 2)
    assert some["touched"] <= 3 and some["bytes_written"] * 4 < first["bytes_written"]
    before, after = files(table, 1), files(table, 2)
    assert sum(before[n] != after[n] for n in before) == 1
    assert told(table.read()) == {i: 3 if i in (5, 6, 7) else 1 for i in range(4000)}
    assert told(table.read(1)) == dict.fromkeys(range(4000), 1)


def test_a_batch_delivered_again_changes_nothing(spark, table):
    table.merge(rows(spark, [1, 2], 1), newest, "w", 7)
    again = table.merge(rows(spark, [1, 2, 3], 9), newest, "w", 7)
    assert not again["changed"] and again["version"] == 1 and told(table.read()) == {1: 1, 2: 1}
    assert table.merge(rows(spark, [3], 4), newest, "other", 0)["version"] == 2
    assert not table.merge(rows(spark, [3], 5), newest, "w", 6)["changed"]
    empty = table.merge(rows(spark, [], 0).limit(0), newest, "w", 8)
    assert empty["changed"] and empty["touched"] == 0 and table.manifest()["writers"] == {"w": 8, "other": 0}


def test_the_second_of_two_writers_starts_again(spark, table, monkeypatch):
    table.merge(rows(spark, [1], 1), newest, "w", 0)
    other, calls = BucketTable(spark, table.path, "id", SCHEMA, 16, "at"), []

    def slow(old, new):
        if not calls:  # another writer commits between reading and writing
            other.merge(rows(spark, [1, 2], 5), newest, "other", 0)
        calls.append(1)
        return newest(old, new)

    assert table.merge(rows(spark, [1], 3), slow, "w", 1)["version"] == 3
    assert len(calls) == 2 and told(table.read()) == {1: 5, 2: 5}
    with pytest.raises(Conflict):
        table._commit(table.manifest())
    assert table.versions() == [1, 2, 3] and versioned.TRIES > 2


def test_expiry_reads_only_buckets_with_old_rows(spark, table):
    table.merge(rows(spark, range(200), 1, day=20), newest, "w", 0)
    table.merge(rows(spark, [1000], 1, day=2), newest, "w", 1)
    cut = 1_704_844_800_000_000  # 2024-01-10
    done = table.expire(cut)
    assert done["touched"] == 1 and 1000 not in told(table.read()) and table.read().count() == 200
    assert not table.expire(cut)["changed"]
    assert table.expire(cut * 2)["touched"] == 16 and table.read().count() == 0


def test_old_versions_go_and_kept_ones_stay_whole(spark, table):
    for n in range(5):
        table.merge(rows(spark, [n, 50], n), newest, "w", n)
    want = told(table.read()), told(table.read(4))
    assert table.collect(keep=2) > 0
    assert table.versions() == [4, 5] and (told(table.read()), told(table.read(4))) == want
    assert table.collect(keep=2) == 0
    assert told(table.look_up(spark.createDataFrame([(50,), (99,)], "id long"))) == {50: 4}


def test_news_keep_all_their_columns(spark):
    log = spark.createDataFrame(
        [(1, 1, 1.0, "a", "s1", "x", "p1"), (1, 2, 3.0, "b", "s2", "y", "p2"), (1, 3, 2.0, None, "s3", "z", "p3")],
        "id long, seq long, heat double, summary string, source string, `column` string, published string",
    ).selectExpr("*", "timestamp_seconds(seq) ts", "summary title", "cast(null as string) image", "source url")
    got = state.upsert_news(log).first()
    assert (got.source, got["column"], got.published, got.heat, got.url) == ("s1", "x", "p1", 3.0, "s1")
