"""Search by n-grams, patterns by needed words, signed tokens, streams that fail: against scans, vectors and plain Python."""

import base64
import hashlib
import hmac
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from headwater.functions import tokens
from headwater.operators import search
from headwater.streaming import supervise


def test_search_finds_what_a_scan_finds(spark):
    rng = random.Random(1)
    texts = [(i, rng.choice(["a", "b"]), "".join(rng.choice("abcé \n") for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(900, "a", None), (901, "a", "x" * 50_000 + "needle"), (902, "b", "a.b*c")]
    needles = [(k, rng.choice(["a", "b"]), "".join(rng.choice("abcé \n") for _ in range(rng.randint(1, 6)))) for k in range(60)] + [(100, "a", ""), (101, "a", None), (102, "a", "xneedle"), (103, "b", ".b*"), (104, "a", "zzz"), (105, "b", "a.b*c")]
    rows = spark.createDataFrame(texts, "id long, part string, text string")
    found = search.search(spark.createDataFrame(needles, "needle_id long, part string, needle string"), search.postings(rows), rows)
    want = {(k, i, p) for k, p, n in needles if n for i, q, t in texts if p == q and t is not None and n in t}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 100
    assert found.count() == len(want)


def _odd_search(spark):
    texts = [(1, "a", "straw"), (1, "a", "berry"), (2, "a", "raw berry"), (None, "a", "no id, raw"), (3, None, "raw"), (4, "b", "raw"), (5, "a", None)]
    needles = [(1, "a", "raw"), (1, "a", "berry"), (1, "b", "raw"), (2, "a", "raw"), (2, "a", "raw"), (None, "a", "berry"), (None, "a", "err"), (3, None, "raw"), (4, "a", "strawberry")]
    rows = spark.createDataFrame(texts, "id long, part string, text string")
    asked = spark.createDataFrame(needles, "needle_id long, part string, needle string")
    found = search.search(asked, search.postings(rows), rows)
    want = {(k, i, p) for k, p, n in needles for i, q, t in texts if p is not None and p == q and t is not None and n in t}
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    return found


def test_search_with_repeated_and_null_ids(spark, monkeypatch):
    _odd_search(spark)
    monkeypatch.setattr(search, "MOST_BROADCAST", 0)
    _odd_search(spark)


def test_search_shuffles_no_pairs(spark):
    """40 needles that all of 2,000 texts contain: 80,000 pairs, which no exchange carries."""
    rows = spark.range(2000).select("id", F.lit("a").alias("part"), F.concat(F.lit("common text "), F.col("id").cast("string")).alias("text"))
    needles = spark.range(40).select(F.col("id").alias("needle_id"), F.lit("a").alias("part"), F.when(F.col("id") % 2 == 0, "common").otherwise("text").alias("needle"))
    found = search.search(needles, search.postings(rows), rows)
    assert found.count() == 80_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("BroadcastHashJoin")]


def test_patterns_by_needed_words_equal_the_plain_join(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(80)] + ["Açúcar", "ÀÉ", "a-b"]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))) for i in range(400)] + [(1000, None), (1001, "")]
    packs = [search.Pattern(w, (w.lower(),), rf"(?i)(^|[^\p{{L}}\p{{N}}]){w}([^\p{{L}}\p{{N}}]|$)") for w in vocabulary[:60]] + [search.Pattern("two", ("w1", "w2"), "w1 w2|w2 w1")]
    rows = spark.createDataFrame(texts, "id long, text string")
    plain = rows.select("id", F.explode(F.array(*[F.when(F.col("text").rlike(p.pattern), F.lit(p.name)) for p in packs])).alias("name")).where("name is not null")
    got = search.match_patterns(rows, packs, "id", "text")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in plain.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(
    "key,data",
    [(b"\x0b" * 20, b"Hi There"), (b"Jefe", b"what do ya want for nothing?"), (b"\xaa" * 20, b"\xdd" * 50), (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First"), (b"", b"")],
)
def test_keyed_hash(spark, key, data):
    got = spark.range(1).select(tokens.hmac_sha256(F.lit(bytearray(data)), key).alias("x")).first().x
    assert bytes(got) == hmac.new(key, data, hashlib.sha256).digest()


def test_published_vector(spark):
    got = spark.range(1).select(F.hex(tokens.hmac_sha256(F.lit(bytearray(b"Hi There")), b"\x0b" * 20)).alias("x")).first().x
    assert got == "B0344C61D8DB38535CA8AFCEAF0BF12B881DC200C9833DA726E9376C2E32CFF7"


def token(claims, key=b"k", alg="HS256"):
    part = lambda raw: base64.urlsafe_b64encode(raw).rstrip(b"=").decode()
    body = part(json.dumps({"alg": alg}).encode()) + "." + part(json.dumps(claims).encode())
    return body + "." + part(hmac.new(key, body.encode(), hashlib.sha256).digest())


def test_refusals(spark):
    fine = {"exp": 200, "iss": "me", "aud": "a", "x": "é"}
    cases = [
        (token(fine), None), (token(fine | {"aud": ["b", "a"]}), None), (token(fine | {"nbf": 100}), None), (token(fine, b"other"), "signature"), (token(fine)[:-1], "signature"),
        (token(fine, alg="none"), "algorithm"), (token(fine | {"exp": 100}), "expired"), (token({"iss": "me", "aud": "a"}), "expired"), (token(fine | {"exp": "soon"}), "expired"), (token(fine | {"nbf": 101}), "early"),
        (token(fine | {"iss": "you"}), "issuer"), (token({"exp": 200, "aud": "a"}), "issuer"), (token(fine | {"aud": "ab"}), "audience"), (token({"exp": 200, "iss": "me"}), "audience"),
        (None, "malformed"), ("", "malformed"), ("a.b", "malformed"), ("a.b.c.d", "malformed"), ("!.!.!", "malformed"), ("e30._w.e30", "malformed"),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.why for r in rows.select("i", tokens.refusal(F.col("t"), b"k", F.lit(100), "me", "a").alias("why")).collect()}
    assert got == {i: why for i, (_, why) in enumerate(cases)}


def test_one_failing_stream_leaves_the_others(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/in")

    def start(name, act):
        rows = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        return lambda: rows.writeStream.foreachBatch(act).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()

    def fails(batch, number):
        raise ValueError("on purpose")

    def absent():
        raise FileNotFoundError("no such feed")

    seen = []
    starts = {"bad": start("bad", fails), "good": start("good", lambda b, n: seen.append(b.count())), "gone": absent, "last": start("last", lambda b, n: seen.append(b.count()))}
    got = {r.name: r for r in supervise.run_streams(spark, starts).collect()}
    assert {n: r.state for n, r in got.items()} == {"bad": "failed", "good": "done", "gone": "not started", "last": "done"}
    assert sum(seen) == 200 and got["good"].rows == got["last"].rows == 100 and got["gone"].error == "no such feed"
    assert got["bad"].error and re.search("purpose|Exception|error", got["bad"].error, re.I)
    again = supervise.run_streams(spark, {"bad": start("bad", lambda b, n: seen.append(b.count()))}).first()
    assert again.state == "done" and sum(seen) == 300
