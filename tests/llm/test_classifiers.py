import random

import numpy as np
from pyspark.sql import functions as F

from headwater.llm import mixing, quality, toxicity
from headwater.llm.common import fold_bucket, one_text_an_id

COMMON = "the of and a river stone house walks under bright morning with field tree road cloud water".split()


def make(rng, toxic):
    words = [rng.choice(COMMON) for _ in range(rng.randint(20, 80))]
    if toxic:
        for _ in range(4):
            words[rng.randrange(len(words))] = rng.choice(["vile", "rotten,", "Awful"])
    return " ".join(words)


def toxic_tables(spark, n=400):
    rng = random.Random(2)
    rows = [(i, make(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in rows] + [(None, None, 1), (n, "", 1), (n + 1, "vile " * 9000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    return docs, labels, dict((i, y) for i, _, y in rows)


def test_toxicity_held_out(spark):
    docs, labels, truth = toxic_tables(spark)
    model = toxicity.fit(docs, labels.where(fold_bucket(F.col("doc_id"), 3) != 1))
    assert 0 < len(model.keys) < 2000
    got = toxicity.score(docs, model, out_col="score")
    assert got.columns == ["doc_id", "text", "score", "_score"]
    rows = got.withColumn("held", fold_bucket(F.col("doc_id"), 3) == 1).collect()
    assert len(rows) == 403
    held = [r for r in rows if r.held and r.doc_id in truth]
    right = sum((r._score >= 0.7) == (truth[r.doc_id] == 1) for r in held)
    assert right / len(held) > 0.95
    assert all(0 <= r._score <= 1 for r in rows)


def test_toxicity_without_labels(spark):
    docs, labels, _ = toxic_tables(spark, 8)
    model = toxicity.fit(docs, labels.where("false"))
    assert {r.x for r in toxicity.score(docs.select("doc_id", "text"), model, out_col="x").collect()} == {0.0}
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_ftrl_matches_plain_loop():
    rng = random.Random(4)
    rows = [(np.array(sorted(rng.sample(range(30), 6)), np.uint32), rng.randint(0, 1)) for _ in range(60)]
    how = toxicity.Ftrl(0.5, 1.0, 0.4, 0.1, 2, 1)
    z, n = {}, {}
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= (0 if k == "b" else 0.4) else -(z[k] - np.sign(z[k]) * (0 if k == "b" else 0.4)) / ((1 + n[k] ** 0.5) / 0.5 + 0.1)
    for _ in range(2):
        for x, y in rows:
            keys = [*map(int, x), "b"]
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for k in keys:
                s = ((n.get(k, 0) + g * g) ** 0.5 - n.get(k, 0) ** 0.5) / 0.5
                z[k], n[k] = z.get(k, 0) + g - s * w[k], n.get(k, 0) + g * g
    model = toxicity.train(rows, how)
    want = {k: weight(k) for k in z if k != "b" and weight(k)}
    assert np.isclose(model.bias, weight("b")) and set(map(int, model.keys)) == set(want)
    assert np.allclose(model.weights, [want[int(k)] for k in model.keys])


def quality_tables(spark, n=500):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        good = i % 5 != 0
        text = make(rng, False).capitalize() + "." if good else " | ".join(rng.choice(COMMON) for _ in range(30))
        rows.append((i, text, int(good)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "y"), (n, "", "z"), (n + 1, "go " * 9000, "z")], "doc_id long, text string, features string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    return docs, labels, dict((i, y) for i, _, y in rows)


def test_quality_held_out(spark):
    docs, labels, truth = quality_tables(spark)
    got = quality.quality_scores(docs, labels, lambda i: fold_bucket(i, 5) != 0).collect()
    assert len(got) == 503 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth]
    assert sum((r.score >= 0.3) == (truth[r.doc_id] == 1) for r in held) / len(held) > 0.95


def test_quality_without_negatives_or_labels(spark):
    docs, labels, truth = quality_tables(spark, 200)
    got = quality.quality_scores(docs, labels.where("quality = 1"), lambda i: F.lit(True)).collect()
    good = np.mean([r.score for r in got if truth.get(r.doc_id) == 1])
    assert good > np.mean([r.score for r in got if truth.get(r.doc_id) == 0]) + 0.3
    assert {r.score for r in quality.quality_scores(docs, labels.where("false"), lambda i: F.lit(True)).collect()} == {0.5}
    assert quality.quality_scores(docs.where("false"), labels, lambda i: F.lit(True)).count() == 0


def learnt(x, positive, prior):
    edges = np.quantile(x, np.linspace(0, 1, quality.BINS + 1)[1:-1], axis=0).T.astype(np.float32)
    m = quality.Moments(len(positive), len(x), quality.moments_of(positive, edges), quality.moments_of(x, edges))
    return edges, m, quality.minimise(m, prior)


def test_risk_against_plain_loop():
    """The risk from moments is that of the rows, and no nearby weights have a smaller one."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, quality.N_FEATURES)).astype(np.float32)
    y = rng.random(3000) < 0.6
    x[y, 0] += 3
    edges, m, w = learnt(x, x[y], 0.6)

    def f(row, w):
        return w[-1] + sum(w[k * quality.BINS + sum(row[k] > e for e in edges[k])] for k in range(quality.N_FEATURES))

    def plain(w):
        p, u = [f(r, w) for r in x[y][:800][:200]], [f(r, w) for r in x[:200]]
        return 0.6 * np.mean([(a - 1) ** 2 for a in p]), np.mean([(a + 1) ** 2 for a in u]) - 0.6 * np.mean([(a + 1) ** 2 for a in p])

    few = quality.Moments(200, 200, quality.moments_of(x[y][:200], edges), quality.moments_of(x[:200], edges))
    for v in (w, rng.normal(size=len(w))):
        assert np.allclose(quality.risk_parts(v, few, 0.6), plain(v))
    whole = lambda v: (lambda a, b: a + max(0.0, b) + 1e-3 * (v[:-1] ** 2).sum())(*quality.risk_parts(v, m, 0.6))
    assert all(whole(w) <= whole(w + 0.01 * rng.normal(size=len(w))) for _ in range(50))
    model = quality.model_of(w, 0.6, edges)
    assert ((model.scores(x)[y] > 0.5).mean() + (model.scores(x)[~y] < 0.5).mean()) / 2 > 0.85


def test_negative_risk_is_climbed():
    """Few unlabelled rows, a prior too large: the second part would fall below zero, and is held near it."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, quality.N_FEATURES)).astype(np.float32)
    positive = rng.normal(size=(400, quality.N_FEATURES)).astype(np.float32) + 1
    edges, m, w = learnt(x, positive, 0.95)
    assert quality.risk_parts(w, m, 0.95)[1] > -0.05 and np.isfinite(w).all()


def test_prior_from_scores():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0.5, 0.3, 20000), rng.normal(-0.5, 0.3, 20000)
    for p in (0.3, 0.6, 0.9):
        mixed = np.concatenate([good[: int(20000 * p)], bad[: int(20000 * (1 - p))]])
        counts = [np.histogram(v, 64, (-2, 2))[0] for v in (good[:5000], mixed)]
        assert abs(quality.prior_of(*counts) - p) < 0.05


def test_repeated_rows(spark):
    docs, labels, _ = quality_tables(spark, 60)
    twice = docs.unionByName(docs)
    got = quality.quality_scores(twice, labels.unionByName(labels), lambda i: F.lit(True)).collect()
    assert len(got) == 126
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(v) == 1 for v in seen.values())
    toxic_docs, toxic_labels, _ = toxic_tables(spark, 60)
    model = toxicity.fit(toxic_docs.unionByName(toxic_docs), toxic_labels.unionByName(toxic_labels))
    assert toxicity.score(toxic_docs.unionByName(toxic_docs), model).count() == 126


def test_an_id_on_very_many_rows_is_one_row_of_the_sample(spark):
    docs, labels, _ = toxic_tables(spark, 200)
    hot = spark.range(100_000, numPartitions=4).select(F.lit(8).cast("long").alias("doc_id"), F.concat(F.lit("plain words "), F.col("id").cast("string")).alias("text"), F.lit(1).alias("score"))
    many = docs.where("doc_id is null or doc_id <> 8").unionByName(hot)
    chosen = hot.selectExpr("min(struct(xxhash64(text) h, text)) m").select("m.text").first().text
    one = docs.where("doc_id is null or doc_id <> 8").unionByName(hot.where(F.col("text") == chosen))
    a, b = toxicity.fit(many, labels), toxicity.fit(one, labels)
    assert a.trained and a.bias == b.bias and np.array_equal(a.keys, b.keys) and np.array_equal(a.weights, b.weights)
    domains = labels.where("doc_id is not null").select("doc_id", F.when(F.col("toxic") == 1, "x").otherwise("y").alias("domain"))
    c, d = mixing.fit_classifier(many, domains), mixing.fit_classifier(one, domains)
    assert c.domains == d.domains and np.array_equal(c.weights, d.weights)


def test_one_text_an_id_is_chosen_before_the_shuffle(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 0, None), (2, 1, None)], "_id long, _label int, _text string")
    picked = one_text_an_id(rows, "_label")
    assert sorted(r._id for r in picked.collect()) == [1, 2] and picked.where("_id = 2").first()._text == ""
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and one_text_an_id(rows.where("false"), "_label").count() == 0
