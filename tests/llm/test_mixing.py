import math
import random

import numpy as np
import pytest

from headwater.llm import mixing

KINDS = {"north": "snow ice fjord birch elk".split(), "south": "vine olive sun quay lemon".split(), "west": "surf dune gull tide reef".split()}


def tables(spark, n=300):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(KINDS[d]) for _ in range(rng.randint(3, 60))), d) for i, d in ((i, ["north", "north", "north", "south", "west"][i % 5]) for i in range(n))]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(None, None, 1), (n, "", 1), (n, "", 1), (n + 1, "elk " * 20000, 1)], "doc_id long, text string, rate int")
    labelled = spark.createDataFrame([(i, d) for i, _, d in rows if i % 2] + [(None, "west"), (0, None)], "doc_id long, domain string")
    return docs, labelled, rows


def test_totals_meet_targets(spark):
    docs, labelled, rows = tables(spark)
    got = mixing.mix(docs, labelled, {"north": 0.2, "south": 0.5, "west": 0.3}).collect()
    assert len(got) == 304 and all(r._rate >= 0 for r in got)
    truth = {i: d for i, _, d in rows}
    assert np.mean([r.domain == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.97
    totals = sum(np.array(r.posterior) * r.tokens * r._rate for r in got)
    assert totals / totals.sum() == pytest.approx([0.2, 0.5, 0.3], abs=2e-3)
    assert totals.sum() == pytest.approx(sum(r.tokens for r in got), rel=2e-3)


def test_steps_are_projected_gradient(spark):
    """The steps equal a plain loop's, the fold over them its rates, and the residual is that of the exact totals."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.4, 0.4], 60)
    n = rng.integers(1, 50, 60).astype(float)
    mass, goal = n @ p, np.array([0.7, 0.2, 0.1]) * n.sum()
    steps, rates = mixing.descend(p, n, np.ones(60), mass, goal, np.ones(3, bool), 1.0, 25, 0.0)
    r = [1.0] * 60
    for g in steps:
        totals = [sum(n[i] * r[i] * p[i][k] for i in range(60)) for k in range(3)]
        assert np.allclose(g, [(totals[k] - goal[k]) / mass[k] for k in range(3)])
        r = [max(0.0, r[i] - sum(p[i][k] * g[k] for k in range(3))) for i in range(60)]
    assert len(steps) == 25 and np.allclose(rates, r) and np.allclose(mixing._rates(p, steps), r)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "tokens long, posterior array<double>")
    history, residual = mixing.solve(members.repartition(3), ["a", "b", "c"], {"a": 0.7, "b": 0.2, "c": 0.1})
    miss = np.abs((n * mixing._rates(p, history)) @ p - goal).max() / n.sum()
    assert residual == pytest.approx(miss, abs=1e-9) and miss < 1e-3


def test_targets_out_of_reach_show(spark):
    members = spark.createDataFrame([(10, [0.5, 0.5]), (30, [0.5, 0.5])], "tokens long, posterior array<double>")
    history, residual = mixing.solve(members, ["a", "b"], {"a": 0.9, "b": 0.1})
    assert residual == pytest.approx(0.4, abs=1e-3) and np.isfinite(history).all()


def test_classifier_against_plain_loop():
    """Gradients of the softmax loss by hand lead to the same weights."""
    rows = [(b"snow ice", "n"), (b"sun vine sun", "s"), (b"", "s"), (b"ICE", "n"), (b"surf", "w")]
    got = mixing.train(rows, steps=4)
    domains, size = ["n", "s", "w"], mixing.BUCKETS
    shares = []
    for text, _ in rows:
        low, one = text.lower(), {}
        for i in range(len(low) - 2):
            at = ((low[i] << 16 | low[i + 1] << 8 | low[i + 2]) * 2654435761 % (1 << 32)) >> 18
            one[at] = one.get(at, 0) + 1 / (len(low) - 2)
        shares.append(one)
    w, m, v = ({} for _ in range(3))
    b = [math.log(sum(d == x for _, x in rows) / len(rows)) for d in domains]
    for t in range(1, 5):
        g, gb = {}, [0.0] * 3
        for one, (_, y) in zip(shares, rows):
            z = [b[k] + sum(w.get((a, k), 0) * x for a, x in one.items()) for k in range(3)]
            e = [math.exp(x - max(z)) for x in z]
            for k in range(3):
                error = (e[k] / sum(e) - (domains[k] == y)) / len(rows)
                gb[k] += error
                for a, x in one.items():
                    g[a, k] = g.get((a, k), 0) + error * x
        for key, x in g.items():
            x += 1e-6 * w.get(key, 0)
            m[key], v[key] = 0.9 * m.get(key, 0) + 0.1 * x, 0.99 * v.get(key, 0) + 0.01 * x * x
            w[key] = w.get(key, 0) - 3.0 * m[key] / (1 - 0.9**t) / (math.sqrt(v[key] / (1 - 0.99**t)) + 1e-7)
        b = [x - 0.5 * y for x, y in zip(b, gb)]
    assert got.domains == domains and got.weights.shape == (size, 3)
    assert np.allclose(got.bias, b, atol=1e-4)
    assert np.allclose([got.weights[a, k] for a, k in w], list(w.values()), rtol=1e-2, atol=1e-2)


def test_odd_tables(spark):
    docs, labelled, _ = tables(spark, 5)
    assert {r.domain for r in mixing.mix(docs, labelled.where("false")).collect()} == {"unknown"}
    assert mixing.mix(docs.where("false"), labelled).count() == 0
