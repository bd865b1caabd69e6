import numpy as np
import pytest
from pyspark.sql import functions as F

from headwater.llm import ann


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        out[q] = sorted((float(a), b) for a, b in zip(d, ids) if b != q)[:k]
    return out


@pytest.mark.parametrize("spread", [0, 3])
def test_recall_and_exact_scores(spark, spread):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(3000, 24)) + spread * rng.normal(size=(12, 24))[rng.integers(0, 12, 3000)]).astype(np.float32).astype(np.float64)
    docs = spark.createDataFrame([(i, [float(a) for a in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, rank int")
    got = ann.search(docs, lambda i: i % 50 == 0, cells=60).collect()
    want = brute(list(range(3000)), x, range(0, 3000, 50))
    hits = 0
    for q, best in want.items():
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in rows] == sorted((r.score, r.vec_id) for r in rows)
        for r in rows:
            assert r.score == pytest.approx(float(np.sqrt(((x[r.vec_id] - x[q]) ** 2).sum())), rel=1e-12)
        hits += len({r.vec_id for r in rows} & {i for _, i in best})
    assert hits / (10 * len(want)) >= 0.9


def test_copies_ties_and_bad_vectors(spark):
    good = [[1.0, 2.0, 2.0]] * 40 + [[float(i), 1.0, 0.0] for i in range(1, 8)]
    rows = list(enumerate(good))
    bad = [(100, None), (101, [0.0] * 3), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 1.0, 1.0]), (105, [1.0, 2.0]), (None, [1.0, 2.0, 2.0]), (0, [1.0, 2.0, 2.0])]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>")
    got = ann.search(df, lambda i: i % 10 == 0, probes=64).collect()
    want = brute(list(range(47)), np.array(good), range(0, 47, 10))
    for q in want:  # the second row of id 0 is a candidate for every query
        d = float(np.sqrt(((np.array(good[0]) - np.array(good[q])) ** 2).sum()))
        want[q] = sorted([*want[q], (d, 0)])[:10]
    assert {r.query_id for r in got} == set(want)
    for q, best in want.items():
        assert [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == best


def test_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(df, lambda i: F.lit(True)).orderBy("query_id").collect()] == [(0, 1, 1, 2**0.5), (1, 1, 0, 2**0.5)]
    assert ann.search(df.where("false"), lambda i: F.lit(True)).count() == 0
    assert ann.search(df, lambda i: F.lit(False)).count() == 0


def test_few_cells_are_measured_in_clustered_tables(spark, monkeypatch):
    """Recall holds while far less than a fifth of the table is measured exactly."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 16)) + 6 * rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen = []
    real = ann._ask
    monkeypatch.setattr(ann, "_ask", lambda *a: seen.append(a[-1]) or real(*a))
    got = {(r.query_id, r.vec_id) for r in ann.search(df, lambda i: i % 100 == 0).collect()}
    want = {(q, i) for q, best in brute(list(range(4000)), x, range(0, 4000, 100)).items() for _, i in best}
    assert len(got & want) >= 0.9 * len(want)
    assert all(n <= 0.2 * len(x) for n in seen)


def test_starved_cells_fall_back_to_all(spark):
    """A query alone in its cell still gets all candidates."""
    x = [[float(i), 0.0] for i in range(1, 30)] + [[1e6, 1e6]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = ann.search(df, lambda i: i == 29, probes=1, cells=7).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(k + 1, 28 - k) for k in range(10)]


def test_large_cells_and_many_queries_are_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    test_recall_and_exact_scores(spark, 3)
