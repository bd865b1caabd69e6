import random

import corpus_pipeline as cp
from headwater.llm import simhash_dedup as sd


def slow_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def slow_groups(rows):
    """For each row the number of its class."""
    sets, group = [slow_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if group[i] != group[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (4, "one"), (5, "a b"), (None, "x y z w"), (None, "x y z w"), (None, "p q r s t u v"), (6, "w " * 4000), (7, "other text than the four"), (7, "and one more under this id")]
    for n in (12, 30, 60, 150):
        base = [word() for _ in range(n)]
        for k in range(60):
            words = list(base)
            for _ in range(rng.randint(0, max(1, n // 30))):
                words[rng.randrange(n)] = word()
            rows.append((1000 * n + (k if k % 2 else 100 - k), " ".join(words)))
    passage = " ".join(word() for _ in range(40))
    rows += [(9_000_000 + k, passage + " " + " ".join(word() for _ in range(30))) for k in range(40)]
    return rows


def test_keep_one_against_brute_force(spark):
    rows = corpus()
    groups = {}
    for g, (d, t) in zip(slow_groups(rows), rows):
        groups.setdefault(g, []).append(d)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    kept = sd.keep_one(docs)
    assert kept.columns == docs.columns
    want = [min((d for d in ds if d is not None), default=None) for ds in groups.values()]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
    assert len(want) < len(rows) - 150


def test_stage_drops_light_edits(spark):
    """One word of 60 changed: similar at 0.84, though the fingerprints of op10 are 6 bits away."""
    words = [f"w{i * 7919 % 1000}" for i in range(60)]
    rows = [(i, " ".join(words[:k] + ["edited"] + words[k + 1 :]) if k else " ".join(words), "en", "s", 1) for i, k in enumerate((0, 20, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in cp.keep_one_near_duplicate(spark, docs, "").collect()] == [0]


def test_empty(spark):
    assert sd.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_frequent_shingles_are_counted_over_all_rows(spark):
    """A shingle of 16 texts is frequent and one of 15 is not, wherever they lie; 40 copies and repeats within a text count as rows."""
    own = lambda k: " ".join(f"t{k}x{i}" for i in range(6))
    passages = {n: " ".join(f"p{n}y{i}" for i in range(5)) for n in (1, 15, 16, 17)}
    rows = [(k, " ".join([own(k), *[p for n, p in passages.items() if k < n]] + [passages[1]] * (3 if k == 0 else 0))) for k in range(60)]
    rows += [(100 + k, "one text of forty copies") for k in range(40)] + [(200, None)]
    found = sd._frequent(sd._narrow(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"), 5)
    upper = lambda text: set(sd._upper(sd.shingle_hashes(text.encode(), 5)).tolist())
    assert set(found.tolist()) >= upper(passages[16]) | upper(passages[17]) | upper("one text of forty copies")
    assert not set(found.tolist()) & (upper(passages[15]) | upper(passages[1]) | upper(own(3)))
    assert list(found) == sorted(found)


def test_small_limits_give_the_same(spark, monkeypatch):
    """Large buckets, hot texts and joins without broadcasts lead to the same rows."""
    for name, value in (("SAMPLE", 1), ("MOST_BROADCAST", 0), ("MOST_PAIRS", 2)):
        monkeypatch.setattr(sd, name, value)
    test_keep_one_against_brute_force(spark)


def test_runs_are_carried_over_batches():
    """Each pair of a run meets, or meets its first row, however batches cut the run."""
    import numpy as np
    import pyarrow as pa

    def met(step, size):
        key = np.repeat(np.arange(5), [1, 2, 3, size, 4])
        cols = [key, np.arange(len(key)), np.full(len(key), 10, np.int32), np.zeros(len(key), np.int32)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + step]) for c in cols], ["key", "name", "n", "pos"]) for i in range(0, len(key), step)]
        out = [r for b in sd._meet(iter(batches)) for r in b.to_pylist()]
        return {(r["a"], r["b"]) for r in out if r["b"] is not None}, {r["a"] for r in out if r["b"] is None}

    for size in (40, 70_000):
        pairs, rows = met(1000, size)
        assert (pairs, rows) == met(70, size) == met(10**6, size)
        assert rows == {3, 4, 5, *range(6, 6 + size + 4)}
        assert {p for p in pairs if p[0] < 6} == {(1, 2), (3, 4), (3, 5)}
        assert len([p for p in pairs if p[0] == 6]) == size - 1
