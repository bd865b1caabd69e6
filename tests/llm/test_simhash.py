import random

import pytest
import xxhash

from headwater.llm import components, simhash


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").split(" ") if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    names = {}
    for g, (d, _) in zip(group, rows):
        if d is not None:
            names[g] = min(d, names.get(g, d))
    return sorted(((d, fps[i] - (1 << 64 if fps[i] >> 63 else 0), names.get(group[i])) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (4, "one"), (5, "a b"), (None, "x y z w"), (None, "x y z w"), (6, "Éa É b c"), (7, "w " * 4000)]
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(120)) for _ in range(6)]
    for k in range(160):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "zz"
        rows.append((100 - k if k % 2 else 100 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("few", [300_000, 0])
def test_against_brute_force(spark, monkeypatch, few):
    """With 0 the classes are found by rounds of joins throughout, and hubs are dealt with apart."""
    monkeypatch.setattr(components, "FEW", few)
    monkeypatch.setattr(components, "HUB", 5)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, key int")
    found = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert found == slow_classes(rows)


@pytest.mark.parametrize("most", [4096, 16])
def test_large_bucket_is_spanned(spark, monkeypatch, most):
    """With 16 the buckets are dealt out by further bits."""
    monkeypatch.setattr(simhash, "MOST_IN_BUCKET", most)
    rng = random.Random(1)
    near = {sum(1 << b for b in rng.sample(range(20), rng.randint(0, 3))) for _ in range(400)}
    fps = spark.createDataFrame([(x,) for x in near], "fp long")
    links = simhash.links(fps).collect()
    assert all((r.a ^ r.b).bit_count() <= 3 for r in links)
    reach, todo = {0}, [0]
    while todo:
        at = todo.pop()
        for r in links:
            for p, q in ((r.a, r.b), (r.b, r.a)):
                if p == at and q not in reach:
                    reach.add(q)
                    todo.append(q)
    assert reach == near | {0}


@pytest.mark.parametrize("schema", ["doc_id long, text string"])
def test_empty(spark, schema):
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
