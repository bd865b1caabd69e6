import math
import re
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from headwater.llm import ngram_lm as lm
from headwater.llm.common import fold_bucket
from headwater.llm.eliasfano import EliasFano, from_buffer, to_buffer


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=300), st.lists(st.integers(0, 2**63), max_size=30), st.integers(0, 60))
def test_elias_fano(values, probes, shift):
    values = np.array(sorted(v >> shift for v in values), np.uint64)
    coded = EliasFano.of_sections(from_buffer(to_buffer(EliasFano.encode(values).sections())))
    assert (coded[np.arange(len(values))] == values).all()
    asked = np.array([p >> shift for p in probes] + values.tolist(), np.uint64)
    assert (coded.next_at_least(asked) == np.searchsorted(values, asked)).all()
    found = coded.find(asked)
    assert all((f == -1) == (a not in set(values.tolist())) for f, a in zip(found, asked.tolist()))


def brute(rows, held, order, discount):
    """The model in plain dictionaries, without quantisation."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    toks = [re.findall("[^\x20\x09-\x0D]+", lower(t)) + [""] for _, t in rows]
    counts = [Counter() for _ in range(order + 1)]
    for t, h in zip(toks, held):
        if not h:
            padded = [""] * (order - 1) + t
            for i in range(order - 1, len(padded)):
                for n in range(1, order + 1):
                    counts[n][tuple(padded[i - n + 1 : i + 1])] += 1
    total, kinds = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for n in range(2, order + 1):
        for g, c in counts[n].items():
            total[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1
    big, v = sum(counts[1].values()), len(counts[1])
    out = []
    for t in toks:
        padded, base, score = [""] * (order - 1) + t, 0.0, 0.0
        for i in range(order - 1, len(padded)):
            p = (counts[1][(padded[i],)] + 0.5) / (big + 0.5 * (v + 1))
            base += math.log10(p)
            for n in range(2, order + 1):
                g = tuple(padded[i - n + 1 : i + 1])
                if total[n][g[:-1]] > 0:
                    p = max(counts[n][g] - discount, 0) / total[n][g[:-1]] + discount * kinds[n][g[:-1]] / total[n][g[:-1]] * p
            score += math.log10(p)
        out.append((len(t), sum(counts[1][(w,)] > 0 for w in t), big, base, score))
    return out


def corpus():
    rng = random.Random(11)
    rows = [(1, None), (2, ""), (3, "One"), (3, "one"), (None, "a b a b"), (4, "x " * 3000), (5, "Éa\tB\x0bc\x1cd")]
    rows += [(10 + i, " ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 60)))) for i in range(150)]
    return rows


@pytest.mark.parametrize("order,shards,hot_share,empties", [(2, 3, lm.HOT_SHARE, True), (2, 4, 0.05, True), (2, 3, 3.0, True), (3, 5, 0.05, True), (3, 5, 3.0, False), (3, 5, 0.05, False)])
def test_against_brute_force(spark, order, shards, hot_share, empties):
    """Whether all, some or no words are split among the shards; with and without texts that are their end alone."""
    rows = [r for r in corpus() if empties or r[1]]
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, block string")
    import zlib

    held = [zlib.crc32(str("" if d is None else d).encode()) % 5 == 1 for d, _ in rows]
    got = lm.lm_scores(docs.repartition(3), fold_bucket(F.col("doc_id"), 5) != 1, order=order, shards=shards, hot_share=hot_share).collect()
    key = lambda r: (str(r[0]), r[1], r[2], round(r[4], 6))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(((d, *b) for (d, _), b in zip(rows, brute(rows, held, order, lm.DISCOUNT))), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], abs_tol=1e-8)
        assert abs(g[5] - w[5]) <= 0.017 * (order - 1) * w[1] + 1e-9


def test_no_training_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = lm.lm_scores(docs, F.lit(False)).first()
    assert (row.train_tokens, row.n_known, row.n_tokens, row.base_score) == (0, 0, 3, 0.0)
    assert lm.lm_scores(docs.where("false"), F.lit(True)).count() == 0


def test_block_with_very_many_words():
    """More distinct words than 21 bits hold: the pairs still come out whole."""
    import numpy as np

    from headwater.llm import ngram_lm as lm

    n = (1 << 21) + 5
    words = np.concatenate([[np.uint64(lm.END)], np.arange(1, n, dtype=np.uint64)])
    codes = np.concatenate([np.arange(1, n), [0]]).astype(np.uint32)
    b = lm.Block(words, codes, np.array([n]), np.array([True]), 2, 4, np.zeros(0, np.uint64))
    assert len(b.grams[2][0]) == n and int(b.counts[2].sum()) == n
    first, second = b.columns(2, b.grams[2][0])
    assert {(int(x), int(y)) for x, y in zip(first[-3:], second[-3:])} <= {(k, k + 1) for k in range(n)} | {(n - 1, 0)}


def test_frequent_words_are_split(spark):
    """The pairs of a word that is a third of all tokens reach every shard, and its count is exact."""
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(f"hot w{rng.randint(0, 400)} v{rng.randint(0, 400)}" for _ in range(40))) for i in range(60)], "doc_id long, text string")
    blocks = lm.token_blocks(docs.repartition(3), "doc_id", "text", F.col("doc_id") % 2 == 0)
    hot, counts = lm.frequent_words(blocks, 0.1)
    assert len(hot) == 1 and counts.tolist() == [60 * 40 // 2]
    sizes = {r.shard: r.n for r in lm.messages(blocks, 2, 4, hot).groupBy("shard").agg(F.sum(F.length("c2")).alias("n")).collect()}
    assert len(sizes) == 4 and max(sizes.values()) < 2 * min(sizes.values())
