"""The pipeline against the stages done by hand, on a small table with planted cases."""

import random

import pytest

import corpus_pipeline as cp
from headwater.llm import registry

from .test_decontamination import brute as leaks
from .test_line_dedup import brute as lines
from .test_simhash import slow_classes

COMMON = "river stone house walks under bright morning field tree road cloud water paper lamp coat".split()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(COMMON) + rng.choice("abcdefgh") for _ in range(n))
    items = [(i, say(30)) for i in range(5)]
    rows, labels = [], []
    for i in range(240):
        text = "\n".join([say(rng.randint(20, 60)) for _ in range(3)])
        if i % 4 == 0:
            words = text.split(" ")
            for _ in range(6):
                words[rng.randrange(len(words))] = rng.choice(["vile", "rotten", "awful"])
            text = " ".join(words)
        labels.append((i, 1, int(i % 4 == 0)))
        if i % 4 == 1:
            text = "Shared menu line\n" + text
        if i % 20 == 3:
            text += "\n" + items[i % 5][1]
        if i % 20 == 7 and rows:
            text = rows[-5][1]
        rows.append((i, text, "en" if i % 2 else "fr", f"s{i % 2}", len(text)))
    rows += [(500, None, "en", "s0", 0), (501, "", None, None, 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_each_stage_by_hand(spark, sf):
    path, rows, items = sf
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = cp.STAGES[0][1](spark, docs, path)
    assert kept.columns == columns
    clean = {r.doc_id for r in kept.collect()}
    assert 501 in clean
    toxic = {r[0] for r in rows if r[0] % 4 == 0 and r[0] < 500}
    assert len(clean & toxic) <= 2 and all(r[0] in clean for r in rows if r[0] < 500 and r[0] % 4)

    second = cp.STAGES[1][1](spark, kept, path)
    want = {d: t for d, t, *_ in lines([(r.doc_id, r.text, r.source, 0) for r in kept.collect()])}
    assert {r.doc_id: r.text for r in second.collect()} == want
    assert all(r.n_chars == len(r.text) for r in second.collect() if r.text is not None)

    third = cp.STAGES[2][1](spark, second, path)
    heads = {c for _, _, c in slow_classes(list(want.items()))}
    assert {r.doc_id for r in third.collect()} == heads and third.columns == columns

    fourth = cp.STAGES[3][1](spark, third, path)
    bad = {d for d, _ in leaks([(r.doc_id, r.text) for r in third.collect()], items)}
    assert {r.doc_id for r in fourth.collect()} == heads - bad and bad

    last = cp.STAGES[4][1](spark, fourth, path)
    assert {r.doc_id for r in last.collect()} == heads - bad
    assert last.columns == [*columns, "tokens", "domain", "posterior", "rate", "residual"]

    whole = cp.run(spark, path)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(heads - bad)


def test_registered(spark):
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert len(cp.STAGES) == 5
