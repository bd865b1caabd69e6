import random
import time
import unicodedata

from pyspark.sql import functions as F

from headwater.functions import nfc as N
from headwater.functions import text as X


def test_equal_to_the_standard_library(spark):
    """All characters below U+3000, each alone and before up to three marks, and mixtures of starters that join."""
    rng = random.Random(3)
    marks = list(N._CLASSES)
    common = [m for m in marks if m in N._BY_MARK]
    texts = []
    for code in range(0x3000):
        c = chr(code)
        texts += [c, c + rng.choice(common), c + "".join(rng.choice(common) for _ in range(2)), c + "".join(rng.choice(marks + common * 9) for _ in range(3)), "x" + c + "y"]
    texts += [a + m + b for a, m, b in ((rng.choice("aeoAEOuα"), rng.choice(common), rng.choice(common)) for _ in range(2000))]
    parts = [p[0] for p in N._JOINS] + [p[1] for p in N._JOINS] + [chr(0x1100), chr(0x1161), chr(0x11A8), "가", "각", "a", "́", "\U0001d157", "\U0001d165", "\n"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(5000)]
    texts += [unicodedata.normalize("NFD", c) for c in N._CHARS if unicodedata.normalize("NFD", c) != c]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.nfc(F.col("t")).alias("n")).collect()
    assert [r for r in rows if r.n != unicodedata.normalize("NFC", r.t)] == []


def test_rules_that_the_steps_rely_on():
    firsts, seconds = {p[0] for p in N._JOINS}, {p[1] for p in N._JOINS}
    assert not firsts & seconds
    # no starter becomes one that joins the next starter by taking a mark
    assert not firsts & {whole for pairs in N._BY_MARK.values() for _, whole in pairs}
    assert all(len(d) <= 4 for _, d in N._DECOMPOSED)


def test_long_runs_nulls_and_filters(spark):
    long = "e" + "̣́" * 20_000 + "x" * 200_000
    rows = [(1, None), (2, ""), (3, long), (4, "Promoção")]
    began = time.perf_counter()
    got = {r.k: r for r in spark.createDataFrame(rows, "k int, t string").select("k", N.nfc(F.col("t")).alias("n"), X.collapse(F.col("t")).rlike("Promoção").alias("found")).collect()}
    assert time.perf_counter() - began < 60
    assert got[1].n is None and got[2].n == "" and got[3].n == unicodedata.normalize("NFC", long) and got[4].n == "Promoção" and got[4].found
