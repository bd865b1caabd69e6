import random
import re
from collections import Counter

from pyspark.sql import functions as F

from headwater.llm import decontamination as dc

WORDS = [a + b for a in "ba ce di fo gu ka le mi no pu".split() for b in "ra se ti vo zu".split()]


def tokens(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def grams(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1)))


def brute(docs, items, least=0.8):
    out = {}
    for d, t in docs:
        w = tokens(t)
        for i, x in items:
            y = tokens(x)
            k = min(5, len(y))
            if not y or len(w) < k:
                continue
            want = grams(y, k)
            for s in range(max(len(w) - len(y) + 1, 1)):
                have = grams(w[s : s + len(y)], k)
                sim = sum((want & have).values()) / sum((want | have).values())
                if sim >= least:
                    old = out.get((d, i), (0, 0, 0))
                    best = max((old[0], -old[1]), (sim, -s)) if old[2] else (sim, -s)
                    out[d, i] = (best[0], -best[1], old[2] + 1)
    return {k: (round(v[0], 9), v[1], v[2]) for k, v in out.items()}


def fixture():
    rng = random.Random(9)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([12, 20, 20, 45])))) for i in range(12)]
    items += [(20, "Tiny one"), (21, None), (22, ""), (23, "Ra, ra! RA ra ra ra ra"), (24, "né à la fin du jour")]
    docs = [(1, None), (2, ""), (3, "tiny ONE here and tiny one"), (4, "ra " * 400), (5, "Né À la fin du jour né"), (6, "tiny")]
    for k in range(90):
        item = rng.choice(items[:12])[1].split()
        for _ in range(rng.randint(0, 3)):
            at = rng.choice([0, 1, len(item) - 1, rng.randrange(len(item))])
            kind = rng.random()
            if kind < 0.4:
                item[at] = "zzz"
            elif kind < 0.7 and len(item) > 2:
                del item[at]
            else:
                item.insert(at, "yyy")
        docs.append((10 + k, " ".join(say(rng.randint(0, 30)) + item + say(rng.randint(0, 30)))))
    docs += [(150, items[0][1]), (151, " ".join(items[1][1].split()[:-1])), (None, items[2][1]), (152, " ".join(say(9000) + items[3][1].split() + say(50)))]
    return docs, items


def check(spark):
    docs, items = fixture()
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs] + [(150, items[0][1], 2)], "doc_id long, text string, n int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items] + [(0, items[0][1], 3)], "item_id long, text string, p int")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word, r.windows) for r in dc.contaminated(frame, bench).collect()}
    want = brute(docs, items)
    assert got == want
    assert len(want) > 40
    kept = dc.decontaminate(frame, bench)
    assert kept.columns == frame.columns
    bad = {d for d, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in bad)


def test_brute_force(spark):
    check(spark)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(dc, "MOST_BROADCAST", 0)
    check(spark)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    assert dc.contaminated(none, bench).count() == 0
    assert dc.contaminated(some, bench.where("false")).count() == 0
    assert dc.decontaminate(some, bench.where("false")).count() == 1


def test_no_python_in_plan(spark):
    some = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    plan = dc.contaminated(some, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_fingerprint_is_the_majority_of_bits(spark):
    rng = random.Random(4)
    rows = [(k, [rng.getrandbits(64) - (1 << 63) for _ in range(n)]) for k, n in enumerate((0, 1, 2, 3, 40, 255, 256, 700))]
    frame = spark.createDataFrame(rows, "k int, h array<bigint>")
    for lane in (16, 32):
        for r in frame.select("k", dc.fingerprint(F.col("h"), lane).alias("fp")).collect():
            h = rows[r.k][1]
            want = sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))
            assert r.fp % (1 << 64) == want


def test_blocks_find_the_radius_and_little_else(spark):
    """Every fingerprint within the radius is met; of unrelated ones under a tenth."""
    rng = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [rng.getrandbits(128) for _ in range(40)]
    windows = []
    for x in items:
        for flips in (0, 10, 20, dc.RADIUS, dc.RADIUS):
            windows.append(x ^ sum(1 << b for b in rng.sample(range(128), flips)))
    halves = lambda x: [signed(x & (1 << 64) - 1), signed(x >> 64)]
    asked = spark.createDataFrame([(i, 0, 7, 0, halves(x)) for i, x in enumerate(windows)], "doc_id long, text_key long, n int, s int, fp array<bigint>")
    entered = spark.createDataFrame([(i, 7, halves(x)) for i, x in enumerate(items)], "item_id long, n int, item_fp array<bigint>")
    met = {(r.doc_id, r.item_id) for r in dc.meet(asked, dc.entries(entered)).select("doc_id", "item_id").distinct().collect()}
    near = {(i, j) for i, x in enumerate(windows) for j, y in enumerate(items) if (x ^ y).bit_count() <= dc.RADIUS}
    assert near <= met and len(near) >= 200
    assert len(met - near) < 0.1 * len(windows) * len(items)
