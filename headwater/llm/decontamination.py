"""Finds benchmark items in texts: SimHash windows, multi-index Hamming blocks, exact shingle similarity.

A text is lower-cased and cut into runs of letters and digits. For an item of n words the windows are all
runs of n words of a text (the whole text if it is shorter). Window and item are compared by their multisets
of five-word shingles (all words, if the item has fewer): weighted Jaccard, the weight of a shingle being
how often it occurs, of ``similarity`` or more.

1. A cheap filter says where windows can lie: similarity of 0.8 means that 8/9 of a window's shingles are shingles of
   items of that size. Windows with ``ANCHOR`` of that many are fingerprinted, found by one equi-join of shingle
   hashes and their places, so no window that qualifies is lost. Which item a window matches is not asked there.
2. Fingerprints have 128 bits (two hashes a shingle), set where over half the shingles (with repeats) have a one.
   Eight blocks of 16 bits: within ``RADIUS`` = 31 differences some block differs in 3 bits at most. Items are entered
   under each block and its neighbours within 3 bits, windows ask under their blocks: all pairs within the radius
   meet, and of unrelated pairs 8.5 % at most. Similarity 0.8 gives about 19.4 differing bits with a deviation of 4,
   so the radius takes in 99.9 % of pairs at the very threshold, and more above it.
3. Pairs within the radius are compared exactly, on the words themselves.

All of it is DataFrame functions. Items are broadcast if they are few; beyond that the same joins shuffle.
Defined cases: null and empty texts and items match nothing; repeated rows are reported once for each id;
a null id is reported as null; an item with fewer than five words is found as that very sequence; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, cut, reserved

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 31
#: Share of the shingles that a qualifying window must have of items, with which a window is fingerprinted.
ANCHOR = 0.6
#: Bits of a block, and differences within which a block finds its neighbours: 8 * (3 + 1) > RADIUS.
BLOCK_BITS, NEAR = 16, 3
#: Sizes of tables that are broadcast, by rows and, where rows hold arrays, by their entries.
MOST_BROADCAST, MOST_ENTRIES = 300_000, 2_000_000
RESULT = "doc_id long, text_key long, item_id long, similarity double, start_word int, windows long"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingle_hashes(own: Column, width: int) -> Column:
    """Hashes of the shingles of an array of words, in order; none if there are fewer words."""
    last = F.size(own) - width
    one = lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(width)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one)).otherwise(F.array().cast("array<bigint>"))


def fingerprint(hashes: Column, lane: int = 16) -> Column:
    """64 majority bits as a long.

    One pass counts all bits: a long holds 64 / ``lane`` counters, the bits g, g + lane, ... in the g-th long. Adding
    a quarter of a lane's range less half of the size sets the last bit but one of a lane where its count is over half.
    """
    low = sum(1 << b for b in range(0, 64, lane))
    wide = lambda x: F.lit(x - (1 << 64) if x >> 63 else x).cast("bigint")
    zero = F.array(*[wide(0)] * lane)
    one = lambda acc, h: F.array(*[acc[g] + F.shiftrightunsigned(h, g).bitwiseAND(wide(low)) for g in range(lane)])
    add = (F.lit((1 << lane - 2) - 1).cast("bigint") - F.floor(F.size(hashes) / 2)) * wide(low)

    def join(counts: Column) -> Column:
        out = wide(0)
        for g in range(lane):
            top = F.shiftrightunsigned((counts[g] + add).bitwiseAND(wide(low << lane - 2)), lane - 2)
            out = out.bitwiseOR(F.shiftleft(top, g))
        return out

    return F.get(F.transform(F.array(F.aggregate(hashes, zero, one)), join), 0)


def fingerprints(hashes: Column) -> Column:
    """An array of two longs, 128 bits; counters are 32 bits wide where a sequence is very long."""
    again = F.transform(hashes, lambda h: F.xxhash64(h))
    one = lambda x: F.when(F.size(x) < 1 << 14, fingerprint(x)).otherwise(fingerprint(x, 32))
    return F.array(one(hashes), one(again))


def _masks() -> list[int]:
    """Which bits of a block differ in its neighbours."""
    return [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= NEAR]


def _blocks(fp: Column) -> Column:
    """The eight blocks, each its number and its value in one int."""
    value = lambda half, j: F.shiftrightunsigned(fp[half], BLOCK_BITS * j).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
    return F.array(*[value(half, j).bitwiseOR(F.lit(4 * half + j << BLOCK_BITS)) for half in range(2) for j in range(4)])


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def _shingles(own: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(own, i, width), " "))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of shingles; only repeats are counted one by one."""
    times = lambda x, s: F.size(F.filter(x, lambda y: y == s))
    common, plain = F.array_intersect(a, b), (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(common, F.lit(0), lambda acc, s: acc + F.least(times(a, s), times(b, s)))
    shared = F.when(plain, F.size(common)).otherwise(counted)
    return shared / (F.size(a) + F.size(b) - shared)


def _matches(docs: DataFrame, items: DataFrame, width: int, least: float) -> DataFrame:
    """items: (item_id, item_words, n), all with shingles of ``width``."""
    items = cut(items.withColumn("item_hashes", _shingle_hashes(F.col("item_words"), width)), "bench-hashed")
    known = cut(items.select("n", F.explode("item_hashes").alias("h")).distinct(), "bench-shingles")
    hashed = docs.select("doc_id", "text_key", _shingle_hashes(F.col("words"), width).alias("hashes"))
    # The outer forms: from explode() Spark infers a filter, pushes it below the columns that it reads, and so
    # would split a text again for each of its words.
    placed = hashed.select("doc_id", "text_key", F.size("hashes").alias("m"), F.posexplode_outer("hashes").alias("p", "h"))
    hits = placed.join(broadcast_if_small(known, MOST_BROADCAST), "h").select("doc_id", "text_key", "m", "n", "p").distinct()

    # Shingles of the item and of the window, and how many they must share at least.
    c, cw = F.col("n") - width + 1, F.least(F.col("n") - width + 1, F.col("m"))
    need = F.ceil(F.lit(least / (1 + least)) * (c + cw) - 1e-9).cast("int")
    asks = F.greatest(F.lit(1), F.ceil(F.col("need") * ANCHOR)).cast("int")
    hits = cut(hits.withColumns({"cw": cw, "need": need}).where("need <= cw").withColumn("need", asks), "bench-hits")
    starts = _starts(hits)
    asked = starts.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("n", "s")).alias("asked"))
    asked = cut(asked, "bench-asked")
    texts = docs.join(broadcast_if_small(asked, MOST_BROADCAST, F.size("asked"), MOST_ENTRIES), on=[docs["text_key"] == asked["text_key"], docs["doc_id"].eqNullSafe(asked["doc_id"])]).select(docs["doc_id"], docs["text_key"], "words", "asked")
    part = F.transform("asked", lambda w: F.struct(w["n"].alias("n"), w["s"].alias("s"), F.slice(F.col("words"), w["s"] + 1, w["n"]).alias("w")))
    windows = texts.select("doc_id", "text_key", F.explode_outer(part).alias("x")).select("doc_id", "text_key", "x.n", "x.s", F.col("x.w").alias("window"))
    # The same words at the same place come from repeated rows.
    hashed = cut(windows.dropDuplicates(["doc_id", "text_key", "n", "s"]).withColumn("hashes", _shingle_hashes(F.col("window"), width)), "bench-windows")
    marked = cut(hashed.withColumn("fp", fingerprints(F.col("hashes"))).drop("hashes"), "bench-marked")

    entered = cut(items.select("item_id", "n", "item_words", fingerprints(F.col("item_hashes")).alias("item_fp")), "bench-items")
    prints = broadcast_if_small(entered.select("item_id", "item_fp"), MOST_BROADCAST)
    near = meet(marked, entries(entered)).join(prints, "item_id").where(distance(F.col("fp"), F.col("item_fp")) <= RADIUS).select("doc_id", "text_key", "n", "s", "item_id").distinct()
    own = marked.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), F.col("n").alias("_n"), F.col("s").alias("_s"), "window")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")) & (F.col("n") == F.col("_n")) & (F.col("s") == F.col("_s"))
    pairs = near.join(own, same).join(broadcast_if_small(entered.select("item_id", "item_words"), MOST_BROADCAST, F.size("item_words"), MOST_ENTRIES), "item_id")
    shingled = pairs.withColumns({"a": _shingles(F.col("window"), width), "b": _shingles(F.col("item_words"), width)})
    exact = shingled.withColumn("similarity", similarity(F.col("a"), F.col("b")))
    found = exact.where(F.col("similarity") >= least)
    best = found.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct("similarity", (-F.col("s")).alias("s"))).alias("b"), F.count(F.lit(1)).alias("windows"))
    return best.select("doc_id", "text_key", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.s")).cast("int").alias("start_word"), "windows")


def entries(items: DataFrame) -> DataFrame:
    """(n, key, item_id): the eight blocks of each item and their 697 neighbours, a fixed list."""
    masks = F.explode(F.array(*map(F.lit, _masks()))).alias("mask")
    index = items.select("item_id", "n", F.explode(_blocks(F.col("item_fp"))).alias("key")).select("*", masks)
    return index.select("n", F.col("key").bitwiseXOR(F.col("mask")).alias("key"), "item_id")


def meet(windows: DataFrame, index: DataFrame) -> DataFrame:
    """Windows and items of one size with a common block, once for each such block; neither side is broadcast."""
    ask = windows.select("doc_id", "text_key", "n", "s", "fp", F.explode(_blocks(F.col("fp"))).alias("key"))
    return ask.join(index.hint("merge"), ["n", "key"]).drop("key")


def _starts(hits: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, s) of the windows that hold enough hits.

    The first hit of such a window has its ``need``-th hit within ``cw`` places, and at most ``cw - need``
    places lie before it. Hits are numbered along a text; the ``need``-th from one is an equi-join away.
    """
    by = F.expr("row_number() over (partition by doc_id, text_key, n order by p)")
    numbered = cut(hits.withColumn("i", by), "bench-numbered")
    later = numbered.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), F.col("n").alias("_n"), F.col("i").alias("_i"), F.col("p").alias("_p"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")) & (F.col("n") == F.col("_n")) & (F.col("_i") == F.col("i") + F.col("need") - 1)
    dense = numbered.join(later, same).where(F.col("_p") - F.col("p") < F.col("cw"))
    low = F.greatest(F.lit(0), F.col("p") - (F.col("cw") - F.col("need")))
    high = F.least(F.col("p"), F.col("m") - F.col("cw"))
    return dense.where(low <= high).select("doc_id", "text_key", "n", F.explode(F.sequence(low, high)).alias("s")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, item_id, similarity, start_word, windows) of each text and item that match.

    text_key: a hash of the text, which with the id names a row; start_word: the first of the best windows.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), words(text).alias("words"))
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), words(F.col(item_text).cast("string")).alias("item_words")).where("size(item_words) > 0").dropDuplicates(["item_id", "item_words"])
    items = cut(items.withColumn("n", F.size("item_words")), "bench")
    widths = [r.w for r in items.select(F.least("n", F.lit(WIDTH)).alias("w")).distinct().collect()]  # 1 to 5
    out = docs.sparkSession.createDataFrame([], T._parse_datatype_string(RESULT))
    for width in sorted(widths):
        out = out.unionByName(_matches(rows, items.where(F.least("n", F.lit(WIDTH)) == width), width, least))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    bad = cut(contaminated(docs, benchmark, id_col, text_col, **how).select("doc_id", "text_key").distinct(), "bench-found")
    key = reserved(docs, "bench_key")["bench_key"]
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key"))
    rows = docs.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))
    same = rows[id_col].cast("long").eqNullSafe(bad["_bad_id"]) & (rows[key] == bad["_bad_key"])
    return rows.join(broadcast_if_small(bad, MOST_BROADCAST), same, "left_anti").drop(key)
