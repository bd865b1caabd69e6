"""How ordered filters work on each other: what each removes, for every order, from one pass over the texts.

A document gets a mask with one bit for each filter that it fails. Documents are counted by (part, mask), in all and
those with a good or a toxic label; that is all that later steps read. The survivors of a set of filters are the
documents whose mask has no bit in common with it, that is, the sum over all subsets of the other bits: the zeta
transform over subsets gives it for every set at once, in one pass a filter over an array of 2 ** filters counts. What a
filter removes at its place of an order is the difference between two neighbouring sets, and so are the labels lost.

A filter may also ask whether a smaller id has the identical text anywhere in the table. Texts are told apart by
SHA-256; each digest's smallest id comes from an aggregation that combines before the shuffle, and rows meet it by
(digest, id), so that a text on a third of all rows is no hot key.

Defined cases: a null text is empty, and identical to an empty one; a null part is the empty text; a null id repeats no
text and makes no other row repeat one; of rows with one id and text none repeats the other, and each counts; an id with
several labels has a label if any of its rows has it, null labels are no label; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

COUNTS = ("n", "good", "toxic")
LETTERS = "ABCDE"
BLANK = r"[\x20\x09-\x0D]+"


def content_failures(text: Column) -> list[Column]:
    """The conditions A to D of a text that is not null: short, repetitive, shouting, holds signs."""
    words = F.array_remove(F.split(text, BLANK), "")
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("kinds")))
    fails = F.transform(sizes, lambda s: F.struct((s["words"] < 200).alias("a"), (100 * s["kinds"].cast("long") < 50 * s["words"].cast("long")).alias("b")))[0]
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [fails["a"], fails["b"], 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", failures=content_failures) -> DataFrame:
    """(part, mask, n, good, toxic): bit i of a mask is failure i; the last bit is a smaller id's identical text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    found = failures(F.col("text"))
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(found)), F.lit(0))
    rows = cut(narrow.select("doc_id", "part", bits.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit-rows")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    # Several label rows of an id are one, so no count is doubled.
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    met = told.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    repeats = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("mask").bitwiseOR(F.when(repeats, 1 << len(found)).otherwise(0))
    of = lambda label: F.sum(F.when(F.col(label), F.col("n")).otherwise(0)).alias(label[3:])
    return met.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), of("is_good"), of("is_toxic"))


def survivors(counts: DataFrame, filters: int) -> DataFrame:
    """(part, alive): alive[s] counts the documents that pass every filter of the set s (bits).

    ``counts`` has each (part, mask) once, so a part lists 2 ** filters entries at most.
    """
    size, full = 1 << filters, (1 << filters) - 1
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS))))
    told = counts.groupBy("part").agg(by_mask.alias("by_mask"))
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS])
    sets = F.sequence(F.lit(0), F.lit(size - 1))
    exact = F.transform(sets, lambda m: F.coalesce(F.try_element_at("by_mask", m), none))

    def one_bit(sums: Column, bit: Column) -> Column:
        """Adds to each set that holds the bit what the set without it has."""
        own, below = lambda m: F.get(sums, m), lambda m: F.get(sums, m.bitwiseXOR(bit))
        both = lambda m: F.struct(*[(own(m)[c] + below(m)[c]).alias(c) for c in COUNTS])
        return F.transform(sets, lambda m: F.when(m.bitwiseAND(bit) != 0, both(m)).otherwise(own(m)))

    within = F.aggregate(F.array(*[F.lit(1 << i) for i in range(filters)]), exact, one_bit)
    sums = told.select("part", within.alias("within"))
    # Passing s is failing within the other bits alone.
    return sums.select("part", F.transform(sets, lambda s: F.get("within", F.lit(full).bitwiseXOR(s))).alias("alive"))


def order_steps(alive: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from differences between neighbouring sets.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (what the
    step's filter removes, summed over all orders).
    """
    k = len(letters)
    full = (1 << k) - 1
    at = lambda s, c="n": F.get("alive", s)[c]
    # A set of s other filters stands before a filter in s! (k - 1 - s)! orders.
    weights = F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)).cast("long") for s in range(k)])
    sets = F.sequence(F.lit(0), F.lit(full))

    def shapley(bit: int) -> Column:
        others = F.filter(sets, lambda s: s.bitwiseAND(F.lit(bit)) == 0)
        return F.aggregate(others, F.lit(0).cast("long"), lambda total, s: total + F.get(weights, F.bit_count(s)) * (at(s) - at(s.bitwiseOR(F.lit(bit)))))

    told = alive.select("part", "alive", F.array(*[shapley(1 << i) for i in range(k)]).alias("shares"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    listed = told.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    place = lambda j: F.position(F.substring(F.col("filter_order"), j, 1), F.lit(letters)) - 1
    bit_of = lambda j: F.get(F.array(*[F.lit(1 << i) for i in range(k)]), place(j))
    before = sum((F.when(F.col("step") > j, bit_of(j)).otherwise(0) for j in range(1, k)), F.lit(0))
    own = F.get(F.array(*[bit_of(j) for j in range(1, k + 1)]), F.col("step") - 1)
    placed = listed.withColumn("before", before).withColumn("own", own).withColumn("after", F.col("before").bitwiseOR(F.col("own")))
    b, a, one = F.col("before"), F.col("after"), F.col("own")
    removed = at(b) - at(a)
    return placed.select(
        "part", "filter_order", "step",
        at(a).alias("kept"), removed.alias("removed"),
        (at(F.lit(0)) - at(one) - removed).alias("redundant"),
        (at(F.lit(full).bitwiseXOR(one)) - at(F.lit(full))).alias("unique_fails"),
        (at(b, "good") - at(a, "good")).alias("good_lost"),
        (at(b, "toxic") - at(a, "toxic")).alias("toxic_lost"),
        F.get("shares", F.round(F.log2(one)).cast("int")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return order_steps(survivors(mask_counts(docs, labels), len(LETTERS)))


#: Walks every order row by row: the first failure of an order removes a document there.
SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT d.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) THEN 'E' ELSE '' END AS failed
  FROM words d LEFT JOIN marks m ON d.doc_id = m.doc_id),
kinds AS (SELECT part, failed, good, toxic, count(*) AS n FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
walked AS (
  SELECT k.*, o.filter_order, coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda i: contains(k.failed, substr(o.filter_order, i, 1)))), 6) AS goes
  FROM kinds k, orders o),
told AS (
  SELECT w.part, s.filter_order, s.step, substr(s.filter_order, s.step, 1) AS letter,
    sum(CASE WHEN goes > s.step THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN goes = s.step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN goes < s.step AND contains(failed, substr(s.filter_order, s.step, 1)) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = substr(s.filter_order, s.step, 1) THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN goes = s.step AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN goes = s.step AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM walked w JOIN steps s ON w.filter_order = s.filter_order GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM told
"""
