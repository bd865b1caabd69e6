"""Resampling a corpus towards a target distribution by importance weights of hashed word runs.

Every run of ``least`` to ``most`` words falls into one of ``buckets`` buckets (crc32 of its UTF-8 bytes, modulo). A
bucket's gain is the logarithm of its smoothed share in the target texts over that in the corpus, in thousandths. A
document's weight is the mean gain of its runs; a weight plus Gumbel noise, which a digest of the id gives, ranks the
documents that have enough words, and the highest are drawn: a draw without replacement, the same in every run.

The plan is Spark SQL alone. Runs are exploded and counted by bucket (``buckets`` rows from each task at most); the gain
table has ``buckets`` rows whatever the corpus, so it is broadcast; gains are summed for each row within the task that
reads it, then one short row a document is shuffled. Ranks come from a range partitioning: rows are sorted within their
partitions, and a row's rank is the number of rows in earlier partitions plus its place in its own.

Defined cases: a null text has no words; texts without words have weight 0; a null id is drawn as the empty text and
ranks after equal scores with an id; repeated rows and ids are documents of their own, rows that agree in
score and id rank by weight, then by number of runs; an empty target or corpus is smoothed like any other;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words once A-Z are lower-cased: ASCII other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: monotonically_increasing_id() has a row's place in its partition in so many low bits.
PLACE_BITS = 33


def words(text: Column) -> Column:
    """The words of a text; none for a null."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(plain, BETWEEN), "")


def runs(tokens: Column, least: int = 1, most: int = 1) -> Column:
    """All runs of ``least`` to ``most`` words, joined by one space."""

    def of(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
        # Not slice(), which copies the whole array each time.
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]))

    found = [tokens if n == 1 else of(n) for n in range(least, most + 1)]
    return found[0] if len(found) == 1 else F.concat(*found)


def bucket(run: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(run.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, text_col: str, least: int = 1, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all runs of a table."""
    tokens = texts.select(words(F.col(text_col)).alias("tokens"))
    return tokens.select(F.explode(runs(F.col("tokens"), least, most)).alias("run")).groupBy(bucket(F.col("run"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets that occur in the corpus; a written table."""
    own = bucket_counts(docs, text_col, least, most, buckets).withColumnRenamed("n", "s")
    wanted = bucket_counts(target, target_col, least, most, buckets).withColumnRenamed("n", "t")
    both = cut(own.join(wanted, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "resample-buckets")
    sums = both.agg(F.sum("s"), F.sum("t")).first()
    total, total_wanted = (float((n or 0) + buckets) for n in sums)
    ratio = ((F.col("t") + 1).cast("double") * F.lit(total)) / ((F.col("s") + 1).cast("double") * F.lit(total_wanted))
    return both.where("s > 0").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) for each row; ``table`` is that of ``gains``."""
    tokens = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("tokens"))
    counted = tokens.withColumn("n_words", F.size("tokens"))  # before the runs are exploded, so that no run carries the words
    listed = counted.select("row", "doc_id", "n_words", F.explode_outer(runs(F.col("tokens"), least, most)).alias("run"))
    met = listed.select("row", "doc_id", "n_words", bucket(F.col("run"), buckets).alias("bucket")).join(F.broadcast(table), "bucket", "left")
    sums = met.groupBy("row", "doc_id", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
    weight = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(gain - pmod(gain, n_features)) div n_features")).cast("long")
    weighed = sums.select("doc_id", "n_words", "n_features", weight.alias("weight"))
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def global_ranks(rows: DataFrame, order: list[Column], out_col: str) -> DataFrame:
    """``rows`` with their place in a total order, from 1. No task sees more than its own range of the order.

    The sorted ranges are written, so that no later recomputation can draw their bounds elsewhere; how many rows each
    has is a table of one row a partition.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(sorted_.withColumn(out_col, F.monotonically_increasing_id()), "resample-sorted")
    part = F.shiftright(out_col, PLACE_BITS)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # one row a partition
    starts = counts.select(F.col("part").alias("_part"), before.alias("_before"))
    place = F.col(out_col).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.join(F.broadcast(starts), part == F.col("_part")).select(*rows.columns, (F.col("_before") + place + 1).alias(out_col))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS, seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row; rank is null for what is not drawn.

    Of N rows with ``least_words`` words or more, floor(percent * N / 100) are drawn.
    """
    table = gains(docs, target, text_col, target_col, least, most, buckets)
    rows = cut(scored(docs, table, id_col, text_col, least, most, buckets, seed), "resample-scores")
    fit = F.col("n_words") >= least_words
    drawn = percent * rows.where(fit).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    out = ["doc_id", "n_features", "weight", "score"]
    ranked = global_ranks(rows.where(fit).select(*out), order, "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(rows.where(~fit).select(*out, F.lit(None).cast("long").alias("rank")))


#: crc32 from its polynomial: a table of 256 rows, then a fold over the bytes of each distinct word.
SQL = rf"""
WITH RECURSIVE
shifted AS (
  SELECT range::BIGINT AS i, range::BIGINT AS v, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM shifted WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM shifted WHERE k = 8),
told AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
doc_words AS (SELECT r, unnest(w) AS word FROM docs),
kinds AS (SELECT DISTINCT word FROM (SELECT word FROM doc_words UNION ALL SELECT word FROM told)),
bytes AS (SELECT word, hex(encode(word)) AS h FROM kinds),
coded AS (
  SELECT word, xor(list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket
  FROM bytes, crc),
s AS (SELECT bucket, count(*) AS s FROM doc_words JOIN coded USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM told JOIN coded USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS total_s, (SELECT coalesce(sum(t), 0) FROM t) AS total_t),
gain AS (
  SELECT s.bucket, floor(1000 * ln(((coalesce(t.t, 0) + 1)::DOUBLE * (total_s + {BUCKETS})::DOUBLE) / ((s.s + 1)::DOUBLE * (total_t + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
sums AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS gain FROM doc_words JOIN coded USING (word) JOIN gain USING (bucket) GROUP BY r),
weighed AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (gain - ((gain % n) + n) % n) // n END::BIGINT AS weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h
  FROM docs d LEFT JOIN sums USING (r)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM weighed),
fit AS (SELECT count(*) AS n FROM scored WHERE n_features >= {LEAST_WORDS}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features DESC) AS place FROM scored)
SELECT doc_id, n_features, weight, score::BIGINT AS score,
  CASE WHEN n_features >= {LEAST_WORDS} AND place <= {PERCENT} * fit.n // 100 THEN place END::BIGINT AS rank
FROM ranked, fit
"""
