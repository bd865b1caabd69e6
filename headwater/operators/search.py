"""Look-ups that are told beforehand where to look: texts by their n-grams, patterns by a word that they need."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.sources.tables import cut

#: Lengths of the grams in an index; needles of that length or shorter are found by one gram.
LENGTHS = (1, 2, 3)
#: So many needles at most are broadcast.
MOST_BROADCAST = 200_000


def grams(text: Column, lengths: tuple[int, ...] = LENGTHS) -> Column:
    """The distinct runs of so many characters; linear in the text."""
    each = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in lengths]
    return F.array_distinct(F.flatten(F.array(*each)))


def postings(rows: DataFrame) -> DataFrame:
    """(part, gram, id) of rows (id, part, text): an inverted index, to be written once and searched often."""
    return rows.where("text is not null").select("part", F.explode(grams(F.col("text"))).alias("gram"), "id")


def search(needles: DataFrame, index: DataFrame, rows: DataFrame) -> DataFrame:
    """(needle_id, id, part): the rows whose text contains a needle (needle_id, part, needle), each once.

    Each different needle is looked up once, by its rarest gram. An id is shuffled once, with the grams that it has of those;
    where it meets its text, the needles of these grams are compared as a whole, and the ids of a needle that is found are
    listed. So no pair is shuffled. A needle with a gram that no text has finds nothing; empty and null needles find nothing
    either.
    """
    size = max(LENGTHS)
    own = F.when(F.length("needle") < size, F.array("needle")).otherwise(grams(F.col("needle"), (size,)))
    asked = needles.where("needle <> '' and part is not null").select("needle_id", "part", "needle").distinct()
    # An id with several needles in a part may find a row by more than one.
    asked = cut(asked.withColumn("again", F.count(F.lit(1)).over(Window.partitionBy("needle_id", "part")) > 1), "needles")
    few = asked.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    each = asked.select("part", "needle").distinct().select("part", "needle", F.size(own).alias("grams"), F.explode(own).alias("gram"))
    counts = index.join(_held(few, each.select("part", "gram").distinct()), ["part", "gram"], "left_semi").groupBy("part", "gram").agg(F.count(F.lit(1)).alias("rows"))
    rarest = each.join(counts, ["part", "gram"]).groupBy("part", "needle").agg(F.min(F.struct("rows", "gram"))["gram"].alias("gram"), F.count(F.lit(1)).alias("known"), F.first("grams").alias("grams"))
    ids = asked.groupBy("part", "needle").agg(F.collect_list(F.struct("needle_id", "again")).alias("ids"))
    chosen = cut(rarest.where("known = grams").join(ids, ["part", "needle"]).select("part", "gram", "needle", "ids"), "rarest")
    met = index.join(_held(few, chosen.select("part", "gram").distinct()), ["part", "gram"]).groupBy("part", "id").agg(F.collect_set("gram").alias("grams"))
    texts = rows.groupBy(F.col("part").alias("_part"), F.col("id").alias("_id")).agg(F.collect_set("text").alias("texts"))
    both = met.join(texts, (F.col("part") == F.col("_part")) & F.col("id").eqNullSafe(F.col("_id"))).select("part", "id", "texts", "grams")
    both = both.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    found = both.select("part", "id", "texts", F.explode("grams").alias("gram")).join(_held(few, chosen), ["part", "gram"])
    found = found.where(F.exists("texts", lambda t: t.contains(F.col("needle")))).select("part", "id", F.explode("ids").alias("n"))
    out = found.select("n.needle_id", "id", "part", "n.again")
    if asked.where("again").isEmpty():
        return out.drop("again")
    return out.where(~F.col("again")).drop("again").unionByName(out.where("again").drop("again").distinct())


def _held(few: bool, some: DataFrame) -> DataFrame:
    """What is made of the needles, for broadcasting if these are few; else the join shuffles."""
    return F.broadcast(some) if few else some


@dataclass(frozen=True)
class Pattern:
    """A named pattern, and words (lower case) of which every text that it matches has one at least."""

    name: str
    needs: tuple[str, ...]
    pattern: str


def words(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def match_patterns(rows: DataFrame, patterns: list[Pattern], id_col: str, text_col: str) -> DataFrame:
    """(id, name): each row with each pattern found in its text.

    Words of texts meet the words that patterns need in an equi-join with the list of patterns, which is as small as the
    rule pack; a pattern runs only on texts that have one of its words. So cost follows the hits, not rows times patterns.
    """
    spark = rows.sparkSession
    listed = spark.createDataFrame([(need, p.name, p.pattern) for p in patterns for need in p.needs], "word string, name string, pattern string")
    told = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    met = told.select("id", "text", F.explode(words(F.col("text"))).alias("word")).join(F.broadcast(listed), "word")
    return met.where(F.regexp_like("text", F.col("pattern"))).select("id", "name").distinct()
