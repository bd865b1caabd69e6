"""Headlines: construction, ordered filters, routing, first-wins dedup, two-level top-k, run report."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions import text as X
from headwater.operators.first_wins import first_wins
from headwater.sources.tables import file_system, swap_in

#: Dates in the stand-in tables count back from here.
ANCHOR = "2024-02-01 00:00:00"


@dataclass(frozen=True)
class Rules:
    """A rule pack; patterns are ours and tuned to the test tables.

    ``block`` reads title, summary, categories and the words of the url's path. ``offers`` reads title and summary.
    The rules by source have a pattern for the url or the title of that source's headlines.
    """

    max_age_days: int = 10
    block: str = r"(?i)\b(?:idiot|moron|scum|trash)\b"
    noise: str = r"(?:!!|\$\$\$|###|%%%)"
    sponsored: str = r"(?i)all rights reserved"
    exclude_source: tuple[str, ...] = ("src19",)
    offers: str | None = None
    exclude_url: dict[str, str] = field(default_factory=dict)
    exclude_title: dict[str, str] = field(default_factory=dict)
    include_title: dict[str, str] = field(default_factory=lambda: {"src7": r"(?i)\bthe\b"})
    routes: tuple[tuple[str, str], ...] = (("legal", r"(?i)licensed|license"), ("lists", r"\|"), ("shout", r"!!"), ("short", r"^.{1,20}$"))


def headlines(documents: DataFrame) -> DataFrame:
    """documents as headline rows (id, column, source, title, summary, url, date, doc_id)."""
    first = F.regexp_extract("text", r"^[^\n]*", 0)
    rest = F.substring(F.replace(F.regexp_replace("text", r"^[^\n]*\n?", ""), F.lit("\n"), F.lit(" ")), 1, 220)
    ts = F.timestamp_seconds(F.lit(1706745600) - (F.col("doc_id") * 37 % 20000) * 60)
    return documents.select(
        "doc_id",
        X.hash_id(F.col("doc_id").cast("string")).alias("id"),
        F.col("lang").alias("column"),
        "source",
        X.truncate(X.tidy_title(first), 200).alias("title"),
        X.trim_blanks(rest).alias("summary"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), F.col("n_chars").cast("string")).alias("url"),
        F.least(ts, F.lit(ANCHOR).cast("timestamp")).alias("date"),
    )


def reason(h: DataFrame, rules: Rules = Rules()) -> Column:
    """Name of the first filter that a headline fails, or null; the order is part of the meaning."""
    both = F.concat(F.coalesce("title", F.lit("")), F.lit(" \n "), F.coalesce("summary", F.lit("")))
    have = lambda c, kind: F.col(c) if c in h.columns else F.lit(None).cast(kind)
    read = X.rule_text(F.col("title"), F.col("summary"), have("categories", "array<string>"), have("url", "string"))
    found = lambda column, pattern: F.coalesce(F.coalesce(column, F.lit("")).rlike(pattern), F.lit(False))

    def by_source(rules_of: dict[str, str], column: Column, default: bool) -> Column:
        out = F.lit(default)
        for source, pattern in rules_of.items():
            out = F.when(F.col("source") == source, found(column, pattern)).otherwise(out)
        return out

    noise = found(F.col("title"), rules.noise) | found(both, rules.sponsored) | F.coalesce(F.col("source").isin(*rules.exclude_source), F.lit(False))
    if rules.offers:
        noise = noise | found(both, rules.offers)
    noise = noise | by_source(rules.exclude_url, have("url", "string"), False) | by_source(rules.exclude_title, F.col("title"), False)
    return (
        F.when(F.col("date").isNull() | (F.unix_millis("date") == 0), "undated")
        .when(F.col("date") < F.lit(ANCHOR).cast("timestamp") - F.expr(f"interval {rules.max_age_days} days"), "old")
        .when(found(read, rules.block), "blocked")
        .when(noise, "noise")
        .when(~by_source(rules.include_title, F.col("title"), True), "excluded")
    )


def route(h: DataFrame, rules: Rules = Rules()) -> Column:
    return X.first_match(F.col("title"), list(rules.routes), F.col("column"))


def dedup_first_wins(rows: DataFrame, order: str, keys: tuple[str, str]) -> DataFrame:
    """Keeps a row iff neither key was seen on a row kept before it, in the given unique order.

    Only kept rows block others, which dropping duplicates key by key would get wrong. See ``first_wins``.
    """
    kept, _ = first_wins(rows, order, keys)
    if kept is None:
        return rows
    return rows.join(kept.select(F.col("o").alias(order)), order, "left_semi")


def two_level_top(rows: DataFrame, per_source: int = 7, per_column: int = 36, tie: str = "doc_id") -> DataFrame:
    """The newest of each (column, source), then of each column; skipped rows use up no place."""
    order = [F.desc("date"), F.asc(tie)]
    some = rows.withColumn("r1", F.row_number().over(Window.partitionBy("column", "source").orderBy(*order))).where(F.col("r1") <= per_source)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))).where(F.col("rank") <= per_column).drop("r1")


def run_report(rows: DataFrame) -> DataFrame:
    """Per source: rows found, used, and why others were left out. ``rows`` has a column ``reason``."""
    why = lambda r: F.count_if(F.col("reason") == r).alias(r)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("reason").isNull()).alias("used"), why("blocked"), why("noise"), why("old"))


def gated_write(rows: DataFrame, path: str, least: int = 40) -> int:
    """Writes a snapshot only if it has enough rows; else the previous one stays and an error is raised."""
    spark, aside = rows.sparkSession, f"{path}.new-{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    n = spark.read.schema(rows.schema).parquet(aside).count()
    if n < least:
        fs, place = file_system(spark, aside)
        fs.delete(place, True)
        raise ValueError(f"{n} rows, fewer than {least}: the previous snapshot stays")
    swap_in(spark, aside, path)
    return n
