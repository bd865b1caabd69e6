"""Removes lines that many pages of one host share.

For each host, the pages that contain a line are divided by all pages of the host; a line beyond
``ratio`` on ``min_pages`` pages or more is boilerplate of that host and is dropped from its pages.

The share of a line is summed before the shuffle for each task (each page tells a line once). As lines of a
page are finitely many, a host has at most (mean lines of a page / ratio) boilerplate lines whatever its
number of pages, so the list of a host is short, and texts are never regrouped: each row meets its host's
list. The lists are broadcast if they are few; otherwise texts are dealt by host and a salt, so that a host
with most of the rows is spread over many tasks.

Lines are told apart by 128 bits of hashes. Defined cases: a null text stays null and counts as a page; a
null host counts as the host named by the empty text; blank lines (spaces, tabs, carriage returns) are never
boilerplate; each of repeated rows is a page; a text that loses all lines becomes empty, the row stays; an
empty table gives an empty result; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, reserved

RATIO = 0.1
MIN_PAGES = 3
#: Beyond so many hosts with boilerplate the lists are not broadcast.
MOST_BROADCAST = 100_000
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _blank(line: Column) -> Column:
    return F.regexp_replace(line, "[ \t\r]", "") == ""


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, keys): for each host that has any, the keys of its boilerplate lines."""
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    pages = docs.select(host.alias("host"), F.col(text_col).cast("string").alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    kinds = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: ~_blank(x)), _key))
    shares = pages.select("host", F.explode(kinds).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    # A line on fewer pages can't qualify: most lines end here, before any join.
    often = shares.where(F.col("n") >= min_pages).join(totals, "host")
    return often.where(F.col("n").cast("double") / F.col("pages") > ratio).groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, count_cols: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with boilerplate lines removed; ``count_cols`` names added counts (None: no counts)."""
    own = reserved(docs, "bp_host", "bp_keys", "bp_salt", *(count_cols or ()))
    host, keys, salt = own["bp_host"], own["bp_keys"], own["bp_salt"]
    lists = cut(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate").select(F.col("host").alias(host), F.col("keys").alias(keys))
    rows = docs.withColumn(host, F.coalesce(F.col(host_col).cast("string"), F.lit("")))
    if lists.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        met = rows.join(F.broadcast(lists), host, "left")
    else:
        salted = lists.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn(salt, F.abs(F.xxhash64(text_col) % SALTS).cast("int")).join(salted, [host, salt], "left")
    text = F.col(text_col).cast("string")
    lines = _lines(text)
    kept = F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col(keys), _key(x)))
    new = F.when(F.col(keys).isNull() | text.isNull(), text).otherwise(F.array_join(kept, "\n"))
    out = [F.col(f"`{c}`") if c != text_col else new.alias(c) for c in docs.columns]
    if count_cols:
        total = F.coalesce(F.size(lines), F.lit(0))
        total = F.when(text.isNull(), 0).otherwise(total)
        out += [total.cast("long").alias(own[count_cols[0]]), F.when(F.col(keys).isNull() | text.isNull(), 0).otherwise(total - F.size(kept)).cast("long").alias(own[count_cols[1]])]
    return met.select(*out)


SQL = f"""
WITH pages AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT host, count(*) AS pages FROM pages GROUP BY host),
told AS (SELECT host, unnest(list_distinct(lines)) AS line FROM pages),
shares AS (SELECT host, line, count(*) AS n FROM told WHERE regexp_replace(line, '[ \\t\\r]', '', 'g') <> '' GROUP BY host, line),
lists AS (
  SELECT s.host, list(s.line) AS keys FROM shares s JOIN totals t ON s.host = t.host
  WHERE n >= {MIN_PAGES} AND n::DOUBLE / pages > {RATIO} GROUP BY s.host),
met AS (
  SELECT p.doc_id, p.text, p.lines, l.keys,
    list_filter(p.lines, lambda x: NOT list_contains(coalesce(l.keys, []), x)) AS kept
  FROM pages p LEFT JOIN lists l ON p.host = l.host)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
  coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(len(kept), 0))::BIGINT AS n_dropped
FROM met
"""
