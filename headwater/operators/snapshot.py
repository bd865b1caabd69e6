"""The page's snapshot as one document: built from tables, embedded in a page, read back, fitted to other columns.

A snapshot holds what the two-level top-k left (columns x rows a column at most), the names of columns and sources, and the
selected trends with those of their items that are on the page, so its size is bounded by the limits of the run.

Defined cases: tables without rows give empty lists; null titles, names and scores stay null; rows with a null column have no
place on a page and go; a page without a snapshot, or with a broken one, reads as no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions import text as X
from headwater.sources.feeds import embedded_snapshot
from headwater.sources.tables import children, cut, file_system, swap_in

_ITEM = "id:string,column:string,rank:bigint,source:string,title:string,url:string,published:bigint"
_TREND = "rank:bigint,term:string,score:double,column:string,ids:array<string>"
SCHEMA = f"generatedAt string, columns array<struct<id:string,name:string>>, sources array<struct<id:string,name:string>>, items array<struct<{_ITEM}>>, trends array<struct<{_TREND}>>"
_FIELDS = {"columns": ("id", "name"), "sources": ("id", "name"), "items": ("id", "column", "rank", "source", "title", "url", "published"), "trends": ("rank", "term", "score", "column", "ids")}


def _listed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """One row: all rows of a bounded table as one sorted array."""
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)]).alias("k")
    each = F.array_sort(F.collect_list(F.struct(key, F.struct(*_FIELDS[name]).alias("v"))))
    return rows.agg(F.transform(each, lambda s: s["v"]).alias(name))


def build(items: DataFrame, columns: DataFrame, sources: DataFrame, trends: DataFrame, trend_items: DataFrame, generated_at: str) -> DataFrame:
    """(snapshot): one row.

    items: (id, column, rank, source, title, url, date) of the two-level top-k; columns, sources: (id, name); trends: (rank, term,
    score, column); trend_items: (rank, term, id). Sources without an item on the page are left out.
    """
    placed = items.where("column is not null").select("id", "column", F.col("rank").cast("long").alias("rank"), "source", "title", "url", F.unix_millis("date").alias("published"))
    placed = cut(placed, "snapshot-items")
    on_page = trend_items.join(F.broadcast(placed.select("id")), "id", "left_semi").groupBy("rank", "term").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    told = trends.join(on_page, ["rank", "term"], "left").select("rank", "term", "score", "column", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    used = sources.join(placed.select(F.col("source").alias("id")).distinct(), "id", "left_semi")
    one = _listed(placed, ["column", "rank", "id"], "items")
    # each list is one row, and so are the products
    for rows, order, name in ((columns, ["id"], "columns"), (used, ["id"], "sources"), (told, ["rank"], "trends")):
        one = one.crossJoin(_listed(rows, order, name))
    return one.select(F.struct(F.lit(generated_at).alias("generatedAt"), "columns", "sources", "items", "trends").alias("snapshot"))


def page(snapshot: Column) -> Column:
    """A page that holds the document and nothing else; no text in it can end its element."""
    return F.concat(F.lit('<!doctype html><script type="application/json" id="page-data">'), X.script_json(snapshot), F.lit("</script>"))


def version(html: Column) -> Column:
    """The time of the snapshot in a page, without parsing the document."""
    return F.nullif(F.regexp_extract(html, r'"generatedAt"\s*:\s*"([^"]+)"', 1), F.lit(""))


def publish(document: DataFrame, path: str, least: int = 40) -> str:
    """Writes the page of a built document aside and swaps it in: "written", or "unchanged" if the page at ``path`` has the same
    version. With fewer than ``least`` items the page stays and an error is raised."""
    spark, aside = document.sparkSession, f"{path}.new-{uuid.uuid4().hex}"
    document.select(page(F.col("snapshot")).alias("value")).coalesce(1).write.text(aside)
    held = spark.read.text(aside, wholetext=True).select(version(F.col("value")).alias("v"), F.size(embedded_snapshot(F.col("value"), SCHEMA)["items"]).alias("n")).first()
    had = spark.read.text(path, wholetext=True).select(version(F.col("value")).alias("v")).first() if children(spark, path) else None
    unchanged = had is not None and had.v == held.v
    if held.n < least or unchanged:
        fs, place = file_system(spark, aside)
        fs.delete(place, True)
        if held.n < least:
            raise ValueError(f"{held.n} items, fewer than {least}: the previous page stays")
        return "unchanged"
    swap_in(spark, aside, path)
    return "written"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(snapshot) of the page at ``path``."""
    found = spark.read.text(path, wholetext=True).select(embedded_snapshot(F.col("value"), SCHEMA).alias("snapshot"))
    return found.where("snapshot.generatedAt is not null")


def reproject(document: DataFrame, columns: DataFrame) -> DataFrame:
    """The document with the columns as they are now: (id, name). Items and trends of columns that are gone go too."""
    now = _listed(columns.select("id", "name"), ["id"], "columns")
    ids = F.transform("columns", lambda c: c["id"])
    stay = lambda part: F.filter(F.col(f"snapshot.{part}"), lambda x: F.array_contains(ids, x["column"])).alias(part)
    # both sides are one row
    return document.crossJoin(now).select(F.struct(F.col("snapshot.generatedAt").alias("generatedAt"), F.col("columns"), F.col("snapshot.sources").alias("sources"), stay("items"), stay("trends")).alias("snapshot"))


def part(document: DataFrame, name: str) -> DataFrame:
    """One of columns, sources, items and trends as a table."""
    return document.select(F.explode(f"snapshot.{name}").alias("x")).select("x.*")
