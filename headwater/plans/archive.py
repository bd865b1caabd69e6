"""Plans of composed texts and of the page's snapshot; each with its SQL in ``archive_oracles``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from headwater.functions.nfc import nfc
from headwater.operators import run, snapshot, trends
from headwater.plans.ledger import FEEDS, _selected
from headwater.plans.queries import heads
from headwater.sources.tables import table, work_dir

GENERATED = "2024-02-01T00:00:00Z"
#: Columns that the configuration had when the page was built and has no more when it is read.
GONE = ("de", "short")


def nfc_titles(spark, d):
    """Titles whose vowels got an acute accent and a dot below, in the order that is not canonical."""
    return heads(spark, d).select("doc_id", nfc(F.regexp_replace("title", "([aeiou])", "$1̣́")).alias("title"))


def _reread(spark, d):
    """A page built from the run and its trends, written, read again and fitted to the columns that are left."""
    ids = heads(spark, d).select("doc_id", "id")
    items = run.radar_run(heads(spark, d), FEEDS).items.drop("id").join(ids, "doc_id")
    columns = table(spark, d, "documents").select(F.col("lang").alias("id")).distinct().unionByName(spark.createDataFrame([(c,) for c in ("legal", "lists", "shout", "short")], "id string")).select("id", F.upper("id").alias("name"))
    sources = table(spark, d, "documents").select(F.col("source").alias("id")).distinct().select("id", F.upper("id").alias("name"))
    chosen, scored, hits = _selected(spark, d)
    built = snapshot.build(items, columns, sources, trends.trend_rows(chosen, scored), trends.trend_items(chosen, hits), GENERATED)
    path = f"{work_dir(spark)}/page-{uuid.uuid4().hex}"
    snapshot.publish(built, path, least=1)
    return snapshot.reproject(snapshot.read(spark, path), columns.where(~F.col("id").isin(*GONE)))


def snapshot_items(spark, d):
    return snapshot.part(_reread(spark, d), "items").select("column", "rank", "id", "source", "title", "url")


def snapshot_trends(spark, d):
    """Trends of columns that are left, with their items on the page as it was built."""
    t = snapshot.part(_reread(spark, d), "trends")
    return t.select("rank", "term", "score", "column", F.explode("ids").alias("id"))


def snapshot_names(spark, d):
    """Columns that are left, and sources with an item on the page as it was built."""
    told = _reread(spark, d)
    kinds = [snapshot.part(told, name).select(F.lit(name).alias("part"), "id", "name") for name in ("columns", "sources")]
    return kinds[0].unionByName(kinds[1])


ALL = [nfc_titles, snapshot_items, snapshot_trends, snapshot_names]
