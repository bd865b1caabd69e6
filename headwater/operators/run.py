"""One run from headlines to the page: filter, route, dedup, two-level top-k, with a report counted on the way.

Each stage is written once, and the counters of the report are observed on those writes: no table is read again to
count it. Counters are kept for the feeds that the configuration names (as many as it has) and for all others together.

Defined cases: a null source and sources that are not named count as ``other``; headlines without a url are told apart by a null url,
which is one value; a run without rows reports zeros for each feed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from headwater.functions import text as X
from headwater.operators import curate
from headwater.sources.tables import cut

REASONS = ("undated", "old", "blocked", "noise", "excluded")
REPORT = "source string, found long, undated long, old long, blocked long, noise long, excluded long, duplicated long, limited long, used long"


@dataclass
class Run:
    items: DataFrame
    report: DataFrame


def _counted(rows: DataFrame, feeds: list[str], kinds: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``rows`` with counters (feed number, kind) that are there once the rows were written."""
    seen = Observation()
    known = F.coalesce(F.col("source").isin(*feeds), F.lit(False)) if feeds else F.lit(False)
    each = [(i, F.col("source") == feed) for i, feed in enumerate(feeds)] + [(len(feeds), ~known)]
    counters = [F.count_if(of & kind).alias(f"{i}_{name}") for i, of in each for name, kind in kinds.items()]
    return rows.observe(seen, *counters), seen


def radar_run(headlines: DataFrame, feeds: list[str], rules: curate.Rules = curate.Rules(), order: str = "doc_id", per_source: int = 7, per_column: int = 36) -> Run:
    """headlines: (order, column, source, title, summary, url, date, ...); items get id (of the clean url), column (routed), rank."""
    clean = headlines.withColumn("url", X.clean_url(F.col("url")))
    told = clean.withColumn("reason", curate.reason(clean, rules)).withColumn("column", curate.route(clean, rules)).withColumn("id", X.hash_id(F.col("url")))
    why = {r: F.coalesce(F.col("reason") == r, F.lit(False)) for r in REASONS}
    watched, filtered = _counted(told, feeds, {"found": F.lit(True)} | why | {"accepted": F.col("reason").isNull()})
    accepted = cut(watched.where("reason is null").drop("reason").withColumn("norm", X.normalize_title(F.col("title"))), "run-accepted")
    unique, deduped = _counted(curate.dedup_first_wins(accepted, order, ("url", "norm")), feeds, {"unique": F.lit(True)})
    unique = cut(unique.drop("norm"), "run-unique")
    top, ranked = _counted(curate.two_level_top(unique, per_source, per_column, order), feeds, {"used": F.lit(True)})
    items = cut(top, "run-items")
    n = filtered.get | deduped.get | ranked.get
    rows = []
    for i, feed in enumerate([*feeds, "other"]):
        of = lambda name, i=i: n[f"{i}_{name}"]
        rows.append((feed, of("found"), *map(of, REASONS), of("accepted") - of("unique"), of("unique") - of("used"), of("used")))
    return Run(items, headlines.sparkSession.createDataFrame(rows, REPORT))
