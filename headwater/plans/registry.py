"""Named plans and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from headwater.plans import queries as plans
from headwater.plans import archive, ledger, newsroom, serving
from headwater.plans.archive_oracles import ARCHIVE
from headwater.plans.ledger_oracles import LEDGER
from headwater.plans.newsroom_oracles import NEWSROOM
from headwater.plans.oracles import ORACLES
from headwater.plans.serving_oracles import SERVING


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in [*plans.ALL, *serving.ALL, *newsroom.ALL, *ledger.ALL, *archive.ALL]}


def oracle_sql() -> dict[str, str]:
    return ORACLES | SERVING | NEWSROOM | LEDGER | ARCHIVE
