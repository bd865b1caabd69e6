"""Every plan against its DuckDB SQL, and shapes of plans that matter at scale."""

import glob
import os

import duckdb
import pytest

from headwater.plans import queries as plans
from headwater.plans import archive, ledger, newsroom, serving
from headwater.plans.archive_oracles import ARCHIVE
from headwater.plans.ledger_oracles import LEDGER
from headwater.plans.newsroom_oracles import NEWSROOM
from headwater.plans.oracles import ORACLES
from headwater.plans.serving_oracles import SERVING

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("plan", [*plans.ALL, *serving.ALL, *newsroom.ALL, *ledger.ALL, *archive.ALL], ids=lambda p: p.__name__)
def test_same_rows_as_sql(spark, con, plan):
    df = plan(spark, SF)
    want = con.sql((ORACLES | SERVING | NEWSROOM | LEDGER | ARCHIVE)[plan.__name__])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    got_rows = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=str)
    want_rows = sorted((tuple(rounded(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=str)
    assert got_rows == want_rows


def test_top_k_limits_before_it_shuffles(spark):
    plan = plans.topk_two_level(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_columns_are_pruned(spark):
    plan = plans.anti_pending(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "html" not in plan
