"""Every registered query next to its DuckDB counterpart, on the smallest test tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from mediagraph.plans import catalog
from tools.check import TABLES, frame

FOLDER = Path("/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    got = QUERIES[name](spark, str(FOLDER)).toPandas()
    if name not in ORACLES:
        assert len(got.columns) and len(got)
        return
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert frame(got).equals(frame(want))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries()) and len(QUERIES) > 100
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 50


@pytest.mark.parametrize("name", ["mention_all_names", "article_names_text", "tags_retag_all"])
def test_mentions_are_dealt_over_as_many_tasks_as_their_rows_need(spark, monkeypatch, name):
    from mediagraph import session

    monkeypatch.setattr(session, "ROWS_PER_TASK", 200)
    tasks = -(-spark.read.parquet(str(FOLDER / "lineitem.parquet")).count() // 200)
    plan = QUERIES[name](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(article_id" in line and f", {tasks}), REPARTITION_BY_NUM" in line]
    assert len(dealt) >= 2
