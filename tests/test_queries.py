"""Every engine query against its SQL, and the driver's contract."""

import pytest
from conftest import DATA
from oracle import compare, connect

from tidemark.plans import queries

import __spark_entry__


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_matches_sql(spark, con, name):
    compare(spark, con, DATA, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.count() > 0 and found.columns[0] == "ticker"
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_cuts_and_pruning_reach_the_scan(spark, tmp_path):
    """A point-in-time read of stored bars filters in the scan and reads only what it returns."""
    from tidemark.operators import asof
    from tidemark.plans import views

    views.bars(spark, str(DATA)).write.parquet(str(tmp_path / "bars"))
    held = spark.read.parquet(str(tmp_path / "bars"))
    plan = asof.read_bars(held, "1-URGENT", start="1996-01-01", as_of="1998-07-01")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(ticker,1-URGENT)" in plan and "GreaterThanOrEqual(date,1996-01-01)" in plan


def test_current_rows_need_one_exchange_and_no_sort(spark):
    from tidemark.plans import views
    from tidemark.sources.store import current

    plan = current(views.ingest(spark, str(DATA)), ["ticker", "date"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_every_cited_word_is_checked(spark, tmp_path):
    said = " ".join(f"w{i}" for i in range(20)) + "  w1 "
    spark.createDataFrame([(1, 0, said), (1, 1, None)], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r["turn"]: r["invented"] for r in queries.cited_check(spark, str(tmp_path)).collect()}
    assert found == {0: "|".join(f"w{i}" for i in range(4, 20)), 1: ""}
    compare(spark, connect(DATA), DATA, queries.cited_check, queries.ORACLE_SQL["cited_check"])


@pytest.mark.parametrize("name", ["payload_asof", "payload_asof_known", "cache_lookup"])
def test_every_event_is_asked_for(spark, con, name):
    assert "event_id % 10" not in queries.ORACLE_SQL[name]
    assert compare(spark, con, DATA, queries.QUERIES[name], queries.ORACLE_SQL[name]) > 0.9 * con.execute("SELECT count(*) FROM events").fetchone()[0]


def test_every_customer_asks_for_every_ticker(spark, con):
    found = compare(spark, con, DATA, queries.bars_for_requests, queries.ORACLE_SQL["bars_for_requests"])
    assert found == con.execute("SELECT count(*) FROM customer").fetchone()[0]
