"""Two-day abnormal returns are found per bar; the registered test doesn't repeat its gate."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, eventstudy, quality


@pytest.fixture
def tables(spark):
    price = spark.range(60).selectExpr("concat('t', id % 3) as ticker", "date_add(date'2026-01-01', cast(id div 3 as int)) as date", "100D as open", "100 + 9 * sin(id * id) as close").filter("not (ticker = 't1' and day(date) in (5, 6, 9))")
    events = spark.range(500).selectExpr("id as event_id", "concat('t', id % 4) as ticker", "date_add(date'2026-01-01', cast(id * 7 % 23 as int)) as date")
    return events, price, bars.proxy_returns(price).filter("date <> date'2026-01-12'")


def test_returns_per_bar_are_those_per_event(tables):
    events, price, market = tables
    legs = eventstudy.window_returns(events, price, market, 0, 1).groupBy("event_id").agg(F.sum("ar").alias("ar01"), F.count("*").alias("n")).filter("n = 2")
    want = {r.event_id: r.ar01 for r in legs.collect()}
    got = {r.event_id: r.ar01 for r in eventstudy.two_day(*tables).collect()}
    with_rows = {r.event_id: r.ar01 for r in eventstudy.with_two_day(events, price, market, "date").collect()}
    assert 200 < len(want) < 500 and got == pytest.approx(want) and with_rows == got


def test_events_are_not_dealt_by_their_ids(tables):
    for df in (eventstudy.two_day(*tables), eventstudy.with_two_day(*tables, "date")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(event_id" not in plan and "explode" not in plan.lower()


def test_the_gate_is_asked_once(spark):
    rows = spark.createDataFrame([(i, f"title {i}", date(2026, 9, 1 + i % 3), "s", float(i)) for i in range(12)], "seq long, title string, session_date date, source string, ar01 double")
    gate, stat = quality.registered_test(rows, score=lambda c: F.length(c) * 0.1 + F.col("seq"), headlines=10, sessions=3, sources=1)
    plan = gate._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and gate.first().met and gate.first().n_headlines == 12 and stat.first().n == 12
    gate, stat = quality.registered_test(rows)
    assert "Aggregate" not in gate._jdf.queryExecution().executedPlan().toString() and stat is None and len(gate.first().reasons) == 3
