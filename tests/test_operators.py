"""Joins, event windows, resampling, quality and corpus operators on small tables."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar, stats
from tidemark.operators import asof, bars, corpus, evaluation, eventstudy, fact, quality, regress, resample


def price(spark, rows):
    return spark.createDataFrame([(t, date.fromisoformat(d), float(o), float(c)) for t, d, o, c in rows], "ticker string, date date, open double, close double")


#: Friday, Monday, no Tuesday, Wednesday.
FOUR = [("X", "2026-09-25", 100, 110), ("X", "2026-09-28", 121, 120), ("X", "2026-09-30", 114, 118)]


def events(spark, times, ticker="X"):
    df = spark.createDataFrame([(i, ticker, t, 0.1 * i) for i, t in enumerate(times)], "seq long, ticker string, t string, compound double")
    return calendar.align(df.withColumn("published_at", F.col("t").cast("timestamp_ntz")), utc_ntz=True)


def test_asof_rolls_over_missing_days_and_ends(spark):
    e = spark.createDataFrame([(i, "X", date.fromisoformat(d)) for i, d in enumerate(("2026-09-25", "2026-09-29", "2026-09-30", "2026-10-01", "2026-09-29"))] + [(9, None, None), (10, "Y", date(2026, 9, 25))], "seq long, ticker string, session_date date")
    got = {r.seq: r.bar and r.bar.date.isoformat() for r in asof.forward(e, price(spark, FOUR)).collect()}
    assert got == {0: "2026-09-25", 1: "2026-09-30", 2: "2026-09-30", 3: None, 4: "2026-09-30", 9: None, 10: None}
    strict = {r.seq: r.bar and r.bar.date.isoformat() for r in asof.forward(e, price(spark, FOUR), strict=True).collect()}
    assert strict == {0: "2026-09-28", 1: "2026-09-30", 2: None, 3: None, 4: "2026-09-30", 9: None, 10: None}


def test_gap_interval_is_open_on_both_sides(spark):
    times = ["2026-09-25 10:00:00", "2026-09-25 10:00:01", "2026-09-28 03:29:59", "2026-09-28 03:30:00", "2026-09-28 12:00:00", "2026-09-24 02:00:00"]
    got = {r.seq: r.gap_return for r in fact.priced(events(spark, times), price(spark, FOUR)).collect()}
    assert got[0] is None and got[3] is None and got[5] is None  # at the close; at the auction; before the first bar
    assert got[1] == got[2] == pytest.approx(0.1) and got[4] == pytest.approx(114 / 120 - 1)


def test_returns_of_the_fact(spark):
    got = fact.priced(events(spark, ["2026-09-28 02:00:00"]), price(spark, FOUR)).first()
    assert got.contemporaneous_return == pytest.approx(-1 / 121) and got.lagged_return == pytest.approx(4 / 114) and not got.rolled


def test_outcomes_account_for_every_headline(spark):
    rules = spark.createDataFrame([(0, "^X", "X Co", "X"), (1, "^Y", "Y Co", "Y"), (2, "^Z", "Z Co", None)], "rule_id int, pattern string, company string, ticker string")
    rows = [(i, t, datetime(2026, 9, 28, 2)) for i, t in enumerate(("X up", "Y up", "Z up", "nothing", None))]
    h = spark.createDataFrame(rows, "seq long, title string, published_at timestamp")
    out = fact.build(h, rules, price(spark, FOUR))
    assert {r.seq: r.status for r in out.collect()} == {0: "ok", 1: "price_error", 2: "unresolved", 3: "no_match", 4: "no_match"}
    assert [r.compound is None for r in out.orderBy("seq").collect()] == [False, True, True, True, True]


def test_bars_of_ticks_products_and_upsert(spark):
    ticks = spark.createDataFrame([("a", datetime(2024, 1, 2, h), v) for h, v in ((9, 2.0), (12, 5.0), (15, 3.0))] + [("b", datetime(2024, 1, 2), 0.0)], "k string, ts timestamp, v double")
    assert [tuple(r) for r in bars.from_ticks(ticks, "k", "ts", "v").collect()] == [("a", date(2024, 1, 2), 2.0, 3.0)]
    cum = [r.cumulative for r in bars.cumulative_returns(price(spark, FOUR)).orderBy("date").collect()]
    assert cum == [pytest.approx(0.1), pytest.approx(1.1 * 120 / 121 - 1), pytest.approx(1.1 * 120 / 121 * 118 / 114 - 1)]
    new = price(spark, [("X", "2026-09-28", 1, 2), ("X", "2026-10-01", 3, 4)])
    got = {r.date.isoformat(): r.open for r in bars.upsert(price(spark, FOUR), new).collect()}
    assert got == {"2026-09-25": 100.0, "2026-09-28": 1.0, "2026-09-30": 114.0, "2026-10-01": 3.0}
    assert bars.proxy_returns(price(spark, FOUR + [("^I", "2026-09-25", 1, 9)])).filter("market > 1").count() == 0


def test_event_windows(spark):
    b = price(spark, [("X", f"2026-09-{d:02}", 100, 100 + d) for d in (21, 22, 23, 24, 25)])
    market = b.select("date", F.lit(0.2).alias("market")).filter("date <> date'2026-09-23'")
    e = spark.createDataFrame([(1, "X", date(2026, 9, 22)), (2, "X", date(2026, 9, 26)), (3, "X", date(2026, 9, 24))], "event_id long, ticker string, date date")
    got = {(r.event_id, r.offset): r.ar for r in eventstudy.window_returns(e, b, market, 2, 2).collect()}
    assert got == {(1, -1): pytest.approx(0.01), (1, 0): pytest.approx(0.02), (1, 2): pytest.approx(0.04), (3, -2): pytest.approx(0.02), (3, 0): pytest.approx(0.04), (3, 1): pytest.approx(0.05)}
    two = {r.event_id: r.ar01 for r in eventstudy.two_day(e, b, market).collect()}
    assert two == {3: pytest.approx(0.09)}


def test_time_split_and_fit(spark):
    rows = spark.createDataFrame([(i * 7 + 3, float(i), 2.0 * i + 1) for i in range(23)], "seq long, compound double, lagged_return double")
    split = regress.time_split(rows)
    assert sorted(r.seq for r in split.filter("split = 'train'").collect()) == [i * 7 + 3 for i in range(16)]
    fit = regress.evaluate(split).first()
    assert (fit.n_train, fit.n_test) == (16, 7) and fit.slope == pytest.approx(2) and fit.test_r2 == pytest.approx(1)
    assert regress.predictions(split).filter("abs(predicted_return - lagged_return) > 1e-9").count() == 0
    tiny = regress.evaluate(regress.time_split(rows.limit(2))).first()
    assert (tiny.n_train, tiny.n_test) == (2, 0)


def test_permutations_keep_the_multiset(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(40)], "seq long, g string, v double")
    out = resample.permuted(rows, ["v"], 5, 1)
    for t, got in out.toPandas().groupby("trial"):
        assert sorted(got.v) == [float(i) for i in range(40)] and sorted(got.seq) == list(range(40)) and list(got.sort_values("seq").v) != sorted(got.v)
    inside = resample.permuted(rows, ["v"], 3, 1, within=["g"]).toPandas()
    assert ((inside.v.astype(int) % 2) == (inside.seq % 2)).all() and len(inside) == 120


def test_audit_flags_an_engineered_leak(spark):
    days = [date(2026, 9, d) for d in (21, 22, 23, 24, 25, 28)]
    scores = [-0.5, -0.3, -0.1, 0.1, 0.3, 0.5]
    b = price(spark, [("X", d.isoformat(), 100, 100 * (1 + s)) for d, s in zip(days, scores)])
    rows = spark.createDataFrame([(i, "X", d, s) for i, (d, s) in enumerate(zip(days, scores))], "seq long, ticker string, session_date date, compound double")
    real, null = resample.audit(rows, resample.returns_on(rows, rows, b), 400, 0)
    out = resample.summary(null, real).first()
    assert out.real == pytest.approx(1) and out.p_value < 0.05 and out.n_trials == 400


def test_within_session_and_demeaning_remove_a_day_effect(spark):
    rows = spark.createDataFrame([(0, "d1", 0.1, 1.0), (1, "d1", 0.2, 1.0), (2, "d2", 0.8, 5.0), (3, "d2", 0.9, 5.0)], "seq long, session_date string, compound double, ret double")
    assert quality.demeaned_r(rows, "ret").first().r == 0.0
    real, null = resample.within_group(rows, 20, 0)
    out = resample.summary(null, real).first()
    assert out.p_value == 1.0 and out.null_std == pytest.approx(0)


def test_bootstrap(spark):
    rows = spark.createDataFrame([(i, "high" if i < 10 else "low", float(i)) for i in range(40)], "seq long, g string, v double")
    got = resample.bootstrap_difference(rows, "g", "v", "high", "low", 200, 3).first()
    assert (got.n_a, got.n_b) == (10, 30) and got.diff == 4.5 - 24.5 and got.ci_low < got.diff < got.ci_high


def test_integrity_checks_fire_and_do_not_overfire(spark):
    t = lambda h: datetime(2026, 9, 28, h)
    rows = [("a", "l1", t(5), t(4)), ("b", "l2", t(1), t(9)), ("b2", "l2", t(2), t(9)), ("c", "l3", t(1), t(9)), ("c", "l4", t(2), t(9)), ("d", "l5", t(1), t(9)), ("d", "l5", t(3), t(9)), *(("x", f"m{i}", t(7), t(9)) for i in range(5))]
    h = spark.createDataFrame(rows, "title string, link string, published_at timestamp, scraped_at timestamp")
    got = sorted((r.check, r.example) for r in quality.timestamp_integrity(h).collect())
    assert got == [("batch_stamped", "2026-09-28 07:00:00"), ("link_at_several_times", "l2"), ("link_at_several_times", "l5"), ("published_after_scraped", "l1"), ("title_at_several_times", "d")]
    assert quality.timestamp_integrity(h.limit(0)).count() == 0


def test_gate_and_registered_test(spark):
    rows = spark.createDataFrame([(i, f"title good {i}", date(2026, 9, 1 + i % 3), "s", float(i)) for i in range(12)], "seq long, title string, session_date date, source string, ar01 double")
    gate, stat = quality.registered_test(rows)
    assert stat is None and not gate.first().met and len(gate.first().reasons) == 3
    gate, stat = quality.registered_test(rows, score=lambda c: F.length(c) * 0.1 + F.col("seq"), headlines=10, sessions=3, sources=1)
    assert gate.first().met and gate.first().reasons == [] and stat.first().n == 12
    assert not quality.gate(rows.limit(0)).first().met


def test_dedupe_merge_and_contract(spark):
    h = spark.createDataFrame([("s", "l", 2, "second"), ("s", "l", 1, "first"), ("t", "l", 0, "other")], "source string, link string, seq long, title string")
    assert {(r.source, r.title) for r in corpus.dedupe(h).collect()} == {("s", "first"), ("t", "other")}
    fresh = spark.createDataFrame([("s", "l", 0, "new"), ("u", "m", 1, "more")], h.schema)
    assert {r.title for r in corpus.merge(h, fresh).collect()} == {"first", "other", "more"}
    a = spark.createDataFrame([("x", date(2026, 9, 28), 0.5), ("X", date(2026, 9, 22), 0.1), ("X", date(2026, 9, 21), 9.0), ("Y", date(2026, 9, 28), 1.0)], "ticker string, session_date date, c double")
    got = corpus.contract(a, "x", score="c").first()
    assert (got.score_7d, got.headline_count_7d, got.coverage) == (pytest.approx(0.3), 2, "partial")
    none = corpus.contract(a.limit(0), "x", score="c").first()
    assert none.score_7d is None and none.json == '{"sentiment":{"score_7d":null,"headline_count_7d":0,"model":"lexicon","coverage":"none"}}'
    assert corpus.contract(a, "X", as_of="2026-09-21", score="c").first().headline_count_7d == 1


def test_evaluation(spark):
    rows = spark.createDataFrame([("p", "p", "p", "g"), ("p", "n", "p", "g"), ("n", "n", "u", "j")], "predicted string, second string, expected_label string, category string")
    got = {(r.category, r.overall): (r.n, r.correct, r.accuracy) for r in evaluation.accuracy(rows).collect()}
    assert got == {("g", 0): (2, 2, 1.0), ("j", 0): (1, 0, 0.0), (None, 1): (3, 2, pytest.approx(2 / 3))}
    assert evaluation.agreement(rows, "predicted", "second").first().agreed == 2
    assert {r.label_a: (r.p, r.n) for r in evaluation.confusion_grid(rows, "predicted", "second", ("p", "n")).collect()} == {"p": (1, 1), "n": (0, 1)}


def test_index_benchmark_may_be_missing(spark):
    assert bars.index_returns(price(spark, FOUR), "^I").count() == 0
    assert stats.with_ci(price(spark, FOUR).limit(0), "open", "close").first().n == 0
