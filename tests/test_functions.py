"""Boundaries of the calendar, the statistics and the text rules."""


import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar, scoring, stats, text
from tidemark.functions.ranks import bucketed_rank

#: UTC instants (local time is 5 h 30 min later), expected timing and session.
BOUNDARIES = [
    ("2026-09-28 03:44:59", "pre_open", "2026-09-28"), ("2026-09-28 03:45:00", "intraday", "2026-09-29"), ("2026-09-28 10:00:00", "intraday", "2026-09-29"),
    ("2026-09-28 10:00:01", "post_close", "2026-09-29"), ("2026-09-28 10:00:00.000001", "post_close", "2026-09-29"), ("2026-09-28 03:44:59.999999", "pre_open", "2026-09-28"),
    ("2026-09-26 06:00:00", "post_close", "2026-09-28"), ("2026-09-25 12:00:00", "post_close", "2026-09-28"), ("2026-09-27 20:00:00", "pre_open", "2026-09-28"), ("2026-09-25 20:00:00", "post_close", "2026-09-28"),
]


@pytest.mark.parametrize("ntz", [True, False])
def test_calendar_boundaries(spark, ntz):
    df = spark.createDataFrame([(i, b[0]) for i, b in enumerate(BOUNDARIES)], "i int, t string")
    df = df.withColumn("published_at", F.col("t").cast("timestamp_ntz" if ntz else "timestamp"))
    got = sorted(calendar.checked(calendar.align(df, utc_ntz=ntz)).collect())
    assert [(r.timing, r.session_date.isoformat()) for r in got] == [b[1:] for b in BOUNDARIES]


def test_local_time_does_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT timestamp'2026-09-28 03:44:59+00:00' AS published_at")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert calendar.align(df).first().timing == "pre_open"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_leak_fails(spark):
    bad = spark.sql("SELECT timestamp_ntz'2026-09-28 09:15:00' AS local_time, date'2026-09-28' AS session_date")
    with pytest.raises(Exception, match="opens before"):
        calendar.checked(bad).collect()


def xy(spark, xs, ys):
    return spark.createDataFrame(list(zip(map(float, xs), map(float, ys))), "x double, y double")


def test_pearson_guards_and_intervals(spark):
    r = lambda xs, ys: stats.with_ci(xy(spark, xs, ys), "x", "y").first()
    assert r([1, 2, 3, 4], [2, 4, 6, 8]).r == pytest.approx(1) and r([1, 2, 3], [3, 2, 1]).r == pytest.approx(-1)
    assert r([0.296] * 61, range(61)).r == 0.0 and r(range(5), [7] * 5).r == 0.0
    assert r([1], [2]).r is None
    few = r([1, 2, 3], [1, 3, 2])
    assert (few.ci_low, few.ci_high) == (-1.0, 1.0)
    many = r([1, 2, 3, 4, 5, 6], [2, 1, 4, 3, 6, 5])
    assert many.ci_low < many.r < many.ci_high


def test_ols_and_r2(spark):
    slope, intercept = stats.ols(F.col("x"), F.col("y"))
    one = xy(spark, [0, 1, 2], [1, 3, 5]).agg(slope.alias("s"), intercept.alias("i")).first()
    assert (one.s, one.i) == (2.0, 1.0)
    flat = xy(spark, [2, 2, 2], [1, 2, 3]).agg(slope.alias("s"), intercept.alias("i")).first()
    assert (flat.s, flat.i) == (0.0, 2.0)
    assert xy(spark, [1, 2], [3, 3]).agg(stats.r_squared(F.col("y"), F.col("x"), F.lit(3.0)).alias("r")).first().r == 0.0


def test_power_table(spark):
    n = spark.createDataFrame([(x,) for x in (23, 42, 50, 100, 250, 500, 1000, 2000)], "n int")
    got = [r.r for r in n.select(F.round(stats.least_detectable_r(F.col("n")), 3).alias("r")).collect()]
    assert got == [0.556, 0.421, 0.387, 0.277, 0.176, 0.125, 0.088, 0.063]
    r = spark.createDataFrame([(x,) for x in (0.05, 0.1, 0.15, 0.2, 0.28, 0.3)], "r double")
    assert [x.n for x in r.select(F.ceil(stats.needed_n(F.col("r"))).alias("n")).collect()] == [3138, 783, 347, 194, 98, 85]
    for bad in ("stats.least_detectable_r(F.lit(3))", "stats.needed_n(F.lit(0.0))", "stats.normal_quantile(F.lit(1.0))"):
        with pytest.raises(Exception, match="must"):
            spark.range(1).select(eval(bad)).collect()


def test_permutation_p_and_percentiles(spark):
    null = spark.createDataFrame([(x,) for x in (0.1, -0.2, 0.3, 0.05, 0.0, 0.15, -0.1)], "v double")
    assert null.agg(stats.permutation_p(F.col("v"), F.lit(0.9)).alias("p")).first().p == pytest.approx(1 / 8)
    assert null.agg(stats.share_at_least(F.col("v"), F.lit(0.1)).alias("p")).first().p == pytest.approx(3 / 7)
    low, high = stats.percentile_interval(F.col("id"))
    got = spark.range(1000).agg(low.alias("a"), high.alias("b")).first()
    assert (got.a, got.b) == (25, 975)


def test_rules_in_order_and_three_outcomes(spark):
    titles = ["Infosys results", "Infosyst", "LTIMindtree Share Price Highlights: x", "Market wrap: Infosys falls", "BSE shares up", "HDFC Bank Q2", "HDFC Bankers", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, title string")
    got = {r.i: (r.ticker, r.status) for r in text.resolve(df, text.default_rules(spark)).collect()}
    assert got == {
        0: ("INFY.NS", "resolved"), 1: (None, "no_match"), 2: (None, "unresolved"), 3: (None, "no_match"), 4: ("BSE.NS", "resolved"), 5: ("HDFCBANK.NS", "resolved"), 6: (None, "no_match"), 7: (None, "no_match")}
    assert text.known_tickers(text.default_rules(spark)).count() == 23


def test_moves_and_templates(spark):
    yes = ["shares rise 4%", "rallies 89%", "FALL 2.5 %", "jumped as much as 8 %", "sank by 3%"]
    no = ["sees 41% upside", "rise in profit", "a rise, then 50% and " + "x" * 50, "surprise 4%", "gain " + "x" * 41 + " 4%"]
    df = spark.createDataFrame([(t,) for t in yes + no[:2] + no[3:]], "t string")
    assert [r.m for r in df.select(text.names_price_move(F.col("t")).alias("m")).collect()] == [True] * 5 + [False] * 4
    assert spark.sql("SELECT 'A share price highlights: x Stock Price History' AS t").select(text.is_liveblog_template(F.col("t")).alias("m")).first().m


def test_lexicon_scores(spark):
    texts = ["good", "very good", "not good", "GOOD news for us", "good!!!", "bad", "", None, "the table", "slightly bad", "good but bad"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, title string")
    got = {r.i: r for r in scoring.score(df).collect()}
    c = {texts[i]: r.compound for i, r in got.items()}
    assert c["good"] == pytest.approx(scoring.LEXICON["good"] / (scoring.LEXICON["good"] ** 2 + 15) ** 0.5, abs=1e-4)
    assert c["very good"] > c["good"] > 0 > c["not good"] and c["good!!!"] > c["good"] and c["slightly bad"] > c["bad"]
    assert c[""] == c[None] == c["the table"] == 0 and got[8].neu == 1.0 and got[0].pos == 1.0
    assert {r.model for r in got.values()} == {"lexicon"} and got[5].label == "negative"


def test_labels_and_scorers(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.049,)], "c double")
    assert [r.l for r in df.select(scoring.label(F.col("c")).alias("l")).collect()] == ["positive", "negative", "neutral"]
    tie = spark.createDataFrame([(0.4, 0.4, 0.2), (0.2, 0.4, 0.4), (0.3, 0.3, 0.4)], "p double, n double, u double")
    assert [r.l for r in tie.select(scoring.label_of_shares(F.col("p"), F.col("n"), F.col("u")).alias("l")).collect()] == ["positive", "negative", "neutral"]
    with pytest.raises(scoring.ScorerUnavailable):
        scoring.scorer("absent")
    fake = scoring.model_score(lambda: lambda texts: [(0.7, 0.1, 0.2) for _ in texts])
    assert df.select(fake(F.col("c").cast("string")).compound.alias("x")).first().x == pytest.approx(0.6)


def test_bucketed_rank_is_a_rank(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as g", "cast(conv(substring(md5(cast(id as string)), 1, 8), 16, 10) as long) as h")
    got = bucketed_rank(df, ["g"], F.col("h"), [F.col("id")], "rank", 16).toPandas()
    want = got.sort_values(["h", "id"]).groupby("g").cumcount()
    assert (got["rank"].loc[want.index] == want).all()
