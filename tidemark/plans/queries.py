"""Registered queries: every operator of the engine over the driver's tables.

An event stands for a headline: its type for the ticker, ``(value - 50) / (50 + |value - 50|)`` for the
score. Bars are the first and last value of each type and weekday; three weekdays are left out as
holidays so that events roll. Floats are rounded alike here and in the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar, scoring, stats, text
from tidemark.operators import asof, bars, corpus, evaluation, eventstudy, fact, quality, regress, resample
from tidemark.sources import payloads

HOLIDAYS = ("2024-01-10", "2024-01-16", "2024-01-17")
TRIALS, LEAK_TRIALS, RESAMPLES, SEED = 2000, 500, 5000, 0
INDEX = "view"
RULES = [(0, "^purchase event", "Purchase Co", "purchase"), (1, "^view event [0-9]*7$", "Lucky View", None), (2, "^view ", "View Co", "view"), (3, r"^error\b", "Error Co", "error"), (4, "event", "Any Co", "click")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r9(c: Column | str) -> Column:
    """Rounded to 9 places; minus zero is zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 9) + F.lit(0.0)


def headlines(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value") - 50
    return read(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("ticker"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source"),
        F.concat("event_type", F.lit(" event "), F.col("event_id").cast("string")).alias("title"), F.concat(F.lit("l"), (F.col("event_id") % 997).cast("string")).alias("link"),
        F.col("ts").alias("published_at"), (v / (50 + F.abs(v))).alias("compound"), "props", "user_id")


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return calendar.align(headlines(spark, d), utc_ntz=True)


def price_bars(spark: SparkSession, d: str) -> DataFrame:
    ticks = read(spark, d, "events").filter((F.weekday("ts") < 5) & ~F.to_date("ts").isin(*(F.lit(h).cast("date") for h in HOLIDAYS)))
    return bars.from_ticks(ticks, "event_type", "ts", "value")


def priced(spark: SparkSession, d: str) -> DataFrame:
    """Fact rows: aligned events that have a bar, by the session they rolled to."""
    out = fact.priced(aligned(spark, d), price_bars(spark, d)).filter("bar is not null")
    return out.withColumn("aligned_date", F.col("session_date")).withColumn("session_date", F.col("bar.date"))


@query
def q_align(spark, d):
    return aligned(spark, d).select("seq", "ticker", "local_time", "timing", "session_date")


@query
def q_timing_counts(spark, d):
    return aligned(spark, d).groupBy("timing", "session_date").agg(F.count("*").alias("n"))


@query
def q_leak_violations(spark, d):
    return aligned(spark, d).agg(F.count("*").alias("n"), F.count_if(~calendar.leak_free(F.col("local_time"), F.col("session_date"))).alias("violations"))


@query
def q_bars(spark, d):
    return price_bars(spark, d)


@query
def q_bar_neighbours(spark, d):
    return bars.neighbours(price_bars(spark, d)).select("ticker", "date", "idx", r9("ret").alias("ret"), "prev_date", "prev_close", "next_date", r9("next_ret").alias("next_ret"))


@query
def q_compound_return(spark, d):
    b = price_bars(spark, d).filter("close < 3 * open")  # keeps products in range
    return bars.cumulative_returns(b).select("ticker", "date", F.round("cumulative", 6).alias("cumulative"))


@query
def q_compound_return_all(spark, d):
    """All bars; as the logarithm of 1 + cumulative, which rounds alike at any size (null where nothing is left)."""
    return bars.cumulative_returns(price_bars(spark, d)).select("ticker", "date", F.round(F.log(F.col("cumulative") + 1), 6).alias("log_growth"))


@query
def q_bar_on(spark, d):
    keys = aligned(spark, d).select("ticker", F.col("session_date").alias("date")).distinct()
    return bars.bar_on(price_bars(spark, d), keys).select("ticker", "date", "open", "close")


@query
def q_asof_session(spark, d):
    out = asof.forward(aligned(spark, d), price_bars(spark, d))
    return out.select("seq", "ticker", "session_date", F.col("bar.date").alias("bar_date"), F.col("bar.open").alias("open"), F.col("bar.close").alias("close"))


@query
def q_asof_strict(spark, d):
    out = asof.forward(aligned(spark, d), price_bars(spark, d), strict=True)
    return out.select("seq", "ticker", "session_date", F.col("bar.date").alias("bar_date"))


@query
def q_fact(spark, d):
    return priced(spark, d).select("seq", "ticker", "session_date", "rolled", r9("compound").alias("compound"), r9("contemporaneous_return").alias("contemporaneous_return"), r9("lagged_return").alias("lagged_return"), r9("gap_return").alias("gap_return"))


@query
def q_gap(spark, d):
    return priced(spark, d).groupBy("ticker").agg(F.count("gap_return").alias("n"), F.round(F.avg("gap_return"), 6).alias("mean_gap"))


@query
def q_proxy(spark, d):
    return bars.proxy_returns(price_bars(spark, d)).select("date", r9("market").alias("market"))


@query
def q_index(spark, d):
    return bars.index_returns(price_bars(spark, d), INDEX).select("date", r9("market").alias("market"))


def _events(spark, d) -> DataFrame:
    return priced(spark, d).select(F.col("seq").alias("event_id"), "ticker", F.col("session_date").alias("date"), eventstudy.magnitude(F.col("compound")).alias("magnitude"))


def _windows(spark, d) -> DataFrame:
    b = price_bars(spark, d)
    return eventstudy.window_returns(_events(spark, d), b, bars.proxy_returns(b))


@query
def q_abnormal(spark, d):
    return _windows(spark, d).select("event_id", "offset", r9("ar").alias("ar"))


@query
def q_car(spark, d):
    out = _windows(spark, d).join(_events(spark, d).select("event_id", "magnitude"), "event_id")
    return eventstudy.mean_car(out, ["magnitude"]).select("magnitude", "offset", F.round("mean_car", 6).alias("mean_car"), "n")


@query
def q_ar01(spark, d):
    b, e = price_bars(spark, d), _events(spark, d)
    proxy = eventstudy.two_day(e, b, bars.proxy_returns(b)).withColumn("benchmark", F.lit("proxy"))
    index = eventstudy.two_day(e, b, bars.index_returns(b, INDEX)).withColumn("benchmark", F.lit("index"))
    out = proxy.unionByName(index).join(e.select("event_id", "magnitude"), "event_id")
    return out.groupBy("benchmark", "magnitude").agg(F.round(F.avg("ar01"), 6).alias("mean_ar01"), F.count("*").alias("n"))


def _ci(df: DataFrame, value: str) -> DataFrame:
    every = stats.with_ci(df, "compound", value).withColumn("ticker", F.lit("all"))
    return every.unionByName(stats.with_ci(df, "compound", value, ["ticker"])).select("ticker", "n", *(F.round(c, 7).alias(c) for c in ("r", "ci_low", "ci_high")))


@query
def q_corr_ci(spark, d):
    return _ci(priced(spark, d), "contemporaneous_return")


@query
def q_lagged_corr(spark, d):
    return _ci(priced(spark, d), "lagged_return")


@query
def q_gap_corr(spark, d):
    return _ci(priced(spark, d), "gap_return")


@query
def q_demeaned_corr(spark, d):
    return quality.demeaned_r(priced(spark, d)).select(F.round("r", 7).alias("r"), "n")


@query
def q_regress(spark, d):
    out = regress.evaluate(regress.time_split(regress.usable(priced(spark, d))))
    return out.select("n_train", "n_test", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "train_r2", "test_r2", "train_mae", "test_mae", "baseline_test_mae")))


@query
def q_predictions(spark, d):
    out = regress.predictions(regress.time_split(regress.usable(priced(spark, d))))
    return out.select("seq", "split", F.round("predicted_return", 6).alias("predicted_return"))


@query
def q_event_split(spark, d):
    return priced(spark, d).groupBy(eventstudy.magnitude(F.col("compound")).alias("magnitude")).agg(F.count("*").alias("n"), F.round(F.avg("contemporaneous_return"), 7).alias("mean_return"))


@query
def q_bootstrap(spark, d):
    rows = priced(spark, d).withColumn("magnitude", eventstudy.magnitude(F.col("compound")))
    out = resample.bootstrap_difference(rows, "magnitude", "contemporaneous_return", "high", "low", RESAMPLES, SEED)
    return out.select("n_a", "n_b", *(F.round(c, 6).alias(c) for c in ("diff", "ci_low", "ci_high")))


def _returns(spark, d) -> DataFrame:
    a = aligned(spark, d)
    return resample.returns_on(a, a, price_bars(spark, d))


@query
def q_audit(spark, d):
    real, null = resample.audit(aligned(spark, d), _returns(spark, d).select("ticker", "session_date", "ret").filter("ret is not null"), TRIALS, SEED)
    out = resample.summary(null, real)
    return out.select("n_trials", "p_value", *(F.round(c, 7).alias(c) for c in ("real", "null_mean", "null_std")))


@query
def q_audit_null(spark, d):
    _, null = resample.audit(aligned(spark, d), _returns(spark, d).select("ticker", "session_date", "ret").filter("ret is not null"), TRIALS, SEED)
    return null.select("trial", "n", F.round("r", 7).alias("r"))


@query
def q_within_session(spark, d):
    rows = priced(spark, d).withColumnRenamed("contemporaneous_return", "ret")
    real, null = resample.within_group(rows, TRIALS, SEED)
    return resample.summary(null, real).select("n_trials", "p_value", *(F.round(c, 7).alias(c) for c in ("real", "null_mean", "null_std")))


@query
def q_leakage(spark, d):
    rows = aligned(spark, d).withColumn("ticker", F.when(F.col("ticker") != "signup", F.col("ticker")))
    out = resample.leakage(rows, _returns(spark, d), LEAK_TRIALS, SEED)
    return out.select("trial", "n_resolved", "n_lagged", F.round("lagged_r", 7).alias("lagged_r"), F.round("test_r2", 6).alias("test_r2"))


@query
def q_power(spark, d):
    n = spark.createDataFrame([(x,) for x in (23, 42, 50, 100, 250, 500, 1000, 2000)], "n int").select(F.lit("detectable").alias("kind"), F.col("n").cast("double").alias("x"), F.round(stats.least_detectable_r(F.col("n")), 6).alias("y"))
    r = spark.createDataFrame([(x,) for x in (0.05, 0.1, 0.15, 0.2, 0.28, 0.3)], "r double").select(F.lit("needed").alias("kind"), F.col("r").alias("x"), F.round(stats.needed_n(F.col("r")), 3).alias("y"))
    return n.unionByName(r)


@query
def q_percentiles(spark, d):
    low, high = stats.percentile_interval(F.col("contemporaneous_return"))
    rows = priced(spark, d).groupBy("ticker", "session_date").agg(F.first("contemporaneous_return").alias("contemporaneous_return"))
    return rows.groupBy("ticker").agg(r9(low).alias("low"), r9(high).alias("high"))


def _rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id int, pattern string, company string, ticker string")


@query
def q_resolve(spark, d):
    return text.resolve(headlines(spark, d).drop("ticker"), _rules(spark)).select("seq", "company", "ticker", "status")


@query
def q_known(spark, d):
    r = _rules(spark)
    return text.known_tickers(r).select(F.lit("ticker").alias("kind"), F.col("ticker").alias("name")).unionByName(text.known_companies(r).select(F.lit("company").alias("kind"), F.col("company").alias("name")))


@query
def q_outcomes(spark, d):
    h = text.resolve(headlines(spark, d).drop("ticker"), _rules(spark))
    out = fact.priced(calendar.align(h, utc_ntz=True), price_bars(spark, d))
    status = F.when(F.col("status") != "resolved", F.col("status")).when(F.col("bar").isNull(), "price_error").otherwise("ok")
    return fact.outcomes(out.withColumn("status", status))


_TITLES = ("Shares rise 4% today", "Shares rose 4% today", "Stock sees 41% upside", "Acme rallies as much as 8.5 % on results", "X Share Price Highlights: live, Stock Price History", "x share price highlights: stock price history 2% dip", "gains, then falls by 3%", "plain title")


def _titles(spark, d) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("seq") % len(_TITLES)).cast("int") + 1)
    return headlines(spark, d).withColumn("title", pick)


@query
def q_moves(spark, d):
    return _titles(spark, d).select("seq", text.names_price_move(F.col("title")).alias("moves"))


@query
def q_templates(spark, d):
    return _titles(spark, d).groupBy(text.is_liveblog_template(F.col("title")).alias("template")).agg(F.count("*").alias("n"))


def _scraped(spark, d) -> DataFrame:
    h = headlines(spark, d)
    return h.withColumns({
        "scraped_at": F.expr("published_at + make_dt_interval(0, seq % 50 - 1)"), "title": F.concat(F.lit("t"), (F.col("seq") % 1500).cast("string")),
        "published_at": F.when(F.col("seq") % 10 == 0, F.date_trunc("HOUR", "published_at").cast("timestamp_ntz")).otherwise(F.col("published_at"))})


@query
def q_integrity(spark, d):
    return quality.timestamp_integrity(_scraped(spark, d)).groupBy("check").agg(F.count("*").alias("n"), F.min("example").alias("first_example"))


@query
def q_dedupe(spark, d):
    return corpus.dedupe(headlines(spark, d)).select("source", "link", "seq", "title")


@query
def q_merge(spark, d):
    h = headlines(spark, d)
    return corpus.merge(h.filter("seq % 3 = 0"), h.filter("seq % 3 <> 0")).select("source", "link", "seq", "title")


@query
def q_upsert(spark, d):
    b = price_bars(spark, d)
    fresh = b.filter("ticker <> 'click' and date > date'2024-01-12'").withColumns({"open": F.col("open") * 2, "close": F.col("close") + 1})
    return bars.upsert(b.filter("date < date'2024-01-22'"), fresh)


@query
def q_usable(spark, d):
    b = price_bars(spark, d)
    rows = priced(spark, d).withColumn("status", F.lit("ok")).drop("title").join(_titles(spark, d).select("seq", "title"), "seq")
    good, templates = quality.usable(rows, eventstudy.two_day(_events(spark, d), b, bars.proxy_returns(b)))
    return good.agg(F.count("*").alias("n"), F.round(F.avg("ar01"), 7).alias("mean_ar01")).crossJoin(F.broadcast(templates))  # one row each


@query
def q_gate(spark, d):
    out = quality.gate(priced(spark, d), 5000, 30, 3)
    return out.select("met", "n_headlines", "n_sessions", "n_sources", F.concat_ws("; ", "reasons").alias("reasons"))


@query
def q_registered_test(spark, d):
    b = price_bars(spark, d)
    rows = eventstudy.with_two_day(priced(spark, d), b, bars.proxy_returns(b))
    out = stats.with_ci(quality.demeaned(rows, "ar01"), "compound", "demeaned")
    return out.select("n", *(F.round(c, 7).alias(c) for c in ("r", "ci_low", "ci_high")))


@query
def q_contract(spark, d):
    out = corpus.contract(aligned(spark, d), "PURCHASE", score="compound")
    return out.select("ticker", F.round("score_7d", 7).alias("score_7d"), "headline_count_7d", "coverage")


@query
def q_rolling_contracts(spark, d):
    return corpus.rolling_contracts(aligned(spark, d)).select("ticker", "as_of", F.round("score", 7).alias("score"), "n", "coverage")


_LEX = {k: v for k, v in scoring.LEXICON.items()} | {"the": 0.4, "that": -0.3, "of": 0.7, "and": -0.6, "on": 0.2}


def _scored(spark, d) -> DataFrame:
    s = scoring.token_valence(F.col("text"), _LEX)
    return read(spark, d, "documents").select("doc_id", "lang", "n_chars", F.round(s, 6).alias("compound"))


@query
def q_score(spark, d):
    return _scored(spark, d).withColumn("label", scoring.label(F.col("compound"))).drop("n_chars")


@query
def q_score_summary(spark, d):
    return _scored(spark, d).groupBy(scoring.label(F.col("compound")).alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("compound"), 5).alias("mean_compound"))


@query
def q_lexicon_score(spark, d):
    s = scoring.lexicon_score(F.col("text"))
    return read(spark, d, "conversations").select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", "s.neg", "s.neu", "s.pos", "s.compound")


def _judged(spark, d) -> DataFrame:
    rows = _scored(spark, d).join(read(spark, d, "labels"), "doc_id")
    p, q = F.col("compound") + 0.3, 0.4 - F.col("compound")
    return rows.withColumns({
        "predicted": scoring.label(F.col("compound")), "second": scoring.label_of_shares(p, q, F.lit(0.35)),
        "expected_label": F.when(F.col("quality") == 1, "positive").when(F.col("toxic") == 1, "negative").otherwise("neutral")})


@query
def q_eval(spark, d):
    return evaluation.accuracy(_judged(spark, d), category="lang").select(F.coalesce("lang", F.lit("all")).alias("lang"), "n", "correct", r9("accuracy").alias("accuracy"))


@query
def q_eval_comparison(spark, d):
    out = evaluation.compare(_judged(spark, d), "predicted", "second", category="lang")
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), "n", "correct_a", "correct_b", r9("accuracy_a").alias("accuracy_a"), r9("accuracy_b").alias("accuracy_b"))


@query
def q_agreement(spark, d):
    return evaluation.agreement(_judged(spark, d), "predicted", "second").withColumn("rate", r9("rate"))


@query
def q_disagreements(spark, d):
    return evaluation.disagreements(_judged(spark, d), "predicted", "second").select("doc_id", "predicted", "second")


@query
def q_confusion(spark, d):
    return evaluation.confusion(_judged(spark, d), "predicted", "second")


@query
def q_confusion_grid(spark, d):
    return evaluation.confusion_grid(_judged(spark, d), "predicted", "second")


@query
def q_json_articles(spark, d):
    h = headlines(spark, d)
    one = F.struct(
        F.concat(F.lit("http://x/"), F.col("seq").cast("string")).alias("url"), F.concat(F.lit(" "), F.col("title"), F.lit(" ")).alias("title"),
        F.when(F.col("seq") % 7 == 0, "bad").otherwise(F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'")).alias("seendate"),
        F.when(F.col("seq") % 5 > 0, F.col("source")).otherwise("").alias("domain"), F.when(F.col("seq") % 11 == 0, "Hindi").otherwise("English").alias("language"))
    texts = h.select(F.when(F.col("seq") % 13 == 0, F.lit("{}")).otherwise(F.to_json(F.struct(F.array(one).alias("articles")))).alias("body"))
    out = payloads.headlines_of_articles(payloads.articles_of_text(texts, "body"), F.lit(None).cast("timestamp"))
    return out.select("source", "title", "link", F.unix_seconds("published_at").alias("published"))


@query
def q_xml_items(spark, d):
    h = headlines(spark, d)
    body = F.concat(
        F.lit("<rss><channel><title>c</title><item><title>"), "title", F.lit("</title><link>http://x/"), F.col("seq").cast("string"), F.lit("</link><pubDate>"),
        F.when(F.col("seq") % 7 == 0, "soon").otherwise(F.concat(F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.when(F.col("seq") % 2 == 0, " +0530").otherwise(" GMT"))), F.lit("</pubDate></item><item><title>no link</title></item></channel></rss>"))
    items = payloads.items_of_text(h.select(body.alias("body")), "body")
    return payloads.headlines_of_items(items, F.lit("feed"), F.lit(None).cast("timestamp")).select("title", "link", F.unix_seconds("published_at").alias("published"))


@query
def q_chart_bars(spark, d):
    b = price_bars(spark, d)
    day = F.struct(F.unix_seconds(F.col("date").cast("timestamp")).alias("t"), F.when(F.col("open") > 5, F.col("open") / 7).alias("o"), F.col("close").alias("c"))
    got = b.groupBy("ticker").agg(F.sort_array(F.collect_list(day)).alias("b"))  # a ticker's trading days
    chart = F.struct(F.struct(F.array(F.struct(
        F.transform("b", lambda x: x.t).alias("timestamp"), F.struct(F.array(F.struct(F.transform("b", lambda x: x.o).alias("open"), F.transform("b", lambda x: x.c).alias("close"))).alias("quote")).alias("indicators"))).alias("result")).alias("chart"))
    texts = got.select("ticker", F.to_json(chart).alias("body"))
    return payloads.bars_of_chart(texts, "body", F.col("ticker"))


@query
def q_orders_weekly_sessions(spark, d):
    """The calendar over another table: orders by the session after their date."""
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("published_at"))
    return calendar.align(o, utc_ntz=True).groupBy("session_date").agg(F.count("*").alias("n"))
