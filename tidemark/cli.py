"""Command line: ``python -m tidemark.cli <command> ...``. Each command reads files, builds one plan, prints or writes its result."""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar, scoring, stats, text
from tidemark.operators import bars, corpus, evaluation, eventstudy, fact, quality, regress, resample
from tidemark.session import session
from tidemark.sources import ingest, payloads, readers, sinks

NOTE = "Descriptive statistics of past data; no advice."


def _scorer(spark: SparkSession, a: argparse.Namespace, name: str = "lexicon"):
    lexicon = scoring.load_lexicon(spark, a.lexicon) if getattr(a, "lexicon", None) else None
    return scoring.scorer(name, lexicon, getattr(a, "model_path", None))


def _fact(spark: SparkSession, a: argparse.Namespace, model: str = "lexicon") -> DataFrame:
    rules = readers.rules(spark, a.rules) if a.rules else text.default_rules(spark)
    score = _scorer(spark, a, model)
    return fact.build(readers.headlines(spark, a.input), rules, readers.bars(spark, a.prices_dir), lambda t: score(t).compound)


def _rows(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    out = _fact(spark, a).cache()
    fact.outcomes(out).show()
    return fact.rows(out)


def align(spark, a):
    out = calendar.checked(calendar.align(readers.headlines(spark, a.input)))
    out.groupBy("timing").agg(F.count("*").alias("n")).show()
    print("sessions:", out.agg(F.count_distinct("session_date")).first()[0])
    sinks.aligned(out, a.out)


def score(spark, a):
    s = _scorer(spark, a, a.model)
    out = readers.headlines(spark, a.input).withColumn("_s", s(F.col("title"))).select("*", "_s.*").drop("_s")
    out = out.withColumns({"label": scoring.label(F.col("compound")), "model": F.lit(a.model)}).cache()
    out.groupBy("label").agg(F.count("*").alias("n"), F.avg("compound").alias("mean_compound")).show()
    sinks.scored(out, a.out)


def _share(x: float | None) -> str:
    return "-" if x is None else f"{x:.1%}"


def evaluate(spark, a):
    s = _scorer(spark, a, a.model)
    rows = readers.evaluation_set(spark, a.eval_set).withColumn("compound", s(F.col("text")).compound).withColumn("predicted", scoring.label(F.col("compound"))).cache()
    for r in evaluation.accuracy(rows).orderBy(F.desc("overall"), "category").collect():  # a row per category
        print(f"{'all' if r.overall else r.category}: {r.correct} of {r.n} right, {_share(r.accuracy)}")
    wrong = rows.filter("predicted <> expected_label")
    print("wrong:", wrong.count())
    for r in wrong.orderBy("id").toLocalIterator():
        print(f"  {r.id} ({r.category}) {r.text!r}: {r.predicted} ({r.compound:+.4f}) instead of {r.expected_label}{'; ' + r.note if r.note else ''}")
    sinks.csv(rows, a.out)


def agreement(spark, a):
    if a.model == a.second:
        raise SystemExit("agreement needs two different scorers")
    one, two = _scorer(spark, a, a.model), _scorer(spark, a, a.second)
    pair = lambda df, c: df.withColumns({"compound_a": one(F.col(c)).compound, "compound_b": two(F.col(c)).compound}).withColumns({"a": scoring.label(F.col("compound_a")), "b": scoring.label(F.col("compound_b"))})
    rows = pair(readers.headlines(spark, a.headlines), "title").cache()
    same = evaluation.agreement(rows, "a", "b").first()
    print(f"{a.model} and {a.second}: {same.agreed} of {same.n} labels alike, {_share(same.rate)}")
    evaluation.confusion_grid(rows, "a", "b").show()
    for r in evaluation.disagreements(rows, "a", "b").orderBy("seq").toLocalIterator():
        print(f"  {r.title!r}: {r.a} ({r.compound_a:+.3f}), {r.b} ({r.compound_b:+.3f})")
    judged = pair(readers.evaluation_set(spark, a.eval_set), "text").cache()
    for r in evaluation.compare(judged, "a", "b").orderBy(F.desc("overall"), "category").collect():  # a row per category
        print(f"{'all' if r.overall else r.category}: n {r.n}, {a.model} {_share(r.accuracy_a)}, {a.second} {_share(r.accuracy_b)}")
    for r in evaluation.disagreements(judged, "a", "b").orderBy("id").toLocalIterator():
        print(f"  {r.id} ({r.category}) {r.text!r}: {r.a}, {r.b}; expected {r.expected_label}")
    sinks.csv(rows, a.out)


def correlate(spark, a):
    rows = _rows(spark, a)
    for value in ("contemporaneous_return", "lagged_return", "gap_return"):
        print(value)
        stats.with_ci(rows, "compound", value).show()
    resample.bootstrap_difference(rows.withColumn("g", eventstudy.magnitude(F.col("compound"), a.event_threshold)), "g", "contemporaneous_return", "high", "low").show()
    sinks.fact(rows, a.out)


def regression(spark, a):
    split = regress.time_split(regress.usable(_rows(spark, a)), a.train_frac)
    result = regress.evaluate(split)
    found = result.first()
    if found is None or found.n_train < regress.MIN_TRAIN or found.n_test < regress.MIN_TEST:
        raise SystemExit("too few rows to split")
    result.show()
    sinks.regression(regress.predictions(split), a.out)


def overlay(spark, a):
    rows, price = _rows(spark, a), readers.bars(spark, a.prices_dir)
    events = rows.select(F.col("seq").alias("event_id"), "ticker", F.col("session_date").alias("date"), eventstudy.magnitude(F.col("compound"), a.event_threshold).alias("magnitude"))
    proxy = bars.proxy_returns(price)
    legs = eventstudy.window_returns(events, price, proxy, a.window_before, a.window_after).join(events.select("event_id", "magnitude"), "event_id")
    car = eventstudy.mean_car(legs, ["magnitude"])
    car.orderBy("magnitude", "offset").show(50)
    for name, market in (("proxy", proxy), ("index", bars.index_returns(price, a.index))):
        out = eventstudy.two_day(events, price, market).join(events.select("event_id", "magnitude"), "event_id")
        out.groupBy("magnitude").agg(F.lit(name).alias("benchmark"), F.avg("ar01").alias("mean_ar01"), F.count("*").alias("n")).show()
    sinks.csv(car, f"{a.out_dir}/car")
    high = events.filter("magnitude = 'high'").select("ticker").distinct()
    sinks.csv(bars.cumulative_returns(price).join(high, "ticker", "left_semi"), f"{a.out_dir}/overlay")


def audit(spark, a):
    rows, price = _rows(spark, a).cache(), readers.bars(spark, a.prices_dir)
    own = rows.withColumn("session_date", F.col("aligned_date"))
    returns = resample.returns_on(own, own, price).filter("ret is not null")
    real, null = resample.audit(own, returns, a.n_perm, a.seed)
    out = resample.summary(null, real)
    out.show()
    return int(out.first().p_value < 0.05)


def leakage(spark, a):
    rows, price = _fact(spark, a).cache(), readers.bars(spark, a.prices_dir)
    own = rows.select("seq", F.when(F.col("status") == "ok", F.col("ticker")).alias("ticker"), F.col("aligned_date").alias("session_date"), "compound")
    returns = resample.returns_on(own.filter("ticker is not null"), own, price)
    out = resample.leakage(own, returns, a.trials, a.seed, a.train_frac).cache()
    for value in ("lagged_r", "test_r2"):
        print(value)
        resample.summary(out.filter("trial > 0"), out.filter("trial = 0"), value).show()


def robustness(spark, a):
    rows = _rows(spark, a).cache()
    quality.timestamp_integrity(readers.headlines(spark, a.input)).show(50, False)
    real, null = resample.within_group(rows.withColumnRenamed("contemporaneous_return", "ret"), a.n_perm, a.seed)
    resample.summary(null, real).show()
    quality.demeaned_r(rows).show()
    stats.with_ci(rows.filter(~text.names_price_move(F.col("title"))), "compound", "contemporaneous_return").show()


def prereg(spark, a):
    rows, price = _fact(spark, a), readers.bars(spark, a.prices_dir)
    events = fact.rows(rows).select(F.col("seq").alias("event_id"), "ticker", F.col("session_date").alias("date"))
    usable, templates = quality.usable(rows, eventstudy.two_day(events, price, bars.proxy_returns(price)))
    s = _scorer(spark, a, a.model)
    gate, stat = quality.registered_test(usable.cache(), lambda t: s(t).compound)
    templates.show()
    gate.show(truncate=False)
    if stat is not None:
        stat.show()


def contract(spark, a):
    rules = readers.rules(spark, a.rules) if a.rules else text.default_rules(spark)
    rows = calendar.align(text.resolve(readers.headlines(spark, a.input), rules))
    s = _scorer(spark, a, a.model)
    rows = rows.withColumn("compound", s(F.col("title")).compound)
    out = corpus.contract(rows, a.ticker, a.model, a.as_of.isoformat() if a.as_of else None, a.window_days, "compound")
    print(out.first().json)
    sinks.contract(out, a.out)


def _merged(spark, a, fresh) -> None:
    """Append to the corpus and say how much was new."""
    fresh, before = fresh.cache(), readers.headlines(spark, a.input)
    out = sinks.merge_headlines(before, fresh, a.out)
    print(f"{fresh.count()} read, {out.count() - before.count()} new")


def scrape(spark, a):
    """Merge fetched or landed RSS feeds into the corpus; a feed's items carry its name. 1 if one wasn't to be had."""
    feeds, robots, limiter, code, found = [ingest.Feed.parse(x) for x in a.feed], ingest.RobotsCache(), ingest.RateLimiter(), 0, []
    for f in feeds:
        status = "ok"
        if a.live:
            payload, status = ingest.fetch_status(f.url, robots, limiter)
            if payload:
                ingest.land(payload, a.landing, f.landed(a.landing).name)
        elif not f.landed(a.landing).exists():
            status = "nothing landed"
        print(f"{f.name}: {status}")
        if status == "ok":
            found.append(str(f.landed(a.landing)))
        elif status != "robots_denied":  # the site's own wish is no failure
            code = 1
    paths = found if feeds else [f"{a.landing}/*.xml"]
    if paths:
        items = readers.feed(spark, paths)
        _merged(spark, a, payloads.headlines_of_items(items, F.col("feed"), F.current_timestamp()).withColumn("seq", F.monotonically_increasing_id()))
    return code


def scrape_news(spark, a):
    """Merge fetched or landed news-API responses into the corpus. 1 if a query failed, 2 if recorded ones aren't asked for."""
    robots, limiter, code, found, missed = ingest.RobotsCache(), ingest.RateLimiter(ingest.NEWS_FLOOR), 0, [], {}
    if not a.live and not a.merge_offline:
        raise SystemExit(2)  # recorded responses don't go into the corpus unless asked for
    for company in a.company:
        at, status = ingest.article_file(a.landing, company), "ok"
        if a.live:
            payload, status = ingest.fetch_status(ingest.news_query_url(f'"{company}"'), robots, limiter, 15.0, tell_limits=True)
            if payload:
                ingest.land(payload, a.landing, at.name)
        elif not at.exists():
            status = "nothing landed"
        print(f"{company}: {status}")
        if status == "ok":
            found.append(str(at))
        else:
            missed[status] = missed.get(status, 0) + 1
            code = code if status in ("robots_denied", "nothing landed") else 1
    if missed:
        print(f"{len(found)} of {len(a.company)} companies;", ", ".join(f"{n} {k}" for k, n in sorted(missed.items())))
    if found or not a.company:
        fresh = payloads.headlines_of_articles(readers.articles(spark, found or a.landing), F.current_timestamp())
        _merged(spark, a, fresh.withColumn("seq", F.monotonically_increasing_id()))
    return code


def fetch_prices(spark, a):
    """Fetch charts of the given tickers (or ``ticker=url``), else of all in the rules and the index, and upsert their bars; failures are told and left out."""
    rules = readers.rules(spark, a.rules) if a.rules else text.default_rules(spark)
    wanted = a.chart or [*(r.ticker for r in text.known_tickers(rules).collect()), a.index]
    texts, failed = [], []
    for ticker, _, url in (x.partition("=") for x in wanted):
        try:
            texts.append((ticker, ingest.fetch_chart(url or ingest.chart_url(ticker))))
        except ingest.PriceFetchError as e:
            failed.append(ticker)
            print(f"{ticker}: not fetched ({e})")
    fresh = payloads.bars_of_chart(spark.createDataFrame(texts, "ticker string, body string"), "body", F.col("ticker"))
    out = bars.upsert(readers.bars(spark, a.prices_dir), fresh).cache()
    for r in out.filter(F.col("ticker").isin([t for t, _ in texts])).groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")).orderBy("ticker").collect():  # a row per ticker
        print(f"{r.ticker}: {r.n} bars, {r.lo} to {r.hi}")
    print(f"{len(texts)} of {len(wanted)} tickers fetched")
    sinks.bars_json(out, a.out)
    return 0


_PRICED = ("--input", "--prices-dir", "--rules", "--lexicon")
_SCORED = ("--model", "--lexicon", "--model-path")
COMMANDS = {
    "align": (align, ("--input", "--out")), "score": (score, ("--input", "--out", *_SCORED)), "evaluate": (evaluate, ("--eval-set", "--out", *_SCORED)),
    "agreement": (agreement, ("--headlines", "--eval-set", "--out", *_SCORED, "--second")), "correlate": (correlate, (*_PRICED, "--out", "--event-threshold")),
    "regress": (regression, (*_PRICED, "--out", "--train-frac")), "overlay": (overlay, (*_PRICED, "--out-dir", "--event-threshold", "--window-before", "--window-after", "--index")),
    "audit": (audit, (*_PRICED, "--n-perm", "--seed")), "leakage-audit": (leakage, (*_PRICED, "--trials", "--seed", "--train-frac")), "robustness": (robustness, (*_PRICED, "--n-perm", "--seed")),
    "prereg": (prereg, (*_PRICED, "--model", "--model-path")), "contract": (contract, ("--input", "--rules", "--ticker", *_SCORED, "--as-of", "--window-days", "--out")),
    "scrape": (scrape, ("--input", "--out", "--landing", "--feed", "--live")), "scrape-news": (scrape_news, ("--input", "--out", "--landing", "--company", "--live", "--merge-offline")),
    "fetch-prices": (fetch_prices, ("--prices-dir", "--chart", "--out", "--rules", "--index")),
}
_OPTIONS = {
    "--model": {"default": "lexicon"}, "--second": {"default": "sum"}, "--lexicon": {}, "--model-path": {}, "--event-threshold": {"type": float, "default": 0.30}, "--train-frac": {"type": float, "default": 0.7},
    "--window-before": {"type": int, "default": 5}, "--window-after": {"type": int, "default": 1}, "--index": {"default": "^NSEI"}, "--n-perm": {"type": int, "default": 2000},
    "--trials": {"type": int, "default": 500}, "--seed": {"type": int, "default": 0}, "--as-of": {"type": date.fromisoformat}, "--window-days": {"type": int, "default": 7}, "--rules": {},
    "--feed": {"action": "append", "default": []}, "--company": {"action": "append", "default": []}, "--chart": {"action": "append", "default": []}, "--live": {"action": "store_true"}, "--merge-offline": {"action": "store_true"},
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemark", epilog=NOTE)
    out.add_argument("--master", default="local[*]")
    commands = out.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        sub = commands.add_parser(name)
        for o in options:
            sub.add_argument(o, **_OPTIONS.get(o, {"required": True}))
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    print(NOTE)
    return COMMANDS[a.command][0](spark or session(a.master), a) or 0


if __name__ == "__main__":
    raise SystemExit(main())
