"""Data-quality checks and the pre-registered gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring, stats, text

BATCH_STAMP = 5
MIN_HEADLINES, MIN_SESSIONS, MIN_SOURCES = 1000, 30, 3


def timestamp_integrity(headlines: DataFrame, batch: int = BATCH_STAMP) -> DataFrame:
    """(check, example): published after scraped; one link at several times; one title at more times than links; ``batch`` rows at one instant."""
    tag = lambda df, name, c: df.select(F.lit(name).alias("check"), c.cast("string").alias("example"))
    future = tag(headlines.filter("published_at > scraped_at"), "published_after_scraped", F.col("link"))
    links = headlines.groupBy("link").agg(F.count_distinct("published_at").alias("t")).filter("t > 1")
    titles = headlines.groupBy("title").agg(F.count_distinct("published_at").alias("t"), F.count_distinct("link").alias("l")).filter("t > 1 and l < t")
    instants = headlines.groupBy("published_at").agg(F.count("*").alias("n")).filter(F.col("n") >= batch)
    return (
        future.unionByName(tag(links, "link_at_several_times", F.col("link")))
        .unionByName(tag(titles, "title_at_several_times", F.col("title")))
        .unionByName(tag(instants, "batch_stamped", F.col("published_at")))
    )


def demeaned(rows: DataFrame, value: str, group: str = "session_date") -> DataFrame:
    """``rows`` with ``demeaned``: value minus its session's mean (joined back, so a large session isn't one task)."""
    means = rows.groupBy(group).agg(F.avg(value).alias("_mean"))
    return rows.join(means, group).withColumn("demeaned", F.col(value) - F.col("_mean")).drop("_mean")


def demeaned_r(rows: DataFrame, value: str = "contemporaneous_return", group: str = "session_date") -> DataFrame:
    return demeaned(rows, value, group).agg(F.coalesce(stats.pearson(F.col("compound"), F.col("demeaned")), F.lit(0.0)).alias("r"), F.count("demeaned").alias("n"))


def gate(rows: DataFrame, headlines: int = MIN_HEADLINES, sessions: int = MIN_SESSIONS, sources: int = MIN_SOURCES) -> DataFrame:
    """met, n_headlines, n_sessions, n_sources and reasons (of each unmet minimum)."""
    got = rows.agg(F.count("*").alias("n_headlines"), F.count_distinct("session_date").alias("n_sessions"), F.count_distinct("source").alias("n_sources"))
    need = (("n_headlines", headlines, "headlines"), ("n_sessions", sessions, "sessions"), ("n_sources", sources, "sources"))
    reasons = F.array_compact(F.array(*(F.when(F.col(c) < k, F.concat(F.col(c).cast("string"), F.lit(f" {name}, {k} needed"))) for c, k, name in need)))
    out = got.withColumn("reasons", reasons)
    return out.select((F.size("reasons") == 0).alias("met"), "n_headlines", "n_sessions", "n_sources", "reasons")


def usable(fact: DataFrame, two_day: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ar01 whose titles tell no move and fit no template, count of templates before that)."""
    ok = fact.filter("status = 'ok'")
    templates = ok.agg(F.count_if(text.is_liveblog_template(F.col("title"))).alias("n_templates"))
    clean = ok.filter(~text.names_price_move(F.col("title")) & ~text.is_liveblog_template(F.col("title")))
    return clean.join(two_day.filter("ar01 is not null"), F.col("seq") == F.col("event_id")).drop("event_id"), templates


def registered_test(rows: DataFrame, score: Callable[[Column], Column] | None = None, scorer: str = "lexicon", **minima: int) -> tuple[DataFrame, DataFrame | None]:
    """(gate, statistic): only if the gate is met are titles scored, returns demeaned by session and r with interval found."""
    found = gate(rows, **minima)
    got = found.first()
    status = rows.sparkSession.createDataFrame([got], found.schema)  # one row, which is known now
    if not got.met:
        return status, None
    scored = rows.withColumn("compound", (score or (lambda t: scoring.scorer(scorer)(t).compound))(F.col("title")))
    return status, stats.with_ci(demeaned(scored, "ar01"), "compound", "demeaned")
