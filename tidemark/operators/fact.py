"""The event fact: resolved, aligned, scored events with their returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import calendar, scoring, text
from tidemark.operators import asof, bars


def gap_return(local: Column, bar: str = "bar") -> Column:
    """Open over previous close - 1 of events strictly between the previous close and the auction of their bar; else null."""
    prev, day = F.col(f"{bar}.prev_date"), F.col(f"{bar}.date")
    at = calendar.clock(local)
    date = F.to_date(local)
    after = (date > prev) | ((date == prev) & (at > calendar._micros(calendar.CLOSE)))
    until = (date < day) | ((date == day) & (at < calendar._micros(calendar.AUCTION)))
    return F.when(prev.isNotNull() & after & until, F.try_divide(F.col(f"{bar}.open"), F.col(f"{bar}.prev_close")) - 1)


def priced(aligned: DataFrame, price_bars: DataFrame) -> DataFrame:
    """Aligned events with bar, ret (contemporaneous), lagged and gap return; rows without a bar keep nulls."""
    out = asof.forward(aligned, bars.neighbours(price_bars))
    return out.withColumns({
        "contemporaneous_return": F.col("bar.ret"),
        "lagged_return": F.col("bar.next_ret"),
        "gap_return": gap_return(F.col("local_time")),
        "rolled": F.col("bar.date") > F.col("session_date"),
    })


def build(headlines: DataFrame, rules: DataFrame, price_bars: DataFrame, score: Callable[[Column], Column] | None = None) -> DataFrame:
    """All headlines with status ``no_match``, ``unresolved``, ``price_error`` or ``ok``; those that are ok hold the fact's columns.

    The scorer runs on rows that have a bar only.
    """
    found = calendar.align(text.resolve(headlines, rules), "published_at")
    out = priced(found, price_bars)
    tickers = price_bars.select("ticker").distinct().withColumn("_priced", F.lit(True))
    out = out.join(tickers, "ticker", "left")
    ok = (F.col("status") == "resolved") & F.col("bar").isNotNull()
    status = F.when(F.col("status") != "resolved", F.col("status")).when(F.col("_priced").isNull() | F.col("bar").isNull(), "price_error").otherwise("ok")
    scored = (score or (lambda t: scoring.lexicon_score(t).compound))(F.col("title"))
    out = out.withColumn("compound", F.when(ok, scored)).withColumn("status", status)
    return out.withColumn("aligned_date", F.col("session_date")).withColumn("session_date", F.coalesce("bar.date", "session_date")).drop("_priced")


def rows(fact: DataFrame) -> DataFrame:
    """The usable rows."""
    return fact.filter("status = 'ok'")


def outcomes(fact: DataFrame) -> DataFrame:
    """Counts of each status: nothing is lost unseen."""
    return fact.groupBy("status").agg(F.count("*").alias("n"))
