"""Set operators on the headline corpus, and the trailing-window contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring

WINDOW_DAYS, FULL_FROM = 7, 5


def dedupe(headlines: DataFrame, key: tuple[str, ...] = ("source", "link"), order: str = "seq") -> DataFrame:
    """The first row, by ``order``, of each key: an aggregate with map-side combine, so hot keys are no window."""
    rest = [c for c in headlines.columns if c not in key]
    first = headlines.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return first.select(*(F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in headlines.columns))


def merge(existing: DataFrame, fresh: DataFrame, key: tuple[str, ...] = ("source", "link"), order: str = "seq") -> DataFrame:
    """Existing rows first, then new ones; the first seen of each key stays."""
    old = existing.withColumn("_age", F.struct(F.lit(0).alias("g"), F.col(order).alias("o")))
    new = fresh.withColumn("_age", F.struct(F.lit(1).alias("g"), F.col(order).alias("o")))
    return dedupe(old.unionByName(new), key, "_age").drop("_age")


def coverage(n: Column) -> Column:
    return F.when(n == 0, "none").when(n < FULL_FROM, "partial").otherwise("full")


def latest_session(aligned: DataFrame) -> DataFrame:
    return aligned.agg(F.max("session_date").alias("latest"))


def in_window(aligned: DataFrame, ticker: str, as_of: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """Rows of ``ticker`` (any case) aligned to one of the ``days`` days up to ``as_of``."""
    return aligned.filter((F.upper("ticker") == ticker.upper()) & F.col("session_date").between(F.date_sub(as_of, days - 1), as_of))


def contract(aligned: DataFrame, ticker: str, model: str = "lexicon", as_of: str | None = None, days: int = WINDOW_DAYS, score: str | None = None) -> DataFrame:
    """One row (ticker, score_7d, headline_count_7d, model, coverage, json); a null score and ``none`` without headlines.

    ``score`` names a column already scored by ``model``; else the scorer of that name runs on the titles.
    """
    if score is None:
        run = scoring.scorer(model)
        value = run(F.col("title")).compound
    else:
        value = F.col(score)
    if as_of is None:
        seen = aligned.crossJoin(F.broadcast(latest_session(aligned)))  # one row
        rows = in_window(seen, ticker, F.col("latest"), days)
    else:
        rows = in_window(aligned, ticker, F.lit(as_of).cast("date"), days)
    out = rows.agg(F.avg(value).alias("score_7d"), F.count("*").cast("int").alias("headline_count_7d"))
    out = out.withColumns({"ticker": F.lit(ticker.upper()), "model": F.lit(model), "coverage": coverage(F.col("headline_count_7d"))})
    body = F.struct("score_7d", "headline_count_7d", "model", "coverage")
    return out.withColumn("json", F.to_json(F.struct(body.alias("sentiment")), {"ignoreNullFields": "false"}))


def rolling_contracts(aligned: DataFrame, days: int = WINDOW_DAYS, score: str = "compound") -> DataFrame:
    """Trailing mean score and count for every ticker and session date: daily sums first, then ``days`` shifted copies of them."""
    daily = aligned.groupBy("ticker", "session_date").agg(F.sum(score).alias("s"), F.count(score).alias("n"))
    spread = daily.withColumn("as_of", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_add("session_date", k.cast("int")))))
    sums = spread.groupBy("ticker", "as_of").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = daily.select("ticker", F.col("session_date").alias("as_of"))
    return own.join(sums, ["ticker", "as_of"]).select("ticker", "as_of", F.try_divide("s", "n").alias("score"), "n", coverage(F.col("n")).alias("coverage"))
