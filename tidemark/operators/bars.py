"""Daily bars: construction, returns, neighbours, benchmarks, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INDEX_MARK = "^"


def session_return() -> Column:
    """(close - open) / open; null on a zero open."""
    return F.try_divide(F.col("close") - F.col("open"), F.col("open"))


def from_ticks(ticks: DataFrame, ticker: str, ts: str, price: str) -> DataFrame:
    """Bars (ticker, date, open, close): first and last price of each day; days whose open is 0 have none."""
    out = ticks.groupBy(F.col(ticker).alias("ticker"), F.to_date(ts).alias("date"))
    return out.agg(F.min_by(price, ts).alias("open"), F.max_by(price, ts).alias("close")).filter("open <> 0")


def bar_on(bars: DataFrame, keys: DataFrame) -> DataFrame:
    """Bars of exactly the (ticker, date) pairs in ``keys``."""
    return keys.join(bars, ["ticker", "date"])


def neighbours(bars: DataFrame) -> DataFrame:
    """Bars with ret, idx (position in the ticker's bars), and the bar before and after."""
    w = Window.partitionBy("ticker").orderBy("date")
    return bars.withColumns({
        "ret": session_return(),
        "idx": F.row_number().over(w) - 1,
        "prev_date": F.lag("date").over(w),
        "prev_close": F.lag("close").over(w),
        "next_date": F.lead("date").over(w),
        "next_ret": F.lead(session_return()).over(w),
    })


def cumulative_returns(bars: DataFrame) -> DataFrame:
    """ticker, date, cumulative: compounded return from the first bar on."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return bars.select("ticker", "date", (F.product(1 + session_return()).over(w) - 1).alias("cumulative"))


def proxy_returns(bars: DataFrame) -> DataFrame:
    """date, market: equal-weighted mean return of the tickers present, indices left out."""
    return bars.filter(~F.col("ticker").startswith(INDEX_MARK)).groupBy("date").agg(F.avg(session_return()).alias("market"))


def index_returns(bars: DataFrame, ticker: str) -> DataFrame:
    """date, market of one index; no rows where there is no such index."""
    return bars.filter(F.col("ticker") == ticker).select("date", session_return().alias("market"))


def upsert(existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """Union by (ticker, date); a fetched bar replaces an existing one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(fetched.withColumn("_new", F.lit(1)))
    cols = [c for c in existing.columns if c not in ("ticker", "date")]
    best = both.groupBy("ticker", "date").agg(F.max_by(F.struct(*cols), "_new").alias("_bar"))
    return best.select("ticker", "date", *(F.col(f"_bar.{c}").alias(c) for c in cols))
