"""Forward as-of join: each event meets the first bar on (or after) its session date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forward(events: DataFrame, bars: DataFrame, on: str = "session_date", strict: bool = False) -> DataFrame:
    """``events`` with a struct column ``bar``, null past the last bar; each event row once.

    Events and bars are united and a running ``last`` goes from the latest date back: one shuffle, one
    sort, no range join. The distinct (ticker, date) pairs go through the window, so a day with very
    many events of one ticker is one row there; events then meet their bar by an equi-join.
    """
    keys = events.select("ticker", F.col(on).alias("_on")).distinct().filter("ticker is not null and _on is not null")
    bar = F.struct(*[c for c in bars.columns if c != "ticker"])
    both = keys.withColumns({"_kind": F.lit(0), "_bar": F.lit(None).cast(bars.select(bar.alias("b")).schema["b"].dataType)}).unionByName(
        bars.select("ticker", F.col("date").alias("_on"), F.lit(1).alias("_kind"), bar.alias("_bar")))
    # sorted by falling date: at one date bars come first if they count for it (inclusive), else last
    kind = F.col("_kind").asc() if strict else F.col("_kind").desc()
    w = Window.partitionBy("ticker").orderBy(F.col("_on").desc(), kind).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("bar", F.last("_bar", ignorenulls=True).over(w)).filter("_kind = 0").select("ticker", F.col("_on").alias(on), "bar")
    return events.join(found, ["ticker", on], "left")
