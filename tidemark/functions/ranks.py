"""Ranks over large groups without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_rank(df: DataFrame, by: list[str], key: Column, order: list[Column], name: str, buckets: int) -> DataFrame:
    """0-based rank by (``key``, ``order``) in each group; ``key`` is an unsigned 32-bit number, evenly spread.

    Rows are sorted in buckets of ``key``'s leading part; counts of earlier buckets are added.
    """
    df = df.withColumns({"_key": key, "_part": F.floor(key / F.lit(2**32 / buckets)).cast("int")})
    counts = df.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    start = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(start), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*by, "_part").orderBy("_key", *order)
    out = df.withColumn("_row", F.row_number().over(inner) - 1).join(counts, [*by, "_part"])
    return out.withColumn(name, F.col("_row") + F.col("_start")).drop("_key", "_part", "_row", "_start")
