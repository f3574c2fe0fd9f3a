"""Running sums and maxima over keys of any size, with DataFrame functions only.

A window over a hot key would put all its rows into one task. Here rows are first cut into buckets
that keep the wanted order; rows are ordered inside a bucket only, and what earlier buckets add comes
from one aggregate row per bucket.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FIRST, _LAST = Window.unboundedPreceding, Window.currentRow


def before(df: DataFrame, by: list[str], buckets: list[str], order: list[str | Column], value: Column, name: str, how: str = "sum") -> DataFrame:
    """``df`` with ``name``: sum (or max) of ``value`` over earlier rows of the same ``by``.

    Order: ``buckets``, then ``order``. ``by`` and ``buckets`` must not be null. A sum starts at 0, a
    maximum at null. Ties in ``order`` fall in any order.
    """
    total = {"sum": F.sum, "max": F.max}[how]
    inner = Window.partitionBy(*by, *buckets).orderBy(*order).rowsBetween(_FIRST, -1)
    outer = Window.partitionBy(*by).orderBy(*buckets).rowsBetween(_FIRST, -1)
    offsets = df.groupBy(*by, *buckets).agg(total(value).alias("_total")).withColumn("_earlier", total("_total").over(outer)).drop("_total")
    out = df.withColumn("_within", total(value).over(inner)).join(offsets, [*by, *buckets])
    both = F.coalesce("_earlier", F.lit(0)) + F.coalesce("_within", F.lit(0)) if how == "sum" else F.greatest("_earlier", "_within")
    return out.withColumn(name, both).drop("_within", "_earlier")


def bucket(key: Column, rows: int) -> Column:
    """Pseudo-random bucket of distinct keys, about as many rows in each as there are buckets (500 at least).

    So a task of :func:`before` sorts about the root of ``rows``: rows of a bucket, or totals of buckets.
    """
    return F.pmod(F.xxhash64(key), F.lit(max(1, rows // max(500, isqrt(rows))))).cast("int")


def stretch(place: str, rows: int) -> Column:
    """Bucket of consecutive places (a struct as of :func:`tidemark.llm.store.place`), with as many rows at most as :func:`bucket` has."""
    return F.struct(f"{place}.part", f"{place}.piece", f"{place}.file", F.expr(f"{place}.row div {max(500, isqrt(rows))}").alias("stretch"))
