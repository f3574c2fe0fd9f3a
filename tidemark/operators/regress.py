"""Time-split regression of the next session's return on the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions.ranks import bucketed_rank

MIN_TRAIN, MIN_TEST = 2, 1


def usable(fact: DataFrame) -> DataFrame:
    return fact.filter("lagged_return is not null")


def time_split(rows: DataFrame, frac: float = 0.7, order: str = "seq", by: list[str] | None = None) -> DataFrame:
    """``rows`` with split ``train`` for the first max(int(n * frac), 2) by ``order``, else ``test``.

    The cut is found from counts per value of ``order``'s rank buckets, so no global sort is needed; rows
    with equal ``order`` must not exist (it is the file order).
    """
    keyed = rows.withColumn("_by", F.lit(0)) if not by else rows
    by = by or ["_by"]
    lo_hi = keyed.groupBy(*by).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"), F.count("*").alias("_n"))
    placed = keyed.join(lo_hi, by)
    spread = F.floor((F.col(order) - F.col("_lo")) * F.lit(2.0**32 - 1) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)))
    ranked = bucketed_rank(placed, by, spread, [F.col(order)], "_rank", 64)
    split = F.when(F.col("_rank") < F.greatest(F.floor(F.col("_n") * F.lit(frac)), F.lit(MIN_TRAIN)), "train").otherwise("test")
    return ranked.withColumn("split", split).drop("_rank", "_lo", "_hi", "_n", "_by")


def evaluate(split: DataFrame, x: str = "compound", y: str = "lagged_return", by: list[str] | None = None) -> DataFrame:
    """One row (or one per group): n_train, n_test, slope, intercept, train and test R2 and MAE, and the MAE of the training mean."""
    by = by or []
    keys = by or [F.lit(0).alias("_one")]
    on = by or ["_one"]
    train = F.col("split") == "train"
    pick = lambda c, which: F.when(which, F.col(c))
    slope, intercept = stats.ols(pick(x, train), pick(y, train))
    fit = split.groupBy(*keys).agg(slope.alias("slope"), intercept.alias("intercept"), F.avg(pick(y, train)).alias("_mean"))
    full = (split if by else split.withColumn("_one", F.lit(0))).join(F.broadcast(fit) if not by else fit, on)
    predicted = F.col("intercept") + F.col("slope") * F.col(x)
    mean = F.first("_mean")

    def r2(which: Column) -> Column:
        yy, pp, m = F.when(which, F.col(y)), F.when(which, predicted), F.col("_mean")
        total = F.sum((yy - m) * (yy - m))
        return F.when(total == 0, F.lit(0.0)).otherwise(1 - F.try_divide(F.sum((yy - pp) * (yy - pp)), total))

    out = full.groupBy(*on).agg(
        F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"), F.first("slope").alias("slope"), F.first("intercept").alias("intercept"),
        r2(train).alias("train_r2"), r2(~train).alias("test_r2"),
        stats.mean_absolute_error(F.when(train, F.col(y)), predicted).alias("train_mae"),
        stats.mean_absolute_error(F.when(~train, F.col(y)), predicted).alias("test_mae"),
        stats.mean_absolute_error(F.when(~train, F.col(y)), F.col("_mean")).alias("baseline_test_mae"), mean.alias("_m"))
    return out.drop("_one", "_m")


def predictions(split: DataFrame, x: str = "compound", y: str = "lagged_return") -> DataFrame:
    """Rows with predicted_return by the training fit."""
    train = F.col("split") == "train"
    slope, intercept = stats.ols(F.when(train, F.col(x)), F.when(train, F.col(y)))
    fit = split.agg(slope.alias("_slope"), intercept.alias("_intercept"))
    return split.crossJoin(F.broadcast(fit)).withColumn("predicted_return", F.col("_intercept") + F.col("_slope") * F.col(x)).drop("_slope", "_intercept")  # one row
