"""Statistics as aggregate and scalar column expressions.

Constant input has correlation and slope 0 (Spark's own ``corr`` raises on it); tests for constancy
compare minimum and maximum, so no rounding error of a mean can hide it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963985


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r of rows where both are present; null below two rows, 0 if either is constant."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.when(F.count(x) < 2, F.lit(None).cast("double")).when(
        (F.min(x) == F.max(x)) | (F.min(y) == F.max(y)), F.lit(0.0)
    ).otherwise(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def fisher_ci(r: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Interval of r by Fisher's transform; (-1, 1) below four rows."""
    clamped = F.greatest(F.least(r, F.lit(1 - 1e-10)), F.lit(-1 + 1e-10))
    mid, half = F.atanh(clamped), z / F.sqrt(F.greatest(n - 3, F.lit(1)))
    return tuple(F.when(n < 4, F.lit(edge)).otherwise(F.tanh(mid + side * half)) for edge, side in ((-1.0, -1), (1.0, 1)))  # type: ignore[return-value]


def with_ci(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """r, n, ci_low and ci_high, of all rows or of each group."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = df.groupBy(*(by or [])).agg(pearson(F.col(x), F.col(y)).alias("r"), F.count(F.when(both, 1)).alias("n"))
    low, high = fisher_ci(F.col("r"), F.col("n"))
    return out.withColumns({"ci_low": low, "ci_high": high})


def ols(x: Column, y: Column) -> tuple[Column, Column]:
    """Aggregates: slope and intercept; slope 0 and intercept mean(y) on constant x."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    slope = F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.covar_pop(x, y), F.var_pop(x)), F.lit(0.0)))
    return slope, F.avg(y) - slope * F.avg(x)


def r_squared(y: Column, predicted: Column, mean: Column) -> Column:
    """Aggregate: 1 - SS_res / SS_tot against ``mean`` (own mean: in sample; the training mean: out of sample); 0 if SS_tot is 0."""
    total = F.sum((y - mean) * (y - mean))
    return F.when(total == 0, F.lit(0.0)).otherwise(1 - F.try_divide(F.sum((y - predicted) * (y - predicted)), total))


def mean_absolute_error(y: Column, predicted: Column) -> Column:
    return F.avg(F.abs(y - predicted))


def permutation_p(null: Column, real: Column) -> Column:
    """Aggregate: two-sided, (count(|null| >= |real|) + 1) / (n + 1)."""
    return (F.count_if(F.abs(null) >= F.abs(real)) + 1) / (F.count(null) + 1)


def share_at_least(null: Column, real: Column) -> Column:
    """Aggregate: share of null values not below the real one; null if there are none."""
    return F.avg((null >= real).cast("int"))


def by_index(sorted_values: Column, index: Column) -> Column:
    return F.element_at(sorted_values, index.cast("int") + 1)


def percentile_interval(values: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Aggregates: sorted values at ``int(tail * n)`` and ``min(int((1 - tail) * n), n - 1)``."""
    tail = (1 - level) / 2
    got = F.sort_array(F.collect_list(values))
    n = F.count(values)
    return by_index(got, F.floor(n * tail)), by_index(got, F.least(F.floor(n * (1 - tail)), n - 1))


#: Coefficients of a published rational approximation of the normal quantile (relative error 1.15e-9).
_CENTRE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
_TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))
_SPLIT = 0.02425


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function; raises outside (0, 1)."""
    q = p - 0.5
    mid = q * _horner(_CENTRE[0], q * q) / _horner(_CENTRE[1], q * q)
    tail = lambda x: _horner(_TAIL[0], x) / _horner(_TAIL[1], x)
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    return (
        F.when((p <= 0) | (p >= 1), F.raise_error(F.lit("p must be between 0 and 1")).cast("double"))
        .when(p < _SPLIT, tail(low)).when(p > 1 - _SPLIT, -tail(high)).otherwise(mid)
    )


def _z(alpha: float, power: float) -> Column:
    return normal_quantile(F.lit(1 - alpha / 2)) + normal_quantile(F.lit(power))


def least_detectable_r(n: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Smallest |r| that ``n`` rows detect; raises for n <= 3."""
    return F.when(n <= 3, F.raise_error(F.lit("n must exceed 3")).cast("double")).otherwise(F.tanh(_z(alpha, power) / F.sqrt(n - 3)))


def needed_n(r: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Rows needed to detect ``r``; raises unless 0 < |r| < 1."""
    bad = (r == 0) | (F.abs(r) >= 1)
    return F.when(bad, F.raise_error(F.lit("|r| must be between 0 and 1")).cast("double")).otherwise(F.pow(_z(alpha, power) / F.atanh(F.abs(r)), F.lit(2)) + 3)
