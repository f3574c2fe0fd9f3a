"""Scorer accuracy and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(rows: DataFrame, predicted: str = "predicted", expected: str = "expected_label", category: str = "category") -> DataFrame:
    """n, correct and accuracy of each category and overall (category null)."""
    hit = F.col(predicted) == F.col(expected)
    out = rows.groupingSets([[category], []], category).agg(F.count("*").alias("n"), F.count_if(hit).alias("correct"), F.grouping(category).alias("overall"))
    return out.withColumn("accuracy", F.try_divide(F.col("correct"), F.col("n")))


def compare(rows: DataFrame, a: str, b: str, expected: str = "expected_label", category: str = "category") -> DataFrame:
    """Accuracy of two scorers on the same rows, by category and overall."""
    out = rows.groupingSets([[category], []], category).agg(
        F.count("*").alias("n"), F.count_if(F.col(a) == F.col(expected)).alias("correct_a"), F.count_if(F.col(b) == F.col(expected)).alias("correct_b"), F.grouping(category).alias("overall"))
    return out.withColumns({"accuracy_a": F.try_divide("correct_a", "n"), "accuracy_b": F.try_divide("correct_b", "n")})


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(F.col(a).alias("label_a"), F.col(b).alias("label_b")).agg(F.count("*").alias("n"))


def confusion_grid(rows: DataFrame, a: str, b: str, labels: tuple[str, ...] = ("positive", "neutral", "negative")) -> DataFrame:
    return rows.groupBy(F.col(a).alias("label_a")).pivot(b, list(labels)).count().na.fill(0)


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    same = F.count_if(F.col(a) == F.col(b))
    return rows.agg(F.count("*").alias("n"), same.alias("agreed"), F.try_divide(same, F.count("*")).alias("rate"))


def disagreements(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.filter(F.col(a) != F.col(b))
