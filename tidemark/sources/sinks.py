"""Writers. Parquet is the native format; CSV and JSON keep the exchange formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import corpus

FILE_ROWS = 1 << 18
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, _STAMP) for c, t in df.dtypes if t == "timestamp"})


def csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None, order: list[str | Column] | None = None, one_file: bool = False) -> None:
    """CSV with header and stated columns, in files of at most ``FILE_ROWS`` rows; by name and row they are in ``order``, or that of ``df``.

    Readers can't split a file whose fields may hold line breaks, so it is one task's. ``one_file`` is for exchange files of a size one reader wants.
    """
    out = df.orderBy(*order) if order else df
    out = _stamped(out.select(*(columns or out.columns)))
    out = out.coalesce(1) if one_file else out
    out.write.mode("overwrite").option("header", "true").option("escape", '"').option("maxRecordsPerFile", 0 if one_file else FILE_ROWS).csv(path)


def headlines(df: DataFrame, path: str) -> None:
    """Corpus by publication time (ties in corpus order), times in UTC."""
    csv(df, path, ("source", "title", "link", "published_at", "published_raw", "scraped_at"), ["published_at", "seq"])


def corpus_parquet(df: DataFrame, path: str) -> None:
    """Native corpus, partitioned by publication day."""
    keyed = df.withColumn("day", F.to_date("published_at"))
    # by hour within the day, so that a day of very many rows is several tasks and files
    keyed.repartition("day", F.date_trunc("HOUR", "published_at")).sortWithinPartitions("day", "published_at").write.mode("overwrite").partitionBy("day").parquet(path)


def merge_headlines(existing: DataFrame, fresh: DataFrame, path: str) -> DataFrame:
    """Append-merge: first seen of each (source, link) stays; written to ``path`` (not the one read) and returned."""
    out = corpus.merge(existing, fresh)
    headlines(out, path)
    return out


def bars_json(df: DataFrame, path: str) -> None:
    """One JSON document and file a ticker: {ticker, bars: [{date, open, close}]}, by date."""
    out = df.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", "open", "close"))).alias("bars"))  # a ticker's trading days
    out.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def bars_parquet(df: DataFrame, path: str) -> None:
    df.repartition("ticker").sortWithinPartitions("date").write.mode("overwrite").partitionBy("ticker").parquet(path)


def aligned(df: DataFrame, path: str) -> None:
    csv(df, path, schema.ALIGNED_COLUMNS)


def fact(df: DataFrame, path: str) -> None:
    csv(df, path, schema.FACT_COLUMNS)


def regression(df: DataFrame, path: str) -> None:
    """Training rows, then test rows, with predicted_return."""
    csv(df, path, ("title", "ticker", "session_date", "compound", "lagged_return", "predicted_return", "split"), [F.col("split").desc(), "seq"])


def scored(df: DataFrame, path: str) -> None:
    csv(df, path, tuple(c for c in df.columns if c != "seq"))


def contract(df: DataFrame, path: str) -> None:
    """The contract's one row as a JSON text file."""
    df.select(F.col("json").alias("value")).coalesce(1).write.mode("overwrite").text(path)
