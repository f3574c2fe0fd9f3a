"""Readers with declared schemas. Paths may be anything Spark opens."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema

_CSV = {"header": "true", "escape": '"', "multiLine": "true", "mode": "FAILFAST"}
_OFFSET = r"(?:Z|[+-]\d{2}:?\d{2})$"


def instant(text: Column) -> Column:
    """ISO-8601 with an offset; a text without one is an error, not a guess."""
    return F.when(text.rlike(_OFFSET), F.to_timestamp(text)).when(text.isNotNull(), F.raise_error(F.concat(F.lit("time without offset: "), text)).cast("timestamp"))


def _in_order(raw: DataFrame) -> DataFrame:
    """``raw`` with ``seq``, the rows' order in the file, or in several files by name (numbers in names count as such)."""
    read, files = F.monotonically_increasing_id(), raw.inputFiles()
    if len(files) < 2:
        return raw.withColumn("seq", read)
    # files are read by size, several to a task; each is one task's, as fields may hold line breaks
    number = lambda path: [int(x) if k % 2 else x for k, x in enumerate(re.split(r"(\d+)", path))]
    ranks = raw.sparkSession.createDataFrame(list(enumerate(sorted(files, key=number))), "_rank long, _file string")  # a row per file
    placed = raw.withColumns({"_file": F.input_file_name(), "_row": read.bitwiseAND(F.lit((1 << 33) - 1))}).join(F.broadcast(ranks), "_file", "left")
    known = F.coalesce("_rank", F.raise_error(F.concat(F.lit("file not listed: "), F.col("_file"))).cast("long"))
    return placed.withColumn("seq", F.shiftleft(known, 33) + F.col("_row")).drop("_file", "_row", "_rank")


def headlines(spark: SparkSession, path: str) -> DataFrame:
    """Headline corpus (CSV, a file or a directory) with ``seq``, the rows' order."""
    raw = _in_order(spark.read.options(**_CSV).schema(schema.HEADLINE_RAW).csv(path))
    return raw.withColumns({"published_at": instant(F.col("published_at")), "scraped_at": instant(F.col("scraped_at"))}).select(*raw.columns)


def bars(spark: SparkSession, path: str) -> DataFrame:
    """Price files (one JSON document a ticker, a file or a directory) as (ticker, date, open, close); one read for all tickers."""
    files = spark.read.schema(schema.PRICE_FILE).option("multiLine", "true").option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(path)
    return files.select("ticker", F.inline("bars"))


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**_CSV).schema(schema.EVAL).csv(path)


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Resolver rules (CSV: rule_id, pattern, company, ticker)."""
    return spark.read.options(**_CSV).schema(schema.RULE).csv(path)


def scored(spark: SparkSession, path: str, model: bool = False) -> DataFrame:
    """Scored headlines (CSV) of the lexicon or of a model."""
    return spark.read.options(**_CSV).schema(schema.MODEL_SCORED if model else schema.LEXICON_SCORED).csv(path)


def articles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """News-API responses (JSON, one object a file) with the slug of their file name."""
    raw = spark.read.schema(schema.ARTICLES).option("multiLine", "true").json(path)
    return raw.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1).alias("slug"))


def feed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """RSS 2.0 items (title, link, pubDate as written) with ``feed``, the name of their file, which is that of the feed."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string").load(path)
    return items.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.xml)?$", 1).alias("feed"))
