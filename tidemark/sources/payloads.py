"""Parsers of fetched payloads, as column expressions over text or nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema

HEADLINE_COLUMNS = ("source", "title", "link", "published_at", "published_raw", "scraped_at")


def seen_date(raw: Column) -> Column:
    """``yyyyMMddTHHmmssZ``, strictly; null for anything else."""
    return F.when(raw.rlike(r"^\d{8}T\d{6}Z$"), F.try_to_timestamp(raw, F.lit("yyyyMMdd'T'HHmmssX")))


def pub_date(raw: Column) -> Column:
    """RFC-2822 date, with or without weekday and seconds; no zone means UTC; null if it can't be read."""
    text = F.trim(F.regexp_replace(raw, r"^\s*[A-Za-z]{3,9},\s*", ""))
    text = F.regexp_replace(text, r"\s+(?:GMT|UTC|UT|Z|-0000)$", " +0000")
    text = F.when(text.rlike(r"[+-]\d{4}$"), text).otherwise(F.concat(text, F.lit(" +0000")))
    forms = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yy HH:mm:ss Z", "d MMM yy HH:mm Z")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in forms))


def headlines_of_articles(df: DataFrame, scraped_at: Column, language: str | None = "English") -> DataFrame:
    """Headlines of ``articles`` arrays; other languages, empty titles or links and unreadable dates are left out."""
    one = df.select(F.explode("articles").alias("a"))
    if language is not None:
        one = one.filter(F.col("a.language") == language)
    out = one.select(
        F.coalesce(F.nullif(F.trim("a.domain"), F.lit("")), F.lit("gdelt")).alias("source"), F.trim("a.title").alias("title"), F.trim("a.url").alias("link"),
        seen_date(F.col("a.seendate")).alias("published_at"), F.col("a.seendate").alias("published_raw"), scraped_at.alias("scraped_at"))
    return out.filter("title <> '' and link <> '' and published_at is not null")


def articles_of_text(df: DataFrame, column: str) -> DataFrame:
    """``articles`` arrays parsed from JSON text; none where there are none."""
    return df.withColumn("articles", F.coalesce(F.from_json(column, schema.ARTICLES).articles, F.array().cast(schema.ARTICLES.split(" ", 1)[1])))


def headlines_of_items(items: DataFrame, source: Column, scraped_at: Column) -> DataFrame:
    """Headlines of RSS items (title, link, pubDate); incomplete or unreadable ones are left out."""
    out = items.select(source.alias("source"), F.trim("title").alias("title"), F.trim("link").alias("link"), pub_date(F.col("pubDate")).alias("published_at"), F.col("pubDate").alias("published_raw"), scraped_at.alias("scraped_at"))
    return out.filter("title <> '' and link <> '' and published_at is not null")


def items_of_text(df: DataFrame, column: str) -> DataFrame:
    """Items (title, link, pubDate) of RSS text in a column."""
    item = "struct<title: string, link: string, pubDate: string>"
    parts = F.regexp_extract_all(F.col(column), F.lit(r"(?s)(<item[ >].*?</item>)"), F.lit(1))
    one = df.select("*", F.explode(parts).alias("_item"))
    return one.withColumn("_item", F.from_xml("_item", item.replace("struct<", "").rstrip(">").replace(": ", " "))).select(*df.columns, "_item.*")


def bars_of_chart(df: DataFrame, column: str, ticker: Column) -> DataFrame:
    """Bars of chart-API text: days without an open or close are left out, prices rounded to 4 places, dates in UTC."""
    r = F.get(F.from_json(column, schema.CHART).chart.result, 0)
    quote = F.get(r.indicators.quote, 0)
    one = df.select(ticker.alias("ticker"), F.inline(F.arrays_zip(r.timestamp.alias("ts"), quote.open.alias("open"), quote.close.alias("close"))))
    one = one.toDF("ticker", "ts", "open", "close").filter("open is not null and close is not null")
    return one.select("ticker", F.to_date(F.timestamp_seconds("ts")).alias("date"), F.round("open", 4).alias("open"), F.round("close", 4).alias("close"))
