"""Incremental ingestion with Structured Streaming: landing folders to corpus and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import schema
from tidemark.functions import calendar
from tidemark.sources import payloads

LATE = "2 days"


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Headlines of news-API responses as they land."""
    raw = spark.readStream.schema(schema.ARTICLES).option("multiLine", "true").json(folder)
    return payloads.headlines_of_articles(raw, F.current_timestamp())


def headlines(spark: SparkSession, folder: str) -> DataFrame:
    """Headline CSV files as they land."""
    from tidemark.sources.readers import _CSV, instant

    raw = spark.readStream.schema(schema.HEADLINE_RAW).options(**_CSV).csv(folder)
    return raw.withColumns({"published_at": instant(F.col("published_at")), "scraped_at": instant(F.col("scraped_at"))})


def first_seen(stream: DataFrame, late: str = LATE) -> DataFrame:
    """First row of each (source, link) inside the watermark; state is bounded by ``late``."""
    return stream.withWatermark("scraped_at", late).dropDuplicatesWithinWatermark(["source", "link"])


def append_new(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append rows whose (source, link) the Parquet corpus at ``path`` lacks; rows only ever get added.

    A batch that is run again finds its own rows there and adds nothing, so appending is idempotent.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        fresh = batch.groupBy("source", "link").agg(F.min_by(F.struct(*[c for c in batch.columns if c not in ("source", "link")]), "scraped_at").alias("r")).select("source", "link", "r.*").select(*batch.columns)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            known = spark.read.parquet(path).select("source", "link")
            fresh = fresh.join(known, ["source", "link"], "left_anti")
        fresh.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(path)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def timing_counts(events: DataFrame, ts: str = "published_at", late: str = LATE, utc_ntz: bool = False) -> DataFrame:
    """Headlines of each hour and timing bucket; late rows within the watermark still count."""
    out = calendar.align(events, ts, utc_ntz).withWatermark(ts, late)
    return out.groupBy(F.window(ts, "1 hour"), "timing").agg(F.count("*").alias("n"))
