"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, minhash, mixing, rules, sharding, store

SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the weighed votes reject go.

    A null or empty text has no words and goes; repeated rows are judged alike and all stay or go; an empty table
    gives no rows. All columns stay as they were.
    """
    return rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of least doc_id (five words a shingle, similarity 0.8).

    A row without doc_id stays; of rows that repeat a doc_id and its text one stays; a null or empty text is similar
    to nothing; an empty table gives no rows. Only rows that may go, or repeat a doc_id, are shuffled with their texts.
    """
    found = minhash.near_duplicates(docs, SHINGLE, PERCENT)
    gone = store.table(found.filter("not kept").select(F.xxhash64("doc_id").alias("key"), "doc_id").distinct(), "gone")
    often = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    often = store.table(often.join(gone, "doc_id", "left_anti").select(F.xxhash64("doc_id").alias("key"), "doc_id"), "often")
    once = store.without(docs, F.xxhash64("doc_id"), gone.select("key").unionByName(often.select("key")))
    if often.isEmpty():
        return once
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    some = store.maybe_in(docs.select(row, F.xxhash64("doc_id").alias("key"), F.xxhash64("text").alias("tid")), "key", often)
    some = some.join(often.select("key"), "key", "left_semi").dropDuplicates(["key", "tid"])
    return once.unionByName(some.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    A null or empty text holds none and stays; repeated rows stay or go together; an empty table, of documents or of
    passages, changes nothing.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources interleaved at their target weights, in the order of the mix; all documents stay.

    A null source is a source of its own; null texts and ids, repeated rows and equal ids take places like any other;
    an empty table gives no rows. All columns stay as they were, whatever their names.
    """
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document: each shard is a mix as the whole is, and its slots are in the order of the mix.

    Documents of a source are dealt to the shards in turn, in the order in which the mix was written, but those of equal texts go
    to one shard. A null text has size 8 and no links; a null source is a source of its own; repeated rows keep one row each; a null
    doc_id is kept; other columns are not read.
    """
    return sharding.assign(docs, kind="source").drop("group")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]

#: Expectation-maximisation, exact components and the schedule are beyond one SQL statement; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again; what a stage only needed itself goes."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        with store.scratch(spark) as made:
            out = store.table(stage(spark, docs, sf_dir), f"pipeline-{k}")
            made.pop()  # the stage's own result
        if last is not None:
            store.drop_table(last)
        docs = last = out
    return docs
