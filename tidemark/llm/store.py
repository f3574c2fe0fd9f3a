"""Shared-folder tables and a fixed-size membership filter.

``spark.checkpoint.dir`` names the one folder that driver and executors share. It is read from
the session; only where it is unset in local mode (as in tests) a folder of our own is set. On a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode one is set where none is."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables made inside are deleted at the end, but those whose path is taken out of the list that it gives."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts lineage, survives lost executors.

    Its shuffle files go as soon as it is written: nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    for made in _scopes:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`table` that nothing reads any more."""
    for uri in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidemark/" in uri:
            _delete(df.sparkSession, uri)


def place(df: DataFrame) -> Column:
    """Where a row of ``df`` lies: struct of part, piece, file and row, which sorts in the order of the rows. To be selected from ``df`` itself.

    Spark reads the files of a table by size, several to a task, so numbers given while reading say nothing of the order in
    which its rows were written. Of Parquet files read as they are it is that order: the number of the task that wrote the
    file and of the file among that task's, and the row in the file. Of any other ``df`` it is its partitions and their rows.
    """
    if df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        try:
            at = df.metadataColumn("_metadata")
            number = lambda pattern: F.coalesce(F.regexp_extract(at["file_name"], pattern, 1).try_cast("long"), F.lit(0).cast("long"))
            out = F.struct(number(r"^part-(\d+)").alias("part"), number(r"-c(\d+)\.").alias("piece"), F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row"))
            df.select(out)
            return out
        except AnalysisException:  # no files, or not Parquet
            pass
    rid = F.monotonically_increasing_id()
    none = F.lit(0).cast("long")
    return F.struct(F.shiftright(rid, 33).alias("part"), none.alias("piece"), none.alias("file"), rid.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))


#: 2**26 bits (8 MB) at most, whatever the number of keys: beyond about 10**7 keys it only lets more through.
MAX_FILTER_BITS = 1 << 26


class MemberFilter:
    """Bloom filter of 64-bit keys with a fixed upper size, built by the executors.

    It never says no to a member, so an exact join behind it gives the same rows with or without
    it; it only spares the shuffle rows that can't match. Its size is bounded by ``MAX_FILTER_BITS``
    for any input, so it may be broadcast.
    """

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.log2 = bits, log2

    def __contains__(self, keys: np.ndarray) -> np.ndarray:  # pragma: no cover - use test()
        raise TypeError("use test(keys)")

    def test(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64) if keys.dtype == np.int64 else keys.astype(np.uint64)
        mask = np.uint64((1 << self.log2) - 1)
        left = None
        for shift in (0, 20, 37):  # each only where the ones before said yes
            at = ((keys if left is None else keys[left]) >> np.uint64(shift)) & mask
            yes = np.flatnonzero(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            left = yes if left is None else left[yes]
        out = np.zeros(len(keys), dtype=bool)
        out[left] = True
        return out


def member_filter(keys: DataFrame, column: str, count: int) -> MemberFilter:
    """Filter over ``column``, already hashed to 64 bits; ``count`` sets the size up to the bound."""
    log2 = 16
    while (1 << log2) < min(MAX_FILTER_BITS, 12 * count):
        log2 += 1
    mask = (1 << log2) - 1
    # the top bits of keys shifted by 37 are only 27, which covers MAX_FILTER_BITS
    at = F.explode(F.array(*(F.shiftrightunsigned(F.col(column), s).bitwiseAND(F.lit(mask)) for s in (0, 20, 37))))
    words = (
        keys.filter(F.col(column).isNotNull()).select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    )
    found = words.toArrow()
    bits = np.zeros(max(1, (1 << log2) // 64), dtype=np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return MemberFilter(bits.view(np.uint8), log2)


def _in_filter(spark: SparkSession, keys: DataFrame, column: str):
    """A function of a column of 64-bit hashes: whether it may be among ``keys``. Only that column goes to Python."""
    shared = spark.sparkContext.broadcast(member_filter(keys, column, keys.count()))

    @F.pandas_udf("boolean")
    def test(key: pd.Series) -> pd.Series:
        return pd.Series(shared.value.test(key.to_numpy()))

    return test


def maybe_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``column``, a 64-bit hash, is among ``keys``, and a few more: what is left to join."""
    return df.filter(_in_filter(df.sparkSession, keys, column)(F.col(column)))


def without(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """Rows, with all their columns, whose ``key``, a 64-bit hash, isn't among ``gone`` (key). Only rows that may be are shuffled."""
    test = _in_filter(df.sparkSession, gone, "key")
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), key.alias("key"))
    rest = keyed.filter(test("key")).join(gone.select("key").distinct(), "key", "left_anti")
    out = keyed.filter(~test("key")).select("_row").unionByName(rest.select("_row"))
    return out.select(*(F.col("_row").getField(c).alias(c) for c in df.columns))
