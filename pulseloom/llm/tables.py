"""Shared helpers: input tables, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset, as in local tests, a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that stored() writes within are deleted at the end; a result leaves by stored(..., outer=True)."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, and survives lost executors."""
    spark, level = df.sparkSession, 2 if outer else 1
    df.write.parquet(path := new_path(spark, name))
    if len(_scratch) >= level:
        _scratch[-level].append(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Memory that this Python worker's earlier tasks freed returns to the system; workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", keyed: int = 1000) -> DataFrame:
    """left join right on keys, where right has one row a key and a few keys may hold most rows of left.

    Keys that hold more than a `keyed`-th of left's rows, which are fewer than `keyed`, are joined by broadcast,
    so that their rows stay where they are; all others by a shuffle.
    """
    n = left.count()
    # fewer than `keyed` rows, as their counts sum to n at most
    heavy = F.broadcast(left.groupBy(*keys).count().where(F.col("count") > max(1000, n // keyed)).select(*keys))
    few = F.broadcast(right.join(heavy, keys, "left_semi"))
    known = F.lit(True)
    for key in keys:
        known &= F.col(key).isNotNull()
    rest = left.where(known).join(heavy, keys, "left_anti").join(right, keys, how)
    nulls = left.where(~known).join(F.broadcast(right.limit(0)), keys, how)  # match nothing, and needn't move
    return left.join(heavy, keys, "left_semi").join(few, keys, how).unionByName(rest).unionByName(nulls)
