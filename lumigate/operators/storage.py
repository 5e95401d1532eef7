"""Tables written in the folder that the cluster shares, to cut a plan that would else repeat its input."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see. Only a session on one machine may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"{tempfile.gettempdir()}/lumigate-shared"


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lumigate"


def stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `stored` that no later plan reads."""
    for df in tables:
        delete(df.sparkSession, df._stored_at)


def sweep(spark: SparkSession, hours: float) -> list[str]:
    """Deletes stored tables that nothing was written to for so many hours, and gives their names.

    Results that are computed when they are read need the tables under them, so `stored` can't delete these itself. Run it
    now and then with more hours than any job lasts; tables of sessions that broke off go with it.
    """
    if not exists(spark, _tables(spark)):
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    old = [f for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if f.getModificationTime() <= (time.time() - 3600 * hours) * 1000]
    for f in old:
        delete(spark, f.getPath().toString())
    return sorted(f.getPath().getName() for f in old)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB: on executors' disks and in the checkpoint, not in their heaps."""
    was = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, was)
