"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local session without it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables that are written and not yet deleted, by the path that their reader has.
_kept: dict[str, SparkSession] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage is cut, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def written_together(frames: dict[str, DataFrame]) -> list[DataFrame]:
    """:func:`written` of several tables by name, as jobs that run side by side."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(df.sparkSession)(written), df, name) for name, df in frames.items()]]


def _delete(path: str) -> None:
    spark = _kept.pop(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forgotten(df: DataFrame) -> None:
    """Deletes the table behind a DataFrame that :func:`written` returned, once nothing reads it any more."""
    if getattr(df, "_written_at", None) in _kept:
        _delete(df._written_at)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes, at its end, the tables that were written inside, but for those that are put into the list it yields."""
    before, keep = set(_kept), []
    yield keep
    held = {getattr(df, "_written_at", None) for df in keep}
    for path in set(_kept) - before - held:
        _delete(path)


@atexit.register
def _end() -> None:
    for path in list(_kept):
        try:
            _delete(path)
        except Exception:  # the session has ended: the cluster's own clean-up takes the folder
            return


def numbered(rows: DataFrame, key: str, order: str, into: str) -> DataFrame:
    """``rows`` with their number, from 1, within ``key`` in ``order``, in column ``into``.

    Rows are sorted in ranges; a range's numbers begin after the counts of the ranges before it. So no task sorts a whole key,
    and what is joined back is a row for each key and range.
    """
    parts = max(8, rows.sparkSession.sparkContext.defaultParallelism)
    laid = rows.repartitionByRange(parts, key, order).sortWithinPartitions(key, order)
    laid = written(laid.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    ranges = laid.groupBy(key, "_pid").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(key, "_pid", (before - F.col("_first") + 1).alias("_shift"))
    return laid.join(ranges, [key, "_pid"]).withColumn(into, F.col("_at") + F.col("_shift")).drop("_pid", "_at", "_shift")
