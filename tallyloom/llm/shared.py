"""Written tables in the folder that the driver and every executor share.

Lineage is cut by writing a Parquet table there and reading it back: a lost executor then costs a re-read, not the
work behind it. The folder is the cluster's ``spark.checkpoint.dir``; only a local session without that setting gets
a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
#: Spark's setting for removing an execution's shuffle files when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="tallyloom-"))
    return folder(spark)


def written(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder, with the same columns and types.

    ``drop_shuffles``: the shuffle files behind it go as soon as it is written, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, str(drop_shuffles or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_mark() -> int:
    """How many tables are written so far, for :func:`forget_since`."""
    return len(_written)


def forget_since(mark: int, keep: int = 1) -> None:
    """Deletes the tables that were written after ``mark``, but for the last ``keep``, which must read none of the others."""
    for spark, path in _written[mark:-keep]:
        _delete(spark, path)
    _written[mark:] = _written[max(mark, len(_written) - keep) :]


@atexit.register
def _forget() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the cluster's own clean-up takes the folder
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: whole texts come in these, so Spark's 10,000 would take several times the memory.
BATCH_ROWS = 2000
#: Rows of keys (up to 100 bytes each) that are sent to every task; more are joined by a shuffle.
SMALL_ROWS = 1 << 18


def own_names(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns named, under the operator's own names, so that no other column can clash.

    Sets the session's Arrow batches to ``BATCH_ROWS`` rows if they are larger.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.select([F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores if their scan has fewer partitions than these, as a small or unsplittable table has."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def small(keys: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``keys`` (a written table) for a broadcast join if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or it with underscores in front, whichever ``df`` does not have yet (case aside)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
