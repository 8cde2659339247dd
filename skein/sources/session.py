"""Where intermediate results go."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that the whole cluster shares: spark.checkpoint.dir. Where it is unset, a temporary folder serves a local
    master, as in tests; on a cluster executors would write to their own disks, so that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = got.get() if got.isDefined() else None
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        at = f"file://{tempfile.gettempdir()}/skein-{os.getuid()}"
    return at.rstrip("/")


#: Folders made in this process, for clean().
_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    _MADE.append(f"{shared(spark)}/skein-{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if at in _MADE:
        _MADE.remove(at)


def clean(spark: SparkSession) -> None:
    """Deletes all that scratch() named and nobody removed: for the end of a job, when its results are written."""
    for at in list(_MADE):
        remove(spark, at)


def sorted_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """df in ranges of an order, written once: with `_p`, the range, and `_i`, the place in it. Nothing stays in memory, and
    later jobs read the same ranges even if executors are lost."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    placed = placed.withColumn("_i", F.monotonically_increasing_id() - F.col("_p").cast("long") * F.lit(2**33))
    at = scratch(df.sparkSession, "ranges")
    placed.write.parquet(at)
    out = df.sparkSession.read.schema(placed.schema).parquet(at)
    out._spooled = at  # for who wants it removed before the end
    return out
