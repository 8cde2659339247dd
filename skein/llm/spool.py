"""Tables between the jobs of an operator, in the folder that the whole cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.session import remove, scratch

_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that the whole cluster shares."""
    return scratch(spark, name)


def spool(df: DataFrame, name: str) -> DataFrame:
    """Writes df once and returns the written table: lineage ends there, and lost executors cost only tasks."""
    spark, at = df.sparkSession, folder(df.sparkSession, name)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._spooled = at
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes spooled tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._spooled)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names made of `names` that docs has not, in any case of letters."""
    there = {c.lower() for c in docs.columns}
    tail = "_"
    while any((f"_{n}{tail}").lower() in there for n in names):
        tail += "_"
    return [f"_{n}{tail}" for n in names]


def text_bytes(docs: DataFrame) -> int:
    """Size of a table with a text column: the planner's figure, which costs nothing, or a count where it has none."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 55 else docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def arrow_batches(spark: SparkSession, rows: int = 512, size: int = 16 << 20) -> None:
    """Texts may be long, so Python workers get few rows at a time, and a batch ends at `size` bytes. Both are settings of the
    session, since plans read them when they run; they are lowered, never raised."""
    if int(spark.conf.get(_ROWS)) > rows:
        spark.conf.set(_ROWS, rows)
    if int(str(spark.conf.get(_BYTES, str(size))).rstrip("b")) > size:
        spark.conf.set(_BYTES, f"{size}b")
