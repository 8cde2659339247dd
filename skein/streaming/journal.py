"""Structured Streaming over journal files: watches, materialised state, replay, metric windows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.functions.predicates import has_prefix


def source(spark: SparkSession, path: str, schema: StructType, *, files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """A stream of the Parquet files that come into a folder; files_per_trigger bounds what is in flight."""
    reader = spark.readStream.schema(schema)
    reader = reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)
    reader = reader if glob is None else reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """The result of a stream over what is there now, as a table in memory."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (writer if checkpoint is None else writer.option("checkpointLocation", checkpoint)).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def watch(journal: DataFrame, prefix: bytes, notify: Callable[[DataFrame, int], None], checkpoint: str | None = None):
    """Calls notify(batch, id) with new operations on keys of a prefix; a batch may come again after a failure."""
    seen = journal.filter(has_prefix(F.col("key"), prefix))
    writer = seen.writeStream.foreachBatch(notify).trigger(availableNow=True)
    return (writer if checkpoint is None else writer.option("checkpointLocation", checkpoint)).start()


def state(journal: DataFrame) -> DataFrame:
    """Last operation of each key as (key, value, slot), deleted keys with `is_delete`: complete or update mode."""
    last = journal.groupBy("key").agg(F.max_by(F.struct("value", "is_delete", "slot"), "slot").alias("l"))
    return last.select("key", "l.value", "l.slot", "l.is_delete")


def windows(events: DataFrame, ts: str, seconds: int, late: str, *by: str, value: str) -> DataFrame:
    """Tumbling flush windows with count, sum, least and greatest; `late` is how long a window stays open (an extra)."""
    rows = events.withWatermark(ts, late).groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *by)
    return rows.agg(F.count("*").alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max")).select(F.col("w.start").alias("start"), *by, "count", "sum", "min", "max")


class Watches:
    """Subscriptions by group and key prefix to one journal stream. Each gets the new operations on its keys, batch by batch; a
    hole in the slots (the journal was cut before they were read) is an error frame to all: they must read the state anew."""

    def __init__(self, journal: DataFrame, expected: int | None = None):
        self.journal, self.expected = journal, expected
        self.subscriptions: dict[tuple[str, bytes], tuple[Callable, Callable]] = {}

    def subscribe(self, group: str, prefix: bytes, notify: Callable[[DataFrame, int], None], failed: Callable[[int, int], None] = lambda *_: None) -> None:
        self.subscriptions[group, prefix] = notify, failed

    def unsubscribe(self, group: str, prefix: bytes) -> bool:
        return self.subscriptions.pop((group, prefix), None) is not None

    def _batch(self, batch: DataFrame, number: int) -> None:
        ends = batch.agg(F.min("slot").alias("low"), F.max("slot").alias("high")).first()
        if ends["low"] is None:
            return
        if self.expected is not None and ends["low"] > self.expected:
            for _, failed in list(self.subscriptions.values()):
                failed(self.expected, ends["low"])
        self.expected = max(self.expected or ends["high"] + 1, ends["high"] + 1)
        for (_, prefix), (notify, _) in list(self.subscriptions.items()):
            notify(batch.filter(has_prefix(F.col("key"), prefix)), number)

    def start(self, checkpoint: str | None = None):
        """The running query; its stop() cancels, and a start with the same checkpoint goes on."""
        writer = self.journal.writeStream.foreachBatch(self._batch).trigger(availableNow=True)
        return (writer if checkpoint is None else writer.option("checkpointLocation", checkpoint)).start()


def appended(stream: DataFrame, at: str, checkpoint: str) -> None:
    """Writes what is new in a stream to a folder of Parquet files, each row once: the folder's log and the checkpoint agree on
    the batches that are done, so a run after a failure goes on where the last one ended."""
    stream.writeStream.format("parquet").option("path", at).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


class Chunks:
    """An append-only stream of chunks in a folder: parts are numbered and never change, a view is the parts up to a number, and
    a checkpoint is a view that is kept under a name."""

    def __init__(self, files, schema: StructType):
        self.files, self.schema, self.spark = files, schema, files.spark

    def _parts(self) -> list[str]:
        return [n for n in self.files.names("parts") if self.files.exists(f"parts/{n}/_SUCCESS")]

    def append(self, rows: DataFrame) -> int:
        """The number of the new part. One writer at a time: a second one fails on the part's name."""
        number = len(self.files.names("parts"))
        rows.select(*self.schema.fieldNames()).write.parquet(f"{self.files.root}/parts/{number:012}")
        return number

    def capture(self) -> int:
        """The end of a view of what is there now."""
        return len(self._parts())

    def open(self, end: int | None = None, start: int = 0) -> DataFrame:
        paths = [f"{self.files.root}/parts/{n}" for n in self._parts()[start:end]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def checkpoint(self, name: str, end: int) -> None:
        self.files.create(f"checkpoints/{name}.json", json.dumps({"end": end}))

    def at(self, name: str) -> int:
        return json.loads(self.files.read(f"checkpoints/{name}.json"))["end"]
