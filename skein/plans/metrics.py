"""Metric and stream queries over events; values are taken as nanoseconds in thousands."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.operators import metrics as M
from skein.plans.kv import STATE
from skein.registry import query
from skein.sources.session import scratch
from skein.streaming import journal as J

BUCKETS = """
WITH v AS (SELECT event_type, user_id, CAST(floor(value * 1000) AS BIGINT) AS ns FROM events),
b AS (SELECT *, CASE WHEN ns < 256 THEN ns WHEN ns >= 1099511627776 THEN 4352 ELSE 256 + (length(bin(ns)) - 9) * 128 + (ns >> (length(bin(ns)) - 8)) - 128 END AS bucket FROM v),
h AS (SELECT event_type, bucket, count(*) AS count, CAST(sum(ns) AS BIGINT) AS sum, min(ns) AS min, max(ns) AS max FROM b GROUP BY ALL)
"""


def _ns():
    return F.floor(F.col("value") * 1000).cast("long")


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


@query("mx_histogram", BUCKETS + "SELECT * FROM h")
def _(spark, sf):
    return M.histogram(_events(spark, sf), _ns(), "event_type")


@query("mx_quantiles", BUCKETS + ", c AS (SELECT *, sum(count) OVER (PARTITION BY event_type) AS n, max(max) OVER (PARTITION BY event_type) AS top, sum(count) OVER (PARTITION BY event_type ORDER BY bucket) AS seen FROM h) SELECT event_type, CAST(sum(count) AS BIGINT) AS count, CAST(sum(sum) AS BIGINT) AS sum, min(min) AS min, max(max) AS max, " + ", ".join(f"CAST(min(CASE WHEN seen >= ceil(n * {q} / 1000.0) THEN CASE WHEN bucket = 4352 THEN 18446744073709551615 WHEN bucket < 256 THEN bucket ELSE least(top, ((bucket - 256) % 128 + 129) * CAST(pow(2, (bucket - 256) // 128 + 1) AS BIGINT) - 1) END END) AS BIGINT) AS {n}" for n, q in M.QUANTILES.items()) + " FROM c GROUP BY event_type")
def _(spark, sf):
    out = M.quantiles(M.histogram(_events(spark, sf), _ns(), "event_type"), "event_type")
    return out.select("event_type", "count", "sum", "min", "max", *(F.col(q).cast("long").alias(q) for q in M.QUANTILES))


@query("mx_merge", BUCKETS + "SELECT bucket, CAST(sum(count) AS BIGINT) AS count, CAST(sum(sum) AS BIGINT) AS sum, min(min) AS min, max(max) AS max FROM h GROUP BY bucket")
def _(spark, sf):
    return M.merge(M.histogram(_events(spark, sf), _ns(), "event_type"))


@query("mx_bandwidth", "WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS count, CAST(sum(user_id) AS BIGINT) AS bytes FROM events GROUP BY 1) SELECT start, count, bytes, bytes // count AS average, bytes / 3600 AS rate, CAST(sum(bytes) OVER (ORDER BY start) AS BIGINT) AS total FROM w")
def _(spark, sf):
    return M.bandwidth(_events(spark, sf), "ts", F.col("user_id"), 3600)


@query("mx_counters", "SELECT event_type, CAST(sum(user_id) AS BIGINT) AS sum, arg_max(user_id, event_id) AS last, count(*) AS count, min(user_id) AS min, max(user_id) AS max, avg(user_id) AS mean FROM events GROUP BY 1")
def _(spark, sf):
    return M.counters(_events(spark, sf), "event_type", "user_id", "event_id")


def _stream(spark, sf):
    return J.source(spark, sf, _events(spark, sf).schema, glob="events.parquet")


def _name(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex}"


@query("ss_journal_state", STATE.format("true"))
def _(spark, sf):
    ops = _stream(spark, sf).select(F.col("event_id").alias("slot"), F.lpad(F.col("user_id").cast("string"), 8, "0").alias("key"), F.col("event_type").alias("value"), (F.col("event_type") == "purchase").alias("is_delete"))
    return J.drained(J.state(ops), _name("state"), "complete").filter("NOT is_delete").select("key", "value", "slot")


@query("ss_window_metrics", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS count, CAST(sum(user_id) AS BIGINT) AS sum, min(user_id) AS min, max(user_id) AS max FROM events GROUP BY ALL")
def _(spark, sf):
    events = _stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = J.drained(J.windows(events, "ts", 86400, "60 days", "event_type", value="user_id"), _name("windows"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("ss_watch", "SELECT event_id AS slot, lpad(CAST(user_id AS VARCHAR), 8, '0') AS key FROM events WHERE starts_with(lpad(CAST(user_id AS VARCHAR), 8, '0'), '0000001')")
def _(spark, sf):
    ops = _stream(spark, sf).select(F.col("event_id").alias("slot"), F.lpad(F.col("user_id").cast("string"), 8, "0").cast("binary").alias("key"))
    at = scratch(spark, "watch")
    J.watch(ops, b"0000001", lambda batch, _: batch.write.mode("append").parquet(at)).awaitTermination()
    return spark.read.schema(ops.schema).parquet(at).select("slot", F.col("key").cast("string").alias("key"))


def _operations(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("slot"), F.lpad(F.col("user_id").cast("string"), 8, "0").cast("binary").alias("key"))


@query("ss_watches", "SELECT CASE WHEN user_id < 100 THEN 'low' ELSE 'high' END AS grp, count(*) AS rows, max(event_id) AS last FROM events WHERE user_id < 200 AND (user_id < 100 OR event_id % 2 = 0) GROUP BY 1")
def _(spark, sf):
    """Two groups watch their prefixes; one unsubscribes after the first half of the journal has come."""
    ops, at = _operations(spark, sf), scratch(spark, "journal")
    out, checkpoint = scratch(spark, "watched"), scratch(spark, "offsets")
    keep = lambda group: lambda batch, _: batch.select(F.lit(group).alias("grp"), "slot").write.mode("append").parquet(out)
    ops.filter("slot % 2 = 0").write.parquet(at)
    watches = J.Watches(J.source(spark, at, ops.schema))
    watches.subscribe("low", b"000000", keep("low"))
    watches.subscribe("high", b"000001", keep("high"))
    watches.start(checkpoint).awaitTermination()
    watches.unsubscribe("high", b"000001")
    ops.filter("slot % 2 <> 0").write.mode("append").parquet(at)
    watches.start(checkpoint).awaitTermination()
    return spark.read.schema("grp string, slot long").parquet(out).groupBy("grp").agg(F.count("*").alias("rows"), F.max("slot").alias("last"))


@query("ss_replay", "SELECT event_id AS slot, lpad(CAST(user_id AS VARCHAR), 8, '0') AS key FROM events")
def _(spark, sf):
    """A journal read in three runs from one checkpoint, the second without anything new: each operation once."""
    ops, at = _operations(spark, sf), scratch(spark, "journal")
    out, checkpoint = scratch(spark, "replayed"), scratch(spark, "offsets")
    for rule in ("slot % 3 = 0", None, "slot % 3 <> 0"):
        if rule is not None:
            ops.filter(rule).write.mode("append").parquet(at)
        J.appended(J.source(spark, at, ops.schema, files_per_trigger=1), out, checkpoint)
    return spark.read.schema(ops.schema).parquet(out).select("slot", F.col("key").cast("string").alias("key"))


@query("ss_chunks", "SELECT event_id AS slot FROM events WHERE event_id % 3 < 2")
def _(spark, sf):
    """A view of a stream of chunks, captured before the last one came."""
    from skein.operators.catalog import Files

    ops = _operations(spark, sf)
    chunks = J.Chunks(Files(spark, scratch(spark, "chunks")), ops.schema)
    for k in range(2):
        chunks.append(ops.filter(F.col("slot") % 3 == k))
    chunks.checkpoint("two", chunks.capture())
    chunks.append(ops.filter("slot % 3 = 2"))
    return chunks.open(chunks.at("two")).select("slot")
