"""Key/value queries: customers by name, and the events table as a journal of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import kv as K
from skein.registry import query


def _items(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_name").cast("binary").alias("key"), F.col("c_acctbal").cast("string").cast("binary").alias("value"), F.col("c_custkey").alias("slot"))


def _journal(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("slot"), F.lpad(F.col("user_id").cast("string"), 8, "0").cast("binary").alias("key"), F.col("event_type").cast("binary").alias("value"), (F.col("event_type") == "purchase").alias("is_delete"))


def _key():
    return F.col("key").cast("string").alias("key")


def _range(name, where, tail="", **bounds):
    @query(name, f"SELECT c_name AS key, c_custkey AS slot FROM customer WHERE {where} ORDER BY c_name {tail}")
    def run(spark, sf):
        return K.scan(_items(spark, sf), **bounds).select(_key(), "slot")


A, B = b"Customer#000000100", b"Customer#000000500"
_range("kv_scan_forward", f"c_name >= '{A.decode()}' AND c_name < '{B.decode()}'", "LIMIT 50", start=A, end=B, limit=50)
_range("kv_scan_reverse", f"c_name >= '{A.decode()}' AND c_name < '{B.decode()}'", "DESC LIMIT 50", start=A, end=B, limit=50, reverse=True)
_range("kv_scan_prefix", "starts_with(c_name, 'Customer#0000000') AND c_name > 'Customer#000000042'", "LIMIT 30", prefix=b"Customer#0000000", start_after=b"Customer#000000042", limit=30)


@query("kv_keys_only", "SELECT c_name AS key FROM customer WHERE starts_with(c_name, 'Customer#00000012')")
def _(spark, sf):
    return K.scan(_items(spark, sf), prefix=b"Customer#00000012", keys_only=True).select(_key())


@query("kv_count", "SELECT count(*) AS n FROM customer WHERE starts_with(c_name, 'Customer#00000')")
def _(spark, sf):
    return K.count(_items(spark, sf), prefix=b"Customer#00000")


@query("kv_page_bytes", "SELECT key, used FROM (SELECT c_name AS key, CAST(sum(octet_length(encode(c_name)) + 8) OVER (ORDER BY c_name) AS BIGINT) AS used FROM customer) WHERE used <= 1000 ORDER BY key LIMIT 200")
def _(spark, sf):
    return K.byte_page(_items(spark, sf), (F.octet_length("key") + 8).cast("long"), 1000, 200).select(_key(), "used")


PROBES = ["Customer#000000000", "Customer#000000007", "Customer#000000100x", "A", "z"]
_VALUES = ", ".join(f"('{p}')" for p in PROBES)


@query("kv_seek4", f"SELECT p AS probe, (SELECT min(c_name) FROM customer WHERE c_name >= p) AS ceiling, (SELECT min(c_name) FROM customer WHERE c_name > p) AS higher, (SELECT max(c_name) FROM customer WHERE c_name <= p) AS floor, (SELECT max(c_name) FROM customer WHERE c_name < p) AS lower FROM (VALUES {_VALUES}) v(p)")
def _(spark, sf):
    probes = spark.createDataFrame([(bytearray(p.encode()),) for p in PROBES], "probe binary")
    out = K.seek(_items(spark, sf), probes)
    return out.select(*(F.col(c).cast("string").alias(c) for c in ("probe", "ceiling", "higher", "floor", "lower")))


@query("kv_newest", "SELECT key, slot, source FROM (SELECT user_id AS key, event_id // 3 AS slot, event_id % 3 AS source, row_number() OVER (PARTITION BY user_id ORDER BY event_id // 3 DESC, event_id % 3) AS n FROM events) WHERE n = 1")
def _(spark, sf):
    e = F.col("event_id")
    return K.newest(spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("key"), F.expr("event_id div 3").alias("slot"), (e % 3).alias("source")))


STATE = "SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, event_type AS value, event_id AS slot FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE {}) WHERE n = 1 AND event_type <> 'purchase'"


def _shown(df):
    return df.select(_key(), F.col("value").cast("string").alias("value"), "slot")


@query("kv_journal_state", STATE.format("true"))
def _(spark, sf):
    return _shown(K.state(_journal(spark, sf)))


@query("kv_snapshot_scan", STATE.format("event_id <= 5000") + " AND user_id < 100")
def _(spark, sf):
    return _shown(K.scan(K.state(_journal(spark, sf), 5000), end=b"00000100"))


@query("kv_journal_range", "SELECT slot, key, true AS truncated, max(slot) OVER () AS last_op_slot FROM (SELECT event_id AS slot, lpad(CAST(user_id AS VARCHAR), 8, '0') AS key FROM events WHERE event_id BETWEEN 100 AND 9000 ORDER BY 1 LIMIT 250)")
def _(spark, sf):
    return K.journal_page(_journal(spark, sf), 100, 9000, 250).select("slot", _key(), "truncated", "last_op_slot")


@query("kv_journal_replay", "SELECT event_id AS slot, lpad(CAST(user_id AS VARCHAR), 8, '0') AS key FROM events WHERE event_id >= 9000")
def _(spark, sf):
    return K.replay_from(_journal(spark, sf), 9000).select("slot", _key())


def _requests(spark, sf, bad):
    i = _items(spark, sf)
    some = i.filter("slot % 100 = 7").select("key", F.when(F.col("slot") % 200 == 7, "slot").otherwise("delete").alias("kind"), F.lit("new").cast("binary").alias("value"), (F.col("slot") + (F.col("slot") == bad).cast("int")).alias("expected_slot"), F.lit(None).cast("binary").alias("expected_value"))
    fresh = spark.createDataFrame([(bytearray(b"fresh"), "absent", bytearray(b"v"), None, None)], some.schema)
    return i, some.union(fresh)


@query("kv_conditional", "SELECT c_name AS key, c_custkey <> 107 AS applied FROM customer WHERE c_custkey % 100 = 7 UNION ALL SELECT 'fresh', true")
def _(spark, sf):
    return K.conditional(*_requests(spark, sf, 107)).select(_key(), "applied")


@query("kv_cas_batch", "SELECT c_name AS key, CASE WHEN c_custkey % 200 = 7 THEN 9999 ELSE c_custkey END AS slot FROM customer WHERE c_custkey % 200 <> 107 UNION ALL SELECT 'fresh', 9999")
def _(spark, sf):
    return K.cas_batch(*_requests(spark, sf, -1), 9999).select(_key(), "slot")


@query("kv_cas_batch_refused", "SELECT c_name AS key, c_custkey AS slot FROM customer")
def _(spark, sf):
    return K.cas_batch(*_requests(spark, sf, 107), 9999).select(_key(), "slot")


@query("kv_range_routing", "SELECT CASE WHEN c_name >= 'Customer#000001000' THEN 'c' WHEN c_name >= 'Customer#000000300' THEN 'b' ELSE 'a' END AS partition, count(*) AS n FROM customer GROUP BY 1")
def _(spark, sf):
    return K.routed(_items(spark, sf), [(b"", "a"), (b"Customer#000000300", "b"), (b"Customer#000001000", "c")]).groupBy("partition").agg(F.count("*").alias("n"))


@query("kv_get", "SELECT 'Customer#' || lpad(CAST(s_suppkey * 37 AS VARCHAR), 9, '0') AS key, c_custkey AS slot FROM supplier LEFT JOIN customer ON c_name = 'Customer#' || lpad(CAST(s_suppkey * 37 AS VARCHAR), 9, '0')")
def _(spark, sf):
    """Reads of single keys, some of which are not there."""
    n = F.lpad((F.col("s_suppkey") * 37).cast("string"), 9, "0")
    keys = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("Customer#"), n).cast("binary").alias("key"))
    return K.get(_items(spark, sf), keys).select(_key(), "slot")


_MANY = "WITH p AS (SELECT DISTINCT 'Customer#' || lpad(CAST(s_suppkey * 37 % 2000 AS VARCHAR), 9, '0') || CASE WHEN s_suppkey % 2 = 0 THEN 'x' ELSE '' END AS p FROM supplier)"


@query("kv_seek_many", f"{_MANY} SELECT p AS probe, min(c_name) FILTER (c_name >= p) AS ceiling, min(c_name) FILTER (c_name > p) AS higher, max(c_name) FILTER (c_name <= p) AS floor, max(c_name) FILTER (c_name < p) AS lower FROM p, customer GROUP BY p")
def _(spark, sf):
    """The nearest keys of many probes, by one range sort."""
    k = F.col("s_suppkey")
    probe = F.concat(F.lit("Customer#"), F.lpad((k * 37 % 2000).cast("string"), 9, "0"), F.when(k % 2 == 0, "x").otherwise(""))
    probes = spark.read.parquet(f"{sf}/supplier.parquet").select(probe.cast("binary").alias("probe"))
    return K.seek(_items(spark, sf), probes).select(*(F.col(c).cast("string").alias(c) for c in ("probe", "ceiling", "higher", "floor", "lower")))


@query("kv_stored_snapshots", "WITH s AS (SELECT (max(event_id) - min(event_id)) // 3 + min(event_id) AS slot FROM events), l AS (SELECT user_id, arg_max(event_type, event_id) AS t, max(event_id) AS slot FROM events WHERE event_id <= (SELECT slot FROM s) GROUP BY user_id) SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, slot FROM l WHERE t <> 'purchase'")
def _(spark, sf):
    """The state that a stored snapshot sees; another one was released."""
    from skein.operators.catalog import Files
    from skein.sources.session import scratch

    journal = _journal(spark, sf)
    low, high = journal.agg(F.min("slot"), F.max("slot")).first()
    s = K.Snapshots(Files(spark, scratch(spark, "snapshots")))
    s.create("third", (high - low) // 3 + low)
    s.create("first", low)
    s.release("first")
    if s.held() != (high - low) // 3 + low or list(s.list()) != ["third"]:
        raise AssertionError("a released snapshot is held")
    return s.state(journal, "third").select(_key(), "slot")
