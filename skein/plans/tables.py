"""Versioned-table queries over lineitem, orders and supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import transforms as X
from skein.operators import table as T
from skein.registry import query
from skein.sources.session import sorted_ranges

#: lineitem as the rows of 8 data files: position within the file by order key and line.
LINES = """
WITH l AS (SELECT *, 'f' || (l_orderkey % 8) AS file_path, row_number() OVER (PARTITION BY l_orderkey % 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, l_orderkey % 8 AS data_sequence, l_returnflag AS part FROM lineitem)
"""


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: The order of a file's rows, nulls last as in SQL.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _lines(spark, sf):
    """A range sort by file and order, written once: a row's position is its place among its file's rows in its range, after
    the file's rows in earlier ranges. No task has a whole file."""
    from pyspark.sql.window import Window

    df = _table(spark, sf, "lineitem").select(*ORDER, "l_returnflag", F.concat(F.lit("f"), (F.col("l_orderkey") % 8).cast("string")).alias("file_path"))
    placed = sorted_ranges(df, F.col("file_path").asc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ORDER))
    before = F.sum("n").over(Window.partitionBy("_f").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1))
    parts = placed.groupBy(F.col("_p").alias("_q"), F.col("file_path").alias("_f")).agg(F.min("_i").alias("first"), F.count("*").alias("n"))
    base = F.broadcast(parts.select("_q", "_f", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("_base")))  # a row for each range and file
    rows = placed.join(base, (F.col("_p") == F.col("_q")) & F.col("file_path").eqNullSafe(F.col("_f"))).withColumn("pos", F.col("_i") + F.col("_base"))
    return rows.drop("_p", "_i", "_q", "_f", "_base").withColumn("data_sequence", F.col("l_orderkey") % 8).withColumn("partition", F.col("l_returnflag"))


OUT = ["l_orderkey", "l_linenumber", "file_path", "pos"]
SEL = "SELECT l_orderkey, l_linenumber, file_path, pos FROM l"


@query("tb_position_delete", LINES + SEL + " WHERE NOT (l_linenumber = 3 AND part <> 'N' AND data_sequence <= 5 AND file_path <> 'f2')")
def _(spark, sf):
    rows = _lines(spark, sf)
    deletes = rows.filter("l_linenumber = 3").select("file_path", "pos", F.when(F.col("partition") == "N", "other").otherwise(F.col("partition")).alias("partition"), F.lit(5).alias("delete_sequence"))
    vectors = spark.createDataFrame([("f2", 0, 1)], "file_path string, start long, end long")
    return T.position_deleted(rows, deletes, vectors).select(*OUT)


def _vectors(rows, rule):
    return T.coalesced(rows.filter(rule).select("file_path", "pos"))


@query("tb_deletion_vector", LINES + SEL + " WHERE l_returnflag <> 'R'")
def _(spark, sf):
    rows = _lines(spark, sf)
    return T.vector_deleted(rows, _vectors(rows, "l_returnflag = 'R'")).select(*OUT)


@query("tb_dv_coalesce", LINES + "SELECT file_path, min(pos) AS start, max(pos) + 1 AS \"end\" FROM (SELECT file_path, pos, pos - row_number() OVER (PARTITION BY file_path ORDER BY pos) AS g FROM l WHERE l_returnflag = 'R') GROUP BY file_path, g")
def _(spark, sf):
    return _vectors(_lines(spark, sf), "l_returnflag = 'R'")


@query("tb_dv_contains", LINES + "SELECT file_path, pos, l_returnflag = 'R' AS deleted FROM l")
def _(spark, sf):
    rows = _lines(spark, sf)
    return T.contains(rows.select("file_path", "pos"), _vectors(rows, "l_returnflag = 'R'"))


@query("tb_dv_covers", LINES + "SELECT file_path, pos FROM l WHERE l_returnflag = 'R' AND l_linenumber = 7")
def _(spark, sf):
    rows = _lines(spark, sf)
    return T.uncovered(_vectors(rows, "l_returnflag = 'R'"), _vectors(rows, "l_linenumber <> 7"))


@query("tb_delete_preservation", LINES + "SELECT file_path, pos FROM l WHERE l_returnflag = 'R' AND l_linenumber = 7 AND file_path IN ('f1', 'f4')")
def _(spark, sf):
    rows = _lines(spark, sf)
    kept = spark.createDataFrame([("f1",), ("f4",)], "file_path string")
    return T.uncovered(_vectors(rows, "l_returnflag = 'R'"), _vectors(rows, "l_linenumber <> 7"), kept)


@query("tb_equality_delete", LINES + SEL + " WHERE NOT (l_partkey % 10 = 1 AND l_returnflag = 'A' AND data_sequence < 4)")
def _(spark, sf):
    rows = _lines(spark, sf).withColumn("m", F.when(F.col("l_partkey") % 10 != 0, F.col("l_partkey") % 10))
    deletes = spark.createDataFrame([(1, "A", 4)], "m long, l_returnflag string, delete_sequence long")
    return T.equality_deleted(rows, deletes, ["m", "l_returnflag"]).select(*OUT)


@query("tb_equality_delete_null", LINES + SEL + " WHERE NOT (l_partkey % 10 = 0 AND data_sequence < 4)")
def _(spark, sf):
    rows = _lines(spark, sf).withColumn("m", F.when(F.col("l_partkey") % 10 != 0, F.col("l_partkey") % 10))
    return T.equality_deleted(rows, spark.createDataFrame([(None, 4)], "m long, delete_sequence long"), ["m"]).select(*OUT)


#: Manifest entries made of lineitem: a file per flag, month and supplier group.
ENTRIES = """
WITH e AS (SELECT (l_suppkey % 5) AS m, l_returnflag || (year(l_shipdate)) AS part, l_suppkey % 4 AS content, l_orderkey % 3 AS status, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS bytes FROM lineitem GROUP BY ALL)
"""


def _entries(spark, sf):
    df = _table(spark, sf, "lineitem")
    key = [(F.col("l_suppkey") % 5).alias("manifest"), F.concat(F.col("l_returnflag"), F.year("l_shipdate").cast("string")).alias("partition"), (F.col("l_suppkey") % 4).alias("content"), (F.col("l_orderkey") % 3).alias("status")]
    return df.groupBy(*key).agg(F.count("*").alias("record_count"), F.sum("l_quantity").cast("long").alias("file_bytes")).withColumn("spec_id", F.lit(0))


@query("tb_live_entries", ENTRIES + "SELECT m AS manifest, part AS partition, content, status, n AS record_count FROM e WHERE status <> 2")
def _(spark, sf):
    return T.live(_entries(spark, sf)).select("manifest", "partition", "content", "status", "record_count")


@query("tb_manifest_totals", ENTRIES + "SELECT m AS manifest, " + ", ".join(f"count(*) FILTER (status = {s}) AS {n}_files, CAST(coalesce(sum(n) FILTER (status = {s}), 0) AS BIGINT) AS {n}_rows" for s, n in enumerate(("existing", "added", "deleted"))) + " FROM e GROUP BY m")
def _(spark, sf):
    return T.manifest_totals(_entries(spark, sf))


@query("tb_snapshot_scan", ENTRIES + "SELECT m AS manifest, part AS partition, content, n AS record_count, CASE WHEN content = 0 THEN 99 ELSE m + 10 END AS data_sequence FROM e WHERE status <> 2 AND m IN (1, 3)")
def _(spark, sf):
    manifests = spark.createDataFrame([(1, 7, 11, 5), (3, 7, 13, 6), (2, 8, 12, 7)], "manifest long, snapshot_id long, sequence long, added_by long")
    entries = _entries(spark, sf).withColumn("data_sequence", F.when(F.col("content") == 0, 99).cast("long")).withColumn("added_by", F.lit(None).cast("long"))
    return T.scan(manifests, entries, 7).select("manifest", "partition", "content", "record_count", "data_sequence")


_STATS = """SELECT part AS partition, 0 AS spec_id, coalesce(sum(n) FILTER (content = 0), 0)::BIGINT AS data_records, count(*) FILTER (content = 0) AS data_files, coalesce(sum(bytes) FILTER (content = 0), 0)::BIGINT AS data_bytes,
coalesce(sum(n) FILTER (content IN (1, 3)), 0)::BIGINT AS position_delete_records, count(*) FILTER (content = 1) AS position_delete_files, coalesce(sum(n) FILTER (content = 2), 0)::BIGINT AS equality_delete_records, count(*) FILTER (content = 2) AS equality_delete_files, count(*) FILTER (content = 3) AS vectors,
CASE WHEN count(*) FILTER (content IN (1, 2)) = 0 THEN coalesce(sum(n) FILTER (content = 0), 0)::BIGINT - coalesce(sum(n) FILTER (content IN (1, 3)), 0)::BIGINT END AS total_records FROM e WHERE status <> 2"""


@query("tb_partition_stats", f"{ENTRIES} {_STATS} GROUP BY part")
def _(spark, sf):
    return T.partition_statistics(_entries(spark, sf))


@query("tb_total_records", f"{ENTRIES} {_STATS} AND content IN (0, 3) GROUP BY part")
def _(spark, sf):
    return T.partition_statistics(_entries(spark, sf).filter("content IN (0, 3)"))


@query("tb_stats_validity", f"{ENTRIES}, s AS ({_STATS} AND content IN (0, 3) GROUP BY part) SELECT partition, coalesce(total_records BETWEEN 0 AND data_records, true) AS valid FROM s")
def _(spark, sf):
    return T.partition_statistics(_entries(spark, sf).filter("content IN (0, 3)")).select("partition", T.valid_statistics().alias("valid"))


@query("tb_stats_compare", f"{ENTRIES}, s AS ({_STATS} GROUP BY part) SELECT partition, CASE WHEN partition LIKE 'A%' THEN 'missing' WHEN partition LIKE 'N%' THEN 'different' END AS problem FROM s WHERE partition LIKE 'A%' OR partition LIKE 'N%'")
def _(spark, sf):
    counted = T.partition_statistics(_entries(spark, sf))
    stored = counted.filter("partition NOT LIKE 'A%'").withColumn("data_files", F.col("data_files") + F.col("partition").startswith("N").cast("int"))
    return T.compared(stored, counted, ["partition"], ["data_records", "data_files", "vectors"])


@query("tb_poisoned_sum", "SELECT l_returnflag, CASE WHEN l_returnflag = 'A' THEN NULL ELSE CAST(sum(l_linenumber) AS BIGINT) END AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    n = F.when((F.col("l_returnflag") != "A") | (F.col("l_linenumber") > 1), F.col("l_linenumber"))
    return _table(spark, sf, "lineitem").groupBy("l_returnflag").agg(T.poisoned_sum(n).alias("n"))


_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "n"]


def _metric_sql(c, nans=False):
    return f"SELECT '{c}' AS \"column\", count(*) AS values, count(*) - count({c}) AS nulls, {'count(*) FILTER (isnan(' + c + '))' if nans else '0::BIGINT'} AS nans, {{0}} AS lower, {{1}} AS upper FROM t"


_METRICS = "WITH t AS (SELECT *, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'nan'::DOUBLE ELSE l_quantity END AS n FROM lineitem) "
_UNION = " UNION ALL ".join(_metric_sql(c, c in ("l_quantity", "n")).format(*((f"CAST({f}({c}) AS VARCHAR)" if c != "n" else f"CAST({f}(n) FILTER (NOT isnan(n)) AS VARCHAR)") for f in ("min", "max"))) for c in _COLS)


def _metered(spark, sf):
    n = F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).when(F.col("l_linenumber") != 1, F.col("l_quantity"))
    return _table(spark, sf, "lineitem").withColumn("n", n)


@query("tb_column_metrics", _METRICS + _UNION)
def _(spark, sf):
    return T.column_metrics(_metered(spark, sf), _COLS)


@query("tb_partition_summary", f"{_METRICS}, u AS ({_UNION}) SELECT \"column\", nulls > 0 AS contains_null, nans > 0 AS contains_nan, lower, upper FROM u WHERE \"column\" IN ('l_returnflag', 'n')".replace(") , u", "), u"))
def _(spark, sf):
    return T.partition_summary(_metered(spark, sf), ["l_returnflag", "n"])


@query("tb_snapshot_summary", ENTRIES + "SELECT count(*) FILTER (content = 0) AS data_files, sum(n) FILTER (content = 0)::BIGINT AS data_rows, sum(n) FILTER (content <> 0)::BIGINT AS delete_rows, count(*) FILTER (content = 2) AS equality_files, count(*) FILTER (content = 1) AS position_files, count(*) FILTER (content = 3) AS vectors, sum(bytes)::BIGINT AS bytes FROM e WHERE status <> 2")
def _(spark, sf):
    return T.snapshot_summary(_entries(spark, sf))


@query("tb_position_delete_summary", LINES + "SELECT count(*) AS rows, count(*) FILTER (file_path <> 'f3') AS applicable_rows, count(DISTINCT file_path) AS targets FROM l WHERE l_linenumber = 3")
def _(spark, sf):
    rows = _lines(spark, sf)
    return T.position_delete_summary(rows.filter("l_linenumber = 3"), rows.filter("file_path <> 'f3'"))


@query("tb_transforms", "SELECT o_orderkey, year(o_orderdate)::INT - 1970 AS y, ((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1)::INT AS m, (CAST(o_orderdate AS DATE) - DATE '1970-01-01')::INT AS d, CAST(floor(epoch_us(o_orderdate) / 3600000000) AS INT) AS h, o_custkey - o_custkey % 100 AS t, o_orderpriority[1:3] AS s FROM orders")
def _(spark, sf):
    d = F.col("o_orderdate")
    return _table(spark, sf, "orders").select("o_orderkey", X.year(d).alias("y"), X.month(d).alias("m"), X.day(d).alias("d"), X.hour(d).alias("h"), X.truncate_int(F.col("o_custkey"), 100).alias("t"), X.truncate_text(F.col("o_orderpriority"), 3).alias("s"))


@query("tb_transform_checks", "SELECT o_orderkey, o_custkey % 40 < 32 AS bucketed, o_custkey % 5 = 0 AS whole, length(o_orderpriority) <= 6 AS short FROM orders")
def _(spark, sf):
    return _table(spark, sf, "orders").select("o_orderkey", X.is_bucket(F.col("o_custkey") % 40, 32).alias("bucketed"), X.is_truncated(F.col("o_custkey"), 5, "int").alias("whole"), X.is_truncated(F.col("o_orderpriority"), 6, "string").alias("short"))


@query("tb_partition_equality", "SELECT l_orderkey, l_linenumber, l_linenumber <> 5 AS same FROM lineitem")
def _(spark, sf):
    n = F.col("l_linenumber")
    odd = F.when(n == 2, F.lit(float("nan"))).when(n == 3, F.lit(None).cast("double")).otherwise(F.lit(0.0))
    rows = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", odd.alias("a"), n.cast("int").alias("b"), F.when(n == 5, F.lit(-0.0)).otherwise(odd).alias("c"), n.cast("long").alias("d"))
    return rows.select("l_orderkey", "l_linenumber", (T.partition_key({"a": "double", "b": "int"}) == T.partition_key({"c": "double", "d": "long"})).alias("same"))


FILES = "WITH f AS (SELECT l_suppkey % 4 AS manifest, l_suppkey AS pos, count(*) AS n, CASE WHEN l_suppkey % 5 = 0 THEN l_suppkey * 1000 END AS given FROM lineitem GROUP BY ALL)"


@query("tb_row_ids", f"{FILES} SELECT manifest, pos, CAST(coalesce(given, 500 + coalesce(sum(CASE WHEN given IS NULL THEN n ELSE 0 END) OVER (PARTITION BY manifest ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS row_id FROM f")
def _(spark, sf):
    s = F.col("l_suppkey")
    files = _table(spark, sf, "lineitem").groupBy((s % 4).alias("manifest"), s.alias("pos")).agg(F.count("*").alias("record_count")).withColumn("first_row_id", F.when(F.col("pos") % 5 == 0, F.col("pos") * 1000))
    return T.row_ids(files, 500).select("manifest", "pos", "row_id")


@query("tb_row_id_gaps", "WITH r AS (SELECT l_suppkey AS s, l_suppkey * 10 AS a, l_suppkey * 10 + CASE WHEN l_suppkey % 9 = 0 THEN 9 ELSE 10 END AS b FROM lineitem GROUP BY 1) SELECT a AS start, b AS \"end\" FROM r WHERE (s - 1) % 9 = 0 AND s > (SELECT min(s) FROM r)")
def _(spark, sf):
    s = F.col("l_suppkey")
    ranges = _table(spark, sf, "lineitem").select(s).distinct().select(F.lit("t").alias("table"), (s * 10).alias("start"), (s * 10 + F.when(s % 9 == 0, 9).otherwise(10)).alias("end"))
    return T.gaps(ranges).select("start", "end")


@query("tb_sorted_check", "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) WHERE b > l_shipdate")
def _(spark, sf):
    rows = _table(spark, sf, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return T.unsorted(rows, "l_orderkey", "o", "l_shipdate").select("l_orderkey", "l_linenumber")


@query("tb_refs_mode", "SELECT DISTINCT o_custkey AS snapshot_id FROM orders WHERE o_custkey IN (1, 4, 7, 10)")
def _(spark, sf):
    refs = spark.createDataFrame([(1, "main"), (4, "tag"), (7, "branch"), (1, "alias")], "snapshot_id long, name string")
    return T.referenced(_table(spark, sf, "orders").select(F.col("o_custkey").alias("snapshot_id")).distinct(), refs, 10)


@query("tb_schema_promotion", "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS nation, s_name AS label, CAST(NULL AS VARCHAR) AS extra FROM supplier")
def _(spark, sf):
    from skein.sources.evolution import Field, read_as

    fields = [Field(1, "s_suppkey", "long"), Field(2, "nation", "long"), Field(3, "label", "string"), Field(9, "extra", "string")]
    return read_as(_table(spark, sf, "supplier"), {1: "s_suppkey", 2: "s_nationkey", 3: "s_name"}, fields)


@query("tb_initial_default", "SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN CASE WHEN s_nationkey % 4 = 0 THEN NULL ELSE s_acctbal END ELSE 5.5 END AS balance FROM supplier")
def _(spark, sf):
    from skein.sources.evolution import Field, read_as

    df = _table(spark, sf, "supplier").withColumn("s_acctbal", F.when(F.col("s_nationkey") % 4 != 0, F.col("s_acctbal")))
    fields = [Field(1, "s_suppkey", "long"), Field(2, "balance", "double", 5.5)]
    new, old = df.filter("s_nationkey % 2 = 0"), df.filter("s_nationkey % 2 <> 0").drop("s_acctbal")
    return read_as(new, {1: "s_suppkey", 2: "s_acctbal"}, fields).unionByName(read_as(old, {1: "s_suppkey"}, fields))


@query("tb_bound_promotion", "SELECT o_orderkey, epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS bound, epoch_us(o_orderdate) * 1000 AS ns FROM orders")
def _(spark, sf):
    d = F.col("o_orderdate")
    return _table(spark, sf, "orders").select("o_orderkey", X.date_bound_micros(X.day(d)).alias("bound"), X.nanos(F.unix_micros(d.cast("timestamp")), "us").alias("ns"))


GC = "WITH f AS (SELECT DISTINCT l_suppkey % 50 AS k FROM lineitem), r AS (SELECT 'list' || (k % 3) AS path FROM f WHERE k % 3 < 2 UNION SELECT 'm' || (k % 9) FROM f WHERE k % 3 < 2 UNION SELECT 'file' || k FROM f WHERE k % 3 < 2)"


def _files(spark, sf):
    k = F.col("k")
    f = _table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("k")).distinct()

    def name(prefix, c):
        return F.concat(F.lit(prefix), c.cast("string"))

    lists = f.select(name("list", k % 3).alias("list")).distinct()
    manifests = f.select(name("list", k % 3).alias("list"), name("m", k % 9).alias("manifest")).distinct()
    entries = f.select(name("m", k % 9).alias("manifest"), name("file", k).alias("file_path"))
    stored = lists.select(F.col("list").alias("path")).union(manifests.select("manifest").distinct()).union(entries.select("file_path"))
    return T.reachable_files(lists.filter("list <> 'list2'"), manifests, entries), stored


@query("tb_gc_reachable", f"{GC} SELECT path FROM r")
def _(spark, sf):
    return _files(spark, sf)[0]


@query("tb_gc_candidates", f"{GC} SELECT path FROM (SELECT 'list' || (k % 3) AS path FROM f UNION SELECT 'm' || (k % 9) FROM f UNION SELECT 'file' || k FROM f) EXCEPT SELECT path FROM r")
def _(spark, sf):
    reachable, stored = _files(spark, sf)
    return T.garbage(stored, reachable)
