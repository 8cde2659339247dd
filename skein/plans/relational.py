"""The SQL surface that other engines use on such tables; joins and windows beyond it are Spark's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.registry import query
from skein.sources import files


def _view(spark, sf, *names):
    for n in names:
        spark.read.parquet(f"{sf}/{n}.parquet").createOrReplaceTempView(n)


def _sql(name, text, *tables, spark_text=None):
    @query(name, text)
    def run(spark, sf):
        _view(spark, sf, *tables)
        return spark.sql(spark_text or text)


_sql("sql_count_sum", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders", "orders")
_sql("sql_order_by", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey", "orders")
_sql("sql_filter_project", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 16", "orders")
_sql("sql_join_group", "SELECT n_name, r_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name", "customer", "nation", "region")
_sql("sql_rank", "SELECT c_custkey, rnk FROM (SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rnk FROM customer) WHERE rnk <= 3", "customer")


@query("sql_batch_accumulate", "SELECT CAST(sum(o_custkey * 2) AS BIGINT) AS total FROM orders")
def _(spark, sf):
    """A scalar accumulated over Arrow batches: partial sums of each task, then one sum."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def partial(batches):
        total = 0
        for b in batches:
            total += (pc.sum(b.column("o_custkey")).as_py() or 0) * 2
        yield pa.RecordBatch.from_pydict({"total": pa.array([total], pa.int64())})

    return spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").mapInArrow(partial, "total long").agg(F.sum("total").alias("total"))


@query("src_parquet_footer", "SELECT count(*) AS rows FROM orders")
def _(spark, sf):
    return files.parquet_footers(spark, f"{sf}/orders.parquet").agg(F.sum("rows").alias("rows"))


@query("src_parquet_columns", "SELECT 'o_orderkey' AS \"column\", CAST(min(o_orderkey) AS VARCHAR) AS lower, CAST(max(o_orderkey) AS VARCHAR) AS upper, 0::BIGINT AS nulls FROM orders")
def _(spark, sf):
    chunks = files.parquet_columns(spark, f"{sf}/orders.parquet").filter(F.col("column") == "o_orderkey")
    return chunks.groupBy("column").agg(F.min(F.col("lower").cast("long")).cast("string").alias("lower"), F.max(F.col("upper").cast("long")).cast("string").alias("upper"), F.sum("nulls").alias("nulls"))


@query("src_avro_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, sf):
    from skein.sources import avro
    from skein.sources.session import scratch

    at = scratch(spark, "avro")
    avro.write(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice"), at)
    return avro.read(spark, at, "o_orderkey long, o_orderstatus string, o_totalprice double")


@query("src_deletion_vector", "SELECT l_linenumber % 4 AS file, l_orderkey * 8 + l_linenumber AS pos FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL")
def _(spark, sf):
    from skein.sources import vectors

    rows = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_returnflag = 'R'").select((F.col("l_linenumber") % 4).alias("file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos")).distinct()
    return vectors.decoded(vectors.encoded(rows, "file"), "file")


@query("src_load_verified", "SELECT count(*) AS rows, true AS same FROM part")
def _(spark, sf):
    """Load a table into another place and compare the copies' digests."""
    from skein.sources.session import scratch

    df = spark.read.parquet(f"{sf}/part.parquet")
    df.write.parquet(at := scratch(spark, "load"))
    digest = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    a, b = df.agg(F.count("*").alias("rows"), digest.alias("d")), spark.read.parquet(at).agg(digest.alias("e"))
    return a.withColumn("e", b.scalar()).select("rows", (F.col("d") == F.col("e")).alias("same"))
