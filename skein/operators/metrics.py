"""Mergeable latency histograms, bandwidth windows and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Exact below 2**8, then 2**7 buckets for each power of two, up to 2**40.
EXACT, PER, TOP = 8, 7, 40
OVERFLOW = 2**EXACT + (TOP - EXACT) * 2**PER
QUANTILES = {"p50": 500, "p90": 900, "p95": 950, "p99": 990, "p999": 999}
LARGEST = "18446744073709551615"


def bucket(nanos: Column) -> Column:
    """The histogram bucket of a whole number of nanoseconds."""
    bits = F.length(F.bin(nanos)) - 1
    fine = F.call_function("shiftright", nanos, (bits - PER).cast("int")) - 2**PER
    return F.when(nanos < 2**EXACT, nanos).when(nanos >= 2**TOP, F.lit(OVERFLOW).cast("long")).otherwise(2**EXACT + (bits - EXACT) * 2**PER + fine)


def upper(index: Column) -> Column:
    """The greatest value of a bucket."""
    step = F.floor((index - 2**EXACT) / 2**PER)
    fine = F.pmod(index - 2**EXACT, F.lit(2**PER))
    return F.when(index < 2**EXACT, index).otherwise((fine + 2**PER + 1) * F.pow(F.lit(2.0), step + EXACT - PER).cast("long") - 1)


def histogram(df: DataFrame, nanos: Column, *by: str) -> DataFrame:
    """(by, bucket, count, sum, min, max): a histogram's rows, which merge() adds up."""
    return df.groupBy(*by, bucket(nanos).alias("bucket")).agg(F.count("*").alias("count"), F.sum(nanos).alias("sum"), F.min(nanos).alias("min"), F.max(nanos).alias("max"))


def merge(histograms: DataFrame, *by: str) -> DataFrame:
    return histograms.groupBy(*by, "bucket").agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))


def quantiles(histograms: DataFrame, *by: str) -> DataFrame:
    """Nearest-rank quantiles: a bucket's upper end, at most the greatest value seen; past the top, the largest number."""
    key = list(by) or [F.lit(0)]
    w, order = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("bucket")
    rows = histograms.withColumn("n", F.sum("count").over(w)).withColumn("top", F.max("max").over(w)).withColumn("seen", F.sum("count").over(order))
    value = F.when(F.col("bucket") == OVERFLOW, F.lit(LARGEST).cast("decimal(20,0)")).otherwise(F.least(upper(F.col("bucket")), F.col("top")).cast("decimal(20,0)"))
    first = [F.min(F.when(F.col("seen") >= F.ceil(F.col("n") * q / F.lit(1000)), value)).alias(name) for name, q in QUANTILES.items()]
    return rows.groupBy(*by).agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), *first)


#: Windows of a stretch, in which one task adds them up.
STRETCH = 4096


def bandwidth(df: DataFrame, ts: str, size: Column, seconds: int) -> DataFrame:
    """Tumbling windows with count, whole average size, bytes per second, and the running total: within stretches of windows,
    over the stretches' own running total, of which there are few."""
    rows = df.groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("count"), F.sum(size).alias("bytes"))
    rows = rows.withColumn("stretch", F.floor(F.unix_seconds(F.col("w.start").cast("timestamp")) / (seconds * STRETCH)))
    before = Window.partitionBy(F.lit(0)).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("stretch").agg(F.sum("bytes").alias("s")).select("stretch", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    total = F.col("base") + F.sum("bytes").over(Window.partitionBy("stretch").orderBy("w.start"))
    rows = rows.join(F.broadcast(sums), "stretch")
    return rows.select(F.col("w.start").alias("start"), "count", "bytes", F.floor(F.col("bytes") / F.col("count")).alias("average"), (F.col("bytes") / seconds).alias("rate"), total.alias("total"))


def counters(df: DataFrame, name: str, value: str, order: str) -> DataFrame:
    """Per name: sum, last value in order, count, least, greatest and mean."""
    return df.groupBy(name).agg(F.sum(value).alias("sum"), F.max_by(value, order).alias("last"), F.count("*").alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
