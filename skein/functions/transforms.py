"""Partition transforms, their checks, type promotion, bounds and float order, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01"


def year(c: Column) -> Column:
    return F.year(c) - 1970


def month(c: Column) -> Column:
    return (F.year(c) - 1970) * 12 + F.month(c) - 1


def day(c: Column) -> Column:
    return F.date_diff(c.cast("date"), F.lit(EPOCH).cast("date"))


def hour(c: Column) -> Column:
    return F.floor(F.unix_micros(c.cast("timestamp")) / 3_600_000_000).cast("int")


def truncate_int(c: Column, width: int) -> Column:
    return c - F.pmod(c, F.lit(width))


def truncate_text(c: Column, width: int) -> Column:
    return F.substring(c, 1, width)


def void(c: Column) -> Column:
    return F.lit(None)


def is_bucket(c: Column, buckets: int) -> Column:
    """Whether a stored bucket number is in range; its hash is not recomputed."""
    return (c >= 0) & (c < buckets)


def is_truncated(c: Column, width: int, kind: str) -> Column:
    """Whether a stored partition value can come of truncation to a width: int, string (code points) or binary."""
    if kind == "int":
        return F.pmod(c, F.lit(width)) == 0
    return (F.char_length(c) if kind == "string" else F.octet_length(c)) <= width


#: transform name -> (source kinds, result kind or None for the source's own)
RESULTS = {"identity": None, "bucket": "int", "truncate": None, "year": "int", "month": "int", "day": "date", "hour": "int", "void": None}
TEMPORAL = {"date", "timestamp", "timestamptz", "timestamp_ns", "timestamptz_ns"}


def result_type(transform: str, source: str) -> str:
    """The type of a partition field; raises where the transform does not take the source."""
    name = transform.split("[")[0]
    if name not in RESULTS:
        raise ValueError(f"unknown transform {transform}")
    if name in ("year", "month", "day") and source not in TEMPORAL or name == "hour" and source not in TEMPORAL - {"date"}:
        raise ValueError(f"{name} of {source}")
    if name == "truncate" and source not in ("int", "long", "string", "binary") and not source.startswith("decimal"):
        raise ValueError(f"truncate of {source}")
    if name == "bucket" and source in ("boolean", "float", "double", "variant", "unknown"):
        raise ValueError(f"bucket of {source}")
    return RESULTS[name] or source


def nanos(value: Column, unit: str) -> Column:
    return value * {"ms": 1_000_000, "us": 1000, "ns": 1}[unit]


def is_time_of_day(micros: Column) -> Column:
    return (micros >= 0) & (micros < 86_400_000_000)


def date_bound_micros(days: Column) -> Column:
    """A date bound as one of a timestamp."""
    return days.cast("long") * 86_400_000_000


def float_key(c: Column) -> Column:
    """A key under which all NaN are one and +0 and -0 are two, as partition tuples compare."""
    text = c.cast("double").cast("string")
    return F.when(F.isnan(c.cast("double")), "NaN").otherwise(text)


def promotes(source: str, target: str, version: int = 2) -> bool:
    """Whether a column may change its type so."""
    if source == target or (source, target) in (("int", "long"), ("float", "double")):
        return True
    if source.startswith("decimal") and target.startswith("decimal"):
        (p, s), (q, t) = (tuple(map(int, x[8:-1].split(","))) for x in (source, target))
        return s == t and q >= p
    return version >= 3 and (source == "unknown" or (source, target) in (("date", "timestamp"), ("date", "timestamp_ns")))
