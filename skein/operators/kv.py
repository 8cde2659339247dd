"""Ordered key/value operators over items(key, value, slot) and journal(slot, key, value, is_delete)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.predicates import has_prefix
from skein.sources.session import sorted_ranges


def scan(items: DataFrame, *, prefix: bytes = b"", start: bytes | None = None, start_after: bytes | None = None, end: bytes | None = None, limit: int | None = None, reverse: bool = False, keys_only: bool = False) -> DataFrame:
    """Items of a half-open key range, in key order. Reverse: `start` is the lower bound, `end` the exclusive upper one."""
    key = F.col("key")
    out = items.filter(has_prefix(key, prefix)) if prefix else items
    for bound, rule in ((start, key >= F.lit(start)), (start_after, key > F.lit(start_after)), (end, key < F.lit(end))):
        out = out.filter(rule) if bound is not None else out
    out = out.orderBy(key.desc() if reverse else key)
    out = out if limit is None else out.limit(limit)
    return out.select("key") if keys_only else out


def count(items: DataFrame, **bounds) -> DataFrame:
    return scan(items, **bounds).agg(F.count("*").alias("n"))


def byte_page(items: DataFrame, size: Column, budget: int, max_items: int) -> DataFrame:
    """The leading items that fit a byte budget; an oversized first item leaves an empty, truncated page. The page is cut
    from the first max_items by key, so the running sum is bounded."""
    head = items.orderBy("key").limit(max_items)
    used = F.sum(size).over(Window.partitionBy(F.lit(0)).orderBy("key"))
    return head.withColumn("used", used).filter(F.col("used") <= budget)


#: Probes that one pass of aggregates answers.
FEW_PROBES = 16


def seek(items: DataFrame, probes: DataFrame) -> DataFrame:
    """probe, ceiling, higher, floor and lower keys: the nearest at or above, above, at or below, below each probe.

    A few probes are aggregates of one pass over the keys, without a sort. More are merged with the keys by one range sort:
    a running maximum and minimum in each range, carried over by the ranges' ends; neither side is paired with the other."""
    few = [bytes(r[0]) for r in probes.select("probe").filter("probe IS NOT NULL").distinct().limit(FEW_PROBES + 1).collect()]
    if few and len(few) <= FEW_PROBES and not probes.filter("probe IS NULL").limit(1).count():
        key = F.col("key")
        found = [F.struct(F.lit(p).alias("probe"), F.min(F.when(key >= F.lit(p), key)).alias("ceiling"), F.min(F.when(key > F.lit(p), key)).alias("higher"), F.max(F.when(key <= F.lit(p), key)).alias("floor"), F.max(F.when(key < F.lit(p), key)).alias("lower")) for p in few]
        return items.agg(F.array(*found).alias("f")).select(F.inline("f"))
    every = items.select("key", F.lit(False).alias("asked")).union(probes.select(F.col("probe").alias("key"), F.lit(True).alias("asked"))).distinct()
    placed = sorted_ranges(every, "key")
    own = F.when(~F.col("asked"), F.col("key"))
    edges = placed.groupBy("_p").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    # Frames grow at their end only, the way back too: one that shrinks is read anew for every row.
    back, ranges = Window.unboundedPreceding, Window.partitionBy(F.lit(0))  # a row for each range
    before, after = ranges.orderBy("_p").rowsBetween(back, -1), ranges.orderBy(F.desc("_p")).rowsBetween(back, -1)
    edges = F.broadcast(edges.select("_p", F.max("last").over(before).alias("down"), F.min("first").over(after).alias("up")))
    up, down = Window.partitionBy("_p").orderBy("key"), Window.partitionBy("_p").orderBy(F.desc("key"))
    steps = placed.select("_p", "key", "asked", own.alias("own")).groupBy("_p", "key").agg(F.bool_or("asked").alias("asked"), F.min("own").alias("own"))
    near = {"ceiling": F.min("own").over(down.rowsBetween(back, 0)), "higher": F.min("own").over(down.rowsBetween(back, -1)), "floor": F.max("own").over(up.rowsBetween(back, 0)), "lower": F.max("own").over(up.rowsBetween(back, -1))}
    found = steps.select("_p", "key", "asked", *(c.alias(n) for n, c in near.items())).filter("asked").join(edges, "_p")
    return found.select(F.col("key").alias("probe"), *(F.when(F.col("key").isNotNull(), F.coalesce(n, "up" if n in ("ceiling", "higher") else "down")).alias(n) for n in near))


def get(items: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value, slot) of keys(key): value and slot are null for a key that is not there."""
    return keys.select("key").distinct().join(items.select("key", "value", "slot"), "key", "left")


def newest(sources: DataFrame) -> DataFrame:
    """One row per key of (key, value, slot, source): the highest slot wins, of equals the lowest source."""
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("slot"), "source"))
    return sources.withColumn("_n", best).filter("_n = 1").drop("_n")


def state(journal: DataFrame, up_to: int | None = None) -> DataFrame:
    """(key, value, slot): the live items after the journal's operations, up to a slot."""
    seen = journal if up_to is None else journal.filter(F.col("slot") <= up_to)
    last = seen.groupBy("key").agg(F.max_by(F.struct("value", "is_delete", "slot"), "slot").alias("l"))
    return last.filter("NOT l.is_delete").select("key", "l.value", "l.slot")


class Snapshots:
    """Named slots of a journal in a folder: a read by name sees the operations up to its slot. Released names are gone; the
    journal may be cut before the least slot that is held."""

    def __init__(self, files):
        self.files = files

    def create(self, name: str, slot: int) -> None:
        self.files.create(f"snapshots/{name}.json", json.dumps({"slot": slot}))

    def list(self) -> dict[str, int]:
        return {n[:-5]: json.loads(self.files.read(f"snapshots/{n}"))["slot"] for n in self.files.names("snapshots") if n.endswith(".json")}

    def release(self, name: str) -> bool:
        return self.files.remove(f"snapshots/{name}.json")

    def held(self) -> int | None:
        return min(self.list().values(), default=None)

    def state(self, journal: DataFrame, name: str) -> DataFrame:
        return state(journal, self.list()[name])


def journal_page(journal: DataFrame, low: int, high: int, limit: int, prefix: bytes = b"") -> DataFrame:
    """Operations of a slot range in slot order, with whether the page is cut and its last slot."""
    rows = journal.filter(F.col("slot").between(low, high))
    rows = rows.filter(has_prefix(F.col("key"), prefix)) if prefix else rows
    page = rows.orderBy("slot").limit(limit + 1)
    w = Window.partitionBy(F.lit(0))
    page = page.withColumn("_n", F.row_number().over(w.orderBy("slot"))).withColumn("truncated", F.count("*").over(w) > limit).filter(F.col("_n") <= limit)
    return page.withColumn("last_op_slot", F.max("slot").over(w)).drop("_n")


class Gap(ValueError):
    """The journal no longer has the asked slots: rebuild from a full scan."""


def replay_from(journal: DataFrame, slot: int) -> DataFrame:
    first = journal.agg(F.min("slot")).first()[0]
    if first is not None and slot < first:
        raise Gap(f"slots before {first} are gone")
    return journal.filter(F.col("slot") >= slot).orderBy("slot")


def conditional(items: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(key, kind, value, expected_slot, expected_value) with `applied`: kinds put, absent, slot, value, delete."""
    now = items.select("key", F.col("value").alias("_v"), F.col("slot").alias("_s"))
    rule = F.when(F.col("kind") == "put", True).when(F.col("kind") == "absent", F.col("_s").isNull()).when(F.col("kind").isin("slot", "delete"), F.coalesce(F.col("_s") == F.col("expected_slot"), F.lit(False))).when(F.col("kind") == "value", F.coalesce(F.col("_v") == F.col("expected_value"), F.lit(False)))
    return requests.join(now, "key", "left").withColumn("applied", F.coalesce(rule, F.lit(False))).drop("_v", "_s")


def cas_batch(items: DataFrame, requests: DataFrame, slot: int) -> DataFrame:
    """Items after a batch of compare-and-set operations; unless all conditions hold, nothing changes."""
    checked = conditional(items, requests)
    ok = checked.agg(F.bool_and("applied").alias("ok")).scalar()
    done = checked.filter(ok).select("key", "value", F.lit(slot).cast("long").alias("slot"), (F.col("kind") == "delete").alias("_d"))
    return items.join(done, "key", "left_anti").select("key", "value", "slot").union(done.filter("NOT _d").select("key", "value", "slot"))


def routed(items: DataFrame, ranges: list[tuple[bytes, str]]) -> DataFrame:
    """items with the partition whose range starts last at or before the key; ranges are sorted starts."""
    out = None
    for start, name in sorted(ranges, reverse=True):
        out = F.when(F.col("key") >= F.lit(start), name) if out is None else out.when(F.col("key") >= F.lit(start), name)
    return items.withColumn("partition", out)
