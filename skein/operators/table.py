"""Versioned tables: scans of manifests, delete files, row ids, statistics and their checks.

Forms: entries(snapshot_id, status, content, file_path, spec_id, partition, record_count, data_sequence, file_bytes,
first_row_id) with status 0 existing, 1 added, 2 deleted, and content 0 data, 1 position deletes, 2 equality deletes, 3
deletion vector; rows(file_path, pos, ...); vectors(file_path, start, end) as half-open ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.transforms import float_key


def live(entries: DataFrame) -> DataFrame:
    return entries.filter("status <> 2")


def scan(manifests: DataFrame, entries: DataFrame, snapshot_id: int) -> DataFrame:
    """Live entries of the manifests in a snapshot's list; missing sequences and snapshot ids come from the manifest."""
    own = manifests.filter(F.col("snapshot_id") == snapshot_id).select("manifest", F.col("sequence").alias("_s"), F.col("added_by").alias("_a"))
    found = live(entries).join(own, "manifest")
    return found.withColumn("data_sequence", F.coalesce("data_sequence", "_s")).withColumn("added_by", F.coalesce("added_by", "_a")).drop("_s", "_a")


def manifest_totals(entries: DataFrame) -> DataFrame:
    """Counts of each manifest by status, as its list entry must have them."""
    return entries.groupBy("manifest").agg(*(F.count_if(F.col("status") == s).alias(f"{n}_files") for s, n in enumerate(("existing", "added", "deleted"))), *(F.sum(F.when(F.col("status") == s, F.col("record_count")).otherwise(0)).alias(f"{n}_rows") for s, n in enumerate(("existing", "added", "deleted"))))


def as_of(rows: DataFrame, chain: DataFrame, column: str = "snapshot_id") -> DataFrame:
    """Rows that a snapshot sees: those of the snapshots (id) of its chain of parents."""
    return rows.join(F.broadcast(chain.select(F.col("id").alias(column))), column, "left_semi")


def position_deleted(rows: DataFrame, deletes: DataFrame, with_vector: DataFrame | None = None) -> DataFrame:
    """rows(file_path, pos, data_sequence, partition) without those that (delete_sequence, partition, file_path, pos) deletes:
    data no newer than the delete, same partition, and no vector on the file."""
    d = deletes if with_vector is None else deletes.join(with_vector.select("file_path").distinct(), "file_path", "left_anti")
    d = d.select(F.col("file_path").alias("_f"), F.col("pos").alias("_p"), F.col("partition").alias("_q"), "delete_sequence")
    return rows.join(d, (F.col("file_path") == F.col("_f")) & (F.col("pos") == F.col("_p")) & F.col("partition").eqNullSafe(F.col("_q")) & (F.col("data_sequence") <= F.col("delete_sequence")), "left_anti")


#: Positions of a block, as a power of two: ranges and positions meet by file and block.
BITS = 16
BLOCK = 1 << BITS


def _block(pos: Column) -> Column:
    return F.shiftright(pos, BITS)


def _blocked(vectors: DataFrame) -> DataFrame:
    """(_f, _b, _from, _to): the ranges cut at blocks, a row for each block that they reach."""
    blocks = F.sequence(_block(F.col("start")), _block(F.col("end") - 1))
    rows = vectors.filter("end > start").select(F.col("file_path").alias("_f"), "start", "end", F.explode(blocks).alias("_b"))
    return rows.select("_f", "_b", F.greatest("start", F.col("_b") * BLOCK).alias("_from"), F.least("end", (F.col("_b") + 1) * BLOCK).alias("_to"))


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt in as many parts as the session's shuffles have: positions shrink so much on the way that parts put together by
    their bytes would have millions of rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _covered(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """rows(file_path, pos, ...) with `_in`, whether a range of their file has the position, and `_again`, whether the row before
    has the same one. Both sides are sorted together in
    each block: a position is in a range if the greatest end of those that start before it is beyond it. So each row and
    range is read once, and neither is paired with the other."""
    cut = _blocked(vectors)
    own = rows.select(*rows.columns, F.col("file_path").alias("_f"), _block(F.col("pos")).alias("_b"), F.col("pos").alias("_from"), F.lit(None).cast("long").alias("_to"), F.lit(True).alias("_row"))
    ends = cut.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema), "_f", "_b", "_from", "_to", F.lit(False).alias("_row"))
    w = Window.partitionBy("_f", "_b").orderBy("_from", "_row")
    reach = F.max("_to").over(w.rowsBetween(Window.unboundedPreceding, 0)) > F.col("_from")
    again = F.lag("_row").over(w) & F.lag("_from").over(w).eqNullSafe(F.col("_from"))
    met = _dealt(own.union(ends), "_f", "_b").withColumn("_in", F.col("_f").isNotNull() & F.coalesce(reach, F.lit(False))).withColumn("_again", F.coalesce(again, F.lit(False)))
    return met.filter("_row").select(*rows.columns, "_in", "_again")


def vector_deleted(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """rows without the positions of their file's deletion vector."""
    return _covered(rows, vectors).filter("NOT _in").drop("_in", "_again")


def equality_deleted(rows: DataFrame, deletes: DataFrame, columns: list[str]) -> DataFrame:
    """rows without those whose columns equal a delete's, nulls too, and that are older than the delete."""
    d = deletes.select(*(F.col(c).alias(f"_{c}") for c in columns), "delete_sequence")
    match = F.col("data_sequence") < F.col("delete_sequence")
    for c in columns:
        match &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(d, match, "left_anti")


def contains(probes: DataFrame, vectors: DataFrame) -> DataFrame:
    """probes(file_path, pos) with whether the file's vector has the position."""
    return _covered(probes.select("file_path", "pos"), vectors).filter("NOT _again").select("file_path", "pos", F.col("_in").alias("deleted"))


def coalesced(positions: DataFrame) -> DataFrame:
    """(file_path, start, end): positions as maximal half-open ranges. Runs are found in each block; those that touch a block's
    edge, two in a block at most, are then joined in each file."""
    island = F.col("pos") - F.dense_rank().over(Window.partitionBy("file_path", "_b").orderBy("pos"))
    placed = _dealt(positions.select("file_path", "pos", _block(F.col("pos")).alias("_b")), "file_path", "_b")
    runs = placed.withColumn("_g", island).groupBy("file_path", "_b", "_g").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    edge = F.coalesce((F.col("start") == F.col("_b") * BLOCK) | (F.col("end") == (F.col("_b") + 1) * BLOCK), F.lit(False))
    w = Window.partitionBy("file_path").orderBy("start")
    begins = F.when(F.lag("end").over(w) == F.col("start"), 0).otherwise(1)
    joined = runs.filter(edge).withColumn("_n", begins).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("file_path", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.filter(~edge).select("file_path", "start", "end").union(joined.select("file_path", "start", "end"))


def uncovered(previous: DataFrame, replacement: DataFrame, surviving: DataFrame | None = None) -> DataFrame:
    """Positions of previous vectors that their replacements do not have: must be none for surviving files. The ranges' ends
    are swept in each block, and only what is not covered becomes positions."""
    old = previous if surviving is None else previous.join(surviving.select("file_path").distinct(), "file_path", "left_semi")
    ends = [_blocked(v).select("_f", "_b", F.explode(F.array(*(F.struct(F.col(c).alias("at"), F.lit(n if mine else 0).alias("old"), F.lit(0 if mine else n).alias("new")) for c, n in (("_from", 1), ("_to", -1))))).alias("e")) for v, mine in ((old, True), (replacement.filter("file_path IS NOT NULL"), False))]
    w = Window.partitionBy("_f", "_b").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = _dealt(ends[0].union(ends[1]).select("_f", "_b", "e.*"), "_f", "_b").select("_f", "at", F.lead("at").over(w).alias("next"), F.sum("old").over(upto).alias("old"), F.sum("new").over(upto).alias("new"))
    bare = swept.filter("old > 0 AND new = 0 AND next > at")
    return bare.select(F.col("_f").alias("file_path"), F.explode(F.sequence("at", F.col("next") - 1)).alias("pos"))


def partition_key(columns: dict[str, str]) -> Column:
    """A key of partition tuples: null is a value, all NaN are one, signed zeros are two, int and long as well as float and
    double compare by value, decimals only at one scale."""
    parts = [F.coalesce(float_key(F.col(c)) if kind in ("float", "double") else F.concat(F.lit(f"{kind[kind.find(','):]}:" if kind.startswith("decimal") else ""), F.col(c).cast("string")), F.lit("\0null")) for c, kind in columns.items()]
    return F.to_json(F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts))))


# --- statistics -------------------------------------------------------------------------------------------------


def poisoned_sum(c: Column) -> Column:
    """A sum that one null makes unknown."""
    return F.when(F.count(c) == F.count("*"), F.sum(c))


def partition_statistics(entries: DataFrame) -> DataFrame:
    """For each partition and spec: counts of data, position-delete and equality-delete files and rows, and of vectors."""
    data, pos, eq, dv = (F.col("content") == k for k in range(4))

    def rows(rule: Column) -> Column:
        return F.coalesce(F.sum(F.when(rule, F.col("record_count"))), F.lit(0))

    out = live(entries).groupBy("partition", "spec_id").agg(rows(data).alias("data_records"), F.count_if(data).alias("data_files"), F.coalesce(F.sum(F.when(data, F.col("file_bytes"))), F.lit(0)).alias("data_bytes"), rows(pos | dv).alias("position_delete_records"), F.count_if(pos).alias("position_delete_files"), rows(eq).alias("equality_delete_records"), F.count_if(eq).alias("equality_delete_files"), F.count_if(dv).alias("vectors"))
    return out.withColumn("total_records", F.when((F.col("position_delete_files") == 0) & (F.col("equality_delete_files") == 0), F.col("data_records") - F.col("position_delete_records")))


def valid_statistics() -> Column:
    names = ("data_records", "data_files", "data_bytes", "position_delete_records", "position_delete_files", "equality_delete_records", "equality_delete_files", "vectors")
    ok = F.coalesce(F.col("total_records").between(0, F.col("data_records")), F.lit(True))
    for n in names:
        ok &= F.col(n) >= 0
    empty = (F.col("data_files") > 0) | ((F.col("data_records") == 0) & (F.col("data_bytes") == 0))
    for k in ("position", "equality"):
        some = (F.col(f"{k}_delete_files") > 0) | (F.col(f"{k}_delete_records") == 0)
        empty &= some | (F.col("vectors") > 0) if k == "position" else some
    return ok & empty


def compared(stored: DataFrame, counted: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys whose values differ or that one side lacks."""
    left = stored.select(*key, F.struct(*values).alias("_l"))
    right = counted.select(*key, F.struct(*values).alias("_r"))
    return left.join(right, key, "full").filter(~F.col("_l").eqNullSafe(F.col("_r"))).select(*key, F.when(F.col("_l").isNull(), "missing").when(F.col("_r").isNull(), "extra").otherwise("different").alias("problem"))


def column_metrics(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: value, null and nan counts and bounds, as text."""
    kinds = dict(df.dtypes)
    parts = []
    for c in columns:
        nan = F.count_if(F.isnan(c)) if kinds[c] in ("double", "float") else F.lit(0).cast("long")
        solid = F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
        parts.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("values"), F.count_if(F.col(c).isNull()).alias("nulls"), nan.alias("nans"), F.min(solid).cast("string").alias("lower"), F.max(solid).cast("string").alias("upper")))
    return df.agg(F.array(*parts).alias("m")).select(F.inline("m"))


def partition_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per partition column: whether it has nulls and NaN, and its bounds."""
    return column_metrics(df, columns).select("column", (F.col("nulls") > 0).alias("contains_null"), (F.col("nans") > 0).alias("contains_nan"), "lower", "upper")


def bound_problem(lower: Column, upper: Column, kind: str) -> Column:
    """What is wrong with a pair of bounds: null if nothing."""
    nan = F.isnan(lower) | F.isnan(upper) if kind in ("float", "double") else F.lit(False)
    return F.when(nan, "nan").when(lower > upper, "order")


def snapshot_problems(entries: DataFrame, rows: DataFrame, vectors: DataFrame, positions: DataFrame) -> DataFrame:
    """(file_path, problem) of a snapshot's live entries, in three passes: data files against their rows(file_path, rows); then
    vectors(file_path, referenced, positions, last); then position deletes(file_path, target, pos) and equality deletes.

    A delete applies to data files of its partition that are no newer; a vector must be the only one of its data file, have
    the positions that its entry counts, no more than the file's rows and none beyond; positions must be in files that they
    apply to, unless these have a vector."""
    e = live(entries)
    data = e.filter("content = 0").join(rows, "file_path", "left")
    first = data.groupBy("file_path").agg(F.count("*").alias("n"), F.bool_or(~F.col("record_count").eqNullSafe(F.col("rows"))).alias("odd"))
    first = first.select("file_path", F.when(F.col("n") > 1, "twice").when(F.col("odd"), "rows").alias("problem"))
    known = data.select(F.col("file_path").alias("referenced"), F.col("record_count").alias("own"), F.col("data_sequence").alias("born"), F.col("partition").alias("part"))
    applies = F.col("own").isNotNull() & (F.col("born") <= F.col("data_sequence")) & F.col("part").eqNullSafe(F.col("partition"))
    dv = e.filter("content = 3").drop("referenced").join(vectors, "file_path", "left").join(known, "referenced", "left").withColumn("applies", F.coalesce(applies, F.lit(False)))
    twice = dv.filter("applies").groupBy("referenced").agg(F.count("*").alias("n")).filter("n > 1").select("referenced", F.lit(True).alias("again"))
    second = dv.join(twice, "referenced", "left").select("file_path", F.when(F.col("referenced").isNull(), "binding").when(~F.col("record_count").eqNullSafe(F.col("positions")), "rows").when(F.col("applies") & F.col("again"), "vectors").when(F.col("applies") & ((F.col("record_count") > F.col("own")) | (F.col("last") >= F.col("own"))), "position").alias("problem"))
    eq = e.filter("content = 2").select("file_path", F.when(F.coalesce(F.size("equality_ids"), F.lit(0)) < 1, "ids").alias("problem"))
    listed = positions.groupBy("file_path").agg(F.count("*").alias("found"))
    counted = e.filter("content = 1").join(listed, "file_path", "left").select("file_path", F.when(F.col("record_count") != F.coalesce("found", F.lit(0)), "rows").alias("problem"))
    beyond = applicable(entries, positions).filter("pos >= own OR pos < 0").select("file_path", F.lit("position").alias("problem")).distinct()
    out = first
    for part in (second, counted, beyond, eq):
        out = out.union(part)
    return out.filter("problem IS NOT NULL")


def applicable(entries: DataFrame, positions: DataFrame) -> DataFrame:
    """positions(file_path, target, pos) of live position deletes that apply, with `own`, the rows of the target."""
    e = live(entries)
    data = e.filter("content = 0").select(F.col("file_path").alias("target"), F.col("record_count").alias("own"), F.col("data_sequence").alias("born"), F.col("partition").alias("part"))
    vectors = e.filter("content = 3").select(F.col("referenced").alias("target"), F.col("data_sequence").alias("s"), F.col("partition").alias("q"))
    covered = data.join(vectors, "target").filter("born <= s AND part <=> q").select("target").distinct()
    deletes = e.filter("content = 1").select("file_path", "data_sequence", "partition")
    free = data.join(covered, "target", "left_anti")
    return positions.join(deletes, "file_path").join(free, "target").filter("born <= data_sequence AND part <=> partition")


def file_summary(entries: DataFrame, positions: DataFrame) -> DataFrame:
    """One row on a snapshot's live files: those of each kind, their rows, positions that apply, and bytes."""
    used = applicable(entries, positions).agg(F.count("*").alias("applicable_rows"))
    return snapshot_summary(entries).join(used)


def snapshot_summary(entries: DataFrame) -> DataFrame:
    data, pos, eq, dv = (F.col("content") == k for k in range(4))

    def rows(rule: Column) -> Column:
        return F.coalesce(F.sum(F.when(rule, F.col("record_count"))), F.lit(0))

    return live(entries).agg(F.count_if(data).alias("data_files"), rows(data).alias("data_rows"), rows(~data).alias("delete_rows"), F.count_if(eq).alias("equality_files"), F.count_if(pos).alias("position_files"), F.count_if(dv).alias("vectors"), F.sum("file_bytes").alias("bytes"))


def position_delete_summary(deletes: DataFrame, data: DataFrame) -> DataFrame:
    """Rows, those that apply to a data file, and the number of files they name."""
    known = data.select("file_path").distinct().withColumn("_known", F.lit(True))
    return deletes.join(known, "file_path", "left").agg(F.count("*").alias("rows"), F.count_if(F.col("_known").isNotNull()).alias("applicable_rows"), F.count_distinct("file_path").alias("targets"))


def row_ids(entries: DataFrame, first: int | Column) -> DataFrame:
    """entries(pos, record_count, first_row_id) of one manifest with missing first row ids given in order from `first`.
    A manifest's entries are few, so the running sum is one task's work; `manifest` splits several."""
    need = F.when(F.col("first_row_id").isNull(), F.col("record_count")).otherwise(0)
    before = Window.partitionBy("manifest").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    given = (first if isinstance(first, Column) else F.lit(first)) + F.coalesce(F.sum(need).over(before), F.lit(0))
    return entries.withColumn("row_id", F.coalesce("first_row_id", given))


def gaps(ranges: DataFrame) -> DataFrame:
    """ranges(table, start, end) that do not begin where the one before ends."""
    before = F.lag("end").over(Window.partitionBy("table").orderBy("start"))
    return ranges.withColumn("before", before).filter("before IS NOT NULL AND before <> start")


def unsorted(pairs: DataFrame, group: str, order: str, *key: str) -> DataFrame:
    """Rows whose key is less than that of the row before."""
    w = Window.partitionBy(group).orderBy(order)
    return pairs.withColumn("_k", F.struct(*key)).withColumn("_b", F.lag("_k").over(w)).filter("_b > _k").drop("_k", "_b")


def referenced(snapshots: DataFrame, refs: DataFrame, current: int) -> DataFrame:
    """Snapshots that a ref names, or the current one."""
    wanted = refs.select("snapshot_id").union(refs.sparkSession.createDataFrame([(current,)], "snapshot_id long"))
    return snapshots.join(wanted.distinct(), "snapshot_id", "left_semi")


def reachable_files(lists: DataFrame, manifests: DataFrame, entries: DataFrame) -> DataFrame:
    """(path): metadata -> manifest lists -> manifests -> files, a join for each level."""
    own = manifests.join(lists.select("list"), "list", "left_semi")
    files = entries.join(own.select("manifest"), "manifest", "left_semi")
    return lists.select(F.col("list").alias("path")).union(own.select("manifest")).union(files.select("file_path")).distinct()


def garbage(stored: DataFrame, reachable: DataFrame) -> DataFrame:
    return stored.join(reachable, "path", "left_anti")


def unified_fields(specs: DataFrame) -> DataFrame:
    """(field_id, source, transform, problem) of all specs' partition fields specs(spec_id, field_id, source, transform): a void
    transform yields to a real one; two sources or two real transforms of one field are a problem."""
    real = F.when(F.col("transform") != "void", F.col("transform"))
    out = specs.groupBy("field_id").agg(F.min("source").alias("source"), F.max("source").alias("_s"), F.min(real).alias("_a"), F.max(real).alias("_b"))
    problem = F.when(F.col("source") != F.col("_s"), "source").when(F.col("_a") != F.col("_b"), "transform")
    return out.select("field_id", "source", F.coalesce("_a", F.lit("void")).alias("transform"), problem.alias("problem"))


def outside(values: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """Keys of summaries(key, contains_null, contains_nan, lower, upper) that do not say what the values(key, value) have."""
    v = F.col("value")
    nan = F.isnan(v) if values.schema["value"].dataType.simpleString() in ("double", "float") else F.lit(False)
    own = values.groupBy(key).agg(F.bool_or(v.isNull()).alias("_null"), F.coalesce(F.bool_or(nan), F.lit(False)).alias("_nan"), F.min(F.when(~nan, v)).alias("_lo"), F.max(F.when(~nan, v)).alias("_up"))
    both = summaries.join(own, key)
    bad = (F.col("contains_null") != F.col("_null")) | (F.col("contains_nan").isNotNull() & (F.col("contains_nan") != F.col("_nan")))
    bad |= F.coalesce((F.col("_lo") < F.col("lower")) | (F.col("_up") > F.col("upper")), F.lit(False))
    return both.filter(bad).select(key)
