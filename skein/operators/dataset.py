"""Dataset reads: members, effective fields, selections, splits, shuffles, shards, batches, composition, retention.

Forms: members(snapshot, sample_id); fields(snapshot, sample_id, field, kind, value, length, md5) with kind 'inline',
'chunk' or 'tombstone'; snapshots(id, parent). Ids are binary and ordered as unsigned bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import hashing, predicates
from skein.sources.session import sorted_ranges

#: Longest parent chain, largest shuffle group, most splits of a revision, most listed examples.
MAX_CHAIN, MAX_GROUP, MAX_SPLITS, EXAMPLES = 64, 100_000, 64, 20


class Rejected(ValueError):
    """A request that does not meet the rules."""


def ancestors(snapshots: DataFrame, snapshot, limit: int = MAX_CHAIN) -> DataFrame:
    """(id, depth): the snapshot and its parents, found in one recursive query. Raises on a cycle, an unknown parent or a
    chain of over `limit`."""
    spark, kind = snapshots.sparkSession, snapshots.schema["id"].dataType.simpleString()
    at = F.lit(snapshot).cast(kind)
    snapshots.select("id", "parent").filter("id IS NOT NULL").createOrReplaceTempView("skein_snapshots")
    spark.createDataFrame([(0,)], "depth int").select(at.alias("start")).createOrReplaceTempView("skein_start")
    steps = spark.sql(f"""
        WITH RECURSIVE up(id, depth) AS (
          SELECT start AS id, 0 AS depth FROM skein_start
          UNION ALL
          SELECT s.parent AS id, up.depth + 1 AS depth FROM up JOIN skein_snapshots s ON s.id = up.id WHERE s.parent IS NOT NULL AND up.depth <= {limit})
        SELECT id, depth FROM up""")
    chain = sorted(((r.depth, r.id) for r in steps.collect()))  # at most limit + 2 rows
    ids = [i for _, i in chain]
    if len(ids) > limit or len(set(ids)) < len(ids):
        raise Rejected("the parent chain has a cycle or is too long")
    if snapshots.filter(F.col("id").isin(ids)).select("id").distinct().count() < len(ids):
        raise Rejected("a snapshot of the chain is unknown")
    return spark.createDataFrame([(i, d) for d, i in chain], f"id {kind}, depth int")


def effective(members: DataFrame, fields: DataFrame, chain: DataFrame) -> DataFrame:
    """(sample_id, field, kind, value, depth): for each member of the newest snapshot and field, the locator of the
    nearest snapshot that has one. Membership is the newest snapshot's; tombstones stay as markers."""
    head = chain.filter("depth = 0").select(F.col("id").alias("snapshot"))
    own = members.join(F.broadcast(head), "snapshot", "left_semi").select("sample_id")
    near = fields.join(F.broadcast(chain), fields.snapshot == chain.id).groupBy("sample_id", "field")
    best = near.agg(F.min_by(F.struct("kind", "value", "depth"), "depth").alias("l"))
    return best.join(own, "sample_id", "left_semi").select("sample_id", "field", "l.*")


def visible(field: str, overlay: DataFrame) -> Column:
    """A field's inline value, by pivoting an effective() frame grouped by sample."""
    return F.max(F.when((F.col("field") == field) & (F.col("kind") == "inline"), F.col("value"))).alias(field)


def select(samples: DataFrame, predicate: predicates.Predicate, fields: list[str], version: int = 2) -> DataFrame:
    """The samples (sample_id and a binary column for each field) that the predicate selects. In version 2 an explicit id
    must be a member."""
    predicates.validate(predicate, set(fields), version)
    if version >= 2:
        existing(samples, predicate)
    needed = set(fields) if predicates.reads_all_fields(predicate) else predicates.fields_of(predicate)
    return samples.filter(predicates.compile(predicate, F.col("sample_id"), {f: F.col(f) for f in fields if f in needed}))


def existing(samples: DataFrame, predicate: predicates.Predicate) -> None:
    """Raises unless all explicit ids are members."""
    ids = predicates.explicit_ids(predicate)
    if ids:
        wanted = samples.sparkSession.createDataFrame([(bytearray(i),) for i in set(ids)], "sample_id binary")
        if not F.broadcast(wanted).join(samples, "sample_id", "left_anti").isEmpty():
            raise Rejected("an explicit id is no member")


def projection(names: list[str]) -> list[str]:
    if not names or len(names) > 256 or len(set(names)) < len(names) or not all(names):
        raise Rejected("a projection has 1 to 256 different names")
    return names


def matrix(samples: DataFrame, overlay: DataFrame, fields: list[str]) -> DataFrame:
    """One row per sample, and for each field its kind, or null where there is none."""
    kinds = overlay.groupBy("sample_id").pivot("field", projection(fields)).agg(F.first("kind"))
    return samples.select("sample_id").join(kinds, "sample_id", "left")


def preview(value: Column, size: int) -> Column:
    """The first bytes of a value with its whole length and digest."""
    if not 1 <= size <= 65536:
        raise Rejected("a preview has 1 to 65536 bytes")
    return F.struct(F.substring(value, 1, size).alias("bytes"), F.octet_length(value).cast("long").alias("length"), F.md5(value).alias("md5"), F.when(value.isNull(), "missing").otherwise("present").alias("state"), F.coalesce(F.octet_length(value) > size, F.lit(False)).alias("truncated"))


# --- order, groups, shards, pages -------------------------------------------------------------------------------


def numbered(df: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """df with 0-based positions in a total order, without gathering the table in one task: a range sort, the sizes of its
    partitions, and a running number in each."""
    placed = sorted_ranges(df, *order)
    sizes = {r["_p"]: r["n"] for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    total, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    base = df.sparkSession.createDataFrame(starts or [(0, 0)], "_p int, _base long")
    return placed.join(F.broadcast(base), "_p").withColumn(name, F.col("_i") + F.col("_base")).drop("_p", "_i", "_base")


def group_shuffle(samples: DataFrame, seed: int, snapshot: bytes, group_size: int) -> DataFrame:
    """Samples with group and ordinal: groups of group_size ids in id order, shuffled within."""
    if not 0 < group_size <= MAX_GROUP:
        raise Rejected("a shuffle group has 1 to 100000 ids")
    grouped = numbered(samples, "sample_id", name="_n").withColumn("group", F.floor(F.col("_n") / group_size))
    key = hashing.group_shuffle_key(F.col("sample_id"), seed, snapshot)
    place = F.row_number().over(Window.partitionBy("group").orderBy(key, "sample_id")) - 1
    return grouped.withColumn("ordinal", F.col("group") * group_size + place).drop("_n")


def default_group(batch: int, workers: int, world_size: int) -> int:
    return min(batch * workers * world_size, MAX_GROUP)


def global_shuffle(samples: DataFrame, seed: int, epoch: int, plan: bytes) -> DataFrame:
    """Samples with the ordinal of the seeded shuffle of all of them."""
    key = hashing.global_shuffle_key(F.col("sample_id"), seed, epoch, plan)
    return numbered(samples.withColumn("_k", key), "_k", "sample_id").drop("_k")


def prefix_groups(samples: DataFrame) -> DataFrame:
    """Samples by the id up to its first hyphen, or the whole id."""
    text = F.col("sample_id").cast("string")
    return samples.groupBy(F.substring_index(text, "-", 1).alias("prefix"))


def shard(numbered_samples: DataFrame, rank: int, world_size: int, worker: int, workers: int) -> DataFrame:
    """The rows of one worker: ordinals that its number takes in turn."""
    return numbered_samples.filter(F.pmod("ordinal", F.lit(world_size * workers)) == rank * workers + worker)


def batches(numbered_samples: DataFrame, size: int) -> DataFrame:
    if not 0 < size <= 10_000:
        raise Rejected("a batch has 1 to 10000 rows")
    return numbered_samples.withColumn("batch", F.floor(F.col("ordinal") / size))


def page(df: DataFrame, key: str, after, limit: int, size: Column | None = None, max_bytes: int | None = None) -> DataFrame:
    """Keyset page: the first rows after a key; an empty page may have a next one. With max_bytes, the leading rows of the page
    whose sizes fit, and the first in any case: the running sum is over `limit` rows at most."""
    rows = (df if after is None else df.filter(F.col(key) > F.lit(after))).orderBy(key).limit(limit)
    if size is None or max_bytes is None:
        return rows
    w = Window.partitionBy(F.lit(0)).orderBy(key)
    return rows.withColumn("_u", F.sum(size).over(w)).withColumn("_n", F.row_number().over(w)).filter((F.col("_u") <= max_bytes) | (F.col("_n") == 1)).drop("_u", "_n")


def admitted(samples: DataFrame, size: Column, *, max_samples: int, max_bytes: int, max_batches: int, batch: int) -> dict[str, int]:
    """Counts of a plan; raises if one is over its limit."""
    row = samples.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    found = {"samples": row["n"], "bytes": row["b"], "batches": -(-row["n"] // batch)}
    if found["samples"] > max_samples or found["bytes"] > max_bytes or found["batches"] > max_batches:
        raise Rejected(f"over the limits: {found}")
    return found


def delivered(df: DataFrame, batch: int):
    """Lists of rows, one in flight; call the second item when it is taken, as only then the cursor moves on."""
    held, done = [], 0
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == batch:
            done += len(held)
            yield held, done
            held = []
    if held:
        yield held, done + len(held)


# --- splits -----------------------------------------------------------------------------------------------------


def weighted_split(sample_id: Column, weights: list[tuple[str, int]], seed: int, domain: bytes = hashing.SPLIT_DOMAIN) -> Column:
    """The name whose interval of the summed weights, in list order, has the id's bucket."""
    names = [n for n, _ in weights]
    total = sum(w for _, w in weights)
    if not weights or len(names) > MAX_SPLITS or len(set(names)) < len(names) or min(w for _, w in weights) <= 0 or total >= 2**32:
        raise Rejected("weights are 1 to 64 different names with positive counts, under 2**32 in all")
    bucket, out, top = hashing.split_bucket(sample_id, seed, total, domain), None, 0
    for name, weight in weights:
        top += weight
        out = F.when(bucket < top, name) if out is None else out.when(bucket < top, name)
    return out


def split_report(samples: DataFrame, members: DataFrame) -> DataFrame:
    """scanned, assigned, unassigned, overlapping, and up to EXAMPLES ids of the last two."""
    counts = samples.select("sample_id").join(members.groupBy("sample_id").agg(F.count("*").alias("c")), "sample_id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    none, many = F.col("c") == 0, F.col("c") > 1
    totals = counts.agg(F.count("*").alias("scanned"), F.count_if(F.col("c") > 0).alias("assigned"), F.count_if(none).alias("unassigned"), F.count_if(many).alias("overlapping"))
    for name, rule in (("unassigned_ids", none), ("overlapping_ids", many)):
        few = counts.filter(rule).orderBy("sample_id").limit(EXAMPLES).agg(F.sort_array(F.collect_list("sample_id")).alias(name))
        totals = totals.withColumn(name, few.scalar())
    return totals


def satisfied(report: DataFrame, *, overlap_allowed: bool = False, unassigned_allowed: bool = True) -> Column:
    return (F.lit(overlap_allowed) | (F.col("overlapping") == 0)) & (F.lit(unassigned_allowed) | (F.col("unassigned") == 0))


# --- composition and retention ----------------------------------------------------------------------------------


def compose(source: DataFrame, parent: DataFrame, upserts: DataFrame, removes: DataFrame, fields: list[str]) -> DataFrame:
    """Source rows with field-level patches and removals. A patched sample that is not in the source but in the parent is
    brought in first. Upserts have a null for a field they leave alone."""
    if not upserts.groupBy("sample_id").count().filter("count > 1").isEmpty():
        raise Rejected("an id is patched twice")
    if not upserts.join(removes, "sample_id", "left_semi").isEmpty():
        raise Rejected("an id is both patched and removed")
    brought = parent.join(upserts, "sample_id", "left_semi").join(source, "sample_id", "left_anti")
    base = source.unionByName(brought).join(removes, "sample_id", "left_anti")
    patch = upserts.select("sample_id", *(F.col(f).alias(f"_{f}") for f in fields))
    return base.join(patch, "sample_id", "full").select("sample_id", *(F.coalesce(f"_{f}", f).alias(f) for f in fields))


def reachable(snapshots: DataFrame, roots: DataFrame) -> DataFrame:
    """(id): roots and all their parents; a join for each generation."""
    found = roots.select("id").distinct()
    edge, out = found, found
    for _ in range(MAX_CHAIN):
        edge = snapshots.join(edge, "id", "left_semi").filter("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct().join(out, "id", "left_anti").persist()
        if edge.isEmpty():
            return out
        out = out.union(edge)
    raise Rejected("the parent chain is too long")


def retention(snapshots: DataFrame, chunks: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshots and chunks that nothing reachable needs; external chunks are never reclaimed."""
    kept = reachable(snapshots, roots)
    lost = snapshots.select("id").join(kept, "id", "left_anti")
    used = chunks.join(kept, chunks.snapshot == kept.id, "left_semi").select("chunk")
    return lost, chunks.filter("NOT external").select("chunk").distinct().join(used, "chunk", "left_anti")


def snapshot_id(text: Column, latest: Column, stable: Column) -> Column:
    """32 lower-case hex digits, or an alias; null otherwise."""
    return F.when(text == "latest", latest).when(text == "stable", stable).when(text.rlike("^[0-9a-f]{32}$"), text)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as samples: decimal ids and the fields text, lang and source."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(F.col("doc_id").cast("string").cast("binary").alias("sample_id"), *(F.col(c).cast("binary").alias(c) for c in ("text", "lang", "source")))


# --- delivery ---------------------------------------------------------------------------------------------------


def frames(numbered_samples: DataFrame, fields: list[str], batch: int, chunk: int) -> DataFrame:
    """(batch, ordinal, sample_id, field, chunk, offset, length, bytes, md5): the fields' values (binary) in pieces of at most
    `chunk` bytes, each with its digest; an empty value is one empty piece, a null one none."""
    rows = batches(numbered_samples, batch)
    values = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))
    rows = rows.select("batch", "ordinal", "sample_id", F.inline(values)).filter("value IS NOT NULL")
    pieces = F.greatest(F.lit(0), F.floor((F.octet_length("value") - 1) / chunk)).cast("int")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), pieces)).alias("chunk"))
    piece = F.substring("value", F.col("chunk") * chunk + 1, F.lit(chunk))
    rows = rows.withColumn("bytes", piece)
    return rows.select("batch", "ordinal", "sample_id", "field", "chunk", (F.col("chunk") * chunk).cast("long").alias("offset"), F.octet_length("bytes").cast("long").alias("length"), "bytes", F.md5("bytes").alias("md5"))


def merged_reports(reports: DataFrame) -> DataFrame:
    """One report of partial ones (scanned, assigned, unassigned, overlapping, unassigned_ids, overlapping_ids): sums, and the
    first EXAMPLES of the ids."""
    sums = [F.sum(c).alias(c) for c in ("scanned", "assigned", "unassigned", "overlapping")]
    few = [F.slice(F.sort_array(F.flatten(F.collect_list(c))), 1, EXAMPLES).alias(c) for c in ("unassigned_ids", "overlapping_ids")]
    return reports.agg(*sums, *few)


def digest(rows: DataFrame, *columns: str) -> Column:
    """A digest of a set of rows, whatever their order and partitions: the sum of 60 bits of each row's md5. An aggregate."""
    row = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns)).cast("binary"))
    return F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)"))
