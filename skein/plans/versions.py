"""Queries over tables with metadata of their own: manifests and lists that are written and read back, snapshots, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import dataset as D
from skein.operators import table as T
from skein.plans.tables import ENTRIES, _entries, _table
from skein.registry import query
from skein.sources import manifests as M
from skein.sources.session import scratch


def _written(spark, sf):
    """The lineitem entries as five manifests of two snapshots, with a list of both: root, rows of the list."""
    from skein.operators.catalog import Files

    files = Files(spark, scratch(spark, "manifests"))
    name = F.concat_ws("/", "partition", F.col("manifest").cast("string"), F.col("content").cast("string"), F.col("status").cast("string"))
    bounds = F.create_map(F.lit(1), F.col("record_count").cast("string").cast("binary"))
    entries = _entries(spark, sf).withColumn("file_path", name).withColumn("pos", F.row_number().over(T.Window.partitionBy("manifest").orderBy("partition", "content", "status")))
    entries = entries.withColumn("data_sequence", F.when((F.col("content") == 0) & (F.col("status") == 0), 3).cast("long")).withColumn("values", F.create_map(F.lit(1), F.col("record_count"))).withColumn("lower", bounds)
    entries = entries.withColumn("equality_ids", F.when(F.col("content") == 2, F.array(F.lit(1), F.lit(2)))).withColumn("added_by", F.when(F.col("status") == 0, 70).cast("long")).cache()
    _, rows = M.publish(files, entries.filter("manifest < 2"), 71, 10)
    name, rows = M.publish(files, entries.filter("manifest >= 2"), 72, 11, rows)
    entries.unpersist()
    return files, M.read_list(files, name)


@query(
    "tb_manifest_read",
    ENTRIES + """SELECT part || '/' || m || '/' || content || '/' || status AS file_path, status, content, part AS partition, n AS record_count, bytes AS file_bytes, CASE WHEN content = 0 AND status = 0 THEN 3 WHEN m < 2 THEN 10 ELSE 11 END::BIGINT AS data_sequence,
      CASE WHEN status = 0 THEN 70 WHEN m < 2 THEN 71 ELSE 72 END::BIGINT AS added_by, n AS counted, CAST(n AS VARCHAR) AS bound, CASE WHEN content = 2 THEN 2 ELSE 0 END AS ids FROM e""",
)
def tb_manifest_read(spark, sf):
    """Every entry of every manifest of a snapshot's list, with what it takes from the list."""
    files, rows = _written(spark, sf)
    e = M.read_entries(spark, files.root, rows)
    return e.select("file_path", "status", "content", "partition", "record_count", "file_bytes", "data_sequence", "added_by", F.element_at("values", 1).alias("counted"), F.element_at("lower", 1).cast("string").alias("bound"), F.coalesce(F.size("equality_ids"), F.lit(0)).alias("ids"))


_NAMES = [f"{n}_{what}" for what in ("files", "rows") for n in ("existing", "added", "deleted")]
_TOTALS = ", ".join(f"count(*) FILTER (status = {k}) AS {n}_files, coalesce(sum(n) FILTER (status = {k}), 0)::BIGINT AS {n}_rows" for k, n in enumerate(("existing", "added", "deleted")))


@query("tb_manifest_list", f"{ENTRIES} SELECT m::VARCHAR AS manifest, CASE WHEN m < 2 THEN 71 ELSE 72 END::BIGINT AS added_by, CASE WHEN m < 2 THEN 10 ELSE 11 END::BIGINT AS sequence, CASE WHEN bool_and(content = 0) THEN 0 ELSE 1 END::BIGINT AS content, {_TOTALS} FROM e GROUP BY m")
def tb_manifest_list(spark, sf):
    """The rows of a snapshot's manifest list."""
    _, rows = _written(spark, sf)
    out = [(r["manifest_path"].rsplit("-", 1)[-1].removesuffix(".avro"), r["added_snapshot_id"], r["sequence_number"], r["content"], *(r[f"{n}_count"] for n in _NAMES)) for r in rows]
    return spark.createDataFrame(out, "manifest string, added_by long, sequence long, content long, " + ", ".join(f"{n} long" for n in _NAMES))


@query("tb_manifest_mismatch", "SELECT * FROM (VALUES ('72-2.avro', 'different')) v(manifest, problem)")
def tb_manifest_mismatch(spark, sf):
    """Manifests that have not what the list says of them."""
    files, rows = _written(spark, sf)
    odd = [r | {"added_rows_count": r["added_rows_count"] + 1} if r["manifest_path"].endswith("-2.avro") else r for r in rows]
    return M.wrong_totals(spark, odd, M.read_entries(spark, files.root, rows))


# --- checks of a snapshot's files -------------------------------------------------------------------------------

#: A data file for each order month and status; a vector for some, position deletes for others, with faults in a few.
_CHECKED = """
WITH f AS (SELECT (year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS k, o_orderstatus AS part, count(*) AS n FROM orders GROUP BY ALL),
v AS (SELECT k, part, n, least(n, 5) + CASE WHEN k % 10 = 3 THEN n ELSE 0 END AS size FROM f WHERE k % 5 = 3),
p AS (SELECT k, part, n, CASE WHEN k % 10 = 4 AND part = 'O' THEN n ELSE n - 1 END AS pos FROM f WHERE k % 5 IN (3, 4))
"""


def _snapshot_files(spark, sf):
    d = F.col("o_orderdate")
    f = _table(spark, sf, "orders").groupBy(((F.year(d) - 1990) * 12 + F.month(d)).alias("k"), F.col("o_orderstatus").alias("partition")).agg(F.count("*").alias("n"))
    k, n = F.col("k"), F.col("n")
    name = lambda kind: F.concat(F.lit(kind), k.cast("string"), F.col("partition"))
    none = F.lit(None).cast("string")
    ids = F.lit(None).cast("array<int>")
    size = F.least(n, F.lit(5)) + F.when(k % 10 == 3, n).otherwise(0)
    data = f.select(name("d").alias("file_path"), F.lit(1).alias("status"), F.lit(0).alias("content"), "partition", n.alias("record_count"), F.lit(5).cast("long").alias("data_sequence"), none.alias("referenced"), ids.alias("equality_ids"), (n * 100).alias("file_bytes"))
    vector = f.filter("k % 5 = 3").select(name("v"), F.lit(1), F.lit(3), "partition", size, F.lit(6), name("d"), ids, F.lit(40))
    deletes = f.filter("k % 5 IN (3, 4)").select(name("p"), F.lit(1), F.lit(1), "partition", F.lit(1), F.lit(7), none, ids, F.lit(30))
    equality = f.filter("k % 5 = 0").select(name("e"), F.when(k % 10 == 0, 2).otherwise(1), F.lit(2), "partition", F.lit(1), F.lit(7), none, F.when(F.col("partition") == "F", F.array(F.lit(1))), F.lit(20))
    entries = data.union(vector).union(deletes).union(equality)
    rows = f.select(name("d").alias("file_path"), (n + (k % 7 == 6).cast("int")).alias("rows"))
    vectors = f.filter("k % 5 = 3").select(name("v").alias("file_path"), name("d").alias("referenced"), size.alias("positions"), (F.least(n, F.lit(5)) - 1).alias("last"))
    positions = f.filter("k % 5 IN (3, 4)").select(name("p").alias("file_path"), name("d").alias("target"), F.when((k % 10 == 4) & (F.col("partition") == "O"), n).otherwise(n - 1).alias("pos"))
    return entries, rows, vectors, positions


@query(
    "tb_validate_files",
    _CHECKED + """SELECT 'd' || k || part AS file_path, 'rows' AS problem FROM f WHERE k % 7 = 6 UNION ALL SELECT 'v' || k || part, 'position' FROM v WHERE size > n
    UNION ALL SELECT 'p' || k || part, 'position' FROM p WHERE pos >= n AND k % 5 = 4 UNION ALL SELECT 'e' || k || part, 'ids' FROM f WHERE k % 10 = 5 AND part <> 'F'""",
)
def tb_validate_files(spark, sf):
    """What is wrong with a snapshot's data files, vectors, position and equality deletes."""
    return T.snapshot_problems(*_snapshot_files(spark, sf))


@query(
    "tb_file_summary",
    _CHECKED + """SELECT (SELECT count(*) FROM f) AS data_files, (SELECT sum(n)::BIGINT FROM f) AS data_rows, (SELECT sum(size) FROM v)::BIGINT + (SELECT count(*) FROM p) + (SELECT count(*) FROM f WHERE k % 10 = 5) AS delete_rows,
    (SELECT count(*) FROM f WHERE k % 10 = 5) AS equality_files, (SELECT count(*) FROM p) AS position_files, (SELECT count(*) FROM v) AS vectors,
    (SELECT sum(n * 100)::BIGINT FROM f) + 40 * (SELECT count(*) FROM v) + 30 * (SELECT count(*) FROM p) + 20 * (SELECT count(*) FROM f WHERE k % 10 = 5) AS bytes, (SELECT count(*) FROM p WHERE k % 5 = 4) AS applicable_rows""",
)
def tb_file_summary(spark, sf):
    """One row on a snapshot's live files, with the position deletes that apply (a vector outranks them)."""
    entries, _, _, positions = _snapshot_files(spark, sf)
    return T.file_summary(entries, positions)


# --- tables in folders ------------------------------------------------------------------------------------------


def _orders_table(spark, sf):
    """orders in a table: two statuses, a delete, a column more, and the third status; the ids of its snapshots."""
    from skein.operators.catalog import Table

    orders = _table(spark, sf, "orders")
    t = Table.scratch(spark, [(1, "o_orderkey", "long", True), (2, "o_custkey", "long", False), (3, "o_totalprice", "double", False)])
    ids = [t.append(orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")), t.append(orders.filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_totalprice"))]
    ids.append(t.delete(F.col("o_orderkey") % 10 == 2))
    t.add_column("note", "string")
    ids.append(t.append(orders.filter("o_orderstatus = 'P'").select("o_orderkey", F.col("o_orderpriority").alias("note"))))
    return t, ids


@query("tb_insert_delete", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS note FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 10 <> 2")
def tb_insert_delete(spark, sf):
    """All rows of a table after appends, a delete and a schema change: list, manifests, files, deletes."""
    return _orders_table(spark, sf)[0].read()


@query("tb_snapshot_read", "SELECT o_orderkey, o_custkey, o_totalprice, NULL::VARCHAR AS note FROM orders WHERE o_orderstatus IN ('F', 'O')")
def tb_snapshot_read(spark, sf):
    """The rows of a snapshot before the delete, in today's schema."""
    t, ids = _orders_table(spark, sf)
    return t.read(snapshot_id=ids[1])


@query("tb_table_scan", "SELECT split_part('data,data,deletes,data', ',', k) AS kind, k AS data_sequence, CASE k WHEN 1 THEN count(*) FILTER (o_orderstatus = 'F') WHEN 2 THEN count(*) FILTER (o_orderstatus = 'O') WHEN 3 THEN count(*) FILTER (o_orderstatus <> 'P' AND o_orderkey % 10 = 2) ELSE count(*) FILTER (o_orderstatus = 'P') END AS record_count FROM orders, (SELECT unnest([1, 2, 3, 4])::BIGINT AS k) GROUP BY k")
def tb_table_scan(spark, sf):
    """What the manifests of a table say of its files, by commit."""
    e = _orders_table(spark, sf)[0].entries()
    return e.groupBy(F.substring_index("file_path", "/", 1).alias("kind"), "data_sequence").agg(F.sum("record_count").alias("record_count"))


@query("tb_time_travel", "SELECT o_orderkey, o_totalprice FROM orders WHERE (year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 <= 300")
def tb_time_travel(spark, sf):
    """Snapshots by month, whose ids are in no order: a snapshot sees its chain of parents."""
    from skein.functions import transforms as X

    number = lambda month: month * 7919 % 10007
    orders = _table(spark, sf, "orders").withColumn("month", X.month(F.col("o_orderdate"))).withColumn("snapshot_id", number(F.col("month")))
    months = orders.select("month").distinct()
    snapshots = months.select(number(F.col("month")).alias("id"), F.when(F.col("month") > months.agg(F.min("month")).first()[0], number(F.col("month") - 1)).alias("parent"))
    return T.as_of(orders, D.ancestors(snapshots, number(300))).select("o_orderkey", "o_totalprice")


@query("tb_bounds_check", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'nan' WHEN l_discount > l_tax THEN 'order' ELSE '' END AS problem FROM lineitem")
def tb_bounds_check(spark, sf):
    """Pairs of bounds that are NaN or in the wrong order."""
    lower = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    return _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(T.bound_problem(lower, F.col("l_tax"), "double"), F.lit("")).alias("problem"))


@query("tb_name_mapping", "SELECT s_suppkey AS id, CAST(s_acctbal AS DOUBLE) AS balance, s_name AS title, CAST(NULL AS VARCHAR) AS extra FROM supplier")
def tb_name_mapping(spark, sf):
    """Files without field ids, read by a name mapping with names of former times."""
    from skein.sources.evolution import Field, mapped_ids, read_as

    mapping = [{"field-id": 1, "names": ["id", "s_suppkey"]}, {"field-id": 2, "names": ["s_acctbal"]}, {"field-id": 3, "names": ["title", "s_name"]}, {"field-id": 9, "names": ["extra"]}]
    df = _table(spark, sf, "supplier")
    return read_as(df, mapped_ids(df.columns, mapping), [Field(1, "id", "long"), Field(2, "balance", "double"), Field(3, "title", "string"), Field(9, "extra", "string")])


@query("tb_load_response", "SELECT 4::BIGINT AS snapshots, 2::BIGINT AS by_refs, true AS unchanged, true AS changed")
def tb_load_response(spark, sf):
    """Loads of a table: all snapshots, those that refs name, nothing for a tag that still holds, and again after a commit."""
    t, ids = _orders_table(spark, sf)
    t.commit([{"action": "set-snapshot-ref", "ref-name": "first", "type": "tag", "snapshot-id": ids[0]}])
    every, few = t.response(), t.response("refs")
    unchanged = t.response(etag=every["etag"]) is None
    t.commit([{"action": "set-properties", "updates": {"a": "b"}}])
    return spark.createDataFrame([(len(every["metadata"]["snapshots"]), len(few["metadata"]["snapshots"]), unchanged, t.response(etag=every["etag"]) is not None)], "snapshots long, by_refs long, unchanged boolean, changed boolean")


@query("tb_sorted_write", "SELECT 0::BIGINT AS unsorted, count(*) AS rows FROM orders")
def tb_sorted_write(spark, sf):
    """Rows out of the table's sort order within their files: none."""
    from skein.operators.catalog import Table

    t = Table.scratch(spark, [(1, "o_custkey", "long", True), (2, "o_totalprice", "double", False)])
    fields = [{"source-id": 1, "transform": "identity", "direction": "asc", "null-order": "nulls-first"}, {"source-id": 2, "transform": "identity", "direction": "desc", "null-order": "nulls-last"}]
    t.commit([{"action": "add-sort-order", "sort-order": {"fields": fields}}, {"action": "set-default-sort-order", "sort-order-id": -1}])
    t.append(_table(spark, sf, "orders").select("o_custkey", "o_totalprice"))
    rows = t._rows(t.metadata())
    odd = T.unsorted(rows.withColumn("down", -F.col("o_totalprice")), "_file", "_pos", "o_custkey", "down")
    return odd.agg(F.count("*").alias("unsorted")).withColumn("rows", rows.agg(F.count("*")).scalar())
