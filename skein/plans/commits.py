"""Queries of the commit algebra: requests made of the tables' rows, evaluated each alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import commit as C
from skein.registry import query


def _table(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _struct(**fields) -> Column:
    """A struct whose names have hyphens for underscores."""
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k.replace("_", "-")) for k, v in fields.items()))



def _elements(array: Column) -> Column:
    """The JSON of an array's elements, without the brackets."""
    text = F.to_json(array)
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _base(version: int, **more) -> str:
    """JSON of an empty table of two columns, without its last brace."""
    import json

    m = C.new_table("file:/t", {"fields": [{"id": 1, "name": "id", "type": "long", "required": True}, {"id": 2, "name": "day", "type": "date", "required": False}]}, version=version, uuid="00000000-0000-0000-0000-000000000001")
    return json.dumps({k: v for k, v in m.items() if k not in more})[:-1]


def _snapshot(number: Column, sequence: Column, rows: Column, first: Column) -> Column:
    return _struct(snapshot_id=number, sequence_number=sequence, timestamp_ms=number * 10, manifest_list=F.concat(F.lit("metadata/"), number.cast("string")), first_row_id=first, added_rows=rows)


def _orders(spark, sf) -> DataFrame:
    """Each customer's orders as snapshots of a table of their own, in order: sequence, added rows, first row id."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = (F.col("o_orderkey") % 7).cast("long")
    df = _table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").cast("long").alias("n"), "o_orderstatus", F.row_number().over(w).cast("long").alias("seq"), rows.alias("rows"), F.coalesce(F.sum(rows).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("first"))
    one = F.struct("seq", "n", "o_orderstatus", "rows", "first")
    return df.groupBy(F.col("o_custkey").cast("long").alias("id")).agg(F.sort_array(F.collect_list(one)).alias("s"))


_ORDERS = "o AS (SELECT o_custkey::BIGINT AS id, o_orderkey::BIGINT AS n, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, o_orderkey % 7 AS rows FROM orders)"


@query(
    "cm_one_request",
    f"""WITH {_ORDERS} SELECT id, count(*) AS snapshots, max(seq)::BIGINT AS last_sequence, max(n) AS current, sum(rows)::BIGINT AS next_row_id, 1::BIGINT AS log_entries, max(n) * 10 AS log_time, min(n) AS tagged FROM o GROUP BY id""",
)
def cm_one_request(spark, sf):
    """All of a customer's orders as snapshots in one request, each made the current one: the log keeps the last move."""
    from_struct = lambda x: _snapshot(x["n"], x["seq"], x["rows"], x["first"])
    adds = _elements(F.transform("s", lambda x: _struct(action="add-snapshot", snapshot=from_struct(x))))
    moves = _elements(F.transform("s", lambda x: _struct(action="set-snapshot-ref", ref_name="main", type="branch", snapshot_id=x["n"])))
    tag = F.to_json(_struct(action="set-snapshot-ref", ref_name="first", type="tag", snapshot_id=F.col("s")[0]["n"]))
    requests = _orders(spark, sf).select("id", F.concat(F.lit(_base(3)), F.lit("}")).alias("metadata"), F.lit("[]").alias("requirements"), F.concat(F.lit("["), F.concat_ws(",", adds, moves, tag), F.lit("]")).alias("updates"), F.lit(5).cast("long").alias("now_ms"))
    m = F.from_json("metadata", "`last-sequence-number` long, `current-snapshot-id` long, `next-row-id` long, snapshots array<struct<`snapshot-id`:long>>, `snapshot-log` array<struct<`timestamp-ms`:long>>, refs struct<first:struct<`snapshot-id`:long>>")
    out = C.apply(requests).select("id", m.alias("m"))
    return out.select("id", F.size("m.snapshots").cast("long").alias("snapshots"), F.col("m.last-sequence-number").alias("last_sequence"), F.col("m.current-snapshot-id").alias("current"), F.col("m.next-row-id").alias("next_row_id"), F.size("m.snapshot-log").cast("long").alias("log_entries"), F.col("m.snapshot-log")[0]["timestamp-ms"].alias("log_time"), F.col("m.refs.first.snapshot-id").alias("tagged"))


def _history(spark, sf) -> DataFrame:
    """(id, metadata, s): tables whose main went over all of the customer's orders, one by one."""
    snapshots = F.to_json(F.transform("s", lambda x: _snapshot(x["n"], x["seq"], x["rows"], x["first"])))
    log = F.to_json(F.transform("s", lambda x: _struct(timestamp_ms=x["n"] * 10, snapshot_id=x["n"])))
    last = F.element_at("s", -1)
    own = ("snapshots", "snapshot-log", "refs", "last-sequence-number", "next-row-id")
    refs = F.to_json(F.struct(F.struct(last["n"].alias("snapshot-id"), F.lit("branch").alias("type")).alias("main"), F.struct(F.col("s")[0]["n"].alias("snapshot-id"), F.lit("tag").alias("type")).alias("first")))
    parts = [F.lit(_base(3, **dict.fromkeys(own))), F.lit(', "snapshots": '), snapshots, F.lit(', "snapshot-log": '), log, F.lit(', "refs": '), refs, F.lit(', "current-snapshot-id": '), last["n"].cast("string"), F.lit(', "last-sequence-number": '), last["seq"].cast("string"), F.lit(', "next-row-id": '), (last["first"] + last["rows"]).cast("string"), F.lit("}")]
    return _orders(spark, sf).withColumn("metadata", F.concat(*parts))


_STATE = "`last-sequence-number` long, `current-snapshot-id` long, `next-row-id` long, snapshots array<struct<`snapshot-id`:long>>, `snapshot-log` array<struct<`timestamp-ms`:long,`snapshot-id`:long>>, refs map<string,struct<`snapshot-id`:long>>"


@query(
    "cm_remove_snapshots",
    f"""WITH {_ORDERS}, g AS (SELECT *, max(CASE WHEN o_orderstatus = 'F' THEN seq ELSE 0 END) OVER (PARTITION BY id) AS gap, max(seq) OVER (PARTITION BY id) AS m FROM o)
    SELECT id, count(*) FILTER (o_orderstatus <> 'F') AS snapshots, CASE WHEN max(gap) = max(m) THEN -1 ELSE max(n) END AS current, count(*) FILTER (seq > gap) AS log_entries,
      (CASE WHEN max(gap) = max(m) THEN 0 ELSE 1 END + CASE WHEN bool_or(seq = 1 AND o_orderstatus = 'F') THEN 0 ELSE 1 END)::BIGINT AS refs, max(m)::BIGINT AS last_sequence FROM g GROUP BY id""",
)
def cm_remove_snapshots(spark, sf):
    """The snapshots of finished orders go: so do refs to them and log entries up to the last of them."""
    gone = F.transform(F.filter("s", lambda x: x["o_orderstatus"] == "F"), lambda x: x["n"])
    requests = _history(spark, sf).select("id", "metadata", F.lit("[]").alias("requirements"), F.to_json(F.array(_struct(action="remove-snapshots", snapshot_ids=gone))).alias("updates"), F.lit(7).cast("long").alias("now_ms"))
    out = C.apply(requests).select("id", F.from_json("metadata", _STATE).alias("m"))
    return out.select("id", F.size("m.snapshots").cast("long").alias("snapshots"), F.col("m.current-snapshot-id").alias("current"), F.size("m.snapshot-log").cast("long").alias("log_entries"), F.size("m.refs").cast("long").alias("refs"), F.col("m.last-sequence-number").alias("last_sequence"))


@query(
    "cm_move_main",
    f"""WITH {_ORDERS}, c AS (SELECT id, min(n) AS a, max(n) AS z, count(*) AS k FROM o GROUP BY id)
    SELECT id, a AS current, k + CASE WHEN a = z THEN 0 ELSE 3 END AS log_entries, CASE WHEN a = z THEN a * 10 ELSE 99 END AS log_time FROM c""",
)
def cm_move_main(spark, sf):
    """Main goes back to the first snapshot, to the last and back again: moves to snapshots that were there stay in the log;
    one to where it is anyway is none."""
    moves = F.to_json(F.array(*(_struct(action="set-snapshot-ref", ref_name="main", type="branch", snapshot_id=x["n"]) for x in (F.col("s")[0], F.element_at("s", -1), F.col("s")[0]))))
    requests = _history(spark, sf).select("id", "metadata", F.lit("[]").alias("requirements"), moves.alias("updates"), F.lit(99).cast("long").alias("now_ms"))
    out = C.apply(requests).select("id", F.from_json("metadata", _STATE).alias("m"))
    return out.select("id", F.col("m.current-snapshot-id").alias("current"), F.size("m.snapshot-log").cast("long").alias("log_entries"), F.element_at("m.snapshot-log", -1)["timestamp-ms"].alias("log_time"))


@query(
    "cm_requirements",
    f"""WITH {_ORDERS}, c AS (SELECT id, max(n) AS z, max(seq) AS k FROM o GROUP BY id)
    SELECT id, CASE id % 9 WHEN 0 THEN 'failed' WHEN 1 THEN NULL WHEN 2 THEN 'failed' WHEN 3 THEN CASE WHEN z % 2 = 0 THEN NULL ELSE 'failed' END WHEN 4 THEN NULL WHEN 5 THEN CASE WHEN k = 2 THEN NULL ELSE 'failed' END WHEN 6 THEN NULL WHEN 7 THEN 'failed' ELSE 'invalid' END AS problem FROM c""",
)
def cm_requirements(spark, sf):
    """Requirements of every kind, some of them not met."""
    z, k = F.element_at("s", -1)["n"], F.element_at("s", -1)["seq"]
    kinds = [
        _struct(type="assert-create"),
        _struct(type="assert-table-uuid", uuid="00000000-0000-0000-0000-000000000001"),
        _struct(type="assert-table-uuid", uuid="00000000-0000-0000-0000-000000000002"),
        _struct(type="assert-ref-snapshot-id", ref="main", snapshot_id=z + z % 2),
        _struct(type="assert-current-schema-id", current_schema_id=0),
        _struct(type="assert-last-assigned-field-id", last_assigned_field_id=k),
        _struct(type="assert-default-spec-id", default_spec_id=0),
        _struct(type="assert-last-assigned-partition-id", last_assigned_partition_id=1000),
        _struct(type="assert-nothing-known"),
    ]
    need = F.lit(None).cast("string")
    for i, x in enumerate(kinds):
        need = F.when(F.col("id") % 9 == i, F.to_json(F.array(x))).otherwise(need)
    requests = _history(spark, sf).select("id", "metadata", need.alias("requirements"), F.lit("[]").alias("updates"), F.lit(7).cast("long").alias("now_ms"))
    return C.apply(requests).select("id", "problem")


@query(
    "cm_upgrade",
    """SELECT c_custkey::BIGINT AS id, CASE WHEN c_custkey // 3 % 4 + 1 < c_custkey % 3 + 1 OR c_custkey // 3 % 4 + 1 > 3 THEN 'invalid' END AS problem,
      CASE WHEN c_custkey // 3 % 4 + 1 BETWEEN c_custkey % 3 + 1 AND 3 THEN (c_custkey // 3 % 4 + 1)::BIGINT END AS version,
      CASE WHEN c_custkey // 3 % 4 + 1 = 3 THEN 0::BIGINT END AS next_row_id FROM customer""",
)
def cm_upgrade(spark, sf):
    """Format versions go up, by one step or two, and never down."""
    old, to = F.col("c_custkey") % 3 + 1, F.expr("c_custkey div 3 % 4 + 1")
    base = F.lit(None).cast("string")
    for v in (1, 2, 3):
        base = F.when(old == v, F.lit(_base(v) + "}")).otherwise(base)
    df = _table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), base.alias("metadata"), F.lit("[]").alias("requirements"), F.to_json(F.array(_struct(action="upgrade-format-version", format_version=to))).alias("updates"), F.lit(7).cast("long").alias("now_ms"))
    m = F.from_json("metadata", "`format-version` long, `next-row-id` long")
    return C.apply(df).select("id", "problem", m["format-version"].alias("version"), m["next-row-id"].alias("next_row_id"))


#: Changes of the second column of a table of version 2, and whether they are allowed.
_CHANGES = [("date", False, None, None, True), ("timestamp", False, None, None, False), ("date", True, None, None, False), ("string", False, None, None, False), ("date", False, 5, None, False)]


@query(
    "cm_schemas",
    """SELECT p_partkey::BIGINT AS id, CASE WHEN p_partkey % 6 IN (1, 2, 3, 4) THEN 'invalid' END AS problem, CASE p_partkey % 6 WHEN 0 THEN 0::BIGINT WHEN 5 THEN 1::BIGINT END AS current, CASE p_partkey % 6 WHEN 0 THEN 2::BIGINT WHEN 5 THEN 3::BIGINT END AS last_column FROM part""",
)
def cm_schemas(spark, sf):
    """Schemas with a changed column, the same one again, and one that grows: the current schema after the request."""
    first = F.struct(F.lit(1).alias("id"), F.lit("id").alias("name"), F.lit("long").alias("type"), F.lit(True).alias("required"))
    text = F.lit(None).cast("string")
    for i, (kind, required, default, _, _) in enumerate(_CHANGES):
        second = [F.lit(2).alias("id"), F.lit("day").alias("name"), F.lit(kind).alias("type"), F.lit(required).alias("required"), *([] if default is None else [F.lit(default).alias("initial-default")])]
        fields = F.concat(F.lit("["), F.to_json(first), F.lit(","), F.to_json(F.struct(*second)), F.lit("]"))
        text = F.when(F.col("p_partkey") % 6 == i, fields).otherwise(text)
    second = F.struct(F.lit(2).alias("id"), F.lit("day").alias("name"), F.lit("date").alias("type"), F.lit(False).alias("required"))
    third = F.struct(F.lit(3).alias("id"), F.col("p_brand").alias("name"), F.lit("string").alias("type"), F.lit(False).alias("required"))
    text = F.coalesce(text, F.to_json(F.array(first, second, third)))
    updates = F.concat(F.lit('[{"action": "add-schema", "schema": {"fields": '), text, F.lit('}}, {"action": "set-current-schema", "schema-id": -1}]'))
    df = _table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("id"), F.lit(_base(2) + "}").alias("metadata"), F.lit("[]").alias("requirements"), updates.alias("updates"), F.lit(7).cast("long").alias("now_ms"))
    m = F.from_json("metadata", "`current-schema-id` long, `last-column-id` long")
    return C.apply(df).select("id", "problem", m["current-schema-id"].alias("current"), m["last-column-id"].alias("last_column"))


@query(
    "cm_layout",
    """SELECT s_suppkey::BIGINT AS id, CASE WHEN s_suppkey % 4 = 3 THEN 'invalid' END AS problem, CASE WHEN s_suppkey % 4 < 3 THEN 1::BIGINT END AS spec, CASE WHEN s_suppkey % 4 < 3 THEN 1000::BIGINT END AS last_partition,
      CASE WHEN s_suppkey % 4 < 3 THEN 1::BIGINT END AS sort_order, CASE WHEN s_suppkey % 4 < 3 THEN s_name END AS owner, CASE WHEN s_suppkey % 4 < 3 THEN 1::BIGINT END AS properties FROM supplier""",
)
def cm_layout(spark, sf):
    """Partition specs, sort orders and properties: all updates of a request apply, or none."""
    transform = F.element_at(F.array(*(F.lit(t) for t in ("year", "month", "day", "truncate[4]"))), F.col("s_suppkey").cast("int") % 4 + 1)
    parts = [
        _struct(action="set-properties", updates=F.struct(F.col("s_name").alias("owner"), F.lit("x").alias("old"))),
        _struct(action="remove-properties", removals=F.array(F.lit("old"), F.lit("never"))),
        _struct(action="add-sort-order", sort_order=F.struct(F.array(_struct(source_id=1, transform="identity", direction="asc", null_order="nulls-first")).alias("fields"))),
        _struct(action="set-default-sort-order", sort_order_id=-1),
        _struct(action="add-spec", spec=F.struct(F.array(_struct(source_id=2, transform=transform, name="p")).alias("fields"))),
        _struct(action="set-default-spec", spec_id=-1),
    ]
    updates = F.concat(F.lit("["), F.concat_ws(",", *(F.to_json(p) for p in parts)), F.lit("]"))
    df = _table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.lit(_base(2) + "}").alias("metadata"), F.lit("[]").alias("requirements"), updates.alias("updates"), F.lit(7).cast("long").alias("now_ms"))
    m = F.from_json("metadata", "`default-spec-id` long, `last-partition-id` long, `default-sort-order-id` long, properties map<string,string>")
    return C.apply(df).select("id", "problem", m["default-spec-id"].alias("spec"), m["last-partition-id"].alias("last_partition"), m["default-sort-order-id"].alias("sort_order"), m["properties"]["owner"].alias("owner"), F.when(F.col("metadata").isNotNull(), F.size(m["properties"]).cast("long")).alias("properties"))
