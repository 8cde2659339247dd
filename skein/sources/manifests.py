"""Manifest lists and manifests of table snapshots: Avro files of the public table format, read into frames of entries.

A snapshot names a list; the list has a row for each manifest; a manifest has an entry for each file. Entries without a
sequence, a snapshot or a first row id take those of their manifest's row in the list. A list is one small file; manifests
are read by tasks, a file each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.table import compared, manifest_totals, row_ids
from skein.sources import avro


def _field(number: int, name: str, kind, optional: bool = True) -> dict:
    return {"name": name, "field-id": number, "type": ["null", kind] if optional else kind} | ({"default": None} if optional else {})


def _map(key: int, value: int, kind: str) -> dict:
    item = {"type": "record", "name": f"k{key}_v{value}", "fields": [_field(key, "key", "int", False), _field(value, "value", kind, False)]}
    return {"type": "array", "items": item, "logicalType": "map"}


def _array(number: int, kind: str) -> dict:
    return {"type": "array", "items": kind, "element-id": number}


#: Names and ids of the public table format.
_FILE = {
    "type": "record",
    "name": "r2",
    "fields": [
        _field(134, "content", "int", False),
        _field(100, "file_path", "string", False),
        _field(101, "file_format", "string", False),
        _field(102, "partition", {"type": "record", "name": "r102", "fields": [_field(1000, "partition", "string")]}, False),
        _field(103, "record_count", "long", False),
        _field(104, "file_size_in_bytes", "long", False),
        _field(109, "value_counts", _map(119, 120, "long")),
        _field(110, "null_value_counts", _map(121, 122, "long")),
        _field(137, "nan_value_counts", _map(138, 139, "long")),
        _field(125, "lower_bounds", _map(126, 127, "bytes")),
        _field(128, "upper_bounds", _map(129, 130, "bytes")),
        _field(135, "equality_ids", _array(136, "int")),
        _field(142, "first_row_id", "long"),
        _field(143, "referenced_data_file", "string"),
        _field(144, "content_offset", "long"),
        _field(145, "content_size_in_bytes", "long"),
    ],
}
ENTRY = {"type": "record", "name": "manifest_entry", "fields": [_field(0, "status", "int", False), _field(1, "snapshot_id", "long"), _field(3, "sequence_number", "long"), _field(4, "file_sequence_number", "long"), _field(2, "data_file", _FILE, False)]}
_COUNTS = [(504, "added_files_count", "int"), (505, "existing_files_count", "int"), (506, "deleted_files_count", "int"), (512, "added_rows_count", "long"), (513, "existing_rows_count", "long"), (514, "deleted_rows_count", "long")]
LIST = {
    "type": "record",
    "name": "manifest_file",
    "fields": [_field(500, "manifest_path", "string", False), _field(501, "manifest_length", "long", False), _field(502, "partition_spec_id", "int", False), _field(517, "content", "int", False), _field(515, "sequence_number", "long", False), _field(516, "min_sequence_number", "long", False), _field(503, "added_snapshot_id", "long", False), *(_field(i, n, k, False) for i, n, k in _COUNTS), _field(520, "first_row_id", "long")],
}

#: Columns of entries, and where each comes from.
_COLUMNS = "manifest string, pos long, schema_id int, spec_id int, status int, added_by long, data_sequence long, content int, file_path string, file_format string, partition string, record_count long, file_bytes long, values map<int,long>, nulls map<int,long>, nans map<int,long>, lower map<int,binary>, upper map<int,binary>, equality_ids array<int>, first_row_id long, referenced string"
_METRICS = {"values": "value_counts", "nulls": "null_value_counts", "nans": "nan_value_counts", "lower": "lower_bounds", "upper": "upper_bounds"}
_STATUS = ("existing", "added", "deleted")


def encode(entries: DataFrame) -> DataFrame:
    """(manifest, blob, entries, ...counts): the Avro file of each manifest of entries(manifest, pos, ...), of which missing
    columns are null."""

    def run(rows: pa.Table) -> pa.Table:
        found = sorted(rows.to_pylist(), key=lambda r: (r.get("pos") or 0, r["file_path"]))
        out = []
        for r in found:
            f = {"content": r["content"], "file_path": r["file_path"], "file_format": r.get("file_format") or "parquet", "partition": {"partition": r.get("partition")}, "record_count": r["record_count"], "file_size_in_bytes": r["file_bytes"], "equality_ids": r.get("equality_ids"), "first_row_id": r.get("first_row_id"), "referenced_data_file": r.get("referenced")}
            f |= {name: None if r.get(c) is None else [{"key": k, "value": v} for k, v in sorted(dict(r[c]).items())] for c, name in _METRICS.items()}
            out.append({"status": r["status"], "snapshot_id": r.get("added_by"), "sequence_number": r.get("data_sequence"), "file_sequence_number": r.get("data_sequence"), "data_file": f})
        first = found[0]
        more = {"schema-id": str(first.get("schema_id") or 0), "partition-spec-id": str(first.get("spec_id") or 0), "format-version": "2", "content": "data" if all(r["content"] == 0 for r in found) else "deletes"}
        counts = [sum(1 for r in found if r["status"] == k) for k in range(3)] + [sum(r["record_count"] for r in found if r["status"] == k) for k in range(3)]
        columns = {"manifest": first["manifest"], "blob": avro.file(out, ENTRY, more), "spec_id": first.get("spec_id") or 0, "deletes": more["content"] == "deletes", "least": min((r["data_sequence"] for r in found if r.get("data_sequence") is not None), default=None)}
        columns |= {f"{n}_{what}": counts[3 * w + k] for w, what in enumerate(("files", "rows")) for k, n in enumerate(_STATUS)}
        return pa.Table.from_pylist([columns], pa.schema([("manifest", pa.string()), ("blob", pa.binary()), ("spec_id", pa.int32()), ("deletes", pa.bool_()), ("least", pa.int64()), *((f"{n}_{what}", pa.int64()) for what in ("files", "rows") for n in _STATUS)]))

    counts = ", ".join(f"{n}_{what} long" for what in ("files", "rows") for n in _STATUS)
    return entries.withColumn("manifest", F.col("manifest").cast("string")).groupBy("manifest").applyInArrow(run, f"manifest string, blob binary, spec_id int, deletes boolean, least long, {counts}")


def publish(files, entries: DataFrame, snapshot_id: int, sequence: int, kept: list[dict] = (), first_row_id: int | None = None) -> tuple[str, list[dict]]:
    """Writes the manifests of the entries and a list of them after those kept; the list's name and its rows. `files` is a
    folder with create(name, bytes)."""
    rows = [dict(r) for r in kept]
    for r in encode(entries).toLocalIterator():
        name = f"metadata/{snapshot_id}-{r.manifest}.avro"
        files.create(name, bytes(r.blob))
        row = {"manifest_path": name, "manifest_length": len(r.blob), "partition_spec_id": r.spec_id, "content": int(r.deletes), "sequence_number": sequence, "min_sequence_number": min(sequence, r.least if r.least is not None else sequence), "added_snapshot_id": snapshot_id, "first_row_id": None}
        row |= {f"{n}_{what}_count": r[f"{n}_{what}"] for what in ("files", "rows") for n in _STATUS}
        if first_row_id is not None and not r.deletes:
            row["first_row_id"] = first_row_id
            first_row_id += r.added_rows + r.existing_rows
        rows.append(row)
    name = f"metadata/snap-{snapshot_id}.avro"
    files.create(name, avro.file(rows, LIST, {"snapshot-id": str(snapshot_id), "sequence-number": str(sequence), "format-version": "2"}))
    return name, rows


def read_list(files, name: str) -> list[dict]:
    """The rows of a manifest list."""
    return list(avro.records(files.read_bytes(name)))


def read_entries(spark: SparkSession, root: str, rows: list[dict], live: bool = False) -> DataFrame:
    """The entries of a list's manifests, with what they take from the list; `live` leaves out what was deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("manifest", pa.string()), ("pos", pa.int64()), ("schema_id", pa.int32()), ("spec_id", pa.int32()), ("status", pa.int32()), ("added_by", pa.int64()), ("data_sequence", pa.int64()), ("content", pa.int32()), ("file_path", pa.string()), ("file_format", pa.string()), ("partition", pa.string()), ("record_count", pa.int64()), ("file_bytes", pa.int64()), *((c, pa.map_(pa.int32(), pa.int64())) for c in ("values", "nulls", "nans")), *((c, pa.map_(pa.int32(), pa.binary())) for c in ("lower", "upper")), ("equality_ids", pa.list_(pa.int32())), ("first_row_id", pa.int64()), ("referenced", pa.string())])
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                data, out = content.as_py(), []
                facts = avro.head(data)
                for pos, e in enumerate(avro.records(data)):
                    if live and e["status"] == 2:
                        continue
                    f = e["data_file"]
                    row = {"manifest": path.as_py().rsplit("/", 1)[-1], "pos": pos, "schema_id": int(facts.get("schema-id", 0)), "spec_id": int(facts.get("partition-spec-id", 0)), "status": e["status"], "added_by": e["snapshot_id"], "data_sequence": e["sequence_number"], "content": f["content"], "file_path": f["file_path"], "file_format": f["file_format"], "record_count": f["record_count"], "file_bytes": f["file_size_in_bytes"], "equality_ids": f.get("equality_ids"), "first_row_id": f.get("first_row_id"), "referenced": f.get("referenced_data_file")}
                    part = list(f["partition"].values())
                    row["partition"] = part[0] if len(part) == 1 and (part[0] is None or isinstance(part[0], str)) else json.dumps(f["partition"], sort_keys=True)
                    row |= {c: None if f.get(n) is None else [(x["key"], x["value"]) for x in f[n]] for c, n in _METRICS.items()}
                    out.append(row)
                yield from pa.Table.from_pylist(out, kinds).to_batches()

    if not rows:
        return spark.createDataFrame([], _COLUMNS)
    files = spark.read.format("binaryFile").load([f"{root}/{r['manifest_path']}" for r in rows]).select("path", "content")
    own = spark.createDataFrame([(r["manifest_path"].rsplit("/", 1)[-1], r["sequence_number"], r["added_snapshot_id"], r["first_row_id"]) for r in rows], "manifest string, _s long, _a long, _r long")
    found = files.mapInArrow(run, _COLUMNS).join(F.broadcast(own), "manifest")
    if any(r["first_row_id"] is not None for r in rows):
        found = row_ids(found, F.col("_r")).drop("first_row_id").withColumnRenamed("row_id", "first_row_id")
    return found.withColumn("data_sequence", F.coalesce("data_sequence", "_s")).withColumn("added_by", F.coalesce("added_by", "_a")).drop("_s", "_a", "_r")


def wrong_totals(spark: SparkSession, rows: list[dict], entries: DataFrame) -> DataFrame:
    """Manifests whose entries are not what the list says: (manifest, problem)."""
    names = [f"{n}_{what}" for what in ("files", "rows") for n in _STATUS]
    said = spark.createDataFrame([(r["manifest_path"].rsplit("/", 1)[-1], *(int(r[f"{n}_count"]) for n in names)) for r in rows], "manifest string, " + ", ".join(f"{n} long" for n in names))
    return compared(said, manifest_totals(entries), ["manifest"], names)
