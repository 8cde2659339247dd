"""Facts of files without their rows: Parquet footers and column chunks, ORC and Avro probes, digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What files begin or end with.
MAGIC = {"parquet": b"PAR1", "orc": b"ORC", "puffin": b"PFA1", "avro": b"Obj\x01"}
PIECE = 1 << 20


def paths(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length) of files, without their content."""
    reader = spark.read.format("binaryFile")
    return (reader if glob is None else reader.option("pathGlobFilter", glob)).load(path).select("path", "length")


def opened(path: str):
    """A file, opened by a task for reading any part of it."""
    from pyarrow import fs as filesystems

    fs, at = filesystems.FileSystem.from_uri(path)
    return fs.open_input_file(at)


def digests(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, sha256, md5) of whole files, read piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for at in b.column("path").to_pylist():
                sums = hashlib.sha256(), hashlib.md5()
                with opened(at) as f:
                    while piece := f.read(PIECE):
                        for s in sums:
                            s.update(piece)
                found.append([s.hexdigest() for s in sums])
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("length"), *(pa.array([f[k] for f in found], pa.string()) for k in range(2))], ["path", "length", "sha256", "md5"])

    return paths(spark, path, glob).mapInArrow(run, "path string, length long, sha256 string, md5 string")


def kinds(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, kind): what each file is by its first and last bytes, which are all that is read."""

    def kind(at: str, length: int) -> str:
        with opened(at) as f:
            head = f.read(4)
            f.seek(max(0, length - 4))
            tail = f.read(4)
        both = [n for n in ("parquet", "puffin") if head == tail == MAGIC[n]]
        return both[0] if both else "avro" if head == MAGIC["avro"] else "orc" if head[:3] == MAGIC["orc"] else "unknown"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [kind(at, n) for at, n in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(found, pa.string())], ["path", "kind"])

    return paths(spark, path, glob).mapInArrow(run, "path string, kind string")


def _parquet(spark: SparkSession, path: str, schema: str, rows) -> DataFrame:
    """rows(path, footer) of each Parquet file, of which only the footer is read."""
    files = paths(spark, path, "*.parquet").select("path")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in batches:
            for at in b.column("path").to_pylist():
                with opened(at) as f:
                    found = rows(at, pq.ParquetFile(f).metadata)
                kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names)

    return files.mapInArrow(run, schema)


def parquet_footers(spark: SparkSession, path: str) -> DataFrame:
    return _parquet(spark, path, "path string, rows long, groups int, columns int, written_by string", lambda at, m: [(at, m.num_rows, m.num_row_groups, m.num_columns, m.created_by)])


def parquet_columns(spark: SparkSession, path: str) -> DataFrame:
    """A row per row group and column: codec, encodings, sizes, bounds as text, nulls and distinct values if known."""

    def rows(at, m):
        out = []
        for g in range(m.num_row_groups):
            for k in range(m.num_columns):
                c = m.row_group(g).column(k)
                s = c.statistics
                bounds = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
                out.append((at, g, c.path_in_schema, c.compression, ",".join(sorted(set(c.encodings))), c.total_compressed_size, c.total_uncompressed_size, *bounds, s.null_count if s is not None and s.has_null_count else None, s.distinct_count if s is not None and s.has_distinct_count else None))
        return out

    return _parquet(spark, path, "path string, group int, column string, codec string, encodings string, compressed long, uncompressed long, lower string, upper string, nulls long, distinct long", rows)
