"""Avro object container files, read and written in Arrow batches (Spark's own module for them is not installed).

Rows of null-or-primitive fields, projected by name, block by block; codecs null and deflate. Records of any type are read and
written as Python values, and projected by paths of field ids.
"""

from __future__ import annotations

import io
import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from skein.sources.files import opened, paths

MAGIC = b"Obj\x01"
TYPES = {"long": "long", "bigint": "long", "int": "int", "string": "string", "double": "double", "float": "float", "boolean": "boolean", "binary": "bytes"}
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "bytes": pa.binary()}


#: Records of a block that is written, and those that are Python values at once; a block ends early at so many bytes.
ROWS, BYTES = 4096, 1 << 20


class Broken(ValueError):
    pass


def _number(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Broken("the file is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        out = shift = 0
        while True:
            b = self.take(1)[0]
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out >> 1 ^ -(out & 1)

    def value(self, kind):
        if isinstance(kind, list):
            return self.value(kind[self.number()])
        if isinstance(kind, dict):
            if kind["type"] == "record":
                return {f["name"]: self.value(f["type"]) for f in kind["fields"]}
            if kind["type"] in ("array", "map"):
                out = []
                while n := self.number():
                    if n < 0:
                        n = -n
                        self.number()
                    for _ in range(n):
                        out.append((self.value("string"), self.value(kind["values"])) if kind["type"] == "map" else self.value(kind["items"]))
                return dict(out) if kind["type"] == "map" else out
            return self.take(kind["size"]) if kind["type"] == "fixed" else self.value(kind["type"])
        if kind == "null":
            return None
        if kind in ("int", "long"):
            return self.number()
        if kind == "boolean":
            return self.take(1) == b"\1"
        if kind in ("float", "double"):
            return struct.unpack("<f" if kind == "float" else "<d", self.take(4 if kind == "float" else 8))[0]
        raw = self.take(self.number())
        return raw.decode() if kind == "string" else raw


def _varint(f) -> int:
    out = shift = 0
    while True:
        b = f.read(1)
        if not b:
            raise Broken("the file is cut off")
        out |= (b[0] & 127) << shift
        shift += 7
        if b[0] < 128:
            return out >> 1 ^ -(out & 1)


def _exactly(f, n: int) -> bytes:
    got = f.read(n) if n >= 0 else b""
    if len(got) != n:
        raise Broken("the file is cut off")
    return got


def _head(f) -> tuple[dict[str, bytes], bytes]:
    """The facts in an open container's head, and its mark."""
    if f.read(4) != MAGIC:
        raise Broken("no object container file")
    meta = {}
    while n := _varint(f):
        if n < 0:
            n = -n
            _varint(f)
        for _ in range(n):
            key = _exactly(f, _varint(f)).decode()
            meta[key] = _exactly(f, _varint(f))
    return meta, _exactly(f, 16)


def blocks(f) -> Iterator[list]:
    """The records of an open file, block by block and at most ROWS at once, so that memory holds a block's bytes and few records."""
    meta, sync = _head(f)
    schema, codec = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null")
    if codec not in (b"null", b"deflate"):
        raise Broken(f"codec {codec.decode()}")
    while ahead := f.read(1):
        number = bytearray(ahead)
        while number[-1] > 127:
            number += _exactly(f, 1)
        count, block = _Reader(bytes(number)).number(), _exactly(f, _varint(f))
        if _exactly(f, 16) != sync:
            raise Broken("a block does not end with the file's mark")
        part = _Reader(zlib.decompress(block, -15) if codec == b"deflate" else block)
        for lo in range(0, count, ROWS):
            yield [part.value(schema) for _ in range(min(ROWS, count - lo))]
        if part.at != len(part.data):
            raise Broken("a block has more than its records")


def records(data: bytes) -> Iterator[dict]:
    for rows in blocks(io.BytesIO(data)):
        yield from rows


def project(value, schema, path: tuple[int, ...]):
    """The value at a path of field ids through records, of which unions may be null on the way."""
    for number in path:
        schema = next((s for s in schema if s != "null"), "null") if isinstance(schema, list) else schema
        if value is None or not isinstance(schema, dict) or schema.get("type") != "record":
            return None
        field = next((f for f in schema["fields"] if f.get("field-id") == number), None)
        if field is None:
            return None
        value, schema = value[field["name"]], field["type"]
    return value


_PACK = {"long": _number, "int": _number, "double": lambda v: struct.pack("<d", v), "float": lambda v: struct.pack("<f", v), "boolean": lambda v: b"\1" if v else b"\0", "string": lambda v: _number(len(v.encode())) + v.encode(), "bytes": lambda v: _number(len(v)) + bytes(v)}


def _opening(fields: list[tuple[str, str]], deflate: bool, sync: bytes) -> bytes:
    schema = json.dumps({"type": "record", "name": "row", "fields": [{"name": n, "type": ["null", k]} for n, k in fields]}).encode()
    meta = b"\4" + b"".join(_number(len(x)) + x for x in (b"avro.schema", schema, b"avro.codec", b"deflate" if deflate else b"null")) + b"\0"
    return MAGIC + meta + sync


def _closed(count: int, body: bytes, deflate: bool, sync: bytes) -> bytes:
    """A block."""
    if deflate:
        engine = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = engine.compress(body) + engine.flush()
    return _number(count) + _number(len(body)) + body + sync


def pieces(rows: Iterable[dict], fields: list[tuple[str, str]], deflate: bool = True) -> Iterator[bytes]:
    """A container piece by piece, its head and its blocks, so that memory holds a block."""
    sync, count, body = os.urandom(16), 0, bytearray()
    yield _opening(fields, deflate, sync)
    for row in rows:
        for n, k in fields:
            body += b"\0" if row[n] is None else b"\2" + _PACK[k](row[n])
        count += 1
        if count == ROWS or len(body) >= BYTES:
            yield _closed(count, bytes(body), deflate, sync)
            count, body = 0, bytearray()
    if count:
        yield _closed(count, bytes(body), deflate, sync)


def container(rows: list[dict], fields: list[tuple[str, str]], deflate: bool = True) -> bytes:
    return b"".join(pieces(rows, fields, deflate))


def packed(value, kind) -> bytes:
    """A value of any Avro type; of unions, null or the first other branch."""
    if isinstance(kind, list):
        k = next(i for i, x in enumerate(kind) if (x == "null") == (value is None))
        return _number(k) + packed(value, kind[k])
    if isinstance(kind, dict):
        if kind["type"] == "record":
            return b"".join(packed(value.get(f["name"]), f["type"]) for f in kind["fields"])
        if kind["type"] == "array":
            return (_number(len(value)) + b"".join(packed(x, kind["items"]) for x in value) if value else b"") + b"\0"
        return packed(value, kind["type"])
    if kind == "null":
        return b""
    if kind in ("int", "long"):
        return _number(value)
    if kind == "boolean":
        return b"\1" if value else b"\0"
    if kind in ("float", "double"):
        return struct.pack("<f" if kind == "float" else "<d", value)
    raw = value.encode() if kind == "string" else bytes(value)
    return _number(len(raw)) + raw


def file(rows: list[dict], schema: dict, more: dict[str, str], block: int = 1000) -> bytes:
    """A container of records of a schema, deflated in blocks, with further facts in its head."""
    head = {"avro.schema": json.dumps(schema), "avro.codec": "deflate", **more}
    sync = os.urandom(16)
    out = [MAGIC, _number(len(head)), *(_number(len(x.encode())) + x.encode() for kv in head.items() for x in kv), b"\0", sync]
    for lo in range(0, len(rows), block):
        engine = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = engine.compress(b"".join(packed(r, schema) for r in rows[lo : lo + block])) + engine.flush()
        out += [_number(len(rows[lo : lo + block])), _number(len(body)), body, sync]
    return b"".join(out)


def head(data: bytes) -> dict[str, str]:
    """The facts in a container's head."""
    return {k: v.decode() for k, v in _head(io.BytesIO(data))[0].items()}


def read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The named fields of all *.avro files under a path; a field that a file lacks is null."""
    fields = spark.createDataFrame([], schema).schema.fields
    kinds = [(f.name, TYPES[f.dataType.simpleString()]) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column("path").to_pylist():
                with opened(at) as f:
                    for rows in blocks(io.BufferedReader(f)):
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], ARROW[k]) for n, k in kinds], [n for n, _ in kinds])

    return paths(spark, path, "*.avro").mapInArrow(run, StructType(fields))


def write(df: DataFrame, path: str) -> None:
    """One file for each task with rows; a file appears under its name when it is complete."""
    kinds = [(f.name, TYPES[f.dataType.simpleString()]) for f in df.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs as filesystems
        from pyspark import TaskContext

        total = 0

        def rows(first: pa.RecordBatch) -> Iterator[dict]:
            nonlocal total
            for b in chain([first], batches):
                for lo in range(0, b.num_rows, ROWS):
                    yield from b.slice(lo, ROWS).to_pylist()
                total += b.num_rows

        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            fs, root = filesystems.FileSystem.from_uri(path)
            fs.create_dir(root, recursive=True)
            part = f"{root}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as f:
                for piece in pieces(rows(first), kinds):
                    f.write(piece)
            fs.move(part, f"{root}/part-{TaskContext.get().partitionId():05d}.avro")
        yield pa.RecordBatch.from_pydict({"n": pa.array([total], pa.int64())})

    df.mapInArrow(run, "n long").collect()  # a number for each task
