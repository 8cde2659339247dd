"""Puffin files: footers, blob metadata, and the blobs themselves, deletion vectors among them."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skein.sources.files import opened, paths

MAGIC = b"PFA1"


class Broken(ValueError):
    pass


def footer(data: bytes) -> dict:
    return footer_of(io.BytesIO(data), len(data))


def footer_of(f, length: int) -> dict:
    """{"blobs": [...], "properties": {...}} of an open file whose footer is not compressed."""

    def part(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    if length < 24 or part(0, 4) != MAGIC or part(length - 4, 4) != MAGIC:
        raise Broken("no puffin file")
    size, flags = struct.unpack("<iI", part(length - 12, 8))
    if flags & 1:
        raise Broken("the footer is compressed")
    if not 0 <= size <= length - 20 or part(length - 16 - size, 4) != MAGIC:
        raise Broken("the footer's size is wrong")
    out = json.loads(part(length - 12 - size, size))
    for b in out["blobs"]:
        if b["offset"] < 4 or b["length"] < 0 or b["offset"] + b["length"] > length - 16 - size:
            raise Broken("a blob lies outside the file")
    return out


def file(blobs: list[tuple[dict, bytes]], properties: dict | None = None) -> bytes:
    body, metas = bytearray(MAGIC), []
    for meta, data in blobs:
        metas.append(meta | {"offset": len(body), "length": len(data)})
        body += data
    raw = json.dumps({"blobs": metas, "properties": properties or {}}).encode()
    return bytes(body) + MAGIC + raw + struct.pack("<iI", len(raw), 0) + MAGIC


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, type, data_file, offset, length, cardinality, blob) of all blobs under a path, a blob at a time."""
    kinds = pa.schema([("path", pa.string()), ("type", pa.string()), ("data_file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("cardinality", pa.int64()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, length in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                with opened(at) as f:
                    for m in footer_of(f, length)["blobs"]:
                        f.seek(m["offset"])
                        facts = m.get("properties", {})
                        row = {"path": at, "type": m["type"], "data_file": facts.get("referenced-data-file"), "offset": m["offset"], "length": m["length"], "cardinality": int(facts.get("cardinality", -1)), "blob": f.read(m["length"])}
                        yield pa.RecordBatch.from_pylist([row], kinds)

    return paths(spark, path, "*.puffin").mapInArrow(run, "path string, type string, data_file string, offset long, length long, cardinality long, blob binary")
