"""Deletion-vector blobs: 64-bit roaring bitmaps of row positions, with length, mark and checksum.

Layout: length (4 bytes, big-endian) of mark and bitmap, mark, bitmap, CRC-32 of both (big-endian). The bitmap is a
count (8 bytes) of keys, each with 4 bytes of key (the high half) and a 32-bit roaring bitmap in its portable form.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the format.
MARK = bytes.fromhex("D1D33964")
COOKIE_RUNS, COOKIE = 12347, 12346
SPARSE, OFFSETS_FROM = 4096, 4


class Broken(ValueError):
    pass


def _bitmap(values: np.ndarray) -> bytes:
    keys = np.unique(values >> 16)
    head, bodies, at = [], [], 8 + 8 * len(keys)
    offsets = []
    for k in keys:
        low = (values[values >> 16 == k] & 0xFFFF).astype(np.uint16)
        head.append(struct.pack("<HH", int(k), len(low) - 1))
        if len(low) <= SPARSE:
            body = low.astype("<u2").tobytes()
        else:
            bits = np.zeros(1 << 16, bool)
            bits[low] = True
            body = np.packbits(bits, bitorder="little").tobytes()
        offsets.append(struct.pack("<I", at))
        bodies.append(body)
        at += len(body)
    return struct.pack("<II", COOKIE, len(keys)) + b"".join(head) + b"".join(offsets) + b"".join(bodies)


def encode(positions: np.ndarray) -> bytes:
    positions = np.unique(positions.astype(np.uint64))
    tops = np.unique(positions >> np.uint64(32))
    body = struct.pack("<Q", len(tops)) + b"".join(struct.pack("<I", int(t)) + _bitmap((positions[positions >> np.uint64(32) == t] & np.uint64(0xFFFFFFFF)).astype(np.int64)) for t in tops)
    return struct.pack(">I", len(MARK) + len(body)) + MARK + body + struct.pack(">I", zlib.crc32(MARK + body))


def _containers(data: memoryview, at: int) -> tuple[list[np.ndarray], int]:
    (cookie,) = struct.unpack_from("<I", data, at)
    if cookie & 0xFFFF == COOKIE_RUNS:
        n = (cookie >> 16) + 1
        at += 4
        flags = np.unpackbits(np.frombuffer(data[at : at + (n + 7) // 8], np.uint8), bitorder="little")[:n].astype(bool)
        at += (n + 7) // 8
    elif cookie == COOKIE:
        (n,) = struct.unpack_from("<I", data, at + 4)
        flags, at = np.zeros(n, bool), at + 8
    else:
        raise Broken("no bitmap")
    heads = np.frombuffer(data[at : at + 4 * n], "<u2").reshape(-1, 2).astype(np.int64)
    at += 4 * n
    if not flags.any() or n >= OFFSETS_FROM:
        at += 4 * n
    out = []
    for (key, less), run in zip(heads, flags, strict=True):
        if run:
            (k,) = struct.unpack_from("<H", data, at)
            pairs = np.frombuffer(data[at + 2 : at + 2 + 4 * k], "<u2").reshape(-1, 2).astype(np.int64)
            low = np.concatenate([np.arange(s, s + m + 1) for s, m in pairs]) if k else np.zeros(0, np.int64)
            at += 2 + 4 * k
        elif less + 1 <= SPARSE:
            low = np.frombuffer(data[at : at + 2 * (less + 1)], "<u2").astype(np.int64)
            at += 2 * (less + 1)
        else:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(data[at : at + 8192], np.uint8), bitorder="little"))
            at += 8192
        if len(low) != less + 1:
            raise Broken("a container has another number of positions")
        out.append(low + (key << 16))
    return out, at


def decode(blob: bytes) -> np.ndarray:
    (size,) = struct.unpack_from(">I", blob)
    body = memoryview(blob)[4 : 4 + size]
    if bytes(body[:4]) != MARK or len(blob) != size + 8 or struct.unpack_from(">I", blob, 4 + size)[0] != zlib.crc32(body):
        raise Broken("the blob's mark, length or checksum is wrong")
    (tops,) = struct.unpack_from("<Q", body, 4)
    at, out = 12, [np.zeros(0, np.int64)]
    for _ in range(tops):
        (top,) = struct.unpack_from("<I", body, at)
        parts, at = _containers(body, at + 4)
        out += [p + (top << 32) for p in parts]
    return np.concatenate(out)


def encoded(positions: DataFrame, key: str) -> DataFrame:
    """(key, blob) of positions(key, pos): one vector for each file, as the table format has it."""
    kind = positions.schema[key].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        return pa.table({key: rows.column(key).slice(0, 1), "blob": pa.array([encode(rows.column("pos").to_numpy())], pa.binary())})

    return positions.select(key, "pos").groupBy(key).applyInArrow(run, f"`{key}` {kind}, blob binary")


def decoded(vectors: DataFrame, key: str) -> DataFrame:
    """positions(key, pos) of (key, blob)."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                pos = decode(b.column("blob")[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([b.column(key)[k].as_py()] * len(pos), b.column(key).type), pa.array(pos, pa.int64())], [key, "pos"])

    return vectors.select(key, "blob").mapInArrow(run, f"`{key}` {kind}, pos long")
