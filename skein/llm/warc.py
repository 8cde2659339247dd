"""WARC archives: written as whole-file gzip streams, then normalised to one gzip member per record with an index.

Writing deduplicates payloads: of equal payloads of at least MIN_PAYLOAD bytes the row with the largest page_id is a
response record, the others are revisit records that refer to it. Archives are written by Spark's own text writer, a
record per row, with gzip over the whole file.

The normaliser takes archives as they come, a task for some of them: it reads each file as a stream, inflates it once, and
writes every record as it comes as a gzip member of its own, and beside it a line of the sidecar index: record id, type,
target, offset, length. So memory holds one record, whatever the size of an archive. Files have the name of the attempt that
wrote them, and the returned table names those of the attempts that succeeded: what a lost executor leaves is not read.
Reading back goes through the index: each member is a range of the file and is inflated alone; no archive is shuffled.

Defined results: a null html is an empty payload; a null URL is an empty target, and control characters and spaces in
URLs are percent-encoded; rows with the same page_id as the response of their payload are responses too; a null
page_id is less than any other, and a revisit to it has no refers_to; an empty table makes no archive; other columns are
not looked at. Texts are UTF-8, as Spark has them.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.spool import folder, remove, spool

MIN_PAYLOAD = 1000
#: The record's end, the time of capture, and the profile of revisits by digest.
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 18


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, and refers_to with `revisit` for copies."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload").cast("long"))
    large = rows.filter(F.col("size") >= MIN_PAYLOAD).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "size", "first")
    large = spool(large, "payloads")
    out = rows.join(large, ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "payload", "digest", "size", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def _record():
    """The record of a row, but for its end, as text."""

    def line(name: str, value) -> list:
        return [F.lit(name + ": "), value, F.lit("\r\n")]

    def identity(page):
        h = F.md5(F.concat(F.lit("page "), F.coalesce(page.cast("string"), F.lit("null"))).cast("binary"))
        return F.concat(F.lit("<urn:uuid:"), *(x for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, b)]), F.lit(">"))

    target = F.col("url")
    for c in [*range(0x21), 0x7F]:
        target = F.replace(target, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))
    again = F.when(F.col("revisit"), F.concat(*line("WARC-Profile", F.lit(PROFILE)), *line("WARC-Refers-To", identity(F.col("refers_to"))), *line("WARC-Refers-To-Page", F.coalesce(F.col("refers_to").cast("string"), F.lit(""))))).otherwise(F.lit(""))
    head = [F.lit("WARC/1.1\r\n"), *line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), *line("WARC-Record-ID", identity(F.col("page_id"))), *line("WARC-Date", F.lit(DATE)), *line("WARC-Target-URI", target), *line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), *line("WARC-Payload-Length", F.col("size").cast("string")), *line("WARC-Page", F.coalesce(F.col("page_id").cast("string"), F.lit(""))), again, *line("Content-Type", F.lit("application/http; msgtype=response"))]
    return F.concat(*head, *line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body)


def write(pages: DataFrame, at: str) -> None:
    """Archives of the pages under the folder `at`: gzip over whole files."""
    rows = planned(pages).select(_record().alias("value"))
    rows.write.option("compression", "gzip").option("lineSep", END).text(at)


class Broken(ValueError):
    """The bytes are no sequence of WARC records."""


def pieces(data: bytes) -> Iterator[bytes]:
    for at in range(0, len(data), PIECE):
        yield data[at : at + PIECE]


def stream(f) -> Iterator[bytes]:
    """The pieces of an open file."""
    while piece := f.read(PIECE):
        yield piece


def inflated(source: Iterator[bytes]) -> Iterator[bytes]:
    """Pieces of a gzip file's content, member after member, each inflated once; zeros after the last one are padding."""
    engine, rest, begun = zlib.decompressobj(31), b"", False
    while True:
        if not rest:
            rest = next(source, b"")
            if not rest:
                break
        if not begun:
            rest = rest.lstrip(b"\0") if engine is None else rest
            if not rest:
                continue
            engine, begun = zlib.decompressobj(31), True
        out = engine.decompress(rest, PIECE)
        rest = engine.unconsumed_tail
        if engine.eof:
            rest, begun, engine = engine.unused_data, False, None
        if out:
            yield out
    if begun:
        out = engine.flush()
        if out:
            yield out
        if not engine.eof:
            raise Broken("the gzip stream is cut off")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, whole record with its end) of a stream of records."""
    held = bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 or not held.startswith(b"WARC/"):
            while held[:2] == b"\r\n":
                del held[:2]
            if held[:5] and not b"WARC/".startswith(bytes(held[:5])):
                raise Broken("no record begins here")
            if not fill(len(held) + 1):
                if held.strip():
                    raise Broken("the last record is cut off")
                return
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = end + 4 + int(headers["content-length"])
        if not fill(size + 4) and not fill(size):
            raise Broken("the last record is cut off")
        yield headers, bytes(held[:size]) + END.encode()
        del held[:size]
        if held[:4] == END.encode():
            del held[:4]


def normalise(spark, source: str, target: str) -> DataFrame:
    """Rewrites the archives under `source` into `target`: (archive, index, records) of each, which must be written once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as filesystems

        fs, root = filesystems.FileSystem.from_uri(target)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = f"{os.path.basename(path).removesuffix('.gz').removesuffix('.txt')}-{uuid.uuid4().hex}"
                here, at = filesystems.FileSystem.from_uri(path)
                offset = count = 0
                with here.open_input_stream(at, compression=None) as f, fs.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out, fs.open_output_stream(f"{root}/{name}.index", compression=None) as index:
                    for headers, record in records(inflated(stream(f))):
                        member = gzip.compress(record, 6, mtime=0)
                        out.write(member)
                        line = {"id": headers.get("warc-record-id"), "type": headers.get("warc-type"), "target": headers.get("warc-target-uri"), "offset": offset, "length": len(member)}
                        index.write(json.dumps(line).encode() + b"\n")
                        offset, count = offset + len(member), count + 1
                yield pa.RecordBatch.from_pydict({"archive": pa.array([f"{name}.warc.gz"]), "index": pa.array([f"{name}.index"]), "records": pa.array([count], pa.int64())})

    return files.mapInArrow(run, "archive string, index string, records long")


def read(archives: DataFrame, at: str) -> DataFrame:
    """Every record of normalised archives(archive, index) under a folder, by the offsets of their indexes: archive, offset,
    page_id (text), record_type, payload_bytes, payload_digest and refers_to (text)."""

    def facts(name: str, x: dict, member: bytes) -> tuple:
        (headers, record), *more = records(iter([zlib.decompress(member, 31)]))
        if more or headers.get("warc-record-id") != x["id"]:
            raise Broken("the index does not fit the archive")
        if headers["warc-type"] == "revisit":
            size, digest = int(headers["warc-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
        else:
            body = record[record.index(b"\r\n\r\n") + 4 : -4]
            payload = body[body.index(b"\r\n\r\n") + 4 :]
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
            if headers["warc-payload-digest"] != f"sha1:{digest}":
                raise Broken("the payload does not fit its digest")
        return name, x["offset"], headers.get("warc-page") or None, headers["warc-type"], size, digest, headers.get("warc-refers-to-page") or None

    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    names = ("archive", "offset", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as filesystems

        fs, root = filesystems.FileSystem.from_uri(at)
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist(), strict=True):
                rows: list[tuple] = []
                with fs.open_input_file(f"{root}/{archive}") as members, fs.open_input_stream(f"{root}/{index}", compression=None) as lines:
                    for line in io.BufferedReader(lines):
                        x = json.loads(line)
                        members.seek(x["offset"])
                        rows.append(facts(archive, x, members.read(x["length"])))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], list(names))
                            rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], list(names))

    each = archives.select("archive", "index").repartition(max(1, archives.count()), "archive")  # names, not their bytes
    return each.mapInArrow(run, "archive string, offset long, page_id string, record_type string, payload_bytes long, payload_digest string, refers_to string")


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the pages, written, normalised and read back."""
    spark = pages.sparkSession
    raw, clean = folder(spark, "warc-raw"), folder(spark, "warc")
    write(pages, raw)
    archives = spool(normalise(spark, raw, clean), "normalised")
    remove(spark, raw)
    kind = pages.schema["page_id"].dataType.simpleString()
    return read(archives, clean).select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


SQL = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS m FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {MIN_PAYLOAD} AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_PAYLOAD} AND m <> page_id THEN m END AS refers_to
FROM r
"""
