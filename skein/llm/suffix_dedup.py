"""Exact substring deduplication by prefix-free parsing.

Texts are UTF-8 bytes. A trigger is a `TRIGGER`-byte string with the least rolling hash among those of some `length`-byte
window (the leftmost of equals), so each window has exactly one trigger, found from the window's own bytes, and equal
windows have it at the same offset. The windows of one trigger make its phrase. Texts become parses, sequences of
phrases; distinct phrases make the dictionary. Occurrences of one phrase are told apart only by their places: all but
the first are covered by earlier copies whole, which settles nearly all of highly repetitive text.

What is left is the first occurrence of each phrase whose trigger other phrases have too. The suffix order of what stands
before the triggers (dictionary side) and the order of what follows them (parse side), each with its LCP array, combine
into the corpus order of the windows: those at offset d are equal where d bytes before and length - d bytes from the
trigger on are, that is, between the same drops of both LCP arrays. Of each such interval the first window stays.

Nothing is compared pair by pair, and no place is lost: copies within a task's batch are settled there, so a hot phrase
reaches its bucket once for each batch. Buckets are packed arrays by trigger hash; texts meet their spans chunk by chunk.
A trigger that WIDE different phrases have (a passage that stands before many texts) is not compared in one place: each of
their windows goes, as a phrase of one window, to the bucket of its own hash, where copies are settled as all are.

Defined results: a null text is an empty one; texts of under `length` bytes stay whole; the order of documents is
(doc_id, xxhash64(text)), null ids first; repeated rows are one document, and none of them removes from the others;
an empty table gives an empty table; other columns are not looked at. Kept bytes need not be UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.decontamination import merged
from skein.llm.spool import arrow_batches, drop, spool, text_bytes
from skein.llm.text import Rolling, blocks, strings

LENGTH, TRIGGER = 100, 32
#: Documents of a chunk at most, and bytes of text that it should have.
CHUNK_DOCS, CHUNK_BYTES = 512, 2 << 20
#: Phrases of one trigger that are compared with one another at most.
WIDE = 1 << 13
BUCKET_BYTES = 4 << 20
PHRASE = np.dtype([("h", "<u4"), ("c", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("before", "u1"), ("windows", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4")])
ASK = np.dtype([("doc", "<i8"), ("h", "<u4"), ("at", "<u4"), ("before", "u1"), ("windows", "u1"), ("wide", "u1")])


def phrases(buf: np.ndarray, off: np.ndarray, doc: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER) -> np.ndarray:
    """The phrases of a block of texts, in order of place."""
    m, wide = len(buf) - length + 1, length - trigger + 1
    if m <= 0:
        return np.zeros(0, PHRASE)
    rolling = Rolling(buf)
    at = np.arange(len(buf) - trigger + 1)
    bits = np.uint64(int(len(buf)).bit_length())
    best = (rolling.of(at, at + trigger) >> bits << bits) | at.astype(np.uint64)
    size = 1
    while 2 * size <= wide:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < wide:
        best = np.minimum(best[: len(best) - (wide - size)], best[wide - size :])
    row = np.repeat(np.arange(len(off) - 1), np.maximum(np.diff(off) - length + 1, 0))
    if not len(row):
        return np.zeros(0, PHRASE)
    first = np.maximum(np.diff(off) - length + 1, 0)
    start = np.arange(len(row)) - np.repeat(np.cumsum(first) - first, first) + off[row]
    chosen = (best[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])])
    last = np.r_[new[1:], len(row)] - 1
    out = np.zeros(len(new), PHRASE)
    t, s, e = chosen[new], start[new], start[last] + length
    out["h"] = (rolling.of(t, t + trigger) >> np.uint64(32)).astype(np.uint32)
    out["c"] = rolling.of(s, e) + (t - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out["doc"], out["at"] = doc[row[new]], t - off[row[new]]
    out["before"], out["windows"] = t - s, last - new + 1
    return out


def _place(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return p["doc"], p["at"]


def copies(p: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases sorted by (h, c, place), split into the first places of each phrase and the spans of all other places."""
    p = p[np.lexsort((p["at"], p["doc"], p["c"], p["h"]))]
    if not len(p):
        return p, np.zeros(0, SPAN)
    new = np.r_[True, (p["h"][1:] != p["h"][:-1]) | (p["c"][1:] != p["c"][:-1])]
    head = p[np.flatnonzero(new)[np.cumsum(new) - 1]]
    first = (p["doc"] == head["doc"]) & (p["at"] == head["at"])
    return p[first], spans_of(p[~first], length)


def spans_of(p: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(p), SPAN)
    out["doc"] = p["doc"]
    out["start"] = p["at"] - p["before"]
    out["end"] = out["start"] + p["windows"] - 1 + length
    return out


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sort order of byte rows and the common prefix of each with the one before it."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    columns = padded.view(">u8").astype(np.uint64)
    order = np.lexsort(columns.T[::-1])
    s = rows[order]
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = s[1:] != s[:-1]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return order, lcp


def combined(left: np.ndarray, right: np.ndarray, before: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which windows have an equal one in an earlier row. left: the bytes before each trigger, backward; right: those
    from it on; rows in order of place, of which equal places are adjacent. Result: rows x offsets."""
    n, wide = len(left), left.shape[1] + 1
    out = np.zeros((n, wide), bool)
    lo, l_lcp = _order(left)
    ro, r_lcp = _order(right)
    l_class, r_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(wide):
        has = np.flatnonzero((d <= before) & (d > before.astype(np.int64) - windows))
        if len(has) < 2:
            continue
        l_class[lo] = np.cumsum(l_lcp < d)
        r_class[ro] = np.cumsum(r_lcp < length - d)
        _, first, which = np.unique(l_class[has] * (n + 1) + r_class[has], return_index=True, return_inverse=True)
        out[has, d] = first[which] != np.arange(len(has))
    return out


def _window_spans(asked: np.ndarray, gone: np.ndarray, length: int) -> np.ndarray:
    """Spans of the marked windows; those next to one another are joined."""
    edge = np.diff(np.pad(gone.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, d0 = np.nonzero(edge > 0)
    _, d1 = np.nonzero(edge < 0)
    out = np.zeros(len(row), SPAN)
    out["doc"] = asked["doc"][row]
    out["start"] = asked["at"][row].astype(np.int64) - d1 + 1
    out["end"] = asked["at"][row].astype(np.int64) - d0 + length
    return out


def _dealt(kind: int, key: np.ndarray, values: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(kind, key, packed values) for each key."""
    order = np.argsort(key, kind="stable")
    key, values = key[order], values[order]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else []
    return [(kind, int(key[lo]), values[lo:hi].tobytes()) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]


def _rows(rows: list[tuple[int, int, bytes]], key: str) -> dict[str, pa.Array]:
    return {"kind": pa.array([r[0] for r in rows], pa.int32()), key: pa.array([r[1] for r in rows], pa.int64()), "blob": pa.array([r[2] for r in rows], pa.binary())}


def _values(rows: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    got = [np.frombuffer(b.as_py(), dtype) for k, b in zip(rows.column("kind").to_pylist(), rows.column("blob"), strict=True) if k == kind]
    return np.concatenate(got) if got else np.zeros(0, dtype)


_PHRASES, _SPANS, _ASKS = 0, 1, 2


def _parsed(docs: DataFrame, buckets: int, width: int, length: int) -> DataFrame:
    """(kind, key, blob): phrases by bucket, and by chunk the spans that a batch settles by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def settled() -> pa.RecordBatch:
            first, gone = copies(np.concatenate(held), length)
            rows = _dealt(_PHRASES, first["h"] % buckets, first)
            rows += [(k, chunk % buckets, np.int64(chunk).tobytes() + blob) for k, chunk, blob in _dealt(_SPANS, gone["doc"] // width, gone)]
            return pa.RecordBatch.from_pydict(_rows(rows, "bucket"))

        for b in batches:
            key = b.column("key").to_numpy()
            for lo, hi, buf, off in blocks(b.column("text")):
                held.append(phrases(buf, off, key[lo:hi], length))
                size += len(held[-1])
            if size >= 1 << 19:
                yield settled()
                held, size = [], 0
        if held:
            yield settled()

    return docs.select("key", "text").mapInArrow(run, "kind int, bucket long, blob binary")


def _bucketed(parsed: DataFrame, width: int, wide: int, length: int) -> DataFrame:
    """(kind, chunk, blob): spans of copies, and what has to be asked of the texts."""

    def run(rows: pa.Table) -> pa.Table:
        p = _values(rows, _PHRASES, PHRASE)
        out = [(_SPANS, int.from_bytes(b[:8], "little", signed=True), b[8:]) for k, b in zip(rows.column("kind").to_pylist(), rows.column("blob").to_pylist(), strict=True) if k == _SPANS]
        h = np.sort(p["h"])
        shared = np.unique(h[1:][h[1:] == h[:-1]])
        at = np.minimum(np.searchsorted(shared, p["h"]), max(0, len(shared) - 1))
        first, gone = copies(p[shared[at] == p["h"]] if len(shared) else p[:0], length)
        out += _dealt(_SPANS, gone["doc"] // width, gone)
        if len(first):
            new = np.r_[True, (first["h"][1:] != first["h"][:-1]) | (first["c"][1:] != first["c"][:-1])]
            _, which, many = np.unique(first["h"][new], return_inverse=True, return_counts=True)
            mine = many[which] > 1
            asked = np.zeros(int(mine.sum()), ASK)
            for name in PHRASE.names:
                if name != "c":
                    asked[name] = first[new][mine][name]
            asked["wide"] = many[which][mine] > wide
            out += _dealt(_ASKS, asked["doc"] // width, asked)
        return pa.table(_rows(out, "chunk"))

    return parsed.groupBy("bucket").applyInArrow(run, "kind int, chunk long, blob binary")


def _singles(text: Rolling, asked: np.ndarray, length: int) -> np.ndarray:
    """Each window of the phrases of a text as a phrase of its own, whose trigger is the window."""
    many = asked["windows"].astype(np.int64)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = np.repeat(asked["at"].astype(np.int64) - asked["before"], many) + nth
    out = np.zeros(len(start), PHRASE)
    out["c"] = text.of(start, start + length)
    out["h"] = (out["c"] >> np.uint64(32)).astype(np.uint32)
    out["doc"], out["at"], out["windows"] = np.repeat(asked["doc"], many), start, 1
    return out


def _answered(docs: DataFrame, asks: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket, blob): what was asked, with the bytes of the phrases; of wide triggers, the windows as phrases."""
    reach = length - TRIGGER
    kind = np.dtype([*ASK.descr, ("left", "u1", (reach,)), ("right", "u1", (length,))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = _values(right, _ASKS, ASK)
        rows = []
        if len(asked) and len(left):
            asked = asked[np.argsort(asked["h"] % buckets, kind="stable")]
            key = left.column("key").to_numpy()
            buf, off = strings(left.column("text"))
            order = np.argsort(key, kind="stable")
            if asked["wide"].any():
                wide = asked[asked["wide"] > 0]
                own = order[np.searchsorted(key[order], wide["doc"])]
                for doc in np.unique(own):
                    mine = wide[own == doc]
                    single = _singles(Rolling(buf[off[doc] : off[doc + 1]]), mine, length)
                    rows += _dealt(_PHRASES, single["h"] % buckets, single)
                asked = asked[asked["wide"] == 0]
            row = order[np.searchsorted(key[order], asked["doc"])]
            buf = np.r_[buf, np.zeros(length, np.uint8)]
            for lo in range(0, len(asked), 1 << 15):
                part, base = asked[lo : lo + (1 << 15)], off[row[lo : lo + (1 << 15)]]
                t = base + part["at"].astype(np.int64)
                got = np.zeros(len(part), kind)
                for name in ASK.names:
                    got[name] = part[name]
                d = np.arange(1, reach + 1)
                got["left"] = np.where(d <= part["before"][:, None], buf[np.maximum(t[:, None] - d, 0)], 0)
                d = np.arange(length)
                end = part["windows"].astype(np.int64) - 1 - part["before"] + length
                got["right"] = np.where(d < end[:, None], buf[np.minimum(t[:, None] + d, len(buf) - 1)], 0)
                rows += _dealt(_ASKS, part["h"] % buckets, got)
        return pa.table(_rows(rows, "bucket"))

    return docs.groupBy("chunk").cogroup(asks.groupBy("chunk")).applyInArrow(run, "kind int, bucket long, blob binary")


def _compared(answers: DataFrame, width: int, length: int) -> DataFrame:
    """(kind, chunk, blob): spans of the windows that are met earlier in another phrase."""
    reach = length - TRIGGER
    kind = np.dtype([*ASK.descr, ("left", "u1", (reach,)), ("right", "u1", (length,))])

    def run(rows: pa.Table) -> pa.Table:
        out = []
        single = _values(rows, _PHRASES, PHRASE)
        if len(single):
            _, gone = copies(single, length)
            out += _dealt(_SPANS, gone["doc"] // width, gone)
        got = _values(rows, _ASKS, kind)
        got = got[np.lexsort((got["at"], got["doc"], got["h"]))]
        cut = np.flatnonzero(np.r_[True, got["h"][1:] != got["h"][:-1]]) if len(got) else np.zeros(0, int)
        lo = 0
        while lo < len(got):  # triggers are taken together up to a size that bounds memory
            k = max(np.searchsorted(cut, lo + (1 << 15)), np.searchsorted(cut, lo, "right"))
            hi = cut[k] if k < len(cut) else len(got)
            part = got[lo:hi]
            part = part[np.lexsort((part["at"], part["doc"]))]
            gone = _window_spans(part, combined(part["left"], part["right"], part["before"], part["windows"], length), length)
            out += _dealt(_SPANS, gone["doc"] // width, gone)
            lo = hi
        return pa.table(_rows(out, "chunk"))

    return answers.groupBy("bucket").applyInArrow(run, "kind int, chunk long, blob binary")


def _keyed(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, key and chunk, where keys are whole numbers in the order of documents; and the keys of a chunk."""
    docs = docs.select("doc_id", "text")
    whole = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int")
    size = max(1, text_bytes(docs))
    n = docs.count()
    width = max(1, min(CHUNK_DOCS, CHUNK_BYTES * n // size))
    plain = whole and docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty()
    if plain and n:  # ids far apart would leave chunks of one document each
        ends = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        plain = int(ends[1]) - int(ends[0]) < 16 * n + 4096
    if plain:
        keyed = docs.withColumn("key", F.col("doc_id").cast("long"))
    else:
        named = docs.withColumn("_h", F.xxhash64("text"))
        names = named.select(F.col("doc_id").alias("_d"), F.col("_h").alias("_g")).distinct().repartitionByRange("_d", "_g").sortWithinPartitions("_d", "_g")
        names = spool(names.withColumn("key", F.monotonically_increasing_id()), "names")
        keyed = named.join(names, named.doc_id.eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g"))).select("doc_id", "text", "key")
    return keyed.withColumn("chunk", F.expr(f"CASE WHEN key >= 0 THEN key div {width}L ELSE -1L - (-(key + 1L)) div {width}L END")), width


def removed(docs: DataFrame, length: int = LENGTH, wide: int = WIDE) -> tuple[DataFrame, DataFrame]:
    """Keyed documents, and (kind, chunk, blob) of the byte spans to remove from them, by chunk; a spooled table."""
    spark = docs.sparkSession
    arrow_batches(spark)
    buckets = max(16, -(-text_bytes(docs.select("doc_id", "text")) // BUCKET_BYTES))
    docs, width = _keyed(docs)
    first = spool(_bucketed(_parsed(docs, buckets, width, length), width, wide, length), "first")
    more = _compared(_answered(docs, first.filter(f"kind = {_ASKS}"), buckets, length), width, length)
    spans = spool(first.filter(f"kind = {_SPANS}").union(more), "spans")
    drop(first)
    return docs, spans


def _applied(docs: DataFrame, spans: DataFrame, schema: str, table) -> DataFrame:
    """table(documents of a chunk, kept spans of each) for every chunk."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        gone = _values(right, _SPANS, SPAN)
        gone = gone[np.argsort(gone["doc"], kind="stable")]
        key = left.column("key").to_numpy()
        buf, off = strings(left.column("text"))
        data, found = buf.tobytes(), []
        lo, hi = np.searchsorted(gone["doc"], key), np.searchsorted(gone["doc"], key, "right")
        for i in range(len(key)):
            mine = gone[lo[i] : hi[i]]
            taken = merged(np.c_[mine["start"], mine["end"]].astype(np.int64))
            if len(taken) > 1:  # spans that touch are one run
                new = np.flatnonzero(np.r_[True, taken[1:, 0] > taken[:-1, 1]])
                taken = np.c_[taken[new, 0], taken[np.r_[new[1:], len(taken)] - 1, 1]]
            cut = np.r_[0, taken.ravel(), off[i + 1] - off[i]] + off[i]
            found.append((int(off[i + 1] - off[i]), taken, b"".join(data[a:b] for a, b in cut.reshape(-1, 2))))
        return table(left, found)

    return docs.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(run, schema)


def deduplicate(docs: DataFrame, length: int = LENGTH, wide: int = WIDE) -> DataFrame:
    """(doc_id, kept, spans): the bytes that stay and the removed runs of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def table(left: pa.Table, found: list) -> pa.Table:
        return pa.table({"doc_id": left.column("doc_id"), "kept": pa.array([f[2] for f in found], pa.binary()), "spans": pa.array([[{"start": int(a), "end": int(b)} for a, b in f[1]] for f in found], run)})

    return _applied(*removed(docs, length, wide), f"doc_id {kind}, kept binary, spans array<struct<start:long,end:long>>", table)


def digests(docs: DataFrame, length: int = LENGTH, wide: int = WIDE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def table(left: pa.Table, found: list) -> pa.Table:
        return pa.table({"doc_id": left.column("doc_id"), "n_bytes": pa.array([f[0] for f in found], pa.int64()), "n_removed": pa.array([f[0] - len(f[2]) for f in found], pa.int64()), "n_spans": pa.array([len(f[1]) for f in found], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(f[2]).hexdigest() for f in found], pa.string())})

    return _applied(*removed(docs, length, wide), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", table)


#: The same result by comparing all strings of LENGTH bytes.
SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, k, row_number() OVER (PARTITION BY b[k:k + {LENGTH - 1}] ORDER BY doc_id, k) AS nth FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - {LENGTH - 2})) AS k FROM d WHERE octet_length(b) >= {LENGTH})),
e AS (SELECT doc_id, k, coalesce(k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + {LENGTH}, true) AS new FROM w WHERE nth > 1),
r AS (SELECT doc_id, min(k) AS a, max(k) + {LENGTH - 1} AS z FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM e) GROUP BY doc_id, run),
p AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS f, a - 1 AS t FROM r UNION ALL SELECT doc_id, max(z) + 1, 9223372036854775807 FROM r GROUP BY doc_id),
k AS (SELECT p.doc_id, string_agg(hex(b[f:least(t, octet_length(b))]), '' ORDER BY f) AS kept FROM p JOIN d USING (doc_id) GROUP BY p.doc_id),
n AS (SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN kept IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
