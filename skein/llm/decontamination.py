"""Benchmark decontamination: an FM-index per training shard answers the test windows.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A window is `width` consecutive words
of a benchmark item; an item of fewer, but not none, is one window. Each task indexes its texts shard by shard
(a shard is some MB of text). Words that no window has are separators, and runs too short for any window are left
out, so the index holds only what a window could match. All windows are searched backwards at once over wavelet
ranks; sampled suffix positions locate their occurrences, whose spans are merged.

Nothing is shuffled. The windows go to the tasks in blocks of at most about `block_bytes` of benchmark text (an item is never
cut). Each block has a pass of its own, whose result is written before the next block is read and the last one released: the
driver and the workers hold one block's windows at a time, so any benchmark of items of bounded size works.

Defined results: null texts have no words and no hits; rows are judged alone, so repeated rows or ids repeat their
results; an empty benchmark hits nothing; null item ids count as the text "null"; items are a set of ids; columns named
n_words, spans or items are replaced by `mark`, others stay; `decontaminate` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.fm_index import FMIndex
from skein.llm.spool import arrow_batches, drop, spool, unused
from skein.llm.text import ALNUM, LOWER, spans, strings

WIDTH = 10
SHARD_BYTES = 6 << 20
BLOCK_BYTES = 4 << 20
_TABLE = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 0x20 for b in range(256))

_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_OUT = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Windows:
    """The distinct windows of some items, by length, as ids of their words."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.ids: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        self.items = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in tokens(text)]
            n = min(width, len(w))
            for k in range(len(w) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(tuple(w[k : k + n]), set()).add(number[item])
        self.by_length = [(n, np.array(list(d), np.int64), [np.array(sorted(s)) for s in d.values()]) for n, d in sorted(found.items())]
        self.shortest = min(found, default=0)


def _runs(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, (ids > 0).astype(np.int8), 0])
    lo, hi = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    long = hi - lo >= shortest
    return lo[long], hi[long]


def merged(pairs: np.ndarray) -> np.ndarray:
    """Union of half-open spans (rows of an n x 2 array)."""
    if len(pairs) < 2:
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.flatnonzero(np.r_[True, pairs[1:, 0] > reach[:-1]])
    return np.c_[pairs[new, 0], reach[np.r_[new[1:], len(pairs)] - 1]]


def find(texts: list[bytes], windows: Windows) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, set[str]]]]:
    """Word counts, and for each text with occurrences its merged word spans and item ids."""
    get, shortest = windows.ids.get, windows.shortest
    counts, symbols, owner, first, begins, size = np.zeros(len(texts), np.int64), [], [], [], [], 0
    for d, text in enumerate(texts):
        words = tokens(text)
        counts[d] = len(words)
        if not shortest or len(words) < shortest:
            continue
        ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        for lo, hi in zip(*_runs(ids, shortest), strict=True):
            symbols += [ids[lo:hi], np.zeros(1, np.int64)]
            owner.append(d)
            first.append(lo)
            begins.append(size)
            size += hi - lo + 1
    hits: dict[int, tuple[np.ndarray, set[str]]] = {}
    if not size:
        return counts, hits
    index = FMIndex(np.concatenate(symbols), len(windows.ids))
    owner, first, begins = np.array(owner), np.array(first), np.array(begins)
    found = []
    for n, patterns, items in windows.by_length:
        lo, hi = index.search(patterns)
        many = hi - lo
        which = np.repeat(np.arange(len(patterns)), many)
        rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + lo[which]
        at = index.locate(rows)
        run = np.searchsorted(begins, at, "right") - 1
        start = first[run] + at - begins[run]
        found.append((owner[run], start, start + n, [items[w] for w in which]))
    docs = np.concatenate([f[0] for f in found])
    pairs = np.c_[np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])]
    items = [i for f in found for i in f[3]]
    order = np.argsort(docs, kind="stable")
    cuts = np.flatnonzero(np.r_[True, docs[order][1:] != docs[order][:-1]]) if len(docs) else []
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(order)] if len(docs) else [], strict=True):
        own = order[lo:hi]
        hits[int(docs[own[0]])] = merged(pairs[own]), {windows.items[i] for i in np.unique(np.concatenate([items[k] for k in own]))}
    return counts, hits


def cut(text: bytes, taken: np.ndarray) -> bytes:
    """The text without the words of the spans and what is between them."""
    buf = np.frombuffer(text, np.uint8)
    starts, ends, _ = spans(ALNUM[LOWER[buf]], np.array([0, len(buf)]))
    out, at = [], 0
    for lo, hi in taken:
        out.append(text[at : starts[lo]])
        at = ends[hi - 1]
    return b"".join([*out, text[at:]])


def _blocks(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks, read as they are asked for; at least one block."""
    items, size, any_ = [], 0, False
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").toLocalIterator():
        items.append((row[0], (row[1] or "").encode()))
        size += len(items[-1][1])
        if size >= block_bytes:
            yield items
            items, size, any_ = [], 0, True
    if items or not any_:
        yield items


def _step(docs: DataFrame, shared, last: bool, remove: bool, keep_text: bool) -> DataFrame:
    again = {"spans", "items"} <= set(docs.columns)
    keep = [n for n in docs.columns if n not in ("n_words", "spans", "items") and (n != "text" or keep_text or not last)]

    def done(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = []
        for b in batches:
            buf, off = strings(b.column("text"))
            raw = buf.tobytes()
            texts += [raw[off[k] : off[k + 1]] for k in range(len(off) - 1)]
        counts, hits = find(texts, shared.value)
        at = 0
        for b in batches:
            rows = range(at, at + b.num_rows)
            at += b.num_rows
            old = zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True) if again else repeat(([], []))
            both = []
            for d, (was, names) in zip(rows, old, strict=False):
                got, more = hits.get(d, (np.zeros((0, 2), np.int64), set()))
                got = merged(np.r_[got, [(x["start"], x["end"]) for x in was]]) if was else got
                both.append((got, sorted(more.union(names))))
            arrays = {n: b.column(n) for n in keep}
            if last and remove and keep_text and any(len(x[0]) for x in both):
                arrays["text"] = pa.array([cut(texts[d], x[0]).decode() if len(x[0]) else t for d, x, t in zip(rows, both, b.column("text").to_pylist(), strict=True)], pa.string())
            arrays["n_words"] = pa.array(counts[rows.start : rows.stop], pa.int64())
            arrays["spans"] = pa.array([[{"start": int(s), "end": int(e)} for s, e in x[0]] for x in both], _SPANS)
            arrays["items"] = pa.array([x[1] for x in both], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column("text").nbytes
            if size >= SHARD_BYTES:
                yield from done(held)
                held, size = [], 0
        if held:
            yield from done(held)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    return docs.mapInArrow(run, ", ".join([*fields, _OUT]))


def mark(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, remove: bool = False, keep_text: bool = True) -> DataFrame:
    """docs with n_words, merged word spans of window occurrences, and the ids of the items they come from;
    with `remove`, the text is cut there."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs, written = docs.drop("n_words", "spans", "items"), None
    blocks = _blocks(benchmark, width, block_bytes)
    items = next(blocks)
    while True:
        shared = spark.sparkContext.broadcast(Windows(items, width))
        items = next(blocks, None)
        docs = _step(docs, shared, items is None, remove, keep_text)
        if items is None:
            return docs
        docs = spool(docs, "marked")
        shared.destroy()
        if written is not None:
            drop(written)
        written = docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The same columns, of any name, and every occurrence of a benchmark window cut out of the text."""
    clash = [c for c in docs.columns if c.lower() in ("n_words", "spans", "items")]
    other = dict(zip(clash, unused(docs, *clash), strict=True))
    out = mark(docs.withColumnsRenamed(other), benchmark, remove=True, **options)
    return out.select(*(F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns))


def digests(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document."""
    found = mark(docs.select("doc_id", "text"), benchmark, keep_text=False, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: The same result by joining all runs of words with the windows.
SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS l FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS l FROM benchmark),
win AS (SELECT DISTINCT item, n, list_slice(l, k, k + n - 1) AS g FROM (SELECT item, l, least({WIDTH}, len(l)) AS n, unnest(range(1, len(l) - least({WIDTH}, len(l)) + 2)) AS k FROM i WHERE len(l) > 0)),
pos AS (SELECT doc_id, k, n, list_slice(l, k, k + n - 1) AS g FROM (SELECT doc_id, l, n, unnest(range(1, len(l) - n + 2)) AS k FROM w, (SELECT DISTINCT n FROM win) WHERE len(l) >= n)),
hit AS (SELECT doc_id, k, n, item FROM pos JOIN win USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
