"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end for each text. The model is a bigram model
over the add-one unigram model (the base). A count c is quantised to 1 + floor(log_B(c)) and the n-gram is put into the
filter once for each level up to that; a probe goes up the levels until one is missing, and the last level found gives the
least count of its range back: never more than was counted, but for false positives, so that the counts found after a
context do not exceed it and probabilities over the vocabulary sum to at most 1. All bigrams of the training texts are in the filter, and
P(w | v) = L * count(v w) / count(v) + (1 - L) * base(w), with L = count(v) / (count(v) + K) and the exact count(v) of
the base; after words not met in training it is base(w). The filter lies in buckets by bigram hash; each has bits for its
own number of insertions, so that a bigram never met is found with probability RATE at most, at any size of the input.

Exact base counts of all words, of which there is no bound, are never broadcast: documents are dealt into chunks of
neighbouring ids, each chunk's distinct words are counted where they are read, packed by hash bucket, summed bucket by
bucket, and the sums go back to the chunks they came from. So a hot word is one entry per chunk. Bigrams travel alike: a
chunk's distinct ones are sent to their buckets as probes, with their counts in training texts, of which the bucket makes
its part of the filter; the levels found go back, a byte each. Keys travel once, rising, as differences; what goes back is
in their order and without them, since the chunk has them itself. Nothing is broadcast.

Defined results: a null text is an empty one and has one token, its end; rows are scored one by one, repeated rows
alike; null ids are training rows (crc32 of no text is taken as 0); an empty table gives an empty table; other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.spool import arrow_batches, drop, spool, text_bytes
from skein.llm.text import LOWER, NON_SPACE, Rolling, blocks, mix, spans

FOLDS, HELD_OUT = 7, 2
HASHES, BASE, K = 3, 1.4, 2000.0
#: False positives of a probe at most.
RATE = 0.01
CHUNK_DOCS = 1024
#: Table bytes to one bucket of word counts.
BUCKET_BYTES = 4 << 20
#: Blocks of a bucket's filter; each n-gram lies in one.
BLOCKS = 256
END = np.uint64(0x5DEECE66D1234567)
#: Tokens that a task holds before it packs them.
HELD = 1 << 21


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes and rows, the end last in each row."""
    low = LOWER[buf]
    starts, ends, row = spans(NON_SPACE[low], off)
    h = Rolling(low).of(starts, ends)
    n = len(off) - 1
    at = np.searchsorted(row, np.arange(n), "right")
    return np.insert(h, at, END), np.insert(row, at, np.arange(n))


def _prepared(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % FOLDS == HELD_OUT
    number = F.floor(F.col("doc_id") / CHUNK_DOCS) if docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int") else F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    return docs.select("doc_id", "text", held.alias("held_out"), F.coalesce(number, -1 - F.pmod(F.xxhash64("text"), F.lit(4096)), F.lit(-1)).cast("long").alias("chunk"))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[new], np.add.reduceat(counts, new)


def _planes(x: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """Each slice of whole numbers as the lowest byte of each, then the next of each, up to the highest that any has: where most
    are small, the later ones are runs of zeros, which files and shuffles compress. No slice is empty."""
    wide = np.ascontiguousarray(x, np.uint64).view(np.uint8).reshape(-1, 8)
    most = np.maximum.reduceat(x, cut[:-1]).tolist() if len(x) else []
    return [wide[lo:hi, : max(1, -(-m.bit_length() // 8))].T.tobytes() for lo, hi, m in zip(cut[:-1].tolist(), cut[1:].tolist(), most, strict=True)]


def _numbers(blobs: list[bytes], cut: np.ndarray) -> np.ndarray:
    wide = np.zeros((int(cut[-1]), 8), np.uint8)
    for blob, lo, hi in zip(blobs, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        wide[lo:hi, : len(blob) // (hi - lo)] = np.frombuffer(blob, np.uint8).reshape(-1, hi - lo).T
    return wide.view(np.uint64).ravel()


def _gaps(keys: np.ndarray, cut: np.ndarray, buckets: int) -> np.ndarray:
    """Keys that rise in each slice, as differences of their quotients by the number of buckets; the remainder is the bucket."""
    of = keys // np.uint64(buckets)
    out = np.diff(of, prepend=np.uint64(0))
    out[cut[:-1]] = of[cut[:-1]]
    return out


def _keys(gaps: np.ndarray, cut: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    up = np.cumsum(gaps, dtype=np.uint64)
    up -= np.repeat(np.r_[np.uint64(0), up][cut[:-1]], np.diff(cut))
    return up * np.uint64(buckets) + np.uint64(bucket)


def _bigrams(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The code, of 48 bits, of each token with the one before it; a text's first token follows an end."""
    before = np.r_[END, h[:-1]][: len(h)]
    before[np.r_[True, row[1:] != row[:-1]][: len(h)]] = END
    return mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) + h) >> np.uint64(16)


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of distinct, rising keys by bucket, the buckets that there are, and where each begins, with the end."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(keys) else np.zeros(1, int)
    return order, bucket[cut[:-1]], cut


def _counted(docs: DataFrame, buckets: int, *, bigrams: bool = False) -> DataFrame:
    """(bucket, chunk, n, tokens, keys, counts): the distinct words or bigrams of a chunk with their counts in training texts."""

    def packed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, chunk, train = (np.concatenate([x[k] for x in held]) for k in range(3))
        order = np.argsort(chunk, kind="stable")
        key, chunk, train = key[order], chunk[order], train[order]
        out = [[], [], [], [], [], []]
        ends = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True])
        for first, last in zip(ends[:-1], ends[1:], strict=True):
            keys, counts = _summed(key[first:last], train[first:last].astype(np.int64))
            order, bucket, cut = _dealt(keys, buckets)
            keys, counts = keys[order], counts[order]
            mine = (bucket.tolist(), [int(chunk[first])] * len(bucket), np.diff(cut).tolist(), np.add.reduceat(counts, cut[:-1]).tolist(), _planes(_gaps(keys, cut, buckets), cut), _planes(counts, cut))
            for column, x in zip(out, mine, strict=True):
                column.extend(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:4]), *(pa.array(x, pa.binary()) for x in out[4:])], ["bucket", "chunk", "n", "tokens", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            chunk, out = b.column("chunk").to_numpy(zero_copy_only=False), b.column("held_out").to_numpy(zero_copy_only=False)
            for lo, _, buf, off in blocks(b.column("text")):
                h, row = tokens(buf, off)
                held.append((_bigrams(h, row) if bigrams else h, chunk[row + lo], ~out[row + lo]))
                size += len(h)
            if size >= HELD:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)

    return docs.mapInArrow(run, "bucket int, chunk long, n long, tokens long, keys binary, counts binary")


class Bucket:
    """The rows of a bucket: its distinct keys, rising, with the sums of their counts."""

    def __init__(self, rows: pa.Table, buckets: int):
        self.number, self.chunks = rows.column("bucket")[0].as_py(), rows.column("chunk").to_pylist()
        cut = np.r_[0, np.cumsum(rows.column("n").to_numpy())]
        keys = _keys(_numbers(rows.column("keys").to_pylist(), cut), cut, self.number, buckets)
        self.parts = np.split(keys, cut[1:-1])
        self.keys, self.counts = _summed(keys, _numbers(rows.column("counts").to_pylist(), cut).astype(np.int64))

    def back(self, values: np.ndarray) -> dict[str, pa.Array]:
        """(chunk, bucket, blob): the values of each chunk's keys, in their order, without the keys, which the chunk has itself."""
        of = {}
        for chunk, keys in zip(self.chunks, self.parts, strict=True):
            of.setdefault(chunk, []).append(keys)
        mine = [np.unique(np.concatenate(x)) if len(x) > 1 else x[0] for x in of.values()]
        blobs = _planes(values[np.searchsorted(self.keys, np.concatenate(mine))], np.r_[0, np.cumsum([len(x) for x in mine])])
        return {"chunk": pa.array(list(of), pa.int64()), "bucket": pa.array([self.number] * len(of), pa.int32()), "blob": pa.array(blobs, pa.binary())}


def _returned(rows: pa.Table, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The values that came back for a chunk's distinct, rising keys."""
    found = dict(zip(rows.column("bucket").to_pylist(), rows.column("blob").to_pylist(), strict=True))
    order, bucket, cut = _dealt(keys, buckets)
    out = np.zeros(len(keys), np.int64)
    out[order] = _numbers([found[b] for b in bucket.tolist()], cut)
    return out


def _totals(counted: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, blob, words): the counts in all training texts of a chunk's words in a bucket; one row of each bucket has
    the number of its words that were met in training."""

    def run(rows: pa.Table) -> pa.Table:
        b = Bucket(rows, buckets)
        out = b.back(b.counts)
        return pa.table(out | {"words": pa.array([int((b.counts > 0).sum())] + [0] * (len(out["chunk"]) - 1), pa.int64())})

    return counted.drop("tokens").groupBy("bucket").applyInArrow(run, "chunk long, bucket int, blob binary, words long")


def _places(codes: np.ndarray, level: np.ndarray | int, bits: int) -> list[np.ndarray]:
    """Bit positions, within the block, of a code at a level."""
    seed = mix(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level) if np.isscalar(level) else codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + level.astype(np.uint64))
    step = mix(seed) | np.uint64(1)
    return [(seed + np.uint64(k) * step) % np.uint64(bits) for k in range(HASHES)]


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def _filter(codes: np.ndarray, counts: np.ndarray, bits: int | None) -> Filter:
    """The filter of distinct codes: of `bits` bits, else of as many as keep the false positives under RATE."""
    up = level(counts)
    block = -(-bits // BLOCKS) if bits else int(up.sum()) * HASHES // BLOCKS * 4 + 64
    base = mix(codes) % np.uint64(BLOCKS)
    while True:
        block = -(-block // 8) * 8
        out = np.zeros(BLOCKS * block, bool)
        for q in range(1, int(up.max(initial=0)) + 1):
            mine = up >= q
            for at in _places(codes[mine], q, block):
                out[base[mine] * np.uint64(block) + at] = True
        rate = float((out.reshape(BLOCKS, block).mean(1) ** HASHES).mean())
        if rate <= RATE:
            raw = np.packbits(out, bitorder="little").tobytes()
            return Filter({b: raw[b * block // 8 : (b + 1) * block // 8] for b in range(BLOCKS)}, block)
        if bits:
            raise ValueError(f"a filter of {bits} bits for a bucket of {len(codes)} bigrams has {rate:.3f} false positives, over {RATE}")
        block = block * 5 // 4


def _levels(counted: DataFrame, buckets: int, bits: int | None) -> DataFrame:
    """(chunk, bucket, blob): the filter's levels of a chunk's bigrams in a bucket."""

    def run(rows: pa.Table) -> pa.Table:
        b = Bucket(rows, buckets)
        met = b.counts > 0
        return pa.table(b.back(_filter(b.keys[met], b.counts[met], bits).levels(b.keys)))

    return counted.drop("tokens").groupBy("bucket").applyInArrow(run, "chunk long, bucket int, blob binary")


def least_count(up: np.ndarray) -> np.ndarray:
    """The least of the counts of a level; none at level 0."""
    return np.where(up > 0, np.ceil(BASE ** (up - 1.0) - 1e-6), 0.0)


class Filter:
    """The log-frequency Bloom filter: counts by repeated membership probes."""

    def __init__(self, parts: dict[int, bytes], bits: int):
        self.bits = bits
        empty = bytes(bits // 8)
        self.bytes = np.frombuffer(b"".join(parts.get(b, empty) for b in range(BLOCKS)), np.uint8)

    def has(self, codes: np.ndarray, q: int) -> np.ndarray:
        base = (mix(codes.astype(np.uint64)) % np.uint64(BLOCKS)) * np.uint64(self.bits)
        found = np.ones(len(codes), bool)
        for at in _places(codes, q, self.bits):
            at = base + at
            found &= (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found

    def levels(self, codes: np.ndarray) -> np.ndarray:
        up, live, q = np.zeros(len(codes), np.int64), np.arange(len(codes)), 1
        while len(live) and q < 200:
            live = live[self.has(codes[live], q)]
            up[live] = q
            q += 1
        return up

    def counts(self, codes: np.ndarray) -> np.ndarray:
        return least_count(self.levels(codes))


def scores(docs: DataFrame, *, share: float = 0.0, bits: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document. A caller may leave bigrams
    of words under a share of the training tokens to the base, and may set the filter's bits, which fails if they are too few."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = _prepared(docs)
    buckets = max(16, -(-text_bytes(docs) // BUCKET_BYTES))
    counted = spool(_counted(docs, buckets), "counted")
    total = counted.agg(F.sum("tokens")).first()[0] or 0
    totals = spool(_totals(counted, buckets), "totals")
    drop(counted)
    words = totals.agg(F.sum("words")).first()[0] or 0
    levels = spool(_levels(_counted(docs, buckets, bigrams=True), buckets, bits and -(-bits // buckets)), "levels")
    bottom = np.log10(total + words + 1) if total + words else 0.0
    least = share * total
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, held = left.column("doc_id").combine_chunks(), left.column("held_out").to_numpy()
        texts = [(len(off) - 1, *tokens(buf, off)) for _, _, buf, off in blocks(left.column("text").combine_chunks())]
        codes = [_bigrams(h, row) for _, h, row in texts]
        none, of_pairs = np.zeros(0, np.uint64), right.column("bigrams")
        known = np.unique(np.concatenate([none, *(h for _, h, _ in texts)]))
        counts = _returned(right.filter(pc.invert(of_pairs)), known, buckets)
        distinct, which = np.unique(np.concatenate([none, *codes]), return_inverse=True)
        pairs = least_count(_returned(right.filter(of_pairs), distinct, buckets))
        out, at = [[], [], [], []], 0
        for (n, h, row), code in zip(texts, codes, strict=True):
            c = counts[np.searchsorted(known, h)]
            base = np.log10(c + 1.0) - bottom
            end = counts[np.searchsorted(known, END)]
            context = np.r_[end, c[:-1]][: len(c)]
            context[np.r_[True, row[1:] != row[:-1]][: len(c)]] = end
            pair = np.minimum(pairs[which[at : at + len(code)]], context)
            at += len(code)
            use = (context > 0) & (context >= least) & (c >= least)
            full = np.where(use, np.log10((pair + K * 10**base) / (context + K)), base)
            for column, x in zip(out, (np.bincount(row, minlength=n), np.bincount(row, c > 0, n).astype(np.int64), np.bincount(row, base, n), np.bincount(row, full, n)), strict=True):
                column.append(x)
        n_tokens, n_known, base, full = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.table({"doc_id": ids, "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array(np.full(len(ids), total), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(full, pa.float64())})

    sums = totals.select("chunk", "bucket", "blob", F.lit(False).alias("bigrams")).union(levels.select("chunk", "bucket", "blob", F.lit(True)))
    return docs.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
