"""Near-duplicate documents by ProbMinHash over weighted word shingles, banding and exact verification.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased; a shingle is five of them in a row (all of
them in a text of fewer), weighted by its count. Each shingle sends the arrivals of a Poisson process whose rate is its
weight to random registers; a register keeps the shingle that came first, and a text's process ends once no later
arrival could be first anywhere. Two registers agree with the texts' probability Jaccard similarity. Texts that share
a band of registers are candidates and are verified exactly; documents linked by a similarity of 0.8 or more,
directly or through others, are one class.

Copies never make pairs: texts with the same weighted shingles are one node. Nodes of a small bucket are compared with
one another, those of a larger one with its leader, the node that is in most large buckets: the original of a group of
variants. Where a leader's nodes are then in several classes, the rest is settled by what differs from the leader, exactly:
let n be the leader's weight, r and u the weight that a node lacks of it and has beyond it, and k = s / (1 - s) for the
similarity s (4). For two nodes of similarity s or more, the weight of differences that they share (both lack a shingle, or
both have it) times 1 + 2k is at least m + m' - n, where m = (1 + k) r + k u, less (1 + k) for each count by which a common
shingle differs and 1 for each repeat of a new one. (The similarity is at most C / (C + D), C the common shingles' larger
counts and D all others; both follow from n, r, u and the shared differences.) Nodes that are not similar to the leader
have m > n, so that they share more than m' / (1 + 2k) with any partner: the partner's rarest differences, up to that weight
from the end, make short lists, and nodes that are not similar meet them with all of theirs. Independent edits meet in
no list, since a shingle that no other node has is left out. The few nodes for which counts leave m below its bounds meet
all the nodes of their leader. Lists work as buckets do: larger ones first send their least different node to all others.
No candidate is given up: with 28 bands of 5 registers a pair at 0.8 is missed with probability 2e-5.

Defined results: a document is its (doc_id, text): repeated rows are copies of one another; null texts and texts
without words are in no class but their own; a class's id is its least doc_id (null ids count as absent: a class of
nulls alone has the id null); an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.components import components
from skein.llm.spool import arrow_batches, drop, spool, unused
from skein.llm.text import ALNUM, LOWER, Rolling, blocks, grams, mix, spans

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 28, 5
#: Buckets of up to so many nodes are compared pair by pair, larger ones with a leader.
SMALL = 8
#: Counters of shingles, a byte each, that go to every worker: a fixed size. Where they are too few, the lists of
#: differences are longer, and as exact.
SLOTS = 1 << 23
#: Bits, 64 in a row, that go to every worker and tell which texts cannot be wanted: a fixed size. Where they are too few,
#: more texts come to a join that is exact.
BITS = 1 << 24


def shingles(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and row numbers of the shingles of a block of texts, repeats included."""
    low = LOWER[buf]
    starts, ends, row = spans(ALNUM[low], off)
    h = Rolling(low).of(starts, ends)
    key, at = grams(h, row, words)
    out, rows = [key], [row[at]]
    count = np.bincount(row, minlength=len(off) - 1)
    first = np.cumsum(count) - count
    for n in range(1, words):
        short = np.flatnonzero(count == n)
        if len(short):
            key, at = grams(h, row, n)
            mine = np.isin(at, first[short])
            out.append(key[mine] ^ np.uint64(n))
            rows.append(row[at[mine]])
    return np.concatenate(out), np.concatenate(rows)


def weighted(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) in that order, with counts."""
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]) if len(key) else np.zeros(0, np.int64)
    return key[new], row[new], np.diff(np.r_[new, len(key)])


def signatures(key: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """rows x m registers of ProbMinHash: the shingle of the earliest arrival in each."""
    first, who = np.full(rows * m, np.inf), np.zeros(rows * m, np.uint64)
    time = np.zeros(len(key))
    seed = key.copy()
    live_key, live_row, rate = key, row, weight.astype(float)
    while len(live_key):
        seed = mix(seed + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(((seed >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate
        slot = live_row * m + (mix(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = time == first[slot]
        who[slot[won]] = live_key[won]
        stop = first.reshape(rows, m).max(1)  # an arrival after this one changes nothing
        on = time < stop[live_row]
        live_key, live_row, rate, time, seed = live_key[on], live_row[on], rate[on], time[on], seed[on]
    return who.reshape(rows, m)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common d of 1 / sum over e of max(wa[e] / wa[d], wb[e] / wb[d])."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    ca, cb = wa[ia].astype(float), wb[ib].astype(float)
    if (ca == 1).all() and (cb == 1).all() and wa.max() == 1 and wb.max() == 1:
        return len(both) / (len(a) + len(b) - len(both))
    only_a, only_b = wa.sum() - ca.sum(), wb.sum() - cb.sum()
    ratio = cb / ca
    order = np.argsort(ratio, kind="stable")
    sa, sb = np.r_[0, np.cumsum(ca[order])], np.r_[0, np.cumsum(cb[order])]
    k = np.searchsorted(ratio[order], ratio, "right")  # up to k, e's share of a is the larger one
    return float((1 / ((sa[k] + only_a) / ca + (sb[-1] - sb[k] + only_b) / cb)).sum())


def _bands(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of each signature."""
    sig = sig.reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2]).copy()
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, k])
    return out


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, h, node and band keys of each document; node is null without words."""
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, keys = [], []
            for _, _, buf, off in blocks(b.column("text")):
                n = len(off) - 1
                key, row, weight = weighted(*shingles(buf, off, words))
                band = _bands(signatures(key, row, weight, n, m), bands, rows)
                both = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
                for k in range(2):
                    np.add.at(both[k], row, mix(mix(key + np.uint64(k * 77 + 1)) + weight.astype(np.uint64)))
                some = np.bincount(row, minlength=n) > 0
                raw = np.c_[both[0], both[1]].tobytes()
                nodes += [raw[16 * i : 16 * i + 16] if some[i] else None for i in range(n)]
                keys += [x if s else [] for x, s in zip(band.view(np.int64).tolist(), some, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "h", "node", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "h", "text").mapInArrow(run, f"doc_id {kind}, h long, node binary, bands array<long>")


def _contents(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles, weights) from rows (node, text); the arrays are packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, weights = [], []
            for _, _, buf, off in blocks(b.column("text")):
                key, row, weight = weighted(*shingles(buf, off, words))
                key = key >> np.uint64(16)
                cut = np.searchsorted(row, np.arange(len(off)))
                for i in range(len(off) - 1):
                    mine = slice(cut[i], cut[i + 1])
                    keys.append(np.ascontiguousarray(key[mine].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
                    w = weight[mine]
                    weights.append(b"" if (w == 1).all() else w.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(keys, pa.binary()), pa.array(weights, pa.binary())], ["node", "shingles", "weights"])

    return texts.mapInArrow(run, "node binary, shingles binary, weights binary")


def _unpacked(keys: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(keys, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view(np.uint64).ravel(), np.frombuffer(weights, np.uint32) if weights else np.ones(len(raw), np.uint32)


def _beside(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """The pairs (a, b) with the contents of both."""
    left = contents.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    right = contents.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "wa", "sb", "wb")


def _verified(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b); a spooled table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n) for n in ("sa", "wa", "sb", "wb")}
            got = [probability_jaccard(*_unpacked(c["sa"][i].as_py(), c["wa"][i].as_py()), *_unpacked(c["sb"][i].as_py(), c["wb"][i].as_py())) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(got, pa.float64())], ["a", "b", "similarity"])

    return spool(_beside(pairs, contents).mapInArrow(run, "a binary, b binary, similarity double"), "verified")


def bound(a, b):
    """The highest similarity of texts with shares a and b of their weights not in common, as a Column."""
    return F.least(1 / (1 / (1 - a) + b / (1 - b)), 1 / (a / (1 - a) + 1 / (1 - b)))


def _slots(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (mix(key) % np.uint64(SLOTS)).astype(np.int64), (mix(key ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(SLOTS)).astype(np.int64)


def _met(common: np.ndarray, key: np.ndarray) -> np.ndarray:
    """At least how many nodes, up to 255, have each shingle; never too few."""
    one, two = _slots(key)
    return np.minimum(common[one], common[two])


def _common(contents: DataFrame) -> np.ndarray:
    """How many nodes have a shingle, by slot, up to 255."""
    parts = 16
    width = SLOTS // parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(SLOTS, np.uint8)
        for b in batches:
            for k in b.column("shingles"):
                at, many = np.unique(np.concatenate(_slots(_unpacked(k.as_py(), b"")[0])), return_counts=True)
                got[at] = np.minimum(got[at] + many, 255)
        at = np.flatnonzero(got)
        if len(at):
            cut = np.searchsorted(at, np.arange(parts + 1) * width)
            blobs = [(at[lo:hi] - i * width).astype(np.uint32).tobytes() + got[at[lo:hi]].tobytes() for i, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(blobs, pa.binary())], ["part", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        got = np.zeros(width, np.uint8)
        for x in rows.column("counts"):
            raw = x.as_py()
            at = np.frombuffer(raw, np.uint32, len(raw) // 5)
            got[at] = np.minimum(got[at].astype(np.int64) + np.frombuffer(raw, np.uint8, len(raw) // 5, len(raw) // 5 * 4), 255)
        return pa.table({"part": rows.column("part").slice(0, 1), "counts": pa.array([got.tobytes()], pa.binary())})

    got = np.zeros(SLOTS, np.uint8)
    for r in contents.select("shingles").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        got[r.part * width : (r.part + 1) * width] = np.frombuffer(bytes(r.counts), np.uint8)
    return got


SHORT, FULL = 1, 2


def difference(x: tuple[np.ndarray, np.ndarray], lead: tuple[np.ndarray, np.ndarray], similar: bool, common: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """The lists that a node joins for its differences from a leader: their shingles (0: the list of all), the weight of
    the differences from each on, and its sides; the node's measure, and the share of its weight that no other node has."""
    (key, weight), (lk, lw) = x, lead
    k = similarity / (1 - similarity)
    total = float(lw.sum())
    met = _met(common, key)
    own = float(weight[met <= 1].sum()) / float(weight.sum())
    none = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int8)
    if 1 - own < similarity - 1e-9:
        return *none, 0.0, own
    _, ix, il = np.intersect1d(key, lk, assume_unique=True, return_indices=True)
    added, gone = np.ones(len(key), bool), np.ones(len(lk), bool)
    added[ix] = gone[il] = False
    uneven = np.abs(weight[ix].astype(np.int64) - lw[il].astype(np.int64)).sum()
    measure = float((1 + k) * lw[gone].sum() + k * added.sum() - (1 + k) * uneven - (weight[added].astype(np.int64) - 1).sum())
    if measure < 0 or (not similar and measure <= total):
        return np.zeros(1, np.uint64), np.full(1, np.inf), np.full(1, SHORT | FULL, np.int8), 0.0, own
    lost = _met(common, lk[gone]).astype(np.int64)
    keys = np.concatenate([key[added], lk[gone]])
    sizes = np.concatenate([np.ones(int(added.sum())), lw[gone].astype(float)])
    often = np.concatenate([met[added].astype(np.int64), 257 - lost])  # what many have, few have lost
    order = np.lexsort((keys, often))
    keys, often = keys[order], often[order]
    left = np.cumsum(sizes[order][::-1])[::-1]
    side = np.where((1 + 2 * k) * left >= measure - 1e-6, SHORT, 0)
    if measure > total:
        side |= np.where((1 + 2 * k) * left >= measure - total - 1e-6, FULL, 0)
    use = (side > 0) & (often > 1)
    return np.r_[keys[use], np.zeros(1, np.uint64)], np.r_[left[use], np.inf], np.r_[side[use], FULL].astype(np.int8), measure, own


def _compared(pairs: DataFrame, contents: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity, ...) of leaders a and nodes b, with the lists of b's differences from a; a spooled table."""
    common = contents.sparkSession.sparkContext.broadcast(_common(contents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n) for n in ("sa", "wa", "sb", "wb")}
            got, keys, left, sides, measure, own, total = [], [], [], [], [], [], []
            for i in range(batch.num_rows):
                lead, x = _unpacked(c["sa"][i].as_py(), c["wa"][i].as_py()), _unpacked(c["sb"][i].as_py(), c["wb"][i].as_py())
                got.append(probability_jaccard(*lead, *x))
                k, reach, side, g, q = difference(x, lead, got[-1] >= similarity - 1e-9, common.value, similarity)
                for column, value in ((keys, k.view(np.int64).tolist()), (left, reach.tolist()), (sides, side.tolist()), (measure, g), (own, q), (total, float(lead[1].sum()))):
                    column.append(value)
            lists = [pa.array(keys, pa.list_(pa.int64())), pa.array(left, pa.list_(pa.float64())), pa.array(sides, pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(x, pa.float64()) for x in (got, measure, own, total)), *lists], ["a", "b", "similarity", "measure", "own", "total", "keys", "reach", "sides"])

    out = _beside(pairs, contents).mapInArrow(run, "a binary, b binary, similarity double, measure double, own double, total double, keys array<long>, reach array<double>, sides array<tinyint>")
    return spool(out, "compared")


def _labelled(rows: DataFrame, labels: DataFrame | None, name: str) -> DataFrame:
    """rows with the label of their node; a spooled table."""
    if labels is None:
        return spool(rows.withColumn("label", F.col("node")), name)
    names = labels.select("node", F.col("label").alias("known"))
    return spool(rows.join(names, "node", "left").withColumn("label", F.coalesce("known", "node")).drop("known"), name)


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The labels after further links (a, b): components of the links and of the labels so far."""
    if links.isEmpty():
        return labels
    out = components(links if labels is None else links.union(labels.filter("node <> label").select("node", "label")))
    if labels is not None:
        drop(labels)
    return out


def _similar(found: DataFrame, similarity: float) -> DataFrame:
    return found.filter(F.col("similarity") >= similarity - 1e-9).select("a", "b")


def _met_by_lists(entries: DataFrame, contents: DataFrame, labels: DataFrame | None, similarity: float, small: int) -> DataFrame | None:
    """The labels after all similar pairs of different labels that share a list are linked."""
    k = similarity / (1 - similarity)
    x, y = F.col("x"), F.col("y")
    near = ((1 + 2 * k) * F.least(x["reach"], y["reach"]) >= x["measure"] + y["measure"] - x["total"] - 1e-6) & (bound(x["own"], y["own"]) >= similarity - 1e-9)
    facts = F.struct("reach", "measure", "total", "own")
    named = _labelled(entries, labels, "named")
    sides = F.max(F.col("side").bitwiseAND(SHORT)).alias("short"), F.max(F.col("side").bitwiseAND(FULL)).alias("full")
    stats = named.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.min(F.struct("measure", "node", "label", facts.alias("facts"))).alias("lead"), *sides)
    stats = spool(stats.filter("l0 <> l1 AND short > 0 AND full > 0").select("key", "lead", "n"), "stats")
    tagged = spool(named.join(stats, "key"), "tagged")
    drop(named, stats)
    # the node with the least differences, which may be the original of a group of its own, meets a long list's others first
    led = tagged.filter((F.col("n") > small) & (F.col("label") != F.col("lead.label"))).select(F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.facts").alias("x"), facts.alias("y")).filter(near)
    found = _verified(_pair(led).distinct(), contents)
    again = _relabelled(labels, _similar(found, similarity))
    drop(found)
    rows = tagged if again is labels else _labelled(tagged.drop("label"), again, "named")
    one = rows.filter(F.col("side").bitwiseAND(SHORT) > 0).select("key", F.col("node").alias("a"), F.col("label").alias("la"), F.col("side").alias("s"), facts.alias("x"))
    two = rows.filter(F.col("side").bitwiseAND(FULL) > 0).select("key", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("side").alias("t"), facts.alias("y"))
    once = ~((F.col("s") == SHORT | FULL) & (F.col("t") == SHORT | FULL) & (F.col("a") > F.col("b")))
    found = _verified(_pair(one.join(two, "key").filter((F.col("la") != F.col("lb")) & once & near)).distinct(), contents)
    labels = _relabelled(again, _similar(found, similarity))
    drop(found, tagged, *([] if rows is tagged else [rows]))
    return labels


def _pair(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _linked(buckets: DataFrame, contents: DataFrame, similarity: float, small: int) -> DataFrame | None:
    """(node, label) of the nodes with links among those that share a bucket (key, node, n); None without any link."""
    few = buckets.filter(F.col("n") <= small)
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    found = _verified(pairs, contents)
    labels = _relabelled(None, _similar(found, similarity))
    drop(found)
    large = _labelled(buckets.filter(F.col("n") > small).select("key", "node"), labels, "large")
    degree = spool(large.groupBy("node").agg(F.count("*").alias("degree")), "degree")
    leads = large.join(degree, "node").groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min(F.struct((-F.col("degree")).alias("order"), "node")).alias("lead"))
    leads = spool(leads.filter("l0 <> l1").select("key", F.col("lead.node").alias("a")), "leads")
    drop(degree)
    if leads.isEmpty():
        drop(large, leads)
        return labels
    pairs = spool(large.join(leads, "key").filter("a <> node").select("a", F.col("node").alias("b")).distinct(), "led")
    drop(large, leads)
    there = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    some = spool(contents.join(there, "node", "left_semi"), "some")
    compared = _compared(pairs, some, similarity)
    drop(pairs)
    labels = _relabelled(labels, _similar(compared, similarity))
    groups = _labelled(compared.select("a", F.col("b").alias("node")).union(compared.select("a", F.col("a").alias("node")).distinct()), labels, "groups")
    mixed = spool(groups.groupBy("a").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("a"), "mixed")
    fields = F.explode(F.arrays_zip("keys", "reach", "sides")).alias("list")
    entries = compared.join(mixed, "a").select("a", F.col("b").alias("node"), "measure", "own", "total", fields)
    entries = spool(entries.select(F.xxhash64("a", "list.keys").alias("key"), "node", F.col("list.reach").alias("reach"), F.col("list.sides").cast("int").alias("side"), "measure", "own", "total"), "entries")
    drop(groups, mixed)
    labels = _met_by_lists(entries, some, labels, similarity, small)
    drop(compared, entries, some)
    return labels


def _wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted (node, d, g), which are doc_id and h; other texts are left where they are, but for the few
    that meet another's bit."""
    place = wanted.select(F.pmod(F.xxhash64("d", "g"), F.lit(BITS)).alias("p"))
    bits = place.groupBy(F.shiftright("p", 6).alias("row")).agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("bits"))
    here = docs.withColumn("p", F.pmod(F.xxhash64("doc_id", "h"), F.lit(BITS)))
    here = here.join(F.broadcast(bits), F.shiftright("p", 6) == F.col("row")).filter(F.expr("bits & shiftleft(1L, CAST(p & 63 AS INT)) <> 0"))
    return here.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))).select("node", "text")


def classes(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, small: int = SMALL) -> DataFrame:
    """(doc_id, h, class_id, kept) for every row of docs: h is xxhash64(text), class_id the class's least doc_id, and
    kept marks the class's first (doc_id, h)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    signed = spool(_signed(docs, words, bands, rows), "signed")
    once = signed.filter("node IS NOT NULL").select("node", "bands").dropDuplicates(["node"])  # a node's copies have its bands
    entries = spool(once.select("node", F.explode("bands").alias("key")), "entries")
    dealt = entries.repartition("key")  # one exchange, for the counts and for the join with them
    crowded = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    buckets = spool(dealt.join(crowded, "key").select("key", "node", "n"), "buckets")
    drop(entries)
    own = spool(signed.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.min("doc_id").alias("least")), "nodes")
    wanted = own.join(buckets.select("node").distinct(), "node").select("node", F.col("first.doc_id").alias("d"), F.col("first.h").alias("g"))
    wanted = spool(wanted, "wanted")
    texts = _wanted_texts(docs, wanted)
    contents = spool(_contents(texts.dropDuplicates(["node"]) if _repeats(signed) else texts, words), "contents")
    drop(wanted)
    labels = _linked(buckets, contents, similarity, small)
    drop(buckets, contents)
    named = own.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")) if labels is not None else own.withColumn("label", F.col("node"))
    named = spool(named, "classes")
    heads = spool(named.groupBy("label").agg(F.min("least").alias("class_id"), F.min("first").alias("head")), "heads")
    members = spool(named.join(heads, "label").select("node", "class_id", "head"), "members")
    out = signed.select("doc_id", "h", "node").join(members, "node", "left")
    drop(own, named, heads)
    alone = F.col("class_id").isNull() & F.col("head").isNull()
    kept = alone | (F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.h") == F.col("h")))
    return out.select("doc_id", "h", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), kept.alias("kept"))


def _repeats(signed: DataFrame) -> bool:
    """Whether some (doc_id, text) is there more than once."""
    return not signed.groupBy("doc_id", "h").count().filter("count > 1").isEmpty()


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without those whose class has another, first row; the columns stay, of any name."""
    h, d, g = unused(docs, "h", "d", "g")
    named = docs.withColumn(h, F.xxhash64("text"))
    found = classes(docs, **options)
    lost = spool(found.filter("NOT kept").select(F.col("doc_id").alias(d), F.col("h").alias(g)).distinct(), "lost")
    twice = found.filter("kept").groupBy("doc_id", "h").count().filter("count > 1")
    out = named.join(lost, named.doc_id.eqNullSafe(F.col(d)) & (F.col(h) == F.col(g)), "left_anti")
    if not twice.isEmpty():  # repeated rows: one of them stays, if they have words
        words = F.col("text").rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]")
        out = out.filter(words).dropDuplicates(["doc_id", h]).union(out.filter(~F.coalesce(words, F.lit(False))))
    return out.drop(h)
