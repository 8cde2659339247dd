import math
import zlib
from collections import Counter

import helpers as H
import numpy as np

from skein.llm import bloom_lm as B


def test_filter_counts():
    r = np.random.default_rng(10)
    codes = np.unique(r.integers(1, 1 << 40, 3000))
    counts = np.maximum(1, (r.pareto(0.8, len(codes)) * 2).astype(np.int64))
    bits = 1 << 14
    rows = {}
    for b in range(B.BLOCKS):
        mine = B.mix(codes.astype(np.uint64)) % np.uint64(B.BLOCKS) == b
        out = np.zeros(bits, bool)
        up = B.level(counts[mine])
        for q in range(1, int(up.max(initial=0)) + 1):
            for at in B._places(codes[mine][up >= q], q, bits):
                out[at] = True
        rows[b] = np.packbits(out, bitorder="little").tobytes()
    f = B.Filter(rows, bits)
    got = f.counts(codes)
    assert (got > counts / B.BASE - 1e-9).all()  # never much less: a filter has no false negatives
    assert np.mean(np.abs(got - counts) <= np.maximum(1, counts * 0.45)) > 0.97
    assert np.mean(f.counts(r.integers(1 << 41, 1 << 42, 3000)) > 0) < 0.01


def test_against_plain(spark):
    df = H.docs(spark)
    rows = df.collect()
    tokens = [(r.doc_id, H.solid(H.lower(r.text)) + [None]) for r in rows]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in tokens if not held(d) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for d, t in tokens)
    got = B.scores(df, share=1e-3, bits=1 << 22).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert B.scores(H.empty(spark)).count() == 0


def test_held_out_is_better_than_the_base(spark):
    import random

    r = random.Random(11)
    after = {w: r.sample("abcdefghijklmnop", 3) for w in "abcdefghijklmnop"}

    def text():
        w = [r.choice("abcdefghijklmnop")]
        for _ in range(120):
            w.append(r.choice(after[w[-1]]))
        return " ".join(w)

    df = spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")
    got = [x for x in B.scores(df).collect() if x.held_out]
    assert sum(x.score for x in got) > 0.75 * sum(x.base_score for x in got)


def test_bigrams_of_rare_words(spark):
    r = np.random.default_rng(12)
    rows = [" ".join(f"c{x}" for x in r.integers(0, 50, 1500)) for _ in range(150)]
    rows += [f"rare{k} word{k} after{k}" for k in range(300) for _ in range(3)]
    rows = list(enumerate(rows))
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = [(d, [None, *t.split(" "), None]) for d, t in rows]
    c = Counter(w for d, t in tokens if not held(d) for w in t[1:])
    pairs = Counter(p for d, t in tokens if not held(d) for p in zip(t, t[1:]))
    n, v = sum(c.values()), len(c)
    least = lambda x: float(B.least_count(B.level(np.array([x])))[0]) if x else 0.0
    want = {d: sum(math.log10((min(least(pairs[a, b]), c[a]) + B.K * (c[b] + 1) / (n + v + 1)) / (c[a] + B.K)) for a, b in zip(t, t[1:])) for d, t in tokens}
    got = B.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    off = max(abs(x.score / want[x.doc_id] - 1) for x in got if x.doc_id < 150)  # some of 1500 bigrams are false positives
    assert len(got) == len(rows) and off < 5e-3
    assert np.mean([abs(x.score - want[x.doc_id]) < 1e-6 for x in got if x.doc_id >= 150]) > 0.95
    assert all(x.score > x.base_score + 0.1 for x in got if x.doc_id >= 150 and x.n_known > 1)  # rare words alone, met in training


def test_filter_grows_with_what_is_in_it():
    r = np.random.default_rng(13)
    for n in (0, 10, 3000, 200000):
        codes = np.unique(r.integers(1, 1 << 47, n).astype(np.uint64))
        f = B._filter(codes, r.integers(1, 9, len(codes)), None)
        assert np.mean(f.levels(r.integers(1 << 47, 1 << 48, 20000).astype(np.uint64)) > 0) < 1.3 * B.RATE
    try:
        B._filter(codes, np.ones(len(codes), np.int64), 1 << 16)
        raise AssertionError("too small a filter passed")
    except ValueError:
        pass


def test_probabilities_sum_to_one_at_most():
    r = np.random.default_rng(14)
    for n in (1, 5, 200, 3000):
        counts = np.maximum(1, (r.pareto(0.7, n) * 2).astype(np.int64))
        found = B._filter(np.unique(r.integers(1, 1 << 47, 2 * n).astype(np.uint64))[:n], counts, None)
        assert found.bits and (B.least_count(B.level(counts)) <= counts).all()
        base = r.dirichlet(np.ones(n + 3))  # more words than have been met after the context
        pairs = np.r_[B.least_count(B.level(counts)), np.zeros(3)]
        assert ((pairs + B.K * base) / (counts.sum() + B.K)).sum() <= 1 + 1e-12


def test_packed_numbers_and_keys():
    r = np.random.default_rng(15)
    for x in ([0], [0, 0, 0], [1, 255, 256], [2**32 - 1, 2**32, 5], [2**64 - 1, 0, 1 << 63], r.integers(0, 9, 4000)):
        x = np.array(x, np.uint64)
        for cut in ([0, len(x)], range(len(x) + 1)):
            cut = np.array(cut)
            assert (B._numbers(B._planes(x, cut), cut) == x).all()
    for n, buckets in ((0, 16), (1, 16), (5000, 16), (5000, 4999)):
        keys = np.unique(np.r_[np.array([0, 2**64 - 1] if n else [], np.uint64), r.integers(0, 2**64, n, dtype=np.uint64)])
        order, number, cut = B._dealt(keys, buckets)
        gaps = B._numbers(B._planes(B._gaps(keys[order], cut, buckets), cut), cut)
        back = [B._keys(gaps[lo:hi], np.array([0, hi - lo]), b, buckets) for b, lo, hi in zip(number, cut[:-1], cut[1:], strict=True)]
        assert (np.sort(np.concatenate([np.zeros(0, np.uint64), *back])) == keys).all()
    two = np.array([7, 23, 39, 7, 55], np.uint64)  # two rows of one bucket
    cut = np.array([0, 3, 5])
    assert (B._keys(B._gaps(two, cut, 16), cut, 7, 16) == two).all()


def test_shuffled_bytes(spark):
    r = np.random.default_rng(16)
    rows = [(i, " ".join(f"{x:x}" for x in r.integers(0, 1 << 20, 300))) for i in range(4096)]
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        seen = sc.statusStore().executorList(True)
        return sum(seen.apply(k).totalShuffleWrite() for k in range(seen.size()))

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    before = written()
    B.scores(df).write.format("noop").mode("overwrite").save()
    moved, size = written() - before, sum(len(t) for _, t in rows)
    assert moved < 4 * size  # 3.1; with the words sent back and whole keys it was 5.3
