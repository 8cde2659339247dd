import hashlib
import random

import helpers as H
import numpy as np

from skein.llm import decontamination as D
from skein.llm.fm_index import FMIndex


def test_index():
    r = np.random.default_rng(1)
    text = np.r_[r.integers(0, 4, 700), 0]
    index = FMIndex(text, 3, 5)
    for n in (1, 2, 5):
        patterns = r.integers(1, 4, (30, n))
        for p, lo, hi in zip(patterns, *index.search(patterns), strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


def plain(rows, items):
    windows = {}
    for i, t in items:
        w = H.alnum(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = H.alnum(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if s := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= s
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, spans string")


def test_against_plain(spark):
    texts = H.texts()
    r = random.Random(4)
    items = []
    for i in range(25):
        w = (r.choice([t for t in texts if t and len(t) > 200])).split(" ")
        k = r.randrange(max(1, len(w) - 15))
        items.append((i, " ".join(w[k : k + r.randint(1, 15)])))
    items += [(3, "of the"), (100, None), (101, ""), (102, "zzz qqq"), (102, "naïve Über")]
    df = H.docs(spark)
    want = sorted(plain([(x.doc_id, x.text) for x in df.collect()], items), key=repr)
    for options in ({}, {"block_bytes": 60}):
        got = D.digests(df, bench(spark, [(i, t, "x") for i, t in items]), **options)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_removal_and_empty(spark):
    long = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"
    rows = [(1, f"Before it, {long.upper()}! After it."), (2, "clean"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in D.decontaminate(df, bench(spark, [(1, long, "")])).collect()}
    assert got == {1: "Before it, ! After it.", 2: "clean", 3: None}
    assert D.digests(df, bench(spark, [])).filter("contaminated").count() == 0
    assert D.digests(H.empty(spark), bench(spark, [(1, long, "")])).count() == 0
