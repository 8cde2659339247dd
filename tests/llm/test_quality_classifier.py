import math
import random
import zlib
from collections import Counter

import helpers as H
import numpy as np

from skein.llm import quality_classifier as Q


def corpus(n=400):
    r = random.Random(6)
    good = lambda: " ".join("".join(r.choice("abcdeimnrst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 80))) + "."
    bad = [lambda: good().replace(" ", "### "), lambda: good().upper(), lambda: " ".join(w for x in good().split() for w in [x] * 3), lambda: good().replace(" ", " | ")]
    out = []
    for i in range(n):
        y = int(r.random() < 0.7)
        out.append((i, good() if y else r.choice(bad)(), y))
    return out


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t, _ in rows], "doc_id long, text string, score string, quality int")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(3, None, 0), (None, 1, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels)
    got = {r.doc_id: r for r in Q.classify(docs, model).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in got if got[i].held_out] and all(got[i].held_out == (i in set(held)) for i in got)
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    flipped = labels.selectExpr("doc_id", f"CASE WHEN doc_id IN ({','.join(map(str, held))}) THEN 1 - quality ELSE quality END AS quality")
    again = {r.doc_id: r.score for r in Q.classify(docs, Q.fit(docs, flipped)).collect()}
    assert again == {i: r.score for i, r in got.items()}  # held-out labels change nothing


def test_odd_rows(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    odd = H.docs(spark)
    assert Q.classify(odd, Q.fit(docs, labels)).count() == odd.count()
    assert Q.classify(H.empty(spark), Q.fit(docs, labels)).count() == 0
    flat = Q.fit(docs, labels.filter("quality = 1"))
    assert {r.score for r in Q.classify(docs, flat).collect()} == {0.5}
    assert {r.score for r in Q.classify(docs, Q.fit(docs, labels.filter("false"))).collect()} == {0.5}


def plain(text):
    """The features of a text, one by one."""
    b, words = (text or "").encode(), H.solid(text)
    out = {int(Q.mix(np.array([int.from_bytes(b[i : i + 3], "big") + 1], np.uint64))[0] % Q.DIMS) for i in range(len(b) - 2)}
    twice = sum(x == y for x, y in zip(words, words[1:])) / max(1, len(words))
    again = sum(c - 1 for c in Counter(words).values()) / max(60, len(words))
    level = lambda share: sum(share > x for x in Q.LEVELS)
    return out | {Q.DIMS + level(twice), Q.DIMS + len(Q.LEVELS) + 1 + level(again)}


def test_features_and_scores_against_plain(spark):
    texts = [t for _, t, _ in corpus(150)] + H.texts(n=10) + ["x y " * 30_000, "w " * 9, "w w", "é" * 5]
    labels = [i % 3 > 0 for i in range(150)]
    model = Q.Model([np.array(sorted(plain(t))) for t in texts[:150]], np.array(labels))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    got = Q.classify(docs, model).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        f = sorted(plain(texts[r.doc_id]))
        margin = sum(model.weight[i] for i in f) / math.sqrt(sum(model.ratio[i] ** 2 for i in f)) + model.bias
        assert abs(r.score - 1 / (1 + math.exp(-(model.curve[0] * margin + model.curve[1])))) < 1e-9


def test_ratios_and_optimum():
    """The log-count ratios as counted, and a solution whose duality gap is small: by strong duality the optimum's objective."""
    rows = [np.array(sorted(plain(t))) for _, t, _ in corpus(120)]
    y = np.array([1.0 if k else -1.0 for _, _, k in corpus(120)])
    model = Q.Model(rows, y)
    fit = [i for i in range(120) if i % 4 != 3]
    p, q = (Counter(f for i in fit if y[i] == s for f in rows[i].tolist()) for s in (1, -1))
    total = [sum(c.values()) + Q.SMOOTH * Q.WIDTH for c in (p, q)]
    for f in range(0, Q.WIDTH, 97):
        assert abs(model.ratio[f] - (math.log((p[f] + Q.SMOOTH) / total[0]) - math.log((q[f] + Q.SMOOTH) / total[1]))) < 1e-9
    x = [model.ratio[r] / math.sqrt((model.ratio[r] ** 2).sum()) for r in rows]
    w, bias, alpha = Q.Model._descend(rows, x, y)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * Q.COST
    again = np.zeros(Q.WIDTH)
    for i in range(120):
        again[rows[i]] += alpha[i] * y[i] * x[i]
    assert np.allclose(again, w) and abs((alpha * y).sum() - bias) < 1e-9 and (alpha >= 0).all() and (alpha <= cost + 1e-12).all()
    norm = (w @ w + bias**2) / 2
    primal = norm + sum(c * max(0.0, 1 - s * (w[r] @ v + bias)) for c, s, r, v in zip(cost, y, rows, x, strict=True))
    assert 0 <= primal - (alpha.sum() - norm) + 1e-9 < 0.02 * primal
