from collections import Counter

import helpers as H
import numpy as np

from skein.llm import near_dedup as N


def shingles(text):
    w = H.alnum(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jp(a, b):
    if {*a.values(), *b.values()} == {1}:  # each term is 1 / |a or b|
        return len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    return sum(1 / sum(max(a[e] / a[x], b[e] / b[x]) for e in set(a) | set(b)) for x in set(a) & set(b))


def plain(rows):
    s = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and (s[i] == s[j] or jp(s[i], s[j]) >= 0.8 - 1e-9):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[top(i)][0] for i in range(len(rows))}


def test_measure():
    r = np.random.default_rng(8)
    for _ in range(60):
        a, b = (Counter(r.integers(0, 12, r.integers(1, 25)).tolist()) for _ in range(2))
        k = [np.array(sorted(x), np.uint64) for x in (a, b)]
        w = [np.array([x[i] for i in sorted(x)], np.uint32) for x in (a, b)]
        assert abs(N.probability_jaccard(k[0], w[0], k[1], w[1]) - jp(a, b)) < 1e-9


def test_signature_estimates():
    r = np.random.default_rng(9)
    key = np.r_[np.arange(40), np.arange(10, 50)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    row = np.repeat([0, 1], 40)
    weight = r.integers(1, 4, 80)
    sig = N.signatures(key, row, weight, 2, 4000)
    a, b = (Counter(dict(zip(key[row == k].tolist(), weight[row == k].tolist(), strict=True))) for k in (0, 1))
    assert abs((sig[0] == sig[1]).mean() - jp(a, b)) < 0.04


def test_against_plain(spark):
    rows = list(enumerate(H.texts(n=60)))
    base = [t for _, t in rows if t and 60 < len(t.split()) < 140][:3]
    for k, t in enumerate(base):  # families of near copies, more than a small bucket
        for v in range(25):
            w = t.split(" ")
            w[(7 * v) % len(w)] = f"v{v}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, node string, h int")
    want = plain(rows)
    for small in (2, 8):
        got = N.classes(df, small=small).collect()
        assert {r.doc_id: r.class_id for r in got} == want
        assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    kept = N.deduplicate(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_texts_without_candidates_are_not_shuffled(spark):
    r = np.random.default_rng(11)
    texts = [" ".join(f"{x:x}" for x in r.integers(0, 2**40, 3000)) for _ in range(300)]
    texts += [t + " end" for t in texts[:4]] + texts[:2]
    df = spark.createDataFrame([(i or None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def written():
        sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, spark._sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))

    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        before = written()
        got = N.classes(df).collect()
        assert written() - before < sum(map(len, texts)) / 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    same = {}
    for x in got:
        same.setdefault(x.class_id, []).append(x.doc_id)
    assert sorted(map(len, same.values()))[-4:] == [2, 2, 3, 3] and len(same) == 300


def test_odd_rows(spark):
    df = H.docs(spark)
    assert N.classes(df).count() == df.count()
    rows = [(1, "some words of a text here"), (1, "some words of a text here"), (None, "some words of a text here"), (2, "other things are said in this one"), (3, None), (4, ""), (4, "")]
    out = N.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in out) == ["2", "3", "4", "4", "None"]
    assert N.classes(H.empty(spark)).count() == 0 and N.deduplicate(H.empty(spark)).count() == 0


def variants(n=250, size=400, seed=3):
    """An original and texts at 0.80 to 0.85 of it, less to one another."""
    r = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(size)]
    out = [" ".join(words)]
    while len(out) <= n:
        w = list(words)
        for at in r.choice(size, 8, replace=False):
            w[at] = f"v{len(out)}x{at}"
        if 0.8 <= jp(shingles(out[0]), shingles(" ".join(w))) <= 0.85:
            out.append(" ".join(w))
    return out


def test_variants_of_one_original(spark):
    texts = variants()
    ids = np.random.default_rng(4).permutation(len(texts)).tolist()
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    assert {r.class_id for r in N.classes(df).collect()} == {0}


def test_bound(spark):
    r = np.random.default_rng(5)
    rows = []
    for _ in range(100):
        a, b = (Counter(r.integers(0, 12, r.integers(1, 25)).tolist()) for _ in range(2))
        if any(x in b for x in a):
            rows.append((sum(a[x] for x in a if x not in b) / sum(a.values()), sum(b[x] for x in b if x not in a) / sum(b.values()), jp(a, b)))
    df = spark.createDataFrame(rows, "a double, b double, s double")
    assert df.filter(N.bound(df.a, df.b) < df.s - 1e-9).isEmpty()


def test_no_similar_pair_escapes_the_lists():
    """Texts around a leader: every pair of similarity 0.8 that is not in the leader's class shares a list and passes."""
    r = np.random.default_rng(6)
    met = 0
    for trial in range(150):
        size = int(r.integers(20, 60))
        lead = {x: int(r.integers(1, 4)) if trial % 2 else 1 for x in range(1, size)}
        texts = []
        for _ in range(12):  # two by two, with edits in common
            base = dict(texts[-1] if len(texts) % 2 else lead)
            for x in r.choice(size, int(r.integers(0, size // (4 if len(texts) % 2 == 0 else 10))), replace=False):
                base.pop(int(x), None)
            for _ in range(int(r.integers(0, size // (5 if len(texts) % 2 == 0 else 10)))):
                base[int(r.integers(1000, 1400))] = int(r.integers(1, 3)) if trial % 2 else 1
            if trial % 3 == 0 and base:
                x = list(base)[0]
                base[x] += 1
            texts.append(base)
        packed = [(np.array(sorted(x), np.uint64), np.array([x[i] for i in sorted(x)], np.uint32)) for x in (lead, *texts)]
        common = np.zeros(N.SLOTS, np.uint8)
        for key, _ in packed:
            for at in N._slots(key):
                np.add.at(common, at, 1)
        similar = [N.probability_jaccard(*x, *packed[0]) >= 0.8 - 1e-9 for x in packed[1:]]
        found = [N.difference(x, packed[0], s, common, 0.8) for x, s in zip(packed[1:], similar, strict=True)]
        total = float(packed[0][1].sum())
        for i in range(len(texts)):
            for j in range(i):
                if (similar[i] and similar[j]) or N.probability_jaccard(*packed[i + 1], *packed[j + 1]) < 0.8 or texts[i] == texts[j]:
                    continue
                met += 1
                lists = [{int(k): (reach, int(side)) for k, reach, side in zip(*f[:3], strict=True)} for f in (found[i], found[j])]
                (m, q), (n, p) = found[i][3:], found[j][3:]
                shared = [(min(lists[0][k][0], lists[1][k][0]), lists[0][k][1], lists[1][k][1]) for k in set(lists[0]) & set(lists[1])]
                assert any(((s & N.SHORT and t & N.FULL) or (t & N.SHORT and s & N.FULL)) and 9 * reach >= m + n - total - 1e-6 for reach, s, t in shared), (texts[i], texts[j])
    assert met > 100


def test_families_in_the_large_buckets(spark):
    """Variants under 0.8 of an original that many have, with near copies of their own, are classes as by all pairs."""
    r = np.random.default_rng(7)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words)]
    for v in range(60):
        w = list(words)
        for at in r.choice(300, int(r.integers(2, 16)), replace=False):
            w[at] = f"v{v}x{at}"
        texts.append(" ".join(w))
        if v % 3 == 0:
            for c in range(int(r.integers(1, 12))):
                again = list(w)
                again[int(r.integers(300))] = f"c{v}y{c}"
                texts.append(" ".join(again))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in N.classes(df, small=3).collect()} == plain(rows)


def test_clashing_names(spark):
    names = ["_h", "_d", "_g", "_h_", "_D_", "node", "key", "class_id", "kept"]
    df = spark.createDataFrame([(i, t, *(f"{n}{i}" for n in names)) for i, t in enumerate(["a b c d e f g"] * 3 + ["other words are here"])], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = N.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(out.collect()) == sorted(r for r in df.collect() if r.doc_id in (0, 3))
