import re
from collections import Counter

import helpers as H

from skein.llm import quality_rules as Q


def judged(text):
    text = text or ""
    w = H.solid(text)

    def covered(n):
        c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return {k for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}

    def met(n):
        seen, out = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            out |= set(range(i, i + n)) if g in seen else set()
            seen.add(g)
        return out

    def top(n):
        c = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return max([k * sum(map(len, g)) for g, k in c.items() if k > 1], default=0)

    seen, dup, chars, dup_chars, lines = set(), 0, 0, 0, 0
    for x in text.split("\n"):
        if H.solid(x):
            lines, chars = lines + 1, chars + len(x)
            if x in seen:
                dup, dup_chars = dup + 1, dup_chars + len(x)
            seen.add(x)
    five, total = covered(5), max(1, sum(map(len, w)))
    failed = len(w) < 10 or 100 * len(five) > 20 * len(w)
    bad = {n for n, limit in Q.LIMITS.items() if sum(len(w[k]) for k in met(n)) / total > limit}
    bad |= {n for n, limit in Q.TOP.items() if top(n) / total > limit}
    bad |= {"lines"} if dup > Q.LINE_LIMITS[0] * lines or dup_chars / max(1, chars) > Q.LINE_LIMITS[1] else set()
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(five), failed, not (failed or bad)), bad


def plain(text):
    return judged(text)[0]


def test_against_plain(spark):
    rows = H.texts() + ["a b c d e f g h i j k l", "a b c d e a b c d e a b c d e", "one # two | three\n" * 3, "w w w w w w w w w w w w"]
    df = H.docs(spark, rows)
    got = Q.judge(df)
    want = sorted(((r.doc_id, *plain(r.text)) for r in df.collect()), key=repr)
    assert sorted((tuple(r) for r in got.select("doc_id", *list(Q.COLUMNS)[:7]).collect()), key=repr) == want
    assert got.count() == df.count()
    kept = Q.keep(df)
    assert kept.columns == df.columns and kept.count() == sum(w[-1] for w in want)
    assert Q.judge(H.empty(spark)).count() == 0 and Q.keep(H.empty(spark)).count() == 0


def runs(n, copies, size, tail):
    """A text of `size` words with a run of n words of `tail` letters `copies` times, apart from one another."""
    own = iter(f"own{k}" for k in range(10**6))
    run = [f"r{k}".ljust(tail, "x") for k in range(n)]
    out = []
    for _ in range(copies):
        out += run + [next(own), next(own)]
    return " ".join([*out, *(next(own) for _ in range(size - len(out)))])


def test_every_length_decides_some_text_alone():
    """For each length there is a text that the base rule passes and this length alone rejects."""
    import numpy as np

    found = {}
    for n in [*Q.TOP, *Q.LIMITS]:
        for copies in range(2, 16):
            for size in range(10, 400):
                if n * copies + 2 * copies > size or found.get(n):
                    continue
                share = n * copies / size
                if 0.05 < share < 0.5:
                    for tail in (4, 5, 6):
                        text = runs(n, copies, size, tail)
                        if not found.get(n) and judged(text)[1] == {n} and not judged(text)[0][5]:
                            found[n] = text
    assert set(found) == {*Q.TOP, *Q.LIMITS}
    for n, text in found.items():
        buf, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
        tops, limits = ({k: x for k, x in d.items() if k != n} for d in (Q.TOP, Q.LIMITS))
        assert not Q.measure(buf, off)["kept"][0] and Q.measure(buf, off, tops, limits)["kept"][0]


def test_clashing_names(spark):
    names = ["text_share", "n_words", "_h", "spans", "kept", "row"]
    df = spark.createDataFrame([(1, "some words " * 3 + "of a text that has ten of them or more", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert Q.keep(df).columns == df.columns
    assert Q.judge(df).columns == ["doc_id", "text_share", "_h", "spans", "row", *Q.COLUMNS]
