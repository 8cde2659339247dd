import hashlib
import random

import helpers as H

from skein.llm import suffix_dedup as S


def plain(rows, length=100):
    first, gone = set(), {}
    for d, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        m = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in first:
                m[k : k + length] = b"\1" * length
            first.add(w)
        gone[d] = (b, bytes(m))
    return {d: (len(b), sum(m), len([x for x in m.split(b"\0") if x]), hashlib.sha256(bytes(x for x, y in zip(b, m, strict=True) if not y)).hexdigest()) for d, (b, m) in gone.items()}


def check(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], "doc_id long, text string, key string, chunk int")
    got = {r.doc_id: tuple(r)[1:] for r in S.digests(df, **options).collect()}
    assert got == plain(rows)


def test_against_plain(spark):
    check(spark, list(enumerate(H.texts())))


def test_repetitive(spark):
    r = random.Random(7)
    parts = ["".join(r.choice("ab \né") for _ in range(r.randint(20, 160))) for _ in range(12)]
    check(spark, [(d, "".join(r.choice(parts) for _ in range(r.randint(0, 9)))) for d in range(150)])
    check(spark, [(0, "a" * 99), (1, "a" * 100), (2, "a" * 250), (3, "ab" * 200), (4, "b" + "ab" * 60), (5, "x" * 99), (-3, "ab" * 51)])


def test_odd_rows(spark):
    df = H.docs(spark)
    got = S.digests(df).collect()
    assert len(got) == df.count()
    body = "".join(chr(97 + i * i % 26) + str(i) for i in range(80))
    rows = [(1, body), (1, body), (None, body), (2, body), (1, "another text")]
    out = S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), bytes(r.kept).decode()) for r in out) == sorted([("1", ""), ("1", ""), ("None", body), ("2", ""), ("1", "another text")])
    assert S.digests(H.empty(spark)).count() == 0


def test_ids_to_the_ends_of_long(spark):
    body = "".join(chr(97 + i * i % 26) + str(i) for i in range(80))
    for n in (1023, 2**60 - 1, 10**18 + 511, 2**63 - 2, -(2**63), -513, -1):
        check(spark, [(5, body), (n, body), (n + 1, body), (7, body[50:] + "tail of its own" * 20)])


def test_a_trigger_of_many_phrases(spark):
    """One passage stands before, within and after texts that differ right beside it."""
    r = random.Random(9)
    passage = "".join(r.choice("abcdefghij klmnop") for _ in range(130))
    side = lambda: "".join(r.choice("qrstuvwxyz\n") for _ in range(r.randint(0, 90)))
    rows = [(d, side() + passage[r.choice([0, 0, 10, 40]) :] + side()) for d in range(400)]
    rows += [(400 + d, rows[d][1][5:] + side()) for d in range(40)]
    for wide in (3, S.WIDE):
        check(spark, rows, wide=wide)
