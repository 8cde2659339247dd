import hashlib
import random
import re

import helpers as H

from skein.llm import line_dedup as L


def plain(rows, least):
    """{doc: removed line numbers}: a non-blank line goes if a run over it, of enough characters, also stands earlier."""
    seqs = {d: [(i, x) for i, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)] for d, t in rows if t is not None}
    first, runs = {}, []
    for d in sorted(seqs):
        s = seqs[d]
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                key = tuple(x for _, x in s[a:b])
                if sum(map(len, key)) >= least:
                    if first.setdefault(key, (d, a)) != (d, a):
                        runs.append((d, a, b))
    gone = {}
    for d, a, b in runs:
        gone.setdefault(d, set()).update(range(a, b))
    out = {}
    for d, t in rows:
        at, lost = sorted(gone.get(d, ())), set()
        for k in at:
            lost.add(seqs[d][k][0])
            if k + 1 in gone[d]:
                lost.update(range(seqs[d][k][0], seqs[d][k + 1][0]))
        out[d] = (len(seqs.get(d, ())), len(at), "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in lost))
    return out


def test_against_plain(spark):
    r = random.Random(5)
    lines = ["a", "bb", "ccc", "dddd", "eeeee", "a longer line of text", "", "  "]
    rows = [(d, "\n".join(r.choice(lines) for _ in range(r.randint(0, 14)))) for d in range(30)] + list(enumerate(H.texts()[40:], 30))
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, runs string, at int")
    for least in (1, 6, 30):
        want = plain(rows, least)
        got = L.digests(df, least).collect()
        assert len(got) == len(rows)
        for x in got:
            n, gone, text = want[x.doc_id]
            assert (x.n_lines, x.n_removed, x.kept_sha256) == (n, gone, hashlib.sha256(text.encode()).hexdigest()), x.doc_id


def test_odd_rows(spark):
    df = H.docs(spark)
    out = L.deduplicate(df)
    assert out.columns == [*df.columns, "_lines"] and out.count() == df.count()
    assert out.filter("text IS NULL").count() == df.filter("text IS NULL").count()
    assert L.deduplicate(H.empty(spark)).count() == 0
    twins = spark.createDataFrame([(1, "one line that is long enough to count here")] * 2, "doc_id long, text string")
    assert {x.text for x in L.deduplicate(twins).collect()} == {"one line that is long enough to count here"}
