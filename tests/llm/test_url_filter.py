import math
import re
import zlib
from collections import Counter

from skein.llm import url_filter as U


def rows():
    hosts = ["a.example.org", "www.shop.com", "example.org", "spam-win.net", "de.wiki.net", "org", "EXAMPLE.ORG", "notexample.org.com"]
    paths = ["/en/1", "/en/2?x=/fr/", "/fr/9", "/de/3#t", "/es/4.html", "", "/", "?q", "/en/17/ü"]
    out = [f"http://{h}{p}" for h in hosts for p in paths]
    return out + [None, "", "no scheme", "a://b://c/d", "https://x.com/fr/\ny", out[0], "http://" + "long." * 500 + "com/de/x"]


def plain(urls):
    found = []
    for u in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        best = None
        for action, rule in U.RULES:
            name, slash, rest = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith(slash + rest) and (best is None or len(rule) > len(best[1])):
                best = action, rule
        found.append((host, path, best, zlib.crc32((u or "").encode()) % U.FOLDS == 0))
    symbol = lambda c: 1 + ord(c) - 97 if "a" <= c <= "z" else 27 if c in "0123456789" else {".": 28, "/": 29, "-": 30}.get(c, 31)

    def grams(host, path):
        s = [0, 0, *map(symbol, re.sub("[A-Z]", lambda x: x[0].lower(), host + path)), 0]
        return [tuple(s[i : i + 3]) for i in range(len(s) - 2)]

    n = {v: [Counter() for _ in range(4)] for v in ("allow", "block")}
    for host, path, best, apart in found:
        for a, b, c in grams(host, path) if best and not apart else ():
            for k, key in enumerate(((), (c,), (b, c), (a, b, c))):
                n[best[0]][k][key] += 1

    def p(v, a, b, c):
        n0, n1, n2, n3 = n[v]
        before1, before2 = sum(x for k, x in n2.items() if k[0] == b), sum(x for k, x in n3.items() if k[:2] == (a, b))
        q = (n1[(c,)] + 1) / (n0[()] + 32)
        q = (n2[(b, c)] + U.PRIOR * q) / (before1 + U.PRIOR)
        return (n3[(a, b, c)] + U.PRIOR * q) / (before2 + U.PRIOR)

    known = {}
    out = []
    for host, path, best, apart in found:
        g = grams(host, path)
        for x in g:
            if x not in known:
                known[x] = math.log(p("allow", *x) / p("block", *x))
        out.append((host, path, best, sum(known[x] for x in g) / len(g), apart))
    bins = lambda rows: Counter((b[0], int(math.floor(abs(s * U.STEPS) + 0.5) * (1 if s >= 0 else -1))) for _, _, b, s, _ in rows if b)
    histogram = bins(x for x in out if x[4])
    cut = U._cut(histogram if len({k for k, _ in histogram}) == 2 else bins(out))
    return [(h, q, b and b[1], b[0] if b else "block" if s * U.STEPS < cut else "allow", s) for h, q, b, s, _ in out]


def test_against_plain(spark):
    urls = rows()
    df = spark.createDataFrame([(i if i else None, u, "clash", 1) for i, u in enumerate(urls)], "page_id long, url string, verdict string, gram int")
    got = U.judge(df).collect()
    assert len(got) == len(urls)
    want = {i if i else None: w for i, w in enumerate(plain(urls))}
    for r in got:
        w = want[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == w[:4], (r, w)
        assert abs(r.score - w[4]) < 1e-9


def test_without_both_classes(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.org/y")], "page_id long, url string")
    assert {r.verdict for r in U.judge(df).collect()} == {"allow"}
    assert U.judge(df.filter("false")).count() == 0
