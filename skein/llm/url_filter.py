"""URL filters: rules, and a ratio of character language models where no rule fits; DataFrame operations only.

The URLs that rules decide, but for one in FOLDS by the crc32 of the URL, train two smoothed variable-order Markov models,
of accepted and of rejected URLs: the
probability of a character after two is that after one where the longer context is rare, and that of the character
alone where both are (each order adds PRIOR counts in the ratio of the next shorter one). Characters of host and path are
folded to 32 symbols, so a model is at most 32**3 numbers, whatever the input. A URL's score is the mean log ratio of the
models over its characters; URLs under a cut are blocked. The cut is calibrated on the decided URLs that the models were not
trained on (on all decided ones, where those are not of both kinds): it makes the mean of both classes' error rates least.

URLs are parsed and coded once, into a written table of their grams; the models, one row, and the scores are written too.

Defined results: a null URL or one without `://` has an empty host and path, and is judged by the method as the empty
text; without decided URLs of both kinds the method allows; repeated rows and ids are judged alike; null ids stay; an
empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.spool import drop, spool

#: The rules of the registered query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
PRIOR = 4.0
FOLDS = 4
#: Scores are calibrated in steps of 1 / STEPS, within -LIMIT .. LIMIT.
STEPS, LIMIT = 100, 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    got = [F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2)]
    return F.translate(got[0], _UPPER, _LOWER), got[1]


def ruled(pages: DataFrame, rules=RULES, *more: Column) -> DataFrame:
    """page_id, host, path, rule and its verdict, and more; the longest rule that fits wins, of equals a blocking one."""
    host, path = parts(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"), *more)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("decided", verdict)


def _grams() -> Column:
    """Codes of each character of host and path with the two before it, and of the end."""
    place = F.array(*(F.lit(1 + _LOWER.index(c) if c in _LOWER else 27 if c.isdigit() else {".": 28, "/": 29, "-": 30}.get(c, 31)) for c in map(chr, range(128))))
    chars = F.filter(F.split(F.translate(F.concat("host", "path"), _UPPER, _LOWER), "", -1), lambda c: c != "")
    codes = F.concat(F.array(F.lit(0), F.lit(0)), F.transform(chars, lambda c: F.coalesce(F.get(place, F.ascii(c)), F.lit(31))), F.array(F.lit(0)))
    return F.transform(F.sequence(F.lit(0), F.size("codes") - 3), lambda i: F.get("codes", i) * 1024 + F.get("codes", i + 1) * 32 + F.get("codes", i + 2)), codes


def _with_grams(found: DataFrame) -> DataFrame:
    grams, codes = _grams()
    return found.withColumn("codes", codes).withColumn("grams", grams).drop("codes")


def model(found: DataFrame) -> DataFrame:
    """One row with the array `ratio`: the log of the models' ratio for each of the 32**3 grams."""
    known = found.filter("decided IS NOT NULL").select("decided", F.explode("grams").alias("gram"))
    counts = known.groupBy("gram").agg(*(F.count(F.when(F.col("decided") == v, 1)).alias(v) for v in ("allow", "block")))
    cells = found.sparkSession.range(32**3).join(F.broadcast(counts), F.col("id") == F.col("gram"), "left").select("id", F.coalesce("allow", F.lit(0)).alias("allow"), F.coalesce("block", F.lit(0)).alias("block"))
    pair, one, last = F.col("id") % 1024, F.expr("id div 32 % 32"), F.col("id") % 32

    def summed(*by: Column) -> DataFrame:
        names = [f"k{i}" for i in range(len(by))]
        return cells.select(*(c.alias(n) for c, n in zip(by, names, strict=True)), "allow", "block").groupBy(*names).agg(F.sum("allow").alias("a"), F.sum("block").alias("b"))

    out = cells.select("id", F.expr("id div 32").alias("before"), pair.alias("pair"), one.alias("one"), last.alias("last"), F.col("allow").alias("a3"), F.col("block").alias("b3"))
    for name, n, by in (("before", "c2", F.expr("id div 32")), ("pair", "2", pair), ("one", "c1", one), ("last", "1", last)):
        out = out.join(F.broadcast(summed(by).select(F.col("k0").alias(name), F.col("a").alias(f"a{n}"), F.col("b").alias(f"b{n}"))), name)
    total = F.broadcast(summed(F.lit(0)).select(F.col("k0"), F.col("a").alias("a0"), F.col("b").alias("b0")))
    out = out.withColumn("k0", F.lit(0)).join(total, "k0")
    chance = {}
    for v in "ab":
        p = (F.col(f"{v}1") + 1) / (F.col(f"{v}0") + 32)
        p = (F.col(f"{v}2") + PRIOR * p) / (F.col(f"{v}c1") + PRIOR)
        chance[v] = (F.col(f"{v}3") + PRIOR * p) / (F.col(f"{v}c2") + PRIOR)
    rows = out.select("id", F.log(chance["a"] / chance["b"]).alias("r"))
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "r"))), lambda x: x["r"]).alias("ratio"))


def _scored(found: DataFrame, ratio: DataFrame) -> DataFrame:
    """found with the score: the mean of its grams' ratios."""
    total = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.get("ratio", g))
    return found.withColumn("ratio", ratio.scalar()).withColumn("score", total / F.size("grams")).drop("ratio")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's score of every page."""
    own = F.pmod(F.crc32(F.coalesce("url", F.lit("")).cast("binary")), F.lit(FOLDS)) == 0
    found = spool(_with_grams(ruled(pages, rules, own.alias("apart"))), "grams")
    ratio = spool(model(found.filter("NOT apart")), "model")
    scored = spool(_scored(found, ratio).drop("grams"), "scored")
    drop(found, ratio)
    bins = scored.filter("decided IS NOT NULL").groupBy("decided", "apart", F.round(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score"))) * STEPS).cast("int").alias("bin")).count()
    every, apart = {}, {}
    for r in bins.collect():
        every[r["decided"], r["bin"]] = every.get((r["decided"], r["bin"]), 0) + r["count"]
        if r["apart"]:
            apart[r["decided"], r["bin"]] = r["count"]
    cut = _cut(apart if len({k for k, _ in apart}) == 2 else every)
    verdict = F.coalesce("decided", F.when(F.col("score") * STEPS < cut, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def _cut(histogram: dict[tuple[str, int], int]) -> float:
    """The cut, between bins, with the least mean error; of equals the middle of the widest range."""
    sums = {v: sum(n for (k, _), n in histogram.items() if k == v) for v in ("allow", "block")}
    if not all(sums.values()):
        return -math.inf
    best, lost, kept = (2.0, 0.0, 0.0), 0, sums["block"]
    bins = sorted({b for _, b in histogram})
    for b, after in zip(bins, [*bins[1:], bins[-1] + 1], strict=True):
        lost += histogram.get(("allow", b), 0)
        kept -= histogram.get(("block", b), 0)
        error = (lost / sums["allow"] + kept / sums["block"]) / 2
        if (error, b - after) < best[:2]:
            best = error, b - after, (b + after) / 2
    return best[2]
