"""Line deduplication over a distributed suffix array of line sequences; DataFrame operations only.

Each text is its sequence of non-blank lines. Lines that are met once end runs, so they leave the sequences at the start.
Prefix doubling ranks the suffixes: level 0 ranks the distinct lines, level j + 1 the distinct pairs of a suffix's level-j rank
and that of the suffix 2**j lines on (or its end), in a range sort. The places in the order of their last ranks are the suffix
array; the common prefix of each with the one before it, found from the stored ranks from the last level down, is the LCP
array. An LCP interval, the maximal stretch of the array whose neighbours share n lines or more, has all places where the
same n lines stand. Of each interval the first place stays and the later copies go.

A repeated run counts if its lines have at least `min_chars` characters in all. Every such run is the union of its
shortest counting windows, from each line forward and up to each line backward; so intervals are taken at the lengths of
windows, and doubling ends at the longest of them (at most log2(min_chars) levels), since a longer common prefix decides
nothing more. The order of places is (doc_id, xxhash64(text), line).

Hot lines: lines and pairs are pre-aggregated to distinct ones before ranking; the suffix array lies in ranges of equal size,
which split the places of one line or run as any others; stretches are joined over the ranges' ends by a row for each
range and length. No window spans the table. Ranks are joined back by sort-merge joins over written tables, whose hot keys
adaptive execution splits.

Defined results: a null text stays null, an empty one empty; a document is its (doc_id, text), so repeated rows are
treated alike and are no copies of one another; null ids sort first; blank lines within a deleted run go with it;
other columns stay, of any name but that of the report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.spool import drop, spool, unused
from skein.sources.session import sorted_ranges

MIN_CHARS = 30
_WORD = r"[^\x20\x09-\x0D]"


def _lines(docs: DataFrame) -> DataFrame:
    """(d, h, at, i, chars, k1, k2): the non-blank lines, numbered by `at`, and by `i` among all lines."""
    every = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    found = docs.select("d", "h", F.posexplode(F.filter(every, lambda s: s["x"].rlike(_WORD))).alias("at", "s"))
    return found.select("d", "h", "at", F.col("s.i").alias("i"), F.length("s.x").cast("long").alias("chars"), F.xxhash64("s.x").alias("k1"), F.hash("s.x").alias("k2"))


def _named(keys: DataFrame, *by: str) -> DataFrame:
    """Distinct keys with names that follow their order: ranks in a range sort."""
    return spool(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()), "names")


def _runs(places: DataFrame) -> DataFrame:
    """places with `run`, which consecutive places share, and `left`, the places from each to the run's end."""
    run = Window.partitionBy("d", "h", "run")
    named = places.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("d", "h").orderBy("at")))
    return named.withColumn("left", F.max("at").over(run) - F.col("at") + 1)


def _windows(places: DataFrame, min_chars: int) -> DataFrame:
    """(d, h, s, n): the shortest windows of at least min_chars characters, within runs of consecutive places."""
    run = Window.partitionBy("d", "h", "run")
    sums = places.withColumn("up", F.sum("chars").over(run.orderBy("at"))).withColumn("below", F.col("up") - F.col("chars"))
    after = F.min("at").over(run.orderBy("below").rangeBetween(min_chars, Window.unboundedFollowing))
    before = F.max("at").over(run.orderBy("up").rangeBetween(Window.unboundedPreceding, -min_chars))
    both = sums.select("d", "h", "at", F.coalesce(after, F.when(F.max("up").over(run) - F.col("below") >= min_chars, F.max("at").over(run) + 1)).alias("to"), F.coalesce(before + 1, F.when(F.col("up") >= min_chars, F.min("at").over(run))).alias("from"))
    ahead = both.filter("to IS NOT NULL").select("d", "h", F.col("at").alias("s"), (F.col("to") - F.col("at")).alias("n"))
    back = both.filter("from IS NOT NULL").select("d", "h", F.col("from").alias("s"), (F.col("at") + 1 - F.col("from")).alias("n"))
    return ahead.union(back).distinct()


def _ranked(places: DataFrame, longest: int) -> list[DataFrame]:
    """(d, h, at, left, name) for each level: ranks of the suffixes by their first 2**level lines; spooled tables."""
    levels, size = [spool(places.select("d", "h", "at", "left", "name"), "ranks")], 1
    while size < longest:
        ranks = levels[-1]
        ahead = ranks.select("d", "h", (F.col("at") - size).alias("at"), F.col("name").alias("b"))
        pairs = ranks.withColumnRenamed("name", "a").join(ahead, ["d", "h", "at"], "left")
        pairs = spool(pairs.withColumn("b", F.when(F.col("left") > size, F.col("b")).otherwise(F.lit(-1))), "pairs")
        named = _named(pairs.select("a", "b").distinct(), "a", "b")
        levels.append(spool(pairs.join(named, ["a", "b"]).select("d", "h", "at", "left", "name"), "ranks"))
        drop(pairs, named)
        size *= 2
    return levels


def _suffix_array(levels: list[DataFrame]) -> DataFrame:
    """(d, h, at, range, idx, lcp): the places in suffix order, with the lines that each shares with the one before it, up to
    2**(levels - 1); a spooled table."""
    order = sorted_ranges(levels[-1], "name", "d", "h", "at")
    row = F.struct("d", "h", "at", "left", "name")
    last = order.groupBy("_p").agg(F.max_by(row, "_i").alias("last"))
    edge = F.broadcast(last.select("_p", F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("_p")).alias("edge")))  # a row for each range
    before = F.lag(row).over(Window.partitionBy("_p").orderBy("_i"))
    array = order.withColumn("before", before).join(edge, "_p").withColumn("before", F.coalesce("before", "edge"))
    array = array.select("d", "h", "at", "left", F.col("_p").alias("range"), F.col("_i").alias("idx"), F.col("before.d").alias("qd"), F.col("before.h").alias("qh"), F.col("before.at").alias("q"), F.col("before.left").alias("qleft"), F.coalesce(F.col("before.name") == F.col("name"), F.lit(False)).alias("same"))
    array = spool(array.withColumn("lcp", F.when(F.col("same"), F.lit(1 << len(levels) - 1)).otherwise(F.lit(0)).cast("long")), "array")
    drop(order)
    for level in range(len(levels) - 2, -1, -1):
        names = levels[level].select("d", "h", "at", "name")
        ahead = names.select("d", "h", F.col("at").alias("_at"), F.col("name").alias("_x"))
        other = names.select(F.col("d").alias("qd"), F.col("h").alias("qh"), F.col("at").alias("_q"), F.col("name").alias("_y"))
        open_ = array.filter("NOT same AND q IS NOT NULL").withColumn("_at", F.col("at") + F.col("lcp")).withColumn("_q", F.col("q") + F.col("lcp"))
        within = (F.col("lcp") < F.col("left")) & (F.col("lcp") < F.col("qleft")) & (F.col("_x") == F.col("_y"))
        more = open_.join(ahead, ["d", "h", "_at"], "left").join(other, ["qd", "qh", "_q"], "left")
        more = more.withColumn("lcp", F.col("lcp") + F.when(F.coalesce(within, F.lit(False)), F.lit(1 << level)).otherwise(F.lit(0)))
        was = array
        array = spool(array.filter("same OR q IS NULL").unionByName(more.select(*array.columns)), "array")
        drop(was)
    whole = array.withColumn("lcp", F.coalesce(F.least("lcp", "left", "qleft"), F.lit(0)))
    out = spool(whole.select("d", "h", "at", "range", "idx", "lcp"), "suffixes")
    drop(array)
    return out


def _intervals(windows: DataFrame, array: DataFrame) -> DataFrame:
    """windows with `head`, the first place in suffix order of the LCP interval that each is in."""
    placed = spool(windows.join(array.withColumnRenamed("at", "s"), ["d", "h", "s"]), "placed")
    begins = F.when(F.col("lcp") < F.col("n"), F.struct("range", "idx"))
    up = Window.partitionBy("range", "n").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    named = placed.withColumn("own", F.max(begins).over(up))
    ends = placed.groupBy("range", "n").agg(F.max(begins).alias("end"))  # a row for each range and length
    carried = Window.partitionBy("n").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("range", "n", F.max("end").over(carried).alias("carried"))
    return named.join(F.broadcast(ends), ["range", "n"]).select("d", "h", "s", "n", F.coalesce("own", "carried").alias("head"))


def repeated_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, h, runs, gone) of the documents (d, h, text) that lose lines: the deleted runs as first and last line, counted
    from 0, in order, and the number of non-blank lines in them. A spooled table."""
    lines = spool(_lines(docs), "lines")
    twice = _named(lines.groupBy("k1", "k2").agg(F.count("*").alias("c")).filter("c > 1").select("k1", "k2"), "k1", "k2")
    places = spool(_runs(lines.join(twice, ["k1", "k2"]).select("d", "h", "at", "i", "chars", "name")), "places")
    drop(lines, twice)
    windows = spool(_windows(places, min_chars), "windows")
    levels = _ranked(places, windows.agg(F.max("n")).first()[0] or 0)
    array = _suffix_array(levels)
    every = spool(_intervals(windows, array), "intervals")
    drop(windows, array, *levels)
    first = spool(every.groupBy("n", "head").agg(F.min(F.struct("d", "h", "s")).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c"), "first")
    later = every.join(first, ["n", "head"]).filter(~F.struct("d", "h", "s").eqNullSafe(F.col("first")))
    gone = later.select("d", "h", F.explode(F.sequence("s", F.col("s") + F.col("n") - 1)).alias("at")).distinct()
    gone = gone.join(places.select("d", "h", "at", "i"), ["d", "h", "at"])
    island = gone.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("d", "h").orderBy("at")))
    runs = island.groupBy("d", "h", "run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("c"))
    out = spool(runs.groupBy("d", "h").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"), F.sum("c").alias("gone")), "runs")
    drop(places, every, first)
    return out


def deduplicate(docs: DataFrame, min_chars: int = MIN_CHARS, report: str = "_lines") -> DataFrame:
    """docs, all columns and rows, with later copies of repeated line runs deleted from the text, and a struct `report` of
    the deleted runs and the number of non-blank lines deleted; a column of that name is replaced."""
    # a null id joins as a value of its own, so that ids are compared as they are
    null = F.lit(-(2**63)).cast("long")
    d = F.coalesce(F.col("doc_id").cast("long"), null) if docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int") else F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = docs.select(d.alias("d"), F.xxhash64("text").alias("h"), "text")
    runs = repeated_runs(key.filter("text IS NOT NULL").dropDuplicates(["d", "h"]) if _repeats(key) else key, min_chars)
    id_, h, lost = unused(docs, "d", "h", "lost")
    named = docs.withColumn(id_, d).withColumn(h, F.xxhash64("text"))
    runs = runs.select(F.col("d").alias(id_), F.col("h").alias(h), F.struct("runs", "gone").alias(lost))
    joined = named.join(runs.hint("shuffle_hash"), [id_, h], "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.exists(f"{lost}.runs", lambda r: (i >= r["first"]) & (i <= r["last"])))
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != report), F.col(lost).alias(report))


def _repeats(key: DataFrame) -> bool:
    return not key.groupBy("d", "h").count().filter("count > 1").isEmpty()


def digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines (non-blank), n_removed, n_runs and kept_sha256 of every document."""
    docs = docs.select("doc_id", "text").withColumn("n_lines", F.coalesce(F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(_WORD))), F.lit(0)).cast("long"))
    out = deduplicate(docs, min_chars)
    return out.select("doc_id", "n_lines", F.coalesce("_lines.gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.size("_lines.runs"), F.lit(0)).cast("long").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The same result by comparing the lines of every window.
SQL = f"""
WITH lines AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
solid AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, length(line) AS c FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
sums AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY pos) AS up FROM solid),
spans AS (
  SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.up >= a.up - a.c + {MIN_CHARS} GROUP BY ALL
  UNION SELECT b.doc_id, max(a.pos) AS s, b.pos AS e FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.up >= a.up - a.c + {MIN_CHARS} GROUP BY ALL),
keys AS (SELECT w.doc_id, w.s, w.e, string_agg(line, chr(10) ORDER BY pos) AS k FROM spans w JOIN solid l ON l.doc_id = w.doc_id AND l.pos BETWEEN w.s AND w.e GROUP BY ALL),
later AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS rn FROM keys) WHERE rn > 1),
gone AS (SELECT DISTINCT l.doc_id, l.pos, l.i FROM solid l JOIN later w ON l.doc_id = w.doc_id AND l.pos BETWEEN w.s AND w.e),
runs AS (SELECT doc_id, min(i) AS a, max(i) AS b, count(*) AS c FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gone) GROUP BY doc_id, g),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM lines l WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = l.doc_id AND l.i BETWEEN r.a AND r.b) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.c, 0) AS BIGINT) AS n_removed, CAST(coalesce(r.k, 0) AS BIGINT) AS n_runs, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM solid GROUP BY doc_id) n USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(c) AS c, count(*) AS k FROM runs GROUP BY doc_id) r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
