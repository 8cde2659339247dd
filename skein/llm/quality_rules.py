"""Quality rules by repetition coverage: the characters inside duplicated n-grams and lines.

Words are `[^\\x20\\x09-\\x0D]+`. Rolling hashes of n-grams of several lengths find, within each text, those met twice
or more. Of two to four words, the n-gram whose occurrences have the most characters may have a share of the text's word
characters of at most TOP; of five to ten words, the characters under n-grams met before in the text (their first
occurrence is none) may have a share of at most LIMITS, which falls with length: the longer a copy, the less of it is
chance. Copies of earlier lines have LINE_LIMITS. The base rule rejects texts of under 10 words and those with over 20
in 100 of their words in repeated 5-word windows.

Defined results: a null or empty text has no words and is rejected; rows are judged alone, so repeated rows and ids
repeat their results and null ids stay; an empty table gives an empty table; in `judge`, further columns stay and those
with a result's name are replaced; `keep` returns its rows as they are, with columns of any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.spool import arrow_batches
from skein.llm.text import NON_SPACE, Rolling, blocks, mix, spans

#: The published limits of repetition rules for web text. n-gram length: the largest share of a text's word
#: characters in all occurrences of one n-gram that is there twice or more; in n-grams met before.
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of lines, and of line characters, that are copies of earlier lines of the text.
LINE_LIMITS = (0.30, 0.20)
MIN_WORDS, REPEAT_SHARE = 10, 20

_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])

COLUMNS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "top_share": pa.float64(), "gram_share": pa.float64(), "line_share": pa.float64()}


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of times that each key is there, and a mask of the keys met before."""
    order = np.argsort(keys, kind="stable")
    new = np.r_[True, keys[order][1:] != keys[order][:-1]][: len(keys)]
    many, before = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    many[order] = np.diff(np.r_[np.flatnonzero(new), len(keys)])[np.cumsum(new) - 1]
    before[order] = ~new
    return many, before


def _keyed(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(row.astype(np.uint64) + np.uint64(1)))


def measure(buf: np.ndarray, off: np.ndarray, tops: dict[int, float] = TOP, limits: dict[int, float] = LIMITS) -> dict[str, np.ndarray]:
    """The figures of each text of a block."""
    n = len(off) - 1
    solid = NON_SPACE[buf]
    lead = (buf & 0xC0) != 0x80
    starts, ends, row = spans(solid, off)
    rolling = Rolling(buf)
    h = rolling.of(starts, ends)
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead & solid, out=chars[1:])
    per_word = chars[ends] - chars[starts]
    n_words, word_chars = np.bincount(row, minlength=n), chars[off[1:]] - chars[off[:-1]]

    def covered(at: np.ndarray, size: int) -> np.ndarray:
        edge = np.zeros(len(h) + 1, np.int32)
        np.add.at(edge, at, 1)
        np.subtract.at(edge, at + size, 1)
        return np.cumsum(edge[:-1]) > 0

    total = np.maximum(word_chars, 1)
    top, worst = np.zeros(n), np.zeros(n)
    bad = np.zeros(n, bool)
    repeat_words = np.zeros(n, np.int64)
    at, upto = np.arange(len(h)), np.r_[0, np.cumsum(per_word)]
    for size in range(2, max(5, *tops, *limits) + 1):
        at = at[at + size <= len(h)]  # a longer repeat starts where a shorter one does
        at = at[row[at] == row[at + size - 1]]
        code = np.zeros(len(at), np.uint64)
        for k in range(size):
            code = code * np.uint64(0x9E3779B97F4A7C15) + h[at + k]
        many, before = _repeated(_keyed(mix(code), row[at]))
        at, before, many = at[many > 1], before[many > 1], many[many > 1]
        if not len(at):
            break
        if size == 5:
            repeat_words = np.bincount(row[covered(at, size)], minlength=n)
        if size in limits:
            inside = covered(at[before], size)
            share = np.bincount(row[inside], per_word[inside], n) / total
            worst, bad = np.maximum(worst, share), bad | (share > limits[size])
        if size in tops:
            share = np.zeros(n)
            np.maximum.at(share, row[at], many * (upto[at + size] - upto[at]))
            top, bad = np.maximum(top, share / total), bad | (share / total > tops[size])

    ls, le, lrow = spans(buf != 0x0A, off)
    worded = chars[le] > chars[ls]
    ls, le, lrow = ls[worded], le[worded], lrow[worded]
    before = _repeated(_keyed(rolling.of(ls, le), lrow))[1]
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=points[1:])
    size = points[le] - points[ls]
    dup_lines, lines = np.bincount(lrow[before], minlength=n), np.bincount(lrow, minlength=n)
    line_share = np.bincount(lrow[before], size[before], n) / np.maximum(np.bincount(lrow, size, n), 1)
    bad |= (dup_lines > LINE_LIMITS[0] * lines) | (line_share > LINE_LIMITS[1])
    failed = (n_words < MIN_WORDS) | (100 * repeat_words > REPEAT_SHARE * n_words)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": _sums(_SYMBOL[buf], off), "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "base_failed": failed, "kept": ~(failed | bad), "top_share": top, "gram_share": worst, "line_share": line_share}


def _measured(column: pa.Array) -> dict[str, np.ndarray]:
    got = [measure(buf, off) for _, _, buf, off in blocks(column)]
    return {c: np.concatenate([g[c] for g in got]) if got else np.zeros(0) for c in COLUMNS}


def judge(docs: DataFrame) -> DataFrame:
    """docs with the figures and the verdict in place of the text."""
    arrow_batches(docs.sparkSession)
    keep = [n for n in docs.columns if n != "text" and n not in COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _measured(b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *(pa.array(got[c], t) for c, t in COLUMNS.items())], [*keep, *COLUMNS])

    kinds = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    return docs.mapInArrow(run, ", ".join([*fields, *(f"{c} {kinds[t]}" for c, t in COLUMNS.items())]))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, unchanged."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_measured(b.column("text"))["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _limit(limits: dict[int, float]) -> str:
    return "CASE n " + " ".join(f"WHEN {n} THEN {x}" for n, x in limits.items()) + " END"


#: The same result by comparing the n-grams of each text; a longer one can be there twice only where its first three words are.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
c AS (SELECT doc_id, t, l, CAST(len(l) AS BIGINT) AS n_words, CAST(length(array_to_string(l, '')) AS BIGINT) AS word_chars FROM d),
g AS (SELECT doc_id, n, k, array_to_string(list_slice(l, k, k + n - 1), ' ') AS g FROM (SELECT doc_id, l, n, unnest(range(1, len(l) - n + 2)) AS k FROM c, (SELECT unnest([2, 3]) AS n) WHERE len(l) >= n)),
short AS (SELECT doc_id, n, k, g, count(*) OVER (PARTITION BY doc_id, n, g) AS many, row_number() OVER (PARTITION BY doc_id, n, g ORDER BY k) AS nth FROM g QUALIFY many > 1),
more AS (SELECT doc_id, m.n, k, array_to_string(list_slice(l, k, k + m.n - 1), ' ') AS g FROM short JOIN c USING (doc_id), (SELECT unnest(range(4, {max(LIMITS) + 1})) AS n) m WHERE short.n = 3 AND k + m.n - 1 <= len(l)),
r AS (SELECT * FROM short UNION ALL SELECT doc_id, n, k, g, count(*) OVER (PARTITION BY doc_id, n, g) AS many, row_number() OVER (PARTITION BY doc_id, n, g ORDER BY k) AS nth FROM more QUALIFY many > 1),
five AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM r WHERE n = 5) GROUP BY doc_id),
met AS (SELECT doc_id, n, sum(length(l[p])) / max(word_chars) AS share FROM (SELECT DISTINCT doc_id, n, unnest(range(k, k + n)) AS p FROM r WHERE nth > 1 AND n >= {min(LIMITS)}) JOIN c USING (doc_id) GROUP BY doc_id, n),
top AS (SELECT doc_id, n, max(many * (length(g) - n + 1)) / max(word_chars) AS share FROM r JOIN c USING (doc_id) WHERE n <= {max(TOP)} GROUP BY doc_id, n),
shares AS (SELECT doc_id, max(share) FILTER (n >= {min(LIMITS)}) AS gram_share, max(share) FILTER (n <= {max(TOP)}) AS top_share, bool_or(share > {_limit(TOP | LIMITS)}) AS bad FROM (SELECT * FROM met UNION ALL SELECT * FROM top) GROUP BY doc_id),
lines AS (SELECT doc_id, line, length(line) AS size, row_number() OVER (PARTITION BY doc_id, line) > 1 AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM c) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
ln AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(size) FILTER (dup), 0) / sum(size) AS line_share FROM lines GROUP BY doc_id),
x AS (SELECT doc_id, n_words, word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {REPEAT_SHARE} * n_words AS base_failed, coalesce(bad, false) OR coalesce(n_dup_lines > {LINE_LIMITS[0]} * lines OR line_share > {LINE_LIMITS[1]}, false) AS bad,
  coalesce(top_share, 0.0)::DOUBLE AS top_share, coalesce(gram_share, 0.0)::DOUBLE AS gram_share, coalesce(line_share, 0.0)::DOUBLE AS line_share FROM c LEFT JOIN five USING (doc_id) LEFT JOIN shares USING (doc_id) LEFT JOIN ln USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR bad) AS kept, top_share, gram_share, line_share FROM x
"""
