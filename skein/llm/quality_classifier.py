"""A quality classifier: naive Bayes support vectors.

A text is the set of its n-grams, hashed: byte trigrams, and of its words `[^\\x20\\x09-\\x0D]+` the share of bigrams of one
word twice and of words met before, each as one of a few levels. Indicators are scaled by the class log-count ratios of
the training rows, rows to length 1, and a linear hinge-loss model is fitted to them by dual coordinate descent. A
logistic curve, fitted to a fourth of the sample that the model does not see, makes a score from 0 to 1 of the margin.

The fit takes at most FIT_ROWS labelled rows of each class, those with the least hash of their doc_id, and never a
held-out one (crc32 of the id as text mod 4 is 2). Neither labels nor ids, lang or source are inputs of a score.

Defined results: a null or empty text has no n-grams but those of an empty text and a score like any other; unlabelled
rows and rows with a null label are only scored; without training rows of both classes every score is 0.5; rows are
scored one by one, so repeated rows and ids repeat their results (of repeated labels all count), and null ids are not
held out; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.spool import arrow_batches
from skein.llm.text import NON_SPACE, Rolling, blocks, mix, spans

FOLDS, HELD_OUT = 4, 2
FIT_ROWS = 2000
DIMS = 1 << 17
ACCEPT = 0.7
EPOCHS, COST, SMOOTH = 12, 1.0, 1.0
#: Levels of shares; the features of each begin at the end of the hashed ones.
LEVELS = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5])
WIDTH = DIMS + 2 * (len(LEVELS) + 1)


def _met(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words that their text has met before."""
    key = mix(h ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order][1:] == key[order][:-1]
    return out


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers of each text's distinct features, by row."""
    n, m = len(off) - 1, max(0, len(buf) - 2)
    code = buf[:m].astype(np.uint64) << np.uint64(16) | buf[1 : m + 1].astype(np.uint64) << np.uint64(8) | buf[2 : m + 2]
    row = np.searchsorted(off, np.arange(m), "right") - 1
    inside = np.arange(m) + 3 <= off[row + 1] if m else np.zeros(0, bool)
    hashed = (mix(code[inside] + np.uint64(1)) % np.uint64(DIMS)).astype(np.int64)
    starts, ends, wrow = spans(NON_SPACE[buf], off)
    h = Rolling(buf).of(starts, ends)
    words = np.maximum(np.bincount(wrow, minlength=n), 1)
    twice = np.r_[False, (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])][: len(h)]
    extra = []
    for k, mask in enumerate((twice, _met(h, wrow) & (np.bincount(wrow, minlength=n)[wrow] > 0))):
        share = np.bincount(wrow[mask], minlength=n) / (words if k == 0 else np.maximum(words, 60))
        extra.append(DIMS + k * (len(LEVELS) + 1) + np.searchsorted(LEVELS, share))
    every = np.unique(np.concatenate([row[inside] * WIDTH + hashed, *(np.arange(n) * WIDTH + x for x in extra)]))
    return every // WIDTH, every % WIDTH


class Model:
    """Log-count ratios, weights, bias and the logistic curve."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        y = np.where(labels > 0, 1.0, -1.0)
        self.flat = not ((y > 0).any() and (y < 0).any())
        self.weight, self.square = np.zeros(WIDTH), np.ones(WIDTH)
        self.bias = 0.0
        self.curve = 1.0, 0.0
        if self.flat:
            return
        fit = np.arange(len(rows)) % 4 != 3
        if not all((y[part] == s).any() for part in (fit, ~fit) for s in (1, -1)):
            fit[:] = True
        p, q = np.full(WIDTH, SMOOTH), np.full(WIDTH, SMOOTH)
        for i in np.flatnonzero(fit):
            (p if y[i] > 0 else q)[rows[i]] += 1
        ratio = np.log(p / p.sum()) - np.log(q / q.sum())
        x = [ratio[r] / max(1e-9, np.sqrt((ratio[r] ** 2).sum())) for r in rows]
        w, bias, _ = self._descend([rows[i] for i in np.flatnonzero(fit)], [x[i] for i in np.flatnonzero(fit)], y[fit])
        self.ratio, self.weight, self.square, self.bias = ratio, w * ratio, ratio**2, bias
        check = ~fit if (~fit).any() else fit
        self.curve = self._platt(np.array([w[rows[i]] @ x[i] + bias for i in np.flatnonzero(check)]), y[check])

    @staticmethod
    def _descend(rows: list[np.ndarray], x: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """Weights, bias and dual variables by dual coordinate descent on the hinge loss; the classes weigh alike."""
        w, bias = np.zeros(WIDTH), 0.0
        alpha = np.zeros(len(y))
        cost = COST * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
        norm = np.array([v @ v + 1.0 for v in x])
        random = np.random.default_rng(7)
        for _ in range(EPOCHS):
            most = 0.0
            for i in random.permutation(len(y)):
                slope = y[i] * (w[rows[i]] @ x[i] + bias) - 1
                new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
                step = (new - alpha[i]) * y[i]
                if step:
                    most = max(most, abs(step))
                    w[rows[i]] += step * x[i]
                    bias += step
                    alpha[i] = new
            if most < 1e-3:
                break
        return w, bias, alpha

    @staticmethod
    def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Slope and offset of the logistic curve by Newton steps; the classes weigh alike."""
        positive = y > 0
        weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum()))
        target = np.where(positive, (positive.sum() + 1) / (positive.sum() + 2), 1 / ((~positive).sum() + 2))
        a, b = 1.0, 0.0
        design = np.c_[margin, np.ones(len(margin))]
        for _ in range(50):
            s = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            gradient = design.T @ (weight * (s - target)) + np.array([1e-6 * a, 1e-6 * b])
            hessian = (design * (weight * s * (1 - s))[:, None]).T @ design + 1e-6 * np.eye(2)
            step = np.linalg.solve(hessian, gradient)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        return (a, b) if a > 0 else (1.0, 0.0)

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if self.flat:
            return np.full(n, 0.5)
        row, f = features(buf, off)
        margin = np.bincount(row, self.weight[f], n) / np.sqrt(np.maximum(np.bincount(row, self.square[f], n), 1e-18)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -30, 30)))


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS) -> Model:
    """A model of labels.quality from at most fit_rows rows of each class."""
    arrow_batches(docs.sparkSession)
    usable = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(~_held_out(F.col("doc_id"))).select("doc_id", "quality")
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = usable.filter("quality = 1").orderBy(*by).limit(fit_rows).union(usable.filter("quality = 0").orderBy(*by).limit(fit_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, _, buf, off in blocks(b.column("text")):
                row, f = features(buf, off)
                cut = np.searchsorted(row, np.arange(len(off)))
                out += [f[lo:hi].astype(np.int32).tobytes() for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(out, pa.binary())], ["doc_id", "quality", "f"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "quality")]
    got = rows.mapInArrow(run, ", ".join([*kinds, "f binary"])).toLocalIterator()
    got = sorted((str(r.doc_id), r.quality, bytes(r.f)) for r in got)
    random = np.random.default_rng(3).permutation(len(got))
    return Model([np.frombuffer(got[i][2], np.int32) for i in random], np.array([got[i][1] for i in random]))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.score(buf, off) for _, _, buf, off in blocks(b.column("text"))]
            score = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array(score >= ACCEPT).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
