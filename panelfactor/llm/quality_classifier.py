"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics (lengths, shares of letters and marks, repeats).
Each class has a mean and a covariance, shrunk towards the pooled covariance and its diagonal; a
score is the difference of the classes' Gaussian log densities, from Mahalanobis distances solved
with the classes' Cholesky factors, which are made once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .labelled import in_fold, learnable
from .textkernel import blocks, row_sets

#: Labelled rows to fit on at most (those with the lowest hash of their id), and the two shrinkages.
MAX_LABELLED, TO_POOLED, TO_DIAGONAL = 50_000, 0.3, 0.1
MODULUS, REMAINDER = 3, 1

NAMES = ["words", "word_length", "upper", "digits", "symbols", "pipes", "exclaim", "stops", "other_marks", "high", "line_words", "dup_lines", "distinct_words", "top_word", "next_same", "long_words", "short_words", "marked_words"]


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGITS, _SYMBOLS, _PIPES, _EXCLAIM, _STOPS = (_table(x) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>~^=_@", "|", "!?", ".,"))
_OTHER = _table("\"'()[]{}:;/\\+-`")
_HIGH = np.arange(256) >= 0xC0
_MARK = ~(_table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") | (np.arange(256) >= 0x80) | _STOPS)


def statistics(b) -> np.ndarray:
    """One row of transformed statistics for each row of a text block."""
    n = b.rows
    low = b.lowered()
    starts, ends = low.words()
    row = low.row_of(starts)
    words = np.bincount(row, minlength=n)
    count = b.per_row
    length = b.span_points(starts, ends)
    solid = np.maximum(np.bincount(row, weights=length, minlength=n), 1)
    many = np.maximum(words, 1)

    hashed = low.hashes(starts, ends)
    _, owner = row_sets(hashed, row)
    distinct = np.bincount(owner, minlength=n)
    order = np.lexsort((hashed, row))
    h, r = hashed[order], row[order]
    group = np.cumsum(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) - 1 if len(h) else np.empty(0, np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, np.bincount(group, minlength=len(owner)))
    same = np.flatnonzero((hashed[1:] == hashed[:-1]) & (row[1:] == row[:-1]))
    repeats = np.bincount(row[same], minlength=n)
    marked = np.bincount(row, weights=b.span_counts(_MARK, starts, ends) > 0, minlength=n)

    at, to, line_row = b.lines()
    first, last = np.searchsorted(starts, at), np.searchsorted(starts, to)
    worded = last > first
    line_hash = b.hashes(at, to)[worded]
    line_row = line_row[worded]
    lines = np.bincount(line_row, minlength=n)
    _, line_owner = row_sets(line_hash, line_row)
    dup = lines - np.bincount(line_owner, minlength=n)

    share = lambda x, of, scale: np.arcsinh(scale * x / (of + 30))  # noqa: E731  smoothed: a mark in a short text says little
    columns = [
        np.log1p(words), np.log((solid + 50) / (many + 10)), share(count(_UPPER), solid, 20), share(count(_DIGITS), solid, 50), share(count(_SYMBOLS), solid, 50),
        share(count(_PIPES), solid, 50), share(count(_EXCLAIM), solid, 50), share(count(_STOPS), solid, 20), share(count(_OTHER), solid, 50), share(count(_HIGH), solid, 10),
        np.log1p((words + 20) / (lines + 1)), share(dup, np.maximum(lines, 1), 10), np.log((distinct + 5) / (words + 5)) / np.log(words + 5), share(top, many, 5), share(repeats, many, 20),
        share(np.bincount(row, weights=length > 12, minlength=n), many, 5), share(np.bincount(row, weights=length <= 3, minlength=n), many, 5), share(marked, many, 10),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


class Discriminant:
    """Quadratic discriminant of two classes; standardised features, cached Cholesky factors."""

    def __init__(self, x: np.ndarray, y: np.ndarray, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL):
        """Classes without rows are unknown: all scores are then 0.5 (none known) or near the one class."""
        d = x.shape[1]
        self.classes = [int((y == c).sum()) for c in (0, 1)]
        if not min(self.classes):
            self.known = False
            return
        self.known = True
        self.centre, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = (x - self.centre) / self.scale
        parts = [z[y == c] for c in (0, 1)]
        self.means = [p.mean(axis=0) for p in parts]
        scatter = [(p - m).T @ (p - m) for p, m in zip(parts, self.means, strict=True)]
        pooled = (scatter[0] + scatter[1]) / max(len(x) - 2, 1)
        self.factors, self.log_scales = [], []
        for s, n in zip(scatter, self.classes, strict=True):
            own = s / max(n - 1, 1)
            cov = (1 - to_pooled) * own + to_pooled * pooled
            cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + 1e-3 * np.eye(d)
            factor = np.linalg.cholesky(cov)
            self.factors.append(np.linalg.inv(factor))
            self.log_scales.append(float(np.log(np.diag(factor)).sum()))
        self.prior = float(np.log(self.classes[1] / self.classes[0]))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        if not self.known:
            return np.full(len(x), 0.5 if self.classes[0] == self.classes[1] else float(self.classes[1] > 0))
        z = (x - self.centre) / self.scale
        log = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - s for m, f, s in zip(self.means, self.factors, self.log_scales, strict=True)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0] + self.prior, -700, 700)))


def _features(batches):
    for batch in batches:
        for b in blocks(batch.column("text")):
            x = statistics(b)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.lo, b.rows), lists], names=["doc_id", "x"])


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, quality).

    Held out: crc32(doc_id as text) mod 3 is 1. Null and empty texts have statistics (zeros) and a score
    like all others; null ids are never held out nor learnt from. Repeated rows score alike. An id labelled both ways
    is not learnt from. Texts may have any length: a task holds one whole, with a few numbers for each word.
    Without learnable labels of both classes all scores are equal. Other columns are ignored. An empty table
    gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    table = store.written(slim.mapInArrow(_features, "doc_id long, x array<double>"), "quality-statistics")
    known = learnable(labels, label, in_fold(F.col("doc_id"), MODULUS, REMAINDER))
    rows = store.again(table).join(known, F.col("doc_id") == F.col("l_doc_id")).select("doc_id", "x", "y")
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_labelled).toArrow()
    x = np.array(sample["x"].to_pylist(), np.float64).reshape(-1, len(NAMES))
    model = docs.sparkSession.sparkContext.broadcast(Discriminant(x, sample["y"].to_numpy()))

    def score(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.scores(x))], names=["doc_id", "score"])

    scored = table.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", in_fold(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Query: quality of every row of ``documents``."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
