"""Toxicity: non-negative positive-unlabelled learning over words and word stems.

The learner sees confirmed toxic texts and unlabelled ones, never negatives. With class prior p the
risk of a classifier is p R+(toxic) + max(0, R-(unlabelled) - p R-(toxic)); where the second part
falls below zero the step goes against it, so the model can't call all that it has not seen toxic.
Features are presence of words (runs of letters, A-Z lower-cased) and of word beginnings with the
word's length. Of those that MIN_HOLDERS confirmed texts hold, all stay that toxic texts hold over twice
as often as unlabelled ones with MIN_EVIDENCE of log-likelihood ratio.

Unlabelled text is not sampled: how often it holds a feature is counted over all rows, and the risk runs over
all rows, grouped by which features they hold (most hold none, so there are few groups). A step's
gradient is a sum over these groups; up to LOCAL_GROUPS of them the driver makes it, beyond that Spark does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .labelled import in_fold, learnable
from .textkernel import Block, blocks, mix, row_sets

#: Confirmed toxic texts to fit on at most (those with the lowest hash of their id).
MAX_TOXIC = 5_000
#: Toxic texts that must hold a feature, and its least log-likelihood ratio against unlabelled texts.
MIN_HOLDERS, MIN_EVIDENCE = 3, 12.0
#: Groups of unlabelled rows up to which the driver sums a gradient; the sums are the same beyond.
LOCAL_GROUPS = 200_000
STEM = 6
MODULUS, REMAINDER = 5, 0
ROUNDS, RATE, RIDGE = 400, 0.05, 1e-3

_LETTER = np.full(256, 32, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def features(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of a block's rows, sorted by row, and their rows."""
    letters = Block(b.lo, b.hi, _LETTER[b.data], b.bounds)
    starts, ends = letters.words()
    row = letters.row_of(starts)
    words = letters.hashes(starts, ends)
    long = ends - starts >= STEM
    at = starts[long]
    stems = mix(letters.hashes(at, at + STEM) + (ends - starts)[long].astype(np.uint64))
    return row_sets(np.concatenate([words, stems]), np.concatenate([row, row[long]]))


def _places(b: Block, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in ``wanted`` (sorted hashes) of each wanted feature that a row holds."""
    values, rows = features(b)
    if not len(wanted):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    hit = wanted[at] == values
    return rows[hit], at[hit]


class Model:
    """Sorted feature hashes with weights, and a bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias

    def scores(self, b: Block) -> np.ndarray:
        log = np.full(b.rows, self.bias)
        if len(self.hashes):
            rows, at = _places(b, self.hashes)
            log += np.bincount(rows, weights=self.weights[at], minlength=b.rows)
        return 1 / (1 + np.exp(-np.clip(log, -700, 700)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Groups:
    """Texts as sparse rows: rows (ascending) and places of the features that they hold, and how many texts each row stands for."""

    def __init__(self, rows: np.ndarray, places: np.ndarray, counts: np.ndarray):
        self.rows, self.places, self.counts = rows, places, counts

    @classmethod
    def from_lists(cls, lists: pa.Array, counts: np.ndarray) -> Groups:
        lengths = lists.value_lengths().to_numpy()
        return cls(np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy(), counts)

    def margins(self, theta: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.rows, weights=theta[self.places], minlength=len(self.counts)) + bias

    def negative(self, theta: np.ndarray, bias: float) -> np.ndarray:
        """Sums over the texts: their loss as negatives, its gradient by feature, and by bias."""
        at = self.margins(theta, bias)
        pull = self.counts * _sigmoid(at)
        return np.r_[self.counts @ np.logaddexp(0, at), np.bincount(self.places, weights=pull[self.rows], minlength=len(theta)), pull.sum()]


def spread_negative(groups: DataFrame):
    """:meth:`Groups.negative` of a table (f, n), summed by Spark."""

    def sums(theta: np.ndarray, bias: float) -> np.ndarray:
        def run(batches):
            total = np.zeros(len(theta) + 2)
            for batch in batches:
                total += Groups.from_lists(batch.column("f"), batch.column("n").to_numpy()).negative(theta, bias)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "x"])

        out = np.zeros(len(theta) + 2)
        for r in store.again(groups).mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            out[r["at"]] = r.x
        return out

    return sums


def train(positive: Groups, negative, n_unlabelled: float, features: int, prior: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk (logistic loss, Adam, whole batches).

    ``negative``: (theta, bias) to the sums of :meth:`Groups.negative` over all ``n_unlabelled`` unlabelled texts.
    """
    theta, bias = np.zeros(features), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(features + 1), np.zeros(features + 1)
    n = positive.counts.sum()
    for t in range(1, rounds + 1):
        at = positive.margins(theta, bias)
        own = positive.negative(theta, bias) * prior / n
        pull = -prior * positive.counts * (1 - _sigmoid(at)) / n
        grad_plus = np.r_[np.bincount(positive.places, weights=pull[positive.rows], minlength=features), pull.sum()]
        rest = negative(theta, bias) / n_unlabelled - own
        g = grad_plus + rest[1:] if rest[0] >= 0 else -rest[1:]
        g[:-1] += RIDGE * prior * theta
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        theta, bias = theta - step[:-1], bias - float(step[-1])
    return theta, bias


def evidence(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """Log-likelihood ratio that a of n toxic and b of m unlabelled texts hold a feature at different rates."""
    rate = (a + b) / (n + m)

    def term(k, expected):
        return np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(expected, 1e-300)), 0.0)

    return 2 * (term(a, n * rate) + term(n - a, n * (1 - rate)) + term(b, m * rate) + term(m - b, m * (1 - rate)))


def _holders(texts: DataFrame, wanted) -> tuple[np.ndarray, int]:
    """How many of the texts hold each wanted feature, and how many texts there are; one pass."""

    def run(batches):
        counts, rows = np.zeros(len(wanted.value), np.int64), 0
        for batch in batches:
            for b in blocks(batch.column("text")):
                counts += np.bincount(_places(b, wanted.value)[1], minlength=len(counts))
                rows += b.rows
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[rows, counts[at]])], names=["at", "n"])

    out, rows = np.zeros(len(wanted.value), np.int64), 0
    for r in texts.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each wanted feature
        if r["at"] < 0:
            rows = r.n
        else:
            out[r["at"]] = r.n
    return out, rows


def _grouped(texts: DataFrame, wanted) -> DataFrame:
    """(f, n): the places of the wanted features that texts hold, and how many texts hold just these."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column("text")):
                rows, places = _places(b, wanted.value)
                cuts = np.searchsorted(rows, np.arange(b.rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cuts), pa.array(places.astype(np.int32)))], names=["f"])

    return texts.select("text").mapInArrow(run, "f array<int>").groupBy("f").agg(F.count("*").cast("double").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_toxic: int = MAX_TOXIC, rounds: int = ROUNDS, local_groups: int = LOCAL_GROUPS) -> Model:
    """The model of ``docs`` (doc_id, text) with confirmed toxic ids in ``labels``; held-out ids and their texts are not looked at.

    At most ``max_toxic`` confirmed texts are fitted on; every other row counts as unlabelled, confirmed ones too. The class
    prior is the share of toxic among learnable labels.
    """
    spark = docs.sparkSession
    held_out = in_fold(F.col("doc_id"), MODULUS, REMAINDER)
    known = store.written(learnable(labels, label, held_out), "toxic-labels")
    n_labels, n_toxic = known.agg(F.count("*"), F.count_if(F.col("y") == 1)).first()
    none = Model(np.empty(0, np.uint64), np.empty(0), float(np.log((n_toxic + 1) / (n_labels - n_toxic + 1))))
    if not n_toxic:
        return none
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & ~held_out)
    confirmed = store.again(known).where("y = 1").orderBy(F.xxhash64("l_doc_id"), "l_doc_id").limit(max_toxic).select("l_doc_id")
    toxic = store.written(slim.join(F.broadcast(confirmed), F.col("doc_id") == F.col("l_doc_id"), "left_semi"), "toxic-texts")  # ids: max_toxic at most

    def hashes(batches):
        for batch in batches:
            for b in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(features(b)[0].view(np.int64))], names=["h"])

    often = toxic.select("text").mapInArrow(hashes, "h long").groupBy("h").count().where(F.col("count") >= MIN_HOLDERS).select("h")
    candidates = np.sort(often.toArrow()["h"].to_numpy().view(np.uint64))  # words of max_toxic texts
    wanted = spark.sparkContext.broadcast(candidates)
    (a, n), (b, m) = _holders(store.again(toxic), wanted), _holders(slim, wanted)
    if not n or not m:
        return none
    chosen = candidates[(a / n > 2 * b / m) & (evidence(a, b, n, m) >= MIN_EVIDENCE)]
    if not len(chosen):
        return none
    wanted = spark.sparkContext.broadcast(chosen)
    groups = store.written(_grouped(slim, wanted), "unlabelled-groups")
    sides = _grouped(store.again(toxic), wanted).orderBy("f").toArrow()
    positive = Groups.from_lists(sides["f"].combine_chunks(), sides["n"].to_numpy())
    if groups.count() <= local_groups:
        rest = store.again(groups).orderBy("f").toArrow()
        negative = Groups.from_lists(rest["f"].combine_chunks(), rest["n"].to_numpy()).negative
    else:
        negative = spread_negative(groups)
    prior = float(np.clip(n_toxic / n_labels, 1e-4, 0.5))
    return Model(chosen, *train(positive, negative, m, len(chosen), prior, rounds))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, toxic).

    Held out: crc32(doc_id as text) mod 5 is 0. Null and empty texts score as texts without any telling
    word; null ids are never held out nor learnt from. Repeated rows score alike, and each counts as a text. An id labelled
    both ways is not learnt from. Texts may have any length: a task holds one whole, with a few numbers for each word.
    Without confirmed toxic texts every score is the prior. Other columns are ignored. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, **bounds))

    def score(batches):
        for batch in batches:
            for b in blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.lo, b.rows), pa.array(model.value.scores(b))], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = slim.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", in_fold(F.col("doc_id"), MODULUS, REMAINDER).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Query: toxicity of every row of ``documents``."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
