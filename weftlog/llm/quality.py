"""Quality classifier: random-indexing word vectors pooled by document, a two-layer numpy network, calibrated scores.

Words are runs of letters, runs of digits, runs of other marks, and line breaks; a run of letters that is the one before it
again is the word REPEAT. Words are hashed to BUCKETS rows. A row has a sparse random index vector (a few +1 and -1); its
word vector is that and what its neighbours' index vectors add up to in the training texts, which is random indexing. A
document is the mean of its words' vectors, over its whole text, and nothing else: labels, lang, source and doc_id are no
inputs, and no counts of the text stand beside the vectors. A network with one hidden layer scores it, and a temperature
fitted on rows that it was not trained on makes the scores probabilities.

Training takes at most SAMPLE labelled rows, those with the smallest id hash: a bound on what is fitted, as a parameter.
Their texts become a table of their own; the driver gets their pooled vectors and, from each of TASKS tasks, one matrix of
fixed size; never texts. Sums of word vectors are of whole numbers, so they agree however rows are dealt. The model is
broadcast: its size is fixed.

Defined cases: null text is empty; empty texts get the score of a zero vector; rows without label or with unknown ids
are not learned from; of rows that share a labelled id the one with the least text is learned from; repeated rows get
equal scores; without both labels to learn from every score is the share of label 1 (0.5 without labels). Output columns
replace those of their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import append_columns, bound_batches, release, settle, utf8

BUCKETS, DIMENSIONS, NONZERO, NEIGHBOURS = 1 << 14, 128, 4, 2
SAMPLE, TASKS, HIDDEN, EPOCHS, SEED = 8000, 8, 32, 60, 7
#: Standard deviations from the mean up to which an input counts.
REACH = 4.0
#: The bucket of a word that is the word before it again.
REPEAT = 0


def index_vectors() -> np.ndarray:
    """A sparse ternary vector for each bucket."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIMENSIONS), np.int32)
    at = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.int32), (BUCKETS, NONZERO)), axis=1)
    return out


_POWERS = np.power(np.uint64(1_099_511_628_211), np.arange(64, dtype=np.uint64))
_INK = np.random.default_rng(SEED + 1).integers(1, 2**63, 256, dtype=np.uint64)
#: What each byte belongs to: 0 blanks, which part words; 1 letters, those of other scripts too; 2 digits; 3 marks; 4 line breaks.
_KIND = np.full(256, 3, np.uint8)
_KIND[[32, 9, 11, 12, 13]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[10] = 4


def buckets_of(raw: bytes) -> np.ndarray:
    """The bucket of each word of a text, in order."""
    data = np.frombuffer(raw, np.uint8)
    if not data.size:
        return np.empty(0, np.int64)
    kind = _KIND[data]
    start = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    lengths = np.diff(np.append(start, data.size))
    place = np.arange(data.size) - np.repeat(start, lengths)
    sums = np.add.reduceat(_INK[data] * _POWERS[place & 63], start) + lengths.astype(np.uint64)
    sums ^= sums >> np.uint64(29)
    sums *= np.uint64(0xBF58476D1CE4E5B9)
    out, kind = (sums >> np.uint64(64 - 14)).astype(np.int64), kind[start]
    letters = np.flatnonzero(kind == 1)
    out[letters[1:][sums[letters[1:]] == sums[letters[:-1]]]] = REPEAT
    return out[kind != 0]


def pooled(raw: bytes, vectors: np.ndarray) -> np.ndarray:
    """The mean of the vectors of a text's words."""
    words = buckets_of(raw)
    if not words.size:
        return np.zeros(DIMENSIONS, np.float32)
    ids, counts = np.unique(words, return_counts=True)
    return counts.astype(np.float32) @ vectors[ids] / np.float32(len(words))


@dataclass
class Network:
    """Two layers over standardised inputs; logits are divided by a temperature."""

    mean: np.ndarray
    spread: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Standardised inputs, no further out than REACH: what is learned does not say more of texts unlike all learned from."""
        return np.clip((x - self.mean) / self.spread, -REACH, REACH)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.scaled(x) @ self.first + self.first_bias) @ self.second + self.second_bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def constant(share: float) -> Network:
    n, p = DIMENSIONS, min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))), 1.0)


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam over four fifths of the rows; the temperature by least log loss over the rest."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(SEED)
    x, y = x.astype(np.float64), y.astype(np.float64)
    aside = rng.random(len(y)) < 0.2
    if aside.all() or not aside.any() or y[~aside].min() == y[~aside].max():
        aside = np.zeros(len(y), bool)
    net = constant(0.5)
    own, target = x[~aside], y[~aside]
    spread = own.std(0)
    net.mean, net.spread = own.mean(0), np.where(spread > 1e-6, spread, np.inf)  # an input that never varied says nothing
    net.first, net.first_bias = rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
    net.second, bias = rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)
    parts = [net.first, net.first_bias, net.second, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    scaled, t = net.scaled(own), 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(target)), max(1, len(target) // 64)):
            t += 1
            hidden = np.tanh(scaled[at] @ net.first + net.first_bias)
            off = (1 / (1 + np.exp(-np.clip(hidden @ net.second + bias, -40, 40))) - target[at]) / len(at)
            back = np.outer(off, net.second) * (1 - hidden**2)
            for p, (m, v), g in zip(parts, moments, (scaled[at].T @ back + 1e-4 * net.first, back.sum(0), hidden.T @ off + 1e-4 * net.second, np.array([off.sum()])), strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 3e-3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    net.second_bias = float(bias[0])
    if aside.any():
        logits = net.logits(x[aside])
        loss = lambda c: np.mean(np.logaddexp(0, -np.where(y[aside] > 0, 1, -1) * logits / c))
        net.temperature = float(min(np.geomspace(0.25, 16, 97), key=loss))
    return net


def _context(sample: DataFrame) -> np.ndarray:
    """Word vectors: index vectors and those of the neighbours in all texts of the sample."""

    def run(batches):
        index, total = index_vectors(), np.zeros((BUCKETS, DIMENSIONS), np.int32)
        for b in batches:
            for raw in utf8(b.column(0)):
                words = buckets_of(raw)
                for k in range(1, min(NEIGHBOURS, len(words) - 1) + 1):
                    pair, n = np.unique(np.concatenate((words[:-k] * BUCKETS + words[k:], words[k:] * BUCKETS + words[:-k])), return_counts=True)
                    np.add.at(total, pair // BUCKETS, index[pair % BUCKETS] * n[:, None].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((BUCKETS, DIMENSIONS), np.int64)
    for r in sample.select("_text").repartition(TASKS).mapInArrow(run, "sums binary").toLocalIterator():
        total += np.frombuffer(r["sums"], np.int32).reshape(BUCKETS, DIMENSIONS)
    size = np.maximum(1, np.linalg.norm(total, axis=1, keepdims=True))
    return (index_vectors() / NONZERO**0.5 + total / size).astype(np.float32)


def pooled_column(df: DataFrame, text_col: str, vectors: np.ndarray, score: Network | None = None) -> DataFrame:
    """df with the pooled vector as _pooled, or with score by a network."""
    shipped = df.sparkSession.sparkContext.broadcast((vectors, score))
    name, kind = ("_pooled", T.ArrayType(T.FloatType())) if score is None else ("score", T.DoubleType())

    def make():
        vectors, net = shipped.value

        def compute(batch):
            x = np.array([pooled(raw, vectors) for raw in utf8(batch.column(text_col))]).reshape(-1, DIMENSIONS)
            return [pa.array(list(x), pa.list_(pa.float32()))] if net is None else [pa.array(net.score(x))]

        return compute

    return append_columns(df, [T.StructField(name, kind)], make)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> tuple[np.ndarray, Network]:
    """Word vectors and network from the labelled rows given."""
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    rows = settle(rows.groupBy("_id", "_label").agg(F.min("_text").alias("_text")), "sample")
    vectors = _context(rows)
    got = sorted((r["_id"], r["_label"], tuple(r["_pooled"])) for r in pooled_column(rows, "_text", vectors).select("_id", "_label", "_pooled").toLocalIterator())
    release(rows)
    x = np.array([r[2] for r in got], np.float32).reshape(-1, DIMENSIONS)
    return vectors, train(x, np.array([r[1] for r in got]))


def score_quality(docs: DataFrame, model: tuple[np.ndarray, Network], text_col: str = "text") -> DataFrame:
    """docs with score: how likely label 1 is."""
    bound_batches(docs.sparkSession)
    return pooled_column(docs, text_col, *model)
