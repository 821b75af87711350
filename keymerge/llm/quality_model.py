"""Quality classifier: hashed word n-grams, follow-the-regularised-leader, sparse dot products.

A text's features are its words, word pairs, word shapes, pairs of shapes, and
marks for a word that repeats the one before or lies in a repeated window,
each hashed into a fixed number of slots; a feature's value is its count over
the number of words.  The score is the logistic function of their dot product
with the weights.

Training takes a bounded sample of labelled rows: the ``TRAIN_ROWS`` labels
with the lowest hashed ids.  Shards of the sample are trained side by side
and their weights averaged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, prepare, tidied, unclashed, with_columns
from .quality_rules import repeat_words

#: Labelled rows used at most (the documented bound), and the shards they are trained in.
TRAIN_ROWS, SHARDS = 8192, 4
#: Slots of the hashed features (a power of two).
SLOT_BITS = 18
CACHE_WORDS = 200_000
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 1e-5, 1e-4, 10
#: Score from which a document counts as good.
THRESHOLD = 0.7

_ORDER = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - SLOT_BITS)
_SALT = {k: np.uint64(xxhash.xxh3_64_intdigest(k.encode())) for k in ("word", "pair", "shape", "shapes")}
_SAME, _AGAIN = (xxhash.xxh3_64_intdigest(k) >> (64 - SLOT_BITS) for k in (b"<same>", b"<again>"))
_RUNS = re.compile(rb"(.)\1+", re.S)
_SHAPE = bytes.maketrans(bytes(range(256)), bytes(
    65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256)))


def shape(word: bytes) -> bytes:
    """Letters, capitals, digits and marks, runs shortened: ``The,`` -> ``Aa,``."""
    return _RUNS.sub(rb"\1", word.translate(_SHAPE))


class Features:
    """Turns texts into hashed features; a word's hashes are kept while it is in use."""

    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.hash, self.shape = np.empty(1024, np.uint64), np.empty(1024, np.uint64)

    def _learn(self, words: list[bytes]) -> None:
        if len(self.at) > CACHE_WORDS:
            self._reset()
        for w in words:
            if w not in self.at:
                i = self.at[w] = len(self.at)
                if i == len(self.hash):
                    self.hash, self.shape = np.resize(self.hash, 2 * i), np.resize(self.shape, 2 * i)
                self.hash[i] = xxhash.xxh3_64_intdigest(w)
                self.shape[i] = xxhash.xxh3_64_intdigest(shape(w))

    def of(self, text: bytes) -> tuple[np.ndarray, int, int]:
        """Slots of a text's features (one entry per occurrence), its words, its words in repeated windows."""
        words = text.split()
        try:
            at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        except KeyError:
            self._learn(words)
            at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        h, s = self.hash[at], self.shape[at]
        with np.errstate(over="ignore"):
            parts = [_mix(h + _SALT["word"]), _mix(h[:-1] * _ORDER + h[1:] + _SALT["pair"]),
                     _mix(s + _SALT["shape"]), _mix(s[:-1] * _ORDER + s[1:] + _SALT["shapes"])]
        same = int((h[1:] == h[:-1]).sum())
        return np.concatenate([*parts, np.full(same, _SAME, np.int64)]), len(words), repeat_words(h)

    def sparse(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct slots and their values."""
        slots, n, again = self.of(text)
        if not n:
            return np.empty(0, np.int64), np.empty(0)
        at, count = np.unique(np.append(slots, np.full(again, _AGAIN, np.int64)), return_counts=True)
        return at, count / n


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> _SHIFT).astype(np.int64)


class Ftrl:
    """Follow-the-regularised-leader with a learning rate per slot, for the logistic loss.

    The last slot is the bias.  Weights are a function of the two sums kept per slot."""

    def __init__(self, slots: int):
        self.z, self.n = np.zeros(slots + 1), np.zeros(slots + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


@dataclass(frozen=True)
class Model:
    """Weights by slot, the bias last; ``None``: there was nothing to learn from."""

    weights: np.ndarray | None

    def score(self, features: Features, text: bytes) -> float:
        if self.weights is None:
            return 1.0
        slots, n, again = features.of(text)
        dot = self.weights[-1]
        if n:
            dot += (self.weights[slots].sum() + again * self.weights[_AGAIN]) / n
        return float(1 / (1 + np.exp(-np.clip(dot, -700, 700))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out part.

    Rows with a null id or label are no labels; of contradicting labels the lowest counts.
    Null and empty texts train the bias only.  Without any labelled document the model
    scores everything 1.0, so that nothing is rejected unjudged.
    """
    prepare(docs.sparkSession)
    sample = (pick(labels, doc_id=id_col, y=label_col).dropna().groupBy("doc_id").agg((F.min("y") > 0).cast("double").alias("y"))
              .filter(~held_out(F.col("doc_id"))).withColumn("place", F.xxhash64("doc_id"))
              .orderBy("place", "doc_id").limit(rows))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for b in batches:
            rows = [f.sparse(t or b"") for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
                ["place", "y", "at", "x"])

    def fit(group: pa.Table) -> pa.Table:
        model, bias = Ftrl(1 << SLOT_BITS), 1 << SLOT_BITS
        g = group.sort_by([("place", "ascending"), ("y", "ascending")])
        y = g.column("y").to_pylist()
        at = [np.append(np.asarray(a.values), bias) for a in g.column("at")]
        x = [np.append(np.asarray(a.values), 1.0) for a in g.column("x")]
        for _ in range(EPOCHS):
            for k in range(len(y)):
                model.update(at[k], x[k], y[k])
        w = model.weights()
        used = np.flatnonzero(w)
        return pa.table({"slot": used, "weight": w[used]})

    shard = F.pmod(F.xxhash64(F.lit("shard"), "place"), F.lit(SHARDS))
    fitted = (pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(sample), "doc_id").select("place", "y", "text")
              .mapInArrow(tidied(features), "place long, y double, at array<long>, x array<double>")
              .withColumn("shard", shard).groupBy("shard").applyInArrow(fit, "slot long, weight double")
              .groupBy("slot").agg(F.sum("weight").alias("weight")).toArrow())  # at most one row per slot
    if not fitted.num_rows:
        return Model(None)
    w = np.zeros((1 << SLOT_BITS) + 1)
    w[fitted.column("slot").to_numpy()] = fitted.column("weight").to_numpy() / SHARDS
    return Model(w)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row: the probability that the text is good.

    Null and empty texts get the bias' score; repeated rows each give a row; an empty table
    gives none; texts of any length are read whole; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, m = Features(), shared.value
        for b in batches:
            s = [m.score(f, t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(tidied(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Train on ``labels``, score ``docs``: ``doc_id, held_out, score, predicted``."""
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns as they are.

    Texts are read whole; a null or empty text has the score of the bias alone; rows with nulls in
    other columns and repeated rows are judged by their text like all others; other columns, also
    such with clashing names, pass through; an empty table gives no rows.
    """
    docs, restore = unclashed(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        f, m = Features(), shared.value
        return lambda texts: [pa.array([m.score(f, t) for t in texts], pa.float64())]

    return restore(with_columns(docs, text_col, "score double", make).filter(F.col("score") >= threshold))
