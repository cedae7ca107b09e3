"""Toxicity of documents.

Method: logistic regression by FTRL-proximal over hashed word n-grams and
skip-grams.  A text is lower-cased; its words are runs of letters, digits and
underscores.  Features are the distinct buckets of all single words, of the first
``STEMS`` letters of longer words (so that inflected forms share a weight), of
two neighbours, and of two words with one between them.

FTRL keeps two sums a bucket: of gradients (``z``) and of their squares (``n``).
The weight follows from them: 0 while ``|z|`` is at most ``L1``, so buckets that say
little never get one, and otherwise with a learning rate of its own bucket, which
falls with ``n``.  What is left is a few thousand weights, sent to every executor
behind a size check; scoring is a sparse sum, and texts never move.

Training reads a bounded sample of the labelled rows (``TOXIC_SAMPLE`` and
``OTHER_SAMPLE``); their features are made on the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from webgrain.llm.common import give_back, map_batches, ship, whole
from webgrain.session import materialized

BUCKETS = 1 << 20
STEMS = (4, 6, 8)
# Rows of each label that training reads at most, by smallest hash of their id.
TOXIC_SAMPLE = 4_000
OTHER_SAMPLE = 12_000
# FTRL-proximal.
ALPHA = 1.0
BETA = 1.0
L1 = 5.0
L2 = 1.0
EPOCHS = 3
SEED = 13
# All toxic examples together weigh this part of what the others weigh, and each of them at least 1.
TOXIC_WEIGHT = 0.3
HELD_OUT = 0

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """The fixed fifth of documents whose labels training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == HELD_OUT, F.lit(False))


# Features --------------------------------------------------------------------


def features(text: str) -> np.ndarray:
    """The distinct buckets of one text, ascending."""
    words = _WORD.findall(text.lower())
    code = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    stems = [xxh3_64_intdigest(w[:n], n) for w in set(words) for n in STEMS if len(w) > n]
    found = [code, np.array(stems, np.uint64)]
    for gap in (1, 2):
        pair = (code[:-gap] * np.uint64(0xD1B54A32D192ED03) + code[gap:] + np.uint64(gap)) * _MIX
        found.append(pair ^ (pair >> np.uint64(32)))
    mixed = np.concatenate(found) * _MIX
    return np.unique((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.uint32))


# Learning --------------------------------------------------------------------


@dataclass
class Model:
    buckets: np.ndarray  # those with a weight, ascending
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[self.buckets] = self.weights
        return out


class Ftrl:
    """The state of FTRL-proximal: the sums of each bucket, and those of the bias (not regularised)."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(BUCKETS), np.zeros(BUCKETS)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0
        return w

    def bias(self) -> float:
        return -self.bias_z * self.alpha / (self.beta + self.bias_n**0.5)

    def step(self, at: np.ndarray, label: int, weight: float) -> None:
        w, b = self.weights(at), self.bias()
        gap = (_sigmoid(float(w.sum()) + b) - label) * weight
        n = self.n[at]
        self.z[at] += gap - (np.sqrt(n + gap * gap) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + gap * gap
        self.bias_z += gap - ((self.bias_n + gap * gap) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += gap * gap

    def model(self) -> Model:
        w = self.weights(np.arange(BUCKETS))
        seen = np.flatnonzero(w)
        return Model(seen.astype(np.uint32), w[seen].astype(np.float32), self.bias())


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def fit(examples: list[tuple[np.ndarray, int]], *, epochs: int = EPOCHS, seed: int = SEED) -> Model | None:
    """Learn from (buckets, label) pairs; None without examples of both labels."""
    toxic = sum(label for _, label in examples)
    if not 0 < toxic < len(examples):
        return None
    weight = max(1.0, TOXIC_WEIGHT * (len(examples) - toxic) / toxic)
    state, order = Ftrl(), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, label = examples[i]
            state.step(at, label, weight if label else 1.0)
    return state.model()


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    toxic_sample: int = TOXIC_SAMPLE, other_sample: int = OTHER_SAMPLE,
) -> Model | None:
    """Learn from the rows of ``docs`` that ``labels`` names; None without both labels.

    Rows of ``labels`` without id or label do not count; an id is toxic if one of its rows says so.  A
    NULL text is empty.  Rows of ``docs`` that repeat an id are examples of their own, within the bound of the sample.
    """
    wanted = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(
        F.max((F.col(label_col) != 0).cast("int")).alias("_label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    sizes = {1: toxic_sample, 0: other_sample}
    some = [wanted.where(F.col("_label") == label).orderBy(*order).limit(size) for label, size in sizes.items()]
    # At most ``toxic_sample + other_sample`` short rows: bounded, whatever the tables hold.
    chosen = F.broadcast(some[0].unionByName(some[1]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [features(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["id", "label", "buckets"])

    given = docs.select(F.col(id_col).cast("long").alias("_id"), whole(F.col(text_col)).alias("_text")).join(chosen, "_id")
    made = materialized(
        map_batches(given.select("_id", "_label", "_text"), work, "id long, label int, buckets binary"), "toxic-examples")
    examples = []
    for label, size in sizes.items():
        top = made.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id", "buckets").limit(size).select("buckets")
        examples += [(np.frombuffer(b.as_py(), np.uint32), label) for b in top.toArrow().column(0)]
    return fit(examples)


# Scoring ---------------------------------------------------------------------


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score_col``, the probability that the text is toxic.

    NULL text is empty; a text without words gets the score of the bias alone, and
    without a model every score is 0.  A column of this name is replaced; other
    columns, NULL or repeated ids do not matter; an empty table gives an empty result.
    """
    state = model and (model.buckets, model.weights, model.bias)
    # Plain values only: workers need not have this package.
    shared = ship(docs.sparkSession, state, model.weights.nbytes + model.buckets.nbytes if model else 0)

    def work(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = Model(*shared.value).dense() if shared.value else None
        try:
            for texts in columns:
                scores = [0.0 if weights is None else _sigmoid(float(weights[features(t or "")].sum(dtype=np.float64)) + shared.value[2])
                          for t in texts.to_pylist()]
                yield pa.array(scores, pa.float64())
        finally:
            give_back()

    work.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(work, "double").asNondeterministic()(F.col(text_col).cast("string"))
    rows = docs.select(F.struct("*").alias("_row"), found.alias("_found"))
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns if c != score_col]
    return rows.select(*own, F.col("_found").alias(score_col))
