"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of hashed words, word pairs and pairs that skip one
word. Every coordinate has its own learning rate, and the L1 term keeps the
weight of a feature at exactly zero until enough evidence has gathered, so the
fitted model is a short list of (feature, weight) that is broadcast for scoring.

The model is fitted on the driver from a bounded sample of labelled rows
(``max_rows`` rows of at most ``max_chars`` characters each, ``max_total`` in
all); every text is scored whole, wherever it lies and however long it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import forget
from .common import PUNCTUATION, chunks, hash_words, labelled_sample, mix

BITS = 21
#: Bounds of the fitting sample: rows, characters of a row that may be in it, and characters of all rows.
MAX_ROWS, MAX_CHARS, MAX_TOTAL = 12_000, 20_000, 32_000_000


def features(texts: list, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word, word pair and pair with one word between, repeats included."""
    h, bounds = hash_words(texts, PUNCTUATION, lower=True)
    of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * np.uint64(3) + mix(h[1:], 2), 2)
        skip = mix(h[:-2] * np.uint64(5) + mix(h[2:], 3), 3)
    near, far = of[:-1] == of[1:], of[:-2] == of[2:]
    text = np.concatenate([of, of[:-1][near], of[:-2][far]])
    return text, (np.concatenate([h, pair[near], skip[far]]) >> np.uint64(64 - bits)).astype(np.int64)


def presence(texts: list, bits: int = BITS) -> list[np.ndarray]:
    """Sorted distinct features of each text."""
    text, feature = features(texts, bits)
    both = np.unique((text << bits) | feature)
    return np.split((both & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(both, np.arange(1, len(texts)) << bits)) if len(texts) else []


@dataclass
class Model:
    """Non-zero weights by feature number, and the intercept."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS

    def table(self) -> np.ndarray:
        """Weight of every feature; 0 for most."""
        full = np.zeros(1 << self.bits, dtype=np.float32)
        full[self.index] = self.weight
        return full  # bounded: one number per feature

    def scores(self, texts: list, table: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each whole text; each feature counts once."""
        text, feature = features(texts, self.bits)
        used = table[feature] != 0
        both = np.unique((text[used] << self.bits) | feature[used])
        z = self.bias + np.bincount(both >> self.bits, table[both & ((1 << self.bits) - 1)], len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def ftrl(examples: list[np.ndarray], labels: list[int], bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, epochs: int = 6) -> Model:
    """Fit by per-coordinate FTRL-proximal, over the examples in a fixed shuffled order.

    A feature's weight is ``-(z - sign(z) l1) / ((beta + sqrt(n)) / alpha + l2)``
    where ``|z| > l1``, else 0; ``z`` gathers gradients, ``n`` their squares.
    Without an example of label 1 nothing is known to be toxic: the score is 0.02.
    """
    if 1 not in labels:
        return Model(np.empty(0, dtype=np.int64), np.empty(0), -4.0, bits)
    size = 1 << bits
    z, n = np.zeros(size, dtype=np.float64), np.zeros(size, dtype=np.float64)
    bias_z = bias_n = 0.0
    order = np.random.default_rng(7).permutation(len(examples))
    for _ in range(epochs):
        for k in order:
            f, y = examples[k], labels[k]
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(nf)) / alpha + l2))
            wb = -bias_z / ((beta + bias_n**0.5) / alpha)
            p = 1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, w.sum() + wb))))
            g = p - y
            step = (np.sqrt(nf + g * g) - np.sqrt(nf)) / alpha
            z[f] += g - step * w
            n[f] += g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / alpha * wb
            bias_n += g * g
    index = np.flatnonzero(np.abs(z) > l1)
    z, n = z[index], n[index]
    return Model(index, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), -bias_z / ((beta + bias_n**0.5) / alpha), bits)


def held_out(id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, max_total: int = MAX_TOTAL
) -> Model:
    """Fit on labelled rows that are not held out.

    The sample is that of :func:`.common.labelled_sample`; rows with a null
    label or id are left out. An id that has several labels counts as 1 if any of
    them is 1.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & ~held_out(F.col(id))).groupBy(F.col(id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    examples, answers = [], []
    for texts, values in labelled_sample(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), marked, "text", max_rows, max_chars, max_total):
        examples += [f for _, part in chunks(texts) for f in presence(part)]
        answers += values
    model = ftrl(examples, answers)
    del examples
    forget(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic; a null, empty or blank text gets the intercept's."""
    held = docs.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias, model.bits))

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        m = Model(*held.value)
        weights = m.table()
        return pd.Series([s for _, part in chunks(texts) for s in m.scores(part, weights)], dtype="float64")

    return docs.withColumn(out, of(F.col(text)))


def toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(id, held_out, score, predicted)``, one for each row of ``docs``.

    Repeated rows, null ids and null texts have rows like any other, an empty
    table has none. Columns of other names are not read.
    """
    scored = score(docs.select(id, text), fit(docs, labels, id, text), text)
    return scored.select(id, held_out(F.col(id)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
