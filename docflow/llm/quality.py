"""Quality: ordinal cumulative-link regression on graded ratings.

One set of hashed-text weights gives every text a place on a line, and ordered
thresholds cut the line into grades: ``P(grade <= k) = sigmoid(t_k - w x)``. The
thresholds stay in order because they are a first one plus positive steps.
Features are the shares of hashed words, of word shapes (case, digits, marks),
and of repeated words, so that a text's length does not matter by itself.

The model is fitted on the driver from a bounded sample of rated rows
(``max_rows`` rows of at most ``max_chars`` characters, ``max_total`` in all);
every text is scored whole where it lies, however long. Selection uses the expected grade and the tail probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, chunks, hash_words, kept, labelled_sample, mix
from .toxicity import held_out

BITS = 18
MAX_ROWS, MAX_CHARS, MAX_TOTAL = 8_000, 20_000, 24_000_000


def _shapes() -> np.ndarray:
    """byte -> value by its class; marks keep their own."""
    kind = np.arange(1, 257, dtype=np.uint64)
    kind[97:123], kind[128:], kind[65:91], kind[48:58] = 300, 300, 301, 302
    values = mix(kind, 5)
    values[list(SPACES)] = 0
    return values


def features(texts: list, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct features, their values) of each text; a blank text has one feature of its own."""
    words, bounds = hash_words(texts)
    shapes, _ = hash_words(texts, values=kept("shapes", _shapes))
    out, mask = [], np.uint64((1 << bits) - 1)
    for a, b in zip(bounds[:-1], bounds[1:]):
        n = int(b - a)
        if not n:
            out.append((np.array([0]), np.array([1.0])))
            continue
        w, c = np.unique(words[a:b], return_counts=True)
        s, d = np.unique(shapes[a:b], return_counts=True)
        again = int(10 * (n - len(w)) / n)
        size = min(16, int(np.log2(n)))
        f = np.concatenate([mix(w, 11) & mask, mix(s, 12) & mask, mix(np.array([again, 100 + size], dtype=np.uint64), 13) & mask]).astype(np.int64)
        v = np.concatenate([np.sqrt(c / n), 2 * np.sqrt(d / n), [1.0, 1.0]])
        f, k = np.unique(f, return_inverse=True)
        out.append((f, np.bincount(k, v)))
    return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def below(self, texts: list) -> np.ndarray:
        """P(grade <= k) for each text and each k but the last."""
        line = np.array([float(self.weights[f] @ v) for f, v in features(texts, self.bits)])
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - line[:, None], -35, 35)))


def fit_ordinal(examples: list[tuple[np.ndarray, np.ndarray]], grades: list[int], n_grades: int, bits: int = BITS, rate: float = 0.3, l2: float = 1e-5, epochs: int = 8) -> Model:
    """Maximum likelihood by per-coordinate adaptive steps over a fixed shuffled order.

    Grades weigh equally however often each occurs. Without examples all grades
    are equally likely.
    """
    w, sw = np.zeros(1 << bits), np.full(1 << bits, 1e-6)
    cuts = n_grades - 1
    first, steps = float(np.log(1 / cuts)) if cuts > 1 else 0.0, np.zeros(max(0, cuts - 1))
    st = np.full(cuts, 1e-6)
    weight = len(grades) / np.maximum(1, np.bincount(grades, minlength=n_grades)) / n_grades if grades else None
    order = np.random.default_rng(11).permutation(len(examples))
    for _ in range(epochs):
        for k in order:
            (f, v), y = examples[k], grades[k]
            t = first + np.concatenate([[0.0], np.cumsum(np.exp(steps))])[:cuts]
            p = 1 / (1 + np.exp(-np.clip(t - w[f] @ v, -35, 35)))
            full = np.concatenate([[0.0], p, [1.0]])
            mass = max(1e-9, full[y + 1] - full[y])
            slope = np.concatenate([[0.0], p * (1 - p), [0.0]])
            # d loss / d line, and d loss / d each threshold
            g_line = weight[y] * (slope[y + 1] - slope[y]) / mass
            g_t = np.zeros(cuts)
            if y < cuts:
                g_t[y] -= weight[y] * slope[y + 1] / mass
            if y > 0:
                g_t[y - 1] += weight[y] * slope[y] / mass
            g = g_line * v + l2 * w[f]
            sw[f] += g * g
            w[f] -= rate * g / np.sqrt(sw[f])
            g_steps = np.concatenate([[g_t.sum()], np.cumsum(g_t[::-1])[::-1][1:] * np.exp(steps)])
            st += g_steps**2
            move = rate * g_steps / np.sqrt(st)
            first -= move[0]
            steps -= move[1:]
    return Model(w, first + np.concatenate([[0.0], np.cumsum(np.exp(steps))])[:cuts], bits)


def fit(
    docs: DataFrame, ratings: DataFrame, grade: Column, n_grades: int, id: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, max_total: int = MAX_TOTAL
) -> Model:
    """Fit on the rated ids that are not held out, by the sample of :func:`.common.labelled_sample`.

    ``grade`` is a whole number from 0; rows without one are left out of the
    sample. Of several ratings of an id the least counts.
    """
    rated = ratings.select(F.col(id).alias("id"), grade.cast("int").alias("label")).where(F.col("label").between(0, n_grades - 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    marked = rated.groupBy("id").agg(F.min("label").alias("label"))
    examples, grades = [], []
    for texts, values in labelled_sample(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), marked, "text", max_rows, max_chars, max_total):
        examples += [f for _, part in chunks(texts) for f in features(part)]
        grades += values
    return fit_ordinal(examples, grades, n_grades)


def score(docs: DataFrame, model: Model, text: str = "text", tail: int = 1) -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tail_probability``, P(grade >= ``tail``). A null text counts as empty."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.bits))

    @F.pandas_udf("struct<expected_grade:double,tail_probability:double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        m = Model(*held.value)
        parts = [m.below(part) for _, part in chunks(texts)]
        p = np.concatenate(parts) if parts else np.zeros((0, len(m.thresholds)))
        return pd.DataFrame({"expected_grade": (1 - p).sum(1), "tail_probability": 1 - p[:, tail - 1]})

    return docs.withColumn("_q", of(F.col(text))).withColumns({"expected_grade": F.col("_q.expected_grade"), "tail_probability": F.col("_q.tail_probability")}).drop("_q")


#: Grades of the labels table: its quality, 0 or 1. It has no finer ones; :func:`fit` takes any number of them.
GRADES = 2


def label_grade() -> Column:
    return F.col("quality").cast("int")


def quality_report(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, held_out, expected_grade, tail_probability, keep), one for each row of ``docs``.

    ``keep`` is 1 where a grade above the lowest is as likely as not. Null, empty
    and blank texts are graded as a text without words, very long ones whole;
    repeated rows give repeated rows, an empty table none.
    """
    scored = score(docs.select(id, text), fit(docs, labels, label_grade(), GRADES, id, text), text)
    return scored.select(id, held_out(F.col(id)).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).cast("int").alias("keep"))
