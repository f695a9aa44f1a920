"""Helpers that the training-data operators share: hashed words of whole texts, by the block."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
#: Bytes hashed at once; longer texts are cut between words.
_BLOCK = 1 << 19

SPACES = bytes([32, *range(9, 14)])
PUNCTUATION = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))


def kept(name, make):
    """A value that a Python worker makes once and keeps for later tasks."""
    home = sys.modules.setdefault("_docflow_worker", types.ModuleType("_docflow_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser over an unsigned array."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((seed * 0x9E3779B97F4A7C15) & _MASK)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; a shorter sequence gives one hash of the whole, an empty one none."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : len(h) - n + 1 + k]
    return mix(out, n)


def _letters(separators: bytes) -> np.ndarray:
    """byte -> value, 0 for separators; A-Z have the value of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64), 99)
    values[65:91] = values[97:123]
    values[list(separators)] = 0
    return values


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _scale(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    full = kept("powers", lambda: (_powers(_P, 2 * _BLOCK), _powers(pow(_P, -1, 1 << 64), 2 * _BLOCK)))
    return full if size <= 2 * _BLOCK else (_powers(_P, size), _powers(pow(_P, -1, 1 << 64), size))


def hash_words(texts, separators: bytes = SPACES, lower: bool = False, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): an unsigned 64-bit hash per word of the texts, one text after another.

    ``bounds[k]:bounds[k + 1]`` are the words of text ``k``. Words lie between
    separator bytes and are compared with A-Z as a-z, or with ``lower`` in Unicode
    lower case. A word's hash does not
    depend on where it stands. A null text has no words. ``values``, if given, is
    what each byte counts as instead, 0 for separators.
    """
    values = values if values is not None else kept(f"letters{len(separators)}", lambda: _letters(separators))
    parts = [(t.lower() if lower else t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    text_ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    hashes, places, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + _BLOCK)
        v = values[data[at:stop]]
        if stop < len(data) and v[-1]:  # back to the last separator, or on to the next
            gaps = np.flatnonzero(v == 0)
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
                v = v[: stop - at]
            else:
                while v[-1]:
                    more = values[data[stop : stop + _BLOCK]]
                    gaps = np.flatnonzero(more == 0)
                    more = more[: gaps[0] + 1] if len(gaps) else more
                    v, stop = np.concatenate([v, more]), stop + len(more)
        word = v != 0
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.concatenate([[0], edge])
        first, last = edge[0::2], edge[1::2]
        up, down = _scale(len(v))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.add.accumulate(v * up[: len(v)])])
            h = (total[last] - total[first]) * down[first]
        hashes.append(mix(h, 1))
        places.append(first + at)
        at = stop
    h = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
    place = np.concatenate(places) if places else np.empty(0, dtype=np.int64)
    return h, np.concatenate([[0], np.searchsorted(place, text_ends)])


def chunks(texts, chars: int = 400_000):
    """Consecutive lists of texts with about ``chars`` characters each, the first index before each."""
    part, size, first = [], 0, 0
    for k, t in enumerate(texts):
        part.append(t)
        size += len(t) if t else 0
        if size >= chars:
            yield first, part
            part, size, first = [], 0, k + 1
    if part:
        yield first, part


def ascii_words(text) -> list[bytes]:
    """Lower-cased (A-Z only) words between the ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def labelled_sample(docs: DataFrame, marked: DataFrame, text: str, max_rows: int, max_chars: int, max_total: int):
    """Lists (texts, labels) of a bounded sample, by id; what a model is fitted on.

    ``docs`` has ``id`` and the text, ``marked`` has ``(id, label)``, a row per
    id. The sample has the ``max_rows`` ids of least hash, without those whose
    text is null or has over ``max_chars`` characters, and of these, in order of
    the hash, as many as have ``max_total`` characters in all. An id of several
    texts has the least of them, taken before anything is collected, so the
    driver never holds more than these bounds.
    """
    picked = marked.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select("id", F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    # max_rows rows of two numbers are broadcast, whatever the corpus.
    rows = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    rows = cut(rows.withColumn("hash", F.xxhash64("id")), "sample")
    total, last = 0, None
    for h, _, n in sorted(tuple(r) for r in rows.select("hash", "id", F.length("text")).collect()):
        total += n
        if total > max_total:
            break
        last = h
    if last is not None:
        found = rows.where(F.col("hash") <= last).select("id", "text", "label").toArrow().sort_by("id")
        for batch in found.to_batches(max_chunksize=500):
            yield batch.column("text").to_pylist(), batch.column("label").to_pylist()
        del found, batch
    drop_cut(rows)
    pa.default_memory_pool().release_unused()
