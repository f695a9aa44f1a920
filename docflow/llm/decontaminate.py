"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A passage matches a test item if their words align with a similarity of 0.8 or
more. An item of ``m`` words may then have at most ``0.2 m`` edits, so of any
``0.2 m + 2`` disjoint n-grams of the item one is untouched: that many seeds
miss no match, whichever are taken, and the ones taken are those that the
fewest documents hold. Seed hits are joined to their items, and each stretch of
the document around them is aligned with the item.

Word order matters here, and n follows from the item's length (five at most). An
item of fewer than ``MIN_WORDS`` words is in no way telling inside a text: it
matches the texts that consist of its words and of nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PUNCTUATION, chunks, hash_words, ngrams

SIMILARITY = 0.8
#: Words of test items that one pass over the documents looks for (some 100 MB on the driver, 40 MB broadcast).
BLOCK_WORDS = 2_000_000
#: Items of fewer words match whole texts only.
MIN_WORDS = 5
#: Seeds that are chosen together: longer items are cut into stretches of so many.
STRETCH = 200
MATCH, MISMATCH, EXTRA, MISSING = 1, -1, -2, -1

FOUND = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.IntegerType()), T.StructField("end_word", T.IntegerType())])
)


def word_hashes(text: str | None) -> np.ndarray:
    """One unsigned 64-bit hash per word: runs of letters, digits and non-ASCII characters, in lower case."""
    return hash_words([text], PUNCTUATION, lower=True)[0]


def seed_plan(m: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(n, number of disjoint n-grams) for an item of ``m`` words."""
    edits = int((1 - similarity) * m + 1e-9)
    seeds = min(m, edits + (2 if m >= 15 else 1))
    return max(1, min(5, m // seeds)), seeds


def rarest(df: np.ndarray, n: int, seeds: int) -> list[int]:
    """Starts of ``seeds`` disjoint n-grams with the least document frequencies in all.

    An item of more than ``STRETCH`` seeds is cut into stretches that hold
    ``STRETCH`` each, and the least are taken in each, so that memory and time
    grow with the item's length only.
    """
    m, out = len(df) + n - 1, []
    for first in range(0, seeds, STRETCH):
        many = min(STRETCH, seeds - first)
        lo, hi = -(-first * m // seeds), -(-(first + many) * m // seeds)
        out += [lo + x for x in _least_disjoint(df[lo : hi - n + 1], n, many)]
    return out


def _least_disjoint(df: np.ndarray, n: int, seeds: int) -> list[int]:
    m = len(df) + n - 1
    best = np.zeros(m + 1)
    took = np.zeros((seeds + 1, m + 1), dtype=bool)
    for k in range(1, seeds + 1):
        now = np.full(m + 1, np.inf)
        use = best[: m + 1 - n] + df
        now[n:] = np.minimum.accumulate(use)
        took[k, n:] = use < now[n - 1 : -1]
        best = now
    out, end = [], m
    for k in range(seeds, 0, -1):
        while not took[k, end]:
            end -= 1
        end -= n
        out.append(end)
    return out[::-1]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score and the end (exclusive) of its stretch of ``words``."""
    steps = np.arange(len(words) + 1) * -EXTRA
    row = np.zeros(len(words) + 1, dtype=np.int64)
    best, end = 0, 0
    for w in item:
        now = np.maximum(row + MISSING, 0)
        now[1:] = np.maximum(now[1:], row[:-1] + np.where(words == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(now + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


Wanted = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Seeds:
    """For each n, the sorted n-gram hashes, and for each of them the items and places it comes from.

    ``by_n[n]`` is (hashes, first posting of each, items, places, a table of the
    hashes' top bits by which most words are ruled out). ``short`` has the items
    of few words by the hash of the whole.
    """

    items: list[np.ndarray]
    ids: list
    by_n: dict[int, tuple] = field(default_factory=dict)
    short: dict[int, list[int]] = field(default_factory=dict)

    @classmethod
    def build(cls, items: list, ids: list, wanted: Wanted) -> Seeds:
        out = cls(items, ids)
        for n, (item, place, h) in wanted.items():
            order = np.argsort(h, kind="stable")
            hashes, first = np.unique(h[order], return_index=True)
            near = np.zeros(1 << 20, dtype=bool)
            near[(hashes >> np.uint64(44)).astype(np.int64)] = True
            out.by_n[n] = (hashes, np.append(first, len(h)), item[order], place[order], near)
        for k, words in enumerate(items):
            if len(words) < MIN_WORDS:
                out.short.setdefault(int(ngrams(words, MIN_WORDS)[0]), []).append(k)
        return out

    def plain(self) -> tuple:
        """What is broadcast: no class of this package, so that plain pickling can read it."""
        return self.items, self.ids, self.by_n, self.short

    def hits(self, words: np.ndarray, bounds: np.ndarray):
        """Arrays for each n: (n, text, place among all words, seed number) of every seed in the texts."""
        for n, (h, _, _, _, near) in self.by_n.items():
            if len(words) < n:
                continue
            g = ngrams(words, n)
            at = np.flatnonzero(near[(g >> np.uint64(44)).astype(np.int64)])
            k = np.searchsorted(h, g[at])
            k[k == len(h)] = 0
            same = h[k] == g[at]
            at, k = at[same], k[same]
            of = np.searchsorted(bounds, at, side="right") - 1
            inside = at + n <= bounds[of + 1]
            yield n, of[inside], at[inside], k[inside]

    def matches(self, texts: list, similarity: float) -> list[list[tuple]]:
        """For each text, (item id, similarity, first word, end) of each item's best stretch of it."""
        words, bounds = hash_words(texts, PUNCTUATION, lower=True)
        out: list[list[tuple]] = [[] for _ in texts]
        if self.short:
            for t in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < MIN_WORDS)).tolist():
                own = words[bounds[t] : bounds[t + 1]]
                for k in self.short.get(int(ngrams(own, MIN_WORDS)[0]), []):
                    if np.array_equal(own, self.items[k]):
                        out[t].append((self.ids[k], 1.0, 0, len(own)))
        found = []
        for n, of, at, seed in self.hits(words, bounds):
            _, first, items, places, _ = self.by_n[n]
            many = first[seed + 1] - first[seed]
            hit = np.repeat(np.arange(len(seed)), many)
            post = np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many) + first[seed][hit]
            found.append(np.stack([of[hit], items[post], (at - bounds[of])[hit] - places[post]]))
        if found and sum(f.shape[1] for f in found):
            starts = np.unique(np.concatenate(found, axis=1), axis=1)
            edge = np.flatnonzero((np.diff(starts[0]) != 0) | (np.diff(starts[1]) != 0)) + 1
            for group in np.split(starts, edge, axis=1):
                t, k = int(group[0, 0]), int(group[1, 0])
                best = self._best(self.items[k], words[bounds[t] : bounds[t + 1]], group[2].tolist())
                value = (best[0] / len(self.items[k]) + 1) / 2
                if value >= similarity - 1e-9:
                    out[t].append((self.ids[k], round(value, 6), *best[1:]))
        return [sorted(x, key=lambda m: (m[0] is None, m[0] or 0, *m[1:])) for x in out]

    def _best(self, item: np.ndarray, words: np.ndarray, places: list[int]) -> tuple[int, int, int]:
        """(score, first word, end) of the best alignment near the places where the item may start."""
        m, best = len(item), (-1, 0, 0)
        first = last = places[0]
        for x in [*places[1:], None]:
            if x is not None and x - last <= m:
                last = x
                continue
            lo, hi = max(0, first - m), min(len(words), last + 2 * m)
            score, end = align(item, words[lo:hi])
            if score > best[0]:
                back = align(item[::-1], words[lo : lo + end][::-1])[1]
                best = (score, lo + end - back, lo + end)
            first = last = x
        return best


def _frequencies(docs: DataFrame, text: str, seeds: Seeds) -> dict[int, np.ndarray]:
    """For each n, in how many rows each n-gram of the test items stands; as many numbers as the items have words."""
    held = docs.sparkSession.sparkContext.broadcast(seeds.plain())

    def count(batches):
        found = Seeds(*held.value)
        total = {n: np.zeros(len(x[0]), dtype=np.int64) for n, x in found.by_n.items()}
        for batch in batches:
            for _, texts in chunks(batch["text"]):
                for n, of, _, seed in found.hits(*hash_words(texts, PUNCTUATION, lower=True)):
                    once = np.unique(np.stack([of, seed]), axis=1)[1]
                    total[n] += np.bincount(once, minlength=len(total[n]))
        for n, counts in total.items():
            seen = np.flatnonzero(counts)
            yield pd.DataFrame({"n": n, "seed": seen, "docs": counts[seen]})

    rows = docs.select(F.col(text).alias("text")).mapInPandas(count, "n int, seed int, docs bigint").groupBy("n", "seed").agg(F.sum("docs").alias("docs")).toArrow()
    out = {n: np.zeros(len(x[0])) for n, x in seeds.by_n.items()}
    n, seed, many = (rows.column(c).to_numpy() for c in ("n", "seed", "docs"))
    for k in out:
        out[k][seed[n == k]] = many[n == k]
    return out


def seeds_for(docs: DataFrame, rows: list, text: str = "text", similarity: float = SIMILARITY) -> Seeds:
    """The rarest seeds of the test items ``rows`` (id, text), by document frequency over all of ``docs``."""
    kept_rows = sorted((r for r in rows if len(word_hashes(r[1]))), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    items, ids = [word_hashes(r[1]) for r in kept_rows], [r[0] for r in kept_rows]
    long = [(k, *seed_plan(len(w), similarity)) for k, w in enumerate(items) if len(w) >= MIN_WORDS]

    def gathered(starts) -> Wanted:
        """Postings for each n of the n-grams at ``starts(item, n, seeds, n-grams)``."""
        parts: dict[int, list] = {}
        for k, n, many in long:
            g = ngrams(items[k], n)
            at = starts(n, many, g)
            parts.setdefault(n, []).append((np.full(len(at), k, dtype=np.int32), at.astype(np.int32), g[at]))
        return {n: tuple(map(np.concatenate, zip(*p))) for n, p in parts.items()}

    every = Seeds.build(items, ids, gathered(lambda n, many, g: np.arange(len(g))))
    df = _frequencies(docs, text, every) if long else {}
    frequency = lambda n, g: df[n][np.searchsorted(every.by_n[n][0], g)]
    return Seeds.build(items, ids, gathered(lambda n, many, g: np.array(rarest(frequency(n, g), n, many))))


def _matcher(docs: DataFrame, seeds: Seeds, similarity: float):
    held = docs.sparkSession.sparkContext.broadcast(seeds.plain())

    @F.pandas_udf(FOUND)
    def of(texts: pd.Series) -> pd.Series:
        found = Seeds(*held.value)
        return pd.Series([m for _, part in chunks(texts) for m in found.matches(part, similarity)])

    return of


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, out: str = "matches") -> DataFrame:
    """``docs`` with an array of the test items that each whole text holds.

    Each entry has the item's id, the similarity ``(score / words + 1) / 2`` of
    its best alignment (1: every word in order, 0.8: one edit in five words), and
    the stretch of words. Null, empty and blank texts and items match nothing.
    Test items are taken in blocks of about ``BLOCK_WORDS`` words, so what is
    broadcast is bounded whatever the size of the benchmark; an item with a null
    id is an item like any other.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    # A word has a separator after it, so half the characters bound the words.
    size = items.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0] // 2
    blocks = int(size // BLOCK_WORDS) + 1
    columns = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
        columns.append(_matcher(docs, seeds_for(docs, [tuple(r) for r in rows], text, similarity), similarity)(F.col(text)))
    return docs.withColumn(out, columns[0] if blocks == 1 else F.concat(*columns))


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(id, item_id, similarity, start_word, end_word)``, one for each text and test item that match."""
    return with_matches(docs.select(id, text), benchmark, text).select(id, F.explode("matches").alias("m")).select(id, "m.*")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that match a test item; columns as before, whatever their names."""
    row = docs.select(F.struct("*").alias("row"), docs[text].alias("text"))
    return with_matches(row, benchmark).where(F.size("matches") == 0).select("row.*")
