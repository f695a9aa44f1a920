"""Packing by cutting-stock column generation.

Every document is cut into full sequences and one rest, shorter than a
sequence. Only the rests need packing, and of these only how many there are of
each length matters: a linear program over patterns (sets of lengths that fit a
sequence) covers the histogram with the fewest sequences. New patterns come
from a knapsack dynamic program priced by the program's dual values. The
solution is rounded, what is left over is packed by best fit, and each pattern's
slots are then handed to the documents by their rank within their length. Where
the lengths at hand leave larger gaps, the emptiest sequences are taken apart
again and their rests are cut to fill the gaps of the others.

The histogram has at most ``size`` numbers and the slots at most some thousands
of ranges, whatever the corpus, so both may lie on the driver; ranks come from a
count per (length, bucket of ids), so no length gathers in one task.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import kept

SIZE = 1024
END = 0
#: Relative distance from the bound at which column generation ends, and its most rounds.
GAP, ROUNDS = 0.002, 200
#: Words that a worker remembers the ids of.
REMEMBERED = 120_000
#: Gaps below this stay padding: filling them would cut documents into crumbs.
SMALLEST_GAP = 32
#: Tokens of gap in a bucket of the join that lays cut rests over gaps.
STRETCH = 65_536

_ODD_SPACES = re.compile(r"\s (?:\s|$)")


def vocabulary() -> str:
    """Path of the public byte-level vocabulary that tokens are counted in."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, for the vocabulary at ``path``.

    The vocabulary splits a text before each single space, so words are encoded
    apart and remembered. Texts for which that is not so (spaces next to other
    white space, or the text of a special token) are encoded whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(re.sub(r"json$", "tiktoken", path), "rb"))}
        self.special = "<|endoftext|>"
        self.whole = tiktoken.Encoding("docflow", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={self.special: len(ranks)})
        self.words: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special in text or _ODD_SPACES.search(text):
            return np.array(self.whole.encode(text, allowed_special="all"), dtype="<u4").tobytes()
        parts = text.split(" ")
        out = [np.array(self.whole.encode_ordinary(parts[0]), dtype="<u4").tobytes()]
        known = self.words.get
        for w in parts[1:]:
            ids = known(w)
            out.append(self._learn(w) if ids is None else ids)
        return b"".join(out)

    def _learn(self, word: str) -> bytes:
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        ids = np.array(self.whole.encode_ordinary(" " + word), dtype="<u4").tobytes()
        if len(word) <= 64:
            self.words[word] = ids
        return ids


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, path: str | None = None) -> DataFrame:
    """Each text's ids, then id 0, cut into full sequences and a rest.

    Rows (id, start, length, ids_crc32, doc_tokens, ids); ``ids``, little-endian
    unsigned 32-bit, is there for rests only, which may be cut further.
    """
    path = path or vocabulary()

    def cut_up(batches):
        encoder = kept(f"encoder {path}", lambda: Encoder(path))
        for batch in batches:
            rows = []
            for key, t in zip(batch["id"], batch["text"]):
                data = encoder.encode(t) + b"\0\0\0\0"
                total = len(data) // 4
                for s in range(0, total, size):
                    part = data[4 * s : 4 * (s + size)]
                    rows.append((key, s, len(part) // 4, zlib.crc32(part), total, part if len(part) < 4 * size else None))
            keys, starts, lengths, crcs, totals, ids = zip(*rows) if rows else ((),) * 6
            keys = pd.array([None if pd.isna(k) else int(k) for k in keys], dtype="Int64")
            yield pd.DataFrame({"id": keys, "start": starts, "length": lengths, "ids_crc32": crcs, "doc_tokens": totals, "ids": ids})

    schema = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInPandas(cut_up, schema)


# ------------------------------------------------------------------ the plan


def knapsack(lengths: np.ndarray, values: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Best total value of lengths that fit ``size``, any number of each, and how many of each."""
    best = np.zeros(size + 1)
    took = np.full(size + 1, -1, dtype=np.int64)
    usable = np.flatnonzero(values > 1e-12)
    n, v = lengths[usable], values[usable]
    fit = np.searchsorted(n, np.arange(size + 1), side="right")
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        if fit[c]:
            total = v[: fit[c]] + best[c - n[: fit[c]]]
            k = int(total.argmax())
            if total[k] > best[c] + 1e-12:
                best[c], took[c] = total[k], k
    pattern, c = np.zeros(len(lengths), dtype=np.int64), size
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[usable[took[c]]] += 1
            c -= int(n[took[c]])
    return float(best[size]), pattern


def column_generation(lengths: np.ndarray, demand: np.ndarray, size: int, pool: list[np.ndarray], gap: float = GAP, rounds: int = ROUNDS) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns and how often each is used (fractions) to cover ``demand`` with few sequences.

    Revised simplex on the covering program; lengths ascend. It starts from
    patterns of one length each, takes in those of ``pool`` while their reduced
    cost improves it, and then the ones that the knapsack program finds. It ends
    within a relative ``gap`` of a lower bound (all tokens over ``size``, or
    ``demand . duals / best pattern value``), or after ``rounds`` new patterns.
    """
    m = len(lengths)
    singles = size // lengths
    patterns = [np.where(np.arange(m) == i, singles[i], 0) for i in range(m)]
    inverse, basis = np.diag(1.0 / singles), list(range(m))
    x, bound = demand / singles, float(lengths @ demand) / size
    columns = np.array(pool, dtype=np.float64).reshape(len(pool), m)
    new = 0
    while x.sum() > bound * (1 + gap):
        duals = inverse.sum(0)
        costs = columns @ duals
        k = int(costs.argmax()) if len(costs) else -1
        if k >= 0 and costs[k] > 1 + 1e-7:
            pattern = pool[k]
        else:
            value, pattern = knapsack(lengths, duals, size)
            bound = max(bound, float(demand @ duals) / max(value, 1.0))
            new += 1
            if value <= 1 + 1e-7 or new > rounds or x.sum() <= bound * (1 + gap):
                break
        direction = inverse @ pattern
        up = direction > 1e-9
        if not up.any():
            break
        ratios = np.where(up, x / np.where(up, direction, 1.0), np.inf)
        leave = int(ratios.argmin())
        step = max(0.0, ratios[leave])
        x = x - step * direction
        x[leave] = step
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
        basis[leave] = len(patterns)
        patterns.append(pattern)
    return [patterns[b] for b in basis], np.maximum(x, 0.0)


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple], list[tuple], int]:
    """(slots, gaps, sequences) for the rests.

    A slot is (length, first rank, end rank, first sequence, per sequence,
    offset): rank ``r`` lies in sequence ``first + (r - lo) // per`` at ``offset +
    (r - lo) % per * length``. With ``per`` 0 the ranks are cut over the gaps:
    rank ``r`` covers ``first + (r - lo) * length`` onward of all gap tokens in
    line. A gap is (place in that line, sequences, first sequence, offset, size).
    Ranks of a length count from 0 and are covered without holes.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), dtype=np.int64)
    if not len(lengths):
        return [], [], 0
    left = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    placed: list[tuple[np.ndarray, int]] = []
    pool = [p for p, _ in best_fit(lengths, left, size)]
    patterns, x = column_generation(lengths, left.astype(float), size, pool)
    for k in np.argsort(-x, kind="stable"):
        pattern, used = patterns[k], patterns[k] > 0
        times = min(int(x[k] + 0.5), int((left[used] // pattern[used]).min()))
        if times > 0:
            placed.append((pattern, times))
            left -= times * pattern
    placed += best_fit(lengths, left, size)
    keep, apart = _take_apart(lengths, placed, size)
    slots, gaps, sequence, place = [], [], 0, 0
    rank = np.zeros_like(left)
    for pattern, times in keep:
        offset = 0
        for i in np.flatnonzero(pattern)[::-1]:
            n, per = int(lengths[i]), int(pattern[i])
            slots.append((n, int(rank[i]), int(rank[i]) + times * per, sequence, per, offset))
            rank[i] += times * per
            offset += n * per
        if size - offset >= SMALLEST_GAP:
            gaps.append((place, times, sequence, offset, size - offset))
            place += times * (size - offset)
        sequence += times
    place = 0
    for i in np.flatnonzero(apart)[::-1]:
        n, many = int(lengths[i]), int(apart[i])
        slots.append((n, int(rank[i]), int(rank[i]) + many, place, 0, 0))
        place += n * many
    return slots, gaps, sequence


def _take_apart(lengths: np.ndarray, placed: list[tuple[np.ndarray, int]], size: int) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Patterns to keep, widest gap first, and how many rests of each length are cut over their gaps."""
    order = sorted(placed, key=lambda p: int(lengths @ p[0]))
    fill = [int(lengths @ p) for p, _ in order]
    room = [size - f if size - f >= SMALLEST_GAP else 0 for f in fill]
    free = sum(r * t for r, (_, t) in zip(room, order))
    apart, loose, keep = np.zeros(len(lengths), dtype=np.int64), 0, []
    for (pattern, times), f, r in zip(order, fill, room):
        # One more sequence apart needs f tokens of gap and takes its own r away.
        many = max(0, min(times, (free - loose) // (f + r)))
        if keep:
            many = 0
        apart += many * pattern
        loose += many * f
        free -= many * r
        if many < times:
            keep.append((pattern, times - many))
    return keep, apart


def best_fit(lengths: np.ndarray, left: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Patterns, and how often each, for all that is left: the longest with the set that fills its sequence best."""
    left, out = left.copy(), []
    while left.any():
        first = int(np.flatnonzero(left)[-1])
        left[first] -= 1
        pattern = fullest(lengths, left, size - int(lengths[first]))
        pattern[first] += 1
        left[first] += 1
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= times * pattern
        out.append((pattern, times))
    return out


def fullest(lengths: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """How many of each length, of those left, to fill ``room`` best (bounded subset sum by bit sets)."""
    chosen = np.zeros_like(left)
    items = [(i, min(int(left[i]), room // int(lengths[i]))) for i in np.flatnonzero((left > 0) & (lengths <= room))[::-1]]
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for i, many in items:
        take = 1
        while many > 0:
            take = min(take, many)
            now = reach | (reach << (take * int(lengths[i]))) & mask
            if now != reach:
                steps.append((i, take, reach))
                reach = now
            many -= take
            take *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for i, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[i] += take
            at -= take * int(lengths[i])
    return chosen


# ------------------------------------------------------------------- packing


def pack_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = SIZE, path: str | None = None) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece.

    Each id of each document lies in exactly one piece; the pieces of a sequence
    follow one another from offset 0. A null or empty text is its end token
    alone. Repeated rows are packed as often as they are there; ties in rank are
    broken by the pieces' own values, so equal pieces may swap places.
    """
    spark = docs.sparkSession
    made = cut(pieces(docs, id, text, size, path), "pieces")
    # Salt: about 50,000 pieces a bucket, whatever the length they share.
    buckets = int(made.count() // 50_000) + 1
    salted = made.withColumn("_b", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = cut(salted.groupBy("length", "_b").agg(F.count("*").alias("n")), "counts")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    n_full = totals.pop(size, 0)
    slots, gaps, _ = plan(totals, size)
    by_length: dict[int, list] = {size: [(0, n_full, 0, 1, 0)]}
    for n, lo, hi, first, per, offset in slots:
        by_length.setdefault(n, []).append((lo, hi, first + n_full if per else first, per, offset))
    # At most ``size`` rows: bounded, whatever the corpus.
    held = spark.createDataFrame(list(by_length.items()), "length bigint, slots array<struct<lo:bigint,hi:bigint,first:bigint,per:bigint,offset:bigint>>")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("length", "_b", before.alias("_first"))
    rank = F.row_number().over(Window.partitionBy("length", "_b").orderBy("id", "start", "doc_tokens", "ids_crc32")) - 1
    ranked = salted.drop("ids").withColumn("_r", rank).join(firsts, ["length", "_b"]).withColumn("_r", F.col("_r") + F.col("_first"))
    placed = ranked.join(F.broadcast(held), "length").withColumn("_s", F.filter("slots", lambda s: (s.lo <= F.col("_r")) & (F.col("_r") < s.hi))[0]).withColumn("_along", F.col("_r") - F.col("_s.lo"))
    whole = placed.where("_s.per > 0").select(
        "id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("_s.first") + F.floor(F.col("_along") / F.col("_s.per"))).cast("long").alias("sequence_id"),
        (F.col("_s.offset") + F.pmod(F.col("_along"), F.col("_s.per")) * F.col("length")).cast("long").alias("offset"),
    )
    if not gaps:
        return whole.withColumnRenamed("id", id)
    return whole.unionByName(_laid(placed, made, [(p, t, f + n_full, o, g) for p, t, f, o, g in gaps])).withColumnRenamed("id", id)


def _laid(placed: DataFrame, made: DataFrame, gaps: list[tuple]) -> DataFrame:
    """The rests that are cut over gaps, a row for each part."""
    # Equal rests differ in nothing, so any of them may take any place of theirs. A struct joins nulls too.
    key = F.struct("id", "start", "doc_tokens", "ids_crc32").alias("key")
    loose = placed.where("_s.per = 0").select(key, "length", (F.col("_s.first") + F.col("_along") * F.col("length")).alias("p"))
    wanted = loose.select("key").distinct()
    ids = made.where("ids is not null").select(key, "ids").join(wanted, "key", "left_semi").groupBy("key").agg(F.first("ids").alias("ids"))
    loose = loose.join(ids, "key").select("key.id", "key.start", "key.doc_tokens", "length", "p", "ids")
    space = placed.sparkSession.createDataFrame(gaps, "g bigint, times bigint, first bigint, offset bigint, size bigint")
    space = space.withColumn("w", F.explode(F.sequence(F.floor(F.col("g") / STRETCH), F.floor((F.col("g") + F.col("times") * F.col("size") - 1) / STRETCH))))
    loose = loose.withColumn("w", F.explode(F.sequence(F.floor(F.col("p") / STRETCH), F.floor((F.col("p") + F.col("length") - 1) / STRETCH))))
    both = loose.join(space, "w")
    lo = F.greatest(F.col("p"), F.col("g"), F.col("w") * STRETCH)
    hi = F.least(F.col("p") + F.col("length"), F.col("g") + F.col("times") * F.col("size"), (F.col("w") + 1) * STRETCH)
    both = both.withColumn("lo", lo).withColumn("hi", hi).where("lo < hi")
    both = both.withColumn("j", F.explode(F.sequence(F.floor((F.col("lo") - F.col("g")) / F.col("size")), F.floor((F.col("hi") - 1 - F.col("g")) / F.col("size")))))
    a = F.greatest(F.col("lo"), F.col("g") + F.col("j") * F.col("size"))
    b = F.least(F.col("hi"), F.col("g") + (F.col("j") + 1) * F.col("size"))
    both = both.withColumn("a", a).withColumn("b", b)
    cut_at, many = (F.col("a") - F.col("p")).cast("int"), (F.col("b") - F.col("a")).cast("int")
    return both.select(
        "id",
        (F.col("start") + F.col("a") - F.col("p")).alias("start"),
        many.cast("long").alias("length"),
        F.crc32(F.substring("ids", cut_at * 4 + 1, many * 4)).alias("ids_crc32"),
        "doc_tokens",
        (F.col("first") + F.col("j")).cast("long").alias("sequence_id"),
        (F.col("offset") + F.col("a") - F.col("g") - F.col("j") * F.col("size")).cast("long").alias("offset"),
    )
