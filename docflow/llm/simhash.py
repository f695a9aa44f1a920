"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 r`` bits have a common point within
``r`` bits of both. Every distinct fingerprint therefore emits all its variants
within ``r`` bits, one shuffle brings equal variants together, and colliding
fingerprints are verified. Copies are merged before anything is emitted, and
the members of a variant's bucket are linked to the bucket's least member
instead of to each other, so no bucket makes a quadratic number of rows.

* :func:`fingerprints` - 64-bit SimHash of shingles, repeats included.
* :func:`near_components` - groups of fingerprints linked at 2 or fewer bits.
* :func:`similar_components` - groups of texts linked at a word-shingle
  similarity of 0.8 or more: candidates that the balls link, then, where
  fingerprints differ in too many bits for balls, candidates that share a band
  of least hashes, all verified whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut, drop_cut, forget
from .common import ascii_words, chunks, hash_words, mix, ngrams

SHINGLE_SEED = 42
WORDS_PER_SHINGLE = 3


def _votes(h: np.ndarray) -> np.ndarray:
    """For each of 64 bits, how many of the hashes have it set (low bit first)."""
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):  # blocks bound the unpacked bits to 4 MB
        part = np.ascontiguousarray(h[k : k + (1 << 16)], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def simhash(text: str | None, n: int = WORDS_PER_SHINGLE) -> int:
    """Unsigned 64-bit fingerprint; 0 for a null, empty or blank text."""
    return simhash_of_words(ascii_words(text), n)


def simhash_of_words(words: list[bytes], n: int = WORDS_PER_SHINGLE) -> int:
    """The fingerprint of a text by its words; 0 for none."""
    if not words:
        return 0
    n = min(n, len(words))
    whole = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1, out=starts[1:])
    first, last = starts[: len(words) - n + 1].tolist(), (starts[n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(whole[a:b], SHINGLE_SEED) for a, b in zip(first, last)), dtype=np.uint64, count=len(first))
    bits = (_votes(h) * 2 > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", n: int = WORDS_PER_SHINGLE, out: str = "fp") -> DataFrame:
    """``docs`` with the SimHash of the whole text as a signed 64-bit column ``out``.

    The text column is dropped unless read by name afterwards; null, empty and
    blank texts have fingerprint 0.
    """

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, n) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(out, of(F.col(text)))


def variants(value: Column, bits: int, radius: int = 1) -> Column:
    """Array of all values within ``radius`` bits of ``value`` (radius 0, 1 or 2)."""
    flips = [0]
    if radius >= 1:
        flips += [1 << k for k in range(bits)]
    if radius >= 2:
        flips += [(1 << k) | (1 << m) for k in range(bits) for m in range(k)]
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in flips]
    return F.transform(F.array(*map(F.lit, signed)), lambda f: f.bitwiseXOR(value))


def near_components(fps: DataFrame, id: str = "doc_id", fp: str = "fp", max_bits: int = 2) -> DataFrame:
    """Rows ``(fp, component_id)`` for every distinct fingerprint.

    Fingerprints link at ``max_bits`` (an even number up to 4) or fewer
    differing bits; ``component_id`` is the least id whose fingerprint is
    reachable. Rows with a null id are ignored. An empty table gives no rows.
    """
    distinct = cut(fps.where(F.col(id).isNotNull()).groupBy(F.col(fp).alias("fp")).agg(F.min(id).alias("rep")), "fps")
    parts = connected_components(ball_links(distinct, max_bits), "rep", "c_rep")
    return distinct.join(parts, distinct.rep == parts.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))


def ball_links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (rep, fp, c_rep, c_fp) that join the distinct fingerprints (rep, fp) which differ in ``max_bits`` or fewer bits."""
    links = bucket_links(distinct.select("rep", "fp", F.explode(variants(F.col("fp"), 64, max_bits // 2)).alias("key")), ["fp"])
    return links.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("c_fp"))) <= max_bits)


def bucket_links(emitted: DataFrame, carried: list[str]) -> DataFrame:
    """Links each row ``(key, rep, *carried)`` to the row of least ``rep`` with its key."""
    least = F.min(F.struct("rep", *carried)).over(_by_key())
    out = emitted.withColumn("least", least).where("least.rep <> rep")
    return out.select("rep", *carried, F.col("least.rep").alias("c_rep"), *(F.col(f"least.{c}").alias(f"c_{c}") for c in carried)).distinct()


def _by_key():
    from pyspark.sql import Window

    return Window.partitionBy("key")


def simhash_components(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(id, fingerprint, component_id)``, one for each row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits. Fingerprints link at 2 or fewer
    differing bits. Repeated rows give repeated rows; a null text counts as
    empty; a row with a null id keeps its fingerprint and gets the component of
    that fingerprint, if any row with an id has it.
    """
    fps = cut(fingerprints(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text").select("id", "fp"), "simhash")
    parts = near_components(fps, "id")
    return fps.join(parts, "fp", "left").select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- similarity

#: Words in a shingle, and the least share of common shingles, of a near copy.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands of a signature and least hashes in a band. A pair of similarity s shares a band with probability
#: 1 - (1 - s^ROWS)^BANDS, whatever the number of texts: 0.999 at 0.80.
BANDS, ROWS = 50, 9
#: Centres of a bucket in each round that holds its members against some of them (few first: what a round joins, the
#: next ones need not look at), and the members of a bucket whose
#: pairs are all looked at in the last round. So a row meets a fixed number of others, however large its bucket is.
CENTRES, SMALL = (1, 4, 4, 8), 16


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of ``n`` hash functions of 32 bits."""
    base = np.arange(1, n + 1, dtype=np.uint64)
    return (mix(base, 7) | np.uint64(1)).astype(np.uint32), mix(base, 8).astype(np.uint32)


def _short(h: np.ndarray) -> np.ndarray:
    """The upper 32 bits."""
    return (h >> np.uint64(32)).astype(np.uint32)


def least_hashes(words: np.ndarray, bounds: np.ndarray, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE) -> np.ndarray:
    """For each text, the least value of its ``n``-word shingles under ``bands * rows`` hash functions; texts must have words."""
    parts = [ngrams(words[a:b], n) for a, b in zip(bounds[:-1], bounds[1:])]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
    h = _short(np.concatenate(parts))
    out, each = np.empty((bands * rows, len(parts)), dtype=np.uint32), np.empty_like(h)
    for k, (a, b) in enumerate(zip(*_factors(bands * rows))):
        np.multiply(h, a, out=each)
        np.add(each, b, out=each)
        np.minimum.reduceat(each, first, out=out[k])
    return out.T


def band_keys(least: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each text."""
    grouped = least.reshape(len(least), bands, -1).astype(np.uint64)
    key = np.tile(np.arange(bands, dtype=np.uint64), (len(least), 1))
    with np.errstate(over="ignore"):
        for k in range(grouped.shape[2]):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, k], k)
    return key.view(np.int64)


def shingle_set(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, as sorted 32-bit hashes."""
    return np.unique(_short(ngrams(words, n)))


def jaccard(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """Share of the hashes of two sets that both have; 0 where the sizes alone keep it below ``least``."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return 0.0
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum()) if len(y) else 0
    return common / max(1, len(x) + len(y) - common)


def signatures(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(id, same, fp, keys)`` of the texts with words: a digest of the word sequence, its SimHash, and a key for each band."""

    @F.pandas_udf("struct<same:binary,fp:bigint,keys:array<bigint>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        same, fp, keys = [], [], []
        for _, part in chunks(texts):
            words = [ascii_words(t) for t in part]
            fp += [simhash_of_words(w) for w in words]
            same += [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in words]
            full = [t for t, w in zip(part, words) if w]
            found = iter(band_keys(least_hashes(*hash_words(full)))) if full else iter(())
            keys += [next(found) if w else None for w in words]
        return pd.DataFrame({"same": same, "fp": np.array(fp, dtype=np.uint64).view(np.int64), "keys": keys})

    return docs.select(F.col(id).alias("id"), of(F.col(text)).alias("s")).select("id", "s.same", "s.fp", "s.keys").where("same is not null")


def similar_components(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Rows ``(id, component)``, one for each text with words; ``component`` is the least id reachable.

    Near copies have ``similarity`` or more of their distinct five-word shingles
    in common (Jaccard, by 32-bit hashes). Equal word sequences are merged first.
    Then texts whose SimHashes are linked by balls, as in
    :func:`near_components`, are candidates, and after them texts that share a
    band of least hashes, for the near copies whose SimHashes differ in more
    bits. A candidate pair is verified on its whole shingle sets. Blank texts
    have no row. ``id`` must be unique and not null.

    Members of a bucket of bands that links do not join yet are held against
    centres of it: in the first round against the member of least id, in each
    further one against ``CENTRES`` others that a hash draws. In the last round,
    all pairs of the buckets of at most ``SMALL`` members are looked at. A text
    of one word or a very long one is a text like any other; an empty table
    gives no rows.
    """

    @F.pandas_udf("binary")
    def set_of(texts: pd.Series) -> pd.Series:
        out = []
        for _, part in chunks(texts):
            words, bounds = hash_words(part)
            out += [shingle_set(words[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        return pd.Series(out)

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similarity) >= similarity for x, y in zip(a, b)], dtype=bool)

    known = cut(signatures(docs, id, text), "words")
    heads = cut(known.groupBy("same").agg(F.min("id").alias("rep"), F.min("fp").alias("fp")), "heads")
    least = cut(heads.groupBy("fp").agg(F.min("rep").alias("rep")), "fps")
    alike = heads.join(least.withColumnRenamed("rep", "c_rep"), "fp").where("rep <> c_rep").select("rep", "c_rep")
    balls = cut(alike.unionByName(ball_links(least).select("rep", "c_rep")), "balls")
    emitted = known.join(heads.select(F.col("rep").alias("id")), "id", "left_semi").select(F.col("id").alias("rep"), F.explode("keys").alias("key"))
    shared = emitted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    waiting = cut(emitted.join(shared, "key").select("key", "rep", F.col("rep").alias("part"), "n"), "buckets")
    wanted = waiting.select("rep").union(balls.select("rep")).union(balls.select("c_rep")).distinct()
    sets = cut(docs.select(F.col(id).alias("rep"), F.col(text).alias("text")).join(wanted, "rep", "left_semi").select("rep", set_of("text").alias("set")), "sets")

    def links(pairs: DataFrame) -> DataFrame:
        """Of pairs (rep, part, c_rep, c_part), the parts (part, c_part) that near copies join."""
        own = pairs.distinct().join(sets, "rep")
        centre = sets.select(F.col("rep").alias("c_rep"), F.col("set").alias("c_set"))
        near = own.join(centre, "c_rep").where(verified("set", "c_set"))
        return near.select(F.greatest("part", "c_part").alias("part"), F.least("part", "c_part").alias("c_part")).distinct()

    def joined(pairs: DataFrame) -> DataFrame:
        """Rows (id, component) of the parts that near copies among the pairs join."""
        found = cut(links(pairs), "links")
        parts = cut(connected_components(found, "part", "c_part"), "parts")
        drop_cut(found)
        forget(docs.sparkSession)
        return parts

    steps = [joined(balls.select("rep", F.col("rep").alias("part"), "c_rep", F.col("c_rep").alias("c_part")))]
    drop_cut(balls)
    drop_cut(least)
    for turn, many in enumerate(CENTRES):
        # Labels move on to the joined parts; a bucket that one part fills is done.
        moved = waiting.join(steps[-1], waiting.part == steps[-1].id, "left").select("key", "rep", F.coalesce("component", "part").alias("part"), "n")
        moved = cut(moved, "moved")
        mixed = moved.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
        left = cut(moved.join(mixed, "key", "left_semi"), "mixed")
        drop_cut(moved)
        drop_cut(waiting)
        waiting = left
        if not waiting.take(1):
            break
        last = turn == len(CENTRES) - 1
        large = waiting.where(F.col("n") > SMALL) if last else waiting
        order = F.xxhash64("rep", F.lit(turn)) if turn else F.col("rep")
        salt = F.pmod(F.xxhash64("rep", F.lit(turn + 100)), F.lit(many))
        first = F.min(F.struct(order.alias("o"), "rep", "part"))
        centres = cut(large.groupBy("key", salt.alias("salt")).agg(first.alias("c")).select("key", F.col("c.rep").alias("c_rep"), F.col("c.part").alias("c_part")), "centres")
        pairs = large.join(centres, "key").where("part <> c_part").select("rep", "part", "c_rep", "c_part")
        if last:
            few = waiting.where(F.col("n") <= SMALL)
            other = few.select("key", F.col("rep").alias("c_rep"), F.col("part").alias("c_part"))
            pairs = pairs.unionByName(few.join(other, "key").where("c_rep < rep and part <> c_part").select("rep", "part", "c_rep", "c_part"))
        steps.append(joined(pairs))
        drop_cut(centres)
    drop_cut(waiting)
    drop_cut(sets)
    out = heads.withColumn("component", F.col("rep"))
    for step in steps:
        out = out.join(step.select(F.col("id").alias("component"), F.col("component").alias("_to")), "component", "left").select("same", F.coalesce("_to", "component").alias("component"))
    return known.select("id", "same").join(out.select("same", "component"), "same").select(F.col("id").alias(id), "component")
