"""Weakly connected components of an edge table, fully distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import cut, drop_cut, forget


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows ``(id, component)``: the smallest id reachable over undirected edges.

    Alternates the large-star and small-star steps: each round every node hands
    its neighbours to its smallest neighbour, so the number of rounds grows with
    the logarithm of a component's size and no node's neighbours are ever
    gathered in one row. Every round is cut to the shared folder. Null ends and
    self loops are ignored; a node that only has self loops is not returned.

    >>> # edges (1,2), (2,3), (7,8) -> (1,1), (2,1), (3,1), (7,7), (8,7)
    """
    pairs = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    pairs, before = _cut(pairs, "edges")
    for _ in range(max_rounds):
        large = _star(pairs.union(pairs.select("b", "a")), large=True)
        small, now = _cut(_star(large, large=False), "stars")
        drop_cut(pairs)
        pairs = small
        forget(pairs.sparkSession)
        # Converged once no pair changed, from the edges on: those that are stars already take one round.
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def _cut(pairs: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The pairs, cut, with their count and order-free digest, taken while they are written."""
    seen, h = Observation(), F.xxhash64("a", "b")
    digest = F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s")
    out = cut(pairs.observe(seen, *digest), name)
    return out, tuple(seen.get[k] for k in "nxs")


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step on pairs (a, b), each neighbour of a node moves to the node's least neighbour."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = pairs.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
