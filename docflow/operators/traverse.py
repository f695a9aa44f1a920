"""Graph traversal by frontiers: each step is a join, and steps are cut to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut
from .components import connected_components

__all__ = ["closure", "connected_components", "cyclic_nodes", "leaves", "levels", "ready", "roots", "walk"]


def closure(edges: DataFrame, starts: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """Rows (id, depth): what ``starts`` (id) reach along edges (src, dst), with the fewest steps.

    Semi-naive: only what the last step found is joined again, and known nodes
    are dropped by an anti join, so cycles end. More than ``max_depth`` steps are
    an error, not a shorter answer.
    """
    edges = cut(edges.select("src", "dst").distinct(), "edges")
    seen = cut(starts.select("id").distinct().withColumn("depth", F.lit(0)), "closure")
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = edges.join(frontier, edges.src == frontier.id, "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:
            seen = cut(seen, "closure")
    else:
        raise RuntimeError(f"more than {max_depth} steps")
    return seen


def levels(nodes: DataFrame, edges: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """Rows (id, level): topological levels; nodes on or behind a cycle are left out.

    Each step counts, for the targets of the last level only, how many of their
    sources are placed; what has all of them is the next level. Nodes and edges
    are written once. More than ``max_depth`` levels are an error.
    """
    known = cut(nodes.select("id").distinct(), "nodes")
    edges = cut(edges.select("src", "dst").distinct().join(known.select(F.col("id").alias("dst")), "dst", "left_semi"), "edges")
    wanted = cut(edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")), "degrees")
    front = out = cut(known.join(wanted.select("id"), "id", "left_anti").withColumn("level", F.lit(0)), "level")
    partly = None
    for level in range(1, max_depth + 1):
        met = edges.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("met"))
        if partly is not None:
            met = met.unionByName(partly).groupBy("id").agg(F.sum("met").alias("met"))
        state = cut(met.join(wanted, "id"), "met")
        front, partly = state.where("met = n").select("id", F.lit(level).alias("level")), state.where("met < n").select("id", "met")
        if not front.take(1):
            return out
        out = out.unionByName(front)
        if level % 16 == 0:
            out = cut(out, "level")
    raise RuntimeError(f"more than {max_depth} levels")


def cyclic_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no topological order can place."""
    return nodes.select("id").distinct().join(levels(nodes, edges), "id", "left_anti")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge."""
    return nodes.select("id").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an outgoing edge."""
    return nodes.select("id").join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def ready(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Dirty nodes all of whose sources are clean; ``nodes`` has (id, dirty)."""
    blocked = edges.join(nodes.where("dirty").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    return nodes.where("dirty").join(blocked, "id", "left_anti").select("id")


def walk(edges: DataFrame, starts: DataFrame, max_depth: int = 1000) -> DataFrame:
    """Rows (id, path, depth) of a tree in pre-order: sort by ``path``, an array of (seq, id) from the top.

    ``edges`` has (src, dst, seq); ``seq`` orders children. A tree of more than
    ``max_depth`` levels, as any cycle is, is an error.
    """
    step = starts.select("id", F.array(F.struct(F.lit(0).cast("bigint").alias("seq"), F.col("id"))).alias("path"), F.lit(0).alias("depth"))
    out = step = cut(step, "walk")
    for depth in range(1, max_depth + 1):
        down = step.join(edges, step.id == edges.src).select(F.col("dst").alias("id"), F.concat("path", F.array(F.struct(F.col("seq").cast("bigint").alias("seq"), F.col("dst").alias("id")))).alias("path"), F.lit(depth).alias("depth"))
        step = cut(down, "walk")
        if not step.take(1):
            break
        out = out.unionByName(step)
        if depth % 16 == 0:
            out = cut(out, "walk")
    else:
        raise RuntimeError(f"more than {max_depth} levels")
    return out
