"""Differences of snapshots, graphs and corpora; similarity of token sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.blocks import without_dangling


def content_hash(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by ``|``; nulls count as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary")), 1, 16)


def snapshot_diff(before: DataFrame, after: DataFrame, id: str, hash: str) -> DataFrame:
    """Rows (id, change): added, removed or updated, by hash."""
    a, b = before.select(F.col(id), F.col(hash).alias("_a")), after.select(F.col(id), F.col(hash).alias("_b"))
    both = a.join(b, id, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "updated")
    return both.select(id, change.alias("change")).where("change is not null")


def field_diff(before: DataFrame, after: DataFrame, id: str, fields: list[str]) -> DataFrame:
    """Rows (id, path, before, after) of fields that differ among rows on both sides; numbers to 3 places."""
    kinds = dict(before.dtypes)
    text = lambda c: (F.round(F.col(c), 3) if kinds[c] in ("double", "float") else F.col(c)).cast("string")
    flat = lambda df, name: df.select(id, F.explode(F.array(*(F.struct(F.lit(c).alias("path"), text(c).alias("v")) for c in fields))).alias("f")).select(id, "f.path", F.col("f.v").alias(name))
    both = flat(before, "before").join(flat(after, "after"), [id, "path"])
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def graph_diff(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Rows (what, change, n): nodes by property hash and edges by (src, dst, relation)."""
    nodes = snapshot_diff(before[0], after[0], "id", "hash").select(F.lit("node").alias("what"), "change")
    key = ["src", "dst", "relation"]
    added = after[1].select(*key).distinct().join(before[1].select(*key), key, "left_anti").select(F.lit("edge").alias("what"), F.lit("added").alias("change"))
    gone = before[1].select(*key).distinct().join(after[1].select(*key), key, "left_anti").select(F.lit("edge").alias("what"), F.lit("removed").alias("change"))
    return nodes.unionByName(added).unionByName(gone).groupBy("what", "change").agg(F.count("*").alias("n"))


def merge_graphs(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union of nodes, the left one on a clash of ids, and of all edges whose ends are there."""
    extra = right[0].join(left[0].select("id"), "id", "left_anti")
    nodes = left[0].unionByName(extra.select(*left[0].columns))
    return nodes, without_dangling(left[1].unionByName(right[1].select(*left[1].columns)), nodes)


def subgraph(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of ``keep`` and the edges between them."""
    kept = nodes.join(keep.select("id").distinct(), "id", "left_semi")
    return kept, without_dangling(edges, kept)


def bucket_diff(before: DataFrame, after: DataFrame, key: list[str], n: str = "n") -> DataFrame:
    """Rows (key, before, after, status) of counts per bucket that differ or are on one side only."""
    both = before.select(*key, F.col(n).alias("before")).join(after.select(*key, F.col(n).alias("after")), key, "full_outer")
    status = F.when(F.col("before").isNull(), "missing_a").when(F.col("after").isNull(), "missing_b").when(F.col("before") != F.col("after"), "changed").otherwise("equal")
    return both.withColumn("status", status).where("status <> 'equal'")


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of the sets of lower-case words; 1 if both are empty."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[ \n\t]+"), lambda w: w != ""))
    x, y = words(a), words(b)
    n = F.size(x) + F.size(y)
    return F.when(n == 0, 1.0).otherwise(F.lit(2.0).cast("double") * F.size(F.array_intersect(x, y)) / n)


def missing_tokens(source: Column, target: Column, pattern: str) -> Column:
    """Sorted distinct matches of ``pattern`` in the source that the target lacks."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0)))
    return F.array_sort(F.array_except(found(source), found(target)))


def migration_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (total, matched, similarity, displacement) of two tables of blocks (id, text, x0, y0) by id."""
    both = a.alias("a").join(b.alias("b"), "id", "left")
    near = F.hypot(F.col("a.x0") - F.col("b.x0"), F.col("a.y0") - F.col("b.y0"))
    hit = F.col("b.text").isNotNull()
    return both.agg(
        F.count("*").alias("total"),
        F.count(F.when(hit, 1)).alias("matched"),
        F.round(F.avg(F.when(hit, dice(F.col("a.text"), F.col("b.text")))), 6).alias("similarity"),
        F.round(F.avg(F.when(hit, near)), 6).alias("displacement"),
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
