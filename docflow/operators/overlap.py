"""Overlap of boxes and intervals, by range joins over cells instead of over all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cells(df: DataFrame, lo: str, hi: str, width: float) -> DataFrame:
    """A row per cell of ``width`` that [lo, hi] touches."""
    return df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))


def interval_pairs(df: DataFrame, by: list[str], seq: str, lo: str, hi: str, width: float) -> DataFrame:
    """Pairs (by, a, b, amount) of rows a before b (by ``seq``) of a group that overlap by more than 0.

    Rows meet by (group, cell); a pair is taken in the first cell that both touch.
    """
    cut = cells(df.select(*by, seq, lo, hi), lo, hi, width)
    a = cut.select(*by, "_cell", F.col(seq).alias("a"), F.col(lo).alias("alo"), F.col(hi).alias("ahi"))
    b = cut.select(*by, "_cell", F.col(seq).alias("b"), F.col(lo).alias("blo"), F.col(hi).alias("bhi"))
    amount = F.least("ahi", "bhi") - F.greatest("alo", "blo")
    both = a.join(b, [*by, "_cell"]).where((F.col("a") < F.col("b")) & (amount > 0))
    return both.where(F.col("_cell") == F.floor(F.greatest("alo", "blo") / width)).select(*by, "a", "b", amount.alias("amount"))


def severity(amount: Column, major: float, critical: float) -> Column:
    return F.when(amount > critical, "critical").when(amount > major, "major").otherwise("minor")


def box_pairs(boxes: DataFrame, by: list[str], width: float, margin: float = 0.0) -> DataFrame:
    """Pairs (by, a, b, dx, dy) of boxes (seq, x0, y0, x1, y1), a before b, that overlap by more than ``margin`` both ways."""
    cut = cells(boxes.select(*by, "seq", "x0", "y0", "x1", "y1"), "x0", "x1", width)
    a = cut.select(*by, "_cell", *(F.col(c).alias(f"a_{c}") for c in ("seq", "x0", "y0", "x1", "y1")))
    b = cut.select(*by, "_cell", *(F.col(c).alias(f"b_{c}") for c in ("seq", "x0", "y0", "x1", "y1")))
    dx = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    dy = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    both = a.join(b, [*by, "_cell"]).where((F.col("a_seq") < F.col("b_seq")) & (dx > margin) & (dy > margin))
    return both.where(F.col("_cell") == F.floor(F.greatest("a_x0", "b_x0") / width)).select(*by, F.col("a_seq").alias("a"), F.col("b_seq").alias("b"), dx.alias("dx"), dy.alias("dy"))


def overlap_rate(boxes: DataFrame, by: list[str], width: float) -> DataFrame:
    """One row (boxes, overlapping, rate): the share of boxes that overlap a later box of their group."""
    hit = box_pairs(boxes, by, width).select(*by, F.col("a").alias("seq")).distinct().withColumn("_hit", F.lit(1))
    marked = boxes.select(*by, "seq").join(hit, [*by, "seq"], "left")
    return marked.agg(F.count("*").alias("boxes"), F.count("_hit").alias("overlapping"), F.round(F.count("_hit") / F.greatest(F.count("*"), F.lit(1)), 6).alias("rate"))


def overflow_rate(boxes: DataFrame, width: float, height: float, margin: float = 0.02) -> DataFrame:
    """One row (boxes, outside, rate): boxes that leave the page by more than the margin."""
    mx, my = width * margin, height * margin
    out = (F.col("x0") < -mx) | (F.col("y0") < -my) | (F.col("x1") > width + mx) | (F.col("y1") > height + my)
    n = F.count(F.when(out, 1))
    return boxes.agg(F.count("*").alias("boxes"), n.alias("outside"), F.round(n / F.greatest(F.count("*"), F.lit(1)), 6).alias("rate"))
