"""Rectangles as column expressions; a rectangle is a struct (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corners in order, whichever way they come."""
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def area(r: Column) -> Column:
    return F.greatest(r.x1 - r.x0, F.lit(0.0)) * F.greatest(r.y1 - r.y0, F.lit(0.0))


def intersection(a: Column, b: Column, margin: float = 0.0) -> Column:
    """Area that two rectangles share, each grown by ``margin``."""
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0) + 2 * margin
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0) + 2 * margin
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    total = area(a) + area(b) - both
    return F.when(total > 0, both / total).otherwise(0.0)


def contains(r: Column, x: Column, y: Column, slack: float = 0.0) -> Column:
    return (r.x0 - slack <= x) & (x <= r.x1 + slack) & (r.y0 - slack <= y) & (y <= r.y1 + slack)


def project(r: Column, source: Column, target: Column) -> Column:
    """Where ``r`` lies in ``target`` as it lies in ``source``."""
    sx = F.when(source.x1 > source.x0, (target.x1 - target.x0) / (source.x1 - source.x0)).otherwise(1.0)
    sy = F.when(source.y1 > source.y0, (target.y1 - target.y0) / (source.y1 - source.y0)).otherwise(1.0)
    return rect(target.x0 + (r.x0 - source.x0) * sx, target.y0 + (r.y0 - source.y0) * sy, target.x0 + (r.x1 - source.x0) * sx, target.y0 + (r.y1 - source.y0) * sy)


def alignment(x0: Column, x1: Column, left: Column, right: Column, slack: float = 4.0) -> Column:
    """justify, left, right, center or mixed, by the gaps to a box's edges."""
    near_left, near_right = F.abs(x0 - left) <= slack, F.abs(right - x1) <= slack
    return F.when(near_left & near_right, "justify").when(near_left, "left").when(near_right, "right").when(F.abs((x0 + x1) - (left + right)) <= 2 * slack, "center").otherwise("mixed")


def text_width(text: Column, size: float = 12.0, wide: float = 1.0, narrow: float = 0.5) -> Column:
    """Width by character class: East Asian characters are wide, others narrow, in shares of the size."""
    east = F.length(F.regexp_replace(text, "[^⺀-鿿가-힯＀-￯]", ""))
    return (east * wide + (F.length(text) - east) * narrow) * size


def fit(needed: Column, available: Column, most_push: float = 40.0, least_scale: float = 0.7) -> Column:
    """How a text that needs some height fits: fits, compress (to 90 %), push, shrink or expand."""
    return F.when(needed <= available, "fits").when(needed * 0.9 <= available, "compress").when(needed - available <= most_push, "push").when(needed * least_scale <= available, "shrink").otherwise("expand")
