"""Layout that folds over a page's rows in order, one page at a time."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def folded(df: DataFrame, by: str, order: list, columns: list[str], fold: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """``fold`` over the rows of each group in order, as named tuples of ``columns``.

    Groups are brought together by one shuffle and sort and then streamed through
    Arrow batches: a task holds one group at a time, and small groups cost no
    call of their own.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    rows = df.select(*columns).repartition(by).sortWithinPartitions(by, *order)

    def run(batches):
        key, held = None, []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name="Row"):
                own = getattr(row, by)
                own = None if pd.isna(own) else own
                if held and own != key:
                    out += fold(held)
                    held = []
                key = own
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(fold(held), columns=names)

    return rows.mapInPandas(run, schema)


def reading_order(boxes: DataFrame) -> DataFrame:
    """Rows (page, seq, position): XY-cut of boxes (page, seq, x0, y0, x1, y1), y down.

    A gap across the page cuts it into bands read from the top; a gap down a band
    cuts it into columns read from the left; what has neither is read by (y0, x0).
    """

    def gaps(rows, lo, hi):
        rows = sorted(rows, key=lambda r: (r[lo], r[hi], r[0]))
        parts, end = [[rows[0]]], rows[0][hi]
        for r in rows[1:]:
            if r[lo] > end:
                parts.append([])
            parts[-1].append(r)
            end = max(end, r[hi])
        return parts

    def cut(rows):
        stack, out = [rows], []
        while stack:
            part = stack.pop()
            for lo, hi in ((1, 3), (2, 4)):  # columns first, then bands
                pieces = gaps(part, lo, hi)
                if len(pieces) > 1:
                    stack += reversed(pieces)
                    break
            else:
                out += sorted(part, key=lambda r: (r[2], r[1], r[0]))
        return out

    def order(page: list) -> list[tuple]:
        return [(page[0].page, r[0], k) for k, r in enumerate(cut([tuple(r[1:]) for r in page]))]

    return folded(boxes, "page", ["seq"], ["page", "seq", "x0", "y0", "x1", "y1"], order, "page bigint, seq bigint, position int")


def words_from_chars(chars: DataFrame, gap: float = 0.45) -> DataFrame:
    """Rows (page, line, word, text, x0, x1) of characters (page, text, x0, y0, x1, size): rows by baseline, split at spaces and gaps."""

    def build(page: list) -> list[tuple]:
        lines: list[list] = []
        for c in sorted(page, key=lambda c: (-c.y0, c.x0)):
            home = next((line for line in lines if abs(line[0].y0 - c.y0) <= 0.5 * c.size), None)
            lines.append([c]) if home is None else home.append(c)
        out = []
        for n, line in enumerate(lines):
            word, last, k = [], None, 0
            for c in [*sorted(line, key=lambda c: c.x0), None]:
                ends = c is None or c.text.isspace() or (last is not None and c.x0 - last.x1 > gap * c.size)
                if ends and word:
                    out.append((page[0].page, n, k, "".join(w.text for w in word), word[0].x0, word[-1].x1))
                    word, k = [], k + 1
                if c is not None and not c.text.isspace():
                    word.append(c)
                last = c
        return out

    return folded(chars, "page", ["y0", "x0"], ["page", "text", "x0", "y0", "x1", "size"], build, "page bigint, line int, word int, text string, x0 double, x1 double")


def merge_fragments(blocks: DataFrame, gap: float = 18.0) -> DataFrame:
    """Rows (page, seq, text, y0, y1): blocks joined while the next begins within ``gap`` of the growing box."""

    def fold(page: list) -> list[tuple]:
        out: list[list] = []
        for r in page:
            if out and r.y0 - out[-1][4] <= gap:
                out[-1][2] += " " + r.text
                out[-1][4] = max(out[-1][4], r.y1)
            else:
                out.append([r.page, r.seq, r.text, r.y0, r.y1])
        return [tuple(r) for r in out]

    return folded(blocks, "page", ["y0", "seq"], ["page", "seq", "text", "y0", "y1"], fold, "page bigint, seq bigint, text string, y0 double, y1 double")


def resolve_collisions(boxes: DataFrame, gap: float = 2.0) -> DataFrame:
    """Rows (page, seq, y0, y1, moved): each box pushed down until it clears the boxes before it in its columns."""

    def push(page: list) -> list[tuple]:
        done, out = [], []
        for r in page:
            y, height = r.y0, r.y1 - r.y0
            for x0, x1, y0, y1 in sorted(done, key=lambda d: d[2]):
                if x0 < r.x1 and r.x0 < x1 and y < y1 + gap and y0 < y + height + gap:
                    y = y1 + gap
            done.append((r.x0, r.x1, y, y + height))
            out.append((r.page, r.seq, y, y + height, y - r.y0))
        return out

    return folded(boxes, "page", ["y0", "x0", "seq"], ["page", "seq", "x0", "y0", "x1", "y1"], push, "page bigint, seq bigint, y0 double, y1 double, moved double")


def solve_below(nodes: DataFrame, rounds: int = 120) -> DataFrame:
    """Rows (page, seq, y): positions that keep ``y[next] >= y + height + gap`` along the page's order, nearest to those wanted.

    ``nodes`` has (page, seq, y, height, gap). Constraints are projected in turn until none moves anything.
    """

    def solve(page: list) -> list[tuple]:
        y, h, g = [r.y for r in page], [r.height for r in page], [r.gap for r in page]
        for _ in range(rounds):
            moved = 0.0
            for k in range(len(y) - 1):
                short = y[k] + h[k] + g[k] - y[k + 1]
                if short > 1e-9:
                    y[k + 1] += short
                    moved += short
            if moved < 1e-9:
                break
        return [(r.page, r.seq, at) for r, at in zip(page, y)]

    return folded(nodes, "page", ["seq"], ["page", "seq", "y", "height", "gap"], solve, "page bigint, seq bigint, y double")
