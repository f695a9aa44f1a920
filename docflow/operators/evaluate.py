"""Evaluation of a translated document against its source: drift, order, coverage and four families of scores."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import preservation
from .layout import folded

# Weights of the parts of a score, lines of a full page, and what a violation costs.
STRUCTURE = {"headings": 0.35, "captions": 0.2, "toc_entries": 0.15, "formulas": 0.1}
ORDER_WEIGHT = 0.2
TRANSLATION = (0.5, 0.3, 0.2)
RENDERING = (0.4, 0.25, 0.2, 0.15)
OVERALL = (0.3, 0.2, 0.25, 0.25)
IDEAL_LINES, MOST_COVERAGE = 40.0, 1.5
TERM_COST, NAME_COST = 0.1, 0.05
LEAST_EDGES = 0.3


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def drift(source: DataFrame, target: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows (by, pairs, mean_dx, mean_dy, mean_drift) of blocks (x0, y0) of both sides, paired by their place in a group."""
    place = Window.partitionBy(*by).orderBy(*order)
    side = lambda d, s: d.select(*by, F.row_number().over(place).alias("_k"), F.col("x0").alias(f"{s}x"), F.col("y0").alias(f"{s}y"))
    both = side(source, "a").join(side(target, "b"), [*by, "_k"])
    one = both.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg(F.abs(F.col("bx") - F.col("ax"))).alias("mean_dx"), F.avg(F.abs(F.col("by") - F.col("ay"))).alias("mean_dy"))
    return one.withColumn("mean_drift", F.hypot("mean_dx", "mean_dy"))


def order_consistency(source: DataFrame, target: DataFrame, by: str, page: str) -> DataFrame:
    """Rows (by, order_consistency): how near the numbers of blocks of the pages of both sides are, over the pages that both have."""
    count = lambda d, n: d.groupBy(by, page).agg(F.count("*").alias(n))
    both = count(source, "_a").join(count(target, "_b"), [by, page])
    return both.groupBy(by).agg(F.avg(F.least("_a", "_b") / F.greatest("_a", "_b")).alias("order_consistency"))


def scores(source: DataFrame, target: DataFrame, by: str, cjk: bool = True) -> DataFrame:
    """Rows (by, geometry_score, structure_score, translation_score, rendering_score, overall) of two tables of profiles.

    Profiles have (headings, captions, toc_entries, formulas, pages, lines,
    chars, cjk_chars); the target's also latin_lines, whitespace, collision,
    overflow and order_consistency. ``cjk``: the target language is written in
    East Asian characters. Scores go up to 100.
    """
    a, b = source.alias("a"), target.alias("b")
    s, t = lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")
    pages = F.greatest(s("pages"), F.lit(1))
    moved = F.abs(t("pages") - pages) / pages
    geometry = 100.0 * F.greatest(F.lit(0.0), 1.0 - t("collision") - t("overflow") - moved)
    kept = sum((w * preservation(s(c), t(c)) for c, w in STRUCTURE.items()), F.lit(0.0))
    structure = 100.0 * (kept + ORDER_WEIGHT * F.coalesce(t("order_consistency"), F.lit(1.0)))
    share = F.when(t("chars") <= 0, 0.0).otherwise(t("cjk_chars") / t("chars") if cjk else 1.0 - t("cjk_chars") / t("chars"))
    residue = F.when(s("lines") <= 0, 0.0).otherwise(F.least(F.lit(1.0), t("latin_lines") / s("lines")))
    coverage = F.when(s("chars") <= 0, 1.0).otherwise(F.least(F.lit(MOST_COVERAGE), t("chars") / s("chars")))
    translation = 100.0 * F.greatest(F.lit(0.0), TRANSLATION[0] * share + TRANSLATION[1] * (1.0 - residue) + TRANSLATION[2] * coverage)
    per_page = t("lines") / t("pages")
    density = F.when(t("pages") <= 0, 1.0).when(t("lines") <= 0, 0.0).otherwise(_unit(1.0 - F.abs(per_page - IDEAL_LINES) / IDEAL_LINES))
    parts = (1.0 - t("collision"), 1.0 - t("overflow"), _unit(1.0 - t("whitespace") * 2.0), density)
    rendering = 100.0 * sum((w * p for w, p in zip(RENDERING, parts)), F.lit(0.0))
    names = ("geometry_score", "structure_score", "translation_score", "rendering_score")
    one = a.join(b, by).select(by, *(c.alias(n) for n, c in zip(names, (geometry, structure, translation, rendering))))
    return one.withColumn("overall", sum((w * F.col(n) for w, n in zip(OVERALL, names)), F.lit(0.0)))


def consistency(source: Column, target: Column, terms: dict[str, str], names: tuple[str, ...] = ()) -> Column:
    """Score from 0 to 1: less for each term of a small glossary, and each name, of the source that the target lacks."""
    low, out = F.lower(F.coalesce(target, F.lit(""))), F.lit(1.0)
    has = lambda text, word: F.contains(text, F.lit(word.lower()))
    origin = F.lower(F.coalesce(source, F.lit("")))
    for cost, pairs in ((TERM_COST, terms.items()), (NAME_COST, ((n, n) for n in names))):
        for word, wanted in pairs:
            out = out - F.when(has(origin, word) & ~has(low, wanted), cost).otherwise(0.0)
    return F.greatest(F.lit(0.0), out)


def annotated_contents(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """``blocks`` (page, seq, text, kind) with ``toc_number``, ``toc_title`` and ``toc_page`` of the entry that they show.

    An entry (page, seq, number, title, target) goes to the first block of its
    page whose words hold its number and whose text holds its title; of several
    entries of a block the last one counts. Blocks and entries meet by (page,
    number), not page by page.
    """
    words = F.explode(F.array_distinct(F.split("text", r"\s+")))
    shown = blocks.select("page", F.col("seq").alias("_b"), "text", words.alias("number"))
    met = shown.join(entries.select("page", F.col("seq").alias("_e"), "number", "title", "target"), ["page", "number"]).where(F.contains("text", "title"))
    first = met.groupBy("page", "_e").agg(F.min(F.struct("_b", "number", "title", "target")).alias("m"))
    last = first.groupBy("page", F.col("m._b").alias("seq")).agg(F.max_by("m", "_e").alias("m"))
    out = blocks.join(last, ["page", "seq"], "left")
    found = F.col("m").isNotNull()
    return out.withColumns({"kind": F.when(found, "toc").otherwise(F.col("kind")), "toc_number": F.col("m.number"), "toc_title": F.col("m.title"), "toc_page": F.col("m.target")}).drop("m")


def visual_order(nodes: DataFrame, follows: DataFrame) -> DataFrame:
    """Rows (page, id, position) of nodes (page, id, x0, y0) in visual order.

    A page with edges (src, dst) for less than 30 % of its nodes is read from
    the top and then from the left. Others are sorted along their edges, the
    least id first where several may come; nodes on a cycle come last, from the
    top. Edges between pages do not count. A page is folded in one task.
    """
    ends = nodes.select(F.col("id").alias("dst"), F.col("page").alias("_to"))
    own = follows.select("src", "dst").distinct().join(ends, "dst").join(nodes.select(F.col("id").alias("src"), "page"), "src").where("page = _to")
    out = own.groupBy("page", F.col("src").alias("id")).agg(F.collect_list("dst").alias("next"))
    rows = nodes.select("page", "id", "x0", "y0").join(out, ["page", "id"], "left")

    def sort(page: list) -> list[tuple]:
        top = sorted(page, key=lambda r: (r.y0, r.x0, r.id))
        after = {r.id: list(r.next) if r.next is not None else [] for r in page}
        if sum(map(len, after.values())) < LEAST_EDGES * len(page):
            return [(r.page, r.id, k) for k, r in enumerate(top)]
        waits = dict.fromkeys(after, 0)
        for targets in after.values():
            for t in targets:
                waits[t] += 1
        ready, done = [n for n, w in waits.items() if not w], []
        heapq.heapify(ready)
        while ready:
            n = heapq.heappop(ready)
            done.append(n)
            for t in after[n]:
                waits[t] -= 1
                if not waits[t]:
                    heapq.heappush(ready, t)
        seen = set(done)
        return [(page[0].page, n, k) for k, n in enumerate(done + [r.id for r in top if r.id not in seen])]

    return folded(rows, "page", ["id"], ["page", "id", "x0", "y0", "next"], sort, "page bigint, id string, position int")


def text_lines(words: DataFrame, tolerance: float = 0.35, column_gap: float = 2.5, strip: tuple[int, int, float] = (3, 3, 3.0)) -> DataFrame:
    """Rows (page, line, x0, x1, y0, text) of words (page, text, x0, x1, y0, size) on their baselines ``y0``, from the top (y up).

    A word joins the first line whose first word's baseline is within
    ``tolerance`` sizes; a gap of ``column_gap`` sizes splits a line. ``strip``
    (lines, characters, slack): as many lines or more of so few characters at
    the same place across are a strip of turned text and are left out.
    """

    def build(page: list) -> list[tuple]:
        lines: list[list] = []
        for w in sorted(page, key=lambda w: (round(w.y0, 1), w.x0)):
            home = next((line for line in lines if abs(w.y0 - line[0].y0) <= tolerance * max(w.size, line[0].size)), None)
            lines.append([w]) if home is None else home.append(w)
        parts: list[list] = []
        for line in lines:
            line.sort(key=lambda w: w.x0)
            gap = column_gap * max(w.size for w in line)
            parts.append([line[0]])
            for a, b in zip(line, line[1:]):
                if b.x0 - a.x1 >= gap:
                    parts.append([])
                parts[-1].append(b)
        few = [p for p in parts if sum(len(w.text) for w in p) <= strip[1]]
        near = lambda a, b: abs(a[0].x0 - b[0].x0) <= strip[2] and abs(a[-1].x1 - b[-1].x1) <= strip[2]
        gone: set[int] = set()
        for a in few:
            group = [id(b) for b in few if id(b) not in gone and near(a, b)]
            if id(a) not in gone and len(group) >= strip[0]:
                gone.update(group)
        kept = sorted((p for p in parts if id(p) not in gone), key=lambda p: (-p[0].y0, p[0].x0))
        return [(p[0].page, k, p[0].x0, p[-1].x1, p[0].y0, " ".join(w.text for w in p)) for k, p in enumerate(kept)]

    return folded(words, "page", ["y0", "x0"], ["page", "text", "x0", "x1", "y0", "size"], build, "page bigint, line int, x0 double, x1 double, y0 double, text string")
