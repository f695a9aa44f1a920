"""Blocks as HTML, text, prompts and manifests; images and their strategy; flow, measure and justification of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import lookup
from .joins import nearest_host

# Escapes of HTML, in the order in which they apply.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
# Strategy of an image class; every other class is preserved.
STRATEGIES = {"screenshot": "ocr_overlay", "chart": "keep_labels", "diagram": "ocr_redraw", "map": "keep_labels", "comic": "ocr_overlay", "scanned": "ocr_pipeline"}
# Limits of the image classes.
QR_COLORS, QR_EDGE, QR_ASPECT = 8, 0.30, (0.8, 1.25)
BARCODE_ASPECT, BARCODE_EDGE = 0.4, 0.25
CAD_COLORS, CAD_EDGE, CAD_SIDE = 4, 0.35, 32
EQUATION_ASPECT, EQUATION_WHITE, EQUATION_COLORS = 1.6, 0.55, 64
LOGO_AREA, LOGO_COLORS = 64 * 64, 12
PHOTO_COLORS, PHOTO_UNIQUE, PHOTO_EDGE = 192, 0.15, 0.30
CHART_WHITE, CHART_COLORS, CHART_EDGE = 0.4, 96, 0.18
COMIC_COLORS, COMIC_EDGE = 120, 0.28
SHOT_COLORS, SHOT_EDGE = (24, 192), 0.30
# Headings of contents entries by language family and kind.
PREFIXES = {
    "zh": {"chapter": "第{}章", "section": "第{}节", "subsection": "第{}节", "part": "第{}篇", "appendix": "附录{}", "contents": "目录", "index": "索引"},
    "en": {"chapter": "Chapter {}", "section": "Section {}", "subsection": "Section {}", "part": "Part {}", "appendix": "Appendix {}", "contents": "Contents", "index": "Index"},
}
# A flowing page, its margins, and the size of letters, lines and gaps at 12 points.
PAGE_HEIGHT, CONTENT_WIDTH, MARGIN_TOP, MARGIN_BOTTOM = 792.0, 512.0, 50.0, 50.0
LETTER, LINE, GAP, ADVANCE = 7.0, 16.0, 6.0, 5.0
WIDE = r"[⺀-⻿　-ヿ㐀-䶿一-鿿豈-﫿＀-￯]"


def escaped(text: Column) -> Column:
    """``text`` with the control characters of HTML escaped."""
    for raw, entity in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def html_element(id: Column, kind: Column, text: Column, image: Column | None = None) -> Column:
    """A block's element: its class by kind, the path of its image; the cells of a table, between tabs, are rows."""
    safe = escaped(F.coalesce(text, F.lit("")))
    own = F.when(kind.isin("heading", "table", "caption", "formula"), F.concat(kind, F.lit(" "))).otherwise("")
    rows = F.concat(F.lit("<tr><td>"), F.replace(safe, F.lit("\t"), F.lit("</td></tr><tr><td>")), F.lit("</td></tr>"))
    figure = F.concat(F.lit("<div class='figure block' id='"), id, F.lit("'><img src='"), escaped(F.coalesce(image, F.lit(""))) if image is not None else F.lit(""), F.lit("' alt='figure'></div>"))
    other = F.concat(F.lit("<div class='"), own, F.lit("block' id='"), id, F.lit("'>"), F.when(kind == "table", rows).otherwise(safe), F.lit("</div>"))
    return F.when(kind == "figure", figure).otherwise(other)


def text_line(kind: Column, text: Column) -> Column:
    """A block as a line of plain text: headings between marks after a blank line, captions marked."""
    text = F.coalesce(text, F.lit(""))
    return F.when(kind == "heading", F.concat(F.lit("\n== "), text, F.lit(" =="))).when(kind == "caption", F.concat(F.lit("[caption] "), text)).otherwise(text)


def render(blocks: DataFrame, by: str, order: list[str], fmt: str = "html") -> DataFrame:
    """Rows (by, body): the blocks (id, kind, text, and image if there is one) of a document in order, as one HTML page or plain text."""
    if fmt not in ("html", "text"):
        raise ValueError(f"unknown format {fmt!r}")
    image = F.col("image") if "image" in blocks.columns else None
    line = html_element(F.col("id"), F.col("kind"), F.col("text"), image) if fmt == "html" else text_line(F.col("kind"), F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"])
    head, mark, tail = ("<!DOCTYPE html><html><head><meta charset='utf-8'></head><body><div class='page'>", "", "</div></body></html>") if fmt == "html" else ("", "\n", "\n")
    return blocks.groupBy(by).agg(F.concat(F.lit(head), F.array_join(parts, mark), F.lit(tail)).alias("body"))


def shown_text(translated: Column, text: Column) -> Column:
    """The translation, or the text where that is missing or empty."""
    return F.coalesce(F.when(translated != "", translated), text, F.lit(""))


def filled(template: str, **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced by that column's text; values are not looked into for further names."""
    parts, rest = [], template
    while rest:
        at = {n: rest.find("{" + n + "}") for n in values}
        at = {n: k for n, k in at.items() if k >= 0}
        if not at:
            break
        name = min(at, key=at.get)
        parts += [F.lit(rest[: at[name]]), F.coalesce(values[name].cast("string"), F.lit(""))]
        rest = rest[at[name] + len(name) + 2 :]
    return F.concat(*parts, F.lit(rest))


def glossary_prompt(terms: DataFrame, by: str, order: str, most: int = 50) -> DataFrame:
    """Rows (by, prompt): the first ``most`` terms (source, target) of each group as lines."""
    first = terms.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_k") <= most)
    line = F.concat(F.lit("- "), "source", F.lit(" → "), "target")
    return first.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", line.alias("_line")))), lambda x: x["_line"]), "\n").alias("prompt"))


def contents_prefix(kind: Column, number: Column, language: str) -> Column:
    """The heading of a contents entry of some kind in a language; empty for kinds without one."""
    low = language.lower().replace("_", "-")
    family = "zh" if low.startswith("zh") or low in ("cmn", "yue", "wuu", "chinese", "cht") else "en"
    out = F.lit("")
    for name, template in PREFIXES[family].items():
        before, _, after = template.partition("{}")
        text = F.concat(F.lit(before), F.coalesce(number, F.lit("")), F.lit(after)) if "{}" in template else F.lit(template)
        out = F.when(kind == name, text).otherwise(out)
    return out


def contents_line(prefix: Column, title: Column, leader: Column, page: Column) -> Column:
    """Prefix and title, then leader and page after a space."""
    head = F.concat_ws(" ", F.when(prefix != "", prefix), F.when(F.trim(title) != "", F.trim(title)))
    tail = F.concat(F.coalesce(leader, F.lit("")), F.coalesce(page, F.lit("")))
    return F.concat_ws(" ", F.when(head != "", head), F.when(tail != "", tail))


def channel(semantic: Column, role: Column) -> Column:
    """The channel that rewrites a block: formula, verbatim, catalog or text, first rule that holds."""
    formula = (role == "keep_formula") | semantic.isin("formula", "formula_inline")
    fixed = role.isin("keep_number", "skip", "track")
    listed = semantic.isin("heading", "reference", "bibliography", "abstract")
    return F.when(formula, "formula").when(fixed, "verbatim").when(listed, "catalog").otherwise("text")


# ------------------------------------------------------------------- images


def image_class(f: Column) -> Column:
    """Struct (class, confidence) of image features (width, height, color_count, gray, edge, white, dark, unique), first rule that holds."""
    aspect, few = f.width / F.greatest(f.height, F.lit(1)), f.color_count
    verdict = lambda name, c: F.struct(F.lit(name).alias("class"), F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    line = f.gray & (few <= QR_COLORS)
    logo = (f.width * f.height <= LOGO_AREA) & (few <= LOGO_COLORS) & ((f.dark > 0.05) | (f.edge > 0.02))
    return (
        F.when((f.width <= 0) | (f.height <= 0) | (few == 0), verdict("unknown", F.lit(0.2)))
        .when(line & aspect.between(*QR_ASPECT) & (f.edge >= QR_EDGE), verdict("qr_code", f.edge * 1.6))
        .when(line & (aspect < BARCODE_ASPECT) & (f.edge >= BARCODE_EDGE), verdict("barcode", 0.6 + f.edge))
        .when(f.gray & (few <= CAD_COLORS) & (f.edge >= CAD_EDGE) & (F.least(f.width, f.height) >= CAD_SIDE), verdict("cad", 0.55 + f.edge * 0.8))
        .when(f.gray & (aspect > EQUATION_ASPECT) & (f.white >= EQUATION_WHITE) & (few <= EQUATION_COLORS), verdict("equation", 0.55 + f.edge))
        .when(logo, verdict("logo", 0.5 + F.greatest(F.lit(0.0), 0.2 - f.unique)))
        .when((few >= PHOTO_COLORS) & (f.unique >= PHOTO_UNIQUE) & (f.edge < PHOTO_EDGE), verdict("photo", 0.55 + f.unique))
        .when((f.white >= CHART_WHITE) & (few <= CHART_COLORS) & (f.edge >= CHART_EDGE), verdict("chart", 0.5 + f.edge))
        .when((few >= COMIC_COLORS) & (f.edge >= COMIC_EDGE), verdict("comic", F.lit(0.55)))
        .when((few >= SHOT_COLORS[0]) & (few < SHOT_COLORS[1]) & (f.edge < SHOT_EDGE), verdict("screenshot", F.lit(0.5)))
        .otherwise(verdict("unknown", F.lit(0.35)))
    )


def strategy(name: Column) -> Column:
    """What is done with an image of a class."""
    return lookup(F.lower(F.coalesce(name, F.lit("unknown"))), STRATEGIES, "preserve")


def region_score(kind: Column, text: Column, translate: Column, confidence: Column) -> Column:
    """Score from 0 to 1 of translating a region of an image; ``translate`` is the verdict on its text."""
    t = F.trim(F.coalesce(text, F.lit("")))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    score = 0.5 + 0.15 * confidence + F.when(words >= 2, 0.15).otherwise(0.0) + F.when(F.length(t).between(2, 40), 0.05).otherwise(0.0)
    return F.when(kind == "axis_label", 0.2).when(kind == "ui_control", 0.3).when(t == "", 0.2).when(~translate, 0.15).otherwise(F.least(score, F.lit(1.0)))


def figures(images: DataFrame, captions: DataFrame) -> DataFrame:
    """``images`` (page, id, y0, class) with their strategy and the caption (page, id, y0) of the page nearest in height."""
    near = nearest_host(images, captions, ["page"], "y0", "id", "caption_")
    return near.withColumn("strategy", strategy(F.col("class"))).drop("caption_y0", "caption_at")


def on_page(resources: DataFrame, page: int) -> DataFrame:
    """The resources of a page."""
    return resources.where(F.col("page") == page)


# --------------------------------------------------------- flow and measure


def flow(blocks: DataFrame, by: str, order: str, width: float = CONTENT_WIDTH, size: float = 12.0) -> DataFrame:
    """Rows (by, order, lines, height, y): where each block that is not blank lands as paragraphs flow down pages.

    A block that does not fit below the last one starts at the top margin again.
    The blocks of one document are folded in order.
    """
    per_line = F.greatest(F.lit(1), F.floor(F.lit(width) / (LETTER * size / 12.0)))
    lines = F.greatest(F.lit(1), F.ceil(F.length("text") / per_line)).cast("bigint")
    rows = blocks.where(F.trim("text") != "").select(by, F.col(order).alias("_o"), lines.alias("_n"))
    each = F.array_sort(F.collect_list(F.struct("_o", "_n")))
    tall = lambda n: n * F.lit(LINE * size / 12.0)

    def place(acc, b):
        y = F.when(acc.y + tall(b["_n"]) > PAGE_HEIGHT - MARGIN_BOTTOM, F.lit(MARGIN_TOP)).otherwise(acc.y)
        out = F.struct(b["_o"].alias("o"), b["_n"].alias("n"), y.alias("y"))
        return F.struct((y + tall(b["_n"]) + GAP).alias("y"), F.concat(acc.out, F.array(out)).alias("out"))

    kind = dict(rows.dtypes)["_o"]
    start = F.struct(F.lit(MARGIN_TOP).alias("y"), F.array().cast(f"array<struct<o:{kind},n:bigint,y:double>>").alias("out"))
    placed = rows.groupBy(by).agg(F.aggregate(each, start, place, lambda a: a.out).alias("p"))
    return placed.select(by, F.explode("p").alias("p")).select(by, F.col("p.o").alias(order), F.col("p.n").alias("lines"), tall(F.col("p.n")).alias("height"), F.col("p.y").alias("y"))


def width_map(glyphs: DataFrame, by: str) -> DataFrame:
    """Rows (by, char, width): the greatest width of each character's glyphs (char, x0, x1) that have one."""
    wide = F.col("x1") - F.col("x0")
    return glyphs.where(wide > 0).groupBy(by, "char").agg(F.max(wide).alias("width"))


def measured(text: Column, widths: dict[str, float] | None = None, advance: float = ADVANCE) -> Column:
    """Width of a text: of each character its own, or ``advance``."""
    return F.aggregate(advances(text, widths, advance), F.lit(0.0), lambda a, w: a + w)


def advances(text: Column, widths: dict[str, float] | None = None, advance: float = ADVANCE) -> Column:
    """The width of each character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c: lookup(c, widths or {}, advance).cast("double"))


def justified(text: Column, width: Column, advance: float = ADVANCE) -> Column:
    """The advance of each character of a line stretched to ``width``.

    What is left goes to the white space in equal parts; without any, or in East
    Asian text, to all characters but the last.
    """
    own, n = advances(text, advance=advance), F.length(text)
    left = F.greatest(F.lit(0.0), width - n * advance)
    space = F.length(text) - F.length(F.regexp_replace(text, r"\s", ""))
    even = text.rlike(WIDE) | (space == 0)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    spread = F.transform(own, lambda w, k: w + F.when(k < n - 1, left / (n - 1)).otherwise(0.0))
    words = F.transform(chars, lambda c: F.lit(advance) + F.when(c.rlike(r"^\s$"), left / space).otherwise(0.0))
    return F.when((n <= 1) | (left <= 0), own).when(even, spread).otherwise(words)


def lone_line(lines: Column, paragraph: Column) -> Column:
    """Whether a paragraph has a single line."""
    return paragraph & (lines == 1)


def column_lines(words: DataFrame, by: list[str], id: str = "seq", ratio: float = 2.5) -> DataFrame:
    """``words`` (x0, x1, size) of baselines with ``line``: a gap of ``ratio`` sizes starts another line of the baseline."""
    w = Window.partitionBy(*by).orderBy("x0", "x1", id)
    size = F.max("size").over(Window.partitionBy(*by))
    new = (F.col("x0") - F.lag("x1").over(w) >= ratio * size).cast("int")
    return words.withColumn("_n", F.coalesce(new, F.lit(0))).withColumn("line", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_n")


def manifest(boxes: DataFrame, by: str, id: str, gap: float) -> DataFrame:
    """Rows (by, chunk, x, y, w, h, sources): blocks that follow one another within ``gap``, as one chunk each."""
    w = Window.partitionBy(by).orderBy("y0", "x0", id)
    reach = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce((F.col("y0") - reach > gap).cast("int"), F.lit(0))
    runs = boxes.withColumn("_c", cut).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = runs.groupBy(by, "_run").agg(F.min(F.struct("y0", "x0", id))[id].alias("_first"), F.min("x0").alias("x"), F.min("y0").alias("y"), F.max("x1").alias("_x1"), F.max("y1").alias("_y1"), F.count("*").alias("sources"))
    return one.select(by, F.concat(F.lit("chunk_"), F.col("_first").cast("string")).alias("chunk"), F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round(F.col("_x1") - F.col("x"), 2).alias("w"), F.round(F.col("_y1") - F.col("y"), 2).alias("h"), "sources")


def chunk_constraints(chunks: DataFrame, by: str) -> DataFrame:
    """Rows (by, src, dst, relation, priority) that keep each chunk (chunk, x, y) below the one before it."""
    w = Window.partitionBy(by).orderBy("y", "x", "chunk")
    below = chunks.select(by, F.lag("chunk").over(w).alias("src"), F.col("chunk").alias("dst"))
    return below.where("src is not null").select(by, "src", "dst", F.lit("must_below").alias("relation"), F.lit("soft").alias("priority"))
