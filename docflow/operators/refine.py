"""Refinement of a document model: sizes, headings, notes, margins, contents, glossary, references, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns, ratios and defaults of the model.
SECTION_NUMBER = r"^(?:I|II|III|IV|V|VI|VII|VIII|IX|X|[0-9]+[.]?[0-9]*|[A-Z][.])\s+"
FOOTNOTE_MARK = r"^[0-9†‡*§¶‖#•◊○●]"
HEADING_RATIOS = ((1.8, 1), (1.4, 2), (1.15, 3))
BODY_SIZE, FOOTNOTE_RATIO, LONGEST_HEADING, MARGIN = 12.0, 0.9, 80, 0.1
ENTRY_DOTTED, ENTRY_PLAIN = r"^\s*([0-9]+(?:[.][0-9]+)+)", r"^\s*([0-9]+)\s+"
LEADER_PAGE, SPACE_PAGE = r"[.·…‥]{2,}\s*([0-9]{1,5})\s*$", r"[ ]+([0-9]{1,5})\s*$"
REFERENCES = {"figure": r"\b(Fig(?:ure)?[.]?)", "table": r"\b(Tab(?:le)?[.]?)", "equation": r"\b(Eq(?:uation)?[.]?)", "section": r"\b(Section|Sec[.]?)"}
OVERLAP_SHARE, WIDEST_GAP = 0.3, 50.0


def body_font_size(blocks: DataFrame, by: str) -> DataFrame:
    """Rows (by, body): the true median size of the paragraphs of each group, 12 without any."""
    size = F.when((F.col("kind") == "paragraph") & (F.col("font_size") > 0), F.col("font_size"))
    return blocks.groupBy(by).agg(F.coalesce(F.percentile(size, F.lit(0.5)), F.lit(BODY_SIZE)).alias("body"))


def refined(blocks: DataFrame, by: str) -> DataFrame:
    """``blocks`` (text, kind, font_size) with refined ``kind``, ``heading_level`` and the ``analysis`` that found it.

    Headings get a level by their size over the body's; short numbered paragraphs
    become headings of level 2; small marked paragraphs become footnotes.
    """
    level = F.lit(4)
    for ratio, k in reversed(HEADING_RATIOS):
        level = F.when(F.col("font_size") / F.col("body") >= ratio, k).otherwise(level)
    text, plain = F.trim("text"), F.col("kind") == "paragraph"
    numbered = plain & text.rlike(SECTION_NUMBER) & (F.length(text) <= LONGEST_HEADING)
    note = plain & ~numbered & (F.col("font_size") > 0) & (F.col("font_size") < F.col("body") * FOOTNOTE_RATIO) & text.rlike(FOOTNOTE_MARK)
    heading = F.col("kind") == "heading"
    out = blocks.join(body_font_size(blocks, by), by)
    return out.withColumns(
        {
            "heading_level": F.when(heading, level).when(numbered, 2),
            "analysis": F.when(heading, "font_ratio_heading").when(numbered, "section_number_heading").when(note, "font_size_footnote"),
            "kind": F.when(numbered, "heading").when(note, "footnote").otherwise(F.col("kind")),
        }
    ).drop("body")


def page_box(blocks: DataFrame, by: str = "page") -> DataFrame:
    """Rows (by, x0, y0, x1, y1): the box around all blocks of a page."""
    return blocks.groupBy(by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def margins(blocks: DataFrame, by: str = "page", share: float = MARGIN) -> DataFrame:
    """``blocks`` with ``edge``: header if a box ends in the upper tenth of its page's box, else footer if it starts in the lower."""
    box = page_box(blocks, by).select(by, F.col("y0").alias("_lo"), F.col("y1").alias("_hi"))
    depth = (F.col("_hi") - F.col("_lo")) * share
    edge = F.when(F.col("y1") >= F.col("_hi") - depth, "header").when(F.col("y0") < F.col("_lo") + depth, "footer")
    return blocks.join(box, by).withColumn("edge", edge).drop("_lo", "_hi")


def layout_quality(blocks: DataFrame, by: str = "page", id: str = "seq", cell: float = 64.0) -> DataFrame:
    """Rows (by, n_overlaps, gap_variance, penalty) of each page.

    Two blocks overlap if their heights do and over 30 % of the narrower one's
    width is shared; they meet by cells of their heights, not page by page. Gaps
    are those between neighbours in reading order, from 0 to 50.
    """
    own = ("x0", "y0", "x1", "y1")
    cells = blocks.select(by, id, *own, F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.greatest("y0", "y1") / cell))).alias("cell"))
    other = cells.select(by, "cell", *(F.col(c).alias(f"o_{c}") for c in (id, *own)))
    after = (F.col("y0") < F.col("o_y0")) | ((F.col("y0") == F.col("o_y0")) & (F.col(id) < F.col(f"o_{id}")))
    shared = F.least("x1", "o_x1") - F.greatest("x0", "o_x0")
    narrow = F.least(F.col("x1") - F.col("x0"), F.col("o_x1") - F.col("o_x0"))
    meet = (F.col("y1") > F.col("o_y0")) & (shared > 0) & (shared > narrow * OVERLAP_SHARE) & (F.col("cell") == F.floor(F.col("o_y0") / cell))
    pairs = cells.join(other, [by, "cell"]).where(after & meet).groupBy(by).agg(F.count("*").alias("n_overlaps"))
    order = Window.partitionBy(by).orderBy("y0", id)
    gap = F.lead("y0").over(order) - F.col("y1")
    gaps = blocks.select(by, gap.alias("gap")).groupBy(by).agg(F.var_pop(F.when((F.col("gap") > 0) & (F.col("gap") < WIDEST_GAP), F.col("gap"))).alias("variance"))
    out = gaps.join(pairs, by, "left").select(by, F.coalesce("n_overlaps", F.lit(0)).alias("n_overlaps"), F.coalesce("variance", F.lit(0.0)).alias("gap_variance"))
    penalty = F.least(F.col("n_overlaps") * 5.0, F.lit(25.0)) + F.when(F.col("gap_variance") > 100, F.least(F.col("gap_variance") / 50, F.lit(10.0))).otherwise(0.0)
    return out.withColumn("penalty", penalty)


def apply_glossary(text: Column, terms: dict[str, str]) -> Column:
    """``text`` with each whole word (or its plural in s) of a small glossary replaced, term after term."""
    for term, target in terms.items():
        escaped = "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in term)
        text = F.regexp_replace(text, f"(?i)(?<![A-Za-z0-9]){escaped}s?(?![A-Za-z0-9])", target.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def renumber(text: Column, kind: str, mapping: dict[str, str]) -> Column:
    """``text`` with the references of a kind to old numbers turned into new ones, all at once."""
    held = text
    for old in mapping:  # marked first, so that a new number is not taken for an old one
        held = F.regexp_replace(held, f"(?i){REFERENCES[kind]}\\s*[.]?\\s*{old}(?![0-9])", f"$1 \u0001{old}\u0002")
    for old, new in mapping.items():
        held = F.replace(held, F.lit(f"\u0001{old}\u0002"), F.lit(new))
    return held


def contents_entry(line: Column) -> Column:
    """Struct (number, title, page) of a line of a table of contents, null if it is none.

    A line starts with a number; digits after leaders or at the end are its page;
    a number without a point needs a page, and a title must be left.
    """
    dotted, plain = F.regexp_extract(line, ENTRY_DOTTED, 1), F.regexp_extract(line, ENTRY_PLAIN, 1)
    number = F.when(dotted != "", dotted).otherwise(plain)
    raw = F.trim(F.when(dotted != "", F.regexp_replace(line, ENTRY_DOTTED, "")).otherwise(F.regexp_replace(line, ENTRY_PLAIN, "")))
    led, spaced = F.regexp_extract(raw, LEADER_PAGE, 1), F.regexp_extract(raw, SPACE_PAGE, 1)
    page = F.when(led != "", led).otherwise(spaced)
    bare = F.when(led != "", F.regexp_replace(raw, LEADER_PAGE, "")).otherwise(F.regexp_replace(raw, SPACE_PAGE, ""))
    title = F.regexp_replace(F.regexp_replace(F.trim(bare), r"^[.·…‥]+|[.·…‥]+$", ""), r"^[ :.–—-]+|[ :.–—-]+$", "")
    valid = (number != "") & (title != "") & (F.contains(number, F.lit(".")) | (page != ""))
    return F.when(valid, F.struct(number.alias("number"), title.alias("title"), page.alias("page")))


def contents(lines: DataFrame, by: str, order: str) -> DataFrame:
    """Rows (by, order, number, title, page): the entries of the blocks that are tables of contents.

    A block is one if it has two lines or more, entries in at least two and in
    half of them, and pages in half of its entries. Blank lines do not count.
    """
    each = lines.where(F.trim("text") != "").select(by, order, contents_entry(F.col("text")).alias("e"))
    one = each.groupBy(by).agg(F.count("*").alias("n"), F.count("e").alias("hits"), F.count(F.when(F.col("e.page") != "", 1)).alias("paged"))
    one = one.where((F.col("n") >= 2) & (F.col("hits") >= F.greatest(F.lit(2), F.floor(F.col("n") / 2))) & (F.col("paged") * 2 >= F.col("hits")))
    return each.where("e is not null").join(one.select(by), by, "left_semi").select(by, order, "e.number", "e.title", "e.page")


def ancestors(ids: DataFrame, id: str = "id", mark: str = "::") -> DataFrame:
    """Rows (id, depth, ancestor): the chain of ids above one that is a path, from the root."""
    ids, parts = ids.select(F.col(id).alias("id")), F.split("id", mark)
    chain = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), mark))
    chain = F.when(F.size(parts) > 1, chain).otherwise(F.array().cast("array<string>"))
    return ids.select("id", F.posexplode(chain).alias("depth", "ancestor"))


def styles(spans: DataFrame, by: str) -> DataFrame:
    """Rows (by, fonts, multifont): each font with its sizes in order, and whether there is more than one."""
    sizes = spans.groupBy(by, "font").agg(F.array_sort(F.collect_set("font_size")).alias("sizes"))
    one = F.concat(F.col("font"), F.lit("="), F.array_join(F.transform("sizes", lambda s: F.format_string("%.2f", s)), "/"))
    made = sizes.select(by, one.alias("one")).groupBy(by).agg(F.array_sort(F.collect_list("one")).alias("all"))
    return made.select(by, F.array_join("all", ";").alias("fonts"), (F.size("all") > 1).alias("multifont"))


def render_plan(blocks: DataFrame) -> DataFrame:
    """A render decision per block: its id, path and boxes, rounded half to even; the translation, or else the text."""
    have = set(blocks.columns)
    field = lambda name, default: F.coalesce(F.col(name), default) if name in have else default
    box = F.array_join(F.array(*(F.format_string("%.2f", F.bround(c, 2)) for c in ("x0", "y0", "x1", "y1"))), ",")
    return blocks.select(
        F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_b"), F.col("seq").cast("string")).alias("block_id"),
        "page",
        field("translated", F.col("text")).alias("translated"),
        field("render_path", F.lit("translate_refit")).alias("render_path"),
        box.alias("src_box"),
        box.alias("dst_box"),
    )


def retry_delay(attempt: Column, base: float = 100.0, factor: float = 2.0) -> Column:
    """Milliseconds to wait before an attempt, counted from 0."""
    return F.lit(base) * F.pow(F.lit(factor), attempt)


def idle(events: DataFrame, by: str, at: str, seconds: int) -> DataFrame:
    """Rows (by, last): those whose last event is more than ``seconds`` before the last of all."""
    last = events.groupBy(by).agg(F.max(at).alias("last"))
    end = events.agg(F.max(at).alias("_end"))  # one row
    return last.join(F.broadcast(end)).where(F.col("last") < F.col("_end") - F.make_dt_interval(secs=F.lit(float(seconds)))).drop("_end")


def matched(nodes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` (page, text, ...) with the least ``node`` of the same page and trimmed text; null if there is none."""
    first = nodes.groupBy("page", F.trim("text").alias("_t")).agg(F.min("node").alias("node"))
    return paragraphs.withColumn("_t", F.trim("text")).join(first, ["page", "_t"], "left").drop("_t")
