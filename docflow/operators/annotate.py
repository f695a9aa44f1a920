"""Annotations and views that compose the other operators: inspection, translation, rendering, constraints, repair, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.text import occurrences


def inspect(blocks: DataFrame, relations: DataFrame) -> DataFrame:
    """``blocks`` (id, ...) with their outgoing relations (src, dst, relation) as a sorted text, and how many there are."""
    out = relations.groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "relation", "dst"))), ",").alias("relations"), F.count("*").alias("n_relations"))
    return blocks.join(out, "id", "left").withColumn("n_relations", F.coalesce("n_relations", F.lit(0)))


def layout_report(blocks: DataFrame, ratio: float = 1.6) -> DataFrame:
    """Rows (issue, n): blocks split at a change of size, blends of sizes, mixed alignment.

    ``blocks`` has (n_parts, least_size, most_size, alignment).
    """
    issues = F.filter(
        F.array(
            F.when(F.col("n_parts") > 1, F.lit("split")),
            F.when(F.col("most_size") > F.col("least_size") * ratio, F.lit("size_blend")),
            F.when(F.col("alignment") == "mixed", F.lit("align_mixed")),
        ),
        lambda x: x.isNotNull(),
    )
    return blocks.select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def annotate_translation(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """``blocks`` (id, text) with ``translated`` and whether it is the source unchanged; untranslated blocks get nulls."""
    return blocks.join(translations.select("id", "translated"), "id", "left").withColumn("translated_same", F.col("translated") == F.col("text"))


def render_mode(kind: Column) -> Column:
    """How a block of a kind is drawn."""
    return F.when(kind.isin("figure", "image"), "overlay").when(kind.isin(*classify.KEEP_KINDS), "preserve_float").otherwise("translate_refit")


def translation_counts(blocks: DataFrame) -> DataFrame:
    """One row of what a translation run does with blocks (kind, text): skipped, preserved, translated, toc."""
    n = lambda test: F.count(F.when(test, 1))
    blank, keep, toc = F.trim("text") == "", F.col("kind").isin(*classify.KEEP_KINDS), F.col("kind") == "toc"
    return blocks.agg(n(blank).alias("skipped"), n(~blank & keep).alias("preserved"), n(~blank & ~keep & ~toc).alias("translated"), n(~blank & toc).alias("toc_translated"))


# Roles of a block kind in the three role systems.
ROLES = {
    "heading": ("heading", "section_start", "translate"),
    "paragraph": ("body_text", "flow", "translate"),
    "caption": ("caption", "follows_figure", "translate"),
    "formula": ("formula", "flow", "preserve"),
    "table": ("table", "float", "preserve"),
    "toc": ("unknown", "flow", "translate"),
}


def ir_roles(blocks: DataFrame) -> DataFrame:
    """``blocks`` with their semantic, reading and translation roles."""
    part = lambda k: classify.lookup(F.col("kind"), {kind: r[k] for kind, r in ROLES.items()}, "unknown")
    return blocks.withColumns({"semantic": part(0), "reading": part(1), "translation": part(2)})


# Edge type -> (constraint, priority, gap).
CONSTRAINTS = {"FOLLOWS": ("must_below", "soft", 2.0), "CONTAINS": ("keep_together", "hard", 0.0), "CAPTION_OF": ("must_below", "hard", 4.0)}


def constraints(edges: DataFrame) -> DataFrame:
    """Layout constraints (src, dst, constraint, priority, gap) of the edges that have one."""
    part = lambda k: classify.lookup(F.col("edge_type"), {e: c[k] for e, c in CONSTRAINTS.items()}, None)
    return edges.select("src", "dst", part(0).alias("constraint"), part(1).alias("priority"), part(2).alias("gap")).where("constraint is not null")


def conflicts(edges: DataFrame) -> DataFrame:
    """Pairs (a, b) that are each constrained to be below the other."""
    below = edges.where("constraint = 'must_below'").select("src", "dst").distinct()
    a, b = below.alias("a"), below.alias("b")
    return a.join(b, (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src")) & (F.col("a.src") < F.col("a.dst"))).select(F.col("a.src").alias("a"), F.col("a.dst").alias("b"))


def column_count(boxes: DataFrame, page: str = "page", gap: float = 20.0) -> DataFrame:
    """Rows (page, columns): intervals of x that lie more than ``gap`` apart, by a running maximum."""
    w = Window.partitionBy(page).orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = boxes.withColumn("_new", F.when(reach.isNull() | (F.col("x0") - reach > gap), 1).otherwise(0))
    return marked.groupBy(page).agg(F.sum("_new").alias("columns"))


def style_runs(chars: DataFrame) -> DataFrame:
    """Rows (page, run, text, font, size): consecutive characters (page, seq, text, font, size, x0, x1, y0) of one style and line."""
    w = Window.partitionBy("page").orderBy("seq")
    prev = lambda c: F.lag(c).over(w)
    new = prev("seq").isNull() | (F.abs(F.col("y0") - prev("y0")) > 3) | (F.col("font") != prev("font")) | (F.abs(F.col("size") - prev("size")) > 0.5) | (F.col("x0") - prev("x1") > 2)
    runs = chars.withColumn("_n", new.cast("int")).withColumn("run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("page", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x.text), "").alias("text"), F.min("font").alias("font"), F.min("size").alias("size"))


def learn(facts: DataFrame) -> DataFrame:
    """Rows (entity, definition, confidence, aliases): the definition of most confidence, all aliases."""
    return facts.groupBy("entity").agg(F.max_by("definition", F.struct("confidence", "seq")).alias("definition"), F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"))


def resolve_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows (name, entity): a name's entity by alias (alias, entity), itself where it is one, else null."""
    return names.join(aliases.withColumnRenamed("alias", "name"), "name", "left")


def tiered_lookup(keys: DataFrame, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows (key, value, tier): the value of the first tier (key, value) that has the key."""
    out, values, names = keys.select("key").distinct(), [], []
    for name, t in tiers:
        out = out.join(t.select("key", F.col("value").alias(f"_{name}")), "key", "left")
        values.append(F.col(f"_{name}"))
        names.append(F.when(F.col(f"_{name}").isNotNull(), name))
    return out.select("key", F.coalesce(*values).alias("value"), F.coalesce(*names).alias("tier"))


def split_contents(blocks: DataFrame) -> DataFrame:
    """Merged contents lines as rows of their own: ``blocks`` (doc_id, block_idx, text) with indexes counted anew."""
    parts = blocks.withColumn("_parts", F.split(F.regexp_replace("text", r"([.]{2,} *[0-9]{1,4}) +", "$1\n"), "\n"))
    rows = parts.select("doc_id", "block_idx", F.posexplode("_parts").alias("_p", "text"))
    kind = F.when(F.col("text").rlike(r"[.]{2,} *[0-9]{1,4}$"), "toc").otherwise("paragraph")
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("block_idx", "_p")) - 1).alias("block_idx"), "text", kind.alias("kind"))


def score_issues(scores: DataFrame, least: dict[str, float]) -> DataFrame:
    """Rows (id, module, severity, score) of scores under their limits; far under is critical."""
    each = F.array(*(F.struct(F.lit(m).alias("module"), F.col(m).cast("double").alias("score"), F.lit(v).alias("limit")) for m, v in least.items()))
    found = scores.select("id", F.explode(each).alias("s")).where("s.score < s.limit")
    return found.select("id", "s.module", F.when(F.col("s.score") < F.col("s.limit") * 0.5, "critical").otherwise("major").alias("severity"), "s.score")


# Repair of an issue and its rank, most urgent first.
REPAIRS = {"unicode_error": ("reextract", 0), "toc_merged_lines": ("split_lines", 1), "translation_overflow": ("shrink", 2), "formula_low_confidence": ("recover_math", 3), "empty_block": ("drop", 4)}


def repair_plan(issues: DataFrame) -> DataFrame:
    """``issues`` (code, ...) with the action and its rank; issues without one are left out."""
    return issues.withColumn("action", classify.lookup(F.col("code"), {k: v[0] for k, v in REPAIRS.items()}, None)).withColumn("rank", classify.lookup(F.col("code"), {k: v[1] for k, v in REPAIRS.items()}, None)).where("action is not null")


def compare_expected(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows (stem, kind, expected, actual, ok) of expected counts; what is not there counts 0."""
    joined = expected.join(actual, ["stem", "kind"], "left")
    return joined.select("stem", "kind", "expected", F.coalesce("actual", F.lit(0)).alias("actual"), (F.col("expected") == F.coalesce("actual", F.lit(0))).alias("ok"))


def glossary_violations(pairs: DataFrame, term: str, pinned: str) -> DataFrame:
    """Pairs (id, source, target) whose source has the term and whose target lacks its pinned form."""
    return pairs.where(F.contains(F.lower("source"), F.lit(term.lower())) & ~F.contains("target", F.lit(pinned))).select("id")


def review_totals(pairs: DataFrame) -> DataFrame:
    """One row of a review of (source, target): checked, unchanged, blank, with numbers lost, and the share without issue."""
    same, blank = F.col("source") == F.col("target"), F.trim("target") == ""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)))
    lost = F.size(F.array_except(numbers("source"), numbers("target"))) > 0
    n = lambda t: F.count(F.when(t, 1))
    return pairs.agg(F.count("*").alias("checked"), n(same).alias("unchanged"), n(blank).alias("blank"), n(lost).alias("numbers_lost"), F.round(1 - n(same | blank | lost) / F.greatest(F.count("*"), F.lit(1)), 3).alias("score"))


def queue_positions(tasks: DataFrame) -> DataFrame:
    """Waiting tasks (id, state, created, queue) with their place in their queue, from 1."""
    return tasks.where("state = 'waiting'").withColumn("place", F.row_number().over(Window.partitionBy("queue").orderBy("created", "id"))).select("id", "queue", "place")


def writeback(plan: DataFrame, blocks: DataFrame) -> DataFrame:
    """``blocks`` (id, y, height) without those the plan (id, action) blocks, shifted down by their height where it says so."""
    joined = blocks.join(plan, "id", "left").where(F.coalesce("action", F.lit("keep")) != "block")
    return joined.select("id", F.when(F.col("action") == "shift_down", F.col("y") + F.col("height")).otherwise(F.col("y")).alias("y"))


def symbol_share(text: Column, symbols: str = "=<>+-*/^_{}") -> Column:
    """Share of mathematical characters in a text."""
    n = F.length(text)
    return F.when(n == 0, 0.0).otherwise(sum((occurrences(text, s) for s in symbols), F.lit(0)) / n)


def estimate(text: Column, layout: Column, coverage: Column) -> Column:
    """Confidence of a translation: layout times coverage (0.3 at least), less for very short texts and formulas."""
    value = layout * F.when(F.length(text) < 4, 0.9).otherwise(1.0) * F.when(symbol_share(text) > 0.3, 0.85).otherwise(1.0) * F.greatest(F.lit(0.3), coverage)
    return F.when(F.length(text) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def model_for(is_formula: Column, domain: Column, confidence: Column) -> Column:
    """Strong model for formulas, exact sciences and doubtful texts."""
    return F.when(is_formula | domain.isin("mathematics", "physics") | (confidence < 0.5), "strong").otherwise("fast")
