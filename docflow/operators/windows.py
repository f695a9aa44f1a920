"""Sequence operators: islands, carried sections, context, trailing rates, versions, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import folded


def islands(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of a group: a row for which ``starts`` holds opens a new one, from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    flag = F.when(F.row_number().over(w) == 1, 0).when(F.coalesce(starts, F.lit(False)), 1).otherwise(0)
    return df.withColumn("_s", flag).withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Rows (user_id, island, n, started, ended): a user's events until a pause longer than the gap."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pause = F.timestamp_diff("SECOND", before, F.col("ts")) if hasattr(F, "timestamp_diff") else F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(before.cast("timestamp"))
    marked = events.withColumn("_new", pause > gap_seconds)
    cut = islands(marked, ["user_id"], ["ts", "event_id"], F.col("_new"))
    return cut.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def carry_sections(blocks: DataFrame, outside: list[str] = ("header", "footer", "toc")) -> DataFrame:
    """``blocks`` with ``section``: the block_idx of the last heading at or before it, null outside sections."""
    w = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == "heading", F.col("block_idx")), ignorenulls=True).over(w)
    return blocks.withColumn("section", F.when(~F.col("kind").isin(*outside), last))


def context(rows: DataFrame, by: str, order: str, text: str = "text", before: int = 3, after: int = 2, sep: str = " / ") -> DataFrame:
    """``rows`` with ``before`` and ``after``: neighbouring texts in order; blank ones go after the neighbours are taken."""
    w = Window.partitionBy(by).orderBy(order)
    own = F.coalesce(F.col(text), F.lit(""))
    joined = lambda c: F.array_join(F.filter(c, lambda t: F.trim(t) != ""), sep)
    return rows.withColumn("before", joined(F.collect_list(own).over(w.rowsBetween(-before, -1)))).withColumn("after", joined(F.collect_list(own).over(w.rowsBetween(1, after))))


def split_by_ratio(blocks: DataFrame, ratio: float = 1.6) -> DataFrame:
    """``blocks`` with ``part``: a new part where a line is ``ratio`` times longer or shorter than the one before."""
    w = Window.partitionBy("doc_id").orderBy("block_idx")
    a, b = F.lag("n_chars").over(w).cast("double"), F.col("n_chars").cast("double")
    jump = (F.least(a, b) > 0) & (F.greatest(a, b) / F.nullif(F.least(a, b), F.lit(0.0)) >= ratio)
    return islands(blocks.withColumn("_j", jump), ["doc_id"], ["block_idx"], F.col("_j"), "part").drop("_j")


def trailing_rate(events: DataFrame, minutes: int) -> DataFrame:
    """``events`` with the number and the value of a user's events in the trailing window, itself included."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("_at").rangeBetween(-minutes * 60_000_000, 0)
    out = events.withColumn("_at", at)
    return out.withColumn("n_window", F.count("*").over(w)).withColumn("value_window", F.sum("value").over(w)).drop("_at")


def eta(progress: DataFrame, remaining: Column, window_seconds: int = 60) -> DataFrame:
    """``progress`` (task, ts seconds, done) with the seconds left at the rate of the trailing window, null with one sample."""
    w = Window.partitionBy("task").orderBy("ts").rangeBetween(-window_seconds, 0)
    span = F.col("ts") - F.first("ts").over(w)
    rate = (F.col("done") - F.first("done").over(w)) / F.nullif(span, F.lit(0))
    return progress.withColumn("eta", F.when(rate > 0, remaining / rate))


def smoothed(progress: DataFrame, alpha: float = 0.08, step: float = 0.1) -> DataFrame:
    """Rows (task, shown): the displayed percentage after a task's samples (ts, real), folded in time order.

    The share taken of each difference grows with the time since the sample
    before; what is shown never falls, and 100 is shown at once.
    """
    samples = F.array_sort(F.collect_list(F.struct("ts", "real")))

    def fold(acc, s):
        a = 1 - F.pow(F.lit(1 - alpha), F.greatest(F.lit(1.0), (s.ts - acc.ts) / step))
        moved = acc.shown + (s.real - acc.shown) * a
        return F.struct(s.ts.alias("ts"), F.when(s.real >= 100, 100.0).otherwise(F.greatest(acc.shown, moved)).alias("shown"))

    start = F.struct(F.col("s")[0].ts.alias("ts"), F.lit(0.0).alias("shown"))
    return progress.groupBy("task").agg(samples.alias("s")).select("task", F.aggregate("s", start, fold, lambda a: a.shown).alias("shown"))


def reading_edges(blocks: DataFrame, by: str, order: list[str], id: str) -> DataFrame:
    """(src, dst) of consecutive rows of a group."""
    return blocks.select(F.col(id).alias("src"), F.lead(id).over(Window.partitionBy(by).orderBy(*order)).alias("dst")).where("dst is not null")


def versions(edits: DataFrame, node: str, order: list[str]) -> DataFrame:
    """``edits`` with a number per node; the last of each is the current one."""
    w = Window.partitionBy(node).orderBy(*order)
    last = Window.partitionBy(node).orderBy(*[F.col(c).desc() for c in order])
    return edits.withColumn("version", F.row_number().over(w)).withColumn("current", F.row_number().over(last) == 1)


def undo_last(edits: DataFrame, node: str, order: list[str]) -> DataFrame:
    """``edits`` without the last of each node."""
    return versions(edits, node, order).where(~F.col("current")).drop("version", "current")


def section_parents(headings: DataFrame, by: str, order: str, level: str = "level") -> DataFrame:
    """``headings`` with ``parent``: the latest earlier heading of a lower level, whatever the number of levels.

    One running value per level that occurs gives the latest heading of it.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    depths = sorted(r[0] for r in headings.select(level).where(F.col(level).isNotNull()).distinct().collect())  # levels, not rows
    last = [F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(w) for k in depths]
    lower = [F.when(F.col(level) > k, x) for k, x in zip(depths, last)]
    best = F.greatest(*lower) if len(lower) > 1 else (lower[0] if lower else F.lit(None).cast("bigint"))
    return headings.withColumn("parent", best)


def outline(entries: DataFrame) -> DataFrame:
    """Rows (doc_id, seq, number, parent, depth) of table-of-contents entries (doc_id, seq, number, level).

    Dotted numbers stand under the entry that they extend, others under the last
    entry of a lower level, as a stack that is only ever popped. One document's
    entries at a time.
    """

    def build(rows: list) -> list[tuple]:
        out, stack = [], []
        for r in rows:
            number = r.number or ""
            while stack and not (number.startswith(stack[-1][1] + ".") if stack[-1][1] and "." in number else stack[-1][2] < r.level):
                stack.pop()
            out.append((r.doc_id, r.seq, number, stack[-1][0] if stack else -1, len(stack)))
            stack.append((r.seq, number, r.level))
        return out

    made = folded(entries, "doc_id", ["seq"], ["doc_id", "seq", "number", "level"], build, "doc_id bigint, seq bigint, number string, parent bigint, depth int")
    return made.withColumn("parent", F.when(F.col("parent") >= 0, F.col("parent")))


def paragraphs(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, paragraph, text): lines between blank ones, a hyphen at a line's end glued to the next line."""
    starts = blocks.withColumn("_blank", F.trim("text") == "")
    w = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    kept = starts.withColumn("paragraph", F.sum(F.col("_blank").cast("int")).over(w)).where("not _blank")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda x: F.trim(x.text))
    text = F.regexp_replace(F.array_join(lines, "\n"), "([A-Za-z])-\n([a-z])", "$1$2")
    return kept.groupBy("doc_id", "paragraph").agg(F.replace(text, F.lit("\n"), F.lit(" ")).alias("text"))


def upper_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows (by, median): the upper of two middle values, by ranks."""
    w = Window.partitionBy(by)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(by, F.col(value).alias("median"))


def weighted_mode(df: DataFrame, by: str, value: str, weight: str, seq: str) -> DataFrame:
    """Rows (by, mode, weight): the value of most weight, the first seen on a tie."""
    summed = df.groupBy(by, value).agg(F.sum(weight).alias("_w"), F.min(seq).alias("_s"))
    return summed.groupBy(by).agg(F.max_by(value, F.struct("_w", -F.col("_s"))).alias("mode"), F.max("_w").alias("weight"))
