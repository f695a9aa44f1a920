"""Records of a run: statistics, reports, states, memories, node paths, replay and graph edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits, states and scores of a run.
RING, LEAST_CONSISTENCY, LEAST_ROLE_CONFIDENCE = 10_000, 0.8, 0.55
TERMINAL = ("finished", "failed", "skipped", "cancelled")
OPEN_TYPES = ("paragraph", "unknown")
URGENT = ("error", "critical")


def _n(test: Column) -> Column:
    return F.count(F.when(test, 1))


def translation_stats(results: DataFrame, *by: str) -> DataFrame:
    """Rows (by, total, translated, cached, failed, latency, avg_latency) of results (status, latency_ms).

    The average is over what was translated; without any, over one. Sums of
    groups add up, so parts of a run can be merged.
    """
    done = F.col("status") == "translated"
    one = results.groupBy(*by).agg(F.count("*").alias("total"), _n(done).alias("translated"), _n(F.col("status") == "cached").alias("cached"), _n(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("latency"))
    return one.withColumn("avg_latency", F.col("latency") / F.greatest("translated", F.lit(1)))


def resource_report(usage: DataFrame, *by: str) -> DataFrame:
    """Rows (by, operations, total_time, avg_time, max_time, min_time) of samples (elapsed)."""
    return usage.groupBy(*by).agg(F.count("*").alias("operations"), F.sum("elapsed").alias("total_time"), F.avg("elapsed").alias("avg_time"), F.max("elapsed").alias("max_time"), F.min("elapsed").alias("min_time"))


def diagnostic_report(records: DataFrame, *by: str) -> DataFrame:
    """Rows (by, total, passed, failed, pass_rate) of records (passed); the rate is in percent, 0 without any."""
    one = records.groupBy(*by).agg(F.count("*").alias("total"), _n(F.col("passed")).alias("passed"))
    return one.withColumns({"failed": F.col("total") - F.col("passed"), "pass_rate": F.col("passed") / F.greatest("total", F.lit(1)) * 100.0})


def newest(samples: DataFrame, order: list[str], n: int = RING) -> DataFrame:
    """The ``n`` newest samples, as a ring of that size holds them (a bounded top-k)."""
    return samples.orderBy(*(F.col(c).desc() for c in order)).limit(n)


def ring_counts(samples: DataFrame, by: str, order: list[str], n: int = RING) -> DataFrame:
    """Rows (by, count, errors, kept): counters over all samples (success), and how many of them the ring still has."""
    counted = samples.groupBy(by).agg(F.count("*").alias("count"), _n(~F.col("success")).alias("errors"))
    kept = newest(samples, order, n).groupBy(by).agg(F.count("*").alias("kept"))
    return counted.join(kept, by, "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


def counted(events: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows (reason, n)."""
    return events.groupBy(reason).agg(F.count("*").alias("n"))


def decisions(log: DataFrame, node=None, stage: str | None = None) -> DataFrame:
    """The decisions (node, stage, ...) of a node, of a stage, or of both."""
    for name, value in (("node", node), ("stage", stage)):
        log = log if value is None else log.where(F.col(name) == value)
    return log


def unresolved(found: DataFrame) -> DataFrame:
    """Diagnostics (severity, repaired) of an urgent severity that no repair has mended."""
    return found.where(~F.coalesce("repaired", F.lit(False)) & F.col("severity").isin(*URGENT))


def cause_chain(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (id, relation, target): each diagnostic (id, message) with the messages of those it points at."""
    heads = found.select("id", F.lit(None).cast("string").alias("relation"), F.col("message").alias("target"))
    ends = found.select(F.col("id").alias("dst"), F.col("message").alias("target"))
    known = edges.join(found.select(F.col("id").alias("src")), "src", "left_semi").join(ends, "dst")
    return heads.unionByName(known.select(F.col("src").alias("id"), "relation", "target"))


def progress_state(items: DataFrame, *by: str) -> DataFrame:
    """Weights of work items (state, weight, partial from 0 to 1) by state, and the percentage done.

    A running item counts with its part. Rows (by, total_weight,
    finished_weight, running_weight, queued_weight, failed_weight, percentage,
    finished_tasks, total_tasks).
    """
    weight = lambda s: F.coalesce(F.sum(F.when(F.col("state") == s, F.col("weight"))), F.lit(0.0))
    part = F.coalesce(F.sum(F.when(F.col("state") == "running", F.col("weight") * F.least(F.greatest("partial", F.lit(0.0)), F.lit(1.0)))), F.lit(0.0))
    names = ("finished", "running", "queued", "failed")
    one = items.groupBy(*by).agg(F.sum("weight").alias("total_weight"), *(weight(s).alias(f"{s}_weight") for s in names), part.alias("_part"), _n(F.col("state") == "finished").alias("finished_tasks"), F.count("*").alias("total_tasks"))
    done = (F.col("finished_weight") + F.col("_part")) / F.nullif(F.col("total_weight"), F.lit(0.0)) * 100.0
    return one.withColumn("percentage", F.coalesce(done, F.lit(0.0))).drop("_part")


def lifecycle(updates: DataFrame, task: str, order: list[str]) -> DataFrame:
    """Rows (task, state, n_ignored): the state after a task's updates (state); what follows a terminal one is ignored.

    Two aggregates by task, no ordered fold: the first terminal update, or else
    the last update, decides.
    """
    at = F.struct(*order)
    ends = F.col("state").isin(*TERMINAL)
    first = F.min(F.when(ends, F.struct(at.alias("at"), "state")))
    one = updates.groupBy(task).agg(first.alias("_end"), F.max(F.struct(at.alias("at"), "state")).alias("_last"))
    state = F.coalesce("_end.state", "_last.state")
    late = updates.join(one.where("_end is not null").select(task, F.col("_end.at").alias("_at")), task).where(at > F.col("_at")).groupBy(task).agg(F.count("*").alias("n_ignored"))
    return one.select(task, state.alias("state")).join(late, task, "left").withColumn("n_ignored", F.coalesce("n_ignored", F.lit(0)))


def until_terminal(events: DataFrame, task: str, order: list[str]) -> DataFrame:
    """The events of each task that a subscriber sees: all up to and including the first terminal one."""
    at = F.struct(*order)
    ends = events.where(F.col("state").isin(*TERMINAL)).groupBy(task).agg(F.min(at).alias("_end"))
    return events.join(ends, task, "left").where(F.col("_end").isNull() | (at <= F.col("_end"))).drop("_end")


# -------------------------------------------------------------- node paths


def node_path(id: Column, mark: str = "::") -> Column:
    """Struct (doc_id, parent, kind, seq, depth) of an id such as ``D::P1::B2``; a bare document has no parent."""
    parts = F.split(id, mark)
    n = F.size(parts)
    last = F.element_at(parts, -1)
    return F.struct(
        parts[0].alias("doc_id"),
        F.when(n > 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(1))), mark)).alias("parent"),
        F.when(n > 1, F.regexp_extract(last, "^([^0-9]*)", 1)).otherwise("document").alias("kind"),
        F.when(n > 1, F.regexp_extract(last, "([0-9]+)$", 1)).alias("seq"),
        (n - 1).alias("depth"),
    )


def child_ids(rows: DataFrame, parent: str, kind: Column, order: list[str], mark: str = "::") -> DataFrame:
    """``rows`` with ``id``: the parent's, and the row's kind and place among its siblings of that kind, from 0."""
    place = F.row_number().over(Window.partitionBy(parent, "_kind").orderBy(*order)) - 1
    return rows.withColumn("_kind", kind).withColumn("id", F.concat_ws(mark, F.col(parent), F.concat("_kind", place.cast("string")))).drop("_kind")


def canonical_json(values: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def get_path(json: Column, path: str) -> Column:
    """What a dotted path names in a JSON text, as text; null where it does not lead anywhere."""
    return F.get_json_object(json, "$." + path)


# ---------------------------------------------------- memory, replay, drift


def merge_memory(own: DataFrame, other: DataFrame, key: str, value: str, overwrite: bool = False) -> DataFrame:
    """Rows (key, value) of both memories; ``own`` wins unless ``overwrite``."""
    a, b = own.select(key, F.col(value).alias("_a")), other.select(key, F.col(value).alias("_b"))
    first, second = ("_b", "_a") if overwrite else ("_a", "_b")
    return a.join(b, key, "full").select(key, F.coalesce(first, second).alias(value))


def replay(inputs: DataFrame, memo: DataFrame, stage: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """``inputs`` with ``output`` and ``source``: the memo's (hash, output) where it has the text's hash, else the stage's.

    A hash that the memo has twice gives its least output.
    """
    known = memo.groupBy("hash").agg(F.min("output").alias("_known"))
    rows = inputs.withColumn("hash", F.sha2(F.col(text), 256)).join(known, "hash", "left")
    hit = F.col("_known").isNotNull()
    return rows.withColumns({"source": F.when(hit, "memo").otherwise("run"), "output": F.when(hit, F.col("_known")).otherwise(stage(F.col(text)))}).drop("_known")


def regression(record: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows (stem, passed, n_changed, missing) of stage hashes (stem, stage, hash) against a baseline's.

    A stage that one side lacks counts as changed; a case without any baseline
    stage fails as missing.
    """
    a, b = record.withColumnRenamed("hash", "_a"), baseline.withColumnRenamed("hash", "_b")
    own = record.select("stem").distinct()
    both = a.join(b, ["stem", "stage"], "full").join(own, "stem", "left_semi")
    one = both.groupBy("stem").agg(_n(~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_changed"), F.count("_b").alias("_base"))
    return one.select("stem", ((F.col("_base") > 0) & (F.col("n_changed") == 0)).alias("passed"), "n_changed", (F.col("_base") == 0).alias("missing"))


def needs_review(results: DataFrame, least: float = LEAST_CONSISTENCY) -> DataFrame:
    """Rows (id, reason) of results (id, status, consistency) that failed or are less consistent than asked."""
    reason = F.when(F.col("status") == "failed", "failed").when(F.col("consistency") < least, "low consistency")
    return results.select("id", reason.alias("reason")).where("reason is not null")


def fuse_roles(nodes: DataFrame, roles: DataFrame, least: float = LEAST_ROLE_CONFIDENCE) -> DataFrame:
    """``nodes`` (id, node_type) with the role that a classifier (id, role, confidence) gives them, and ``fused``.

    ``fused`` is adopted, kept (a more special type stays) or none (no role of
    enough confidence). Of several roles of a node the surest counts.
    """
    best = roles.where(F.col("confidence") >= least).groupBy("id").agg(F.max_by("role", F.struct("confidence", "role")).alias("_role"))
    both = nodes.join(best, "id", "left")
    free = F.col("node_type").isin(*OPEN_TYPES) | (F.col("node_type") == F.col("_role"))
    fused = F.when(F.col("_role").isNull(), "none").when(free, "adopted").otherwise("kept")
    return both.withColumn("fused", fused).withColumn("node_type", F.when(F.col("fused") == "adopted", F.col("_role")).otherwise(F.col("node_type"))).drop("_role")


def merge_rows(a: DataFrame, b: DataFrame, by: str, order: list[str], similarity: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows (by, left_rows, right_rows, matched, similarity, displacement) of two row sets paired by their place.

    Pairs of a similarity of 0.5 match; the displacement is that of the boxes'
    centres. Rows beyond the shorter side have no pair.
    """
    place = Window.partitionBy(by).orderBy(*order)
    side = lambda d, s: d.select(by, F.row_number().over(place).alias("_k"), *(F.col(c).alias(f"{s}{c}") for c in ("text", "x0", "y0", "x1", "y1")))
    both = side(a, "a_").join(side(b, "b_"), [by, "_k"], "full")
    mid = lambda s, c: (F.col(f"{s}{c}0") + F.col(f"{s}{c}1")) / 2
    pair = F.col("a_x0").isNotNull() & F.col("b_x0").isNotNull()
    alike = F.when(pair, similarity(F.col("a_text"), F.col("b_text")))
    moved = F.when(pair, F.hypot(mid("a_", "x") - mid("b_", "x"), mid("a_", "y") - mid("b_", "y")))
    rows = both.select(by, "a_x0", "b_x0", alike.alias("_s"), moved.alias("_d"))
    return rows.groupBy(by).agg(F.count("a_x0").alias("left_rows"), F.count("b_x0").alias("right_rows"), _n(F.col("_s") >= 0.5).alias("matched"), F.avg("_s").alias("similarity"), F.avg("_d").alias("displacement"))


# ------------------------------------------------------------- graph edits


def put_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``nodes`` with those of ``new``, which replace the ones of the same id."""
    return nodes.join(new.select("id"), "id", "left_anti").unionByName(new)


def drop_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of ``gone`` (id) and without every edge at one of them."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(*edges.columns)


def drop_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """``edges`` without those of ``gone`` (src, dst, and relation if it has that column)."""
    return edges.join(gone, [c for c in ("src", "dst", "relation") if c in gone.columns], "left_anti")


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges that start or end at a node of ``ids`` (id), each once."""
    own = ids.select("id").distinct()
    starts = edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi")
    return starts.unionByName(edges.join(own.withColumnRenamed("id", "src"), "src", "left_anti").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi"))


# Names under which other graphs have the fields of a node and an edge.
NODE_FIELDS = {"id": ("id", "node_id", "key", "name"), "node_type": ("node_type", "kind", "type", "label")}
EDGE_FIELDS = {"src": ("src", "source_id", "source", "from"), "dst": ("dst", "target_id", "target", "to"), "relation": ("relation", "edge_type", "type", "kind")}


def adapted(rows: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """``rows`` under the common field names; the first known name is taken, a field without one is null."""
    have = set(rows.columns)
    pick = lambda names: next((F.col(n) for n in names if n in have), F.lit(None))
    return rows.select(*(pick(names).cast("string").alias(field) for field, names in fields.items()))


def dump(rows: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group, for looking at (a bounded top-k)."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= most).drop("_k")
