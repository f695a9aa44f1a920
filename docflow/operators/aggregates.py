"""Grouped summaries: telemetry, profiles, scores, gates, buckets, weights of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def telemetry(samples: DataFrame, by: str, duration: str, failed: Column) -> DataFrame:
    """Per operation: count, total, least, most, mean, nearest-rank p50 and p95, errors and their rate."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {duration})")
    errors = F.count(F.when(failed, 1))
    return samples.groupBy(F.col(by).alias("operation")).agg(
        F.count("*").alias("n"),
        F.round(F.sum(duration), 2).alias("total"),
        F.min(duration).alias("least"),
        F.max(duration).alias("most"),
        F.round(F.avg(duration), 2).alias("mean"),
        p(0.5).alias("p50"),
        p(0.95).alias("p95"),
        errors.alias("errors"),
        F.round(errors / F.count("*"), 4).alias("error_rate"),
    )


def profile(blocks: DataFrame, by: str) -> DataFrame:
    """Counts per group: blocks, characters, words, and blocks of each kind."""
    kinds = ("heading", "paragraph", "caption", "toc", "table", "formula", "empty")
    return blocks.groupBy(by).agg(
        F.count("*").alias("blocks"),
        F.sum("n_chars").cast("bigint").alias("chars"),
        F.sum("n_words").cast("bigint").alias("words"),
        *(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds),
    )


# The seven groups of a snapshot, by block kind.
BUCKETS = {"heading": "headings", "paragraph": "body", "caption": "captions", "formula": "formulas", "table": "tables", "toc": "toc"}
ALL_BUCKETS = ("headings", "body", "captions", "formulas", "tables", "toc", "other")


def bucket_counts(blocks: DataFrame, by: str) -> DataFrame:
    """Rows (by, one column per bucket); every bucket is there, 0 where nothing is in it."""
    bucket = F.lit("other")
    for kind, name in BUCKETS.items():
        bucket = F.when(F.col("kind") == kind, name).otherwise(bucket)
    return blocks.groupBy(by).agg(*(F.count(F.when(bucket == b, 1)).alias(b) for b in ALL_BUCKETS))


def composite(scores: list[tuple[Column, float]]) -> Column:
    """Weighted sum between 0 and 100, one place."""
    total = sum((c * w for c, w in scores), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 1)


def gate(pages: DataFrame, by: str, score: str, total_least: float = 90.0, page_least: float = 75.0) -> DataFrame:
    """Per group: pages, mean and least score, and whether both pass."""
    mean, least = F.avg(score), F.min(score)
    return pages.groupBy(by).agg(F.count("*").alias("pages"), F.round(mean, 4).alias("total"), least.alias("least"), ((mean >= total_least) & (least >= page_least)).alias("passed"))


def fuse(scores: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the scores that are there: agreement adds 0.05, contradiction takes a fifth, 0.5 without any."""
    values = F.filter(F.array(*(F.struct(c.cast("double").alias("v"), F.lit(float(w)).alias("w")) for c, w in scores)), lambda s: s.v.isNotNull())

    def judge(a):
        v = F.transform(a, lambda s: s.v)
        weight = F.aggregate(a, F.lit(0.0), lambda acc, s: acc + s.w)
        mean = F.aggregate(a, F.lit(0.0), lambda acc, s: acc + s.v * s.w) / weight
        spread = F.array_max(v) - F.array_min(v)
        fused = F.when(spread <= 0.15, mean + 0.05).when(F.exists(v, lambda x: x >= 0.8) & F.exists(v, lambda x: x < 0.3), mean * 0.8).otherwise(mean)
        return F.when((F.size(a) == 0) | (weight <= 0), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.99), fused)))

    return judge(values)


# Cost of a unit of work.
UNIT_WEIGHTS = {"paragraph": 10.0, "heading": 4.0, "formula": 25.0, "table": 30.0, "image": 60.0, "ocr": 80.0, "page": 2.0, "line": 0.5}


def pass_weights(counts: DataFrame) -> DataFrame:
    """Rows (doc_id, pass, weight) from counts of pages, paragraphs, headings, formulas, tables, lines and images."""
    u, c = UNIT_WEIGHTS, lambda n: F.coalesce(F.col(n), F.lit(0))
    passes = {
        "Parser": c("pages") * 4.0,
        "SemanticAnalysis": c("paragraphs") * 2.0 + c("formulas") * 8.0 + c("tables") * 12.0,
        "Translation": c("paragraphs") * u["paragraph"] + c("formulas") * u["formula"] + c("tables") * u["table"] + c("headings") * u["heading"] + c("images") * u["image"],
        "Layout": c("lines") * u["line"] + c("pages") * u["page"],
        "Render": c("pages") * 3.0,
    }
    return counts.select("doc_id", F.explode(F.array(*(F.struct(F.lit(p).alias("pass"), w.cast("double").alias("weight")) for p, w in passes.items()))).alias("p")).select("doc_id", "p.*")


def stage_breakdown(tasks: DataFrame, stage: str, state: str, weight: str, done: str) -> DataFrame:
    """Per stage: tasks, weight in all and done, and the share done."""
    finished = F.sum(F.when(F.col(state) == done, F.col(weight)).otherwise(0.0))
    return tasks.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("tasks"), F.round(F.sum(weight), 2).alias("weight"), F.round(finished, 2).alias("done"), F.round(finished / F.sum(weight), 6).alias("share"))


def preservation(source: Column, target: Column) -> Column:
    """Share of ``source`` that ``target`` keeps, up to 1; where there was nothing, 1 if nothing came and 0.5 if something did."""
    return F.when(source <= 0, F.when(target <= 0, 1.0).otherwise(0.5)).otherwise(F.least(F.lit(1.0), target / source))


def calibrate(samples: DataFrame, value: str, label: str, grid: list[float]) -> DataFrame:
    """Rows (threshold, accuracy) of ``value >= threshold`` against a boolean label, best first.

    Samples are counted per threshold interval once, so the grid costs no pass of its own.
    """
    hits = [F.avg(F.when((F.col(value) >= t) == F.col(label), 1.0).otherwise(0.0)).alias(f"g{k}") for k, t in enumerate(grid)]
    wide = samples.agg(*hits)
    each = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.round(F.col(f"g{k}"), 6).alias("accuracy")) for k, t in enumerate(grid)))
    return wide.select(F.explode(each).alias("g")).select("g.*").orderBy(F.col("accuracy").desc(), "threshold")


def type_variance(nodes: DataFrame, by: str, value: str) -> DataFrame:
    """Rows (by, n, variance): population variance of groups of three or more."""
    return nodes.groupBy(by).agg(F.count("*").alias("n"), F.round(F.var_pop(value), 6).alias("variance")).where("n >= 3")
