"""Joins that documents ask for: as-of, nearest host, containment by words, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: list[str], carry: list[str], prefix: str = "host_") -> DataFrame:
    """Each left row with the last right row of its group that is not after it.

    Both sides are merged and sorted once by ``by`` and ``at`` (a union and one
    window, no join): right rows come before left rows at the same place. Left
    rows without one get nulls.
    """
    marked = F.struct(*(F.col(c) for c in carry))
    kinds = dict(left.dtypes)
    a = left.withColumns({"_side": F.lit(1), "_host": F.lit(None).cast(right.select(marked.alias("m")).schema["m"].dataType)})
    b = right.select(*by, *at, F.lit(0).alias("_side"), marked.alias("_host"), *(F.lit(None).cast(kinds[c]).alias(c) for c in left.columns if c not in (*by, *at)))
    order = Window.partitionBy(*by).orderBy(*at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("_host", F.last("_host", ignorenulls=True).over(order)).where("_side = 1")
    return both.select(*left.columns, *(F.col(f"_host.{c}").alias(prefix + c) for c in carry))


def nearest_host(left: DataFrame, right: DataFrame, by: list[str], at: str, id: str, prefix: str = "host_") -> DataFrame:
    """Each left row with the right row of its group nearest in ``at`` (a number), ties to the earlier one, then the smaller id.

    Of the right rows at or before and at or after a left row only the next ones can be
    nearest, so two running windows over the merged rows find it.
    """
    kinds = dict(left.dtypes)
    a = left.withColumns({"_side": F.lit(1), "_h": F.lit(None).cast(f"struct<at:{kinds[at]},id:{dict(right.dtypes)[id]}>")})
    heads = right.groupBy(*by, at).agg(F.min(id).alias(id))
    b = heads.select(*by, at, F.struct(F.col(at).alias("at"), F.col(id).alias("id")).alias("_h"), *(F.lit(None).cast(kinds[c]).alias(c) for c in left.columns if c not in (*by, at)))
    both = a.unionByName(b.withColumn("_side", F.lit(0)))
    before = Window.partitionBy(*by).orderBy(F.col(at), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(F.col(at), F.col("_side").desc()).rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("_p", F.last("_h", ignorenulls=True).over(before)).withColumn("_n", F.first("_h", ignorenulls=True).over(after)).where("_side = 1")
    gap = lambda c: F.abs(F.col(f"{c}.at") - F.col(at))
    pick = F.when(F.col("_p").isNull(), F.col("_n")).when(F.col("_n").isNull(), F.col("_p")).when(gap("_n") < gap("_p"), F.col("_n")).otherwise(F.col("_p"))
    return both.withColumn("_best", pick).select(*left.columns, F.col("_best.id").alias(prefix + "id"), F.col("_best.at").alias(prefix + "at"))


def word_hits(texts: DataFrame, terms: DataFrame, id: str, text: str = "text", term: str = "term") -> DataFrame:
    """Rows (id, term, hits): how often each one-word term stands in each text, by an equi-join on words.

    Words are pre-counted per text, so a common word makes one row per text.
    """
    words = texts.select(id, F.explode(F.split(F.lower(text), " ")).alias("term")).where("term <> ''").groupBy(id, "term").agg(F.count("*").alias("hits"))
    return words.join(terms.select(F.lower(term).alias("term")).distinct(), "term").select(id, "term", "hits")


def membership(tables: dict[str, DataFrame], id: str = "id") -> DataFrame:
    """Rows (id, members, coverage): which of the named tables hold each id."""
    parts = [t.select(F.col(id).alias("id")).distinct().withColumn("name", F.lit(n)) for n, t in tables.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("members"), F.count("*").alias("coverage"))


def coverage_counts(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row (total, present, missing) of the keys of ``before`` in ``after``."""
    have = after.select(*keys).distinct().withColumn("_in", F.lit(1))
    marked = before.select(*keys).join(have, keys, "left")
    return marked.agg(F.count("*").alias("total"), F.count("_in").alias("present"), F.count(F.when(F.col("_in").isNull(), 1)).alias("missing"))


def glossary_lookup(terms: DataFrame, glossary: DataFrame) -> DataFrame:
    """Rows (term, target): exact, then lower-case, then the longest glossary key inside the term.

    Keys inside a term are found by its own runs of words, an equi-join, so the
    glossary may have any size.
    """
    words = F.split(F.lower("term"), " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(i, F.size(words)), lambda j: F.array_join(F.slice(words, i, j - i + 1), " "))))
    runs = terms.select("term", F.explode(F.array_distinct(spans)).alias("key"))
    keys = glossary.select(F.lower("source").alias("key"), "source", "target", "seq")
    rank = F.struct((F.col("source") == F.col("term")).alias("exact"), F.length("key").alias("n"), (-F.col("seq")).alias("s"))
    found = runs.join(keys, "key").groupBy("term").agg(F.max_by("target", rank).alias("target"))
    return terms.select("term").distinct().join(found, "term", "left")


def link_target(links: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """Each link (id, lx0..ly1) with the first box (seq, x0..y1) of its group that holds its centre, else the one of most overlap."""
    cx, cy = (F.col("lx0") + F.col("lx1")) / 2, (F.col("ly0") + F.col("ly1")) / 2
    inside = F.col("x0").__le__(cx) & (cx <= F.col("x1")) & (F.col("y0") <= cy) & (cy <= F.col("y1"))
    w = F.greatest(F.least("x1", "lx1") - F.greatest("x0", "lx0"), F.lit(0.0))
    h = F.greatest(F.least("y1", "ly1") - F.greatest("y0", "ly0"), F.lit(0.0))
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    iou = w * h / (area("") + area("l") - w * h)
    pairs = links.join(boxes, by).withColumn("_in", inside).withColumn("_iou", iou).where("_in or _iou > 0")
    best = F.struct(F.col("_in"), F.when(F.col("_in"), F.lit(0.0)).otherwise(F.col("_iou")), (-F.col("seq")).alias("s"))
    return pairs.groupBy("id").agg(F.max_by("seq", best).alias("target"))


def first_rule(rules: list[tuple[str, Column]], default: str) -> Column:
    """Name of the first rule that holds."""
    out = F.lit(default)
    for name, test in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out


def rollout_bucket(user: Column) -> Column:
    """Stable bucket 0-99 of a user: the first eight hex digits of md5("user:" + id), modulo 100."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit("user:"), user.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") % 100).cast("bigint")


def caption_hosts(blocks: DataFrame, hosts: list[str], by: str = "doc_id", at: str = "block_idx") -> DataFrame:
    """Each caption with the latest preceding block of a host kind, or null."""
    order = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    host = F.last(F.when(F.col("kind").isin(*hosts), F.col(at)), ignorenulls=True).over(order)
    return blocks.withColumn("host", host).where("kind = 'caption'").select(by, at, "host")
