"""Queries of the evaluation operators, each beside its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import evaluate
from .queries import BLOCKS, BOXES, PAIRS, boxes, pairs, query
from .sources import blocks as model

SIDES = f"{BLOCKS}, src AS (SELECT *, block_idx // 8 AS page FROM blocks), tgt AS (SELECT *, block_idx // 8 AS page FROM blocks WHERE block_idx % 7 <> 3)"


def sides(t):
    b = model.text_blocks(t("documents")).withColumn("page", F.floor(F.col("block_idx") / 8))
    return b, b.where("block_idx % 7 <> 3")


@query(f"""WITH {SIDES}, a AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_idx) AS k, n_chars AS x, block_idx AS y FROM src), b AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY block_idx) AS k, n_chars AS x, block_idx AS y FROM tgt),
d AS (SELECT doc_id, page, count(*) AS pairs, avg(abs(b.x - a.x)) AS dx, avg(abs(b.y - a.y)) AS dy FROM a JOIN b USING (doc_id, page, k) GROUP BY doc_id, page)
SELECT doc_id, page, pairs, round(dx, 4) AS mean_dx, round(dy, 4) AS mean_dy, round(sqrt(dx * dx + dy * dy), 4) AS mean_drift FROM d""")
def q_drift(t, spark):
    a, b = (s.withColumns({"x0": F.col("n_chars").cast("double"), "y0": F.col("block_idx").cast("double")}) for s in sides(t))
    d = evaluate.drift(a, b, ["doc_id", "page"], ["block_idx"])
    return d.withColumns({c: F.round(c, 4) for c in ("mean_dx", "mean_dy", "mean_drift")})


PROFILE = "count(*) FILTER (WHERE kind = 'heading') AS headings, count(*) FILTER (WHERE kind = 'caption') AS captions, count(*) FILTER (WHERE kind = 'toc') AS toc, count(*) FILTER (WHERE kind = 'formula') AS formulas, count(DISTINCT page) AS pages, count(*) AS lines, sum(n_chars) AS chars, sum(length(text) - length(regexp_replace(text, '[äöüß]', '', 'g'))) AS cjk, count(*) FILTER (WHERE n_words > 20) AS latin, avg(CASE WHEN kind = 'empty' THEN 1.0 ELSE 0.1 END) AS white"


def profile(b):
    n = lambda test: F.count(F.when(test, 1))
    kind = lambda k: n(F.col("kind") == k)
    special = F.length("text") - F.length(F.regexp_replace("text", "[äöüß]", ""))
    return b.groupBy("doc_id").agg(
        kind("heading").alias("headings"), kind("caption").alias("captions"), kind("toc").alias("toc_entries"), kind("formula").alias("formulas"),
        F.countDistinct("page").alias("pages"), F.count("*").alias("lines"), F.sum("n_chars").alias("chars"), F.sum(special).alias("cjk_chars"),
        n(F.col("n_words") > 20).alias("latin_lines"), F.avg(F.when(F.col("kind") == "empty", 1.0).otherwise(0.1)).alias("whitespace"),
    )


KEPT = "CASE WHEN a.{0} <= 0 THEN CASE WHEN b.{0} <= 0 THEN 1.0 ELSE 0.5 END ELSE least(1.0, b.{0}::DOUBLE / a.{0}) END"


@query(f"""WITH {SIDES}, a AS (SELECT doc_id, {PROFILE} FROM src GROUP BY doc_id), b AS (SELECT doc_id, {PROFILE}, (doc_id % 5) / 50.0 AS collision, (doc_id % 3) / 30.0 AS overflow FROM tgt GROUP BY doc_id),
o AS (SELECT doc_id, avg(least(x, y)::DOUBLE / greatest(x, y)) AS oc FROM (SELECT doc_id, page, count(*) AS x FROM src GROUP BY ALL) JOIN (SELECT doc_id, page, count(*) AS y FROM tgt GROUP BY ALL) USING (doc_id, page) GROUP BY doc_id),
s AS (SELECT doc_id, 100 * greatest(0, 1 - collision - overflow - abs(b.pages - a.pages)::DOUBLE / a.pages) AS g, 100 * (0.35 * {KEPT.format('headings')} + 0.2 * {KEPT.format('captions')} + 0.15 * {KEPT.format('toc')} + 0.1 * {KEPT.format('formulas')} + 0.2 * coalesce(oc, 1)) AS st,
100 * (0.5 * CASE WHEN b.chars <= 0 THEN 0 ELSE b.cjk::DOUBLE / b.chars END + 0.3 * (1 - least(1.0, b.latin::DOUBLE / a.lines)) + 0.2 * CASE WHEN a.chars <= 0 THEN 1 ELSE least(1.5, b.chars::DOUBLE / a.chars) END) AS tr,
100 * (0.4 * (1 - collision) + 0.25 * (1 - overflow) + 0.2 * greatest(0, least(1, 1 - b.white * 2)) + 0.15 * greatest(0, least(1, 1 - abs(b.lines::DOUBLE / b.pages - 40) / 40))) AS r FROM a JOIN b USING (doc_id) LEFT JOIN o USING (doc_id))
SELECT doc_id, round(g::DOUBLE, 4) AS geometry_score, round(st::DOUBLE, 4) AS structure_score, round(tr::DOUBLE, 4) AS translation_score, round(r::DOUBLE, 4) AS rendering_score, round((0.3 * g + 0.2 * st + 0.25 * tr + 0.25 * r)::DOUBLE, 4) AS overall FROM s""")
def q_evaluation(t, spark):
    a, b = sides(t)
    target = profile(b).join(evaluate.order_consistency(a, b, "doc_id", "page"), "doc_id", "left")
    target = target.withColumns({"collision": (F.col("doc_id") % 5) / 50.0, "overflow": (F.col("doc_id") % 3) / 30.0})
    s = evaluate.scores(profile(a), target, "doc_id")
    return s.select("doc_id", *(F.round(c, 4).alias(c) for c in s.columns if c != "doc_id"))


@query(f"""WITH {PAIRS}, l AS (SELECT doc_id, lower(coalesce(text, '')) AS a, lower(coalesce(other, '')) AS b FROM pairs)
SELECT doc_id, round((1.0 - CASE WHEN contains(a, 'the') AND NOT contains(b, 'der') THEN 0.1 ELSE 0 END - CASE WHEN contains(a, 'und') AND NOT contains(b, 'and') THEN 0.1 ELSE 0 END - CASE WHEN contains(a, 'tion') AND NOT contains(b, 'tion') THEN 0.05 ELSE 0 END)::DOUBLE, 4) AS score FROM l""")
def q_consistency(t, spark):
    score = evaluate.consistency(F.col("text"), F.col("other"), {"The": "der", "und": "and"}, ("tion",))
    return pairs(t).select("doc_id", F.round(score, 4).alias("score"))


@query("""WITH b AS (SELECT l_orderkey AS page, l_linenumber::BIGINT AS seq, min((l_partkey % 4) || '.' || (l_suppkey % 3) || ' part ' || (l_partkey % 5) || ' of it') AS text FROM lineitem GROUP BY 1, 2),
e AS (SELECT o_orderkey AS page, k AS seq, (k % 4) || '.' || (o_custkey % 3) AS number, 'part ' || (o_custkey % 5) AS title, 'p' || k AS target FROM orders, range(8) r(k)),
m AS (SELECT e.page, e.seq AS e, min(b.seq) AS b FROM e JOIN b ON e.page = b.page AND starts_with(text, number || ' ') AND contains(text, title) GROUP BY 1, 2), l AS (SELECT page, b AS seq, max(e) AS e FROM m GROUP BY 1, 2)
SELECT b.page, b.seq, CASE WHEN l.e IS NULL THEN 'paragraph' ELSE 'toc' END AS kind, e.number AS toc_number, e.title AS toc_title, e.target AS toc_page FROM b LEFT JOIN l USING (page, seq) LEFT JOIN e ON e.page = b.page AND e.seq = l.e""")
def q_annotated_contents(t, spark):
    s = lambda c, n: (F.col(c) % n).cast("string")
    text = F.concat(s("l_partkey", 4), F.lit("."), s("l_suppkey", 3), F.lit(" part "), s("l_partkey", 5), F.lit(" of it"))
    b = t("lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("bigint").alias("seq")).agg(F.min(text).alias("text")).withColumn("kind", F.lit("paragraph"))
    e = t("orders").select(F.col("o_orderkey").alias("page"), "o_custkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("seq"))
    e = e.select("page", "seq", F.concat(s("seq", 4), F.lit("."), s("o_custkey", 3)).alias("number"), F.concat(F.lit("part "), s("o_custkey", 5)).alias("title"), F.concat(F.lit("p"), F.col("seq").cast("string")).alias("target"))
    return evaluate.annotated_contents(b, e).select("page", "seq", "kind", "toc_number", "toc_title", "toc_page")


@query(f"""WITH {BOXES} SELECT page, 'b' || seq AS id, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN page % 2 = 0 THEN -seq END, y0, x0, 'b' || seq) - 1 AS position FROM boxes""")
def q_visual_order(t, spark):
    b = boxes(t).withColumn("id", F.concat(F.lit("b"), F.col("seq").cast("string")))
    # The pages of even number are read from their last box to the first one, by edges whose ends name the page.
    n = b.withColumn("node", F.concat_ws("_", F.col("page").cast("string"), "id"))
    back = n.alias("p").join(n.alias("q"), (F.col("p.page") == F.col("q.page")) & (F.col("p.seq") > F.col("q.seq"))).where("p.page % 2 = 0").select(F.col("p.node").alias("src"), F.col("q.node").alias("dst"))
    out = evaluate.visual_order(n.select("page", F.col("node").alias("id"), "x0", "y0"), back)
    return out.select("page", F.element_at(F.split("id", "_"), 2).alias("id"), "position")
