"""Queries of the refinement operators, each beside its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import annotate, refine
from .queries import BLOCKS, BOXES, boxes, query
from .sources import blocks as model

STYLED = f"{BLOCKS}, styled AS (SELECT doc_id, block_idx, CASE WHEN block_idx % 5 = 2 THEN block_idx || '.1 ' || text WHEN block_idx % 5 = 3 THEN '* ' || text ELSE text END AS text, kind, (8 + (n_chars + block_idx) % 13)::DOUBLE AS font_size FROM blocks)"
BODY = "body AS (SELECT doc_id, coalesce(median(font_size) FILTER (WHERE kind = 'paragraph' AND font_size > 0), 12.0) AS body FROM styled GROUP BY doc_id)"


def styled(t):
    i = F.col("block_idx")
    made = F.when(i % 5 == 2, F.concat(i.cast("string"), F.lit(".1 "), "text")).when(i % 5 == 3, F.concat(F.lit("* "), "text")).otherwise(F.col("text"))
    return model.text_blocks(t("documents")).select("doc_id", "block_idx", made.alias("text"), "kind", (8 + (F.col("n_chars") + i) % 13).cast("double").alias("font_size"))


@query(f"WITH {STYLED}, {BODY} SELECT doc_id, body FROM body")
def q_body_font_size(t, spark):
    return refine.body_font_size(styled(t), "doc_id")


@query(rf"""WITH {STYLED}, {BODY}, j AS (SELECT doc_id, block_idx, kind, font_size, body, trim(text) AS x, kind = 'paragraph' AND regexp_matches(trim(text), '{refine.SECTION_NUMBER}') AND length(trim(text)) <= 80 AS numbered FROM styled JOIN body USING (doc_id)),
n AS (SELECT *, kind = 'paragraph' AND NOT numbered AND font_size > 0 AND font_size < body * 0.9 AND regexp_matches(x, '{refine.FOOTNOTE_MARK}') AS note FROM j)
SELECT doc_id, block_idx, CASE WHEN numbered THEN 'heading' WHEN note THEN 'footnote' ELSE kind END AS kind,
CASE WHEN kind = 'heading' THEN CASE WHEN font_size / body >= 1.8 THEN 1 WHEN font_size / body >= 1.4 THEN 2 WHEN font_size / body >= 1.15 THEN 3 ELSE 4 END WHEN numbered THEN 2 END AS heading_level,
CASE WHEN kind = 'heading' THEN 'font_ratio_heading' WHEN numbered THEN 'section_number_heading' WHEN note THEN 'font_size_footnote' END AS analysis FROM n""")
def q_refined_kinds(t, spark):
    return refine.refined(styled(t), "doc_id").select("doc_id", "block_idx", "kind", "heading_level", "analysis")


@query(f"WITH {BOXES} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY page")
def q_page_box(t, spark):
    return refine.page_box(boxes(t))


@query(f"""WITH {BOXES}, p AS (SELECT page, min(y0) AS lo, max(y1) AS hi FROM boxes GROUP BY page)
SELECT page, seq, CASE WHEN y1 >= hi - (hi - lo) * 0.1 THEN 'header' WHEN y0 < lo + (hi - lo) * 0.1 THEN 'footer' END AS edge FROM boxes JOIN p USING (page)""")
def q_margins(t, spark):
    return refine.margins(boxes(t)).select("page", "seq", "edge")


@query(f"""WITH {BOXES}, o AS (SELECT a.page, count(*) AS n_overlaps FROM boxes a JOIN boxes b ON a.page = b.page AND (a.y0 < b.y0 OR (a.y0 = b.y0 AND a.seq < b.seq)) AND a.y1 > b.y0
AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > least(a.x1 - a.x0, b.x1 - b.x0) * 0.3 GROUP BY a.page),
g AS (SELECT page, lead(y0) OVER (PARTITION BY page ORDER BY y0, seq) - y1 AS gap FROM boxes), v AS (SELECT page, coalesce(var_pop(gap) FILTER (WHERE gap > 0 AND gap < 50), 0) AS gap_variance FROM g GROUP BY page),
j AS (SELECT page, coalesce(n_overlaps, 0) AS n_overlaps, gap_variance FROM v LEFT JOIN o USING (page))
SELECT page, n_overlaps, round(gap_variance, 4) AS gap_variance, round(least(n_overlaps * 5.0, 25.0) + CASE WHEN gap_variance > 100 THEN least(gap_variance / 50, 10.0) ELSE 0 END, 4) AS penalty FROM j""")
def q_layout_quality(t, spark):
    return refine.layout_quality(boxes(t)).select("page", "n_overlaps", F.round("gap_variance", 4).alias("gap_variance"), F.round("penalty", 4).alias("penalty"))


TERMS = {"the": "T1", "of": "T2", "and": "T3", "der": "T4"}


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\bthes?\b', 'T1', 'gi'), '\bofs?\b', 'T2', 'gi'), '\bands?\b', 'T3', 'gi'), '\bders?\b', 'T4', 'gi') AS text FROM documents WHERE text IS NOT NULL AND NOT contains(text, '_')")
def q_glossary_applied(t, spark):
    return t("documents").where("text is not null and not contains(text, '_')").select("doc_id", refine.apply_glossary(F.col("text"), TERMS).alias("text"))


@query(rf"""WITH {BLOCKS}, made AS (SELECT doc_id, block_idx, text || ' see Fig. ' || (block_idx % 5 + 1) || ' and Figure ' || (block_idx % 13) AS text FROM blocks)
SELECT doc_id, block_idx, replace(replace(regexp_replace(regexp_replace(text, '\b(Fig(?:ure)?[.]?)\s*[.]?\s*2\b', '\1 <2>', 'gi'), '\b(Fig(?:ure)?[.]?)\s*[.]?\s*3\b', '\1 <3>', 'gi'), '<2>', '3'), '<3>', '12') AS text FROM made WHERE NOT contains(text, '<')""")
def q_renumbered(t, spark):
    i = F.col("block_idx")
    made = F.concat("text", F.lit(" see Fig. "), (i % 5 + 1).cast("string"), F.lit(" and Figure "), (i % 13).cast("string"))
    b = model.text_blocks(t("documents")).where("not contains(text, '<')")
    return b.select("doc_id", "block_idx", refine.renumber(made, "figure", {"2": "3", "3": "12"}).alias("text"))


@query(rf"""WITH {BLOCKS}, made AS (SELECT doc_id, block_idx, CASE WHEN doc_id % 3 = 0 AND trim(text) <> '' THEN (block_idx + 1) || CASE WHEN block_idx % 2 = 0 THEN '.' || block_idx ELSE '' END || ' ' || text || CASE WHEN doc_id % 2 = 0 THEN ' .... ' || (block_idx + 7) ELSE '' END ELSE text END AS text FROM blocks),
p AS (SELECT doc_id, block_idx, text, regexp_extract(text, '{refine.ENTRY_DOTTED}', 1) AS d, regexp_extract(text, '{refine.ENTRY_PLAIN}', 1) AS f FROM made WHERE trim(text) <> ''),
r AS (SELECT *, CASE WHEN d <> '' THEN d ELSE f END AS number, trim(CASE WHEN d <> '' THEN regexp_replace(text, '{refine.ENTRY_DOTTED}', '') ELSE regexp_replace(text, '{refine.ENTRY_PLAIN}', '') END) AS raw FROM p),
s AS (SELECT *, regexp_extract(raw, '{refine.LEADER_PAGE}', 1) AS led, regexp_extract(raw, '{refine.SPACE_PAGE}', 1) AS spaced FROM r),
u AS (SELECT *, CASE WHEN led <> '' THEN led ELSE spaced END AS page, regexp_replace(regexp_replace(trim(CASE WHEN led <> '' THEN regexp_replace(raw, '{refine.LEADER_PAGE}', '') ELSE regexp_replace(raw, '{refine.SPACE_PAGE}', '') END), '^[.·…‥]+|[.·…‥]+$', '', 'g'), '^[ :.–—-]+|[ :.–—-]+$', '', 'g') AS title FROM s),
e AS (SELECT *, number <> '' AND title <> '' AND (contains(number, '.') OR page <> '') AS ok FROM u),
g AS (SELECT doc_id FROM e GROUP BY doc_id HAVING count(*) >= 2 AND count(*) FILTER (WHERE ok) >= greatest(2, count(*) // 2) AND 2 * count(*) FILTER (WHERE ok AND page <> '') >= count(*) FILTER (WHERE ok))
SELECT doc_id, block_idx, number, title, page FROM e JOIN g USING (doc_id) WHERE ok""")
def q_contents(t, spark):
    i, one = F.col("block_idx"), (F.col("doc_id") % 3 == 0) & (F.trim("text") != "")
    number = F.concat((i + 1).cast("string"), F.when(i % 2 == 0, F.concat(F.lit("."), i.cast("string"))).otherwise(""))
    page = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" .... "), (i + 7).cast("string"))).otherwise("")
    lines = model.text_blocks(t("documents")).withColumn("text", F.when(one, F.concat(number, F.lit(" "), "text", page)).otherwise(F.col("text")))
    return refine.contents(lines, "doc_id", "block_idx")


@query("""WITH ids AS (SELECT 'r' || n_regionkey || '::n' || n_nationkey || '::s' || s_suppkey AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT id, 0 AS depth, split_part(id, '::', 1) AS ancestor FROM ids UNION ALL SELECT id, 1, split_part(id, '::', 1) || '::' || split_part(id, '::', 2) FROM ids""")
def q_ancestors(t, spark):
    j = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    part = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    return refine.ancestors(j.select(F.concat_ws("::", part("r", "n_regionkey"), part("n", "n_nationkey"), part("s", "s_suppkey")).alias("id")))


@query(f"""WITH {STYLED}, f AS (SELECT DISTINCT doc_id, 'F' || (font_size::BIGINT % 3) AS font, font_size FROM styled),
o AS (SELECT doc_id, font || '=' || string_agg(printf('%.2f', font_size), '/' ORDER BY font_size) AS one FROM f GROUP BY doc_id, font)
SELECT doc_id, string_agg(one, ';' ORDER BY one) AS fonts, count(*) > 1 AS multifont FROM o GROUP BY doc_id""")
def q_styles(t, spark):
    return refine.styles(styled(t).withColumn("font", F.concat(F.lit("F"), (F.col("font_size").cast("bigint") % 3).cast("string"))), "doc_id")


@query(f"""WITH {BOXES}, b AS (SELECT page, seq, printf('%.2f', round_even(x0, 2)) || ',' || printf('%.2f', round_even(y0, 2)) || ',' || printf('%.2f', round_even(x1, 2)) || ',' || printf('%.2f', round_even(y1, 2)) AS box FROM boxes)
SELECT 'p' || page || '_b' || seq AS block_id, page, CASE WHEN seq % 2 = 0 THEN 't' || seq ELSE 'box ' || seq END AS translated, 'translate_refit' AS render_path, box AS src_box, box AS dst_box FROM b""")
def q_render_plan(t, spark):
    name = F.col("seq").cast("string")
    return refine.render_plan(boxes(t).withColumns({"text": F.concat(F.lit("box "), name), "translated": F.when(F.col("seq") % 2 == 0, F.concat(F.lit("t"), name))}))


@query("SELECT n_nationkey AS attempt, 100.0 * pow(2, n_nationkey) AS delay_ms FROM nation")
def q_retry_delay(t, spark):
    return t("nation").select(F.col("n_nationkey").alias("attempt"), refine.retry_delay(F.col("n_nationkey")).alias("delay_ms"))


@query("SELECT user_id, last FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) WHERE last < (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND")
def q_idle_sessions(t, spark):
    return refine.idle(t("events"), "user_id", "ts", 3600)


@query(f"""WITH {BLOCKS}, n AS (SELECT doc_id % 50 AS page, trim(text) AS x, min(doc_id * 1000 + block_idx) AS node FROM blocks WHERE block_idx % 2 = 0 GROUP BY ALL)
SELECT doc_id, block_idx, node FROM blocks b LEFT JOIN n ON n.page = b.doc_id % 50 AND n.x = trim(b.text)""")
def q_matched_nodes(t, spark):
    b = model.text_blocks(t("documents")).withColumn("page", F.col("doc_id") % 50)
    nodes = b.where("block_idx % 2 = 0").select("page", "text", (F.col("doc_id") * 1000 + F.col("block_idx")).alias("node"))
    return refine.matched(nodes, b).select("doc_id", "block_idx", "node")
