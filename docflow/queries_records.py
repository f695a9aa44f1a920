"""Queries of the record and render operators, each beside its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.text import upper_each
from .operators import diff, records, render
from .queries import BLOCKS, BOXES, GEO, PAIRS, WORDSET, boxes, geo_graph, pairs, query
from .sources import blocks as model

STATE = "CASE event_type WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'running' END"


def states(t):
    kind = F.col("event_type")
    return t("events").withColumn("state", F.when(kind == "purchase", "finished").when(kind == "error", "failed").when(kind == "signup", "queued").otherwise("running"))


# -------------------------------------------------------------------- records


@query("""SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS translated, count(*) FILTER (WHERE event_type = 'view') AS cached, count(*) FILTER (WHERE event_type = 'error') AS failed,
round(coalesce(sum(value), 0), 4) AS latency, round(coalesce(sum(value), 0) / greatest(count(*) FILTER (WHERE event_type = 'click'), 1), 4) AS avg_latency FROM events GROUP BY user_id""")
def q_translation_stats(t, spark):
    kind = F.col("event_type")
    status = F.when(kind == "click", "translated").when(kind == "view", "cached").when(kind == "error", "failed")
    s = records.translation_stats(t("events").select("user_id", status.alias("status"), F.col("value").alias("latency_ms")), "user_id")
    return s.withColumns({c: F.round(c, 4) for c in ("latency", "avg_latency")})


@query("SELECT event_type, count(*) AS operations, round(sum(value), 4) AS total_time, round(avg(value), 4) AS avg_time, max(value) AS max_time, min(value) AS min_time FROM events GROUP BY event_type")
def q_resource_report(t, spark):
    r = records.resource_report(t("events").withColumnRenamed("value", "elapsed"), "event_type")
    return r.withColumns({c: F.round(c, 4) for c in ("total_time", "avg_time")})


@query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value < 100) AS passed, count(*) - count(*) FILTER (WHERE value < 100) AS failed, round(100.0 * count(*) FILTER (WHERE value < 100) / greatest(count(*), 1), 6) AS pass_rate FROM events GROUP BY event_type")
def q_diagnostic_report(t, spark):
    r = records.diagnostic_report(t("events").withColumn("passed", F.col("value") < 100), "event_type")
    return r.withColumn("pass_rate", F.round("pass_rate", 6))


@query("""WITH ring AS (SELECT event_type, count(*) AS kept FROM (SELECT event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) GROUP BY event_type),
c AS (SELECT event_type, count(*) AS count, count(*) FILTER (WHERE value >= 200) AS errors FROM events GROUP BY event_type) SELECT event_type, count, errors, coalesce(kept, 0) AS kept FROM c LEFT JOIN ring USING (event_type)""")
def q_telemetry_ring(t, spark):
    return records.ring_counts(t("events").withColumn("success", F.col("value") < 200), "event_type", ["ts", "event_id"], 500)


@query("SELECT o_orderpriority AS reason, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def q_fallbacks(t, spark):
    return records.counted(t("orders").where("o_orderstatus = 'F'"), "o_orderpriority").withColumnRenamed("o_orderpriority", "reason")


@query("SELECT user_id AS node, event_type AS stage, event_id FROM events WHERE user_id = 3 AND event_type = 'click'")
def q_decisions(t, spark):
    log = t("events").select(F.col("user_id").alias("node"), F.col("event_type").alias("stage"), "event_id")
    return records.decisions(log, 3, "click")


@query("SELECT o_orderkey AS id, o_orderpriority AS severity FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')")
def q_unresolved(t, spark):
    rank = F.substring("o_orderpriority", 1, 1)
    found = t("orders").withColumns({"severity": F.when(rank == "1", "critical").when(rank == "2", "error").otherwise("info"), "repaired": F.col("o_orderstatus") == "F"})
    return records.unresolved(found).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("severity"))


@query(f"WITH {GEO} SELECT id, NULL::VARCHAR AS relation, hash AS target FROM nodes UNION ALL SELECT src, relation, n.hash FROM edges JOIN nodes n ON n.id = dst")
def q_cause_chain(t, spark):
    nodes, edges = geo_graph(t)
    return records.cause_chain(nodes.withColumnRenamed("hash", "message"), edges)


@query(f"""WITH i AS (SELECT user_id, {STATE} AS state, 1.0 + event_id % 7 AS weight, (event_id % 12) / 10.0 AS partial FROM events), s AS (SELECT user_id, sum(weight) AS total_weight,
coalesce(sum(weight) FILTER (WHERE state = 'finished'), 0) AS finished_weight, coalesce(sum(weight) FILTER (WHERE state = 'running'), 0) AS running_weight, coalesce(sum(weight) FILTER (WHERE state = 'queued'), 0) AS queued_weight,
coalesce(sum(weight) FILTER (WHERE state = 'failed'), 0) AS failed_weight, coalesce(sum(weight * least(partial, 1.0)) FILTER (WHERE state = 'running'), 0) AS part, count(*) FILTER (WHERE state = 'finished') AS finished_tasks, count(*) AS total_tasks FROM i GROUP BY user_id)
SELECT user_id, total_weight::DOUBLE AS total_weight, finished_weight::DOUBLE AS finished_weight, running_weight::DOUBLE AS running_weight, queued_weight::DOUBLE AS queued_weight, failed_weight::DOUBLE AS failed_weight,
round(100.0 * (finished_weight + part)::DOUBLE / total_weight::DOUBLE, 6) AS percentage, finished_tasks, total_tasks FROM s""")
def q_progress_state(t, spark):
    i = states(t).select("user_id", "state", (F.lit(1.0).cast("double") + F.col("event_id") % 7).alias("weight"), ((F.col("event_id") % 12) / 10.0).alias("partial"))
    return records.progress_state(i, "user_id").withColumn("percentage", F.round("percentage", 6))


@query(f"""WITH e AS (SELECT user_id % 7 * 100 + event_id % 90 AS task, ts, event_id, {STATE} AS state FROM events), f AS (SELECT task, min((ts, event_id)) AS at FROM e WHERE state IN ('finished', 'failed') GROUP BY task),
l AS (SELECT e.task, arg_max(state, (ts, event_id)) AS last, arg_min(state, (ts, event_id)) FILTER (WHERE state IN ('finished', 'failed')) AS first, count(*) FILTER (WHERE f.at IS NOT NULL AND (ts, event_id) > f.at) AS n_ignored FROM e LEFT JOIN f USING (task) GROUP BY e.task)
SELECT task, coalesce(first, last) AS state, n_ignored FROM l""")
def q_lifecycle(t, spark):
    return records.lifecycle(states(t).withColumn("task", F.col("user_id") % 7 * 100 + F.col("event_id") % 90), "task", ["ts", "event_id"])


@query(f"""WITH e AS (SELECT user_id % 7 * 100 + event_id % 90 AS task, ts, event_id, {STATE} AS state FROM events), f AS (SELECT task, min((ts, event_id)) AS at FROM e WHERE state IN ('finished', 'failed') GROUP BY task)
SELECT task, event_id, state FROM e LEFT JOIN f USING (task) WHERE f.at IS NULL OR (ts, event_id) <= f.at""")
def q_until_terminal(t, spark):
    e = states(t).withColumn("task", F.col("user_id") % 7 * 100 + F.col("event_id") % 90)
    return records.until_terminal(e, "task", ["ts", "event_id"]).select("task", "event_id", "state")


@query("""WITH n AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'D' || o_custkey WHEN 1 THEN 'D' || o_custkey || '::P' || o_orderkey % 5 ELSE 'D' || o_custkey || '::P' || o_orderkey % 5 || '::B' || o_orderkey % 9 END AS id, o_orderkey % 3 AS depth, o_orderkey AS k, o_custkey AS c FROM orders)
SELECT k, id, 'D' || c AS doc_id, CASE depth WHEN 1 THEN 'D' || c WHEN 2 THEN 'D' || c || '::P' || k % 5 END AS parent, CASE depth WHEN 0 THEN 'document' WHEN 1 THEN 'P' ELSE 'B' END AS kind, CASE depth WHEN 1 THEN (k % 5)::VARCHAR WHEN 2 THEN (k % 9)::VARCHAR END AS seq, depth FROM n""")
def q_node_path(t, spark):
    k, part = F.col("o_orderkey"), lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    d, p, b = part("D", F.col("o_custkey")), part("::P", k % 5), part("::B", k % 9)
    id = F.when(k % 3 == 0, d).when(k % 3 == 1, F.concat(d, p)).otherwise(F.concat(d, p, b))
    return t("orders").select(k.alias("k"), id.alias("id"), records.node_path(id).alias("n")).select("k", "id", "n.*")


@query(f"WITH {BLOCKS}, k AS (SELECT doc_id, block_idx, upper(substr(kind, 1, 1)) AS k FROM blocks) SELECT doc_id, block_idx, 'D' || doc_id || '::' || k || (row_number() OVER (PARTITION BY doc_id, k ORDER BY block_idx) - 1) AS id FROM k")
def q_child_ids(t, spark):
    b = model.text_blocks(t("documents")).withColumn("parent", F.concat(F.lit("D"), F.col("doc_id").cast("string")))
    return records.child_ids(b, "parent", F.upper(F.substring("kind", 1, 1)), ["block_idx"]).select("doc_id", "block_idx", "id")


@query("""SELECT p_partkey, '{"brand":"' || p_brand || '","name":"' || p_name || '","type":"' || p_type || '"}' AS json FROM part""")
def q_canonical_json(t, spark):
    values = F.create_map(F.lit("type"), "p_type", F.lit("name"), "p_name", F.lit("brand"), "p_brand")
    return t("part").select("p_partkey", records.canonical_json(values).alias("json"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand, p_size::VARCHAR AS size, NULL::VARCHAR AS lost FROM part""")
def q_path_values(t, spark):
    inner = F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("brand"), F.array(F.lit(0), F.col("p_size")).alias("sizes"))
    json = F.to_json(F.struct(F.struct(inner.alias("part")).alias("extra")))
    return t("part").select("p_partkey", *(records.get_path(json, p).alias(n) for n, p in (("brand", "extra.part.brand"), ("size", "extra.part.sizes[1]"), ("lost", "extra.none.brand"))))


@query("WITH a AS (SELECT doc_id AS key, source AS value FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS key, lang AS value FROM documents WHERE doc_id % 3 = 0) SELECT key, coalesce(b.value, a.value) AS value FROM a FULL JOIN b USING (key)")
def q_memory_merge(t, spark):
    d = t("documents")
    side = lambda k, c: d.where(F.col("doc_id") % k == 0).select(F.col("doc_id").alias("key"), F.col(c).alias("value"))
    return records.merge_memory(side(2, "source"), side(3, "lang"), "key", "value", overwrite=True)


@query("""WITH memo AS (SELECT sha256(text) AS hash, min('memo ' || item_id) AS output FROM benchmark WHERE item_id % 2 = 0 GROUP BY 1)
SELECT item_id, sha256(text) AS hash, coalesce(output, upper(text)) AS output, CASE WHEN output IS NULL THEN 'run' ELSE 'memo' END AS source FROM benchmark b LEFT JOIN memo ON memo.hash = sha256(b.text)""")
def q_replay(t, spark):
    b = t("benchmark")
    memo = b.where("item_id % 2 = 0").select(F.sha2("text", 256).alias("hash"), F.concat(F.lit("memo "), F.col("item_id").cast("string")).alias("output"))
    return records.replay(b, memo, upper_each).select("item_id", "hash", "output", "source")


@query("""WITH a AS (SELECT lang || '-' || (doc_id % 50) AS stem, source AS stage, md5(string_agg(text, '' ORDER BY doc_id)) AS hash FROM documents GROUP BY 1, 2),
b AS (SELECT lang || '-' || (doc_id % 50) AS stem, source AS stage, md5(string_agg(CASE WHEN doc_id % 40 = 3 THEN text || 'x' ELSE text END, '' ORDER BY doc_id)) AS hash FROM documents WHERE doc_id % 50 < 45 GROUP BY 1, 2),
j AS (SELECT stem, a.hash AS x, b.hash AS y FROM a FULL JOIN b USING (stem, stage))
SELECT stem, count(y) > 0 AND count(*) FILTER (WHERE x IS DISTINCT FROM y) = 0 AS passed, count(*) FILTER (WHERE x IS DISTINCT FROM y) AS n_changed, count(y) = 0 AS missing FROM j WHERE stem IN (SELECT stem FROM a) GROUP BY stem""")
def q_regression(t, spark):
    stem = F.concat_ws("-", "lang", (F.col("doc_id") % 50).cast("string"))
    d = t("documents").where("text is not null").select("doc_id", stem.alias("stem"), F.col("source").alias("stage"), "text")
    each = lambda rows, text: rows.groupBy("stem", "stage").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", text.alias("x")))), lambda r: r.x), "")).alias("hash"))
    altered = F.when(F.col("doc_id") % 40 == 3, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return records.regression(each(d, F.col("text")), each(d.where("doc_id % 50 < 45"), altered))


@query("SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'low consistency' END AS reason FROM events WHERE event_type = 'error' OR value / 100 < 0.8")
def q_needs_review(t, spark):
    r = t("events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), (F.col("value") / 100).alias("consistency"))
    return records.needs_review(r)


@query(f"""WITH {BLOCKS}, n AS (SELECT doc_id || '_' || block_idx AS id, kind, n_words, n_chars FROM blocks),
r AS (SELECT id, CASE WHEN n_chars % 3 = 0 THEN 'caption' ELSE 'list' END AS role, (n_chars % 10) / 10.0 AS confidence FROM n WHERE n_words > 2 UNION ALL SELECT id, 'heading', (n_words % 10) / 10.0 FROM n WHERE n_words > 8),
b AS (SELECT id, arg_max(role, (confidence, role)) AS role FROM r WHERE confidence >= 0.55 GROUP BY id)
SELECT id, CASE WHEN role IS NOT NULL AND (kind = 'paragraph' OR kind = role) THEN role ELSE kind END AS node_type, CASE WHEN role IS NULL THEN 'none' WHEN kind = 'paragraph' OR kind = role THEN 'adopted' ELSE 'kept' END AS fused FROM n LEFT JOIN b USING (id)""")
def q_fused_roles(t, spark):
    n = model.text_blocks(t("documents")).withColumn("id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("block_idx").cast("string")))
    first = n.where("n_words > 2").select("id", F.when(F.col("n_chars") % 3 == 0, "caption").otherwise("list").alias("role"), ((F.col("n_chars") % 10) / 10.0).alias("confidence"))
    more = n.where("n_words > 8").select("id", F.lit("heading").alias("role"), ((F.col("n_words") % 10) / 10.0).alias("confidence"))
    return records.fuse_roles(n.select("id", F.col("kind").alias("node_type")), first.unionByName(more))


SIDES = f"""{BLOCKS}, a AS (SELECT doc_id % 40 AS page, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id, block_idx) AS k, text, n_chars::DOUBLE AS w, block_idx * 20.0 AS y FROM blocks WHERE kind = 'paragraph'),
b AS (SELECT doc_id % 40 AS page, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id, block_idx) AS k, text, n_chars + 6.0 AS w, block_idx * 20.0 + 4 AS y FROM blocks WHERE kind = 'paragraph' AND block_idx % 9 <> 1)"""


@query(f"""WITH {SIDES}, j AS (SELECT page, a.k AS ka, b.k AS kb, {WORDSET.format('a.text')} AS x, {WORDSET.format('b.text')} AS z, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN sqrt(pow((b.w - a.w) / 2, 2) + pow(b.y - a.y, 2)) END AS d FROM a FULL JOIN b USING (page, k)),
s AS (SELECT *, CASE WHEN ka IS NOT NULL AND kb IS NOT NULL THEN CASE WHEN len(x) + len(z) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(x, z)) / (len(x) + len(z)) END END AS s FROM j)
SELECT page, count(ka) AS left_rows, count(kb) AS right_rows, count(*) FILTER (WHERE s >= 0.5) AS matched, round(avg(s), 6) AS similarity, round(avg(d), 6) AS displacement FROM s GROUP BY page""")
def q_merge_rows(t, spark):
    b = model.text_blocks(t("documents")).where("kind = 'paragraph'").withColumn("page", F.col("doc_id") % 40)
    y = F.col("block_idx") * 20.0
    side = lambda d, w, s: d.select("page", "doc_id", "block_idx", "text", F.lit(0.0).alias("x0"), w.cast("double").alias("x1"), (y + s).cast("double").alias("y0"), (y + s).cast("double").alias("y1"))
    m = records.merge_rows(side(b, F.col("n_chars"), 0.0), side(b.where("block_idx % 9 <> 1"), F.col("n_chars") + 6, 4.0), "page", ["doc_id", "block_idx"], diff.dice)
    return m.withColumns({c: F.round(c, 6) for c in ("similarity", "displacement")})


@query(f"""WITH {GEO}, gone AS (SELECT id FROM nodes WHERE id IN ('r1', 'n3')), left_edges AS (SELECT * FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone))
SELECT id AS a, node_type AS b FROM nodes WHERE id NOT IN (SELECT id FROM gone) AND id <> 'r0' UNION ALL SELECT 'r0', 'renamed' UNION ALL SELECT src, dst FROM left_edges""")
def q_graph_edits(t, spark):
    nodes, edges = geo_graph(t)
    nodes, edges = records.drop_nodes(nodes, edges, nodes.where("id in ('r1', 'n3')"))
    nodes = records.put_nodes(nodes, nodes.where("id = 'r0'").withColumn("node_type", F.lit("renamed")))
    return nodes.select(F.col("id").alias("a"), F.col("node_type").alias("b")).unionByName(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query(f"WITH {GEO} SELECT src, dst FROM edges WHERE src IN ('r2', 'n4') OR dst IN ('r2', 'n4')")
def q_touching(t, spark):
    nodes, edges = geo_graph(t)
    return records.touching(edges, nodes.where("id in ('r2', 'n4')")).select("src", "dst")


@query("SELECT 'n' || n_nationkey AS id, n_name AS node_type FROM nation")
def q_adapted_graph(t, spark):
    n = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.col("n_name").alias("kind"))
    return records.adapted(n, records.NODE_FIELDS)


@query(f"WITH {BLOCKS} SELECT doc_id, block_idx, kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) AS k FROM blocks) WHERE k <= 5")
def q_dump(t, spark):
    return records.dump(model.text_blocks(t("documents")), "doc_id", ["block_idx"], 5).select("doc_id", "block_idx", "kind")


# --------------------------------------------------------------------- render

SAFE = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""WITH {BLOCKS}, e AS (SELECT doc_id, block_idx, '<div class=''' || CASE WHEN kind IN ('heading', 'table', 'caption', 'formula') THEN kind || ' ' ELSE '' END || 'block'' id=''b' || block_idx || '''>' ||
CASE WHEN kind = 'table' THEN '<tr><td>' || replace({SAFE}, chr(9), '</td></tr><tr><td>') || '</td></tr>' ELSE {SAFE} END || '</div>' AS x FROM blocks)
SELECT doc_id, '<!DOCTYPE html><html><head><meta charset=''utf-8''></head><body><div class=''page''>' || string_agg(x, '' ORDER BY block_idx) || '</div></body></html>' AS body FROM e GROUP BY doc_id""")
def q_render_html(t, spark):
    b = model.text_blocks(t("documents")).withColumn("id", F.concat(F.lit("b"), F.col("block_idx").cast("string")))
    return render.render(b, "doc_id", ["block_idx"])


@query(f"""WITH {BLOCKS} SELECT doc_id, string_agg(CASE kind WHEN 'heading' THEN chr(10) || '== ' || text || ' ==' WHEN 'caption' THEN '[caption] ' || text ELSE text END, chr(10) ORDER BY block_idx) || chr(10) AS body FROM blocks GROUP BY doc_id""")
def q_render_text(t, spark):
    return render.render(model.text_blocks(t("documents")).withColumn("id", F.lit("")), "doc_id", ["block_idx"], "text")


@query(f"""WITH {PAIRS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN pairs.text WHEN other <> '' THEN other ELSE pairs.text END AS shown, 'Translate ' || coalesce(d.source, '') || ': {{x}} ' || pairs.text || ' [' || doc_id || ']' AS prompt FROM pairs JOIN documents d USING (doc_id) WHERE pairs.text IS NOT NULL""")
def q_prompts(t, spark):
    p = pairs(t).where("text is not null").join(t("documents").select("doc_id", "source"), "doc_id")
    translated = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("other"))
    prompt = render.filled("Translate {s}: {x} {t} [{d}]", s=F.col("source"), t=F.col("text"), d=F.col("doc_id"))
    return p.select("doc_id", render.shown_text(translated, F.col("text")).alias("shown"), prompt.alias("prompt"))


@query("""SELECT p_brand, string_agg('- ' || p_name || ' → ' || p_type, chr(10) ORDER BY p_partkey) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) WHERE k <= 5 GROUP BY p_brand""")
def q_glossary_prompt(t, spark):
    terms = t("part").select("p_brand", "p_partkey", F.col("p_name").alias("source"), F.col("p_type").alias("target"))
    return render.glossary_prompt(terms, "p_brand", "p_partkey", 5)


KINDS = ("chapter", "section", "subsection", "part", "appendix", "contents", "index", "plain")


@query("""WITH e AS (SELECT page_id, page_id::VARCHAR AS n, ['chapter', 'section', 'subsection', 'part', 'appendix', 'contents', 'index', 'plain'][page_id % 8 + 1] AS kind, CASE WHEN page_id % 5 = 0 THEN ' ' ELSE ' title ' END AS title, CASE WHEN page_id % 2 = 0 THEN '....' ELSE '' END AS leader FROM pages),
p AS (SELECT *, CASE kind WHEN 'chapter' THEN '第' || n || '章' WHEN 'section' THEN '第' || n || '节' WHEN 'subsection' THEN '第' || n || '节' WHEN 'part' THEN '第' || n || '篇' WHEN 'appendix' THEN '附录' || n WHEN 'contents' THEN '目录' WHEN 'index' THEN '索引' ELSE '' END AS zh,
CASE kind WHEN 'chapter' THEN 'Chapter ' || n WHEN 'section' THEN 'Section ' || n WHEN 'subsection' THEN 'Section ' || n WHEN 'part' THEN 'Part ' || n WHEN 'appendix' THEN 'Appendix ' || n WHEN 'contents' THEN 'Contents' WHEN 'index' THEN 'Index' ELSE '' END AS en FROM e),
h AS (SELECT *, zh || CASE WHEN zh <> '' AND trim(title) <> '' THEN ' ' ELSE '' END || trim(title) AS head FROM p)
SELECT page_id, en, head || CASE WHEN head <> '' THEN ' ' ELSE '' END || leader || n AS line FROM h""")
def q_contents_prefix(t, spark):
    n, k = F.col("page_id").cast("string"), F.col("page_id")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % 8 + 1).cast("int"))
    title, leader = F.when(k % 5 == 0, " ").otherwise(" title "), F.when(k % 2 == 0, "....").otherwise("")
    line = render.contents_line(render.contents_prefix(kind, n, "zh_CN"), title, leader, n)
    return t("pages").select("page_id", render.contents_prefix(kind, n, "en").alias("en"), line.alias("line"))


@query("""WITH e AS (SELECT o_orderkey, ['heading', 'formula', 'paragraph', 'abstract', 'formula_inline', 'table'][o_orderkey % 6 + 1] AS s, ['translate', 'keep_number', 'keep_formula', 'skip', NULL][o_custkey % 5 + 1] AS r FROM orders)
SELECT o_orderkey, CASE WHEN coalesce(r, '') = 'keep_formula' OR s IN ('formula', 'formula_inline') THEN 'formula' WHEN r IN ('keep_number', 'skip', 'track') THEN 'verbatim' WHEN s IN ('heading', 'abstract') THEN 'catalog' ELSE 'text' END AS channel FROM e""")
def q_channel(t, spark):
    pick = lambda values, c: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col(c) % len(values) + 1).cast("int"))
    s = pick(("heading", "formula", "paragraph", "abstract", "formula_inline", "table"), "o_orderkey")
    return t("orders").select("o_orderkey", render.channel(s, pick(("translate", "keep_number", "keep_formula", "skip", None), "o_custkey")).alias("channel"))


IMAGES = """images AS (SELECT l_orderkey AS page, l_orderkey * 10 + l_linenumber AS id, l_partkey * 7 % 500 AS width, l_suppkey * 11 % 300 AS height, (l_partkey * 13 + l_linenumber) % 260 AS colors, l_partkey % 3 > 0 AS gray, (l_suppkey * 3 % 50) / 100.0 AS edge, (l_partkey % 10) / 10.0 AS white, (l_suppkey % 10) / 100.0 AS dark, (l_orderkey % 30) / 100.0 AS uniq FROM lineitem),
aspects AS (SELECT *, width / greatest(height, 1) AS aspect, gray AND colors <= 8 AS line FROM images),
classes AS (SELECT page, id, height AS y0, CASE WHEN width <= 0 OR height <= 0 OR colors = 0 THEN 'unknown' WHEN line AND aspect BETWEEN 0.8 AND 1.25 AND edge >= 0.3 THEN 'qr_code' WHEN line AND aspect < 0.4 AND edge >= 0.25 THEN 'barcode'
  WHEN colors <= 4 AND gray AND edge >= 0.35 AND width >= 32 AND height >= 32 THEN 'cad' WHEN gray AND aspect > 1.6 AND white >= 0.55 AND colors <= 64 THEN 'equation' WHEN width * height <= 4096 AND colors <= 12 AND (dark > 0.05 OR edge > 0.02) THEN 'logo'
  WHEN colors >= 192 AND uniq >= 0.15 AND edge < 0.3 THEN 'photo' WHEN white >= 0.4 AND colors <= 96 AND edge >= 0.18 THEN 'chart' WHEN colors >= 120 AND edge >= 0.28 THEN 'comic' WHEN colors >= 24 AND colors < 192 AND edge < 0.3 THEN 'screenshot' ELSE 'unknown' END AS class FROM aspects)"""


def images(t):
    o, p, s, k = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    f = t("lineitem").select(
        o.alias("page"), (o * 10 + k).alias("id"), (p * 7 % 500).alias("width"), (s * 11 % 300).alias("height"), ((p * 13 + k) % 260).alias("color_count"),
        (p % 3 > 0).alias("gray"), ((s * 3 % 50) / 100.0).alias("edge"), ((p % 10) / 10.0).alias("white"), ((s % 10) / 100.0).alias("dark"), ((o % 30) / 100.0).alias("unique"),
    )
    return f.select("page", "id", F.col("height").alias("y0"), render.image_class(F.struct(*f.columns)).alias("c")).select("page", "id", "y0", "c.class")


@query(f"WITH {IMAGES} SELECT class, count(*) AS n FROM classes GROUP BY class")
def q_image_class(t, spark):
    return images(t).groupBy("class").agg(F.count("*").alias("n"))


@query(f"""WITH {IMAGES}, captions AS (SELECT o_orderkey AS page, o_orderkey AS cap, (o_custkey * 17 % 300)::BIGINT AS y FROM orders UNION ALL SELECT o_orderkey, o_orderkey + 1000000000, (o_custkey * 29 % 300)::BIGINT FROM orders),
r AS (SELECT c.*, cap, row_number() OVER (PARTITION BY c.page, id, y0, class ORDER BY abs(y - y0), y, cap) AS k FROM classes c LEFT JOIN captions k ON k.page = c.page)
SELECT page, id, CASE class WHEN 'screenshot' THEN 'ocr_overlay' WHEN 'chart' THEN 'keep_labels' WHEN 'comic' THEN 'ocr_overlay' ELSE 'preserve' END AS strategy, cap AS caption_id FROM (SELECT DISTINCT * FROM r) WHERE k = 1""")
def q_figures(t, spark):
    o = t("orders")
    cap = lambda shift, m: o.select(F.col("o_orderkey").alias("page"), (F.col("o_orderkey") + shift).alias("id"), (F.col("o_custkey") * m % 300).alias("y0"))
    return render.figures(images(t).distinct(), cap(0, 17).unionByName(cap(1000000000, 29))).select("page", "id", "strategy", "caption_id")


@query(f"""WITH {BLOCKS}, s AS (SELECT doc_id, block_idx, trim(text) AS x, n_chars % 6 AS k, n_chars % 4 <> 0 AS tr, (block_idx % 10) / 10.0 AS c, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) AS n FROM blocks)
SELECT doc_id, block_idx, round(CASE WHEN k = 0 THEN 0.2 WHEN k = 1 THEN 0.3 WHEN x = '' THEN 0.2 WHEN NOT tr THEN 0.15 ELSE least(1.0, 0.5 + 0.15 * c + CASE WHEN n >= 2 THEN 0.15 ELSE 0 END + CASE WHEN length(x) BETWEEN 2 AND 40 THEN 0.05 ELSE 0 END) END::DOUBLE, 4) AS score FROM s""")
def q_region_score(t, spark):
    k = F.col("n_chars") % 6
    kind = F.when(k == 0, "axis_label").when(k == 1, "ui_control").otherwise("text")
    score = render.region_score(kind, F.col("text"), F.col("n_chars") % 4 != 0, (F.col("block_idx") % 10) / 10.0)
    return model.text_blocks(t("documents")).select("doc_id", "block_idx", F.round(score, 4).alias("score"))


@query(f"""WITH RECURSIVE {BLOCKS}, b AS (SELECT doc_id, block_idx, greatest(1, (length(text) + 72) // 73) AS lines, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) AS k FROM blocks WHERE trim(text) <> ''),
f AS (SELECT doc_id, block_idx, k, lines, 50.0::DOUBLE AS y FROM b WHERE k = 1
UNION ALL SELECT b.doc_id, b.block_idx, b.k, b.lines, (CASE WHEN f.y + f.lines * 16 + 6 + b.lines * 16 > 742 THEN 50 ELSE f.y + f.lines * 16 + 6 END)::DOUBLE FROM f JOIN b ON b.doc_id = f.doc_id AND b.k = f.k + 1)
SELECT doc_id, block_idx, lines, (lines * 16)::DOUBLE AS height, y FROM f""")
def q_flow(t, spark):
    return render.flow(model.text_blocks(t("documents")), "doc_id", "block_idx")


@query(f"""WITH {BLOCKS}, j AS (SELECT doc_id, block_idx, n_chars AS n, n_chars * 5.0 AS used, greatest(0, 400 - n_chars * 5.0) AS spare, n_chars - length(regexp_replace(text, '\\s', '', 'g')) AS spaces FROM blocks)
SELECT doc_id, block_idx, used::DOUBLE AS used, round(CASE WHEN n <= 1 OR spare <= 0 THEN used ELSE used + spare END::DOUBLE, 4) AS total, n = 1 AS lone FROM j""")
def q_justified(t, spark):
    b = model.text_blocks(t("documents"))
    total = F.aggregate(render.justified(F.col("text"), F.lit(400.0)), F.lit(0.0), lambda a, w: a + w)
    return b.select("doc_id", "block_idx", render.measured(F.col("text")).alias("used"), F.round(total, 4).alias("total"), render.lone_line(F.col("n_chars"), F.lit(True)).alias("lone"))


@query("SELECT p_brand, substr(p_name, 1, 1) AS char, max(p_size)::DOUBLE AS width FROM part WHERE p_size > 0 GROUP BY 1, 2")
def q_width_map(t, spark):
    return render.width_map(t("part").select("p_brand", F.substring("p_name", 1, 1).alias("char"), F.lit(0.0).alias("x0"), F.col("p_size").cast("double").alias("x1")), "p_brand")


@query(f"""WITH {BOXES}, g AS (SELECT page, seq, x0, x1, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page ORDER BY x0, x1, seq) >= 25 THEN 1 ELSE 0 END AS s FROM boxes)
SELECT page, seq, (sum(s) OVER (PARTITION BY page ORDER BY x0, x1, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS line FROM g""")
def q_column_lines(t, spark):
    return render.column_lines(boxes(t).withColumn("size", F.lit(10.0)), ["page"]).select("page", "seq", "line")


CHUNKS = f"""{BOXES}, m AS (SELECT *, CASE WHEN y0 - max(y1) OVER (PARTITION BY page ORDER BY y0, x0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 2 THEN 1 ELSE 0 END AS s FROM boxes),
r AS (SELECT *, sum(s) OVER (PARTITION BY page ORDER BY y0, x0, seq ROWS UNBOUNDED PRECEDING) AS run FROM m),
chunks AS (SELECT page, 'chunk_' || arg_min(seq, (y0, x0, seq)) AS chunk, min(x0) AS x, min(y0) AS y, max(x1) - min(x0) AS w, max(y1) - min(y0) AS h, count(*) AS sources FROM r GROUP BY page, run)"""


@query(f"WITH {CHUNKS} SELECT * FROM chunks")
def q_manifest(t, spark):
    return render.manifest(boxes(t), "page", "seq", 2.0)


@query(f"WITH {CHUNKS}, c AS (SELECT page, lag(chunk) OVER (PARTITION BY page ORDER BY y, x, chunk) AS src, chunk AS dst FROM chunks) SELECT page, src, dst, 'must_below' AS relation, 'soft' AS priority FROM c WHERE src IS NOT NULL")
def q_chunk_constraints(t, spark):
    return render.chunk_constraints(render.manifest(boxes(t), "page", "seq", 2.0), "page")
