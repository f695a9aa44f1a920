"""Queries of annotations, geometry and views that other queries only use in part, each beside its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import classify, geometry
from .functions import text as words
from .operators import aggregates, annotate, joins, knowledge, layout, overlap, traverse
from .operators.doc_query import DocumentQuery
from .queries import BLOCKS, BOXES, GEO, PAIRS, boxes, geo_graph, pairs, query
from .sources import blocks as model
from .streaming import events as log

# ---------------------------------------------------------------- annotations


@query("""WITH s AS (SELECT 1 + p_size % 3 AS parts, 8.0 AS lo, 8.0 + p_partkey % 9 AS hi, p_partkey % 4 = 0 AS mixed FROM part)
SELECT * FROM (SELECT 'split' AS issue, count(*) FILTER (WHERE parts > 1) AS n FROM s UNION ALL SELECT 'size_blend', count(*) FILTER (WHERE hi > lo * 1.6) FROM s UNION ALL SELECT 'align_mixed', count(*) FILTER (WHERE mixed) FROM s) WHERE n > 0""")
def q_layout_report(t, spark):
    k = F.col("p_partkey")
    b = t("part").select((1 + F.col("p_size") % 3).alias("n_parts"), F.lit(8.0).alias("least_size"), (F.lit(8.0).cast("double") + k % 9).alias("most_size"), F.when(k % 4 == 0, "mixed").otherwise("left").alias("alignment"))
    return annotate.layout_report(b)


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN 'x ' || text END AS translated, CASE WHEN doc_id % 3 = 0 THEN text = text WHEN doc_id % 3 = 1 THEN ('x ' || text) = text END AS translated_same FROM documents")
def q_annotated_translation(t, spark):
    d = t("documents").select(F.col("doc_id").alias("id"), "text")
    made = d.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("x "), "text")).alias("translated"))
    return annotate.annotate_translation(d, made).select("id", "translated", "translated_same")


@query("""WITH e AS (SELECT DISTINCT o_custkey % 60 AS src, o_orderkey % 60 AS dst FROM orders WHERE o_orderkey % 2 = 0) SELECT a.src AS a, a.dst AS b FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src AND a.src < a.dst""")
def q_conflicts(t, spark):
    e = t("orders").select((F.col("o_custkey") % 60).alias("src"), (F.col("o_orderkey") % 60).alias("dst"), F.when(F.col("o_orderkey") % 2 == 0, "must_below").otherwise("keep_together").alias("constraint"))
    return annotate.conflicts(e)


CHARS = "chars AS (SELECT l_orderkey AS page, l_linenumber::BIGINT AS seq, substr('abcdefg', l_linenumber, 1) AS text, CASE WHEN l_partkey % 3 = 0 THEN 'B' ELSE 'A' END AS font, 10.0 + l_suppkey % 2 AS size, l_linenumber * 6.0 AS x0, l_linenumber * 6.0 + 5 AS x1, (l_orderkey % 3) * 1.0 AS y0 FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1)"


def chars(t):
    k, first = F.col("l_linenumber"), Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey")
    one = t("lineitem").withColumn("_k", F.row_number().over(first)).where("_k = 1")
    font = F.when(F.col("l_partkey") % 3 == 0, "B").otherwise("A")
    return one.select(
        F.col("l_orderkey").alias("page"), k.cast("bigint").alias("seq"), F.substring(F.lit("abcdefg"), k, F.lit(1)).alias("text"), font.alias("font"),
        (10.0 + F.col("l_suppkey") % 2).alias("size"), (k * 6.0).alias("x0"), (k * 6.0 + 5).alias("x1"), ((F.col("l_orderkey") % 3) * 1.0).alias("y0"),
    )


@query(f"""WITH {CHARS}, m AS (SELECT *, CASE WHEN lag(seq) OVER w IS NULL OR font <> lag(font) OVER w OR abs(size - lag(size) OVER w) > 0.5 OR x0 - lag(x1) OVER w > 2 THEN 1 ELSE 0 END AS n FROM chars WINDOW w AS (PARTITION BY page ORDER BY seq)),
r AS (SELECT *, sum(n) OVER (PARTITION BY page ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT page, run::BIGINT AS run, string_agg(text, '' ORDER BY seq) AS text, min(font) AS font, min(size)::DOUBLE AS size FROM r GROUP BY page, run""")
def q_style_runs(t, spark):
    return annotate.style_runs(chars(t))


@query("SELECT n.n_name AS name, r_name AS entity FROM nation n LEFT JOIN region ON n_regionkey = r_regionkey AND n_regionkey < 3")
def q_resolved_alias(t, spark):
    known = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_regionkey < 3").select(F.col("n_name").alias("alias"), F.col("r_name").alias("entity"))
    return annotate.resolve_alias(t("nation").select(F.col("n_name").alias("name")), known)


@query(f"WITH {PAIRS} SELECT doc_id AS id FROM pairs WHERE contains(lower(text), 'the') AND NOT contains(other, 'and')")
def q_glossary_violations(t, spark):
    p = pairs(t).select(F.col("doc_id").alias("id"), F.col("text").alias("source"), F.col("other").alias("target"))
    return annotate.glossary_violations(p, "The", "and")


@query("SELECT p_partkey, round(CASE WHEN p_size % 7 = 0 THEN CASE WHEN p_size % 5 = 0 THEN 1.0 ELSE 0.5 END ELSE least(1.0, (p_size % 5) / (p_size % 7)) END, 6) AS kept FROM part")
def q_preservation(t, spark):
    return t("part").select("p_partkey", F.round(aggregates.preservation(F.col("p_size") % 7, F.col("p_size") % 5), 6).alias("kept"))


@query("SELECT count(*) AS entities, coalesce(sum(p_size), 0)::BIGINT AS occurrences FROM part")
def q_knowledge_stats(t, spark):
    return knowledge.stats(t("part").withColumnRenamed("p_size", "occurrences"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT -1 - n_nationkey, 'added' FROM nation")
def q_upserted(t, spark):
    now = t("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    change = now.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "new").alias("segment"))
    return knowledge.upsert(now, change.unionByName(t("nation").select((-1 - F.col("n_nationkey").cast("bigint")).alias("c_custkey"), F.lit("added").alias("segment"))), ["c_custkey"], ["segment"])


@query(f"""WITH {GEO} SELECT '"' || src || '" -> "' || dst || '" [label="' || relation || '"];' AS line FROM edges""")
def q_dot(t, spark):
    return model.to_dot(geo_graph(t)[1].withColumnRenamed("relation", "edge_type"))


@query("SELECT 'node_' || (item_id % 9) AS id, text, 0::BIGINT AS page, 72.0::DOUBLE AS x0, (100 + (item_id % 9) * 20)::DOUBLE AS y0, 172.0::DOUBLE AS x1, (114 + (item_id % 9) * 20)::DOUBLE AS y1 FROM benchmark")
def q_record_boxes(t, spark):
    texts = t("benchmark").select(F.lit(0).alias("doc_id"), (F.col("item_id") % 9).alias("seq"), "text")
    return model.normalize_records(model.records_from_texts(texts))


# ------------------------------------------------------------------- geometry


@query(f"""WITH {BOXES} SELECT page, seq, CASE WHEN abs(x0 - 40) <= 4 AND abs(400 - x1) <= 4 THEN 'justify' WHEN abs(x0 - 40) <= 4 THEN 'left' WHEN abs(400 - x1) <= 4 THEN 'right' WHEN abs(x0 + x1 - 440) <= 8 THEN 'center' ELSE 'mixed' END AS alignment FROM boxes""")
def q_alignment(t, spark):
    return boxes(t).select("page", "seq", geometry.alignment(F.col("x0"), F.col("x1"), F.lit(40.0), F.lit(400.0)).alias("alignment"))


@query("SELECT item_id, (length(text) * 0.5 + length(regexp_replace('漢字 ' || item_id, '[^⺀-鿿]', '', 'g')) * 1.0 + (length('漢字 ' || item_id) - 2) * 0.5)::DOUBLE * 12 AS width FROM benchmark")
def q_text_width(t, spark):
    return t("benchmark").select("item_id", geometry.text_width(F.concat("text", F.lit("漢字 "), F.col("item_id").cast("string"))).alias("width"))


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_quantity AS need, 25.0 AS room FROM lineitem) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, need, CASE WHEN need <= room THEN 'fits' WHEN need * 0.9 <= room THEN 'compress' WHEN need - room <= 10 THEN 'push' WHEN need * 0.7 <= room THEN 'shrink' ELSE 'expand' END AS fit FROM n""")
def q_fit(t, spark):
    need = F.col("l_quantity")
    return t("lineitem").select("l_orderkey", "l_linenumber", need.alias("need"), geometry.fit(need, F.lit(25.0), 10.0).alias("fit"))


@query(f"WITH {BOXES} SELECT page, seq, x0 * 2 + 10 AS x0, y0 * 0.5 - 5 AS y0, x1 * 2 + 10 AS x1, y1 * 0.5 - 5 AS y1 FROM boxes")
def q_projected(t, spark):
    rect = lambda *v: geometry.rect(*(F.lit(float(x)) for x in v))
    own = geometry.rect(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    p = boxes(t).select("page", "seq", geometry.project(own, rect(0, 0, 512, 1024), rect(10, -5, 1034, 507)).alias("p"))
    return p.select("page", "seq", "p.x0", "p.y0", "p.x1", "p.y1")


@query(f"""WITH {BOXES}, p AS (SELECT a.page, a.seq AS a, b.seq AS b, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS dx, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS dy FROM boxes a JOIN boxes b ON a.page = b.page AND a.seq < b.seq)
SELECT page, a, b, CASE WHEN dy > 20 THEN 'critical' WHEN dy > 8 THEN 'major' ELSE 'minor' END AS severity FROM p WHERE dx > 1 AND dy > 1""")
def q_box_collisions(t, spark):
    p = overlap.box_pairs(boxes(t), ["page"], 128.0, 1.0)
    return p.select("page", "a", "b", overlap.severity(F.col("dy"), 8.0, 20.0).alias("severity"))


@query(f"""WITH {BOXES}, l AS (SELECT DISTINCT o_orderkey AS page, o_orderkey AS id, (o_custkey * 31 % 500)::DOUBLE AS lx0, (o_custkey * 13 % 700)::DOUBLE AS ly0 FROM orders),
p AS (SELECT id, seq, lx0 + 30 BETWEEN x0 AND x1 AND ly0 + 15 BETWEEN y0 AND y1 AS inside, greatest(least(x1, lx0 + 60) - greatest(x0, lx0), 0) * greatest(least(y1, ly0 + 30) - greatest(y0, ly0), 0) AS common, (x1 - x0) * (y1 - y0) + 1800 AS total FROM l JOIN boxes USING (page))
SELECT id, arg_max(seq, (inside, CASE WHEN inside THEN 0.0 ELSE common / (total - common) END, -seq)) AS target FROM p WHERE inside OR common > 0 GROUP BY id""")
def q_link_targets(t, spark):
    x, y = (F.col("o_custkey") * 31 % 500).cast("double"), (F.col("o_custkey") * 13 % 700).cast("double")
    links = t("orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderkey").alias("id"), x.alias("lx0"), y.alias("ly0"), (x + 60).alias("lx1"), (y + 30).alias("ly1")).distinct()
    return joins.link_target(links, boxes(t), ["page"])


@query(f"""WITH {BOXES}, g AS (SELECT *, CASE WHEN y0 - max(y1) OVER (PARTITION BY page ORDER BY y0, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 18 THEN 0 ELSE 1 END AS s FROM boxes),
r AS (SELECT *, sum(s) OVER (PARTITION BY page ORDER BY y0, seq ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT page, arg_min(seq, (y0, seq)) AS seq, string_agg('b' || seq, ' ' ORDER BY y0, seq) AS text, min(y0) AS y0, max(y1) AS y1 FROM r GROUP BY page, run""")
def q_fragments(t, spark):
    return layout.merge_fragments(boxes(t).withColumn("text", F.concat(F.lit("b"), F.col("seq").cast("string"))))


@query(f"""WITH {BOXES}, o AS (SELECT page, seq, y0 AS want, sum(y1 - y0 + 2) OVER (PARTITION BY page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM boxes)
SELECT page, seq, coalesce(before, 0) + max(want - coalesce(before, 0)) OVER (PARTITION BY page ORDER BY seq ROWS UNBOUNDED PRECEDING) AS y FROM o""")
def q_solved_below(t, spark):
    return layout.solve_below(boxes(t).select("page", "seq", F.col("y0").alias("y"), (F.col("y1") - F.col("y0")).alias("height"), F.lit(2.0).alias("gap")))


# ----------------------------------------------------------------------- text


@query("SELECT p_partkey, 'a' || chr(9) || p_name || 'b' AS text FROM part")
def q_without_controls(t, spark):
    return t("part").select("p_partkey", words.without_controls(F.concat(F.lit("a\t\x01\x0b"), "p_name", F.lit("\x7f\x1fb"))).alias("text"))


@query("SELECT DISTINCT 'R' || chr(65 + r_regionkey) AS abbreviation, 'Region ' || chr(65 + r_regionkey) AS long_form FROM region")
def q_abbreviations(t, spark):
    letter = F.char(65 + F.col("r_regionkey"))
    return knowledge.abbreviations(t("region").select(F.concat(F.lit("1: Region "), letter, F.lit(" (R"), letter, F.lit(") and (x).")).alias("text")))


DOMAIN_WORDS = sorted({w for ws in words.GLOSSARY_DOMAINS.values() for w in ws} | set(words.DOMAIN_KEYWORDS))


def domain_texts(t):
    """Texts of two words of the fixed domain tables each."""
    table, k = F.array(*map(F.lit, DOMAIN_WORDS)), F.col("p_partkey")
    pick = lambda n: F.element_at(table, (n % len(DOMAIN_WORDS) + 1).cast("int"))
    return t("part").select("p_partkey", F.concat(F.lit("A "), pick(k), F.lit(" and the "), pick(k * 7 + 3)).alias("text"))


DOMAIN_TEXTS = f"x AS (SELECT p_partkey, 'A ' || {DOMAIN_WORDS!r}[p_partkey % {len(DOMAIN_WORDS)} + 1] || ' and the ' || {DOMAIN_WORDS!r}[(p_partkey * 7 + 3) % {len(DOMAIN_WORDS)} + 1] AS t FROM part)"
GLOSSARY_HITS = ", ".join(f"len(list_filter({list(ws)!r}, lambda w: contains(lower(t), w))) AS {d}" for d, ws in words.GLOSSARY_DOMAINS.items())


@query(f"WITH {DOMAIN_TEXTS}, h AS (SELECT p_partkey, {GLOSSARY_HITS} FROM x), g AS (SELECT *, greatest({', '.join(words.GLOSSARY_DOMAINS)}) AS m FROM h) SELECT p_partkey, CASE WHEN m = 0 THEN 'generic' {' '.join(f'WHEN {d} = m THEN {d!r}' for d in words.GLOSSARY_DOMAINS)} END AS domain FROM g")
def q_glossary_domains(t, spark):
    return domain_texts(t).select("p_partkey", words.best_domain(F.col("text")).alias("domain"))


@query(f"WITH {DOMAIN_TEXTS}, k AS (SELECT unnest({list(words.DOMAIN_KEYWORDS)!r}) AS word, unnest({list(words.DOMAIN_KEYWORDS.values())!r}) AS domain) SELECT p_partkey, domain, sum((length(t) - length(replace(lower(t), word, ''))) // length(word))::BIGINT AS score FROM x CROSS JOIN k GROUP BY p_partkey, domain")
def q_keyword_domains(t, spark):
    return domain_texts(t).select("p_partkey", F.explode(words.domain_scores(F.col("text"), words.DOMAIN_KEYWORDS)).alias("s")).select("p_partkey", "s.domain", "s.score")


@query("SELECT p_partkey, ['black', 'bold', 'semibold', 'plain', 'medium'][p_partkey % 5 + 1] AS font, CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.9 WHEN 3 THEN 0.0 ELSE 0.5 END::DOUBLE AS weight FROM part")
def q_font_weight(t, spark):
    font = F.element_at(F.array(*map(F.lit, ("black", "bold", "semibold", "plain", "medium"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t("part").select("p_partkey", font.alias("font"), classify.font_weight(F.concat(F.lit("X-"), F.initcap(font))).alias("weight"))


@query(f"""WITH {BLOCKS} SELECT 'p' || doc_id || '_' || block_idx AS id, substr(text, 1, 120) AS text FROM blocks WHERE n_words > 2 AND doc_id = 5 AND NOT contains(text, '�') AND NOT regexp_matches(text, '[(]cid:[0-9]+[)]')""")
def q_page_query(t, spark):
    q = DocumentQuery(model.text_blocks(t("documents"))).page(5).where(F.col("n_words") > 2).has_replacement(False)
    return q.execute().select("id", "text")


@query("WITH e AS (SELECT DISTINCT o_custkey % 40 AS src, (o_custkey % 40 + o_orderkey % 3) % 40 AS dst FROM orders WHERE o_custkey % 40 < 20) SELECT DISTINCT a.src AS id FROM e a WHERE a.src = a.dst")
def q_self_loops(t, spark):
    k = F.col("o_custkey") % 40
    e = t("orders").where(k < 20).select(k.alias("src"), ((k + F.col("o_orderkey") % 3) % 40).alias("dst")).distinct()
    return traverse.cyclic_nodes(e.select(F.col("src").alias("id")).distinct(), e.where("src = dst")).select("id")


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('click', 'error') AND user_id = 5")
def q_subscribed(t, spark):
    return t("events").where(log.matches(["click", "error"], 5)).select("event_id", "event_type", "user_id")
