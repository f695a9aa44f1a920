"""Named queries over the tables, each beside its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import classify, geometry
from .functions import text as words
from .operators import aggregates, annotate, diff, graph_query, joins, knowledge, layout, overlap, traverse, windows
from .operators.doc_query import DocumentQuery, effective_confidence, find_text, translation_status
from .plans.dag import incremental_plan
from .session import table
from .sources import blocks as model
from .streaming import events as log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def wide(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, others as DOUBLE."""
    kinds = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.select(*(F.col(c).cast(kinds.get(t, "double" if t.startswith("decimal") else t)).alias(c) if t in kinds or t.startswith("decimal") else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: wide(f(lambda name: table(spark, sf_dir, name), spark))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# SQL of the derived views.
LINES = "lines AS (SELECT doc_id, unnest(range(len(l))) AS block_idx, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
N_WORDS = "len(list_filter(string_split(text, ' '), lambda w: w <> ''))"
BLOCKS = f"""{LINES}, blocks AS (SELECT *, length(text) AS n_chars, {N_WORDS} AS n_words,
  CASE WHEN trim(text) = '' THEN 'empty' WHEN regexp_matches(text, '{model.CAPTION}') THEN 'caption' WHEN regexp_matches(text, '{model.LEADER}') THEN 'toc'
  WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '{model.SYMBOLS}') THEN 'formula'
  WHEN {N_WORDS} <= 6 AND NOT suffix(text, ',') THEN 'heading' ELSE 'paragraph' END AS kind FROM lines)"""
EVENTS = "ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"
EDITED = """edited AS (SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN text || ' edited' ELSE text END AS text, source FROM documents WHERE doc_id % 7 <> 0
  UNION ALL SELECT doc_id + 1000000, text, source FROM documents WHERE doc_id % 7 = 2)"""
HASH = "substr(sha1(coalesce(source, '') || '|' || coalesce(text, '')), 1, 16)"


def edited(docs: DataFrame) -> DataFrame:
    """A deterministic edit: ids that 7 divides are lost, remainder 1 altered, remainder 2 copied under new ids."""
    same = docs.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit(" edited"))).otherwise(F.col("text")).alias("text"), "source")
    return same.unionByName(docs.where("doc_id % 7 = 2").select((F.col("doc_id") + 1000000).alias("doc_id"), "text", "source"))


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", diff.content_hash(F.col("source"), F.col("text")).alias("hash"))


def part_edges(parts: DataFrame) -> DataFrame:
    """A binary tree over part keys: k to 2k and 2k + 1."""
    keys = parts.select(F.col("p_partkey").alias("dst"))
    return keys.where("dst > 1").select(F.floor(F.col("dst") / 2).alias("src"), "dst")


def geo_graph(t) -> tuple[DataFrame, DataFrame]:
    """Regions, nations and customers as nodes (id, node_type, hash), their keys as edges."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = diff.union_all(
        [
            t("region").select(key("r", "r_regionkey").alias("id"), F.lit("region").alias("node_type"), F.col("r_name").alias("hash")),
            t("nation").select(key("n", "n_nationkey").alias("id"), F.lit("nation").alias("node_type"), F.col("n_name").alias("hash")),
            t("customer").select(key("c", "c_custkey").alias("id"), F.lit("customer").alias("node_type"), F.col("c_mktsegment").alias("hash")),
        ]
    )
    edges = diff.union_all(
        [
            t("nation").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"), F.lit("has").alias("relation")),
            t("customer").select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst"), F.lit("has").alias("relation")),
        ]
    )
    return nodes, edges


GEO = """nodes AS (SELECT 'r' || r_regionkey AS id, 'region' AS node_type, r_name AS hash FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'customer', c_mktsegment FROM customer),
edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'has' AS relation FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'has' FROM customer)"""


def boxes(t) -> DataFrame:
    """Whole-numbered boxes from line items: an order is a page."""
    x, y = (F.col("l_partkey") * 37) % 500, (F.col("l_suppkey") * 53) % 700
    return t("lineitem").select(
        F.col("l_orderkey").alias("page"),
        F.col("l_linenumber").cast("bigint").alias("seq"),
        x.cast("double").alias("x0"),
        y.cast("double").alias("y0"),
        (x + 40 + F.col("l_quantity")).cast("double").alias("x1"),
        (y + 12 + F.col("l_quantity") % 30).cast("double").alias("y1"),
    ).distinct().groupBy("page", "seq").agg(*(F.min(c).alias(c) for c in ("x0", "y0", "x1", "y1")))


BOXES = """boxes AS (SELECT page, seq, min(x0) AS x0, min(y0) AS y0, min(x1) AS x1, min(y1) AS y1 FROM (
  SELECT l_orderkey AS page, l_linenumber::BIGINT AS seq, ((l_partkey * 37) % 500)::DOUBLE AS x0, ((l_suppkey * 53) % 700)::DOUBLE AS y0,
  ((l_partkey * 37) % 500 + 40 + l_quantity)::DOUBLE AS x1, ((l_suppkey * 53) % 700 + 12 + l_quantity % 30)::DOUBLE AS y1 FROM lineitem) GROUP BY page, seq)"""


# --------------------------------------------------------- filters and scans


@query(f"WITH {BLOCKS} SELECT 'p' || doc_id || '_' || block_idx AS id, doc_id AS page, block_idx AS idx, kind, substr(text, 1, 120) AS text, NULL::DOUBLE AS confidence, 'pending' AS status FROM blocks WHERE kind = 'heading'")
def q_doc_query(t, spark):
    return DocumentQuery(model.text_blocks(t("documents"))).kind("heading").execute()


@query(f"WITH {BLOCKS} SELECT doc_id, block_idx, kind FROM blocks WHERE contains(lower(text), 'license')")
def q_find_text(t, spark):
    return find_text(model.text_blocks(t("documents")), "License").select("doc_id", "block_idx", "kind")


@query("""SELECT doc_id, CASE WHEN quality = 0 THEN 'preserved' WHEN toxic = 1 THEN 'pending' WHEN doc_id % 5 = 0 THEN 'pending' ELSE 'done' END AS status
FROM documents JOIN labels USING (doc_id) WHERE text <> ''""")
def q_translation_status(t, spark):
    both = t("documents").join(t("labels"), "doc_id").where("text <> ''")
    made = F.when(F.col("toxic") == 1, "").when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.concat(F.lit("t:"), "text"))
    return both.select("doc_id", translation_status(F.col("quality") == 1, made, F.col("text")).alias("status"))


@query("SELECT doc_id FROM labels WHERE CASE WHEN quality = 0 THEN 1.0 ELSE 0.3 + 0.5 * toxic END < 0.6")
def q_confidence_below(t, spark):
    confidence = F.when(F.col("quality") == 0, 0.0).otherwise(F.lit(0.3) + F.lit(0.5) * F.col("toxic"))
    return t("labels").where(effective_confidence(confidence) < 0.6).select("doc_id")


def part_nodes(t) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("node_type"), F.col("p_brand").alias("brand"), F.col("p_size").cast("bigint").alias("size"), F.col("p_retailprice").alias("price"))


@query("SELECT p_partkey AS id, p_brand AS brand, p_retailprice AS price FROM part WHERE p_size >= 20 ORDER BY p_retailprice DESC NULLS FIRST, p_partkey LIMIT 50")
def q_match_where_order_limit(t, spark):
    return graph_query.parse_query("MATCH part WHERE size >= 20 ORDER BY price DESC LIMIT 50 RETURN id, brand, price", part_nodes(t)).run()


@query("SELECT count(*) AS total_matched FROM part WHERE p_size >= 20 AND p_brand <> 'Brand#11'")
def q_match_total(t, spark):
    return graph_query.GraphQuery(part_nodes(t)).match("part").where("size", ">=", 20).where("brand", "!=", "Brand#11").matched().agg(F.count("*").alias("total_matched"))


@query("SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier WHERE s_acctbal BETWEEN 1000 AND 5000")
def q_range(t, spark):
    return graph_query.in_range(t("supplier"), "s_acctbal", 1000, 5000).select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_nationkey = 7")
def q_find(t, spark):
    return graph_query.having(t("supplier"), s_nationkey=7).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


@query("SELECT s_suppkey AS id, round(abs(s_acctbal - 2500), 6) AS distance FROM supplier WHERE s_acctbal IS NOT NULL ORDER BY abs(s_acctbal - 2500), s_suppkey LIMIT 10")
def q_nearest(t, spark):
    found = graph_query.nearest(t("supplier"), "s_acctbal", 2500.0, 10, "s_suppkey")
    return found.select(F.col("s_suppkey").alias("id"), F.round("distance", 6).alias("distance"))


@query("SELECT p_type AS node_type, count(*) AS n FROM part GROUP BY p_type")
def q_type_counts(t, spark):
    return graph_query.type_counts(t("part").withColumnRenamed("p_type", "node_type"))


@query("""SELECT 'brand' AS prop, count(p_brand) AS size, count(DISTINCT p_brand) AS distinct_values FROM part
UNION ALL SELECT 'size', count(p_size), count(DISTINCT p_size) FROM part""")
def q_index_stats(t, spark):
    return graph_query.index_stats(part_nodes(t), ["brand", "size"])


@query("SELECT c_custkey AS id, 'segment' AS missing FROM customer WHERE c_nationkey % 5 = 0 AND c_acctbal < 0")
def q_schema_violations(t, spark):
    nodes = t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 5 == 0, "vip").otherwise("plain").alias("node_type"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"))
    return graph_query.violations(nodes, {"vip": ["segment"]}).select("id", F.array_join("missing", ",").alias("missing"))


@query("SELECT DISTINCT user_id, (('0x' || substr(md5('user:' || user_id), 1, 8))::BIGINT % 100) AS bucket FROM events WHERE ('0x' || substr(md5('user:' || user_id), 1, 8))::BIGINT % 100 < 30")
def q_stable_rollout(t, spark):
    return t("events").select("user_id", joins.rollout_bucket(F.col("user_id")).alias("bucket")).distinct().where("bucket < 30")


@query("SELECT event_id, CASE WHEN user_id IN (1, 2, 3) THEN 'allow' WHEN event_type = 'error' THEN 'type' WHEN value > 90 THEN 'range' ELSE 'default' END AS rule FROM events")
def q_rollout_rules(t, spark):
    rules = [("allow", F.col("user_id").isin(1, 2, 3)), ("type", F.col("event_type") == "error"), ("range", F.col("value") > 90)]
    return t("events").select("event_id", joins.first_rule(rules, "default").alias("rule"))


@query("""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1) AS block_idx, regexp_extract(raw, '^<(h1|p|li)>', 1) AS tag, regexp_replace(raw, '<[^>]*>', '', 'g') AS text
FROM (SELECT page_id, unnest(range(len(r))) AS i, unnest(r) AS raw FROM (SELECT page_id, regexp_extract_all(html, '<(h1|p|li)>([^\\n]*?)</(h1|p|li)>', 0) AS r FROM pages))""")
def q_html_blocks(t, spark):
    return model.html_blocks(t("pages"))


# -------------------------------------------------------------------- joins


def pairs(t) -> DataFrame:
    """Consecutive documents of a source, side by side."""
    w = F.row_number().over(windows.Window.partitionBy("source").orderBy("doc_id"))
    n = t("documents").select("doc_id", "source", "text", w.alias("ord"))
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.source") == F.col("b.source")) & (F.col("b.ord") == F.col("a.ord") + 1)).select(F.col("a.doc_id").alias("doc_id"), F.col("b.doc_id").alias("other_id"), F.col("a.text").alias("text"), F.col("b.text").alias("other"))


PAIRS = "numbered AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ord FROM documents), pairs AS (SELECT a.doc_id, b.doc_id AS other_id, a.text, b.text AS other FROM numbered a JOIN numbered b ON a.source = b.source AND b.ord = a.ord + 1)"
WORDSET = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[ \\n\\t]+'), lambda w: w <> ''))"


@query(f"""WITH {PAIRS}, sets AS (SELECT doc_id, other_id, {WORDSET.format('text')} AS x, {WORDSET.format('other')} AS y FROM pairs)
SELECT doc_id, other_id, round(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END, 6) AS dice FROM sets""")
def q_dice(t, spark):
    return pairs(t).select("doc_id", "other_id", F.round(diff.dice(F.col("text"), F.col("other")), 6).alias("dice"))


@query(f"""WITH {EDITED}, a AS (SELECT doc_id AS id, text, doc_id % 10 * 1.0 AS x0, 0.0 AS y0 FROM documents), b AS (SELECT doc_id AS id, text, doc_id % 10 + 3.0 AS x0, 4.0 AS y0 FROM edited),
j AS (SELECT a.id, b.text IS NOT NULL AS hit, {WORDSET.format('a.text')} AS x, {WORDSET.format('b.text')} AS y FROM a LEFT JOIN b USING (id))
SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS matched, round(avg(CASE WHEN hit THEN CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END END), 6) AS similarity, 5.0::DOUBLE AS displacement FROM j""")
def q_node_match(t, spark):
    at = lambda df, dx, dy: df.select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 10 + dx).cast("double").alias("x0"), F.lit(dy).alias("y0"))
    return diff.migration_report(at(t("documents"), 0.0, 0.0), at(edited(t("documents")), 3.0, 4.0))


@query("SELECT count(*) AS total, count(l.doc_id) AS present, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def q_missing_semi(t, spark):
    return joins.coverage_counts(t("documents"), t("labels"), ["doc_id"])


@query("""WITH v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
SELECT p.event_id, p.user_id, (SELECT v.event_id FROM v WHERE v.user_id = p.user_id AND (v.ts < p.ts OR (v.ts = p.ts AND v.event_id <= p.event_id)) ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS host_event_id FROM p""")
def q_asof_host(t, spark):
    left = t("events").where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = t("events").where("event_type = 'view'").select("user_id", "ts", "event_id", F.col("event_id").alias("view_id"))
    return joins.as_of(left, right, ["user_id"], ["ts", "event_id"], ["view_id"]).select("event_id", "user_id", F.col("host_view_id").alias("host_event_id"))


@query("""WITH v AS (SELECT user_id, epoch_us(ts) AS at, event_id FROM events WHERE event_type = 'signup'), e AS (SELECT user_id, epoch_us(ts) AS at, event_id FROM events WHERE event_type = 'error')
SELECT event_id, host_id, host_at FROM (SELECT e.event_id, v.event_id AS host_id, v.at AS host_at, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(v.at - e.at) NULLS LAST, v.at, v.event_id) AS r FROM e LEFT JOIN v USING (user_id)) WHERE r = 1""")
def q_nearest_host(t, spark):
    e = t("events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type")
    left = e.where("event_type = 'error'").select("user_id", "at", "event_id")
    right = e.where("event_type = 'signup'").select("user_id", "at", "event_id")
    return joins.nearest_host(left, right, ["user_id"], "at", "event_id").select("event_id", "host_id", "host_at")


@query(f"""WITH {BLOCKS}, h AS (SELECT doc_id, block_idx, kind, last_value(CASE WHEN kind IN ('table', 'heading') THEN block_idx END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS host FROM blocks)
SELECT doc_id, block_idx, host FROM h WHERE kind = 'table'""")
def q_caption_hosts(t, spark):
    marked = model.text_blocks(t("documents")).withColumn("kind", F.when(F.col("kind") == "table", "caption").otherwise(F.col("kind")))
    return joins.caption_hosts(marked, ["caption", "heading"])


@query(f"""WITH {LINES}, m AS (SELECT doc_id, block_idx, unnest(regexp_extract_all(text || ' see Fig. ' || (block_idx % 5 + 1) || ' and Table ' || (doc_id % 3), '{classify.MENTION}', 0)) AS raw FROM lines)
SELECT doc_id, block_idx, CASE WHEN lower(raw) LIKE 'fig%' THEN 'figure' WHEN lower(raw) LIKE 'tab%' THEN 'table' WHEN lower(raw) LIKE 'eq%' THEN 'equation' ELSE 'section' END AS target_type, regexp_extract(raw, '{classify.MENTION}', 2) AS number FROM m""")
def q_mentions(t, spark):
    return classify.mentions(cross_referenced(t)).select("doc_id", "block_idx", "target_type", "number")


def cross_referenced(t) -> DataFrame:
    """Blocks that end in references, which the tables' prose does not have."""
    more = F.concat("text", F.lit(" see Fig. "), (F.col("block_idx") % 5 + 1).cast("string"), F.lit(" and Table "), (F.col("doc_id") % 3).cast("string"))
    return model.text_blocks(t("documents")).withColumn("text", more)


@query(f"""WITH {LINES}, b AS (SELECT doc_id, block_idx, CASE WHEN block_idx % 4 = 0 THEN 'Figure ' || (block_idx // 4) || ': ' || text ELSE text || ' see Fig. ' || (block_idx % 5 + 1) END AS text FROM lines),
h AS (SELECT doc_id, regexp_extract(text, '^Figure ([0-9]+)', 1) AS number, min(block_idx) AS target FROM b WHERE block_idx % 4 = 0 GROUP BY 1, 2)
SELECT b.doc_id, b.block_idx, 'figure' AS target_type, h.number, h.target FROM b JOIN h ON h.doc_id = b.doc_id AND h.number = CASE WHEN b.block_idx % 4 = 0 THEN (b.block_idx // 4)::VARCHAR ELSE (b.block_idx % 5 + 1)::VARCHAR END""")
def q_resolved_mentions(t, spark):
    i = F.col("block_idx")
    made = F.when(i % 4 == 0, F.concat(F.lit("Figure "), F.floor(i / 4).cast("string"), F.lit(": "), "text")).otherwise(F.concat("text", F.lit(" see Fig. "), (i % 5 + 1).cast("string")))
    b = model.text_blocks(t("documents")).withColumn("text", made).withColumn("kind", F.when(i % 4 == 0, "caption").otherwise("paragraph"))
    return classify.resolve_mentions(b).select("doc_id", "block_idx", "target_type", "number", "target")


@query("""WITH terms AS (SELECT DISTINCT lower(unnest(string_split(text, ' '))) AS term FROM benchmark),
w AS (SELECT doc_id, lower(unnest(string_split(text, ' '))) AS term FROM documents)
SELECT doc_id, term, count(*) AS hits FROM w JOIN terms USING (term) WHERE term <> '' GROUP BY doc_id, term""")
def q_glossary_hits(t, spark):
    terms = t("benchmark").select(F.explode(F.split("text", " ")).alias("term"))
    return joins.word_hits(t("documents"), terms, "doc_id")


@query("""WITH g AS (SELECT n_name AS source, 'N' || n_nationkey AS target, n_nationkey AS seq FROM nation), q AS (SELECT DISTINCT 'see ' || n_name || ' now' AS term FROM nation UNION SELECT n_name FROM nation WHERE n_nationkey < 10 UNION SELECT 'nothing')
SELECT term, target FROM (SELECT q.term, g.target, row_number() OVER (PARTITION BY q.term ORDER BY (g.source = q.term) DESC NULLS LAST, length(g.source) DESC, g.seq) AS r FROM q LEFT JOIN g ON contains(' ' || lower(q.term) || ' ', ' ' || lower(g.source) || ' ')) WHERE r = 1""")
def q_glossary_lookup(t, spark):
    n = t("nation")
    glossary = n.select(F.col("n_name").alias("source"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("target"), F.col("n_nationkey").alias("seq"))
    terms = n.select(F.concat(F.lit("see "), "n_name", F.lit(" now")).alias("term")).union(n.where("n_nationkey < 10").select("n_name")).union(spark.createDataFrame([("nothing",)], "term string"))
    return joins.glossary_lookup(terms, glossary)


@query("""SELECT id, string_agg(name, ',' ORDER BY name) AS members, count(*) AS coverage FROM (SELECT DISTINCT doc_id AS id, 'documents' AS name FROM documents UNION ALL SELECT DISTINCT doc_id, 'labels' FROM labels
UNION ALL SELECT DISTINCT item_id, 'benchmark' FROM benchmark) GROUP BY id""")
def q_membership(t, spark):
    return joins.membership({"documents": t("documents").withColumnRenamed("doc_id", "id"), "labels": t("labels").withColumnRenamed("doc_id", "id"), "benchmark": t("benchmark").withColumnRenamed("item_id", "id")})


@query(f"WITH {GEO} SELECT DISTINCT src AS id, dst AS neighbor FROM edges WHERE src IN ('r0', 'r1', 'n3') UNION SELECT DISTINCT dst, src FROM edges WHERE dst IN ('r0', 'r1', 'n3')")
def q_neighbors(t, spark):
    _, edges = geo_graph(t)
    return graph_query.neighbors(edges, spark.createDataFrame([("r0",), ("r1",), ("n3",)], "id string"), "both")


# ------------------------------------------------------------------ overlaps

SPANS = "spans AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS lo, epoch_us(ts) // 1000000 + (value * 60)::BIGINT + 1 AS hi FROM events WHERE value IS NOT NULL)"


def spans(t) -> DataFrame:
    lo = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    return t("events").where("value is not null").select("user_id", "event_id", lo.alias("lo"), (lo + F.bround(F.col("value") * 60).cast("bigint") + 1).alias("hi"))


@query(f"""WITH {SPANS}, p AS (SELECT least(a.hi, b.hi) - greatest(a.lo, b.lo) AS amount FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.event_id < b.event_id AND least(a.hi, b.hi) > greatest(a.lo, b.lo))
SELECT CASE WHEN amount > 1800 THEN 'critical' WHEN amount > 600 THEN 'major' ELSE 'minor' END AS severity, count(*) AS n FROM p GROUP BY 1""")
def q_collisions(t, spark):
    found = overlap.interval_pairs(spans(t), ["user_id"], "event_id", "lo", "hi", 7200.0)
    return found.groupBy(overlap.severity(F.col("amount"), 600, 1800).alias("severity")).agg(F.count("*").alias("n"))


@query(f"""WITH {BOXES}, hit AS (SELECT DISTINCT a.page, a.seq FROM boxes a JOIN boxes b ON a.page = b.page AND a.seq < b.seq AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0))
SELECT count(*) AS boxes, count(hit.seq) AS overlapping, round(count(hit.seq) / greatest(count(*), 1), 6) AS rate FROM boxes LEFT JOIN hit USING (page, seq)""")
def q_overlap_rate(t, spark):
    return overlap.overlap_rate(boxes(t), ["page"], 128.0)


@query(f"WITH {BOXES} SELECT count(*) AS boxes, count(*) FILTER (WHERE x1 > 510 OR y1 > 714) AS outside, round(count(*) FILTER (WHERE x1 > 510 OR y1 > 714) / greatest(count(*), 1), 6) AS rate FROM boxes")
def q_overflow_rate(t, spark):
    return overlap.overflow_rate(boxes(t), 500.0, 700.0)


@query(f"""WITH {BOXES}, j AS (SELECT a.page, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS both_area,
(a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS total FROM boxes a JOIN boxes b ON a.page = b.page AND a.seq = 1 AND b.seq = 2) SELECT page, round(both_area / (total - both_area), 6) AS iou FROM j""")
def q_rect_iou(t, spark):
    b = boxes(t)
    r = lambda df, n: df.select("page", geometry.rect(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias(n))
    return r(b.where("seq = 1"), "a").join(r(b.where("seq = 2"), "b"), "page").select("page", F.round(geometry.iou(F.col("a"), F.col("b")), 6).alias("iou"))


# -------------------------------------------------------------- aggregations


@query(f"""WITH {BLOCKS} SELECT doc_id, count(*) AS blocks, sum(n_chars)::BIGINT AS chars, sum(n_words)::BIGINT AS words,
{', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in ('heading', 'paragraph', 'caption', 'toc', '"table"'.strip('"'), 'formula', 'empty')).replace('AS table', 'AS "table"')} FROM blocks GROUP BY doc_id""")
def q_profile(t, spark):
    return aggregates.profile(model.text_blocks(t("documents")), "doc_id")


@query("""SELECT event_type AS operation, count(*) AS n, round(sum(value), 2) AS total, min(value) AS least, max(value) AS most, round(avg(value), 2) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95,
count(*) FILTER (WHERE event_type = 'error') AS errors, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS error_rate FROM events GROUP BY event_type""")
def q_telemetry(t, spark):
    return aggregates.telemetry(t("events"), "event_type", "value", F.col("event_type") == "error")


@query("""SELECT o_orderpriority AS stage, count(*) AS tasks, round(sum(o_totalprice), 2) AS weight, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS done,
round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 6) AS share FROM orders GROUP BY 1""")
def q_progress_stage(t, spark):
    return aggregates.stage_breakdown(t("orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", "F")


@query(f"""WITH {BLOCKS}, c AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'paragraph') AS p, count(*) FILTER (WHERE kind = 'heading') AS h, count(*) FILTER (WHERE kind = 'formula') AS f, count(*) FILTER (WHERE kind = 'table') AS t, count(*) AS l FROM blocks GROUP BY doc_id)
SELECT doc_id, 'Parser' AS pass, 4.0::DOUBLE AS weight FROM c UNION ALL SELECT doc_id, 'SemanticAnalysis', (p * 2 + f * 8 + t * 12)::DOUBLE FROM c UNION ALL SELECT doc_id, 'Translation', (p * 10 + f * 25 + t * 30 + h * 4)::DOUBLE FROM c
UNION ALL SELECT doc_id, 'Layout', l * 0.5 + 2 FROM c UNION ALL SELECT doc_id, 'Render', 3.0 FROM c""")
def q_pass_weights(t, spark):
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    counts = model.text_blocks(t("documents")).groupBy("doc_id").agg(F.lit(1).alias("pages"), n("paragraph").alias("paragraphs"), n("heading").alias("headings"), n("formula").alias("formulas"), n("table").alias("tables"), F.count("*").alias("lines"), F.lit(0).alias("images"))
    return aggregates.pass_weights(counts)


@query(f"""WITH {BLOCKS} SELECT doc_id, count(*) FILTER (WHERE kind = 'heading') AS headings, count(*) FILTER (WHERE kind = 'paragraph') AS body, count(*) FILTER (WHERE kind = 'caption') AS captions, count(*) FILTER (WHERE kind = 'formula') AS formulas,
count(*) FILTER (WHERE kind = 'table') AS tables, count(*) FILTER (WHERE kind = 'toc') AS toc, count(*) FILTER (WHERE kind = 'empty') AS other FROM blocks GROUP BY doc_id""")
def q_ir_buckets(t, spark):
    return aggregates.bucket_counts(model.text_blocks(t("documents")), "doc_id")


@query("""SELECT source, count(*) AS pages, round(avg(s), 4) AS total, min(s) AS least, avg(s) >= 90 AND min(s) >= 75 AS passed FROM (SELECT source, round(greatest(0, least(100, 70.0 + 30.0 * quality - 20.0 * toxic)), 1) AS s FROM documents JOIN labels USING (doc_id)) GROUP BY source""")
def q_quality_gate(t, spark):
    score = aggregates.composite([(F.lit(100.0), 0.7), (F.col("quality"), 30.0), (F.col("toxic"), -20.0)])
    return aggregates.gate(t("documents").join(t("labels"), "doc_id").select("source", score.alias("s")), "source", "s")


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE quality::DOUBLE END AS a, CASE WHEN toxic = 1 THEN 0.1::DOUBLE ELSE 0.9::DOUBLE END AS b FROM labels),
f AS (SELECT doc_id, CASE WHEN a IS NULL THEN b ELSE (2 * a + b) / 3 END AS m, CASE WHEN a IS NULL THEN 0 ELSE abs(a - b) END AS spread, greatest(coalesce(a, b), b) AS hi, least(coalesce(a, b), b) AS lo FROM s)
SELECT doc_id, round(greatest(0, least(0.99, CASE WHEN spread <= 0.15 THEN m + 0.05 WHEN hi >= 0.8 AND lo < 0.3 THEN m * 0.8 ELSE m END)), 6) AS confidence FROM f""")
def q_evidence(t, spark):
    a = F.when(F.col("doc_id") % 4 != 0, F.col("quality").cast("double"))
    return t("labels").select("doc_id", F.round(aggregates.fuse([(a, 2.0), (F.when(F.col("toxic") == 1, 0.1).otherwise(0.9), 1.0)]), 6).alias("confidence"))


@query("""SELECT g::DOUBLE AS threshold, round(avg(CASE WHEN (value >= g) = (event_type = 'purchase') THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM events, (SELECT unnest([10.0, 50.0, 90.0]) AS g) GROUP BY g""")
def q_calibrate(t, spark):
    return aggregates.calibrate(t("events").where("value is not null").withColumn("label", F.col("event_type") == "purchase"), "value", "label", [10.0, 50.0, 90.0])


@query("SELECT p_brand AS brand, count(*) AS n, round(var_pop(p_size), 6) AS variance FROM part GROUP BY p_brand HAVING count(*) >= 3")
def q_type_variance(t, spark):
    return aggregates.type_variance(t("part").withColumnRenamed("p_brand", "brand"), "brand", "p_size")


@query("SELECT p_brand AS brand, l[len(l) // 2 + 1] AS median FROM (SELECT p_brand, list_sort(list(p_size::BIGINT)) AS l FROM part WHERE p_size IS NOT NULL GROUP BY p_brand)")
def q_upper_median(t, spark):
    return windows.upper_median(t("part").withColumnRenamed("p_brand", "brand"), "brand", "p_size")


@query("""SELECT source, lang AS mode, w AS weight FROM (SELECT source, lang, sum(n_chars)::BIGINT AS w, row_number() OVER (PARTITION BY source ORDER BY sum(n_chars) DESC, min(doc_id)) AS r FROM documents GROUP BY source, lang) WHERE r = 1""")
def q_weighted_mode(t, spark):
    return windows.weighted_mode(t("documents"), "source", "lang", "n_chars", "doc_id")


# ------------------------------------------------------- windows and sequences


@query("""SELECT event_id, count(*) OVER w AS n_window, round(sum(value) OVER w, 4) AS value_window FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTES PRECEDING AND CURRENT ROW)""")
def q_eta_rate(t, spark):
    return windows.trailing_rate(t("events"), 60).select("event_id", "n_window", F.round("value_window", 4).alias("value_window"))


@query("""WITH w AS (SELECT conv_id, turn, list(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, list(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a FROM conversations)
SELECT conv_id, turn, coalesce(array_to_string(list_filter(b, lambda x: trim(x) <> ''), ' / '), '') AS before, coalesce(array_to_string(list_filter(a, lambda x: trim(x) <> ''), ' / '), '') AS after FROM w""")
def q_context_window(t, spark):
    return windows.context(t("conversations"), "conv_id", "turn").select("conv_id", "turn", "before", "after")


@query(f"""WITH {BLOCKS} SELECT doc_id, block_idx, CASE WHEN kind <> 'toc' THEN last_value(CASE WHEN kind = 'heading' THEN block_idx END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS section FROM blocks""")
def q_section_carry(t, spark):
    return windows.carry_sections(model.text_blocks(t("documents"))).select("doc_id", "block_idx", "section")


@query(f"""WITH {LINES}, n AS (SELECT doc_id, block_idx, length(text)::DOUBLE AS b, lag(length(text)::DOUBLE) OVER (PARTITION BY doc_id ORDER BY block_idx) AS a FROM lines)
SELECT doc_id, block_idx, sum(CASE WHEN least(a, b) > 0 AND a IS NOT NULL AND greatest(a, b) / least(a, b) >= 1.6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM n""")
def q_layout_split(t, spark):
    return windows.split_by_ratio(model.text_blocks(t("documents"))).select("doc_id", "block_idx", "part")


@query("""WITH g AS (SELECT *, CASE WHEN date_diff('second', lag(ts) OVER w, ts) > 3600 THEN 1 ELSE 0 END AS s FROM (SELECT user_id, event_id, date_trunc('second', ts) AS ts FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT user_id, island::BIGINT AS island, count(*) AS n FROM i GROUP BY 1, 2""")
def q_merge_islands(t, spark):
    e = t("events").select("user_id", "event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    return windows.sessions(e, 3600).select("user_id", "island", "n")


@query(f"WITH {LINES} SELECT doc_id || '_' || block_idx AS src, doc_id || '_' || (block_idx + 1) AS dst FROM lines a WHERE EXISTS (SELECT 1 FROM lines b WHERE b.doc_id = a.doc_id AND b.block_idx = a.block_idx + 1)")
def q_reading_edges(t, spark):
    b = model.text_blocks(t("documents")).withColumn("id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("block_idx").cast("string")))
    return windows.reading_edges(b, "doc_id", ["block_idx"], "id")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 1""")
def q_undo_versions(t, spark):
    marked = windows.versions(t("orders"), "o_custkey", ["o_orderdate", "o_orderkey"])
    return marked.where("not current").select("o_orderkey", "version")


@query(f"""WITH {LINES}, h AS (SELECT doc_id, block_idx, 1 + length(text) % 4 AS level FROM lines WHERE length(text) < 60)
SELECT doc_id, block_idx, level, (SELECT max(p.block_idx) FROM h p WHERE p.doc_id = h.doc_id AND p.block_idx < h.block_idx AND p.level < h.level) AS parent FROM h""")
def q_section_parents(t, spark):
    heads = model.text_blocks(t("documents")).where("n_chars < 60").select("doc_id", "block_idx", (1 + F.col("n_chars") % 4).alias("level"))
    return windows.section_parents(heads, "doc_id", "block_idx")


@query(f"""WITH {LINES}, p AS (SELECT *, sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING) AS paragraph FROM lines)
SELECT doc_id, paragraph::BIGINT AS paragraph, replace(regexp_replace(string_agg(trim(text), chr(10) ORDER BY block_idx), '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g'), chr(10), ' ') AS text FROM p WHERE trim(text) <> '' GROUP BY doc_id, paragraph""")
def q_paragraphs(t, spark):
    return windows.paragraphs(model.text_blocks(t("documents")))


@query("""WITH RECURSIVE p AS (SELECT user_id AS task, epoch_us(ts) / 1e6 AS sec, least(value, 100.0) AS real, row_number() OVER (PARTITION BY user_id ORDER BY ts, least(value, 100.0)) AS k FROM events WHERE value IS NOT NULL),
s AS (SELECT task, k, sec, CASE WHEN real >= 100 THEN 100.0::DOUBLE ELSE greatest(0.0, real * (1 - pow(0.92, 1.0))) END AS shown FROM p WHERE k = 1
UNION ALL SELECT p.task, p.k, p.sec, CASE WHEN real >= 100 THEN 100.0 ELSE greatest(shown, shown + (real - shown) * (1 - pow(0.92, greatest(1.0, (p.sec - s.sec) / 0.1)))) END FROM s JOIN p ON p.task = s.task AND p.k = s.k + 1)
SELECT task, round(arg_max(shown, k), 6) AS shown FROM s GROUP BY task""")
def q_smoothed(t, spark):
    p = t("events").where("value is not null").select(F.col("user_id").alias("task"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.least(F.col("value"), F.lit(100.0)).alias("real"))
    return windows.smoothed(p).select("task", F.round("shown", 6).alias("shown"))


@query(rf"""WITH RECURSIVE {BLOCKS}, x AS (SELECT doc_id, block_idx::BIGINT AS seq, (block_idx % 5 + 1) || '.' || (block_idx % 3) || ' ' || text AS t FROM blocks WHERE kind = 'heading'),
e AS (SELECT doc_id, seq, CASE WHEN regexp_matches(trim(t), '^[0-9]+[.][0-9]+[ \t]') THEN regexp_extract(trim(t), '^([0-9]+[.][0-9]+)', 1) ELSE regexp_extract(t, '^([0-9]+)', 1) END AS number, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM x),
s AS (SELECT doc_id, seq, k, number, [{{'seq': seq, 'number': number}}] AS stack, 0::BIGINT AS best FROM e WHERE k = 1
UNION ALL SELECT doc_id, seq, k, number, stack[1:best] || [{{'seq': seq, 'number': number}}], best FROM (SELECT e.doc_id, e.seq, e.k, e.number, stack, coalesce(list_max(list_filter(range(1, len(stack) + 1), lambda i: starts_with(e.number, stack[i].number || '.'))), 0) AS best FROM s JOIN e ON e.doc_id = s.doc_id AND e.k = s.k + 1))
SELECT doc_id, seq, number, CASE WHEN best > 0 THEN stack[best].seq END AS parent, best AS depth FROM s""")
def q_outline(t, spark):
    e = classify.toc_entry(F.concat(((F.col("block_idx") % 5) + 1).cast("string"), F.lit("."), (F.col("block_idx") % 3).cast("string"), F.lit(" "), "text"))
    b = model.text_blocks(t("documents")).where("kind = 'heading'").withColumn("e", e)
    return windows.outline(b.select("doc_id", F.col("block_idx").cast("bigint").alias("seq"), "e.number", "e.level"))


# ------------------------------------------------------------- sets and diffs


@query(f"""WITH {EDITED}, a AS (SELECT doc_id, {HASH} AS h FROM documents), b AS (SELECT doc_id, {HASH} AS h FROM edited)
SELECT doc_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'updated' END AS change FROM a FULL JOIN b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h""")
def q_snapshot_diff(t, spark):
    return diff.snapshot_diff(hashed(t("documents")), hashed(edited(t("documents"))), "doc_id", "hash")


@query("SELECT doc_id, substr(sha1(coalesce(source, '') || '|' || coalesce(text, '')), 1, 16) AS hash FROM documents")
def q_content_hash(t, spark):
    return hashed(t("documents"))


@query("""WITH a AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer), b AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'CHANGED' ELSE segment END AS segment, balance FROM a)
SELECT a.id, 'segment' AS path, a.segment AS before, b.segment AS after FROM a JOIN b USING (id) WHERE a.segment IS DISTINCT FROM b.segment""")
def q_field_diff(t, spark):
    a = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    b = a.withColumn("segment", F.when(F.col("id") % 11 == 0, "CHANGED").otherwise(F.col("segment")))
    return diff.field_diff(a, b, "id", ["segment", "balance"])


@query(f"""WITH {GEO}, n2 AS (SELECT id, CASE WHEN id LIKE 'n1%' THEN 'x' ELSE hash END AS hash FROM nodes WHERE id NOT LIKE 'c1%'), e2 AS (SELECT * FROM edges WHERE dst NOT LIKE 'c1%')
SELECT 'node' AS what, CASE WHEN b.id IS NULL THEN 'removed' ELSE 'updated' END AS change, count(*) AS n FROM nodes a LEFT JOIN n2 b USING (id) WHERE b.id IS NULL OR a.hash <> b.hash GROUP BY 1, 2
UNION ALL SELECT 'edge', 'removed', count(*) FROM (SELECT * FROM edges EXCEPT SELECT * FROM e2)""")
def q_graph_diff(t, spark):
    nodes, edges = geo_graph(t)
    after = nodes.where("id not like 'c1%'").withColumn("hash", F.when(F.col("id").like("n1%"), "x").otherwise(F.col("hash")))
    return diff.graph_diff((nodes, edges), (after, edges.where("dst not like 'c1%'")))


@query(f"""WITH {GEO}, l AS (SELECT id, node_type, hash FROM nodes WHERE node_type <> 'customer'), r AS (SELECT id, node_type, 'right' AS hash FROM nodes WHERE node_type <> 'region'),
m AS (SELECT * FROM l UNION ALL SELECT * FROM r WHERE id NOT IN (SELECT id FROM l)) SELECT node_type, hash = 'right' AS from_right, count(*) AS n FROM m GROUP BY 1, 2""")
def q_graph_merge(t, spark):
    nodes, edges = geo_graph(t)
    merged, _ = diff.merge_graphs((nodes.where("node_type <> 'customer'"), edges), (nodes.where("node_type <> 'region'").withColumn("hash", F.lit("right")), edges))
    return merged.groupBy("node_type", (F.col("hash") == "right").alias("from_right")).agg(F.count("*").alias("n"))


@query(f"WITH {GEO}, k AS (SELECT id FROM nodes WHERE node_type <> 'region') SELECT src, dst FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def q_subgraph(t, spark):
    nodes, edges = geo_graph(t)
    return diff.subgraph(nodes, edges, nodes.where("node_type <> 'region'"))[1].select("src", "dst")


@query("""WITH a AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), b AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 7 <> 0 AND lang <> 'es' GROUP BY lang)
SELECT lang, a.n AS before, b.n AS after, CASE WHEN a.n IS NULL THEN 'missing_a' WHEN b.n IS NULL THEN 'missing_b' ELSE 'changed' END AS status FROM a FULL JOIN b USING (lang) WHERE a.n IS DISTINCT FROM b.n""")
def q_bucket_diff(t, spark):
    n = lambda df: df.groupBy("lang").agg(F.count("*").alias("n"))
    return diff.bucket_diff(n(t("documents")), n(t("documents").where("doc_id % 7 <> 0 and lang <> 'es'")), ["lang"])


@query("""WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations), s AS (SELECT conv_id, turn, list_sort(list_filter(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z]*[.]', 0)), lambda x: NOT list_contains(list_distinct(regexp_extract_all(coalesce(reply, ''), '[A-Za-z]*[.]', 0)), x))) AS m FROM p)
SELECT conv_id, turn, array_to_string(m, ' ') AS missing FROM s WHERE len(m) > 0""")
def q_review_tokens(t, spark):
    reply = F.lead("text").over(windows.Window.partitionBy("conv_id").orderBy("turn"))
    found = t("conversations").withColumn("reply", reply).select("conv_id", "turn", diff.missing_tokens(F.col("text"), F.col("reply"), "[A-Za-z]*[.]").alias("m"))
    return found.where(F.size("m") > 0).select("conv_id", "turn", F.array_join("m", " ").alias("missing"))


# --------------------------------------------------- text and classification


@query("SELECT doc_id, lower(replace(replace(trim(source), ' ', '_'), '-', '_')) AS key, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS flat FROM documents")
def q_normalize(t, spark):
    return t("documents").select("doc_id", words.entity_key(F.col("source")).alias("key"), words.collapse(F.col("text")).alias("flat"))


@query("SELECT doc_id, replace(replace(replace(replace(trim(replace(text, chr(13) || chr(10), chr(10)), ' ' || chr(9) || chr(10) || chr(13)), ' ,', ','), ' .', '.'), ' )', ')'), '( ', '(') AS text FROM documents")
def q_post_process(t, spark):
    return t("documents").select("doc_id", words.post_process(F.col("text")).alias("text"))


@query("SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) = 0 THEN 'unknown' ELSE 'en' END AS detected FROM documents WHERE text IS NOT NULL")
def q_language(t, spark):
    return t("documents").where("text is not null").select("doc_id", words.language(F.col("text")).alias("detected"))


SYLLABLES = {"the": "short", "and": "short", "tion": "ending", "ment": "ending", "heit": "ending"}


@query("""SELECT doc_id, 'short' AS domain, ((length(t) - length(replace(t, 'the', ''))) // 3 + (length(t) - length(replace(t, 'and', ''))) // 3)::BIGINT AS score FROM (SELECT doc_id, lower(text) AS t FROM documents)
UNION ALL SELECT doc_id, 'ending', ((length(t) - length(replace(t, 'tion', ''))) // 4 + (length(t) - length(replace(t, 'ment', ''))) // 4 + (length(t) - length(replace(t, 'heit', ''))) // 4)::BIGINT FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def q_domain_scores(t, spark):
    return t("documents").select("doc_id", F.explode(words.domain_scores(F.col("text"), SYLLABLES)).alias("s")).select("doc_id", "s.domain", "s.score")


@query("""WITH h AS (SELECT doc_id, contains(t, 'the ')::INT + contains(t, ' of ')::INT AS a, contains(t, ' der ')::INT + contains(t, ' und ')::INT AS b FROM (SELECT doc_id, lower(text) AS t FROM documents))
SELECT doc_id, CASE WHEN greatest(a, b) = 0 THEN 'generic' WHEN a >= b THEN 'english' ELSE 'german' END AS domain FROM h""")
def q_best_domain(t, spark):
    return t("documents").select("doc_id", words.best_domain(F.col("text"), {"english": ("the ", " of "), "german": (" der ", " und ")}).alias("domain"))


@query(f"""WITH {LINES}, w AS (SELECT doc_id, block_idx, trim(text) AS t, len(list_filter(regexp_split_to_array(trim(text), '[ \\t\\n]+'), lambda w: w <> '')) AS n FROM lines)
SELECT doc_id, block_idx, CASE WHEN t = '' THEN 'keep' WHEN regexp_matches(t, '\\{{ *v[0-9]+ *\\}}') THEN 'keep' WHEN regexp_matches(t, '^[-0-9%. ,:;()\\t\\n]+$') THEN 'keep' WHEN regexp_matches(t, '[{{}}_\\\\]|:[A-Za-z0-9_]+ *=') AND n <= 8 THEN 'keep' ELSE 'translate' END AS route,
round(CASE WHEN t = '' THEN 0.0 WHEN regexp_matches(t, '\\{{ *v[0-9]+ *\\}}') THEN 0.1 WHEN regexp_matches(t, '^[-0-9%. ,:;()\\t\\n]+$') THEN 0.2 WHEN regexp_matches(t, '[{{}}_\\\\]|:[A-Za-z0-9_]+ *=') AND n <= 8 THEN 0.3
WHEN NOT regexp_matches(t, '[A-Za-zÀ-ɏ一-鿿]') THEN 0.45 WHEN n BETWEEN 2 AND 12 THEN 0.7 WHEN n BETWEEN 13 AND 60 THEN 0.8 WHEN n > 60 THEN 0.85 ELSE 0.5 END, 4)::DOUBLE AS confidence FROM w""")
def q_route(t, spark):
    b = model.text_blocks(t("documents")).withColumn("r", words.route(F.col("text")))
    return b.select("doc_id", "block_idx", "r.route", F.round("r.confidence", 4).alias("confidence"))


@query(f"""WITH {BLOCKS} SELECT doc_id, block_idx, round_even(greatest(0.05, least(0.99, CASE WHEN trim(text) = '' THEN 0.1 ELSE CASE kind WHEN 'toc' THEN 0.55 WHEN 'heading' THEN 0.65 WHEN 'caption' THEN 0.6 WHEN 'formula' THEN 0.6 WHEN 'paragraph' THEN 0.85 ELSE 0.7 END * CASE WHEN n_chars > 2000 THEN 0.8 ELSE 1.0 END END))::DOUBLE, 3) AS confidence FROM blocks""")
def q_confidence(t, spark):
    b = model.text_blocks(t("documents"))
    c = classify.node_confidence(F.col("kind"), F.lit(None).cast("double"), F.contains("text", F.lit("�")), F.col("n_chars") > 2000, F.trim("text") == "")
    return b.select("doc_id", "block_idx", c.alias("confidence"))


@query(f"""WITH {BLOCKS} SELECT kind, CASE WHEN kind IN ('formula', 'table') THEN false ELSE true END AS translate, CASE WHEN kind IN ('formula', 'table') THEN 'kind:' || kind WHEN kind = 'toc' THEN 'toc:title_only'
WHEN kind = 'caption' THEN CASE WHEN regexp_matches(text, '(?i)^[ ]*((figure|fig|table|tab|equation)[. ]*)?([0-9]+([.][0-9]+)*)') THEN 'caption:keep_number' ELSE 'caption' END ELSE 'body' END AS reason, count(*) AS n FROM blocks GROUP BY 1, 2, 3""")
def q_policy(t, spark):
    b = model.text_blocks(t("documents")).withColumn("p", classify.policy(F.col("kind"), F.col("text")))
    return b.groupBy("kind", "p.translate", "p.reason").agg(F.count("*").alias("n")).select("kind", "translate", "reason", "n")


@query(f"""WITH {BLOCKS} SELECT code, severity, count(*) AS n FROM (SELECT 'unicode_error' AS code, 'error' AS severity FROM blocks WHERE contains(text, '�')
UNION ALL SELECT 'toc_merged_lines', 'error' FROM blocks WHERE (len(regexp_extract_all(text, '[0-9]+[.][0-9]+')) >= 2 AND regexp_matches(text, '[.]{{3,}}')) OR len(regexp_extract_all(text, '[0-9]+[.][0-9]+')) >= 3
UNION ALL SELECT 'empty_block', 'info' FROM blocks WHERE trim(text) = '' UNION ALL SELECT 'translation_overflow', 'warning' FROM blocks WHERE n_chars > 2000
UNION ALL SELECT 'formula_low_confidence', 'warning' FROM blocks WHERE kind = 'formula' AND length(regexp_replace(text, '[-+*/=^_{{}}<>()~]', '', 'g')) > 0.5 * length(text)) GROUP BY 1, 2""")
def q_diagnostics(t, spark):
    return classify.issues(model.text_blocks(t("documents"))).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES} SELECT doc_id, block_idx, round(CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) / length(text) END, 6) AS digit_ratio,
round(CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) / length(text) END, 6) AS capital_ratio FROM lines""")
def q_features(t, spark):
    f = classify.features(F.col("text"))
    return model.text_blocks(t("documents")).select("doc_id", "block_idx", F.round(f["digit_ratio"], 6).alias("digit_ratio"), F.round(f["capital_ratio"], 6).alias("capital_ratio"))


@query(rf"""WITH {LINES}, x AS (SELECT trim(text) AS t FROM lines), f AS (SELECT t, length(t) AS n, length(regexp_replace(t, '[-+*/=^_{{}}<>()~]', '', 'g')) AS plain, length(regexp_replace(t, '{classify.LEADER_CHARS}', '', 'g')) AS no_leader, length(regexp_replace(t, '[A-Za-z0-9À-ɏ]', '', 'g')) AS no_letter FROM x),
r AS (SELECT CASE WHEN t = '' THEN 'unknown' WHEN regexp_matches(t, '^[0-9]{{1,4}}$') OR (regexp_matches(t, '(?i)^[ivxlcdm]+$') AND n <= 8) THEN 'page_number' WHEN (n - no_leader) / n >= 0.08 AND regexp_matches(t, '{classify.LEADER_LINE}') THEN 'toc_entry'
WHEN regexp_matches(t, '(?i)^(figure|fig|table|tab)[ .:]*[0-9]+') AND n <= 200 THEN 'caption' WHEN regexp_matches(t, '^[-0-9 +*/=(){{}}^_\\<>,.~]+$') OR (n - plain >= 2 AND (n - no_letter) / n < 0.85) THEN 'formula'
WHEN regexp_matches(t, '^([0-9]+([.][0-9]+)*|[A-Z]([.][0-9]+)*|[IVXLC]+[.]?|[0-9]+[.)])[ \t]+') THEN 'heading' WHEN regexp_matches(t, '(?i)^(\[[0-9]+|references?$|bibliography$)') THEN 'citation' ELSE 'body_text' END AS role FROM f)
SELECT role, count(*) AS n FROM r GROUP BY role""")
def q_roles(t, spark):
    b = model.text_blocks(t("documents")).withColumn("r", classify.role(F.col("text"), F.lit(1.0), F.lit(1)))
    return b.groupBy("r.role").agg(F.count("*").alias("n"))


@query("""SELECT page_id, 'section' AS kind, 2::BIGINT AS level, page_id::VARCHAR || '.1' AS number FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'chapter', 1, page_id::VARCHAR FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT page_id, 'section', 2, page_id::VARCHAR FROM pages WHERE page_id % 3 = 2""")
def q_toc(t, spark):
    n = F.col("page_id").cast("string")
    line = F.when(F.col("page_id") % 3 == 0, F.concat(n, F.lit(".1 A heading"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("Chapter "), n, F.lit(": A title"))).otherwise(F.concat(n, F.lit(". A title")))
    return t("pages").select("page_id", classify.toc_entry(line).alias("e")).select("page_id", "e.kind", "e.level", "e.number")


@query(f"""WITH {BLOCKS} SELECT doc_id, string_agg(CASE kind WHEN 'heading' THEN '## ' || text WHEN 'formula' THEN '$$' || text || '$$' WHEN 'caption' THEN '*' || text || '*' ELSE text END, chr(10) || chr(10) ORDER BY block_idx) AS markdown FROM blocks WHERE kind <> 'empty' GROUP BY doc_id""")
def q_export_markdown(t, spark):
    return model.export_markdown(model.text_blocks(t("documents")))


@query(rf"""WITH d AS (SELECT doc_id, text, string_split(text, '.') AS l FROM documents WHERE text <> ''),
p AS (SELECT doc_id, unnest(l) AS part, generate_subscripts(l, 1) AS k, len(l) AS n, l FROM d),
e AS (SELECT doc_id, k, n, part, k < n AND (regexp_matches(l[k + 1], '^\s') OR (k + 1 = n AND l[n] = '')) AS dot, right(array_to_string(l[greatest(1, k - 12):k], '.'), 12) AS tail FROM p),
w AS (SELECT *, CASE WHEN regexp_matches(tail, '\s$') OR tail = '' THEN regexp_extract(tail, '(\S*)\s*$', 1) ELSE regexp_extract(tail, '(\S+)$', 1) END AS word FROM e),
b AS (SELECT doc_id, k, n, part, dot AND NOT (lower(ltrim(word, '([')) IN {words.ABBREVIATIONS} OR regexp_matches(ltrim(word, '(['), '^\p{{L}}$')) AS ends FROM w),
g AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM b),
t AS (SELECT doc_id, s, regexp_replace(string_agg(part || CASE WHEN k < n THEN '.' ELSE '' END, '' ORDER BY k), '^\s+|\s+$', '', 'g') AS sentence FROM g GROUP BY doc_id, s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS seq, sentence FROM t WHERE sentence <> ''""")
def q_sentences(t, spark):
    return t("documents").select("doc_id", F.posexplode(words.sentences("text")).alias("seq", "sentence"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, unnest(l) AS part, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, list_filter(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x) <> '') AS l FROM documents)),
n AS (SELECT doc_id, k, part, length(part) AS n FROM p),
s AS (SELECT doc_id, k, 0::BIGINT AS seq, n FROM n WHERE k = 1 UNION ALL SELECT n.doc_id, n.k, CASE WHEN s.n + n.n + 2 <= 2000 THEN seq ELSE seq + 1 END, CASE WHEN s.n + n.n + 2 <= 2000 THEN s.n + n.n + 2 ELSE n.n END FROM s JOIN n ON n.doc_id = s.doc_id AND n.k = s.k + 1)
SELECT doc_id, seq, string_agg(part, chr(10) || chr(10) ORDER BY k) AS chunk FROM s JOIN p USING (doc_id, k) GROUP BY doc_id, seq""")
def q_chunks(t, spark):
    joined = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return t("documents").select("doc_id", F.posexplode(words.chunks(joined)).alias("seq", "chunk"))


@query("""WITH RECURSIVE w AS (SELECT item_id, unnest(l) AS word, generate_subscripts(l, 1) AS k FROM (SELECT item_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS l FROM benchmark)),
s AS (SELECT item_id, k, 0::BIGINT AS line, word AS text FROM w WHERE k = 1
UNION ALL SELECT w.item_id, w.k, CASE WHEN length(s.text) + 1 + length(word) <= 40 THEN line ELSE line + 1 END, CASE WHEN length(s.text) + 1 + length(word) <= 40 THEN s.text || ' ' || word ELSE word END FROM s JOIN w ON w.item_id = s.item_id AND w.k = s.k + 1)
SELECT item_id, line, arg_max(text, k) AS text FROM s GROUP BY item_id, line""")
def q_wrap(t, spark):
    return t("benchmark").select("item_id", F.posexplode(words.wrap(F.col("text"), 40)).alias("line", "text"))


# ------------------------------------------------------------------ knowledge


@query("""WITH w AS (SELECT source AS session, doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS word FROM documents)
SELECT session, lower(word) AS entity, CASE WHEN regexp_matches(word, '^[A-Z]{2,8}$') THEN 'abbreviation' ELSE 'concept' END AS type, count(*) AS occurrences, min(doc_id) AS first_page FROM w
WHERE regexp_matches(word, '^[A-Z]{2,8}$') OR (regexp_matches(word, '^[A-Z][a-z]{2,}$') AND lower(word) NOT IN ('the', 'this', 'that', 'with', 'from', 'have')) GROUP BY 1, 2, 3""")
def q_entities(t, spark):
    return knowledge.entities(t("documents"))


@query("""WITH w AS (SELECT source AS session, doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS word FROM documents)
SELECT lower(word) AS entity, count(*) AS occurrences, min(doc_id) AS first_page, string_agg(DISTINCT session, ',' ORDER BY session) AS sessions FROM w
WHERE regexp_matches(word, '^[A-Z]{2,8}$') OR (regexp_matches(word, '^[A-Z][a-z]{2,}$') AND lower(word) NOT IN ('the', 'this', 'that', 'with', 'from', 'have')) GROUP BY 1""")
def q_knowledge_merge(t, spark):
    return knowledge.merge_entities(knowledge.entities(t("documents")))


@query("""SELECT source, target, confidence, uses FROM (SELECT event_type AS source, 't' || event_id AS target, value AS confidence, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id DESC) AS r, count(*) OVER (PARTITION BY event_type) AS uses FROM events) WHERE r = 1""")
def q_glossary_merge(t, spark):
    entries = t("events").select(F.col("event_type").alias("source"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("target"), F.col("value").alias("confidence"), F.col("event_id").alias("seq"))
    return knowledge.merge_glossary(entries)


@query(f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text || ' [' || (doc_id % 40) || ']', '{classify.CITATION}')) AS citation FROM documents) SELECT citation, count(*) AS n, count(DISTINCT doc_id) AS docs FROM c GROUP BY citation""")
def q_citations(t, spark):
    cited = t("documents").withColumn("text", F.concat("text", F.lit(" ["), (F.col("doc_id") % 40).cast("string"), F.lit("]")))
    return knowledge.citations(cited, classify.CITATION)


# --------------------------------------------------------------------- graphs


@query("""WITH RECURSIVE r AS (SELECT 3::BIGINT AS id, 0::BIGINT AS depth UNION ALL SELECT p_partkey, depth + 1 FROM r JOIN part ON p_partkey // 2 = r.id AND p_partkey > 1) SELECT id, depth FROM r""")
def q_closure(t, spark):
    return traverse.closure(part_edges(t("part")), spark.createDataFrame([(3,)], "id bigint"))


@query("SELECT p_partkey AS id, floor(log2(p_partkey))::BIGINT AS level FROM part WHERE p_partkey > 0")
def q_levels(t, spark):
    return traverse.levels(t("part").select(F.col("p_partkey").alias("id")).where("id > 0"), part_edges(t("part")))


@query(f"WITH {GEO} SELECT id, 'root' AS place FROM nodes WHERE id NOT IN (SELECT dst FROM edges) UNION ALL SELECT id, 'leaf' FROM nodes WHERE id NOT IN (SELECT src FROM edges)")
def q_roots(t, spark):
    nodes, edges = geo_graph(t)
    return traverse.roots(nodes, edges).withColumn("place", F.lit("root")).unionByName(traverse.leaves(nodes, edges).withColumn("place", F.lit("leaf")))


@query("""WITH e AS (SELECT c_custkey AS a, 10000000 + c_nationkey AS b FROM customer UNION ALL SELECT 20000000 + s_suppkey, 10000000 + s_nationkey FROM supplier), f AS (SELECT b, min(a) AS m FROM e GROUP BY b)
SELECT a AS id, m AS component FROM e JOIN f USING (b) UNION SELECT b, m FROM f""")
def q_components(t, spark):
    a = t("customer").select(F.col("c_custkey").alias("src"), (F.col("c_nationkey") + 10000000).cast("bigint").alias("dst"))
    b = t("supplier").select((F.col("s_suppkey") + 20000000).alias("src"), (F.col("s_nationkey") + 10000000).cast("bigint").alias("dst"))
    return traverse.connected_components(a.unionByName(b))


@query(f"""WITH {GEO} SELECT 'r0' AS id, 0::BIGINT AS depth UNION ALL SELECT dst, 1 FROM edges WHERE src = 'r0' UNION ALL SELECT b.dst, 2 FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src = 'r0'""")
def q_walk(t, spark):
    _, edges = geo_graph(t)
    tree = edges.withColumn("seq", F.substring("dst", 2, 20).cast("bigint"))
    return traverse.walk(tree, spark.createDataFrame([("r0",)], "id string")).select("id", "depth")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def q_ready(t, spark):
    nodes = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2 == 0).alias("dirty"))
    blocks_ = t("orders").where("o_orderkey % 3 = 0").select(F.lit(-2).cast("bigint").alias("src"), F.col("o_orderkey").alias("dst"))
    dirty = spark.createDataFrame([(-2, True)], "id bigint, dirty boolean")
    return traverse.ready(nodes.unionByName(dirty), blocks_).where("id >= 0")


# --------------------------------------------------------------------- events


@query(f"WITH {EVENTS} SELECT event_id, seq FROM ev WHERE seq > CASE WHEN user_id % 2 = 0 THEN 50 ELSE 0 END")
def q_replay_cursor(t, spark):
    cursors = t("events").where("user_id % 2 = 0").select("user_id", F.lit(50).alias("last_seq")).distinct()
    return log.events_since(t("events"), cursors).select("event_id", "seq")


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def q_last_events(t, spark):
    return log.last_events(t("events"), 5).select("event_id")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, event_id)) AS last_value, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS last_purchase, count(*) AS n FROM events GROUP BY user_id""")
def q_latest_state(t, spark):
    return log.latest_state(t("events"))


FSM = [("signup", "view"), ("view", "view"), ("view", "click"), ("click", "purchase"), ("click", "view"), ("purchase", "view")]


@query(f"""WITH s AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, before, event_type FROM s WHERE before IS NOT NULL AND before || '>' || event_type NOT IN ({', '.join(f"'{a}>{b}'" for a, b in FSM)})""")
def q_fsm_violations(t, spark):
    return log.violations(t("events"), FSM).select("event_id", "before", "event_type")


@query("WITH s AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, before, event_type FROM s WHERE before IS NULL OR before <> event_type")
def q_transitions(t, spark):
    return log.transitions(t("events")).select("event_id", "before", "event_type")


@query("""WITH c AS (SELECT o_orderkey AS id, nullif(o_orderkey // 2, 0) AS parent FROM orders WHERE o_orderkey > 0) SELECT a.id, a.parent, (a.id % 100)::BIGINT AS duration, (SELECT count(*) FROM c b WHERE b.parent = a.id) AS children, a.parent IS NULL AS root FROM c a""")
def q_span_tree(t, spark):
    s = t("orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("id"), F.nullif(F.floor(F.col("o_orderkey") / 2), F.lit(0)).alias("parent"), F.lit(0).alias("started"), (F.col("o_orderkey") % 100).alias("ended"))
    return log.span_tree(s)


@query("SELECT c.conv_id, c.turn, k.cached, k.cached IS NOT NULL AS hit FROM conversations c LEFT JOIN (SELECT text, arg_max('v' || conv_id, conv_id * 1000 + turn) AS cached FROM conversations WHERE conv_id % 3 = 0 GROUP BY text) k USING (text)")
def q_cache_lookup(t, spark):
    c = t("conversations")
    held = c.where("conv_id % 3 = 0").select("text", F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("v"), (F.col("conv_id") * 1000 + F.col("turn")).alias("created_at"))
    return model.cache_lookup(c, held, ["text"], "v").select("conv_id", "turn", "cached", "hit")


@query("""WITH m AS (SELECT max(ts) AS newest FROM events) SELECT event_id AS key FROM events, m WHERE ts >= newest - INTERVAL 5 DAYS ORDER BY ts DESC, event_id LIMIT 500""")
def q_ttl_trim(t, spark):
    e = t("events").select(F.col("event_id").alias("key"), F.col("ts").alias("created_at"))
    return model.trim_cache(e.crossJoin(F.broadcast(e.agg(F.max("created_at").alias("newest")))), F.col("newest"), 5, 500).select("key")


# ---------------------------------------------------------------------- plans


@query(f"""WITH {EDITED}, d AS (SELECT CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'updated' END AS change FROM (SELECT doc_id, {HASH} AS h FROM documents) a FULL JOIN (SELECT doc_id, {HASH} AS h FROM edited) b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h)
SELECT stage, count(*) AS n FROM (SELECT unnest(CASE change WHEN 'added' THEN ['parse', 'analyze', 'plan', 'translate', 'review', 'layout', 'render'] WHEN 'updated' THEN ['plan', 'translate', 'review', 'layout', 'render'] ELSE ['layout', 'render'] END) AS stage FROM d) GROUP BY stage""")
def q_incremental_plan(t, spark):
    changes = diff.snapshot_diff(hashed(t("documents")), hashed(edited(t("documents"))), "doc_id", "hash").withColumnRenamed("doc_id", "id")
    return incremental_plan(changes, {"added": "parse", "updated": "plan", "removed": "layout"})


@query(f"""WITH RECURSIVE {BOXES}, r AS (SELECT *, []::BIGINT[] AS path, 0 AS depth FROM boxes
UNION ALL SELECT page, seq, x0, y0, x1, y1, list_append(path, CASE WHEN nx > 0 THEN px ELSE py END::BIGINT), depth + 1 FROM (SELECT *, max(px) OVER (PARTITION BY page, path) AS nx, max(py) OVER (PARTITION BY page, path) AS ny FROM (SELECT *,
  sum(sx) OVER (PARTITION BY page, path ORDER BY x0, x1, seq ROWS UNBOUNDED PRECEDING) AS px, sum(sy) OVER (PARTITION BY page, path ORDER BY y0, y1, seq ROWS UNBOUNDED PRECEDING) AS py FROM (SELECT *,
  CASE WHEN x0 > max(x1) OVER (PARTITION BY page, path ORDER BY x0, x1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS sx, CASE WHEN y0 > max(y1) OVER (PARTITION BY page, path ORDER BY y0, y1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS sy FROM r))) WHERE nx > 0 OR ny > 0),
d AS (SELECT page, seq, y0, x0, arg_max(path, depth) AS path FROM r GROUP BY page, seq, y0, x0)
SELECT page, seq, row_number() OVER (PARTITION BY page ORDER BY path, y0, x0, seq) - 1 AS position FROM d""")
def q_reading_order(t, spark):
    return layout.reading_order(boxes(t))


@query(f"""WITH RECURSIVE {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, seq) AS k FROM boxes),
s AS (SELECT page, seq, k, y0 AS was, {{'y0': y0, 'x0': x0, 'x1': x1, 'y1': y1}} AS box, [{{'y0': y0, 'x0': x0, 'x1': x1, 'y1': y1}}] AS done FROM o WHERE k = 1
UNION ALL SELECT page, seq, k, was, box, list_append(done, box) FROM (SELECT o.page, o.seq, o.k, o.y0 AS was, done, list_reduce(list_sort(done), lambda a, d: CASE WHEN d.x0 < a.x1 AND a.x0 < d.x1 AND a.y0 < d.y1 + 2 AND d.y0 < a.y1 + 2 THEN {{'y0': d.y1 + 2, 'x0': a.x0, 'x1': a.x1, 'y1': d.y1 + 2 + a.y1 - a.y0}} ELSE a END,
  {{'y0': o.y0, 'x0': o.x0, 'x1': o.x1, 'y1': o.y1}}) AS box FROM s JOIN o ON o.page = s.page AND o.k = s.k + 1))
SELECT page, seq, box.y0 AS y0, box.y1 AS y1, box.y0 - was AS moved FROM s""")
def q_resolve_collisions(t, spark):
    return layout.resolve_collisions(boxes(t))


# ---------------------------------------------------------------- annotations


@query(f"""WITH {GEO}, o AS (SELECT src AS id, string_agg(relation || ':' || dst, ',' ORDER BY relation || ':' || dst) AS relations, count(*) AS n FROM edges GROUP BY src)
SELECT id, node_type, relations, coalesce(n, 0) AS n_relations FROM nodes LEFT JOIN o USING (id) WHERE node_type <> 'customer'""")
def q_inspect(t, spark):
    nodes, edges = geo_graph(t)
    return annotate.inspect(nodes.where("node_type <> 'customer'"), edges).select("id", "node_type", "relations", "n_relations")


@query(f"""WITH {BLOCKS} SELECT count(*) FILTER (WHERE trim(text) = '') AS skipped, count(*) FILTER (WHERE trim(text) <> '' AND kind IN ('formula', 'table')) AS preserved,
count(*) FILTER (WHERE trim(text) <> '' AND kind NOT IN ('formula', 'table', 'toc')) AS translated, count(*) FILTER (WHERE trim(text) <> '' AND kind = 'toc') AS toc_translated FROM blocks""")
def q_translation_counts(t, spark):
    return annotate.translation_counts(model.text_blocks(t("documents")))


@query(f"""WITH {BLOCKS} SELECT kind, CASE kind WHEN 'heading' THEN 'heading' WHEN 'paragraph' THEN 'body_text' WHEN 'caption' THEN 'caption' WHEN 'formula' THEN 'formula' WHEN 'table' THEN 'table' ELSE 'unknown' END AS semantic,
CASE WHEN kind IN ('formula', 'table') THEN 'preserve_float' ELSE 'translate_refit' END AS render, count(*) AS n FROM blocks GROUP BY 1, 2, 3""")
def q_ir_roles(t, spark):
    b = annotate.ir_roles(model.text_blocks(t("documents"))).withColumn("render", annotate.render_mode(F.col("kind")))
    return b.groupBy("kind", "semantic", "render").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES} SELECT 'must_below' AS "constraint", 'soft' AS priority, count(*) AS n FROM lines WHERE block_idx > 0 UNION ALL SELECT 'keep_together', 'hard', count(*) FROM lines""")
def q_constraints(t, spark):
    _, edges = model.document_graph(model.text_blocks(t("documents")))
    return annotate.constraints(edges).groupBy("constraint", "priority").agg(F.count("*").alias("n"))


@query(f"""WITH {BOXES}, m AS (SELECT page, CASE WHEN max(x1) OVER w IS NULL OR x0 - max(x1) OVER w > 20 THEN 1 ELSE 0 END AS s FROM boxes WINDOW w AS (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT page, sum(s)::BIGINT AS columns FROM m GROUP BY page""")
def q_column_count(t, spark):
    return annotate.column_count(boxes(t))


@query("""SELECT event_type AS entity, arg_max('d' || event_id, (value, event_id)) AS definition, max(value) AS confidence, string_agg(DISTINCT 'u' || (user_id % 4), ',' ORDER BY 'u' || (user_id % 4)) AS aliases FROM events GROUP BY event_type""")
def q_learn(t, spark):
    facts = t("events").select(F.col("event_type").alias("entity"), F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("definition"), F.col("value").alias("confidence"), F.col("event_id").alias("seq"), F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("alias"))
    return annotate.learn(facts)


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN p_brand WHEN p_partkey % 3 = 0 THEN p_type END AS value, CASE WHEN p_partkey % 2 = 0 THEN 'memory' WHEN p_partkey % 3 = 0 THEN 'disk' END AS tier FROM part""")
def q_tiered_lookup(t, spark):
    p = t("part").withColumnRenamed("p_partkey", "key")
    tiers = [("memory", p.where("key % 2 = 0").select("key", F.col("p_brand").alias("value"))), ("disk", p.where("key % 3 = 0").select("key", F.col("p_type").alias("value")))]
    return annotate.tiered_lookup(p, tiers)


@query("""SELECT doc_id AS id, m.module AS module, CASE WHEN m.score < m.lim * 0.5 THEN 'critical' ELSE 'major' END AS severity, m.score AS score FROM (SELECT doc_id, unnest([{'module': 'quality', 'score': quality::DOUBLE, 'lim': 0.9}, {'module': 'safety', 'score': 1.0 - 0.6 * toxic, 'lim': 0.7}]) AS m FROM labels) WHERE m.score < m.lim""")
def q_score_issues(t, spark):
    scores = t("labels").select(F.col("doc_id").alias("id"), "quality", (F.lit(1.0) - F.lit(0.6) * F.col("toxic")).alias("safety"))
    return annotate.score_issues(scores, {"quality": 0.9, "safety": 0.7})


@query(f"""WITH {BLOCKS} SELECT 'drop' AS action, 4::BIGINT AS rank, count(*) AS n FROM blocks WHERE trim(text) = '' HAVING count(*) > 0 UNION ALL SELECT 'shrink', 2, count(*) FROM blocks WHERE n_chars > 2000 HAVING count(*) > 0
UNION ALL SELECT 'split_lines', 1, count(*) FROM blocks WHERE (len(regexp_extract_all(text, '[0-9]+[.][0-9]+')) >= 2 AND regexp_matches(text, '[.]{{3,}}')) OR len(regexp_extract_all(text, '[0-9]+[.][0-9]+')) >= 3 HAVING count(*) > 0
UNION ALL SELECT 'recover_math', 3, count(*) FROM blocks WHERE kind = 'formula' AND length(regexp_replace(text, '[-+*/=^_{{}}<>()~]', '', 'g')) > 0.5 * length(text) HAVING count(*) > 0""")
def q_repair_plan(t, spark):
    return annotate.repair_plan(classify.issues(model.text_blocks(t("documents")))).groupBy("action", "rank").agg(F.count("*").alias("n"))


@query("""SELECT p_brand AS stem, 'small' AS kind, 30::BIGINT AS expected, count(*) FILTER (WHERE p_size < 10) AS actual, count(*) FILTER (WHERE p_size < 10) = 30 AS ok FROM part GROUP BY p_brand""")
def q_compare_expected(t, spark):
    p = t("part").withColumnRenamed("p_brand", "stem")
    expected = p.select("stem", F.lit("small").alias("kind"), F.lit(30).alias("expected")).distinct()
    return annotate.compare_expected(expected, p.where("p_size < 10").groupBy("stem").agg(F.count("*").alias("actual")).withColumn("kind", F.lit("small")))


@query(f"""WITH {PAIRS}, r AS (SELECT text = other AS same, trim(other) = '' AS blank, len(list_filter(list_distinct(regexp_extract_all(text, '[0-9]+')), lambda x: NOT list_contains(list_distinct(regexp_extract_all(other, '[0-9]+')), x))) > 0 AS lost FROM pairs)
SELECT count(*) AS checked, count(*) FILTER (WHERE same) AS unchanged, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE lost) AS numbers_lost, round(1 - count(*) FILTER (WHERE same OR blank OR lost) / greatest(count(*), 1), 3) AS score FROM r""")
def q_review_totals(t, spark):
    return annotate.review_totals(pairs(t).select(F.col("text").alias("source"), F.col("other").alias("target")))


@query("SELECT o_orderkey AS id, o_orderpriority AS queue, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O'")
def q_queue_positions(t, spark):
    tasks = t("orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "waiting").otherwise("done").alias("state"), F.col("o_orderdate").alias("created"), F.col("o_orderpriority").alias("queue"))
    return annotate.queue_positions(tasks)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 12 ELSE o_totalprice END AS y FROM orders WHERE o_orderstatus <> 'F'")
def q_writeback(t, spark):
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("y"), F.lit(12.0).alias("height"), "o_orderstatus")
    plan = o.where("o_orderstatus in ('F', 'P')").select("id", F.when(F.col("o_orderstatus") == "F", "block").otherwise("shift_down").alias("action"))
    return annotate.writeback(plan, o.select("id", "y", "height"))


@query(f"""WITH {LINES}, s AS (SELECT doc_id, block_idx, text, CASE WHEN length(text) = 0 THEN 0 ELSE (length(text) - length(regexp_replace(text, '[-=<>+*/^_{{}}]', '', 'g'))) / length(text) END AS share FROM lines),
c AS (SELECT doc_id, block_idx, CASE WHEN length(text) = 0 THEN 0.0 ELSE 0.9 * CASE WHEN length(text) < 4 THEN 0.9 ELSE 1.0 END * CASE WHEN share > 0.3 THEN 0.85 ELSE 1.0 END * greatest(0.3, (doc_id % 10) / 10.0) END AS v FROM s)
SELECT doc_id, block_idx, round(v, 6)::DOUBLE AS confidence, CASE WHEN v < 0.5 THEN 'strong' ELSE 'fast' END AS model FROM c""")
def q_estimate(t, spark):
    v = annotate.estimate(F.col("text"), F.lit(0.9), (F.col("doc_id") % 10) / 10.0)
    b = model.text_blocks(t("documents")).withColumn("v", v)
    return b.select("doc_id", "block_idx", F.round("v", 6).alias("confidence"), annotate.model_for(F.lit(False), F.lit("generic"), F.col("v")).alias("model"))


@query(rf"""WITH {BLOCKS}, p AS (SELECT doc_id, block_idx, unnest(l) AS text, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, block_idx, string_split(regexp_replace('1.1 A .... 3 1.2 B .... 4 ' || text, '([.]{{2,}} *[0-9]{{1,4}}) +', '\1' || chr(10), 'g'), chr(10)) AS l FROM blocks WHERE kind = 'heading'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx, k) - 1 AS block_idx, text, CASE WHEN regexp_matches(text, '[.]{{2,}} *[0-9]{{1,4}}$') THEN 'toc' ELSE 'paragraph' END AS kind FROM p""")
def q_split_contents(t, spark):
    made = model.text_blocks(t("documents")).where("kind = 'heading'").withColumn("text", F.concat(F.lit("1.1 A .... 3 1.2 B .... 4 "), "text"))
    return annotate.split_contents(made)


from . import queries_evaluate, queries_records, queries_refine, queries_views  # noqa: E402,F401  register their queries here
