"""Documents and pages as rows of blocks, and blocks as graphs of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ASCII patterns that Java and RE2 read alike.
CAPTION = r"^[ ]*(Figure|Fig|Table|Tab)[. ]*[0-9]+"
LEADER = r"[.]{2,}[ ]*[0-9]{1,4}$"
SYMBOLS = r"^[-0-9 +*/=(){}^_<>,.~|$%#&!]+$"


def block_kind(text: Column) -> Column:
    """Kind of a line: empty, caption, toc, table, formula, heading or paragraph, first rule that holds."""
    words = n_words(text)
    return (
        F.when(F.trim(text) == "", "empty")
        .when(text.rlike(CAPTION), "caption")
        .when(text.rlike(LEADER), "toc")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(text.rlike(SYMBOLS), "formula")
        .when((words <= 6) & ~F.endswith(text, F.lit(",")), "heading")
        .otherwise("paragraph")
    )


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, " "), lambda w: w != ""))


def text_blocks(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, block_idx, text, kind, n_chars, n_words): a block per line. A null text has none."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_idx", "text"))
    return lines.select("doc_id", "block_idx", "text", block_kind(F.col("text")).alias("kind"), F.length("text").alias("n_chars"), n_words(F.col("text")).alias("n_words"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """Rows (page_id, block_idx, tag, text) of the h1, p and li elements in page order, inner tags dropped."""
    found = F.regexp_extract_all("html", F.lit(r"<(h1|p|li)>([^\n]*?)</(h1|p|li)>"), F.lit(0))
    each = pages.select("page_id", F.posexplode(found).alias("block_idx", "raw"))
    return each.select("page_id", "block_idx", F.regexp_extract("raw", "^<(h1|p|li)>", 1).alias("tag"), F.regexp_replace("raw", "<[^>]*>", "").alias("text"))


def records_from_texts(texts: DataFrame, left: float = 72.0, top: float = 100.0, step: float = 20.0) -> DataFrame:
    """Plain strings (doc_id, seq, text) with the synthetic geometry of a single column."""
    return texts.select(
        F.col("doc_id"),
        F.concat(F.lit("node_"), F.col("seq").cast("string")).alias("id"),
        "text",
        F.lit("paragraph").alias("type"),
        F.lit(left).alias("x"),
        (F.lit(top) + F.col("seq") * F.lit(step)).alias("y"),
        F.lit(100.0).alias("w"),
        F.lit(14.0).alias("h"),
        F.lit(0).alias("page"),
        F.lit(12.0).alias("font_size"),
    )


def normalize_records(rows: DataFrame) -> DataFrame:
    """Block records of any subset of the fields -> (id, text, page, x0, y0, x1, y1); inverted boxes are turned."""
    have = set(rows.columns)
    field = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    x0, y0 = field("x", 0.0), field("y", 0.0)
    x1, y1 = x0 + field("w", 100.0), y0 + field("h", 14.0)
    ids = F.col("id") if "id" in have else F.concat(F.lit("node_"), F.monotonically_increasing_id().cast("string"))
    return rows.select(ids.alias("id"), field("text", "").alias("text"), field("page", 0).alias("page"), F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def document_graph(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a node per block and document, CONTAINS to each block, FOLLOWS to the next."""
    block_id = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_"), F.col("block_idx").cast("string"))
    page_id = F.concat(F.lit("page_"), F.col("doc_id").cast("string"))
    own = blocks.select(block_id.alias("id"), F.col("kind").alias("node_type"), F.col("doc_id").alias("page"), "text")
    tops = blocks.select(page_id.alias("id"), F.lit("page").alias("node_type"), F.col("doc_id").alias("page"), F.lit("").alias("text")).distinct()
    follows = blocks.select(block_id.alias("src"), F.lead(block_id).over(Window.partitionBy("doc_id").orderBy("block_idx")).alias("dst"), F.lit("FOLLOWS").alias("edge_type")).where("dst is not null")
    contains = blocks.select(page_id.alias("src"), block_id.alias("dst"), F.lit("CONTAINS").alias("edge_type"))
    return own.unionByName(tops), contains.unionByName(follows)


def without_dangling(edges: DataFrame, nodes: DataFrame, id: str = "id") -> DataFrame:
    """Edges whose both ends are nodes."""
    ids = nodes.select(F.col(id).alias("_id")).distinct()
    return edges.join(ids, edges.src == ids._id, "left_semi").join(ids, edges.dst == ids._id, "left_semi")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Graph JSON lines with ``nodes`` and ``edges`` arrays; dangling edges are dropped."""
    raw = spark.read.schema("nodes array<struct<id:string,kind:string,label:string>>, edges array<struct<src:string,dst:string,relation:string>>").json(path)
    nodes = raw.select(F.explode("nodes").alias("n")).select("n.*")
    return nodes, without_dangling(raw.select(F.explode("edges").alias("e")).select("e.*"), nodes)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines below ``path``."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def to_dot(edges: DataFrame) -> DataFrame:
    """One Graphviz line per edge, in the order of their ends."""
    return edges.select(F.concat(F.lit('"'), "src", F.lit('" -> "'), "dst", F.lit('" [label="'), "edge_type", F.lit('"];')).alias("line"))


# The three templates of the synthetic corpus, (text, type, x, y).
TEMPLATES = (
    (
        ("A Two-Column Study", "heading", 72, 60),
        ("We study a new method.", "paragraph", 72, 90),
        ("Left column paragraph one.", "paragraph", 72, 130),
        ("Right column paragraph one.", "paragraph", 340, 130),
        ("Figure 1: Overview.", "caption", 72, 300),
        ("References go here.", "reference", 72, 500),
    ),
    (
        ("Chapter 1", "heading", 72, 60),
        ("Definition and theorem.", "paragraph", 72, 100),
        ("E = mc^2", "formula", 72, 170),
        ("Caption of the example.", "caption", 72, 220),
        ("Proof sketch.", "paragraph", 72, 260),
        ("List item A, list item B.", "list", 72, 320),
    ),
    (
        ("Figure Heavy Document", "heading", 72, 60),
        ("Figure 1", "figure", 72, 100),
        ("Fig 1 caption.", "caption", 72, 260),
        ("Table 1", "table", 72, 320),
        ("Tab 1 caption.", "caption", 72, 420),
        ("Body text after the figure.", "paragraph", 72, 470),
    ),
)


def synthetic_corpus(spark: SparkSession, n: int) -> DataFrame:
    """``n`` small documents, a template each, in turn."""
    rows = [(t, k, *r) for t, template in enumerate(TEMPLATES) for k, r in enumerate(template)]
    shapes = spark.createDataFrame(rows, "template int, seq int, text string, type string, x int, y int")
    docs = spark.range(n).withColumn("template", (F.col("id") % len(TEMPLATES)).cast("int"))
    return docs.join(F.broadcast(shapes), "template").select(F.col("id").alias("doc_id"), "seq", "text", "type", "x", "y")


def export_markdown(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, markdown): headings marked, tables and formulas fenced, blank blocks dropped."""
    line = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), "text")).when(F.col("kind") == "formula", F.concat(F.lit("$$"), "text", F.lit("$$"))).when(F.col("kind") == "caption", F.concat(F.lit("*"), "text", F.lit("*"))).otherwise(F.col("text"))
    kept = blocks.where("kind <> 'empty'").select("doc_id", "block_idx", line.alias("line"))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "line"))), lambda x: x.line), "\n\n").alias("markdown"))


def cache_lookup(wanted: DataFrame, cache: DataFrame, key: list[str], value: str) -> DataFrame:
    """``wanted`` with the newest cached ``value`` of its key and whether there is one."""
    newest = cache.groupBy(*key).agg(F.max_by(value, "created_at").alias("cached"))
    return wanted.join(newest, key, "left").withColumn("hit", F.col("cached").isNotNull())


def trim_cache(cache: DataFrame, newest: Column, days: int, rows: int) -> DataFrame:
    """Entries not older than ``days`` before ``newest``, of those the ``rows`` newest (a bounded top-k)."""
    return cache.where(F.col("created_at") >= newest - F.make_dt_interval(F.lit(days))).orderBy(F.col("created_at").desc(), F.col("key")).limit(rows)
