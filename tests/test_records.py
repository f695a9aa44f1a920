"""Records, rendering and snapshots on small tables whose results are known."""

import duckdb
import pytest
from pyspark.sql import functions as F

from docflow import queries
from docflow.operators import graph_query, records, render
from docflow.plans.snapshots import CostRegistry, SnapshotStore, Transaction, files


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def test_lifecycle_ignores_what_follows_the_end(spark):
    u = spark.createDataFrame([("a", 1, "queued"), ("a", 2, "finished"), ("a", 3, "running"), ("a", 4, "failed"), ("b", 1, "running"), ("c", 2, "failed")], "task string, at int, state string")
    assert {r.task: (r.state, r.n_ignored) for r in records.lifecycle(u, "task", ["at"]).collect()} == {"a": ("finished", 2), "b": ("running", 0), "c": ("failed", 0)}
    assert records.until_terminal(u, "task", ["at"]).count() == 4
    assert records.lifecycle(u.limit(0), "task", ["at"]).count() == 0


def test_statistics_of_nothing_translated(spark):
    r = spark.createDataFrame([("failed", 5.0), ("cached", None)], "status string, latency_ms double")
    one = records.translation_stats(r).first()
    assert (one.total, one.translated, one.cached, one.failed, one.avg_latency) == (2, 0, 1, 1, 5.0)
    assert records.diagnostic_report(spark.createDataFrame([], "passed boolean")).first().pass_rate == 0.0


def test_node_paths_and_children(spark):
    assert value(spark, records.node_path(F.lit("D::P1::B12"))).asDict() == {"doc_id": "D", "parent": "D::P1", "kind": "B", "seq": "12", "depth": 2}
    assert value(spark, records.node_path(F.lit("D"))).asDict() == {"doc_id": "D", "parent": None, "kind": "document", "seq": None, "depth": 0}
    rows = spark.createDataFrame([("D", "B", 1), ("D", "B", 2), ("D", "H", 3)], "parent string, k string, at int")
    assert [r.id for r in records.child_ids(rows, "parent", F.col("k"), ["at"]).orderBy("at").collect()] == ["D::B0", "D::B1", "D::H0"]


def test_replay_runs_only_what_the_memo_lacks(spark):
    inputs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, text string")
    memo = inputs.where("id = 1").select(F.sha2("text", 256).alias("hash"), F.lit("known").alias("output"))
    got = {r.id: (r.output, r.source) for r in records.replay(inputs, memo.union(memo), F.upper).collect()}
    assert got == {1: ("known", "memo"), 2: ("B", "run"), 3: (None, "run")}


def test_replay_query_equals_its_sql_on_any_letter(spark, tmp_path):
    """Letters whose capital is two letters, as in the German items of sf0.1, and every other code point, also in runs."""
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["Straße\nẞß ﬁnd ŉ", "ᾳß", "", None, "memo", *("".join(every[k : k + 4096]) for k in range(0, len(every), 4096))]
    path = str(tmp_path / "benchmark.parquet")
    spark.createDataFrame([(2 * k + 1, t) for k, t in enumerate(texts)] + [(8, "memo"), (10, "memo")], "item_id bigint, text string").coalesce(1).write.parquet(path)
    got = {tuple(r) for r in queries.QUERIES["q_replay"](spark, str(tmp_path)).select("item_id", "hash", "output", "source").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{path}/*.parquet'")
    assert got == set(con.execute(f"SELECT item_id, hash, output, source FROM ({queries.ORACLE['q_replay']})").fetchall())


def test_regression_needs_every_stage(spark):
    base = spark.createDataFrame([("a", "s1", "x"), ("a", "s2", "y"), ("b", "s1", "x")], "stem string, stage string, hash string")
    now = spark.createDataFrame([("a", "s1", "x"), ("b", "s1", "x"), ("c", "s1", "z")], base.schema)
    got = {r.stem: (r.passed, r.n_changed, r.missing) for r in records.regression(now, base).collect()}
    assert got == {"a": (False, 1, False), "b": (True, 0, False), "c": (False, 1, True)}


def test_fused_roles_keep_special_types(spark):
    nodes = spark.createDataFrame([(1, "paragraph"), (2, "table"), (3, "unknown"), (4, "heading")], "id int, node_type string")
    roles = spark.createDataFrame([(1, "heading", 0.9), (1, "caption", 0.6), (2, "heading", 0.9), (3, "list", 0.5), (4, "heading", 0.7)], "id int, role string, confidence double")
    got = {r.id: (r.node_type, r.fused) for r in records.fuse_roles(nodes, roles).collect()}
    assert got == {1: ("heading", "adopted"), 2: ("table", "kept"), 3: ("unknown", "none"), 4: ("heading", "adopted")}


def test_graph_edits(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "id string, node_type string")
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("a", "c", "s"), ("a", "a", "s")], "src string, dst string, relation string")
    left, kept = records.drop_nodes(nodes, edges, nodes.where("id = 'b'"))
    assert left.count() == 2 and {(r.src, r.dst) for r in kept.collect()} == {("a", "c"), ("a", "a")}
    assert records.touching(edges, nodes.where("id = 'a'")).count() == 3
    assert records.drop_edges(edges, edges.where("relation = 's'")).count() == 2
    assert records.drop_edges(edges, edges.where("src = 'a' and dst = 'c'").select("src", "dst")).count() == 3
    assert {r.id: r.node_type for r in records.put_nodes(nodes, nodes.where("id = 'a'").withColumn("node_type", F.lit("y"))).collect()} == {"a": "y", "b": "x", "c": "x"}
    assert graph_query.having(nodes, id="a", node_type="x").count() == 1
    assert records.adapted(spark.createDataFrame([("p", "q")], "source_id string, target_id string"), records.EDGE_FIELDS).first().asDict() == {"src": "p", "dst": "q", "relation": None}


def test_templates_do_not_fill_values(spark):
    assert value(spark, render.filled("{a}-{b}-{c}", a=F.lit("{b}"), b=F.lit(None))) == "{b}--{c}"
    assert value(spark, render.filled("plain", a=F.lit("x"))) == "plain"
    assert value(spark, render.shown_text(F.lit(""), F.lit("t"))) == "t"


def test_contents_lines(spark):
    prefix = render.contents_prefix(F.lit("section"), F.lit("3.2"), "zh-TW")
    assert value(spark, render.contents_line(prefix, F.lit(" 实验设置 "), F.lit("..."), F.lit("42"))) == "第3.2节 实验设置 ...42"
    assert value(spark, render.contents_prefix(F.lit("plain"), F.lit("1"), "en")) == ""


def test_html_escapes_and_orders(spark):
    b = spark.createDataFrame([(1, 2, "b2", "table", "x\t<y>", None), (1, 1, "b1", "heading", "A & 'B'", None), (1, 3, "b3", "figure", None, "p.png")], "d int, at int, id string, kind string, text string, image string")
    body = render.render(b, "d", ["at"]).first().body
    inner = "<div class='heading block' id='b1'>A &amp; &#x27;B&#x27;</div><div class='table block' id='b2'><tr><td>x</td></tr><tr><td>&lt;y&gt;</td></tr></div><div class='figure block' id='b3'><img src='p.png' alt='figure'></div>"
    assert inner in body
    assert render.render(b, "d", ["at"], "text").first().body == "\n== A & 'B' ==\nx\t<y>\n\n"
    with pytest.raises(ValueError):
        render.render(b, "d", ["at"], "pdf")


def test_justified_lines(spark):
    assert value(spark, render.justified(F.lit("ab cd"), F.lit(35.0))) == [5.0, 5.0, 15.0, 5.0, 5.0]
    assert value(spark, render.justified(F.lit("漢字"), F.lit(20.0))) == [15.0, 5.0]
    assert value(spark, render.justified(F.lit("abc"), F.lit(10.0))) == [5.0, 5.0, 5.0]
    assert value(spark, render.justified(F.lit(""), F.lit(10.0))) == []
    assert value(spark, render.measured(F.lit("ab"), {"a": 7.0})) == 12.0


def test_flow_starts_pages_anew(spark):
    b = spark.createDataFrame([(1, k, "x" * 73 * 30) for k in range(3)] + [(1, 9, " ")], "doc int, at int, text string")
    assert [(r.lines, r.y) for r in render.flow(b, "doc", "at").orderBy("at").collect()] == [(30, 50.0), (30, 50.0), (30, 50.0)]


def test_snapshots_and_transactions(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.labels("s") == []
    with pytest.raises(KeyError):
        store.load("s")
    told = []
    t = Transaction(store, "s", {"nodes": spark.createDataFrame([(1, "a"), (2, "b")], "id int, hash string")}, [lambda *e: told.append(e), lambda *e: 1 / 0])
    assert t.commit() == "r1"
    t.edit("nodes", lambda d: d.where("id = 1").withColumn("hash", F.lit("z")))
    assert t.tables["nodes"].count() == 1 and t.rollback().tables["nodes"].count() == 2
    t.edit("nodes", lambda d: d.where("id = 1").withColumn("hash", F.lit("z")))
    assert t.commit() == "r2" and store.labels("s") == ["r1", "r2"]
    assert {r.id: r.change for r in store.diff("s", "r1", "r2", "nodes", "id", "hash").collect()} == {1: "updated", 2: "removed"}
    assert t.rollback("r1").tables["nodes"].count() == 2 and store.load("s")["nodes"].count() == 1
    assert told[0] == ("commit", "r1")
    with pytest.raises(ValueError):
        store.save("s", "r1", {})
    with pytest.raises(ValueError):
        store.save("s", "../x", {})
    assert store.delete("s", "r2") and store.labels("s") == ["r1"]


def test_files_at_any_depth(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("x.pdf", "a/y.pdf", "a/b/z.pdf", "a/no.txt"):
        (tmp_path / name).write_bytes(b"123")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files(spark, str(tmp_path)).collect()) == ["x.pdf", "y.pdf", "z.pdf"]


def test_registered_costs(spark):
    work = spark.createDataFrame([("parse", 3), ("render", 4), ("other", 5)], "pass string, pages int")
    costs = CostRegistry().register("parse", lambda: F.col("pages") * 2).register("render", lambda: -F.col("pages"))
    assert {r["pass"]: r.weight for r in costs.weighed(work).collect()} == {"parse": 6.0, "render": 0.0, "other": 1.0}
