"""Operators on small tables whose results are known."""

import pytest
from pyspark.sql import functions as F

from docflow.functions import classify, geometry, text
from docflow.operators import aggregates, components, diff, graph_query, joins, layout, overlap, traverse, windows
from docflow.operators.doc_query import DocumentQuery
from docflow.plans.dag import OperatorGraph, ResultCache, repair_loop
from docflow.plans.registry import PassManager, Registry
from docflow.sources import blocks
from docflow.streaming import events as log


def one(df):
    return df.collect()[0]


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def test_levels_and_cycles(spark):
    chain = edges(spark, ("a", "b"), ("b", "c"))
    assert {r.id: r.level for r in traverse.levels(nodes(spark, "abc"), chain).collect()} == {"a": 0, "b": 1, "c": 2}
    assert traverse.cyclic_nodes(nodes(spark, "abc"), chain).count() == 0
    ring = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"))
    assert traverse.cyclic_nodes(nodes(spark, "abc"), ring).count() == 3
    assert traverse.levels(nodes(spark, "abc"), ring).count() == 0


def test_closure_ends_on_cycles(spark):
    ring = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"))
    assert {r.id: r.depth for r in traverse.closure(ring, nodes(spark, "a")).collect()} == {"a": 0, "b": 1, "c": 2}


def test_components(spark):
    e = spark.createDataFrame([(5, 9), (9, 7), (1, 2), (3, 3), (None, 4)] + [(100 + k, 101 + k) for k in range(40)], "src bigint, dst bigint")
    got = {r.id: r.component for r in components.connected_components(e).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {5: 5, 9: 5, 7: 5, 1: 1, 2: 1}
    assert {v for k, v in got.items() if k >= 100} == {100}
    assert components.connected_components(e.limit(0)).count() == 0


def test_walk_is_preorder(spark):
    tree = spark.createDataFrame([("r", "b", 2), ("r", "a", 1), ("a", "c", 1)], "src string, dst string, seq int")
    assert [r.id for r in traverse.walk(tree, nodes(spark, "r")).orderBy("path").collect()] == ["r", "a", "c", "b"]


def test_graph_diff_and_merge(spark):
    g = lambda n, e: (spark.createDataFrame(n, "id string, hash string"), spark.createDataFrame(e, "src string, dst string, relation string"))
    before, after = g([("a", ""), ("b", "")], [("a", "b", "r")]), g([("a", "k"), ("c", "")], [("a", "c", "r")])
    assert {(r.what, r.change): r.n for r in diff.graph_diff(before, after).collect()} == {("node", "added"): 1, ("node", "removed"): 1, ("node", "updated"): 1, ("edge", "added"): 1, ("edge", "removed"): 1}
    merged, links = diff.merge_graphs(before, after)
    assert {r.id: r.hash for r in merged.collect()} == {"a": "", "b": "", "c": ""}
    assert links.count() == 2
    kept, inner = diff.subgraph(*before, nodes(spark, "a"))
    assert (kept.count(), inner.count()) == (1, 0)


def test_dice(spark):
    d = lambda a, b: value(spark, diff.dice(F.lit(a), F.lit(b)))
    assert d("a b c", "a b d") == pytest.approx(2 / 3)
    assert d("", "") == 1 and d("a b", "") == 0


def test_overlap_rate(spark):
    b = spark.createDataFrame([(0, 1, 0.0, 0.0, 100.0, 20.0), (0, 2, 50.0, 10.0, 150.0, 30.0), (1, 3, 0.0, 0.0, 100.0, 20.0)], "page int, seq int, x0 double, y0 double, x1 double, y1 double")
    assert one(overlap.overlap_rate(b, ["page"], 30.0)).rate == pytest.approx(1 / 3, abs=1e-6)


def test_words(spark):
    def chars(s, x, y):
        return [(1, c, x + k * 7.0, y, x + k * 7.0 + 6, 12.0) for k, c in enumerate(s)]

    df = spark.createDataFrame(chars("Hello world", 100.0, 700.0) + chars("AB", 100.0, 640.0) + chars("C", 180.0, 640.0), "page bigint, text string, x0 double, y0 double, x1 double, size double")
    assert sorted(r.text for r in layout.words_from_chars(df).collect()) == ["AB", "C", "Hello", "world"]


def test_layout_folds(spark):
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 40.0, 50.0), (1, 2, 60.0, 0.0, 90.0, 20.0), (1, 3, 60.0, 30.0, 90.0, 50.0), (1, 4, 0.0, 10.0, 40.0, 60.0)], "page bigint, seq bigint, x0 double, y0 double, x1 double, y1 double")
    order = {r.seq: r.position for r in layout.reading_order(b).collect()}
    assert order[1] < order[4] < order[2] < order[3]
    moved = {r.seq: r.y0 for r in layout.resolve_collisions(b).collect()}
    assert moved[4] == 52.0 and moved[2] == 0.0
    n = spark.createDataFrame([(1, 1, 0.0, 10.0, 2.0), (1, 2, 5.0, 10.0, 2.0), (1, 3, 50.0, 10.0, 2.0)], "page bigint, seq bigint, y double, height double, gap double")
    assert [r.y for r in layout.solve_below(n).orderBy("seq").collect()] == [0.0, 12.0, 50.0]
    f = spark.createDataFrame([(1, 1, "a", 0.0, 10.0), (1, 2, "b", 20.0, 30.0), (1, 3, "c", 90.0, 99.0)], "page bigint, seq bigint, text string, y0 double, y1 double")
    assert [r.text for r in layout.merge_fragments(f).orderBy("seq").collect()] == ["a b", "c"]
    assert layout.reading_order(b.limit(0)).count() == 0


def test_query_language(spark):
    n = spark.createDataFrame([("a", "x", 1, None), ("b", "x", 2, "q"), ("c", "y", 3, "r")], "id string, node_type string, size int, name string")
    run = lambda q: [r.id for r in graph_query.parse_query(q, n).run().collect()]
    assert run("MATCH x WHERE size >= 1 ORDER BY size DESC") == ["b", "a"]
    assert run("MATCH * WHERE name != 'q' ORDER BY id") == ["a", "c"]
    assert run("MATCH * ORDER BY name LIMIT 2") == ["b", "c"] and run("MATCH * ORDER BY name DESC LIMIT 1") == ["a"]
    got = graph_query.parse_query("MATCH y RETURN id, nothing", n).run().collect()
    assert [tuple(r) for r in got] == [("c", None)]
    for bad in ("WHERE a = 1", "MATCH x WHERE size > 1 OR size < 3", "MATCH x LIMIT -1", "MATCH x RETURN", "MATCH x extra", "MATCH x WHERE size ~ 3"):
        with pytest.raises(ValueError):
            graph_query.parse_query(bad, n)


def test_fluent_query(spark):
    b = spark.createDataFrame([(1, 0, "Head", "heading", 0.0), (1, 1, "bad �", "paragraph", 0.2), (2, 0, "x" * 200, "paragraph", 0.9)], "doc_id int, block_idx int, text string, kind string, confidence double")
    assert DocumentQuery(b).kind("heading").kind("paragraph").count() == 2
    assert [r.id for r in DocumentQuery(b).page(1).confidence_below(0.5).ids().collect()] == ["p1_1"]
    assert DocumentQuery(b).has_replacement().count() == 1
    assert len(DocumentQuery(b).page(2).execute().collect()[0].text) == 120


def test_as_of_and_nearest(spark):
    left = spark.createDataFrame([("g", 5, 1), ("g", 1, 2), ("h", 3, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("g", 2, 10), ("g", 5, 11), ("g", 9, 12)], "k string, t int, v int")
    got = {r.id: r.host_v for r in joins.as_of(left, right, ["k"], ["t"], ["v"]).collect()}
    assert got == {1: 11, 2: None, 3: None}
    near = {r.id: r.host_id for r in joins.nearest_host(left, right.withColumnRenamed("v", "id"), ["k"], "t", "id").collect()}
    assert near == {1: 11, 2: 10, 3: None}


def test_link_target(spark):
    links = spark.createDataFrame([(1, "p", 10.0, 10.0, 12.0, 12.0), (2, "p", 28.0, 8.0, 34.0, 12.0), (3, "p", 900.0, 0.0, 901.0, 1.0)], "id int, page string, lx0 double, ly0 double, lx1 double, ly1 double")
    b = spark.createDataFrame([(1, "p", 0.0, 0.0, 20.0, 20.0), (2, "p", 0.0, 0.0, 30.0, 20.0)], "seq int, page string, x0 double, y0 double, x1 double, y1 double")
    assert {r.id: r.target for r in joins.link_target(links, b, ["page"]).collect()} == {1: 1, 2: 2}


def test_geometry(spark):
    r = lambda *v: geometry.rect(*map(F.lit, map(float, v)))
    assert value(spark, geometry.iou(r(0, 0, 2, 2), r(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert tuple(value(spark, geometry.project(r(0, 0, 1, 1), r(0, 0, 2, 2), r(10, 10, 14, 14)))) == (10, 10, 12, 12)
    assert tuple(value(spark, r(3, 4, 1, 2))) == (1, 2, 3, 4)
    assert value(spark, geometry.fit(F.lit(130.0), F.lit(100.0))) == "push"


def test_classification(spark):
    role = lambda t, ratio=1.0: value(spark, classify.role(F.lit(t), F.lit(ratio), F.lit(1))).role
    assert role("12") == "page_number" and role("Figure 42") == "caption" and role("Plain words in a row") == "body_text"
    assert role("1. Intro .......... 3") == "toc_entry" and role("x^2 + y^2 = z^2") == "formula" and role("Title", 1.5) == "heading"
    f = classify.features(F.lit("Figure 42"))
    assert value(spark, f["digit_ratio"]) == pytest.approx(2 / 9)
    assert value(spark, classify.font_weight(F.lit("Noto-Bold"))) > 0.8
    assert value(spark, classify.features(F.lit("3.1 Methods"))["numbering"])
    entry = lambda t: tuple(value(spark, classify.toc_entry(F.lit(t))))
    assert entry("5.1 Data Collection") == ("section", 2, "5.1", "Data Collection")
    assert entry("Chapter 3: Kernels") == ("chapter", 1, "3", "Kernels") and entry("Plain") == ("plain", 0, "", "Plain") and entry("Index")[0] == "index"
    assert value(spark, classify.table_columns(F.lit("A|B|C\n1|2|3"))) == 3 and value(spark, classify.table_columns(F.lit("one line"))) is None
    assert value(spark, classify.is_code(F.lit("return x"), F.lit(1)))


def test_text(spark):
    assert value(spark, text.post_process(F.lit(" a , b ( c ) \r\n"))) == "a, b (c)"
    assert value(spark, text.wrap(F.lit("aa bb cccccc d"), 5)) == ["aa bb", "cccccc", "d"]
    assert value(spark, text.chunks(F.lit("a" * 1500 + "\n\n" + "b" * 400 + "\n\n" + "c" * 400))) == ["a" * 1500 + "\n\n" + "b" * 400, "c" * 400]
    assert value(spark, text.sentences(F.lit("See Fig. 3 of Dr. A. B. now. It has 3.5 parts. End"))) == ["See Fig. 3 of Dr. A. B. now.", "It has 3.5 parts.", "End"]
    assert [value(spark, text.language(F.lit(t))) for t in ("abc", "中文字", "かな漢", "한국어", "12", "")] == ["en", "zh", "ja", "ko", "unknown", "unknown"]
    assert value(spark, text.nfc(F.lit("é"))) == "é" and value(spark, text.normalized(F.lit("a​  b\nc"))) == "a b\nc"
    assert value(spark, text.best_domain(F.lit("a theorem and a lemma of stress"))) == "math" and value(spark, text.best_domain(F.lit("none"))) == "generic"
    routes = [value(spark, text.route(F.lit(t), ("github",))).route for t in ("", "{ v1 }", "12, 5%", "see github now", "a_b := 3", "some plain words here")]
    assert routes == ["keep"] * 5 + ["translate"]


def test_evidence(spark):
    fuse = lambda *s: round(value(spark, aggregates.fuse([(F.lit(x).cast("double"), 1.0) for x in s])), 6)
    assert fuse(0.8, 0.9) == 0.9 and fuse(0.9, 0.1) == 0.4 and fuse(None) == 0.5 and fuse(0.99, 0.99) == 0.99 and fuse(0.5, 0.7) == 0.6


def test_sections_and_islands(spark):
    h = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 2), (1, 4, 1)], "d int, i int, level int")
    assert [r.parent for r in windows.section_parents(h, "d", "i").orderBy("i").collect()] == [None, 0, 1, 0, None]
    toc = spark.createDataFrame([(1, 0, "1", 1), (1, 1, "1.1", 2), (1, 2, "1.1.1", 3), (1, 3, "2", 1), (1, 4, "2.1", 2)], "doc_id bigint, seq bigint, number string, level int")
    assert [(r.parent, r.depth) for r in windows.outline(toc).orderBy("seq").collect()] == [(None, 0), (0, 1), (1, 2), (None, 0), (3, 1)]
    p = spark.createDataFrame([(1, 0, "exam-"), (1, 1, "ple one"), (1, 2, " "), (1, 3, "two")], "doc_id int, block_idx int, text string")
    assert [r.text for r in windows.paragraphs(p).orderBy("paragraph").collect()] == ["example one", "two"]
    s = spark.createDataFrame([(1, 0.0, 50.0), (1, 1.0, 40.0), (1, 2.0, 100.0)], "task int, ts double, real double")
    assert one(windows.smoothed(s)).shown == 100.0


def test_operator_graph(spark):
    calls = []

    def made(name, *needs):
        def run(c):
            calls.append(name)
            return c[needs[0]].withColumn(name, F.lit(1)) if needs else spark.range(3)

        return run

    g = OperatorGraph().add("parse", made("parse")).add("plan", made("plan", "parse"), "parse").add("render", made("render", "plan"), "plan")
    assert g.order() == ["parse", "plan", "render"] and g.dependents("parse") == {"plan", "render"} and g.affected(["plan"]) == ["plan", "render"]
    cache = ResultCache(spark)
    assert g.run({}, cache=cache)["render"].columns == ["id", "plan", "render"]
    g.run({}, cache=cache)
    assert calls == ["parse", "plan", "render"] and [t["cached"] for t in g.trace[-3:]] == [True] * 3
    with pytest.raises(ValueError):
        g.order(["nothing"])
    with pytest.raises(ValueError):
        OperatorGraph().add("a", made("a"), "b").add("b", made("b"), "a").order()


def test_passes_registry_and_repair(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, hash string")
    m = PassManager().add("ok", lambda d: d.withColumn("hash", F.upper("hash"))).add("broken", lambda d: d.select("missing")).add("drop", lambda d: d.where("id = 1"))
    out, report = m.run(df, track=("id", "hash"))
    assert out.count() == 1 and report.ran == ["ok", "drop"] and "broken" in report.failed
    assert {r.change for r in report.diffs["drop"].collect()} == {"removed"}
    r = Registry()
    r.register("x", 1, ("ocr",), 1)
    r.register("y", 2, ("ocr",), 5)
    assert r.best("ocr") == 2 and r.best("none") is None and r.unregister("y") and r.best("ocr") == 1
    fixed, counts = repair_loop(df.withColumn("bad", F.lit(2)), lambda d: d.where("bad > 0"), lambda d, i: d.withColumn("bad", F.col("bad") - F.col("id")), most=3)
    assert counts == [2, 1, 0] and fixed.where("bad > 0").count() == 0


def test_sources(spark, tmp_path):
    n, e = blocks.document_graph(blocks.text_blocks(spark.createDataFrame([(1, "Head\nsome line of text, then more words here"), (2, None)], "doc_id bigint, text string")))
    assert n.count() == 3 and {r.edge_type: r["count"] for r in e.groupBy("edge_type").count().collect()} == {"CONTAINS": 2, "FOLLOWS": 1}
    path = str(tmp_path / "g.json")
    with open(path, "w") as f:
        f.write('{"nodes":[{"id":"a"},{"id":"b"}],"edges":[{"src":"a","dst":"b"},{"src":"a","dst":"zz"}]}')
    assert [x.count() for x in blocks.read_graph(spark, path)] == [2, 1]
    assert blocks.synthetic_corpus(spark, 4).where("doc_id = 3").orderBy("seq").first().text == "A Two-Column Study"
    rec = blocks.normalize_records(spark.createDataFrame([("t", -5.0)], "text string, w double")).first()
    assert (rec.x0, rec.x1, rec.y1) == (-5.0, 0.0, 14.0)


def test_streams_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"2024-01-01 0{k % 9}:00:0{k % 7}", k % 3, ["view", "click", "buy"][k // 3 % 3], float(k), "{}") for k in range(40)], "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    events = log.stream(spark, str(tmp_path / "in"))
    log.run_to_table(log.stream_changes(events), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.user_id, r.event_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.user_id, r.event_id) for r in log.transitions(rows).collect()}
    log.run_to_table(log.stream_latest(events), str(tmp_path / "latest"), str(tmp_path / "cp2"), "update")
    assert {(r.user_id, r.last_type, r.n) for r in spark.read.parquet(str(tmp_path / "latest")).collect()} == {(r.user_id, r.last_type, r.n) for r in log.latest_state(rows).collect()}
    log.dispatch(events, {"ok": (log.matches(["view"]), lambda b: b.write.mode("append").parquet(str(tmp_path / "ok"))), "bad": (log.matches(task=1), lambda b: 1 / 0)}, str(tmp_path / "dead"), str(tmp_path / "cp3"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == rows.where("event_type = 'view'").count()
    assert spark.read.parquet(str(tmp_path / "dead")).count() == rows.where("user_id = 1").count()


def test_loops_that_do_not_settle_are_errors(spark):
    chain = spark.createDataFrame([(k, k + 1, 0) for k in range(6)], "src bigint, dst bigint, seq int")
    top, nodes = spark.createDataFrame([(0,)], "id bigint"), spark.range(7)
    assert traverse.closure(chain, top).count() == 7 and traverse.levels(nodes, chain).agg({"level": "max"}).first()[0] == 6
    assert traverse.walk(chain, top).count() == 7
    for call in (lambda: traverse.closure(chain, top, 3), lambda: traverse.levels(nodes, chain, 3), lambda: traverse.walk(chain, top, 3)):
        with pytest.raises(RuntimeError):
            call()


def test_levels_of_a_graph_with_cycles_and_strangers(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 3), (9, 2), (1, 1), (5, 6), (5, 6)], "src bigint, dst bigint")
    got = {r.id: r.level for r in traverse.levels(spark.range(7), edges).collect()}
    assert got == {0: 0, 5: 0, 6: 1}


def test_sections_of_any_depth(spark):
    rows = [(1, k, k + 1) for k in range(12)] + [(1, 12, 9), (1, 13, 1), (1, 14, 30)]
    got = {r.i: r.parent for r in windows.section_parents(spark.createDataFrame(rows, "d int, i int, level int"), "d", "i").collect()}
    assert got == {0: None} | {k: k - 1 for k in range(1, 12)} | {12: 7, 13: None, 14: 13}


def test_results_follow_the_files_they_were_made_from(spark, tmp_path):
    path = str(tmp_path / "source")
    op = OperatorGraph().add("read", lambda c: spark.read.parquet(path)).add("sum", lambda c: c["read"].agg(F.sum("id").alias("s")), "read").operators["sum"]
    cache = ResultCache(spark, most=1)

    def total():
        source = spark.read.parquet(path)
        key = cache.key(op, {"read": source})
        found = cache.get(key)
        return (found is not None), one(found if found is not None else cache.put(key, source.agg(F.sum("id").alias("s")))).s

    spark.range(5).write.parquet(path)
    assert total() == (False, 10) and total() == (True, 10)
    spark.range(9).write.mode("overwrite").parquet(path)
    assert total() == (False, 36) and total() == (True, 36) and len(cache.held) == 1
