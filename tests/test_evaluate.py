"""Evaluation, visual order and lines on small tables whose results are known."""

from pyspark.sql import functions as F

from docflow.operators import aggregates, evaluate


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def test_preservation_of_nothing(spark):
    kept = lambda a, b: value(spark, aggregates.preservation(F.lit(a), F.lit(b)))
    assert (kept(0, 0), kept(0, 3), kept(4, 1), kept(2, 5)) == (1.0, 0.5, 0.25, 1.0)


def test_perfect_and_empty_translations(spark):
    columns = "doc int, headings int, captions int, toc_entries int, formulas int, pages int, lines int, chars int, cjk_chars int, latin_lines int, whitespace double, collision double, overflow double, order_consistency double"
    whole = spark.createDataFrame([(1, 2, 1, 0, 3, 2, 80, 100, 100, 0, 0.0, 0.0, 0.0, 1.0)], columns)
    s = evaluate.scores(whole, whole, "doc").first()
    assert [round(x, 9) for x in s[1:]] == [100.0, 100.0, 100.0, 100.0, 100.0]
    none = spark.createDataFrame([(1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0.0, 0.0, 0.0, None)], columns)
    s = evaluate.scores(whole, none, "doc").first()
    assert s.geometry_score == 0.0 and abs(s.structure_score - 35.0) < 1e-9 and abs(s.translation_score - 30.0) < 1e-9


def test_consistency_counts_every_violation(spark):
    score = lambda a, b: round(value(spark, evaluate.consistency(F.lit(a), F.lit(b), {"Cat": "Katze", "dog": "Hund"}, ("Ada",))), 9)
    assert score("A cat, a dog and Ada", "nichts") == 0.75
    assert score("A CAT by ada", "Eine katze von Ada") == 1.0
    assert score(None, None) == 1.0


def test_visual_order(spark):
    n = spark.createDataFrame([(1, "a", 0.0, 9.0), (1, "b", 0.0, 5.0), (1, "c", 0.0, 1.0), (2, "d", 5.0, 1.0), (2, "e", 1.0, 1.0), (3, "f", 0.0, 2.0), (3, "g", 0.0, 1.0), (3, "h", 0.0, 0.0)], "page bigint, id string, x0 double, y0 double")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("f", "g"), ("g", "f")], "src string, dst string")
    order = lambda e: [r.id for r in evaluate.visual_order(n, e).orderBy("page", "position").collect()]
    assert order(edges) == ["a", "b", "c", "e", "d", "h", "g", "f"]
    assert order(edges.limit(0)) == ["c", "b", "a", "e", "d", "h", "g", "f"]
    assert evaluate.visual_order(n.limit(0), edges).count() == 0


def test_lines_split_at_columns_and_lose_strips(spark):
    rows = [(1, "left", 0.0, 20.0, 100.0, 10.0), (1, "side", 24.0, 40.0, 100.5, 10.0), (1, "right", 80.0, 99.0, 100.0, 10.0), (1, "below", 0.0, 25.0, 80.0, 10.0)]
    strip = [(1, c, 300.0, 305.0, 20.0 * k, 10.0) for k, c in enumerate("abc")]
    words = lambda rows: spark.createDataFrame(rows, "page bigint, text string, x0 double, x1 double, y0 double, size double")
    lines = lambda rows: [r.text for r in evaluate.text_lines(words(rows)).orderBy("line").collect()]
    assert lines(rows + strip) == ["left side", "right", "below"]
    assert lines(rows + strip[:2]) == ["left side", "right", "below", "b", "a"]
    assert lines([]) == []


def test_contents_go_to_the_first_block(spark):
    b = spark.createDataFrame([(1, 1, "1.1 Intro 4", "paragraph"), (1, 2, "1.1 Intro again", "paragraph"), (2, 1, "1.1 Intro", "paragraph")], "page int, seq int, text string, kind string")
    e = spark.createDataFrame([(1, 1, "1.1", "Intro", "4"), (1, 2, "1", "Intro", "5")], "page int, seq int, number string, title string, target string")
    got = {(r.page, r.seq): (r.kind, r.toc_page) for r in evaluate.annotated_contents(b, e).collect()}
    assert got == {(1, 1): ("toc", "4"), (1, 2): ("paragraph", None), (2, 1): ("paragraph", None)}
