"""Classification of blocks by ordered rules: features, roles, contents entries, policies, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns in the dialect that Java and RE2 share.
MENTION = r"(Figure|Fig|FIG|Table|Tab|Equation|Eq|Section|Sec)[.]? ?[(]?([0-9]+([.][0-9]+)*)"
SECTION_NUMBER = r"^[ ]*([0-9]+([.][0-9]+)*)"
CITATION = r"\[[0-9][0-9, -]*\]|\[[A-Za-z]+[0-9]*\]"
LEADER_CHARS = "[.·…‥]"
LEADER_LINE = r"([.·…‥][ .·…‥]*){2,}[ ]*[0-9]{1,4}[ ]*$"
CODE_WORD = r"(?i)(^|[^A-Za-z0-9_])(def|class|function|import|export|return|if|else|elif|for|while|try|except|catch|switch|case|break|continue|var|let|const|void|int|float|double|char|struct|enum|lambda|yield|pass)([^A-Za-z0-9_]|$)"


def share(text: Column, pattern: str) -> Column:
    """Share of a text's characters that match a one-character pattern; 0 for an empty text."""
    n = F.length(text)
    return F.when(n == 0, 0.0).otherwise((n - F.length(F.regexp_replace(text, pattern, ""))) / n)


def features(text: Column) -> dict[str, Column]:
    """Numeric features of a block's text."""
    return {
        "digit_ratio": share(text, "[0-9]"),
        "punctuation_ratio": share(text, "[^A-Za-z0-9_À-ɏ \t\n]"),
        "leader_ratio": share(text, LEADER_CHARS),
        "capital_ratio": share(text, "[A-Z]"),
        "numbering": text.rlike(r"^([0-9]+([.][0-9]+)*|[A-Z]([.][0-9]+)*|[IVXLC]+[.]?|[0-9]+[.)])[ \t]+"),
    }


def font_weight(font: Column) -> Column:
    """Weight of a font by the words in its name."""
    low, out = F.lower(F.coalesce(font, F.lit(""))), F.lit(0.0)
    for word, weight in reversed((("black", 1.0), ("heavy", 1.0), ("bold", 0.9), ("demibold", 0.75), ("semibold", 0.7), ("medium", 0.5))):
        out = F.when(F.contains(low, F.lit(word)), weight).otherwise(out)
    return out


def role(text: Column, size_ratio: Column, n_lines: Column, heading_ratio: float = 1.15) -> Column:
    """Struct (role, confidence) by the first rule that holds."""
    t, f = F.trim(text), features(F.trim(text))
    say = lambda r, c: F.struct(F.lit(r).alias("role"), (c if isinstance(c, Column) else F.lit(c)).cast("double").alias("confidence"))
    symbols = F.length(t) - F.length(F.regexp_replace(t, r"[-+*/=^_{}<>()~]", ""))
    return (
        F.when(t == "", say("unknown", 0.0))
        .when(t.rlike(r"^[0-9]{1,4}$") | (t.rlike(r"(?i)^[ivxlcdm]+$") & (F.length(t) <= 8)), say("page_number", 0.7))
        .when((f["leader_ratio"] >= 0.08) & t.rlike(LEADER_LINE), say("toc_entry", F.least(F.lit(0.98), f["leader_ratio"] + 0.6)))
        .when(t.rlike(r"(?i)^(figure|fig|table|tab)[ .:]*[0-9]+") & (F.length(t) <= 200), say("caption", 0.92))
        .when(t.rlike(r"^[-0-9 +*/=(){}^_\\<>,.~]+$") | ((symbols >= 2) & (share(t, "[A-Za-z0-9À-ɏ]") < 0.85)), say("formula", 0.9))
        .when((n_lines <= 1) & (F.length(t) <= 400) & t.rlike(r"^([†‡§¶*•][ 0-9]|[0-9]{1,3}[ .)])") & (size_ratio > 0) & (size_ratio < 0.92), say("footnote", 0.8))
        .when(size_ratio >= heading_ratio, say("heading", F.least(F.lit(0.98), F.lit(0.65) + (size_ratio - heading_ratio) * 0.5)))
        .when(f["numbering"] & (n_lines <= 2), say("heading", 0.72))
        .when((n_lines <= 1) & t.rlike(r"(?i)^(\[[0-9]+|references?$|bibliography$)"), say("citation", 0.85))
        .otherwise(say("body_text", 0.6))
    )


def toc_entry(text: Column) -> Column:
    """Struct (kind, level, number, title) of a contents line, by the first form that fits."""
    t = F.trim(text)
    forms = (
        ("chapter", 1, r"(?i)^(chapter|ch[.])[ ]*([0-9IVXLC]+)"),
        ("section", 2, r"(?i)^(section|sec[.])[ ]*([0-9]+([.][0-9]+)*)"),
        ("subsection", 3, r"(?i)^(subsection|subsec[.])[ ]*([0-9]+([.][0-9]+)*)"),
        ("part", 1, r"(?i)^(part)[ ]*([0-9IVXLC]+)"),
        ("appendix", 1, r"(?i)^(appendix|appx[.])[ ]*([A-Z0-9]+)"),
    )
    made = lambda kind, level, number, title: F.struct(F.lit(kind).alias("kind"), (level if isinstance(level, Column) else F.lit(level)).cast("int").alias("level"), number.alias("number"), F.btrim(title, F.lit(" \t:.-()[]{}")).alias("title"))
    dots = lambda n: F.length(n) - F.length(F.replace(n, F.lit("."), F.lit(""))) + 1
    none = F.lit("")
    out = F.when(t == "", made("unknown", 0, none, none)).when(t.rlike(r"(?i)^(table +of +contents|contents)$"), made("contents", 0, none, none)).when(t.rlike(r"(?i)^index$"), made("index", 0, none, none))
    for kind, level, pattern in forms:
        out = out.when(t.rlike(pattern), made(kind, level, F.regexp_extract(t, pattern, 2), F.regexp_replace(t, pattern, "")))
    multi, single, closed = r"^([0-9]+([.][0-9]+)+)[ \t]+", r"^([0-9]+)[ ]*[.:]", r"^[(]?[ ]*([0-9]+([.][0-9]+)*)[ ]*[)][ \t]+"
    number = F.regexp_extract(t, multi, 1)
    out = out.when(t.rlike(multi), made("section", dots(number), number, F.regexp_replace(t, multi, "")))
    out = out.when(t.rlike(single), made("section", 2, F.regexp_extract(t, single, 1), F.regexp_replace(t, single, "")))
    number = F.regexp_extract(t, closed, 1)
    out = out.when(t.rlike(closed), made("section", dots(number), number, F.regexp_replace(t, closed, "")))
    return out.otherwise(F.struct(F.lit("plain").alias("kind"), F.lit(0).alias("level"), none.alias("number"), t.alias("title")))


def mentions(blocks: DataFrame, text: str = "text") -> DataFrame:
    """``blocks`` exploded to cross references: (target_type, number), a row each."""
    raw = blocks.withColumn("raw", F.explode(F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))))
    word = F.lower(F.regexp_extract("raw", MENTION, 1))
    kind = F.when(F.startswith(word, F.lit("fig")), "figure").when(F.startswith(word, F.lit("tab")), "table").when(F.startswith(word, F.lit("eq")), "equation").otherwise("section")
    return raw.withColumn("target_type", kind).withColumn("number", F.regexp_extract("raw", MENTION, 2)).drop("raw")


def resolve_mentions(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, block_idx, target_type, number, target): mentions with the first caption of their number in the document."""
    pattern = r"^[ ]*(Figure|Fig|Table|Tab|Equation|Eq)[. ]*([0-9]+([.][0-9]+)*)"
    word = F.lower(F.regexp_extract("text", pattern, 1))
    kind = F.when(F.startswith(word, F.lit("fig")), "figure").when(F.startswith(word, F.lit("tab")), "table").otherwise("equation")
    hosts = blocks.where(F.col("kind").isin("caption", "table", "figure", "formula") & F.col("text").rlike(pattern)).select("doc_id", kind.alias("target_type"), F.regexp_extract("text", pattern, 2).alias("number"), "block_idx")
    first = hosts.groupBy("doc_id", "target_type", "number").agg(F.min("block_idx").alias("target"))
    return mentions(blocks.select("doc_id", "block_idx", "text")).drop("text").join(first, ["doc_id", "target_type", "number"])


def is_code(text: Column, n_lines: Column) -> Column:
    """A code word in a block of four lines or less (English words among them count too)."""
    return (F.trim(text) != "") & text.rlike(CODE_WORD) & (n_lines <= 4)


def table_columns(text: Column) -> Column:
    """Upper-rounded-down median of cells per line if most of two or more lines have three cells, else null."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")
    cells = F.array_sort(F.transform(lines, lambda s: F.size(F.split(F.trim(s), "  +|[|]|\t"))))
    n = F.size(cells)
    wide = F.size(F.filter(cells, lambda c: c >= 3))
    middle = F.floor((F.get(cells, F.floor((n - 1) / 2).cast("int")) + F.get(cells, F.floor(n / 2).cast("int"))) / 2).cast("int")
    return F.when((F.size(F.split(text, "\n")) >= 2) & (n > 0) & (wide >= F.greatest(F.lit(1), F.floor(n * 0.6))), middle)


KEEP_KINDS = ("formula", "figure", "image", "table", "code", "header", "footer", "page_number")


def policy(kind: Column, text: Column) -> Column:
    """Struct (translate, partial, preserve_math, preserve_code, preserve_number, reason) of a block."""
    number = F.regexp_extract(text, r"(?i)^[ ]*((figure|fig|table|tab|equation)[. ]*)?([0-9]+([.][0-9]+)*)", 3) != ""
    say = lambda t, p, m, c, n, r: F.struct(*(x.alias(a) for x, a in zip((F.lit(t), p, m, c, n, r), ("translate", "partial", "preserve_math", "preserve_code", "preserve_number", "reason"))))
    no = F.lit(False)
    return (
        F.when(kind.isin(*KEEP_KINDS), say(False, no, kind == "formula", kind == "code", no, F.concat(F.lit("kind:"), kind)))
        .when(kind == "toc", say(True, F.lit(True), no, no, F.lit(True), F.lit("toc:title_only")))
        .when(kind == "caption", say(True, number, no, no, number, F.when(number, "caption:keep_number").otherwise("caption")))
        .otherwise(say(True, no, no, no, no, F.lit("body")))
    )


# Base confidence of a block by its kind.
BASE_CONFIDENCE = {"toc": 0.55, "heading": 0.65, "caption": 0.6, "formula": 0.6, "footnote": 0.6, "paragraph": 0.85, "code": 0.7, "table": 0.7, "figure": 0.9, "header": 0.8, "footer": 0.8}


def lookup(column: Column, values: dict, default) -> Column:
    """Value of a small fixed table."""
    out = F.lit(default)
    for k, v in reversed(list(values.items())):
        out = F.when(column == k, v).otherwise(out)
    return out


def node_confidence(kind: Column, role_confidence: Column, damaged: Column, overflow: Column, empty: Column) -> Column:
    """Confidence of a block between 0.05 and 0.99, three places."""
    value = F.when(F.coalesce(role_confidence, F.lit(0.0)) != 0.0, F.lit(0.4) + role_confidence * 0.6).otherwise(lookup(kind, BASE_CONFIDENCE, 0.7))
    value = value * F.when(damaged, 0.3).otherwise(1.0) * F.when(overflow, 0.8).otherwise(1.0)
    value = F.when(empty, 0.1).otherwise(value)
    return F.bround(F.greatest(F.lit(0.05), F.least(F.lit(0.99), value)), 3)


def issues(blocks: DataFrame) -> DataFrame:
    """Rows (doc_id, block_idx, code, severity) of damaged, merged, empty and suspicious blocks, from one scan."""
    dotted = F.size(F.regexp_extract_all("text", F.lit(r"[0-9]+[.][0-9]+"), F.lit(0)))
    found = F.filter(
        F.array(
            F.when(F.contains("text", F.lit("�")), F.struct(F.lit("unicode_error").alias("code"), F.lit("error").alias("severity"))),
            F.when((dotted >= 2) & (F.col("text").rlike(r"[.]{3,}") | (dotted >= 3)), F.struct(F.lit("toc_merged_lines").alias("code"), F.lit("error").alias("severity"))),
            F.when(F.trim("text") == "", F.struct(F.lit("empty_block").alias("code"), F.lit("info").alias("severity"))),
            F.when((F.col("kind") == "formula") & (share(F.col("text"), r"[-+*/=^_{}<>()~]") < 0.5), F.struct(F.lit("formula_low_confidence").alias("code"), F.lit("warning").alias("severity"))),
            F.when(F.col("n_chars") > 2000, F.struct(F.lit("translation_overflow").alias("code"), F.lit("warning").alias("severity"))),
        ),
        lambda x: x.isNotNull(),
    )
    return blocks.withColumn("i", F.explode(found)).select("doc_id", "block_idx", "i.code", "i.severity")
