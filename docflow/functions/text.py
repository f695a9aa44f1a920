"""Text functions on columns: cleaning, detection, routing, scoring."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZERO_WIDTH = "[​-‏﻿  ]"


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Composed Unicode form; the one cleaning step without a built-in function."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def collapse(text: Column) -> Column:
    """White space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t\n\r]+", " "))


def without_controls(text: Column) -> Column:
    """Text without control characters other than tab and line ends."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def normalized(text: Column) -> Column:
    """Without zero-width characters, runs of blanks as one; line feeds stay."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), ZERO_WIDTH, ""), "[ \t]{2,}", " ")


def post_process(text: Column) -> Column:
    """CRLF to LF, trimmed, no space before , . ) or after (."""
    out = F.btrim(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit(" \t\n\r"))
    for a, b in ((" ,", ","), (" .", "."), (" )", ")"), ("( ", "(")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


#: Letters that Spark's Unicode gives a capital and DuckDB's does not yet.
NEWER = "\u019b\u0264\u1c8a\ua7cd\ua7db" + "".join(map(chr, range(0x10D70, 0x10D86)))


def _single_capitals() -> dict[str, str]:
    """Letters with a capital of several letters, and the single one that stands for it, else themselves."""
    full = [c for c in map(chr, range(0x110000)) if len(c.upper()) > 1]
    return {c: c.title() if len(c.title()) == 1 else c for c in full} | {"ß": "ẞ"} | {c: c for c in NEWER}


SINGLE_CAPITALS = _single_capitals()


def _ranges(letters) -> str:
    """The letters as the inside of a regular expression's class, runs of neighbours as ranges."""
    points, out = sorted(map(ord, letters)), []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


def upper_each(text: Column) -> Column:
    """Upper case letter by letter, as DuckDB's ``upper``: no letter becomes two (ß is ẞ, where Spark's ``upper`` writes SS)."""
    these = _ranges(SINGLE_CAPITALS)
    runs = F.regexp_extract_all(text, F.lit(f"[{these}]+|[^{these}]+"), F.lit(0))
    single = F.array_join(F.transform(runs, lambda run: F.when(run.rlike(f"^[{these}]"), F.translate(run, "".join(SINGLE_CAPITALS), "".join(SINGLE_CAPITALS.values()))).otherwise(F.upper(run))), "")
    return F.when(text.rlike(f"[{these}]"), single).otherwise(F.upper(text))


def entity_key(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), " -", "__")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def language(text: Column) -> Column:
    """Language by script: ja, ko or zh where Han, kana and hangul outweigh Latin letters, else en; unknown without either."""
    cjk = F.length(F.regexp_replace(text, "[^一-鿿぀-ヿ가-힯]", ""))
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    east = F.when(text.rlike("[぀-ヿ]"), "ja").when(text.rlike("[가-힯]"), "ko").otherwise("zh")
    return F.when((cjk == 0) & (latin == 0), "unknown").when(cjk > latin, east).otherwise("en")


# Keyword -> domain, and the keywords of each glossary domain, in order.
DOMAIN_KEYWORDS = {
    "diffusion model": "diffusion",
    "latent diffusion": "diffusion",
    "transformer": "nlp",
    "attention mechanism": "nlp",
    "language model": "nlp",
    "natural language": "nlp",
    "convolutional": "computer_vision",
    "object detection": "computer_vision",
    "segmentation": "computer_vision",
    "reinforcement": "reinforcement_learning",
    "gradient descent": "optimization",
    "convex": "optimization",
    "linear programming": "optimization",
    "bayesian": "statistics",
    "regression": "statistics",
    "hypothesis": "statistics",
    "quantum": "physics",
    "hamiltonian": "physics",
    "protein": "biology",
    "genome": "biology",
    "differential equation": "mathematics",
    "stochastic": "mathematics",
    "theorem": "mathematics",
}
GLOSSARY_DOMAINS = {
    "cs": ("kernel", "scheduler", "thread", "compiler", "runtime", "deadlock", "register", "instruction"),
    "math": ("lemma", "theorem", "eigenvalue", "manifold", "topology", "gradient", "vector space"),
    "medicine": ("lesion", "patient", "clinical", "biopsy", "antibody", "symptom"),
    "law": ("plaintiff", "defendant", "statute", "jurisdiction", "contract", "liability"),
    "engineering": ("stress", "strain", "fatigue", "torque", "bearing", "vibration", "tolerance"),
}


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("bigint")


def domain_scores(text: Column, keywords: dict[str, str]) -> Column:
    """Array of (domain, score), one per domain, in the order of the keywords."""
    low = F.lower(F.coalesce(text, F.lit("")))
    by: dict[str, Column] = {}
    for word, domain in keywords.items():
        by[domain] = by[domain] + occurrences(low, word) if domain in by else occurrences(low, word)
    return F.array(*(F.struct(F.lit(d).alias("domain"), s.alias("score")) for d, s in by.items()))


def best_domain(text: Column, domains: dict[str, tuple[str, ...]] = GLOSSARY_DOMAINS) -> Column:
    """Domain of which the most keywords stand in the text, the first on a tie, generic without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) for words in domains.values()]
    best = F.greatest(*hits)
    out = F.lit("generic")
    for name, h in reversed(list(zip(domains, hits))):
        out = F.when((best > 0) & (h == best), name).otherwise(out)
    return out


def route(text: Column, keep_terms: tuple[str, ...] = ()) -> Column:
    """Struct (route, confidence, reason): whether a paragraph is worth translating."""
    t = F.trim(F.coalesce(text, F.lit("")))
    words = F.size(F.filter(F.split(t, "[ \t\n]+"), lambda w: w != ""))
    tokens = F.transform(F.split(F.lower(t), "[ \t\n]+"), lambda w: F.btrim(w, F.lit(" ,.:;()[]{}")))
    kept = F.exists(tokens, lambda w: w.isin(*keep_terms)) if keep_terms else F.lit(False)
    verdict = lambda r, c, why: F.struct(F.lit(r).alias("route"), (c if isinstance(c, Column) else F.lit(c)).cast("double").alias("confidence"), F.lit(why).alias("reason"))
    score = F.lit(0.5) + F.when(words.between(2, 12), 0.2).when(words.between(13, 60), 0.3).when(words > 60, 0.35).otherwise(0.0)
    score = F.when(t.rlike("[A-Za-zÀ-ɏ一-鿿]"), score).otherwise(F.least(score, F.lit(0.45)))
    return (
        F.when(t == "", verdict("keep", 0.0, "empty"))
        .when(t.rlike(r"\{ *v[0-9]+ *\}"), verdict("keep", 0.1, "formula_marker"))
        .when(t.rlike(r"^[-0-9%. ,:;()\t\n]+$"), verdict("keep", 0.2, "number_only"))
        .when(kept, verdict("keep", 0.3, "brand|technical"))
        .when(t.rlike(r"[{}_\\]|:[A-Za-z0-9_]+ *=") & (words <= 8), verdict("keep", 0.3, "code_like"))
        .otherwise(verdict("translate", score, "translate:mainline"))
    )


def chunks(text: Column, budget: int = 2000) -> Column:
    """Paragraphs of a text merged in order up to ``budget`` characters, joined by blank lines."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda p: F.trim(p) != "")

    def merge(acc, p):
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(last) + F.length(p) + 2 <= budget)
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws("\n\n", last, p)))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(F.size(acc) == 0, F.array(p)).otherwise(merge(acc, p)))


# Abbreviations and titles after which a period ends no sentence.
ABBREVIATIONS = (
    "e.g", "i.e", "etc", "vs", "cf", "al", "fig", "figs", "tab", "tabs", "eq", "eqs", "sec", "ref", "refs", "no", "nos",
    "vol", "pp", "ed", "eds", "dept", "est", "approx", "min", "max", "avg", "viz", "et",
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st",
)


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Sentences that end in a period before white space; abbreviations, initials and decimals end none."""
    out, start = [], 0
    for k, c in enumerate(text):
        if c != "." or (k + 1 < len(text) and not text[k + 1].isspace()):
            continue
        word = text[max(0, k - 12) : k].split()[-1:] or [""]
        word = word[0].lstrip("([").lower()
        if word in ABBREVIATIONS or (len(word) == 1 and word.isalpha()):
            continue
        out.append((start, k + 1))
        start = k + 1
    if text[start:].strip():
        out.append((start, len(text)))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [s for a, b in sentence_spans(t or "") if (s := (t[a:b]).strip())])


def wrap(text: Column, width: int) -> Column:
    """Greedy lines of at most ``width`` characters; a longer word has a line of its own."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")

    def add(acc, w):
        joined = F.concat_ws(" ", F.when(acc.line != "", acc.line), w)
        return F.when(F.length(joined) <= width, F.struct(acc.lines.alias("lines"), joined.alias("line"))).otherwise(F.struct(F.concat(acc.lines, F.when(acc.line != "", F.array(acc.line)).otherwise(F.array().cast("array<string>"))).alias("lines"), w.alias("line")))

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))
    return F.aggregate(words, start, add, lambda a: F.when(a.line != "", F.concat(a.lines, F.array(a.line))).otherwise(a.lines))


def clamp(value: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), value))
