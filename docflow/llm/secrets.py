"""Secret scans: known patterns, and a randomness test battery for the rest.

Only DataFrame expressions are used; a text is scanned where it lies.

Patterns: ``assign`` (a keyword, ``=`` or ``:``, a value of 6 or more
characters), ``access`` (AKIA keys) and ``hex`` (24 or more hexadecimal digits).

The battery looks at every other run of 20 or more characters of
``[A-Za-z0-9+/_=-]``. The smallest alphabet that has all its characters is its
inferred encoding; in a run of one letter case ``-`` and ``_`` only part its
groups, as in a UUID. Three statistics compare it with random draws from that
alphabet:

* chi-squared of the character counts against a uniform alphabet,
* runs of characters in the same half of the alphabet,
* lag-one serial correlation of places in the alphabet.

Fisher's rule combines their three p-values; a run with a combined one below
``RANDOM_P`` is not random. The p-value of the opposite hypothesis, that the run
is *ordinary* text, is its likelihood as ordinary text over its likelihood as
random draws: ordinary text keeps to one class of characters and has the letters
of prose. Under that hypothesis the ratio is at most p with probability p or
less, and each further character of a random run lowers it, in every encoding.
For a run that is not random it is 1. Benjamini-Hochberg over every tested run,
for each encoding and length class of the whole corpus, then bounds the share of
false discoveries, from a histogram of p-values with a fixed number of bins.

All work is linear in a text's length and close to it in its number of hits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Fixed patterns. The base patterns are Java regular expressions.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

#: (name, pattern of the whole run, size, pattern of the upper half of the alphabet, SQL order string)
ENCODINGS = (
    ("decimal", r"^[0-9]+$", 10, "0123456789"),
    ("hex", r"^(?=.*[0-9])([0-9a-f]+|[0-9A-F]+)$", 16, "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", 32, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", r"^([a-z0-9]+|[A-Z0-9]+)$", 36, "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 64, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)

#: Accepted share of false discoveries; p-value bins per length class; length classes (upper bounds).
FALSE_DISCOVERIES, BINS = 0.01, 400
LENGTHS = (23, 31, 47, 79, 159, 1 << 31)
#: The combined p-value of the three tests below which a run is not random: one random run in 10,000 is lost.
RANDOM_P = 1e-4
#: Ordinary text: the chance that the next character is of the same class (lower, upper, digit, other), and the letters'
#: shares, three quarters those of prose and one quarter equal, for other languages and invented words.
STAY, PROSE = 0.8, 0.75
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)))
CHARACTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"


def _log_shares() -> list[float]:
    """For each of CHARACTERS, the logarithm of its share of its class in ordinary text."""
    letters = [math.log(PROSE * v / sum(LETTERS.values()) + (1 - PROSE) / 26) for v in LETTERS.values()]
    return letters * 2 + [math.log(1 / 10)] * 10 + [math.log(1 / 5)] * 5


#: Elements that :func:`running` takes together.
BLOCK = 64


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, combine) -> Column:
    """For each of an array of whole numbers, the combination of 0 and all before it; by blocks, as appending copies."""

    def before(array: Column, zero: Column) -> Column:
        first = F.struct(zero.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(array, first, lambda acc, x: F.struct(combine(acc.at, x).cast("int").alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")), lambda acc: acc.out)

    whole = lambda array: F.aggregate(array, F.lit(0), lambda acc, x: combine(acc, x).cast("int"))
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
    each = lambda b: bound(before(F.transform(b, whole), F.lit(0)), lambda starts: F.flatten(F.zip_with(b, starts, before)))
    return bound(values, lambda v: F.when(F.size(v) > 0, bound(blocks(v), each)).otherwise(F.array().cast("array<int>")))


def located(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of (start, end, kind, value) of the leftmost, non-overlapping matches, in code points, end exclusive."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def spans(x: Column) -> Column:
        sizes = F.zip_with(F.slice(x.gaps, F.lit(1), F.size(x.hits)), x.hits, lambda g, h: F.length(g) + F.length(h))
        ends = F.zip_with(running(sizes, lambda p, q: p + q), sizes, lambda at, n: at + n)
        made = F.zip_with(ends, x.hits, lambda e, v: F.struct((e - F.length(v)).cast("int").alias("start"), e.cast("int").alias("end"), F.lit(KINDS.index(kind)).alias("kind"), v.alias("value")))
        return F.filter(made, keep) if keep is not None else made

    return F.when(text.rlike(pattern), bound(found, spans)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>"))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start, then by kind as listed."""
    assign = located(text, ASSIGN, "assign", lambda s: F.length(F.regexp_extract(s.value, ASSIGN, 2)) >= MIN_VALUE)
    return F.array_sort(F.concat(assign, located(text, ACCESS, "access"), located(text, HEX, "hex")), _by_place)


def _by_place(a: Column, b: Column) -> Column:
    sign = lambda x, y, rest: F.when(x < y, -1).when(x > y, 1).otherwise(rest)
    return sign(a.start, b.start, sign(a.kind, b.kind, F.lit(0)))


def battery(value: Column) -> Column:
    """Struct (encoding, n, chi_z, runs_z, serial_z, ordinary_p), null for a run without an encoding."""
    mixed = value.rlike("[a-z]") & value.rlike("[A-Z]")
    bare = F.when(mixed, value).otherwise(F.regexp_replace(value, "[-_]", ""))
    return F.transform(F.array(bare), _battery)[0]


def _battery(value: Column) -> Column:
    out = F.lit(None)
    for name, pattern, size, order in reversed(ENCODINGS):
        out = F.when(value.rlike(pattern), _statistics(F.lower(value) if size in (16, 36) else value, name, size, order)).otherwise(out)
    return out


def _statistics(value: Column, name: str, size: int, order: str) -> Column:
    def of(x: Column) -> Column:
        core, letters = x.core, x.letters
        places = F.transform(letters, lambda c: _place(order, c, size))
        codes = F.transform(letters, lambda c: F.instr(F.lit(CHARACTERS), c))
        counts = F.transform(F.array_distinct(letters), lambda c: (F.size(letters) - F.length(F.replace(core, c, F.lit("")))).cast("double"))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        struct = F.struct(F.size(letters).cast("double").alias("n"), squares.alias("squares"), places.alias("places"), codes.alias("codes"))
        # What is left of a run of fill characters has no two letters to compare.
        return F.when(F.size(letters) >= 2, bound(struct, lambda s: _scores(s, name, size)))

    core = F.regexp_replace(value, "=+$", "")
    return bound(F.transform(F.array(core), lambda c: F.struct(c.alias("core"), F.split(c, "").alias("letters")))[0], of)


def _ordinary(codes: Column) -> Column:
    """Logarithm of the likelihood of a run, as places in CHARACTERS from 1, as ordinary text."""
    shares = F.array(*map(F.lit, _log_shares()))
    kind = lambda c: F.when(c <= 26, 0).when(c <= 52, 1).when(c <= 62, 2).otherwise(3)
    first = F.struct(F.lit(math.log(1 / 4)).alias("sum"), F.lit(-1).alias("last"))
    step = lambda acc, c: F.struct(
        (acc.sum + F.get(shares, c - 1) + F.when(acc.last < 0, 0.0).when(acc.last == kind(c), math.log(STAY)).otherwise(math.log((1 - STAY) / 3))).alias("sum"), kind(c).alias("last")
    )
    return F.aggregate(codes, first, step, lambda acc: acc.sum)


def _place(order: str, c: Column, size: int) -> Column:
    return F.pmod(F.instr(F.lit(order), c) - 1, F.lit(size)).cast("double")


def tail(z: Column) -> Column:
    """Chance of a standard normal draw beyond ``z``, by the logistic approximation (within 0.0002)."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 0.07056 * z * z * z + 1.5976 * z)))


def _scores(s: Column, name: str, size: int) -> Column:
    n, k = s.n, float(size)
    chi = s.squares * k / n - n
    # Wilson and Hilferty: the cube root of chi-squared over its degrees of freedom is close to normal.
    spread = 2 / (9 * (k - 1))
    chi_z = (F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - spread)) / math.sqrt(spread)
    last = F.greatest(F.size(s.places) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(s.places, F.lit(1), last), F.slice(s.places, F.lit(2), last), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    turns = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.when((p.a >= k / 2) != (p.b >= k / 2), 1.0).otherwise(0.0))
    runs_z = (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    middle = (k - 1) / 2
    product = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p.a - middle) * (p.b - middle))
    serial_z = product / (((k * k - 1) / 12) * F.sqrt(n - 1))
    likelihood = F.exp(F.least(F.lit(0.0), _ordinary(s.codes) + n * math.log(k)))
    parts = {"encoding": F.lit(name), "n": n.cast("int"), "chi_z": chi_z, "runs_z": runs_z, "serial_z": serial_z, "likelihood": likelihood}
    return bound(F.struct(*(c.alias(x) for x, c in parts.items())), _combined)


def _combined(t: Column) -> Column:
    """The statistics with ``random_p``, by Fisher's rule, and ``ordinary_p``."""
    # Counts that are too uneven speak against random draws; the other two tests have two sides.
    product = tail(t.chi_z) * F.least(F.lit(1.0), 2 * tail(F.abs(t.runs_z))) * F.least(F.lit(1.0), 2 * tail(F.abs(t.serial_z)))
    random_p = bound(-F.log(F.greatest(F.lit(1e-300), product)), lambda f: F.exp(-f) * (1 + f + f * f / 2))
    same = [t[c].alias(c) for c in ("encoding", "n", "chi_z", "runs_z", "serial_z")]
    return bound(random_p, lambda r: F.struct(*same, r.alias("random_p"), F.when(r < RANDOM_P, 1.0).otherwise(t.likelihood).alias("ordinary_p")))


def _apart(runs: Column, base: Column) -> Column:
    """The runs that no base span overlaps: what ends before them and what starts after them, in one ordered pass."""
    bare = lambda a: F.transform(a, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"), s.value.alias("value")))
    random = KINDS.index("random")

    def of(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: F.when(s.kind == random, 0).otherwise(s.end)), F.greatest)
        # Starts are counted back from a large number, so that the greatest is the least start.
        starts = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(s.kind == random, 0).otherwise(FAR - s.start))), F.greatest))
        marked = F.zip_with(spans, F.zip_with(ends, starts, lambda e, f: F.struct(e.alias("e"), f.alias("f"))), lambda s, x: F.struct(s.alias("s"), x.alias("x")))
        return F.transform(F.filter(marked, lambda m: (m.s.kind == random) & (m.x.e <= m.s.start) & (FAR - m.x.f >= m.s.end)), lambda m: m.s)

    return F.when(F.size(runs) > 0, bound(F.array_sort(F.concat(bare(base), bare(runs)), _by_place), of)).otherwise(runs)


FAR = (1 << 31) - 1


def candidates(text: Column, base: Column) -> Column:
    """Every run outside the base spans that has an encoding, with its statistics."""
    runs = bound(located(text, RUN, "random"), lambda r: _apart(r, base))
    tested = F.transform(runs, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"), battery(s.value).alias("test")))
    return F.filter(tested, lambda s: s.test.isNotNull())


def length_class(n: Column) -> Column:
    out = F.lit(len(LENGTHS) - 1)
    for k, most in reversed(list(enumerate(LENGTHS[:-1]))):
        out = F.when(n <= most, k).otherwise(out)
    return out


def test_class(test: Column) -> Column:
    """Number of a run's encoding and length class."""
    names = F.array(*(F.lit(e[0]) for e in ENCODINGS))
    return (F.array_position(names, test.encoding).cast("int") - 1) * len(LENGTHS) + length_class(test.n)


def p_bin(p: Column) -> Column:
    """Bin of a p-value on a logarithmic scale, twenty bins a factor of ten; 0 holds the least."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(BINS + 20 * F.log10(F.greatest(p, F.lit(1e-30)))))).cast("int")


def cutoffs(found: DataFrame, share: float = FALSE_DISCOVERIES) -> list[int]:
    """For each encoding and length class, the last bin whose runs are reported, -1 for none.

    ``found`` has the column ``candidates``. Benjamini-Hochberg per class: the
    largest p with ``p * tested / reported <= share``. At most classes x bins
    numbers reach the driver, whatever the corpus.
    """
    each = found.select(F.explode("candidates.test").alias("t")).groupBy(test_class(F.col("t")).alias("c"), p_bin(F.col("t.ordinary_p")).alias("b")).agg(F.count("*").alias("n"))
    rows = {(r.c, r.b): r.n for r in each.collect()}
    out = []
    for c in range(len(ENCODINGS) * len(LENGTHS)):
        tested, so_far, last = sum(n for (k, _), n in rows.items() if k == c), 0, -1
        for b in range(BINS):
            so_far += rows.get((c, b), 0)
            if so_far and 10 ** ((b + 1 - BINS) / 20) * tested / so_far <= share:
                last = b
        out.append(last)
    return out


def scan(docs: DataFrame, text: str = "text", carried: list[str] | None = None, share: float = FALSE_DISCOVERIES) -> DataFrame:
    """Rows (row, base, spans), one for each row of ``docs``.

    ``row`` is a struct of the columns ``carried`` (all, if not given), so none
    can clash with another name. ``base`` and ``spans`` are arrays of (start, end,
    kind) in code points: the base spans, and those with the runs that the
    battery reports, by start, then by kind (0 assign, 1 access, 2 hex, 3
    random). A null text counts as empty; an empty table gives no rows. The
    scanned rows are cut to the shared folder, as the corpus is read once for the
    histogram and once for the result.
    """
    row = F.struct(*(docs[c] for c in (docs.columns if carried is None else carried))).alias("row")
    step = docs.select(row, F.coalesce(docs[text], F.lit("")).alias("whole")).withColumn("found", base_spans(F.col("whole")))
    bare = F.transform("found", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))
    found = cut(step.select("row", bare.alias("base"), candidates(F.col("whole"), F.col("found")).alias("candidates")), "secrets")
    last = F.array(*map(F.lit, cutoffs(found, share)))
    kept = F.filter("candidates", lambda s: p_bin(s.test.ordinary_p) <= F.get(last, test_class(s.test)))
    extra = F.transform(kept, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))
    return found.select("row", "base", F.array_sort(F.concat("base", extra), _by_place).alias("spans"))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def secret_report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the id, a count for each pattern, and the spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == KINDS.index(kind))).cast("long")
    found = scan(docs.select(id, text), text, [id])
    return found.select(
        f"row.{id}",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
    )


MASK = "[SECRET]"


#: Code points of the pieces that a text is cut into to take parts of it out.
PIECE = 4096


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every reported span of the text replaced by a mask; columns as before.

    Overlapping spans get one mask. A null text stays null.
    """
    found = scan(docs, text)

    def masked(x: Column) -> Column:
        """From the text's pieces and the spans, with the end of all spans before each."""
        part = lambda a, b: F.substring(F.array_join(F.slice(x.pieces, F.floor(a / PIECE).cast("int") + 1, (F.floor(b / PIECE) - F.floor(a / PIECE)).cast("int") + 1), ""), F.pmod(a, F.lit(PIECE)) + 1, b - a)
        both = F.zip_with(x.spans, x.ends, lambda s, e: F.struct(s.start.alias("start"), e.alias("e")))
        before = F.transform(F.filter(both, lambda s: s.start >= s.e), lambda s: F.concat(part(s.e, s.start), F.lit(MASK)))
        return F.concat(F.array_join(before, ""), part(F.array_max(F.transform(x.spans, lambda s: s.end)), x.size))

    whole = F.col(f"row.{text}")
    parts = F.struct(
        F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"),
        F.col("spans").alias("spans"),
        running(F.transform("spans", lambda s: s.end), F.greatest).alias("ends"),
        F.length(whole).alias("size"),
    )
    clean = F.when(F.size("spans") > 0, bound(parts, masked)).otherwise(whole)
    return found.select(*((clean if c == text else F.col(f"row.{c}")).alias(c) for c in docs.columns))
