"""HTML extraction: markup where it speaks, a host's suffix array where it does not.

A page is cut into blocks. A class name counts if all its parts are such words. Blocks in menus, headers, footers, sidebars, notices,
adverts, forms, reader comments and the like are dropped; if the page marks its
main part (``article``, ``main`` or a content class), the blocks in it are its
text, whole. Only where a page marks nothing is it left to its host: the token
streams of such blocks of all its pages are sorted by their suffixes, and what
stands under a suffix shared by distinct pages, ``RUN`` tokens or a whole
shorter block, is boilerplate. Covered tokens go, unique runs stay.

The suffixes are sorted to depth ``RUN``, which is all that coverage by repeats
of ``RUN`` or more tokens depends on; so the array needs no concatenated string
of a whole host in one task: it is a shuffle by (host, first tokens).
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

RUN = 8

# Elements and class words by what they say of their content.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template svg iframe object textarea select canvas audio video title"
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
CHROME = set("nav footer aside form button dialog menu fieldset annotation annotation-xml".split())
#: Of these, what may hold a whole page.
WRAPS = {"form", "fieldset"}
CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored sponsors promo promotion promoted nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar sidenav footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter"
    " subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist reply replies"
    " respond disqus widget widgets pagination pager search toolbar masthead skip".split()
)
CHROME_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
MAIN_WORDS = set(
    "article-body article-content article-text post-body post-content post-text entry-content entry-text main-content page-content story-body"
    " content-body articlebody postcontent maincontent".split()
)
CLOSES_P = BLOCK - {"button", "option", "optgroup", "caption", "tbody", "tfoot", "thead", "tr", "legend"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<({'|'.join(RAW.split())})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
#: Attributes one after another: a value cannot be taken for a name, nor a part of a name for the whole.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_READ = {"class", "id", "role", "hidden", "aria-hidden", "itemprop"}
_PARTS = re.compile(r"[-_]+")


def _kind(tag: str, attributes: str, in_main: bool, first: bool) -> str | None:
    """``chrome``, ``words`` (chrome by a class word), ``main`` or None, as an element says of its content.

    ``first``: the page has shown no main part yet; then article and main are one whatever their class words.
    """
    if tag in CHROME or (tag == "header" and not in_main):
        return "words" if tag in WRAPS else "chrome"
    found = None
    if attributes and not attributes.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name not in _READ:
                continue
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return "chrome"
            if name == "role":
                if value in CHROME_ROLES:
                    return "chrome"
                found = "main" if value in ("main", "article") else found
            elif name == "itemprop":
                found = "main" if value == "articlebody" else found
            elif tag not in ("html", "body"):
                words = set(value.split())
                said = any(CHROME_WORDS.issuperset(_PARTS.split(w)) for w in words)
                if (said or ("header" in words and not in_main)) and not (first and tag in ("article", "main")):
                    return "words"
                if set(value.replace("_", "-").split()) & MAIN_WORDS:
                    found = "main"
    return "main" if tag in ("article", "main") else found


def blocks(page: str | None) -> tuple[list[str], list[str]]:
    """(blocks of the marked main part, blocks that nothing marks), in page order.

    Character references are decoded, white space inside a block becomes one
    space, blank blocks are left out. Elements that are never closed end with
    their parents, a paragraph also where the next block starts.
    """
    main: list[str] = []
    other: list[str] = []
    text: list[str] = []
    stack: list[tuple[str, str | None]] = []
    chrome = inside = 0
    first = True

    def flush() -> None:
        if text:
            if not chrome:
                line = " ".join(html.unescape("".join(text)).split())
                if line:
                    (main if inside else other).append(line)
            text.clear()

    def pop_to(n: int) -> None:
        nonlocal chrome, inside
        while len(stack) > n:
            kind = stack.pop()[1]
            chrome -= kind in ("chrome", "words")
            inside -= kind == "main"

    page, at = page or "", 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not chrome:
            text.append(page[at : m.start()])
        at = m.end()
        slash, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            if m[1]:
                text.append(" ")
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        elif tag in ("br", "td", "th"):
            text.append(" ")
        if slash:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, max(-1, len(stack) - 12), -1):
                if stack[k][0] in BLOCK:
                    if stack[k][0] == "p" or (stack[k][0] == tag and tag in ("li", "dt", "dd", "option")):
                        pop_to(k)
                    break
        if tag in VOID or attributes.endswith("/"):
            continue
        kind = _kind(tag, attributes, inside > 0, first)
        if kind == "main" and first and tag in ("article", "main") and all(k != "chrome" for _, k in stack):
            # What holds the page's main part is no chrome, whatever its class words.
            chrome -= sum(k == "words" for _, k in stack)
            stack[:] = [(t, None if k == "words" else k) for t, k in stack]
        first = first and not (kind == "main" and not chrome)
        stack.append((tag, kind))
        chrome += kind in ("chrome", "words")
        inside += kind == "main"
    if at < len(page) and not chrome:
        text.append(page[at:])
    flush()
    return main, other


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Rows (id, url, text, n_chars), one for each row of ``pages``.

    ``text`` is the main text's blocks joined by two line feeds, empty if there
    is none or the html is null. Pages without a host share an empty one. Equal
    pages of a host count as one, so that copies do not remove each other.
    """

    @F.pandas_udf("struct<text:string,open:array<string>>")
    def of(sources: pd.Series) -> pd.DataFrame:
        rows = []
        for s in sources:
            main, other = blocks(s)
            rows.append(("\n\n".join(main) if main else None, None if main else other))
        return pd.DataFrame(rows, columns=["text", "open"])

    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    read = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), of(F.col(source)).alias("p"))
    read = cut(read.select("id", "url", F.monotonically_increasing_id().alias("row"), host.alias("host"), "p.text", "p.open"), "pages")
    marked = read.where("text is not null").select("id", "url", "text")
    left = unique_runs(read.where("text is null").select("id", "url", "row", "host", "open"))
    out = marked.unionByName(left)
    return out.select(F.col("id").alias(id), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))


def unique_runs(pages: DataFrame, run: int = RUN) -> DataFrame:
    """Rows (id, url, text): the blocks ``open`` without what distinct pages of the host repeat.

    Needs the columns id, url, row (unique), host and open (array of blocks).
    """
    block = pages.select("row", "host", F.xxhash64("open").alias("page"), F.posexplode("open").alias("b", "block"))
    words = block.withColumn("words", F.split("block", " "))
    at = F.sequence(F.lit(0), F.greatest(F.size("words") - run, F.lit(0)))
    suffixes = words.select("row", "host", "page", "b", F.explode(F.transform(at, lambda k: F.struct(k.alias("k"), F.xxhash64(F.array_join(F.slice("words", k + 1, F.lit(run)), " "), F.size("words") < run).alias("head")))).alias("s"))
    suffixes = suffixes.select("row", "host", "page", "b", "s.k", "s.head")
    shared = suffixes.groupBy("host", "head").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).where("lo <> hi").select("host", "head")
    covered = suffixes.join(shared, ["host", "head"], "left_semi").groupBy("row", "b").agg(F.collect_set("k").alias("starts"))
    both = words.join(covered, ["row", "b"], "left")
    kept = F.when(F.col("starts").isNull(), F.col("words")).otherwise(
        F.filter("words", lambda w, k: ~F.exists("starts", lambda s: (s <= k) & (k < s + run)))
    )
    lines = both.withColumn("line", F.array_join(kept, " ")).where("line <> ''").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("b", "line"))).alias("lines"))
    return pages.select("row", "id", "url").join(lines, "row", "left").select("id", "url", F.coalesce(F.array_join("lines.line", "\n\n"), F.lit("")).alias("text"))
