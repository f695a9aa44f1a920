"""Chat formatting, Matroska, HTML extraction and fixity."""

import collections
import gzip
import hashlib
import html
import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from docflow.llm import chat, fixity, html_text, matroska
from docflow.session import table

DATA = "/root/testdata/sf0.001"


def test_chat_round_trip(spark):
    rows = [(1, 2, "assistant", "a \\ <s> </s>[INST] \\c \\e <|im_end|> <<SYS>>"), (1, 1, "us\ner", None), (1, None, None, "first"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, 0, "user", "x" * 100_000)]
    rows += [(4, k, "assistant", f"turn {k}") for k in range(200)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"piece": F.lit("z"), "loss": F.lit(0)})
    got = {r.conv_id: r for r in chat.chat_digest(chat.canonical_turns(df)).collect()}
    for c in (1, 2, 3, 4):
        turns = sorted([(-1 if t is None else t, r or "", x or "") for i, t, r, x in rows if i == c])
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.chat_digest(chat.canonical_turns(df.limit(0))).count() == 0


def test_control_strings_do_not_survive(spark):
    text = "</s>[INST] ok [/INST]<s><<SYS>><|x|>"
    out = spark.range(1).select(chat.escape(F.lit(text)).alias("e"), chat.unescape(chat.escape(F.lit(text))).alias("u")).first()
    assert out.u == text and not re.search(chat.ANGLED + "|" + chat.SQUARED, out.e)


def test_layouts(spark):
    j = [
        (1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'),
        (2, '{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":"y"}]}'),
        (3, '{"instruction":"do","input":"","output":"ok"}'),
        (4, "nope"),
        (5, None),
        (6, '{"other":1}'),
    ]
    j += [
        (7, '{"id":"x","messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b","weight":1}]}'),
        (8, '{"messages":[]}'),
        (9, '{"instruction":"do","output":"ok","text":"more","source":{"a":1}}'),
        (10, '{"messages":[{"role":"user"},{"role":"assistant","content":"late"}]}'),
        (11, "[1]"),
    ]
    df = spark.createDataFrame(j, "conv_id bigint, record string")
    kinds = {r.layout: r.n for r in chat.json_layouts(df).groupBy("layout").agg(F.sum("records").alias("n")).collect()}
    assert kinds == {"messages": 4, "share": 1, "instruction": 1, "instruction_only": 1, None: 4}
    got = [(r.conv_id, r.role, r.text) for r in chat.json_turns(df).orderBy("conv_id", "turn").collect()]
    extra = [x for x in got if x[0] > 6]
    assert extra == [(7, "user", "a"), (7, "assistant", "b"), (9, "user", "do"), (9, "assistant", "ok"), (10, "user", ""), (10, "assistant", "late")]
    got = [x for x in got if x[0] <= 6]
    assert got == [(1, "user", "a"), (1, "assistant", "b"), (2, "user", "x"), (2, "assistant", "y"), (3, "user", "do"), (3, "assistant", "ok")]
    assert chat.layout_of(spark.createDataFrame([(1, "p", "c", "extra")], "conv_id int, prompt string, completion string, more string")) == "prompt"
    with pytest.raises(ValueError):
        chat.layout_of(spark.createDataFrame([(1, "p")], "conv_id int, something string"))


@pytest.mark.parametrize("payload", [b"", b"a" * 64, bytes(range(256)) * 16, b"q" * 5000, bytes(range(256)) * 600])
def test_matroska_round_trip(payload):
    media = matroska.mux(payload)
    found = matroska.parse(media)
    assert matroska.stored_bytes(media, found) == payload and found.tracks[1]["codec"] == "A_PCM/INT/LIT"
    assert [p.time for p in found.packets] == sorted(p.time for p in found.packets)
    for _, _, at in found.cues:
        assert int.from_bytes(media[at : at + 4], "big") == matroska.CLUSTER


def block(lacing, body, many=None):
    head = b"\x81" + struct.pack(">h", 3) + bytes([0x80 | lacing << 1]) + (bytes([many - 1]) if many else b"")
    inner = matroska.uint(matroska.CLUSTER_TIME, 10) + matroska.element(matroska.SIMPLE_BLOCK, head + body)
    return HEAD + matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, inner))


def frames(media):
    return [media[p.start : p.end] for p in matroska.parse(media).packets]


def test_lacing():
    a, b, c = b"x" * 300, b"y" * 20, b"z" * 7
    assert frames(block(0, a)) == [a]
    assert frames(block(1, bytes([255, 45, 20]) + a + b + c, 3)) == [a, b, c]
    assert frames(block(2, b * 3, 3)) == [b] * 3
    ebml = (0x4000 | 300).to_bytes(2, "big") + (0x4000 | (20 - 300 + 8191)).to_bytes(2, "big")
    assert frames(block(3, ebml + a + b + c, 3)) == [a, b, c]
    assert [p.time for p in matroska.parse(block(2, b * 3, 3)).packets] == [13] * 3


def test_broken_media(spark):
    good = matroska.mux(b"a" * 64)
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:-60])), (3, None), (4, bytearray(b"\0"))], "doc_id int, media binary")
    assert {r.doc_id for r in matroska.packet_table(df).collect()} == {1}
    long = matroska.mux(bytes(range(256)) * 600)
    whole = matroska.parse(long).packets
    for at in range(200, len(long), 5003):
        found = matroska.parse(long[:at])
        assert found.cut and found.packets == [p for p in whole if p.end <= at][: len(found.packets)]
        assert len(found.packets) >= sum(p.end <= at for p in whole) - matroska.FRAMES


def test_unknown_sizes_and_frame_times():
    unknown = b"\x01" + b"\xff" * 7
    cluster = lambda t, body: matroska.CLUSTER.to_bytes(4, "big") + unknown + matroska.uint(matroska.CLUSTER_TIME, t) + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\0\0\x80" + body)
    track = matroska.element(matroska.TRACK, matroska.uint(matroska.NUMBER, 1) + matroska.uint(matroska.TYPE, 2) + matroska.element(matroska.CODEC, b"X") + matroska.uint(matroska.FRAME_TIME, 20_000_000))
    laced = matroska.element(matroska.CLUSTER, matroska.uint(matroska.CLUSTER_TIME, 30) + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\0\0\x84\x02" + b"abc"))
    media = HEAD + matroska.SEGMENT.to_bytes(4, "big") + unknown + matroska.element(matroska.TRACKS, track) + cluster(10, b"one") + cluster(20, b"two") + laced
    found = matroska.parse(media)
    assert [media[p.start : p.end] for p in found.packets] == [b"one", b"two", b"a", b"b", b"c"]
    assert [p.time for p in found.packets] == [10, 20, 30, 50, 70] and not found.cut


HEAD = matroska.element(matroska.EBML, matroska.uint(0x4286, 1))


def test_media_digest(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "é" * 40, 0), (3, "é" * 40, 0)], "doc_id bigint, text string, m int")
    got = media = matroska.media_digest(df).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.payload_bytes) for r in got] == [(0, 64), (0, 64), (80, 128), (80, 128)]
    assert got[3].payload_sha256 == hashlib.sha256("é".encode() * 40 + bytes(48)).hexdigest() and got[2] == got[3] and media[0].feature == media[1].feature
    assert matroska.media_digest(df.limit(0)).count() == 0


def plain_digest(text):
    """All seven values of a row, from the text and from a reader that knows no more than the format."""
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    media = matroska.mux(payload)

    def walk(at, end):
        while at < end:
            n = 9 - media[at].bit_length()
            id, at = int.from_bytes(media[at : at + n], "big"), at + n
            n = 9 - media[at].bit_length()
            size, at = int.from_bytes(media[at : at + n], "big") & ((1 << 7 * n) - 1), at + n
            yield id, at, at + size
            at += size

    back, packets, cues = b"", 0, 0
    for id, a, b in walk(0, len(media)):
        for kind, c, d in walk(a, b) if id == matroska.SEGMENT else ():
            cues += sum(1 for _ in walk(c, d)) if kind == matroska.CUES else 0
            for k, x, y in walk(c, d) if kind == matroska.CLUSTER else ():
                if k == matroska.SIMPLE_BLOCK:
                    laced = media[x + 3] & 4
                    packets += media[x + 4] + 1 if laced else 1
                    back += media[x + (5 if laced else 4) : y]
    assert back == payload
    mean, energy = sum(payload) * 1000 // len(payload), sum(v * v for v in payload) // len(payload)
    crossings = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))
    bins = ".".join(str(sum(v >> 4 == k for v in payload)) for k in range(16))
    said = f"p{packets};c{cues};m{mean};e{energy};z{crossings};h{bins}"
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), said


def test_media_digest_equals_plain_reading(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "word " * 9000, "né" * 30_000] + [r.text for r in table(spark, DATA, "documents").limit(40).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in matroska.media_digest(df).collect():
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == plain_digest(texts[r.doc_id])


def test_articles_of_the_table(spark):
    got = {r.page_id: r.text for r in html_text.extract(table(spark, DATA, "pages")).collect()}
    for p in table(spark, DATA, "pages").collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[p.page_id] == "\n\n".join(x for x in parts if x)


def test_ordinary_markup_keeps_the_article():
    text = "<p>The article.</p>"
    for page in (
        f'<main class="with-sidebar">{text}</main>',
        f'<article class="post no-sidebar">{text}</article>',
        f'<article class="post sponsored">{text}</article>',
        f'<div class="content-sidebar-wrap"><article>{text}</article></div>',
        f'<div class="layout has-sidebar"><article>{text}</article></div>',
        f'<article style="overflow:hidden">{text}</article>',
        f'<article data-role="banner" title="class=ad">{text}</article>',
        f'<form id="page" action="/x"><article>{text}<form>Subscribe</form></article></form>',
        f'<div class="widget"><main>{text}</main></div><div class="related"><article>Other</article></div>',
        f"<html><head><title>T</title><meta charset=utf-8><style>p{{}}</style><body><article>{text}</article>",
        f"<head><title>T</title><article>{text}<section class=comments><article>Reply</article></section></article>",
    ):
        assert html_text.blocks(page)[0] == ["The article."], page
    assert html_text.blocks(f'<article>{text}<div class="cookie-notice">We use</div><div class="ad_banner">Buy</div></article>')[0] == ["The article."]
    assert html_text.blocks(f'<article>{text}<section id="alert-systems"><p>Two</p></section><section id="comments"><p>Reader</p></section></article>')[0] == ["The article.", "Two"]
    formula = "<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p></article>"
    assert html_text.blocks(formula)[0] == ["so x=2 holds"]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a>Logo</a></header><nav>Menu</nav>
<div class="cookie-notice">We use cookies</div><main><article><header><h1>The &lt;title&gt;</h1></header><p>One
 <b>bold</b> &amp; two<p>Three<script>bad("</p>")</script><ul><li>a<li>b</ul><aside>Aside</aside><form>Form</form>
<table><tr><td>x</td><td>y</td></tr></table></article><section id="comments"><article>A reader's comment</article></section></main>
<div role="complementary">Side</div><footer>Foot</footer></body>"""


def test_regions():
    assert html_text.blocks(PAGE)[0] == ["The <title>", "One bold & two", "Three", "a", "b", "x y"]
    assert html_text.blocks(None) == ([], []) and html_text.blocks("plain &copy; text") == ([], ["plain © text"])
    assert html_text.blocks("<p>a<br>b<p class='ad'>c<div>d")[1] == ["a b", "d"]
    html_text.blocks("<div " * 5000 + '"' * 5000)


def test_unmarked_pages_lose_what_their_host_repeats(spark):
    shared = "shared line of many words that every page of this host has"
    rows = [(k, f"http://H.example/{k}", f"<div>{shared}</div><div>own words number {k} here</div><div>Home</div>") for k in range(4)]
    rows += [(9, None, None), (10, "http://other", f"<div>{shared}</div>"), (0, "http://H.example/0", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit("t"), "host": F.lit(1)})
    got = sorted((r.page_id, r.text) for r in html_text.extract(df).collect())
    assert got == sorted([(k, f"own words number {k} here") for k in range(4)] + [(9, ""), (10, shared), (0, "own words number 0 here")])
    assert html_text.extract(df.limit(0)).count() == 0


def test_unmarked_articles_lose_the_headings_and_quotations_they_share(spark):
    """What the README states of pages that mark no main part."""
    quote = "one two three four five six seven eight nine ten"
    rows = [(k, "http://h/", f"<h1>Introduction</h1><p>text of page {k} says {quote} and ends as page {k}</p>") for k in range(2)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all("Introduction" not in v and "three" not in v and f"text of page {k}" in v for k, v in got.items())


def brute_runs(pages, run=8):
    """Blocks without the tokens under a substring of ``run`` tokens, or a whole shorter block, of another page of the host."""
    seen = {}
    for k, (host, blocks) in enumerate(pages):
        for b in blocks:
            w = b.split(" ")
            for s in range(max(1, len(w) - run + 1)):
                seen.setdefault((host, tuple(w[s : s + run]), len(w) < run), set()).add(tuple(blocks))
    out = []
    for host, blocks in pages:
        kept = []
        for b in blocks:
            w = b.split(" ")
            covered = {s + d for s in range(max(1, len(w) - run + 1)) if len(seen[host, tuple(w[s : s + run]), len(w) < run]) > 1 for d in range(run)}
            line = " ".join(x for k, x in enumerate(w) if k not in covered)
            kept += [line] if line else []
        out.append("\n\n".join(kept))
    return out


def test_runs_of_a_host_equal_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(f"t{rng.randrange(30)}" for _ in range(rng.randrange(1, 25))) for _ in range(25)]
    pages = []
    for k in range(60):
        blocks = [rng.choice(pool) if rng.random() < 0.5 else " ".join(f"u{rng.randrange(200)}" for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(8))]
        if blocks and rng.random() < 0.5:
            blocks[0] += " " + " ".join(rng.choice(pool).split()[:12])
        pages.append((f"h{k % 3}", blocks))
    df = spark.createDataFrame([(k, f"http://{h}/{k}", k, h, b) for k, (h, b) in enumerate(pages)], "id bigint, url string, row bigint, host string, open array<string>")
    got = {r.id: r.text for r in html_text.unique_runs(df).collect()}
    assert [got[k] for k in range(60)] == brute_runs(pages)


def test_fixity(spark):
    pages = table(spark, DATA, "pages")
    got = {(r.key, r.problem) for r in fixity.fixity_report(pages).collect()}
    ids = [r.page_id for r in pages.select("page_id").collect()]
    assert got == {(i, "missing") for i in ids if i % 193 == 7} | {(i, "changed") for i in ids if i % 97 == 13 and i % 193 != 7}
    odd = spark.createDataFrame([(None, None, None), (None, "n", "n"), (1, "u", "x"), (1, "u", "x"), (1, "u", "y"), (5000, "v", "z"), (1 << 60, "w", "z")], "page_id bigint, url string, html string").withColumn("hash", F.lit(1))
    a = fixity.records(odd)
    assert fixity.audit(a, a).count() == 0
    b = fixity.records(odd.where("page_id is null or page_id < 5000 or page_id > 6000").union(odd.where("html = 'y'")).where("html <> 'x' or html is null"))
    assert sorted((r.key, r.problem) for r in fixity.audit(a, b).collect()) == [(1, "changed"), (1, "missing"), (5000, "missing")]
    lost = fixity.audit(a, fixity.records(odd.where("url <> 'n' or url is null"))).collect()
    assert [(r.key, r.problem) for r in lost] == [(None, "missing")]
    assert fixity.audit(a.limit(0), a.limit(0)).count() == 0


def test_fixity_equals_a_comparison_of_all_records(spark):
    """Random replicas with hot keys and repeated records, against multisets of records."""
    rng = random.Random(13)
    rows = [(rng.choice([1, 2, 3, 70, 1500, None]), f"u{rng.randrange(3)}", f"p{rng.randrange(6)}") for _ in range(400)]
    other = [r for r in rows if rng.random() < 0.9] + [(rng.choice([1, 4000]), "new", f"q{k}") for k in range(10)]
    kind = "page_id bigint, url string, html string"
    a, b = (fixity.records(spark.createDataFrame(r, kind)) for r in (rows, other))
    got = collections.Counter((r.key, r.problem) for r in fixity.audit(a, b).collect())
    lost, new = collections.Counter(rows) - collections.Counter(other), collections.Counter(other) - collections.Counter(rows)
    want = collections.Counter()
    for key in {r[0] for r in [*lost, *new]}:
        n, m = (sum(v for r, v in c.items() if r[0] == key) for c in (lost, new))
        pairs = min(n, m) if key is not None else 0
        want.update({(key, "changed"): pairs, (key, "missing"): n - pairs, (key, "extra"): m - pairs})
    assert got == +want
    offsets = sorted((r.archive, r.offset, r.length) for r in a.collect())
    for x, y in zip(offsets, offsets[1:]):
        assert y[1] == (x[1] + x[2] if x[0] == y[0] else 0)


def test_only_damaged_branches_are_descended(spark):
    a = fixity.records(table(spark, DATA, "pages"))
    assert fixity.differing(fixity.tree(a), fixity.tree(a)).count() == 0
    top = fixity.tree(a)[fixity.DEPTH]
    assert top.select("node").distinct().count() == 1 and top.select("archive").distinct().count() == top.count()


def test_warc_files(spark):
    def record(k, block):
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:r:{k}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    parts = [record(k, f"body {k} \r\n\r\n WARC/1.0".encode() * k) for k in range(5)]
    plain, packed = b"".join(parts), b"".join(map(gzip.compress, parts))
    damaged = b"".join(parts[:2] + [parts[2].replace(b"body", b"bodz")] + parts[4:])
    files = spark.createDataFrame([("a", bytearray(plain)), ("g", bytearray(packed)), ("cut", bytearray(plain[:-30])), ("bad", bytearray(b"nothing")), ("none", None)], "path string, content binary")
    got = {}
    for r in fixity.warc_table(files).collect():
        got.setdefault(r.path, []).append(r)
    at = [sum(map(len, parts[:k])) for k in range(6)]
    assert [(r.offset, r.length, r.record_id, r.readable) for r in got["a"]] == [(at[k], len(parts[k]), f"<urn:r:{k}>", True) for k in range(5)]
    assert [r.hash for r in got["g"]] == [r.hash for r in got["a"]] and got["g"][0].length == len(gzip.compress(parts[0]))
    assert [r.readable for r in got["cut"]] == [True] * 4 + [False] and [r.readable for r in got["bad"]] == [False] and "none" not in got
    replica = lambda data: fixity.warc_records(spark.createDataFrame([("a", bytearray(data))], "path string, content binary"))
    assert sorted((r.problem, r.offset, r.length) for r in fixity.audit(replica(plain), replica(damaged)).collect()) == [("changed", at[2], len(parts[2])), ("missing", at[3], len(parts[3]))]
