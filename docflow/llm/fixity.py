"""WARC fixity: Merkle trees over records, and a descent to what differs.

Records of an archive are leaves in the order of their keys. A leaf hashes its
records' hashes; each parent hashes ``FAN`` neighbours' hashes with their places
and their byte ranges within the parent's, up to one root per archive. Ranges
are counted from the parent's first byte, so that a record of another length
changes its ancestors and not all that lies behind it. The levels are built once
per replica, each from the one below. Two replicas are compared root by root;
only the children of nodes that differ are read and compared, level by level,
down to the damaged records and their byte ranges.

A leaf's place is its key within the archive, so a lost record does not shift
the others. An archive holds ``SLOTS`` keys. A key that very many records share
is one leaf whose records are hashed in 256 parts by their hashes, equal ones
counted instead of listed, so no task gathers them; records without a key are
spread over archives of their own by their content.

:func:`warc_table` reads WARC files, plain or with a gzip member per record.
"""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, drop_cut

FAN, DEPTH = 16, 3
SLOTS = 1024  # keys of an archive; at most FAN ** DEPTH


def warc_record(id: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.0 response record: header lines, payload, two line ends."""
    size = F.octet_length(payload).cast("string")
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nWARC-Record-ID: <urn:record:"),
        id.cast("string"),
        F.lit(">\r\nContent-Length: "),
        size,
        F.lit("\r\n\r\n"),
        payload,
        F.lit("\r\n\r\n"),
    )


RECORDS = "path string, offset bigint, length bigint, record_id string, type string, date string, uri string, hash string, readable boolean"


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """The gzip member at a place, unpacked, and the place after it."""
    unpack = zlib.decompressobj(31)
    out = [unpack.decompress(data[at:])]
    out.append(unpack.flush())
    if not unpack.eof:
        raise ValueError("member cut off")
    return b"".join(out), len(data) - len(unpack.unused_data)


def _record(data: bytes, at: int) -> tuple[dict[str, str], int, int]:
    """(header fields in lower case, start of the block, end of the record) of the record at a place."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or bytes(data[at : at + 5]) != b"WARC/":
        raise ValueError("no record")
    lines = bytes(data[at:end]).decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    stop = end + 4 + int(fields["content-length"])
    if int(fields["content-length"]) < 0 or data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record cut off")
    return fields, end + 4, stop + 4


def read_warc(data: bytes):
    """(offset, length, header fields, bytes of the record) of each record, plain or packed.

    What cannot be read ends the file: its offset and length come with None, b"".
    """
    at, view = 0, memoryview(data)
    while at < len(data):
        try:
            if data[at : at + 2] == b"\x1f\x8b":
                whole, stop = _member(view, at)
                fields, _, _ = _record(whole, 0)
            else:
                fields, _, stop = _record(data, at)
                whole = data[at:stop]
        except (ValueError, KeyError, zlib.error):
            yield at, len(data) - at, None, b""
            return
        yield at, stop - at, fields, whole
        at = stop


def warc_table(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A row for each record of WARC files, given as (path, bytes), as Spark's ``binaryFile`` source has them.

    ``offset`` and ``length`` are those in the file, ``hash`` is of the unpacked
    record. An unreadable rest is one row that is not ``readable``. A null
    content has no rows, an empty one none either.
    """

    def read(batches):
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                rows = []
                for at, n, fields, whole in read_warc(bytes(data)) if data is not None else ():
                    get = (fields or {}).get
                    rows.append((name, at, n, get("warc-record-id"), get("warc-type"), get("warc-date"), get("warc-target-uri"), hashlib.sha256(whole).hexdigest(), fields is not None))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(read, RECORDS)


def warc_records(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Records of WARC files as :func:`audit` takes them: an archive per path, keys and places by record id."""
    key = F.xxhash64(F.coalesce("record_id", F.lit("")))
    return warc_table(files, path, content).select(F.xxhash64("path").alias("archive"), F.pmod(key, F.lit(SLOTS)).cast("int").alias("slot"), key.alias("key"), "length", "hash", "offset")


def records(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Rows (archive, slot, key, length, hash, offset), a row for each record.

    Records lie in an archive by place, then hash; offsets follow from their
    lengths, by parts of the hash first, so that a key of very many records is
    not ordered in one task. Null urls and payloads count as empty. Records
    without a key have negative archives. An empty table gives no rows.
    """
    key = F.col(id).cast("bigint")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    made = pages.select(key.alias("key"), warc_record(F.coalesce(key, F.lit(-1)), text(url), text(payload)).alias("record"))
    spread = F.shiftright(F.xxhash64("record"), 1).bitwiseAND(F.lit((1 << 42) - 1))
    made = made.select(
        F.when(F.col("key").isNull(), -1 - F.shiftright(spread, 10)).otherwise(F.shiftright("key", 10)).cast("bigint").alias("archive"),
        F.coalesce("key", spread).bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot"),
        "key",
        F.octet_length("record").cast("bigint").alias("length"),
        F.sha2(F.col("record").cast("binary"), 256).alias("hash"),
    )
    made = made.withColumn("_part", F.substring("hash", 1, 2))
    sums = made.groupBy("archive", "slot", "_part").agg(F.sum("length").alias("_sum"))
    before = Window.partitionBy("archive").orderBy("slot", "_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select("archive", "slot", "_part", (F.sum("_sum").over(before) - F.col("_sum")).alias("_first"))
    inner = Window.partitionBy("archive", "slot", "_part").orderBy("hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = made.withColumn("_own", F.sum("length").over(inner) - F.col("length")).join(sums, ["archive", "slot", "_part"])
    return placed.select("archive", "slot", "key", "length", "hash", (F.col("_first") + F.col("_own")).alias("offset"))


def _hashed(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), ",").cast("binary"), 256)


def tree(made: DataFrame) -> list[DataFrame]:
    """Nodes (archive, node, hash, first, end) by level: 0 has one node per slot, ``DEPTH`` the roots; each written once."""
    counted = made.groupBy("archive", "slot", "hash").agg(F.count("*").alias("n"), F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("end"))
    part = F.substring("hash", 1, 2).alias("part")
    parts = counted.groupBy("archive", "slot", part).agg(_hashed(F.concat_ws(":", "hash", F.col("n").cast("string"))).alias("hash"), F.min("first").alias("first"), F.max("end").alias("end"))
    nodes = parts.groupBy("archive", F.col("slot").alias("node")).agg(_hashed(F.concat_ws(":", "part", "hash")).alias("hash"), F.min("first").alias("first"), F.max("end").alias("end"))
    levels = [cut(nodes, "level0")]
    for level in range(1, DEPTH + 1):
        below = levels[-1].withColumn("up", F.shiftright("node", 4))
        # A child's range counts from its parent's first byte, which only the group knows.
        child = F.struct("node", "hash", "first", "end")
        up = below.groupBy("archive", "up").agg(F.array_sort(F.collect_list(child)).alias("c"), F.min("first").alias("first"), F.max("end").alias("end"))
        said = F.transform("c", lambda c: F.concat_ws(":", c.node.cast("string"), (c.first - F.col("first")).cast("string"), (c.end - F.col("first")).cast("string"), c.hash))
        nodes = up.select("archive", F.col("up").alias("node"), F.sha2(F.array_join(said, ",").cast("binary"), 256).alias("hash"), "first", "end")
        levels.append(cut(nodes, f"level{level}"))
    return levels


def differing(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(archive, node) of the leaves that differ, found from the roots down: only children of what differs are compared."""
    found = None
    for level in range(DEPTH, -1, -1):
        x, y = (t[level].select("archive", "node", "hash") for t in (a, b))
        if found is not None:
            under = found.withColumnRenamed("node", "up")
            x, y = (t.withColumn("up", F.shiftright("node", 4)).join(under, ["archive", "up"], "left_semi") for t in (x, y))
        both = x.withColumnRenamed("hash", "ha").join(y.withColumnRenamed("hash", "hb"), ["archive", "node"], "full_outer")
        last, found = found, cut(both.where(~F.col("ha").eqNullSafe(F.col("hb"))).select("archive", "node"), "differing")
        if last is not None:
            drop_cut(last)
    return found


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Damaged records of replica ``b`` against ``a``, both as :func:`records` or :func:`warc_records` gives them.

    Rows (archive, key, problem, offset, length): ``problem`` is changed, missing
    or extra; the byte range is that in ``a``, or in ``b`` for extra records.
    Records are compared as multisets of hashes; a lost and a new record of one
    key are one that changed. A record without a key is missing or extra. Equal
    replicas give no rows.
    """
    a, b = cut(a, "replica"), cut(b, "replica")
    levels = tree(a), tree(b)
    nodes = differing(*levels)
    for level in (*levels[0], *levels[1]):
        drop_cut(level)
    under = nodes.withColumnRenamed("node", "slot")
    same = ["archive", "slot", "key", "hash"]

    def counted(t: DataFrame, n: str) -> DataFrame:
        part = t.join(under, ["archive", "slot"], "left_semi")
        return part.groupBy(*same).agg(F.count("*").alias(n), F.min("offset").alias(f"{n}_at"), F.first("length").alias(f"{n}_length"))

    x, y = counted(a, "x"), counted(b, "y").withColumnsRenamed({c: f"y_{c}" for c in same})
    match = [x[c].eqNullSafe(y[f"y_{c}"]) for c in same]
    both = x.join(y, (x.archive == y.y_archive) & (x.slot == y.y_slot) & (x.hash == y.y_hash) & match[2], "full_outer")
    both = both.select(*(F.coalesce(c, f"y_{c}").alias(c) for c in same), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("x", "y")), "x_at", "x_length", "y_at", "y_length")
    many = F.abs(F.col("x") - F.col("y")).cast("int")
    side = F.when(F.col("x") > F.col("y"), "l").otherwise("r")
    # Equal records lie side by side; the last of them are taken as the ones without a partner.
    first = F.when(side == "l", F.col("x_at") + F.col("y") * F.col("x_length")).otherwise(F.col("y_at") + F.col("x") * F.col("y_length"))
    length = F.when(side == "l", F.col("x_length")).otherwise(F.col("y_length"))
    apart = both.where("x <> y").select("archive", "key", side.alias("side"), first.alias("first"), length.alias("length"), F.explode(F.sequence(F.lit(0), many - 1)).alias("k"))
    apart = apart.select("archive", "key", "side", (F.col("first") + F.col("k") * F.col("length")).alias("offset"), "length")
    rank = F.row_number().over(Window.partitionBy("archive", "key", "side").orderBy("offset"))
    apart = cut(apart.withColumn("m", rank), "apart")
    lost, new = (apart.where(F.col("side") == s).drop("side").alias(s) for s in ("l", "r"))
    pairs = lost.join(new, (F.col("l.key") == F.col("r.key")) & (F.col("l.archive") == F.col("r.archive")) & (F.col("l.m") == F.col("r.m")), "full_outer")
    problem = F.when(F.col("l.m").isNull(), "extra").when(F.col("r.m").isNull(), "missing").otherwise("changed")
    pick = lambda c: F.when(F.col("l.m").isNotNull(), F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")).alias(c)
    return pairs.select(pick("archive"), pick("key"), problem.alias("problem"), pick("offset"), pick("length"))


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica with known damage: one page in 97 has a byte too many, one in 193 is lost."""
    kept = pages.where(F.coalesce(F.pmod("page_id", F.lit(193)) != 7, F.lit(True)))
    return kept.withColumn("html", F.when(F.pmod("page_id", F.lit(97)) == 13, F.concat(F.coalesce("html", F.lit("")), F.lit("x"))).otherwise(F.col("html")))


def fixity_report(pages: DataFrame) -> DataFrame:
    """Audit of the damaged copy of ``pages`` against ``pages``."""
    return audit(records(pages), records(damaged_copy(pages)))


#: Both replicas as tables of records, compared record by record. Without a key, and for repeated keys, only counts are comparable in SQL.
ORACLE_SQL = """
WITH replica AS (
  SELECT page_id, url, html FROM pages WHERE coalesce(page_id % 193 <> 7, true)
), damaged AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 13 THEN coalesce(html, '') || 'x' ELSE html END AS html FROM replica
), a AS (
  SELECT page_id AS key, sha256('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || coalesce(html, '')) AS hash,
    (octet_length(encode(coalesce(html, ''))) + octet_length(encode(coalesce(url, ''))) + length(page_id::VARCHAR)
     + length(octet_length(encode(coalesce(html, '')))::VARCHAR) + 105)::BIGINT AS length FROM pages
), b AS (
  SELECT page_id AS key, sha256('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || coalesce(html, '')) AS hash FROM damaged
), placed AS (
  SELECT *, (sum(length) OVER (PARTITION BY key // 1024 ORDER BY key ROWS UNBOUNDED PRECEDING) - length)::BIGINT AS "offset" FROM a
)
SELECT (placed.key // 1024)::BIGINT AS archive, placed.key, CASE WHEN b.key IS NULL THEN 'missing' ELSE 'changed' END AS problem, "offset", length
FROM placed LEFT JOIN b ON placed.key = b.key WHERE b.key IS NULL OR placed.hash <> b.hash
"""
