"""Media columns: Matroska files, from EBML elements to packet tables.

:func:`parse` walks the elements of a file (variable-length ids and sizes),
reads its tracks, clusters, simple blocks and block groups with all four kinds
of lacing, and the cues, and gives one packet per frame: track, timestamp, the
frame's byte range in the file, and whether it is a key frame. :func:`mux`
writes a file of one PCM track from bytes, with laced blocks and cues; reading
the packets' ranges one after another gives the bytes back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the format.
EBML, SEGMENT, INFO, SCALE, TRACKS, TRACK, CLUSTER, CLUSTER_TIME = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0x1F43B675, 0xE7
SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, CUES, CUE_POINT = 0xA3, 0xA0, 0xA1, 0x1C53BB6B, 0xBB
NUMBER, UID, TYPE, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
FRAME_TIME, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x23E383, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that end an element of unknown size before them, by the element that they lie in.
TOP = {SEGMENT, EBML}
IN_SEGMENT = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}

UNIT, FRAME, FRAMES, BLOCKS = 64, 4096, 8, 8
PER_SECOND = 8000


def element(id: int, body: bytes) -> bytes:
    """An element: its id, its size as the shortest variable-length number, its body."""
    return id.to_bytes((id.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def vint(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:  # all ones mean an unknown size
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def uint(id: int, n: int) -> bytes:
    return element(id, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def read_vint(data, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(number, next place); None for an unknown size."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length number at {at}")
    width = 9 - first.bit_length()
    n = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


@dataclass
class Packet:
    track: int
    time: int
    start: int
    end: int
    key: bool


@dataclass
class Media:
    """What a file holds; ``cut`` tells that it ends or breaks off before its elements do."""

    scale: int = 1_000_000
    cut: bool = False
    tracks: dict = field(default_factory=dict)
    packets: list = field(default_factory=list)
    cues: list = field(default_factory=list)


def elements(data, at: int, end: int, enders=frozenset(), found: Media | None = None):
    """(id, body start, body end) of the elements side by side in a range.

    An element of unknown size, as live streams have them, ends before the first
    element of ``enders`` in it. With ``found``, an element that runs over the
    end is given as far as it goes and noted there; without, it is an error.
    """
    while at < end:
        try:
            id, body = read_vint(data, at, keep_marker=True)
            size, body = read_vint(data, body)
            if body > end:
                raise ValueError(f"element at {at} runs over its parent's end")
        except (ValueError, IndexError):
            if found is None:
                raise
            found.cut = True
            return
        if size is None:
            stop = _unknown_end(data, body, end, enders)
        else:
            stop = body + size
            if stop > end:
                if found is None:
                    raise ValueError(f"element {id:x} runs over its parent's end")
                found.cut, stop = True, end
        yield id, body, stop
        at = stop


def _unknown_end(data, at: int, end: int, enders) -> int:
    """Where an element of unknown size ends: before the first of ``enders`` that follows in it."""
    while at < end:
        try:
            id, body = read_vint(data, at, keep_marker=True)
            if id in enders:
                return at
            size, body = read_vint(data, body)
        except (ValueError, IndexError):
            return end
        if size is None:
            return end
        at = body + size
    return end


def parse(data: bytes) -> Media:
    """Tracks, packets and cues of a Matroska file.

    A file that is cut off gives the packets whose frames are whole before the
    cut, and ``cut``. ValueError if the first element is no EBML head or a block
    in a whole cluster is malformed.
    """
    out, view = Media(), memoryview(data)
    number = lambda a, b: int.from_bytes(view[a:b], "big")
    if len(view) < 4 or number(0, 4) != EBML:
        raise ValueError("no EBML head")
    for id, a, b in elements(view, 0, len(view), TOP, out):
        if id != SEGMENT:
            continue
        for kind, c, d in elements(view, a, b, IN_SEGMENT | TOP, out):
            before, broken = out.cut, None
            try:
                if kind == INFO:
                    out.scale = next((number(x, y) for k, x, y in elements(view, c, d) if k == SCALE), out.scale)
                elif kind == TRACKS:
                    for k, x, y in elements(view, c, d):
                        if k == TRACK:
                            fields = {q: (r, s) for q, r, s in elements(view, x, y)}
                            out.tracks[number(*fields[NUMBER])] = {
                                "type": number(*fields[TYPE]),
                                "codec": bytes(view[slice(*fields[CODEC])]).decode(),
                                "frame_time": number(*fields[FRAME_TIME]) if FRAME_TIME in fields else 0,
                            }
                elif kind == CLUSTER:
                    _cluster(view, c, d, out, number)
                elif kind == CUES:
                    for k, x, y in elements(view, c, d):
                        fields = {q: (r, s) for q, r, s in elements(view, x, y)}
                        inner = {q: number(r, s) for q, r, s in elements(view, *fields[CUE_PLACES])}
                        out.cues.append((number(*fields[CUE_TIME]), inner[CUE_TRACK], inner[CUE_CLUSTER] + a))
            except (ValueError, IndexError, KeyError, struct.error) as e:
                broken = e
            if broken is not None and not (before or d == len(view)):
                raise ValueError(str(broken)) from broken
            out.cut = out.cut or broken is not None
    return out


def _cluster(view, at: int, end: int, out: Media, number) -> None:
    base = 0
    for kind, a, b in elements(view, at, end, IN_SEGMENT | TOP, out):
        if kind == CLUSTER_TIME:
            base = number(a, b)
        elif kind == SIMPLE_BLOCK:
            _block(view, a, b, base, out, None)
        elif kind == BLOCK_GROUP:
            for k, x, y in elements(view, a, b, frozenset(), out):
                if k == BLOCK:
                    _block(view, x, y, base, out, False)


def _block(view, at: int, end: int, base: int, out: Media, key: bool | None) -> None:
    """A block's frames: none laced, or laced by Xiph (1), equal size (2) or EBML (3) sizes.

    The first has the block's time, each further one is later by the track's
    default duration of a frame, if it states one. Of a block that is cut off, an
    unlaced frame is left out; sizes of a lace that do not fit are an error.
    """
    short = out.cut and end == len(view)
    track, at = read_vint(view, at)
    time = base + struct.unpack(">h", view[at : at + 2])[0]
    flags, at = view[at + 2], at + 3
    lacing = flags >> 1 & 3
    sizes = []
    if lacing:
        many, at = view[at] + 1, at + 1
        if lacing == 1:
            for _ in range(many - 1):
                n = 0
                while view[at] == 255:
                    n, at = n + 255, at + 1
                sizes.append(n + view[at])
                at += 1
        elif lacing == 3 and many > 1:
            n, at = read_vint(view, at)
            sizes.append(n)
            for _ in range(many - 2):
                before = at
                step, at = read_vint(view, at)
                step = (1 << 7 * (at - before)) - 1 if step is None else step
                sizes.append(sizes[-1] + step - ((1 << 7 * (at - before) - 1) - 1))
        if lacing == 2:
            sizes = [(end - at) // many] * many
        else:
            sizes.append(end - at - sum(sizes))
    else:
        sizes = [end - at]
    if short:
        # The last frame, or each of equal size, has an unknown part missing.
        sizes = sizes[:-1] if lacing in (1, 3) else []
    step = out.tracks.get(track, {}).get("frame_time", 0) / out.scale
    for k, n in enumerate(sizes):
        if n < 0 or at + n > end:
            raise ValueError("frames run over their block's end")
        out.packets.append(Packet(track, time + round(k * step), at, at + n, bool(flags & 0x80) if key is None else key))
        at += n


def mux(payload: bytes, frame: int = FRAME) -> bytes:
    """A Matroska file with one 8-bit PCM track whose frames hold ``payload``.

    Full frames are laced by equal size, the last, shorter frame has a block of
    its own. Times are in samples of 1/8000 s; a cluster has at most eight blocks.
    """
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    info = element(INFO, uint(SCALE, 1_000_000_000 // PER_SECOND) + element(0x4D80, b"docflow") + element(0x5741, b"docflow"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", PER_SECOND)) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, uint(NUMBER, 1) + uint(UID, 1) + uint(TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues, at = info + tracks, [], 0
    parts = [body]
    size = len(body)
    per_cluster = frame * FRAMES * BLOCKS
    # A block's time is a signed 16-bit number of samples after its cluster's.
    per_cluster = min(per_cluster, 32_000 // frame * frame if frame <= 32_000 else frame)
    while at < len(payload) or at == 0:
        part = payload[at : at + per_cluster]
        inner = [uint(CLUSTER_TIME, at)]
        for k in range(0, max(1, len(part)), frame * FRAMES):
            piece = part[k : k + frame * FRAMES]
            full = len(piece) // frame * frame
            if full:
                lace = b"\x84" + bytes([full // frame - 1]) if full > frame else b"\x80"
                inner.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", k) + lace + piece[:full]))
            if len(piece) > full or not piece:
                inner.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", k + full) + b"\x80" + piece[full:]))
        cues.append(element(CUE_POINT, uint(CUE_TIME, at) + element(CUE_PLACES, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, size))))
        parts.append(element(CLUSTER, b"".join(inner)))
        size += len(parts[-1])
        at += per_cluster
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes with bytes 0 up to a positive multiple of 64, bytes before that)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT)), len(data)


def stored_bytes(media: bytes, found: Media) -> bytes:
    """The frames of track 1, in order."""
    return b"".join(media[p.start : p.end] for p in found.packets if p.track == 1)


def feature(samples: bytes, found: Media) -> str:
    """Whole-number features of 8-bit samples: packets, clusters, mean, energy, zero crossings and a 16-bin histogram."""
    x = np.frombuffer(samples, dtype=np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    squares = int((x.astype(np.int64) ** 2).sum())
    return f"p{len(found.packets)};c{len(found.cues)};m{int(x.sum(dtype=np.int64)) * 1000 // len(x)};e{squares // len(x)};z{crossings};h" + ".".join(map(str, bins.tolist()))


def media_columns(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, n_bytes, media): each whole text as a Matroska file; a null text as an empty one."""

    @F.pandas_udf("struct<n_bytes:bigint,media:binary>")
    def of(texts: pd.Series) -> pd.DataFrame:
        made = [(n, mux(p)) for p, n in map(payload_of, texts)]
        return pd.DataFrame(made, columns=["n_bytes", "media"])

    return docs.select(F.col(id), of(F.col(text)).alias("m")).select(id, "m.n_bytes", "m.media")


PACKETS = "array<struct<track:int,time:bigint,start:bigint,end:bigint,key:boolean>>"


def packet_table(media: DataFrame, id: str = "doc_id", column: str = "media") -> DataFrame:
    """Rows (id, number, track, time, start, end, key), one for each frame of each file.

    A null file gives no rows, a malformed one none either, and one that is cut
    off those of its whole frames before the cut. Ids may repeat or be null.
    """

    @F.pandas_udf(PACKETS)
    def of(files: pd.Series) -> pd.Series:
        def packets(data):
            try:
                return [(p.track, p.time, p.start, p.end, p.key) for p in parse(bytes(data)).packets] if data is not None else []
            except (ValueError, IndexError, KeyError, struct.error):
                return []

        return pd.Series([packets(f) for f in files])

    return media.select(id, F.posexplode(of(F.col(column))).alias("number", "p")).select(id, "number", "p.*")


def media_digest(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: sizes and digests of its file and of the payload read back from it, and its feature.

    The file is parsed where it was made, so no file is written or shuffled.
    """

    @F.pandas_udf("struct<n_bytes:bigint,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            payload, n = payload_of(t)
            media = mux(payload)
            found = parse(media)
            back = stored_bytes(media, found)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, found)))
        return pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select(F.col(id), of(F.col(text)).alias("m")).select(id, "m.*")
