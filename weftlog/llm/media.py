"""Media columns: Matroska files and the packet tables parsed from them.

The parser walks variable-length EBML elements (sizes may be unknown for segments and clusters) and reads tracks, info,
clusters, simple blocks and block groups with no, Xiph, fixed-size or EBML lacing, and cues. A packet is a row of
track, timestamp, byte range and flags. The writer stores bytes as one track of unsigned 8-bit PCM.

Defined cases: null media or text is empty bytes; bytes that are not Matroska give no packets and ok false, and of a
damaged file the packets before the damage; equal inputs give equal files. A column of the input with the name of an
output column is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import append_columns, bound_batches, utf8

# Element identifiers of EBML and Matroska.
EBML, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
MUXING_APP, WRITING_APP = 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
EBML_HEAD = ((0x4286, 1), (0x42F7, 1), (0x42F2, 4), (0x42F3, 8), (0x4282, b"matroska"), (0x4287, 4), (0x4285, 2))
# The writer's layout: samples a frame, frames a block, blocks a cluster, samples a second.
FRAME, LACED, BLOCKS, HERTZ = 512, 8, 32, 8000
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def size_bytes(n: int, width: int = 0) -> bytes:
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
        if n < (1 << 7 * width) - 1:
            break
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes | int | float) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, float):
        body = struct.pack(">d", body)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing kind and body of a block: none for one frame, fixed-size for equal ones, else EBML."""
    if len(frames) == 1:
        return NO_LACING, frames[0]
    count = bytes([len(frames) - 1])
    if len({len(x) for x in frames}) == 1:
        return FIXED, count + b"".join(frames)
    sizes = size_bytes(len(frames[0]))
    for a, b in zip(frames, frames[1:-1], strict=False):
        d, width = len(b) - len(a), 1
        while not -(1 << 7 * width - 1) < d < 1 << 7 * width - 1:
            width += 1
        sizes += (d + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return EBML_LACING, count + sizes + b"".join(frames)


_HEAD = element(EBML, b"".join(element(i, v) for i, v in EBML_HEAD))
_TRACK = element(TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(DEFAULT_DURATION, FRAME * 10**9 // HERTZ) + element(AUDIO, element(RATE, float(HERTZ)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))))


def mux(samples: bytes) -> bytes:
    """A Matroska file with the samples as 8-bit PCM."""
    info = element(INFO, element(SCALE, 1_000_000) + element(DURATION, len(samples) * 1000 / HERTZ) + element(MUXING_APP, b"weftlog") + element(WRITING_APP, b"weftlog"))
    body, cues = [info, _TRACK], []
    at = len(info) + len(_TRACK)
    block = FRAME * LACED
    for first in range(0, len(samples), block * BLOCKS):
        base = first * 1000 // HERTZ
        parts = [element(TIMESTAMP, base)]
        for i in range(first, min(first + block * BLOCKS, len(samples)), block):
            chunk = samples[i : i + block]
            kind, laced = lace([chunk[j : j + FRAME] for j in range(0, len(chunk), FRAME)])
            parts.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", i * 1000 // HERTZ - base, 0x80 | kind << 1) + laced))
        cues.append(element(CUE_POINT, element(CUE_TIME, base) + element(CUE_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at))))
        body.append(cluster := element(CLUSTER, b"".join(parts)))
        at += len(cluster)
    return _HEAD + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


class Damaged(ValueError):
    pass


def read_number(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """A variable-length number at a place, the place past it, and whether all its bits are set (size unknown)."""
    if at >= end or not data[at]:
        raise Damaged
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damaged
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw if keep_marker else raw & (1 << 7 * width) - 1
    return value, at + width, not keep_marker and value == (1 << 7 * width) - 1


_TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES}


def elements(data: bytes, at: int, end: int, own: int = 0) -> Iterator[tuple[int, int, int]]:
    """(identifier, start, end) of each child in a range. In a cluster of unknown size (own: its identifier), an
    element that belongs a level up ends it."""
    while at < end:
        ident, at, _ = read_number(data, at, end, keep_marker=True)
        if own == CLUSTER and ident in _TOP:
            return
        size, at, unknown = read_number(data, at, end)
        stop = end if unknown else at + size
        if stop > end:
            yield ident, at, end
            raise Damaged
        yield ident, at, stop
        if unknown and ident == CLUSTER:
            at = _extent(data, at, end)
        else:
            at = stop


def _extent(data: bytes, at: int, end: int) -> int:
    """Where a cluster of unknown size ends."""
    while at < end:
        ident, past, _ = read_number(data, at, end, keep_marker=True)
        if ident in _TOP:
            return at
        size, past, _ = read_number(data, past, end)
        at = past + size
    return min(at, end)


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    #: (track, timestamp in ns, first byte, length, cluster, lacing, key frame)
    packets: list[tuple[int, int, int, int, int, int, bool]] = field(default_factory=list)
    ok: bool = True


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _real(data: bytes, a: int, b: int) -> float:
    return struct.unpack({4: ">f", 8: ">d"}[b - a], data[a:b])[0] if b - a in (4, 8) else 0.0


def frame_ranges(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(first byte, length) of each frame in a block's body."""
    if kind == NO_LACING:
        return [(at, end - at)]
    if at >= end:
        raise Damaged
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == FIXED:
        if (end - at) % n:
            raise Damaged
        sizes = [(end - at) // n] * n
    elif kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Damaged
                size, at, more = size + data[at], at + 1, data[at] == 255
                if not more:
                    break
            sizes.append(size)
    else:
        for k in range(n - 1):
            value, past, _ = read_number(data, at, end)
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * (past - at) - 1) - 1))
            at = past
    if kind != FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def _block(m: Media, data: bytes, a: int, b: int, base: int, key: bool | None) -> None:
    track, a, _ = read_number(data, a, b)
    if a + 3 > b:
        raise Damaged
    rel, flags = struct.unpack(">hB", data[a : a + 3])
    kind = flags >> 1 & 3
    stamp, each = (base + rel) * m.scale, m.tracks.get(track, {}).get("frame_ns", 0)
    for k, (at, size) in enumerate(frame_ranges(data, a + 3, b, kind)):
        m.packets.append((track, stamp + k * each, at, size, len(m.clusters) - 1, kind, bool(flags & 0x80) if key is None else key))


def parse(data: bytes) -> Media:
    """The packet table, tracks and cues of a Matroska file."""
    m = Media()
    try:
        top = list(elements(data, 0, len(data)))
        if not top or top[0][0] != EBML:
            m.ok = False
            return m
    except Damaged:
        m.ok, top = False, _lenient(data)
    for ident, a, b in top:
        if ident == SEGMENT:
            try:
                for x in elements(data, a, b):
                    _segment_child(m, data, a, *x)
            except Damaged:
                m.ok = False
    return m


def _lenient(data: bytes) -> list[tuple[int, int, int]]:
    out = []
    try:
        for x in elements(data, 0, len(data)):
            out.append(x)
    except Damaged:
        pass
    return out if out and out[0][0] == EBML else []


def _segment_child(m: Media, data: bytes, start: int, ident: int, a: int, b: int) -> None:
    if ident == INFO:
        for i, x, y in elements(data, a, b):
            if i == SCALE:
                m.scale = _uint(data, x, y)
            elif i == DURATION:
                m.duration = _real(data, x, y)
    elif ident == TRACKS:
        for i, x, y in elements(data, a, b):
            if i == TRACK_ENTRY:
                _track(m, data, x, y)
    elif ident == CLUSTER:
        m.clusters.append(a)
        base = 0
        for i, x, y in elements(data, a, b, CLUSTER):
            if i == TIMESTAMP:
                base = _uint(data, x, y)
            elif i == SIMPLE_BLOCK:
                _block(m, data, x, y, base, None)
            elif i == BLOCK_GROUP:
                inner = list(elements(data, x, y))
                for j, p, q in inner:
                    if j == BLOCK:
                        _block(m, data, p, q, base, all(k != REFERENCE for k, *_ in inner))
    elif ident == CUES:
        for i, x, y in elements(data, a, b):
            if i == CUE_POINT:
                _cue(m, data, start, x, y)


def _track(m: Media, data: bytes, a: int, b: int) -> None:
    number, found = 0, {"codec": "", "kind": 0, "rate": 0.0, "channels": 1, "bits": 0, "frame_ns": 0}
    for i, x, y in elements(data, a, b):
        if i == TRACK_NUMBER:
            number = _uint(data, x, y)
        elif i == TRACK_TYPE:
            found["kind"] = _uint(data, x, y)
        elif i == CODEC_ID:
            found["codec"] = data[x:y].decode("utf-8", "replace")
        elif i == DEFAULT_DURATION:
            found["frame_ns"] = _uint(data, x, y)
        elif i == AUDIO:
            for j, p, q in elements(data, x, y):
                if j == RATE:
                    found["rate"] = _real(data, p, q)
                elif j in (CHANNELS, BIT_DEPTH):
                    found["channels" if j == CHANNELS else "bits"] = _uint(data, p, q)
    m.tracks[number] = found


def _cue(m: Media, data: bytes, start: int, a: int, b: int) -> None:
    time, places = 0, []
    for i, x, y in elements(data, a, b):
        if i == CUE_TIME:
            time = _uint(data, x, y)
        elif i == CUE_POSITIONS:
            got = {j: _uint(data, p, q) for j, p, q in elements(data, x, y)}
            places.append((got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, 0)))
    m.cues += [(time * m.scale, track, start + at) for track, at in places]


def payload_of(data: bytes, m: Media) -> bytes:
    """The packets' bytes, in order."""
    return b"".join([data[at : at + size] for _, _, at, size, *_ in m.packets])


def padded(raw: bytes) -> bytes:
    """raw and zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def store_texts(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """df and a binary column with each text, padded, as a Matroska file; and n_bytes, the text's own bytes."""
    bound_batches(df.sparkSession)

    def make():
        def compute(batch):
            raw = utf8(batch.column(text_col))
            return [len(x) for x in raw], [mux(padded(x)) for x in raw]

        return compute

    return append_columns(df, [T.StructField("n_bytes", T.LongType()), T.StructField(media_col, T.BinaryType())], make)


PACKET = T.StructType([T.StructField(n, t) for n, t in (("track", T.LongType()), ("timestamp_ns", T.LongType()), ("byte_start", T.LongType()), ("byte_length", T.LongType()), ("cluster", T.IntegerType()), ("lacing", T.IntegerType()), ("key_frame", T.BooleanType()))])


def packet_table(df: DataFrame, media_col: str = "media") -> DataFrame:
    """A row for each packet: df's columns but the media, then track, timestamp_ns, byte_start, byte_length, cluster, lacing, key_frame."""
    bound_batches(df.sparkSession)

    def make():
        def compute(batch):
            return [[[dict(zip(PACKET.names, p, strict=True)) for p in parse(x).packets] for x in utf8(batch.column(media_col))]]

        return compute

    got = append_columns(df, [T.StructField("_packet", T.ArrayType(PACKET))], make)
    return got.select(*[c for c in df.columns if c != media_col and c not in PACKET.names], F.inline("_packet"))


READ = [T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("media_ok", T.BooleanType()))]


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df and digests of what the files hold: the payload read back through the packet table, and a feature string:
    packets, clusters, cues that point at their cluster, length in ns, loudness and zero crossings of the samples."""
    bound_batches(df.sparkSession)

    def make():
        def compute(batch):
            rows = [_digests(data) for data in utf8(batch.column(media_col))]
            return [[r[k] for r in rows] for k in range(len(READ))]

        return compute

    return append_columns(df, READ, make)


def digest_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with n_bytes and what read_media() gives of the file that store_texts() makes of each text, in one pass: files
    are made, parsed and forgotten batch by batch."""
    bound_batches(df.sparkSession)

    def make():
        def compute(batch):
            raw = utf8(batch.column(text_col))
            rows = [_digests(mux(padded(x))) for x in raw]
            return [[len(x) for x in raw], *([r[k] for r in rows] for k in range(len(READ)))]

        return compute

    return append_columns(df, [T.StructField("n_bytes", T.LongType()), *READ], make)


def _digests(data: bytes) -> tuple:
    m = parse(data)
    payload = payload_of(data, m)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(data, m, payload), m.ok


def feature(data: bytes, m: Media, payload: bytes) -> str:
    wave = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
    right = sum(data[at : at + 4] == CLUSTER.to_bytes(4, "big") for _, _, at in m.cues)
    energy = int((wave * wave).sum(dtype=np.int64))
    return f"packets={len(m.packets)};clusters={len(m.clusters)};cues={right};ns={round(m.duration * m.scale)};energy={energy};crossings={crossings}"
