"""Matroska: payloads stored as EBML documents and parsed into packet tables.

``mux`` stores bytes as an audio track of 8-bit samples at 8000 Hz: EBML header, then a Segment with
Info, Tracks, Clusters and Cues. A packet is 64 samples (8 ms); packets go into SimpleBlocks of eight
with fixed-size lacing, and the last ones into a block with EBML lacing if two or more, else unlaced.
A cluster spans 512 blocks; Cues has an entry a cluster. ``demux`` reads any such file from its
variable-length elements, including unknown sizes, Void, and Xiph, EBML and fixed lacing, BlockGroups
too, into packets (track, timestamp, offset, size, keyframe), clusters and cues.

Defined cases: null text is empty text, which is stored as 64 zero bytes; equal texts give equal
values; a null id is kept; repeated rows return as often as they occur; a very long text is one file of several clusters (at
most 2 GB, Spark's bound of a binary value); an empty table gives no rows; other columns are not read; a file that breaks off
or is damaged raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_rows, raw_texts, unsigned_crc

# Element identifiers of the public Matroska and EBML specifications.
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, ENTRY, NUMBER, UID, KIND, CODEC, DEFAULT_DURATION, LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0x9C
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, POINT, CUE_TIME, CUE_TRACKS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, POINT, CUE_TRACKS, INFO, EBML}

UNIT, RATE_HZ, PER_BLOCK, BLOCKS = 64, 8000, 8, 512
PACKET_MS = UNIT * 1000 // RATE_HZ


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def vint(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _block(payload: bytes, count: int, ms: int) -> bytes:
    full = count == PER_BLOCK
    flags = 0x80 | (0x04 if full else 0x06 if count > 1 else 0)
    head = b"\x81" + struct.pack(">hB", ms, flags)
    if full:
        head += bytes([count - 1])
    elif count > 1:  # sizes: the first, then differences (all 0)
        head += bytes([count - 1]) + vint(UNIT) + vint(63, 1) * (count - 2)
    return element(SIMPLE, head + payload)


_HEADER = element(EBML, uint(VERSION, 1) + uint(READ_VERSION, 1) + uint(MAX_ID, 4) + uint(MAX_SIZE, 8) + element(DOCTYPE, b"matroska") + uint(DOCTYPE_VERSION, 4) + uint(DOCTYPE_READ, 2))
_TRACKS = element(TRACKS, element(ENTRY, uint(NUMBER, 1) + uint(UID, 1) + uint(KIND, 2) + uint(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, PACKET_MS * 1_000_000) + element(AUDIO, element(RATE, struct.pack(">d", RATE_HZ)) + uint(CHANNELS, 1) + uint(DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """The payload, a positive multiple of 64 bytes, as a Matroska file."""
    packets = len(payload) // UNIT
    info = element(INFO, uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", packets * PACKET_MS)) + element(MUXER, b"quillon") + element(WRITER, b"quillon"))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    step = PER_BLOCK * BLOCKS
    for first in range(0, packets, step):
        base = first * PACKET_MS
        body = [uint(TIMESTAMP, base)]
        for p in range(first, min(first + step, packets), PER_BLOCK):
            n = min(PER_BLOCK, packets - p)
            body.append(_block(payload[p * UNIT : (p + n) * UNIT], n, (p - first) * PACKET_MS))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(POINT, uint(CUE_TIME, base) + element(CUE_TRACKS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return _HEADER + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def read_vint(data, at: int, keep: bool = False) -> tuple[int, int]:
    """(value, next offset); value -1: a size that is unknown."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"bad variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"broken off at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


@dataclass
class Parsed:
    packets: list = field(default_factory=list)  # (track, timestamp, offset, size, keyframe)
    clusters: list = field(default_factory=list)  # (timestamp, offset in the segment)
    cues: list = field(default_factory=list)  # (time, track, cluster offset)
    tracks: dict = field(default_factory=dict)  # number: (kind, codec, rate, depth, packet ns)
    scale: int = 1_000_000
    duration: float = 0.0
    doctype: str = ""
    lacing: dict = field(default_factory=dict)  # kind: blocks


def _frames(data, at: int, end: int, flags: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block whose lacing is in ``flags``."""
    kind = flags >> 1 & 3
    if not kind:
        return [(at, end - at)]
    n = data[at] + 1
    at += 1
    if kind == 2:  # fixed
        size, rest = divmod(end - at, n)
        if rest:
            raise ValueError("fixed lacing of unequal frames")
        return [(at + i * size, size) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if kind == 1:  # Xiph
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            size += data[at]
            at += 1
        else:
            first = at
            size, at = read_vint(data, at)
            if i:  # a signed difference
                size = sizes[-1] + size - ((1 << 7 * (at - first) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing beyond its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def demux(data: bytes) -> Parsed:
    """Packet table, clusters, cues and tracks of a file."""
    out = Parsed()
    state = {"segment": 0, "time": 0}

    def value(kind, at, n):
        return int.from_bytes(data[at : at + n], "big") if kind == "u" else struct.unpack(">d" if n == 8 else ">f", data[at : at + n])[0]

    def walk(at: int, end: int, parent: int, entry: dict) -> int:
        while at < end:
            start = at
            ident, at = read_vint(data, at, keep=True)
            size, at = read_vint(data, at)
            if size < 0:
                if ident not in (SEGMENT, CLUSTER):
                    raise ValueError("unknown size")
                stop = end
            else:
                stop = at + size
            if stop > end:
                raise ValueError(f"element at {start} goes beyond its parent")
            if ident in (CLUSTER, CUES, TRACKS, INFO) and parent == CLUSTER:
                return start  # ends a cluster of unknown size
            if ident == SEGMENT:
                state["segment"] = at
            if ident == CLUSTER:
                out.clusters.append([0, start - state["segment"]])
            if ident in MASTERS:
                inner: dict = {} if ident in (ENTRY, POINT) else entry
                at = walk(at, stop, ident, inner)
                if ident == ENTRY:
                    out.tracks[inner.get(NUMBER, 0)] = tuple(inner.get(k) for k in (KIND, CODEC, RATE, DEPTH, DEFAULT_DURATION))
                if ident == POINT:
                    out.cues.append(tuple(inner.get(k, 0) for k in (CUE_TIME, CUE_TRACK, CUE_CLUSTER)))
                continue
            if ident == TIMESTAMP:
                state["time"] = out.clusters[-1][0] = value("u", at, size)
            elif ident in (SIMPLE, BLOCK):
                track, p = read_vint(data, at)
                rel, flags = struct.unpack(">hB", data[p : p + 3])
                frames = _frames(data, p + 3, stop, flags)
                kind = flags >> 1 & 3
                out.lacing[kind] = out.lacing.get(kind, 0) + 1
                step = (out.tracks.get(track, (0,) * 5)[4] or 0) // out.scale
                base, key = state["time"] + rel, ident == SIMPLE and bool(flags & 0x80)
                out.packets += [(track, base + i * step, o, n, key) for i, (o, n) in enumerate(frames)]
            elif ident in (NUMBER, KIND, DEPTH, DEFAULT_DURATION, CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                entry[ident] = value("u", at, size)
            elif ident == RATE:
                entry[ident] = value("f", at, size)
            elif ident == CODEC:
                entry[ident] = data[at:stop].decode()
            elif ident == SCALE:
                out.scale = value("u", at, size)
            elif ident == DURATION:
                out.duration = value("f", at, size)
            elif ident == DOCTYPE:
                out.doctype = data[at:stop].decode()
            at = stop
        return at

    try:
        walk(0, len(data), 0, {})
    except (struct.error, IndexError, UnicodeDecodeError) as e:
        raise ValueError(f"broken off or not Matroska: {e}") from e
    return out


def payload_of(data: bytes, parsed: Parsed, track: int = 1) -> bytes:
    """The track's packets joined, in order of their timestamps."""
    rows = sorted((p for p in parsed.packets if p[0] == track), key=lambda p: p[1])
    return b"".join(data[o : o + n] for _, _, o, n, _ in rows)


def feature_of(parsed: Parsed, payload: bytes) -> str:
    """Figures of the parsed file as text."""
    found = {tuple(c[:2]) for c in parsed.clusters}
    exact = sum((t, c) in found for t, _, c in parsed.cues)
    last = max((p[1] for p in parsed.packets), default=0)
    return f"tracks={len(parsed.tracks)};clusters={len(parsed.clusters)};cues={exact};packets={len(parsed.packets)};lacing={','.join(f'{k}:{v}' for k, v in sorted(parsed.lacing.items()))};last_ms={last};duration_ms={parsed.duration:.0f};zeros={payload.count(0)}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a Matroska file."""

    def run(batch):
        raws = raw_texts(batch)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(r) for r in raws], pa.int64()), pa.array([mux(pad(r)) for r in raws], pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_rows(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """One row a packet of every file in (doc_id, media)."""
    names = ["doc_id", "track", "timestamp", "offset", "size", "keyframe"]

    def run(batch):
        rows = [(i, *p) for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if m for p in demux(m).packets]
        cols = list(zip(*rows)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.bool_()])], names)

    return map_rows(media.select("doc_id", "media"), run, "doc_id long, track long, timestamp long, offset long, size long, keyframe boolean")


def media_digests(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, parsed from them."""

    def run(batch):
        rows = []
        for doc_id, n, m in zip(*(batch.column(i).to_pylist() for i in range(3))):
            parsed = demux(m)
            payload = payload_of(m, parsed)
            rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), unsigned_crc(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(parsed, payload)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], _NAMES)

    return map_rows(media.select("doc_id", "n_bytes", "media"), run, DIGEST)
