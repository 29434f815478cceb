"""Matroska: a muxer for 8-bit PCM and a parser of EBML elements, clusters, lacing and cues into packet tables.

``mux`` stores a payload of whole 64-byte groups as mono 8-bit samples at 8 kHz (so 64 bytes are 8 ms): frames of
1,024 samples, up to eight to a block, fixed-size lacing where all are full and EBML lacing otherwise, clusters of
64 KiB, one cue per cluster. The file depends on the payload alone. ``parse`` reads any file of the container: ids
and sizes of any length, segments and clusters of unknown size, SimpleBlocks and BlockGroups, no, Xiph, fixed and
EBML lacing; elements that it doesn't know are skipped. A file cut short or out of order raises ValueError.

Columns: null or empty texts give one group of zeros. Equal texts give equal files. Equal rows and null ids are kept
each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adjudica.llm.units import slices

GROUP, FRAME, LACED, CLUSTER, RATE = 64, 1024, 8, 1 << 16, 8000
NS = 1_000_000_000

# Element ids of EBML and Matroska.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER_ID, CUES, CUE, CUE_TRACKS, BLOCK_GROUP = 0x1F43B675, 0x1C53BB6B, 0xBB, 0xB7, 0xA0
SIMPLE_BLOCK, BLOCK, REFERENCE, BLOCK_DURATION, TIMESTAMP = 0xA3, 0xA1, 0xFB, 0x9B, 0xE7
SCALE, NUMBER, KIND, CODEC, DEFAULT_DURATION = 0x2AD7B1, 0xD7, 0x83, 0x86, 0x23E383
FREQUENCY, CHANNELS, DEPTH, CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB5, 0x9F, 0x6264, 0xB3, 0xF7, 0xF1
TOP_LEVEL = {EBML, SEGMENT, INFO, TRACKS, CLUSTER_ID, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}


def id_bytes(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def vint(number: int, length: int = 0) -> bytes:
    """A size or lace size; all ones of a length mean "unknown", so they take a longer form."""
    length = length or next(n for n in range(1, 9) if number < (1 << 7 * n) - 1)
    return (number | 1 << 7 * length).to_bytes(length, "big")


def element(number: int, *content: bytes) -> bytes:
    body = b"".join(content)
    return id_bytes(number) + vint(len(body)) + body


def unsigned(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def real(number: int, value: float) -> bytes:
    return element(number, struct.pack(">d", value))


HEAD = element(EBML, unsigned(0x4286, 1), unsigned(0x42F7, 1), unsigned(0x42F2, 4), unsigned(0x42F3, 8), element(0x4282, b"matroska"), unsigned(0x4287, 4), unsigned(0x4285, 2))
ABOUT = element(INFO, unsigned(SCALE, NS // 1000), element(0x4D80, b"adjudica"), element(0x5741, b"adjudica")) + element(
    TRACKS,
    element(TRACK, unsigned(NUMBER, 1), unsigned(0x73C5, 1), unsigned(KIND, 2), unsigned(0x9C, 1), element(CODEC, b"A_PCM/INT/LIT"), unsigned(DEFAULT_DURATION, FRAME * NS // RATE), element(AUDIO, real(FREQUENCY, RATE), unsigned(CHANNELS, 1), unsigned(DEPTH, 8))),
)


def lace(frames: list[bytes], at_ms: int, track: int = 1) -> bytes:
    """A SimpleBlock that holds the frames; ``at_ms`` counts from the cluster's start."""
    head = vint(track) + struct.pack(">h", at_ms)
    if len(frames) == 1:
        return element(SIMPLE_BLOCK, head, b"\x80", frames[0])
    count, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return element(SIMPLE_BLOCK, head, b"\x84", count, *frames)
    steps = []
    for before, size in zip(sizes, sizes[1:-1], strict=False):
        step = size - before
        n = next(n for n in range(1, 9) if abs(step) < (1 << 7 * n - 1) - 1)
        steps.append(vint(step + (1 << 7 * n - 1) - 1, n))
    return element(SIMPLE_BLOCK, head, b"\x86", count, vint(sizes[0]), *steps, *frames)


def mux(payload: bytes) -> bytes:
    body, cues, position = [ABOUT], [], len(ABOUT)
    for start in range(0, len(payload), CLUSTER):
        part, time = payload[start : start + CLUSTER], start * 1000 // RATE
        frames = [part[a : a + FRAME] for a in range(0, len(part), FRAME)]
        blocks = [lace(frames[a : a + LACED], a * FRAME * 1000 // RATE) for a in range(0, len(frames), LACED)]
        body.append(element(CLUSTER_ID, unsigned(TIMESTAMP, time), *blocks))
        cues.append(element(CUE, unsigned(CUE_TIME, time), element(CUE_TRACKS, unsigned(CUE_TRACK, 1), unsigned(CUE_CLUSTER, position))))
        position += len(body[-1])
    return HEAD + element(SEGMENT, *body, element(CUES, *cues))


@dataclass
class Media:
    """``packets``: (track, timestamp in ns, offset, size, keyframe, block, place in its lace, cluster)."""

    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0
    laced: int = 0


def read_vint(data: bytes, at: int, end: int, keep_mark: bool = False) -> tuple[int, int, bool]:
    """(value, what follows, whether all value bits are ones)."""
    if at >= end or not data[at]:
        raise ValueError(f"no element at {at}")
    length = 9 - data[at].bit_length()
    if at + length > end:
        raise ValueError(f"cut short at {at}")
    raw = int.from_bytes(data[at : at + length], "big")
    bare = raw & (1 << 7 * length) - 1
    return (raw if keep_mark else bare), at + length, bare == (1 << 7 * length) - 1


def header(data: bytes, at: int, end: int) -> tuple[int, int, int | None]:
    """(id, start of the content, its end or None if unknown)."""
    number, at, _ = read_vint(data, at, end, True)
    size, at, unknown = read_vint(data, at, end)
    if not unknown and at + size > end:
        raise ValueError(f"cut short at {at}")
    return number, at, None if unknown else at + size


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        number, start, stop = header(data, at, end)
        if stop is None:
            raise ValueError(f"unknown size at {at}")
        yield number, start, stop
        at = stop


def number_of(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def number_or_real(data: bytes, start: int, end: int) -> float:
    return {0: lambda b: 0.0, 4: lambda b: struct.unpack(">f", b)[0], 8: lambda b: struct.unpack(">d", b)[0]}[end - start](data[start:end])


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first starts. kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not kind:
        return [end - at], at
    if at >= end:
        raise ValueError(f"cut short at {at}")
    count, at, sizes = data[at] + 1, at + 1, []
    if kind == 2:
        if (end - at) % count:
            raise ValueError(f"frames of unequal size at {at}")
        return [(end - at) // count] * count, at
    for k in range(count - 1):
        if kind == 1:
            size = 0
            while True:
                if at >= end:
                    raise ValueError(f"cut short at {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
        else:
            value, after, _ = read_vint(data, at, end)
            size = value if not k else sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1)
            at = after
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"frames beyond their block at {at}")
    return sizes, at


def read_block(media: Media, data: bytes, start: int, end: int, time: int, simple: bool, key: bool, duration: int | None) -> None:
    track, at, _ = read_vint(data, start, end)
    if at + 3 > end:
        raise ValueError(f"cut short at {at}")
    relative, flags = struct.unpack_from(">hB", data, at)
    sizes, at = lace_sizes(data, at + 3, end, flags >> 1 & 3)
    first = (time + relative) * media.scale
    step = duration * media.scale // len(sizes) if duration else media.tracks.get(track, {}).get("frame_ns", 0)
    key = bool(flags & 0x80) if simple else key
    for k, size in enumerate(sizes):
        media.packets.append((track, first + k * step, at, size, key, media.blocks, k, len(media.clusters) - 1))
        at += size
    media.blocks += 1
    media.laced += len(sizes) > 1


def read_track(data: bytes, start: int, end: int) -> tuple[int, dict]:
    found: dict = {"frame_ns": 0}
    for number, a, b in elements(data, start, end):
        if number in (NUMBER, KIND, DEFAULT_DURATION):
            found[{NUMBER: "number", KIND: "kind", DEFAULT_DURATION: "frame_ns"}[number]] = number_of(data, a, b)
        elif number == CODEC:
            found["codec"] = data[a:b].rstrip(b"\0").decode("ascii", "replace")
        elif number == AUDIO:
            for inner, c, d in elements(data, a, b):
                if inner == FREQUENCY:
                    found["rate"] = number_or_real(data, c, d)
                elif inner in (CHANNELS, DEPTH):
                    found["channels" if inner == CHANNELS else "depth"] = number_of(data, c, d)
    return found.get("number", 0), found


def read_cue(media: Media, data: bytes, start: int, end: int) -> None:
    time, places = 0, []
    for number, a, b in elements(data, start, end):
        if number == CUE_TIME:
            time = number_of(data, a, b)
        elif number == CUE_TRACKS:
            inner = {n: number_of(data, c, d) for n, c, d in elements(data, a, b)}
            places.append((inner.get(CUE_TRACK, 0), inner.get(CUE_CLUSTER, 0)))
    media.cues += [(time * media.scale, track, place) for track, place in places]


def read_cluster(media: Media, data: bytes, start: int, end: int | None, limit: int) -> int:
    """Reads up to ``end``; of unknown size, up to the next top-level element, whose place is returned."""
    time, at = 0, start
    while at < (limit if end is None else end):
        if end is None and read_vint(data, at, limit, True)[0] in TOP_LEVEL:
            return at
        number, a, b = next(elements(data, at, limit if end is None else end))
        if number == TIMESTAMP:
            time = number_of(data, a, b)
        elif number == SIMPLE_BLOCK:
            read_block(media, data, a, b, time, True, False, None)
        elif number == BLOCK_GROUP:
            parts = {n: (c, d) for n, c, d in elements(data, a, b)}
            if BLOCK in parts:
                duration = number_of(data, *parts[BLOCK_DURATION]) if BLOCK_DURATION in parts else None
                read_block(media, data, *parts[BLOCK], time, False, REFERENCE not in parts, duration)
        at = b
    return at


def parse(data: bytes) -> Media:
    media, at, limit = Media(), 0, len(data)
    segment = 0
    if read_vint(data, 0, limit, True)[0] != EBML:
        raise ValueError("not an EBML file")
    while at < limit:
        number, a, b = header(data, at, limit)
        if number == SEGMENT:  # its children are read as they come, whatever its size says
            segment = at = a
            continue
        if b is None and number != CLUSTER_ID:
            raise ValueError(f"unknown size at {a}")
        if number == INFO:
            media.scale = next((number_of(data, c, d) for n, c, d in elements(data, a, b) if n == SCALE), media.scale)
        elif number == TRACKS:
            media.tracks |= dict(read_track(data, c, d) for n, c, d in elements(data, a, b) if n == TRACK)
        elif number == CLUSTER_ID:
            media.clusters.append(at - segment)
            b = read_cluster(media, data, a, b, limit)
        elif number == CUES:
            for n, c, d in elements(data, a, b):
                if n == CUE:
                    read_cue(media, data, c, d)
        at = b
    return media


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % GROUP if raw else GROUP)


STORED = "doc_id long, n_bytes long, media binary"
TABLE = "doc_id long, track int, timestamp_ns long, offset long, size int, keyframe boolean, block int, lace int, cluster int"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media column: each whole text as a Matroska file."""
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(1)):
                sizes, files = [], []
                for text in batch.column(1).slice(at, n):
                    size, payload = padded(text.as_py())
                    sizes.append(size)
                    files.append(mux(payload))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(store, STORED)


def packet_table(stored: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of each file."""
    names = [x.split()[0] for x in TABLE.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), *[pa.int32()] * 3]

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, file in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = parse(file.as_py()).packets if file.is_valid else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([[doc_id] * len(found), *zip(*found, strict=True)], kinds, strict=True)], names)

    return stored.select(id_col, media_col).mapInArrow(packets, TABLE)


def feature(media: Media, payload: bytes) -> str:
    """What the packet table and the samples say: counts, duration and level, all whole numbers."""
    samples = np.frombuffer(payload, np.uint8)
    track = next(iter(media.tracks.values()), {})
    last = max((p[1] + p[3] * NS // RATE for p in media.packets), default=0)
    seeks = sum(place in set(media.clusters) for _, _, place in media.cues) if len(media.cues) < 1000 else len({c[2] for c in media.cues} & set(media.clusters))
    return f"{track.get('codec')};tracks={len(media.tracks)};clusters={len(media.clusters)};cues={seeks};blocks={media.blocks};laced={media.laced};packets={len(media.packets)};ms={last // 1_000_000};sum={int(samples.sum(dtype=np.int64))};peak={int(samples.max(initial=0))}"


def read_media(stored: DataFrame) -> DataFrame:
    """The payload back from the packets of each stored file, as digests and a feature string."""
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, size, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = file.as_py()
                media = parse(data)
                payload = b"".join([data[p[2] : p[2] + p[3]] for p in media.packets])
                rows.append((doc_id, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-GROUP:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)

    return stored.mapInArrow(read, DIGEST)
