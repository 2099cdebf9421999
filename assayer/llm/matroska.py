"""Media columns: samples in Matroska files and packet tables read back from their bytes.

A payload is stored as 8-bit PCM in a Matroska file: EBML header, segment with info, one audio track, clusters of
SimpleBlocks whose frames share a block by EBML lacing, and cues. The parser walks the EBML elements of any such file
(elements of unknown size too) and gives a row for each packet: track, timestamp, key flag and byte range. It reads blocks
without lacing and with Xiph, fixed-size and EBML lacing, in SimpleBlocks and BlockGroups.

A null text is an empty one; an empty text is a payload of 64 zero bytes. Repeated rows give equal values; other columns are
ignored; an empty table gives no row. Media are processed one at a time, so a task holds a batch of texts and one file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import map_lists, read, ship

UNIT = 64
RATE = 8000
FRAME = 512
FRAMES_PER_BLOCK = 4
BLOCKS_PER_CLUSTER = 8
#: Element ids of the Matroska format: fixed values.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, MUXING_APP = 0x4282, 0x4D80
#: Elements that end a cluster, or the cues, of unknown size.
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
PARENTS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS, EBML}


def vint(value: int) -> bytes:
    """A length as the shortest variable-length integer; all ones are kept for unknown sizes."""
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes | int | float | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, float):
        body = struct.pack(">d", body)
    elif isinstance(body, str):
        body = body.encode()
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def laced(frames: list[bytes]) -> bytes:
    """The EBML lace head and the frames: sizes as a first size and signed differences."""
    head = bytes([len(frames) - 1])
    for k, f in enumerate(frames[:-1]):
        if not k:
            head += vint(len(f))
        else:
            diff, n = len(f) - len(frames[k - 1]), 1
            while abs(diff) >= (1 << 7 * n - 1) - 1:
                n += 1
            head += (diff + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")
    return head + b"".join(frames)


def mux(payload: bytes, rate: int = RATE) -> bytes:
    """A Matroska file that holds the payload as unsigned 8-bit samples, one sample a byte."""
    scale = 1_000_000_000 // rate  # a tick for each sample
    track = element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(CODEC_ID, "A_PCM/INT/LIT")
    track += element(AUDIO, element(SAMPLING, float(rate)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))
    body = element(INFO, element(TIMESTAMP_SCALE, scale) + element(MUXING_APP, "assayer"))
    body += element(TRACKS, element(TRACK_ENTRY, track + element(DEFAULT_DURATION, FRAME * scale)))
    parts, cues, at = [body], [], len(body)
    block, cluster = FRAME * FRAMES_PER_BLOCK, FRAME * FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for start in range(0, len(payload), cluster):
        inner = [element(CLUSTER_TIME, start)]
        for k in range(start, min(start + cluster, len(payload)), block):
            stop = min(k + block, start + cluster, len(payload))
            frames = [payload[i : min(i + FRAME, stop)] for i in range(k, stop, FRAME)]
            flags = 0x80 | (0x06 if len(frames) > 1 else 0)
            head = b"\x81" + struct.pack(">hB", k - start, flags)
            inner.append(element(SIMPLE_BLOCK, head + (laced(frames) if len(frames) > 1 else frames[0])))
        made = element(CLUSTER, b"".join(inner))
        cues.append(element(CUE_POINT, element(CUE_TIME, start) + element(CUE_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at))))
        parts.append(made)
        at += len(made)
    parts.append(element(CUES, b"".join(cues)))
    return element(EBML, element(DOC_TYPE, "matroska")) + element(SEGMENT, b"".join(parts))


def read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """The number at a place, and the place after it; -1 for an unknown size. keep leaves the length marker in, as ids do."""
    if at >= len(data):
        raise ValueError("the data end within an element")
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > len(data):
        raise ValueError("not a variable-length integer")
    value = int.from_bytes(data[at : at + n], "big")
    if keep:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def elements(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """Depth-first (id, start of the body, end of the body, depth) of all elements; parents come before their children.

    The open parents are a stack, not calls. One of unknown size ends with the data or its own parent, at an element of the
    segment's level if it is in the segment, and at a new segment or header if it is the segment; its end is then not known
    when it is told, and its parent's is given.
    """
    end = len(data) if end is None else end
    opened: list[tuple[int, int, bool]] = []  # (id, end, whether the size is unknown)
    while at < end:
        ident, body = read_vint(data, at, keep=True)
        while opened and (at >= opened[-1][1] or opened[-1][2] and ident in ({EBML, SEGMENT} if opened[-1][0] == SEGMENT else TOP)):
            opened.pop()
        size, body = read_vint(data, body)
        above = opened[-1][1] if opened else end
        stop = above if size < 0 else min(body + size, above)
        yield ident, body, stop, depth + len(opened)
        if ident in PARENTS:
            opened.append((ident, stop, size < 0))
            at = body
        else:
            at = stop


def frame_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where they start. lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not lacing:
        return [end - at], at
    many, at = data[at] + 1, at + 1
    if lacing == 2:
        return [(end - at) // many] * many, at
    sizes: list[int] = []
    for k in range(many - 1):
        if lacing == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            start = at
            size, at = read_vint(data, at)
            if k:
                size += sizes[-1] - ((1 << 7 * (at - start) - 1) - 1)
        sizes.append(size)
    return [*sizes, end - at - sum(sizes)], at


def packets(data: bytes) -> list[tuple[int, int, bool, int, int]]:
    """track, timestamp in ns, key flag, first byte and number of bytes of every frame.

    Laced frames after the first are later by the track's default duration.
    """
    scale, cluster, out = 1_000_000, 0, []
    number, duration = 0, {}
    for ident, at, end, _ in elements(data):
        if ident == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[at:end], "big")
        elif ident == TRACK_NUMBER:
            number = int.from_bytes(data[at:end], "big")
        elif ident == DEFAULT_DURATION:
            duration[number] = int.from_bytes(data[at:end], "big")
        elif ident == CLUSTER_TIME:
            cluster = int.from_bytes(data[at:end], "big")
        elif ident in (SIMPLE_BLOCK, BLOCK):
            track, at = read_vint(data, at)
            relative, flags = struct.unpack_from(">hB", data, at)
            sizes, at = frame_sizes(data, at + 3, end, flags >> 1 & 3)
            time = (cluster + relative) * scale
            for size in sizes:
                out.append((track, time, ident == BLOCK or bool(flags & 0x80), at, size))
                time += duration.get(track, 0)
                at += size
    return out


def cue_points(data: bytes) -> list[tuple[int, int]]:
    """Time in ticks and the position of the cluster, relative to the segment's body, of every cue."""
    out, time = [], 0
    for ident, at, end, _ in elements(data):
        if ident == CUE_TIME:
            time = int.from_bytes(data[at:end], "big")
        elif ident == CUE_CLUSTER:
            out.append((time, int.from_bytes(data[at:end], "big")))
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes with zeros up to a positive multiple of UNIT, and their number without these."""
    raw = (text or "").encode("utf-8")
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def feature(samples: bytes, table: list[tuple[int, int, bool, int, int]]) -> str:
    """Packets, mean, root mean square and sign changes of the samples around 128."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    rms = int(1000 * np.sqrt((x * x).mean()))
    return f"packets={len(table)};mean={int(1000 * x.mean())};rms={rms};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the file) of each row of docs (doc_id, text)."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for x in batches:
            made = [payload_of(t) for t in x["text"]]
            yield {"doc_id": x["doc_id"], "n_bytes": [n for _, n in made], "media": [mux(p) for p, _ in made]}

    return map_lists(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, media binary")


PACKETS = "array<struct<track:int,timestamp_ns:long,key:boolean,first_byte:long,bytes:long>>"


def with_packets(files: DataFrame) -> DataFrame:
    """Adds packets (PACKETS) to rows with media; a null file has none."""
    ship(files.sparkSession)
    udf = F.pandas_udf(lambda s: s.map(lambda d: packets(bytes(d)) if d is not None else []), PACKETS)
    return files.withColumn("packets", udf("media"))


def digests(files: DataFrame) -> DataFrame:
    """What is read back from the files' packets, one row for each of files (doc_id, n_bytes, media)."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for x in batches:
            rows = []
            for doc, n, data in zip(x["doc_id"], x["n_bytes"], x["media"], strict=True):
                table = packets(data)
                back = b"".join(data[a : a + size] for _, _, _, a, size in table)
                rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(back, table)))
            yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return map_lists(files, run, schema)


def op8_matroska(spark, sf_dir: str) -> DataFrame:
    return digests(media(read(spark, sf_dir, "documents")))
