"""Operator 9: Matroska media columns.

Writing: bytes become an 8-bit PCM track in an EBML document: header, info, tracks,
clusters of laced blocks, cues. Reading: elements with variable-length ids and sizes are
walked, clusters and their blocks unlaced into a packet table of track, timestamp and
byte range, cues into an index of cluster positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import id_and_text, per_document, table

#: Element ids of the Matroska format.
EBML, DOCTYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, NUMBER, UID, KIND, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE, CHANNELS, DEPTH, LASTS = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_AT}
#: Elements beside a cluster (seek head, chapters, tags and attachments among them): a cluster of unknown size ends before one.
BESIDE_CLUSTER = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}

#: Samples a second; bytes of a frame, frames of a block, blocks of a cluster. A frame lasts 128 ms.
HERTZ, FRAME, LACED, BLOCKS = 8000, 1024, 8, 8


def size_bytes(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones means unknown and is not used."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def block(track: int, at: int, frames: list[bytes]) -> bytes:
    """A simple block: unlaced, laced with one size, or laced with EBML sizes."""
    sizes = [len(f) for f in frames]
    head = size_bytes(track) + struct.pack(">h", at)
    if len(frames) == 1:
        return element(SIMPLE, head, b"\x80", frames[0])
    count = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return element(SIMPLE, head, b"\x84", count, *frames)
    laces = size_bytes(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        laces += size_bytes(b - a + (1 << 7 * width - 1) - 1, width)
    return element(SIMPLE, head, b"\x86", count, laces, *frames)


def mux(payload: bytes) -> bytes:
    """The payload as the only track of a Matroska document."""
    ms = FRAME * 1000 // HERTZ
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = element(INFO, number(SCALE, 1_000_000), element(DURATION, struct.pack(">d", len(payload) * 1000 / HERTZ)))
    audio = element(AUDIO, element(RATE, struct.pack(">d", HERTZ)), number(CHANNELS, 1), number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(NUMBER, 1), number(UID, 1), number(KIND, 2), number(LASTS, FRAME * 1_000_000_000 // HERTZ), element(CODEC, b"A_PCM/INT/LIT"), audio))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    for first in range(0, len(frames), LACED * BLOCKS):
        some = frames[first : first + LACED * BLOCKS]
        blocks = [block(1, i * ms, some[i : i + LACED]) for i in range(0, len(some), LACED)]
        body.append(element(CLUSTER, number(TIME, first * ms), *blocks))
        cues.append(element(CUE, number(CUE_TIME, first * ms), element(CUE_AT, number(CUE_TRACK, 1), number(CUE_CLUSTER, at))))
        at += len(body[-1])
    if cues:
        body.append(element(CUES, *cues))
    return element(EBML, element(DOCTYPE, b"matroska")) + element(SEGMENT, *body)


def variable(data: bytes, at: int, keep_mark: bool) -> tuple[int, int]:
    """A variable-length integer and the place after it; -1 for an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"the integer at byte {at} is cut off")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_mark:
        return n, at + width
    n ^= 1 << 7 * width
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, content, end) of the elements in a range; masters of unknown size reach to the range's end."""
    while at < end:
        start = at
        kind, at = variable(data, at, True)
        n, at = variable(data, at, False)
        stop = end if n < 0 else at + n
        if stop > end:
            raise ValueError(f"element {kind:x} at byte {start} is longer than what holds it")
        yield kind, start, at, stop
        at = stop


def unlace(data: bytes, at: int, end: int) -> tuple[int, int, bool, list[tuple[int, int]]]:
    """(track, relative timestamp, key, [(offset, size)]) of a block's content."""
    track, at = variable(data, at, False)
    time, flags = struct.unpack_from(">hB", data, at)
    at, lacing = at + 3, flags >> 1 & 3
    if not lacing:
        return track, time, bool(flags & 0x80), [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:  # sums of bytes, each run ended by one below 255
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif lacing == 3:  # the first size, then signed differences
        n, at = variable(data, at, False)
        sizes.append(n)
        for _ in range(count - 2):
            before = at
            d, at = variable(data, at, False)
            sizes.append(sizes[-1] + d - ((1 << 7 * (at - before) - 1) - 1))
    else:
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laces are longer than their block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return track, time, bool(flags & 0x80), out


def demux(data: bytes) -> tuple[list[tuple[int, int, int, int, int, bool]], list[tuple[int, int, int]], dict]:
    """Packets (track, timestamp, offset, size, cluster, key), cues (timestamp, track, cluster's byte) and facts of a document.

    Timestamps are in whole milliseconds, by the segment's scale. A frame of a lace comes after
    the frames before it by its track's default duration; without one it has its block's
    time. A cluster of unknown size
    ends before the next element of its own level, a segment before the next document. A
    block in a group is a key one if it refers to no other. Open elements are kept in a
    list, so no depth or number of them is too much.
    """
    packets, cues, facts = [], [], {"clusters": 0, "laced": 0, "codec": "", "rate": 0.0, "duration": 0.0, "scale": 1_000_000}
    open_: list[tuple[int, int, bool]] = [(0, len(data), False)]  # element, end, whether that is unknown
    base = time = at = 0
    group: dict = {}
    cue: dict = {}
    track_: dict = {}
    lasts: dict[int, int] = {}  # nanoseconds of a frame, by track

    def integer(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def real(a: int, b: int) -> float:
        return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0

    def add(a: int, b: int, key: bool | None) -> None:
        track, relative, flagged, parts = unlace(data, a, b)
        facts["laced"] += len(parts) > 1
        packets.extend((track, time + relative, at_, n, facts["clusters"], flagged if key is None else key, i) for i, (at_, n) in enumerate(parts))

    def close() -> None:
        kind = open_.pop()[0]
        if kind == GROUP and "block" in group:
            add(*group["block"], not group.get("refers"))
        elif kind == TRACK:
            lasts[track_.get(NUMBER, 0)] = track_.get(LASTS, 0)
        elif kind == CUE_AT:
            cue.setdefault("places", []).append((cue.pop(CUE_TRACK, 0), base + cue.pop(CUE_CLUSTER, 0)))
        elif kind == CUE:
            cues.extend((cue.get(CUE_TIME, 0), *p) for p in cue.get("places", ()))

    while True:
        while len(open_) > 1 and open_[-1][1] <= at:
            close()
        if at >= len(data):
            break
        kind, a = variable(data, at, True)
        n, a = variable(data, a, False)
        while open_[-1][2] and kind in (BESIDE_CLUSTER if open_[-1][0] == CLUSTER else {EBML, SEGMENT}):
            close()
        b = open_[-1][1] if n < 0 else a + n
        if b > open_[-1][1]:
            raise ValueError(f"element {kind:x} at byte {at} is longer than what holds it")
        at = b
        if kind in MASTERS:
            open_.append((kind, b, n < 0))
            at = a
            if kind == SEGMENT:
                base = a
            elif kind == CLUSTER:
                facts["clusters"] += 1
                time = 0
            elif kind == GROUP:
                group = {}
            elif kind == TRACK:
                track_ = {}
            elif kind == CUE:
                cue = {}
        elif kind == TIME:
            time = integer(a, b)
        elif kind == SIMPLE:
            add(a, b, None)
        elif kind == BLOCK:
            group["block"] = (a, b)
        elif kind == REFERENCE:
            group["refers"] = True
        elif kind in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
            cue[kind] = integer(a, b)
        elif kind in (NUMBER, LASTS):
            track_[kind] = integer(a, b)
        elif kind == SCALE:
            facts["scale"] = integer(a, b)
        elif kind == CODEC:
            facts["codec"] = data[a:b].decode("ascii", "replace")
        elif kind == RATE:
            facts["rate"] = real(a, b)
        elif kind == DURATION:
            facts["duration"] = real(a, b)
    while len(open_) > 1:
        close()
    scale = facts["scale"]
    packets = [(track, (ticks * scale + i * lasts.get(track, 0)) // 1_000_000, *rest) for track, ticks, *rest, i in packets]
    if scale != 1_000_000:
        cues = [(at_ * scale // 1_000_000, *rest) for at_, *rest in cues]
        facts["duration"] *= scale / 1_000_000
    return packets, cues, facts


def to_matroska(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pad: int = 64) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, padded with zeros to a positive multiple of `pad`, as a Matroska document.

    A null or empty text becomes `pad` zeros. Texts of any length are stored whole. Equal
    texts give equal media; repeated rows and null ids are stored like others. An empty
    table gives an empty result; other columns are not read.
    """

    def rows(ids, texts):
        data = [t.encode() for t in texts]
        return {"doc_id": ids, "n_bytes": [len(d) for d in data], "media": [mux(d + bytes((-len(d)) % pad or (0 if d else pad))) for d in data]}

    return per_document(id_and_text(docs, id_col, text_col), rows, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """One row for each packet of (doc_id, media): its track, timestamp in ms, byte offset and size, cluster and key flag.

    Null media have no packets; bytes that are no EBML document raise an error.
    """

    def rows(ids, blobs):
        out = [(i, *p) for i, b in zip(ids, blobs) if b for p in demux(b)[0]]
        columns = list(zip(*out)) or [()] * 7
        return dict(zip(("doc_id", "track", "time_ms", "offset", "size", "cluster", "key"), map(list, columns)))

    return per_document(media.select("doc_id", "media"), rows, "doc_id long, track int, time_ms long, offset long, size long, cluster int, key boolean")


def read_back(media: DataFrame) -> DataFrame:
    """Digests and a feature string of (doc_id, n_bytes, media), from the packets read back; n_bytes is passed on."""
    packed = media.select(F.struct("doc_id", "n_bytes").alias("doc_id"), "media")

    def rows(keys, blobs):
        out = []
        for key, blob in zip(keys, blobs):
            packets, cues, facts = demux(blob)
            payload = b"".join([blob[a : a + n] for _, _, a, n, _, _ in packets])
            mean = sum(payload) / len(payload) if payload else 0.0
            feature = f"{facts['codec']};rate={facts['rate']:.0f};ms={facts['duration']:.3f};packets={len(packets)};clusters={facts['clusters']};laced={facts['laced']};cues={len(cues)};last_ms={packets[-1][1] if packets else 0};mean={mean:.6f}"
            out.append((key["doc_id"], key["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
        return dict(zip(["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], map(list, zip(*out))))

    return per_document(packed, rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(to_matroska(table(spark, sf_dir, "documents")))
