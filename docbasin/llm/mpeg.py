"""MPEG audio: a parser for streams of frames with tags and variable-bitrate tables, and a writer of payload streams.

`parse` resynchronises on frame headers (a header counts if the next frame follows where it says, or the data end
there), reads ID3v2 (2.2 to 2.4, with extended headers and unsynchronised) and ID3v1 tags and the Xing, Info or VBRI
table of the first frame, checks the CRC-16 of protected frames of all three layers and the music and tag CRCs that
follow a Xing table, and gives exact durations (samples over sample rate) and the byte offset of each frame for seeking.

`write` stores bytes as MPEG-1 Layer III frames: the payload, padded with bytes 255 to whole units of 576 bytes, is the
main data of protected frames of 672 bytes (224 kbit/s at 48 kHz: header 4, CRC 2, side information 32, room 634). A first
frame has the Xing table; its extension has the length and CRC-16 of the music. An ID3v2 tag gives the unpadded length.
`payload` reads it back.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docbasin.llm.common import arrow, pieces, read

# Fixed values of the MPEG audio standards (ISO 11172-3, 13818-3): kbit/s by bitrate index, Hz by rate index.
KBPS = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
HZ = {0: [11025, 12000, 8000], 2: [22050, 24000, 16000], 3: [44100, 48000, 32000]}
#: Bits of the allocation of each subband in Layer II, by bitrate for a channel and sample rate.
LAYER2 = {"all": [4] * 11 + [3] * 12 + [2] * 7, "some": [4] * 11 + [3] * 12 + [2] * 4, "few": [4] * 2 + [3] * 6, "few at 32000": [4] * 2 + [3] * 10, "lsf": [4] * 4 + [3] * 7 + [2] * 19}
UNIT, FRAME, HEAD = 576, 672, 38
HEADER = bytes([0xFF, 0xFA, 0xC4, 0x00])  # MPEG-1, Layer III, protected, 224 kbit/s, 48 kHz, stereo


@dataclass
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    hz: int
    length: int
    samples: int
    side: int


@dataclass
class Audio:
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    skipped: int = 0
    bad_crc: int = 0
    samples: int = 0
    seconds: Fraction = Fraction(0)


@lru_cache(maxsize=4096)
def header(word: int) -> Header | None:
    """What a frame header says; None if the four bytes are none (free format is not taken for one)."""
    if word >> 21 != 0x7FF:
        return None
    version, layer, rate, hz = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    mpeg1, mono, pad = version == 3, word >> 6 & 3 == 3, word >> 9 & 1
    kbps, f = KBPS[1 if mpeg1 else 2, layer][rate], HZ[version][hz]
    samples = 384 if layer == 1 else 1152 if layer == 2 or mpeg1 else 576
    length = (12 * kbps * 1000 // f + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // f + pad
    side = 0 if layer < 3 else (17 if mono else 32) if mpeg1 else (9 if mono else 17)
    return Header(version, layer, not word >> 16 & 1, kbps, f, length, samples, side)


def _table(poly: int, reflected: bool) -> list[int]:
    out = []
    for byte in range(256):
        c = byte if reflected else byte << 8
        for _ in range(8):
            c = (c >> 1 ^ (poly if c & 1 else 0)) if reflected else (c << 1 ^ (poly if c & 0x8000 else 0)) & 0xFFFF
        out.append(c)
    return out


#: Frames: x^16 + x^15 + x^2 + 1, high bit first, from 0xFFFF. Music and tag: the same polynomial, low bit first, from 0.
FRAME_CRC, MUSIC_CRC = _table(0x8005, False), _table(0xA001, True)
MUSIC_ARRAY = np.array(MUSIC_CRC, np.uint16)


def frame_crc(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ FRAME_CRC[c >> 8 ^ b]
    return c


SILENT_CRC = frame_crc(HEADER[2:] + bytes(32))


@lru_cache(maxsize=64)
def _over_zeros(length: int) -> np.ndarray:
    """What each 16-bit remainder becomes over `length` zero bytes."""
    c = np.arange(65536, dtype=np.uint16)
    for _ in range(length):
        c = (c >> 8) ^ MUSIC_ARRAY[c & 255]
    return c


def music_crc(streams: list[list[tuple[bytes, int]]]) -> list[int]:
    """CRC-16 of each list of frames: all frames of a length advance together, then their remainders are chained."""
    single: dict[tuple[int, int], int] = {}
    by: dict[int, list[tuple[int, int]]] = {}
    for s, frames in enumerate(streams):
        for k, (_, n) in enumerate(frames):
            by.setdefault(n, []).append((s, k))
    for n, keys in by.items():
        block = np.frombuffer(b"".join(streams[s][k][0] for s, k in keys), np.uint8).reshape(len(keys), n)
        c = np.zeros(len(keys), np.uint16)
        for column in np.ascontiguousarray(block.T):
            c = (c >> 8) ^ MUSIC_ARRAY[(c ^ column) & 255]
        single.update(zip(keys, c.tolist(), strict=True))
    out = []
    for s, frames in enumerate(streams):
        c = 0
        for k, (_, n) in enumerate(frames):
            c = int(_over_zeros(n)[c]) ^ single[s, k]
        out.append(c)
    return out


def _fields(word: int, h: Header, bits: int, at: int) -> int:
    """How many bits behind the header a Layer I or II frame's CRC covers: its bit allocation, in Layer II also the scale factor selection.

    `bits` are the data behind the CRC as one number of `at` bits. Subbands from the bound on share one allocation in
    joint stereo.
    """
    mode, channels = word >> 6 & 3, 1 if word >> 6 & 3 == 3 else 2
    if h.layer == 1:
        widths = [4] * 32
    else:
        each = h.kbps // channels
        if h.version != 3:
            widths = LAYER2["lsf"]
        elif each <= 48:
            widths = LAYER2["few at 32000" if h.hz == 32000 else "few"]
        else:
            widths = LAYER2["some" if h.hz == 48000 or each <= 80 else "all"]
    bound = min(4 * ((word >> 4 & 3) + 1), len(widths)) if mode == 1 else len(widths)
    used = chosen = 0
    for band, width in enumerate(widths):
        for _ in range(channels if band < bound else 1):
            used += width
            value = bits >> at - used & (1 << width) - 1 if at >= used else 0
            chosen += 2 * bool(value) * (channels if band >= bound else 1)
    return used + (chosen if h.layer == 2 else 0)


def covered_crc(data: bytes, begin: int, h: Header) -> int:
    """The CRC-16 that a protected frame at `begin` should have."""
    head, body = data[begin + 2 : begin + 4], begin + 6
    if h.layer == 3:
        return frame_crc_cached(head + data[body : body + h.side])
    rest = data[body : min(begin + h.length, body + 80)]
    n = _fields(int.from_bytes(data[begin : begin + 4], "big"), h, int.from_bytes(rest, "big"), 8 * len(rest))
    c = frame_crc(head + rest[: n // 8])
    for i in range(n // 8 * 8, n):
        bit = rest[i // 8] >> 7 - i % 8 & 1
        c = (c << 1 & 0xFFFF) ^ (0x8005 if c >> 15 ^ bit else 0)
    return c


def _size(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def _framed(data: bytes, at: int) -> bool:
    """Whether whole frames, one behind the other, fill the data from `at` to their end."""
    while at + 4 <= len(data) and (h := header(int.from_bytes(data[at : at + 4], "big"))):
        at += h.length
    return at == len(data)


def _id3v2(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of a tag at the beginning, and where it ends. A damaged frame ends the reading of frames."""
    tags: dict[str, str] = {}
    version, flags = data[3], data[5]
    end = min(10 + _size(data[6:10]) + 10 * bool(flags & 0x10), len(data))
    body = data[10 : min(10 + _size(data[6:10]), len(data))]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and version > 2:
        at = _size(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    name_size, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= len(body) and body[at : at + name_size].strip(b"\0"):
        name, size = body[at : at + name_size].decode("latin-1"), body[at + name_size : at + 2 * name_size]
        n = _size(size) if version == 4 else int.from_bytes(size, "big")
        content = body[at + head : at + head + n]
        if n <= 0 or at + head + n > len(body):
            break
        if version == 4 and (flags & 0x80 or body[at + 9] & 2):
            content = content.replace(b"\xff\x00", b"\xff")
        if name[0] == "T" and content:
            text = content[1:].decode(["latin-1", "utf-16", "utf-16-be", "utf-8"][content[0] & 3], "replace").rstrip("\0")
            key, _, rest = text.partition("\0")
            own = name in ("TXXX", "TXX")
            tags[f"TXXX:{key}" if own else name] = rest if own else text
        at += head + n
    return tags, end


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Tags, and where the frames begin and end. Damaged tags end the reading of tags, not of the stream."""
    tags, begin, end = {}, 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10:
        tags, begin = _id3v2(data)
    if end - begin >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags[f"id3v1:{name}"] = value
    return tags, begin, end


def parse(data: bytes) -> Audio:
    audio = Audio()
    audio.tags, at, end = _tags(data)
    begin, synced = at, False
    while at + 4 <= end:
        h = header(int.from_bytes(data[at : at + 4], "big"))
        after = at + h.length if h else 0
        if h and after > end and end < len(data) and (synced or at == begin) and _framed(data, at):
            # What looks like an ID3v1 tag is the inside of the last frames.
            end, audio.tags = len(data), {k: v for k, v in audio.tags.items() if not k.startswith("id3v1:")}
        if h and after <= end and (synced or after + 4 > end or header(int.from_bytes(data[after : after + 4], "big"))):
            body = at + 4 + 2 * h.protected
            if h.protected and covered_crc(data, at, h) != int.from_bytes(data[at + 4 : at + 6], "big"):
                audio.bad_crc += 1
            mark, first = body + h.side, not audio.offsets and audio.table is None and h.layer == 3
            if first and data[mark : mark + 4] in (b"Xing", b"Info"):
                audio.table = _vbr(data[at:after], mark - at)
            elif first and data[at + 36 : at + 40] == b"VBRI" and after - at >= 62:
                audio.table = _vbri(data[at:after])
            else:
                audio.offsets.append(at)
                audio.headers.append(h)
                audio.samples += h.samples
            at, synced = after, True
            continue
        # Resynchronise: on to the next byte 255.
        synced = False
        to = data.find(b"\xff", at + 1, end)
        to = end if to < 0 else to
        audio.skipped += to - at
        at = to
    audio.skipped += max(0, end - at)
    by: dict[int, int] = {}
    for h in audio.headers:
        by[h.hz] = by.get(h.hz, 0) + h.samples
    audio.seconds = sum((Fraction(n, hz) for hz, n in by.items()), Fraction(0))
    return audio


@lru_cache(maxsize=4096)
def frame_crc_cached(data: bytes) -> int:
    return frame_crc(data)


def _vbr(frame: bytes, at: int) -> dict:
    flags, i = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
    table: dict = {"kind": frame[at : at + 4].decode()}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            table[name] = int.from_bytes(frame[i : i + 4], "big")
            i += 4
    if flags & 4:
        table["toc"] = list(frame[i : i + 100])
        i += 100
    if flags & 8:
        table["quality"] = int.from_bytes(frame[i : i + 4], "big")
        i += 4
    if len(frame) >= i + 36 and frame[i : i + 9].strip(b"\0"):
        table["music_bytes"], table["music_crc"], table["tag_crc"] = struct.unpack(">IHH", frame[i + 28 : i + 36])
        c = 0
        for b in frame[: i + 34]:
            c = c >> 8 ^ MUSIC_CRC[(c ^ b) & 255]
        table["tag_ok"] = c == table["tag_crc"]
    return table


def _vbri(frame: bytes) -> dict:
    """The other kind of table: 32 bytes behind the header, with an entry's size and scale."""
    _, delay, quality, size, frames, entries, scale, width, each = struct.unpack(">HHHIIHHHH", frame[40:62])
    toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries) if 62 + (i + 1) * width <= len(frame)]
    return {"kind": "VBRI", "frames": frames, "bytes": size, "quality": quality, "delay": delay, "toc": toc, "frames_per_entry": each}


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def write(texts: list[bytes]) -> list[bytes]:
    """A stream for each text; equal texts give equal streams."""
    bodies = []
    for text in texts:
        units = np.frombuffer(padded(text), np.uint8).reshape(-1, UNIT)
        frames = np.zeros((len(units), FRAME), np.uint8)
        frames[:, :4] = np.frombuffer(HEADER, np.uint8)
        frames[:, 4], frames[:, 5] = SILENT_CRC >> 8, SILENT_CRC & 255
        frames[:, HEAD : HEAD + UNIT] = units
        bodies.append(frames.tobytes())
    crcs = music_crc([[(b[i : i + FRAME], FRAME) for i in range(0, len(b), FRAME)] for b in bodies])
    out = []
    for text, body, crc in zip(texts, bodies, crcs, strict=True):
        n = len(body) // FRAME
        total = (n + 1) * FRAME
        toc = bytes(min(255, (i * n // 100 + 1) * FRAME * 256 // total) for i in range(100))
        first = HEADER + SILENT_CRC.to_bytes(2, "big") + bytes(32) + b"Xing" + struct.pack(">III", 15, n, total) + toc + bytes(4)
        first += b"docbasin1" + bytes(19) + struct.pack(">IH", len(body), crc)
        c = 0
        for b in first:
            c = c >> 8 ^ MUSIC_CRC[(c ^ b) & 255]
        first = (first + c.to_bytes(2, "big")).ljust(FRAME, b"\0")
        tag = b"\x03bytes\x00" + str(len(text)).encode()
        tag = b"TXXX" + bytes([0, 0, 0, len(tag), 0, 0]) + tag
        out.append(b"ID3\x04\x00\x00" + bytes([0, 0, 0, len(tag)]) + tag + first + body)
    return out


def payload(data: bytes, audio: Audio) -> bytes:
    """The padded payload, out of the stored bytes."""
    places = ((o + 4 + 2 * h.protected + h.side, o + h.length) for o, h in zip(audio.offsets, audio.headers, strict=True))
    return b"".join(data[b : min(b + UNIT, e)] for b, e in places)


def features(audio: Audio, music: int | None) -> str:
    """Deterministic text of what was measured."""
    t = audio.table or {}
    kbps = [h.kbps for h in audio.headers]
    seconds = f"{audio.seconds.numerator}/{audio.seconds.denominator}"
    checks = [audio.bad_crc == 0, t.get("frames") in (None, len(kbps)), t.get("tag_ok", True), music is None or t.get("music_crc") in (None, music)]
    last = audio.offsets[-1] if audio.offsets else -1
    return f"frames={len(kbps)};samples={audio.samples};seconds={seconds};hz={audio.headers[0].hz if kbps else 0};kbps={min(kbps, default=0)}-{max(kbps, default=0)};table={t.get('kind', 'none')};last={last};skipped={audio.skipped};checks={''.join('01'[x] for x in checks)}"


def probe(media: DataFrame, column: str = "media") -> DataFrame:
    """(doc_id, binary column) -> doc_id, frames, samples, seconds (double), seek (offset of each frame), tags, bad_crc, skipped, feature.

    Null and empty media have no frames. Each row is parsed by itself; other columns are ignored.
    """
    schema = "doc_id long, frames long, samples long, seconds double, seek array<long>, tags map<string,string>, bad_crc long, skipped long, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, column):
            found = [parse(d or b"") for d in piece[column].to_pylist()]
            crcs = music_crc([[(d[o : o + h.length], h.length) for o, h in zip(a.offsets, a.headers, strict=True)] for d, a in zip((x or b"" for x in piece[column].to_pylist()), found, strict=True)])
            rows = [[len(a.offsets), a.samples, float(a.seconds), a.offsets, list(a.tags.items()), a.bad_crc, a.skipped, features(a, c)] for a, c in zip(found, crcs, strict=True)]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.map_(pa.string(), pa.string()), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([piece["doc_id"].cast(pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=[f.split()[0] for f in re.split(r", (?=\w+ )", schema)])

    return arrow(media.select("doc_id", column)).mapInArrow(run, schema)


def store(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, media: each whole text as a stream; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            media = write([(t or "").encode() for t in piece["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([piece["doc_id"].cast(pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return arrow(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, media binary")


def digest(docs: DataFrame) -> DataFrame:
    """Stores every text, reads the stored bytes back and gives their digests (see op9's contract), exact duration and frame offsets. One pass, no shuffle.

    Null and empty texts have a payload of one unit of bytes 255. Equal texts give equal values, whatever else the
    rows hold.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "seek"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            media = write([(t or "").encode() for t in piece["text"].to_pylist()])
            found = [parse(d) for d in media]
            crcs = music_crc([[(d[o : o + h.length], h.length) for o, h in zip(a.offsets, a.headers, strict=True)] for d, a in zip(media, found, strict=True)])
            rows = []
            for d, a, c in zip(media, found, crcs, strict=True):
                back = payload(d, a)
                rows.append((int(a.tags["TXXX:bytes"]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(d), hashlib.sha256(d).hexdigest(), features(a, c), float(a.seconds), a.offsets))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([piece["doc_id"].cast(pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=names)

    return arrow(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, seek array<long>")


def op9_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))
