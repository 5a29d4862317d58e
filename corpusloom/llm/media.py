"""Media columns: MPEG audio streams that carry a payload, and a parser for any MPEG audio.

The writer makes MPEG-1 Layer III frames (48 kHz, mono, with checksum) whose main data is the payload, behind an
ID3v2 tag and a frame with a variable-bitrate table. The parser takes arbitrary bytes: it skips tags, finds frame
headers again after damage, checks checksums, reads the table, and gives exact durations and seek offsets.
Both work row by row in Arrow batches: no shuffle, memory bounded by one batch. A null or empty text is a payload of
spaces; rows that repeat give equal streams; an empty table gives an empty result; a new name that the table has, in
whatever case, is an error.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.arrowmap import prefixed, with_arrow_columns

#: Payload unit: every payload is padded with spaces to a positive multiple of it.
UNIT = 192

# Fixed values of the MPEG audio formats (ISO/IEC 11172-3 and 13818-3): kbit/s by bitrate index 1 to 14, and Hz.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    crc: bool
    kbps: int
    rate: int
    padding: int
    mono: bool

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 1 else 576

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12_000 * self.kbps // self.rate + self.padding) * 4
        return self.samples * 125 * self.kbps // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


@lru_cache(4096)
def parse_header(four: bytes) -> Header | None:
    """The header in four bytes, or None. Free-format and reserved values count as none."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(four[1] >> 3 & 3)
    layer = 4 - (four[1] >> 1 & 3)
    index, rate = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3:
        return None
    kbps = BITRATES[1 if version == 1 else 2, layer][index - 1]
    return Header(version, layer, not four[1] & 1, kbps, SAMPLE_RATES[version][rate], four[2] >> 1 & 1, four[3] >> 6 == 3)


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    c = 0xFFFF
    for byte in data:
        c ^= byte << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1 & 0xFFFF
    return c


@lru_cache(64)
def _frame_head(kbps: int, crc: bool) -> bytes:
    """Header, checksum and empty side information of a 48 kHz mono Layer III frame."""
    head = bytes([0xFF, 0xFB if not crc else 0xFA, (BITRATES[1, 3].index(kbps) + 1) << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    return head + (crc16(head[2:] + side).to_bytes(2, "big") if crc else b"") + side


#: Payload units a frame holds, by kbit/s.
_HOLDS = {1: 80, 2: 160, 3: 224, 4: 320}


def pad(raw: bytes) -> bytes:
    """Spaces up to a positive multiple of the unit."""
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def write_stream(payload: bytes) -> bytes:
    """An MPEG stream whose frames' main data is ``payload`` (a positive multiple of the unit)."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of the unit")
    parts, offsets, at, place = [], [], 0, 192
    while at < len(payload):
        units = min(4, (len(payload) - at) // UNIT)
        kbps = _HOLDS[units]
        head, size = _frame_head(kbps, True), 3 * kbps
        chunk = payload[at : at + units * UNIT]
        parts += (head, chunk, bytes(size - len(head) - len(chunk)))
        offsets.append(place)
        place += size
        at += len(chunk)
    toc = bytes(min(255, offsets[k * len(offsets) // 100] * 256 // place) for k in range(100))
    table = _frame_head(64, False) + b"Xing" + (7).to_bytes(4, "big") + len(offsets).to_bytes(4, "big") + place.to_bytes(4, "big") + toc
    text = b"\x00payload\x00" + str(len(payload)).encode()
    frame = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    n = len(frame)
    tag = b"ID3\x03\x00\x00" + bytes(n >> s & 0x7F for s in (21, 14, 7, 0)) + frame
    return tag + table.ljust(192, b"\0") + b"".join(parts)


@dataclass
class Stream:
    """What the parser found. Offsets are bytes from the start of the media; the table frame isn't audio."""

    frames: int = 0
    samples: int = 0
    rate: int = 0
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0
    tags: dict = field(default_factory=dict)
    vbr: dict = field(default_factory=dict)
    kbps: set = field(default_factory=set)
    offsets: list = field(default_factory=list)
    main: list = field(default_factory=list)
    #: samples of the frames at one rate, by rate
    at_rate: dict = field(default_factory=dict)

    @property
    def seconds(self) -> float:
        return sum(n / r for r, n in sorted(self.at_rate.items()))


def _id3v2(media: bytes, at: int, out: Stream) -> int:
    """The byte after an ID3v2 tag at ``at``; its text frames go to ``out.tags``."""
    size = 0
    for b in media[at + 6 : at + 10]:
        size = size << 7 | b & 0x7F
    version, end, p = media[at + 3], min(len(media), at + 10 + size), at + 10
    while version in (3, 4) and p + 10 <= end and media[p : p + 4].isalnum():
        n = 0
        for b in media[p + 4 : p + 8]:
            n = n << (7 if version == 4 else 8) | b
        body = media[p + 10 : min(end, p + 10 + n)]
        if media[p : p + 1] == b"T" and body:
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3], "replace")
            out.tags[media[p : p + 4].decode()] = text.replace("\0", "=").strip("=")
        p += 10 + n
    return at + 10 + size + (10 if media[at + 5] & 0x10 else 0)


def _vbr_table(frame: bytes, h: Header) -> dict:
    """The variable-bitrate table of a frame, or an empty dict."""
    for skip in (0, 2):
        p = 4 + skip + h.side
        if frame[p : p + 4] in (b"Xing", b"Info"):
            out, flags, q = {"kind": frame[p : p + 4].decode()}, int.from_bytes(frame[p + 4 : p + 8], "big"), p + 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[q : q + 4], "big")
                    q += 4
            if flags & 4:
                out["toc"] = list(frame[q : q + 100])
            return out
    if frame[36:40] == b"VBRI":
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big")}
    return {}


def read_stream(media: bytes) -> Stream:
    """Parse any bytes. A header counts if the next one follows it, if the media or a tag ends there."""
    out, at, end = Stream(), 0, len(media)
    # an ID3v1 tag counts only where no frame lies over it: a payload may hold its name
    last = end - 128 if media[-128:-125] == b"TAG" else end
    synced = False
    while at < end:
        if at == last:
            out.tags["ID3v1"] = media[at + 3 : at + 33].rstrip(b"\0 ").decode("latin-1")
            break
        if media[at : at + 3] == b"ID3" and at + 10 <= end:
            at = _id3v2(media, at, out)
            continue
        h = parse_header(media[at : at + 4])
        nxt = at + h.size if h else 0
        follows = h is not None and (nxt in (last, end) or media[nxt : nxt + 3] == b"ID3" or parse_header(media[nxt : nxt + 4]) is not None)
        good = h is not None and nxt <= end and (follows or (synced and nxt < last))
        if not good:
            synced = False
            sync = media.find(b"\xff", at + 1, end)
            sync = end if sync < 0 else sync
            sync = last if at < last < sync else sync
            tag = media.find(b"ID3", at + 1, sync)
            step = sync if tag < 0 else tag
            out.skipped += step - at
            at = step
            continue
        synced = True
        if not out.frames and not out.vbr and (table := _vbr_table(media[at:nxt], h)):
            out.vbr = table
            at = nxt
            continue
        body = at + 4 + 2 * h.crc + h.side
        if h.crc and h.layer == 3:
            ok = crc16(media[at + 2 : at + 4] + media[at + 6 : at + 6 + h.side]) == int.from_bytes(media[at + 4 : at + 6], "big")
            out.crc_ok += ok
            out.crc_bad += not ok
        out.frames += 1
        out.samples += h.samples
        out.at_rate[h.rate] = out.at_rate.get(h.rate, 0) + h.samples
        out.rate = out.rate or h.rate
        out.kbps.add(h.kbps)
        out.offsets.append(at)
        out.main.append((body, nxt, h.kbps))
        at = nxt
    return out


_UNITS_OF = {v: k for k, v in _HOLDS.items()}


def read_payload(media: bytes, stream: Stream) -> bytes:
    """The payload that ``write_stream`` put into the frames' main data."""
    return b"".join(media[a : a + _UNITS_OF[kbps] * UNIT] for a, _, kbps in stream.main)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def store_media(df: DataFrame, text_col: str = "text", media_col: str = "media", keep_text: bool = False) -> DataFrame:
    """``df`` with the UTF-8 of a text column (null: empty) stored as an MPEG stream in a binary column."""

    def make():
        def work(batch):
            texts = _column(batch, text_col).cast(pa.binary())
            return [pa.array((write_stream(pad(t.as_py() or b"")) for t in texts), pa.binary())]

        return work

    return with_arrow_columns(df, make, [T.StructField(media_col, T.BinaryType())], [] if keep_text else [text_col])


PROBE = [
    ("frames", T.LongType()), ("samples", T.LongType()), ("sample_rate", T.LongType()), ("seconds", T.DoubleType()), ("crc_ok", T.LongType()),
    ("crc_bad", T.LongType()), ("skipped_bytes", T.LongType()), ("tags", T.StringType()), ("vbr", T.StringType()), ("seek_offsets", T.ArrayType(T.LongType())),
]


def probe_media(df: DataFrame, media_col: str = "media", prefix: str = "") -> DataFrame:
    """``df`` plus what the parser finds in a binary column. Null or foreign bytes: no frames, nothing fails."""

    def make():
        def work(batch):
            rows = []
            for m in _column(batch, media_col):
                s = read_stream(m.as_py() or b"")
                rows.append((s.frames, s.samples, s.rate, s.seconds, s.crc_ok, s.crc_bad, s.skipped, json.dumps(s.tags, sort_keys=True), json.dumps(s.vbr, sort_keys=True), s.offsets))
            cols = list(zip(*rows, strict=True)) or [()] * len(PROBE)
            kinds = [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.int64())]
            return [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]

        return work

    return with_arrow_columns(df, make, prefixed(PROBE, prefix))


DIGEST = [
    ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()),
    ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("duration_samples", T.LongType()), ("seek_offsets", T.ArrayType(T.LongType())),
]


def media_digests(df: DataFrame, size_col: str, media_col: str = "media") -> DataFrame:
    """Read the stored streams back: payload and media digests, and a feature string. The media column goes."""

    def make():
        def work(batch):
            rows = []
            for n, m in zip(_column(batch, size_col).to_pylist(), _column(batch, media_col), strict=True):
                media = m.as_py()
                s = read_stream(media)
                payload = read_payload(media, s)
                seek = hashlib.sha256(",".join(map(str, s.offsets)).encode()).hexdigest()[:16]
                feature = (
                    f"mpeg1-l3 {s.rate} Hz; frames {s.frames}; samples {s.samples}; crc ok {s.crc_ok} bad {s.crc_bad}; "
                    f"kbps {'/'.join(map(str, sorted(s.kbps)))}; vbr frames {s.vbr.get('frames')}; skipped {s.skipped}; seek {seek}"
                )
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, s.samples, s.offsets))
            cols = list(zip(*rows, strict=True)) or [()] * len(DIGEST)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
            return [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]

        return work

    return with_arrow_columns(df, make, [T.StructField(n, t) for n, t in DIGEST], [size_col, media_col])


def op10_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every document stored as an MPEG stream, read back and described."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("__loom_size"))
    return media_digests(store_media(docs), "__loom_size")
