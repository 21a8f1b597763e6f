"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, durations and seek offsets."""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weft.llm.common import frame_udf
from weft.plans.runtime import ship

# Fixed values of the MPEG audio format.
#: kbit/s by (MPEG-1?, layer), by index 1 to 14.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Hz by version bits, by index.
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
#: Names of the text frames that have another name in the three-letter tags of old.
OLD_FRAMES = {"TT2": "TIT2", "TP1": "TPE1", "TAL": "TALB", "TLE": "TLEN", "TRK": "TRCK", "TYE": "TYER"}

#: Header of the frames that hold payloads: MPEG-1, layer III, with a checksum; 32 kHz, mono.
PAYLOAD_RATE, SIDE_BYTES, OWNER = 32000, 17, b"weft.payload\0"
FRAME_OVERHEAD = 4 + 2 + SIDE_BYTES
BLOCK = 64


class Header:
    """What the four bytes of a frame's header say; ``length`` is the whole frame's bytes."""

    __slots__ = ("version", "layer", "guarded", "kbps", "rate", "channels", "mode", "extension", "samples", "length", "side")

    def __init__(self, version, layer, guarded, kbps, rate, padded, mode, extension):
        self.version, self.layer, self.guarded, self.kbps, self.rate = version, layer, guarded, kbps, rate
        self.mode, self.extension, self.channels = mode, extension, 1 if mode == 3 else 2
        first = version == 3
        self.samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
        slot = 4 if layer == 1 else 1
        self.length = (self.samples // 8 * kbps * 1000 // (rate * slot) + padded) * slot
        self.side = 0 if layer != 3 else (17 if self.channels == 1 else 32) if first else (9 if self.channels == 1 else 17)


@lru_cache(maxsize=65536)
def read_header(four: bytes) -> Header | None:
    """None where the bytes aren't a header (or of free format, whose length isn't stated)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bitrate, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    kbps = BITRATES[version == 3, layer][bitrate - 1]
    return Header(version, layer, not four[1] & 1, kbps, RATES[version][rate], four[2] >> 1 & 1, four[3] >> 6, four[3] >> 4 & 3)


def _crc_table() -> list[int]:
    table = []
    for top in range(256):
        value = top << 8
        for _ in range(8):
            value = (value << 1) ^ (0x8005 if value & 0x8000 else 0)
        table.append(value & 0xFFFF)
    return table


CRC = _crc_table()


@lru_cache(maxsize=4096)
def checksum(covered: bytes, bits: int) -> int:
    """CRC-16 (polynomial 0x8005, start 0xFFFF) of the first ``bits`` of ``covered``."""
    value = 0xFFFF
    for byte in covered[: bits // 8]:
        value = (value << 8 & 0xFFFF) ^ CRC[value >> 8 ^ byte]
    for k in range(bits % 8):
        bit = covered[bits // 8] >> (7 - k) & 1
        value = (value << 1 & 0xFFFF) ^ (0x8005 if (value >> 15) ^ bit else 0)
    return value


#: Of layer II, the widths of the bit allocations, as (subbands, bits) runs, by table.
ALLOCATIONS = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "lower rates": ((4, 4), (7, 3), (19, 2)),
}


def _allocation_widths(head: Header) -> list[int]:
    """Bits of each subband's allocation in layer II: by version, rate and bit rate of a channel."""
    each = head.kbps // head.channels
    if head.version != 3:
        name = "lower rates"
    elif each <= 48:
        name = "d" if head.rate == 32000 else "c"
    else:
        name = "a" if each <= 80 or head.rate == 48000 else "b"
    return [bits for n, bits in ALLOCATIONS[name] for _ in range(n)]


def _guard_bits(head: Header, body: bytes) -> int | None:
    """Bits after the checksum that it covers; None where ``body``, what follows it, is too short to tell.

    In layer II these are the allocations, of one channel from the joint subbands on, and two bits for
    each subband that has any.
    """
    if head.layer == 3:
        return 8 * head.side
    bound = 4 * (head.extension + 1) if head.mode == 1 else 32
    if head.layer == 1:
        return 4 * (bound * head.channels + (32 - bound))
    bits, at, used = int.from_bytes(body[:64], "big"), 0, 0
    size = 8 * len(body[:64])
    for band, width in enumerate(_allocation_widths(head)):
        shared = head.channels == 2 and band >= bound
        for _ in range(1 if shared else head.channels):
            if at + width > size:
                return None
            value = bits >> (size - at - width) & ((1 << width) - 1)
            at += width
            used += (head.channels if shared else 1) * (value > 0)
    return at + 2 * used


def _verify(media: bytes, at: int, head: Header) -> bool | None:
    """Whether a frame's checksum is right; None where there is none, or the frame is too short for it."""
    bits = _guard_bits(head, media[at + 6 : at + head.length]) if head.guarded else None
    if bits is None or 6 + (bits + 7) // 8 > head.length:
        return None
    body = media[at + 2 : at + 4] + media[at + 6 : at + 6 + (bits + 7) // 8]
    return checksum(body, 16 + bits) == int.from_bytes(media[at + 4 : at + 6], "big")


def _syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _text(raw: bytes) -> str:
    if not raw:
        return ""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0], "latin-1")
    return raw[1:].decode(kind, "replace").rstrip("\0")


def read_tags(media: bytes) -> tuple[dict, bytes | None, int, int]:
    """Tags, the payload note of this module if any, and where the frames begin and end."""
    tags, note, begin, end = {}, None, 0, len(media)
    if len(media) - 128 >= 0 and media[-128:-125] == b"TAG":
        end -= 128
        for name, at, n in (("TIT2", 3, 30), ("TPE1", 33, 30), ("TALB", 63, 30), ("TYER", 93, 4)):
            if value := media[end + at : end + at + n].split(b"\0")[0].decode("latin-1").rstrip():
                tags[name] = value
    while media[begin : begin + 3] == b"ID3" and begin + 10 <= end:
        major, flags, size = media[begin + 3], media[begin + 5], _syncsafe(media[begin + 6 : begin + 10])
        body = media[begin + 10 : min(end, begin + 10 + size)]
        if flags & 0x80 and major < 4:
            body = body.replace(b"\xff\0", b"\xff")
        at = 0
        if flags & 0x40 and major > 2 and len(body) >= 4:
            at = _syncsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
        id_len, head = (3, 6) if major == 2 else (4, 10)
        while at + head <= len(body) and body[at]:
            name = body[at : at + id_len].decode("latin-1")
            raw = body[at + id_len : at + id_len + (3 if major == 2 else 4)]
            n = _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
            value = body[at + head : at + head + n]
            at += head + n
            if name[0] == "T":
                tags[OLD_FRAMES.get(name, name)] = _text(value)
            elif name == "PRIV" and value.startswith(OWNER):
                note = value[len(OWNER) :]
        begin = min(end, begin + 10 + size + (10 if major == 4 and flags & 0x10 else 0))
    return tags, note, begin, end


def read_rate_table(frame: bytes, head: Header) -> dict | None:
    """The variable-bitrate table of a first frame: kind, frames, bytes and table of contents, if it has one."""
    at = 4 + (2 if head.guarded else 0) + head.side
    for place in (at, 4 + head.side):
        if frame[place : place + 4] in (b"Xing", b"Info") and len(frame) >= place + 8:
            flags = int.from_bytes(frame[place + 4 : place + 8], "big")
            out = {"kind": frame[place : place + 4].decode(), "frames": None, "bytes": None, "toc": None}
            place += 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[place : place + 4], "big")
                    place += 4
            if flags & 4:
                out["toc"] = list(frame[place : place + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        toc = [int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") * scale for k in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


def scan(media: bytes, payload: bool = False) -> dict:
    """All that the columns hold; see ``media_columns``. ``payload``: also the bytes that ``store`` put in."""
    tags, note, at, end = read_tags(media)
    seek, parts, table, first, kept = [], [], None, None, None
    samples = skipped = good = bad = unchecked = wire = 0
    synced = False
    while at + 4 <= end:
        head = read_header(media[at : at + 4])
        fits = head is not None and at + head.length <= end
        if fits and first is not None:
            fits = (head.version, head.layer, head.rate) == (first.version, first.layer, first.rate)
        if fits and kept is not None:
            fits = head.guarded == kept.guarded and head.channels == kept.channels
        if fits:
            # A sync word in other data is seldom followed by another header. The last frame before a
            # gap isn't either: in step, a right checksum will do, or that there is none to verify.
            nxt = read_header(media[at + head.length : at + head.length + 4]) if at + head.length + 4 <= end else head
            fits = nxt is not None and (nxt.version, nxt.layer, nxt.rate) == (head.version, head.layer, head.rate)
            fits = fits or (synced and _verify(media, at, head) is not False)
        if not fits:
            synced = False
            step = media.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            skipped += step - at
            at = step
            continue
        synced = True
        frame = media[at : at + head.length]
        if first is None:
            first = head
            table = read_rate_table(frame, head)
            if table is not None:
                at += head.length
                continue
        right = _verify(media, at, head)
        good, bad, unchecked = good + (right is True), bad + (right is False), unchecked + (right is None)
        kept = head
        seek.append(at)
        samples += head.samples
        wire += head.length
        if payload:
            parts.append(frame[4 + (2 if head.guarded else 0) + head.side :])
        at += head.length
    skipped += end - at
    out = {
        "version": VERSIONS[first.version] if first else None, "layer": first.layer if first else None,
        "sample_rate": first.rate if first else None, "channels": first.channels if first else None,
        "n_frames": len(seek), "n_samples": samples, "duration": samples / first.rate if first else 0.0,
        "frame_bytes": wire, "skipped_bytes": skipped, "crc_good": good, "crc_bad": bad, "crc_none": unchecked,
        "rate_table": table, "tags": tags, "seek": seek,
    }
    if payload:
        whole = b"".join(parts)
        out["payload"] = whole[: int.from_bytes(note[:8], "big")] if note else whole
    return out


def _payload_header(index: int) -> bytes:
    return bytes((0xFF, 0xFA, index << 4 | 2 << 2, 3 << 6))


def _frame_room(index: int) -> int:
    return read_header(_payload_header(index)).length - FRAME_OVERHEAD


def store(payload: bytes) -> bytes:
    """``payload`` as an MPEG-1 layer III stream of silence, whose frames carry it as ancillary data.

    Side information is zero, so each frame's granules are empty and a decoder skips what follows.
    Full frames have the highest bitrate; the last has the lowest that holds the rest, so the stream
    is of variable bitrate and opens with a Xing table. Tags tell the duration and the payload's bytes.
    """
    full, side = _frame_room(14), bytes(SIDE_BYTES)
    frames = []
    for at in range(0, len(payload), full):
        part = payload[at : at + full]
        index = 14 if len(part) == full else next(k for k in range(1, 15) if _frame_room(k) >= len(part))
        head = _payload_header(index)
        crc = checksum(head[2:] + side, 16 + 8 * SIDE_BYTES)
        frames.append(head + crc.to_bytes(2, "big") + side + part.ljust(_frame_room(index), b"\0"))
    table_head = bytes((0xFF, 0xFB, 5 << 4 | 2 << 2, 3 << 6))
    table_len = read_header(table_head).length
    total = table_len + sum(map(len, frames))
    ends = [table_len]
    for frame in frames:
        ends.append(ends[-1] + len(frame))
    toc = bytes(min(255, 256 * ends[k * len(frames) // 100] // total) for k in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    table = (table_head + side + xing).ljust(table_len, b"\0")
    length_ms = len(frames) * 1152 * 1000 // PAYLOAD_RATE
    body = b"".join(
        name + struct.pack(">IH", len(value), 0) + value
        for name, value in ((b"TLEN", b"\0" + str(length_ms).encode()), (b"PRIV", OWNER + struct.pack(">Q", len(payload))))
    )
    size = bytes(len(body) >> shift & 127 for shift in (21, 14, 7, 0))
    closing = (b"TAG" + b"payload".ljust(30, b"\0")).ljust(127, b"\0") + b"\xff"
    return b"ID3\3\0\0" + size + body + table + b"".join(frames) + closing


def padded_payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0")


COLUMNS = (
    "version string, layer int, sample_rate int, channels int, n_frames long, n_samples long, duration double, "
    "frame_bytes long, skipped_bytes long, crc_good long, crc_bad long, crc_none long, "
    "rate_table struct<kind:string,frames:long,bytes:long,toc:array<int>>, tags map<string,string>, seek array<long>"
)


def media_struct(media: Column) -> Column:
    """The columns of ``media_columns`` as one struct."""

    def scanned(values: pd.Series) -> pd.DataFrame:
        rows = [scan(bytes(v)) if v is not None else None for v in values]
        names = [part.split()[0] for part in COLUMNS.split(", ")]
        return pd.DataFrame([{n: (r or {}).get(n) for n in names} for r in rows], columns=names).astype(object)

    return frame_udf(scanned, COLUMNS)(media)


def media_columns(df: DataFrame, media: str = "media", into: str = "audio") -> DataFrame:
    """``df`` with the struct ``into`` for its binary column ``media``; a column of that name is replaced.

    Frames are found by header and, after any other data, by a header that is followed by another;
    bytes passed over are counted. Tags are ID3v1 and ID3v2; rate tables Xing, Info and VBRI. The
    checksum is verified in layers I and III. ``duration`` is n_samples over sample_rate, and ``seek``
    has each frame's byte offset. A null has null fields; empty bytes, or ones without frames, have no
    frames and duration 0. A row's work and memory grow with its own bytes only.
    """
    ship(df.sparkSession)
    return df.withColumn(into, media_struct(F.col(media)))


def stored_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``stored``: the text's payload as MPEG audio, and what reading it back gives.

    A struct of n_bytes, media, payload (read back), and feature, a line of the scan's figures. A null
    text counts as empty, and the least payload is one block of 64 zero bytes.
    """
    ship(docs.sparkSession)

    def stored(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            n, payload = padded_payload(text)
            media = store(payload)
            got = scan(media, payload=True)
            back, table = got["payload"], got["rate_table"]
            seek = zlib.crc32(b"".join(x.to_bytes(8, "little") for x in got["seek"]))
            feature = (
                f"mpeg{got['version']}-{got['layer']};hz={got['sample_rate']};frames={got['n_frames']};"
                f"samples={got['n_samples']};crc={got['crc_good']}/{got['crc_bad']};skipped={got['skipped_bytes']};"
                f"{table['kind']}={table['frames']}/{table['bytes']};tlen={got['tags'].get('TLEN')};seek={seek:08x}"
            )
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), media, feature))
        return pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "feature"])

    kind = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, feature string"
    return docs.withColumn("stored", frame_udf(stored, kind)(F.col("text")))
