"""MPEG audio columns: write a payload as frames, and read frames back.

The writer lays each 576-byte unit of a payload into one MPEG-2 Layer III frame
(576 samples): header, CRC-16, an all-zero side information (silence) and the
unit in the frame's ancillary part.  An ID3v2 tag and a Xing frame with counts
and seek table come first.  The reader skips tags, resynchronises on headers
that a second header (or the end) confirms, or that continue the stream's kind
where the last frame ended, takes an ID3v1 tag only where no frame explains its
bytes, parses ID3v2 frames, APE tags, and Xing, Info and VBRI tables with the
encoder's delay and padding, verifies the checksums of all layers, and gives exact
durations (without delay and padding) and the offset of every frame.

Defined results: a null payload counts as empty and is padded to one unit; bytes
without any frame give zero frames, a duration of 0 and an empty payload; texts of any
length are stored whole, equal ones alike; a repeated or null id keeps a row each;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

UNIT, PAD = 576, 255
#: kbit/s by (MPEG-1 or not, layer) and header index, and Hz by version bits: fixed values of the format.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@lru_cache(1 << 14)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The format's CRC-16 of the first `bits` bits (all): polynomial 0x8005, start 0xFFFF."""
    c = 0xFFFF
    for k in range(8 * len(data) if bits is None else bits):
        c = c << 1 ^ (0x8005 if (c >> 15 ^ data[k >> 3] >> 7 - (k & 7)) & 1 else 0)
        c &= 0xFFFF
    return c


#: Layer II: bits of the allocation of each subband, as (subbands, bits) runs, by table (fixed values of the format).
ALLOCATION = {"a": ((3, 4), (8, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "lsf": ((4, 4), (7, 3), (19, 2))}


def guarded(four: bytes, data: bytes) -> int:
    """Bits of frame data, after the checksum, that a checksum of layer I or II covers: allocation, and in layer II the scale factor selection."""
    version, layer, mode = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[3] >> 6
    channels, joint = 1 if mode == 3 else 2, 4 * (four[3] >> 4 & 3) + 4 if mode == 1 else 32
    if layer == 1:
        return 4 * (channels * joint + 32 - joint)
    if version != 3:
        table = "lsf"
    else:
        hz, kbit = RATES[3][four[2] >> 2 & 3], BITRATES[True, 2][four[2] >> 4] // channels
        table = ("d" if hz == 32000 else "c") if kbit <= 48 else "b" if kbit >= 96 and hz != 48000 else "a"
    widths = [w for n, w in ALLOCATION[table] for _ in range(n)]
    at = used = 0
    for band, w in enumerate(widths):
        for _ in range(channels if band < joint else 1):
            some = any(data[k >> 3] >> 7 - (k & 7) & 1 for k in range(at, at + w))
            # Above the joint bound both channels share an allocation and have their own scale factors.
            used += some * (1 if band < joint else channels)
            at += w
    return at + 2 * used


@lru_cache(1 << 12)
def header(four: bytes) -> tuple[int, int, int, int, int, bool] | None:
    """(bytes, samples, Hz, side information bytes, kbit/s, has a checksum) of a frame header, or None."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer, bare = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), four[1] & 1
    rate, hz = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    one, mono = version == 3, four[3] >> 6 == 3
    kbit, hertz, pad = BITRATES[one, layer][rate], RATES[version][hz], four[2] >> 1 & 1
    if layer == 1:
        size, samples = (12_000 * kbit // hertz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and not one else 1152
        size = samples // 8 * 1000 * kbit // hertz + pad
    side = ((17 if mono else 32) if one else (9 if mono else 17)) if layer == 3 else 0
    return size, samples, hertz, side, kbit, not bare


#: Frame header of the writer: MPEG-2, Layer III, CRC, 144 kbit/s, 16 kHz, mono.
HEAD = bytes((0xFF, 0xF2, 13 << 4 | 2 << 2, 3 << 6))
SIZE, _, _, SIDE, _, _ = header(HEAD)
START = 4 + 2 + SIDE


def write(payload: bytes) -> bytes:
    """The stored form of a payload whose length is a multiple of UNIT."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    frames = np.zeros((len(units) + 1, SIZE), np.uint8)
    frames[:, :4] = np.frombuffer(HEAD, np.uint8)
    frames[:, 4:6] = np.frombuffer(struct.pack(">H", crc16(HEAD[2:] + bytes(SIDE))), np.uint8)
    frames[1:, START : START + UNIT] = units
    toc = bytes(min(255, 256 * (p * len(frames) // 100) // len(frames)) for p in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(units), frames.size) + toc
    frames[0, START : START + len(xing)] = np.frombuffer(xing, np.uint8)
    text = b"\x03recallum"
    body = b"TSSE" + struct.pack(">IH", len(text), 0) + text
    return b"ID3\x04\x00\x00" + bytes((0, 0, len(body) >> 7, len(body) & 127)) + body + frames.tobytes()


def _safe(four: bytes) -> int:
    """An integer of seven bits a byte."""
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def id3(tag: bytes) -> dict[str, str]:
    """The texts of an ID3v2 tag by frame name; frames of other kinds have an empty text."""
    version, flags, at, out = tag[3], tag[5], 10, {}
    if flags & 0x80 and version < 4:
        tag = tag[:10] + tag[10:].replace(b"\xff\0", b"\xff")
    if flags & 0x40 and version > 2:
        at += _safe(tag[10:14]) if version == 4 else 4 + int.from_bytes(tag[10:14])
    wide = version > 2
    while at + (10 if wide else 6) <= len(tag) and tag[at]:
        name = tag[at : at + (4 if wide else 3)].decode("latin-1")
        size = (_safe(tag[at + 4 : at + 8]) if version == 4 else int.from_bytes(tag[at + 4 : at + 8])) if wide else int.from_bytes(tag[at + 3 : at + 6])
        at += 10 if wide else 6
        body = tag[at : at + size]
        out[name] = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0") if name[0] == "T" and body else ""
        at += size
    return out


def read(data: bytes) -> dict:
    """Tags, table, frames, checksums and the units' bytes of an MPEG audio stream."""
    at, end, tags, texts = 0, len(data), [], {}
    while at + 10 <= end:
        if data[at : at + 3] == b"ID3":
            size = 10 + _safe(data[at + 6 : at + 10])
            tags.append(f"ID3v2.{data[at + 3]}")
            texts |= id3(data[at : at + size])
            at += size + 10 * (data[at + 5] >> 4 & 1)
        elif data[at : at + 8] == b"APETAGEX" and at + 32 <= end:
            tags.append("APE")
            at += 32 + int.from_bytes(data[at + 12 : at + 16], "little")
        else:
            break
    found = _frames(data, at, end)
    # A tag at the end is what no frame explains; bytes of the last frame can look like one.
    if data[-128:-125] == b"TAG" and end - at >= 128 and (short := _frames(data, at, end - 128))["skipped"] < found["skipped"]:
        found, tags, end = short, [*tags, "ID3v1"], end - 128
    if data[end - 32 : end - 24] == b"APETAGEX" and end - at >= 32:
        size = int.from_bytes(data[end - 20 : end - 16], "little") + 32 * (data[end - 9] >> 7)
        if at <= end - size and (short := _frames(data, at, end - size))["skipped"] < found["skipped"]:
            found, tags = short, [*tags, "APE"]
    return {"tags": tags, "texts": texts, **found}


def _frames(data: bytes, at: int, end: int) -> dict:
    """Table, frames, checksums and the units' bytes between the tags."""
    offsets, samples, good, bad, hz, skipped, kbit, parts, table = [], 0, 0, 0, 0, 0, 0, [], None
    sure, kind = False, None  # whether the last frame ended here; its version, layer and rate
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h is None or at + h[0] > end or not (at + h[0] == end or header(data[at + h[0] : at + h[0] + 4]) or (sure and kind == (data[at + 1], data[at + 2] & 12))):
            nxt = data.find(b"\xff", at + 1, end)
            skipped += (nxt if nxt >= 0 else end) - at
            at, sure = nxt if nxt >= 0 else end, False
            continue
        size, count, hz, side, rate, checked = h
        kind = (data[at + 1], data[at + 2] & 12)
        body = at + 4 + 2 * checked + side
        if checked:
            rest = data[at + 6 : body] if side else data[at + 6 : at + min(size, 70)]
            ok = crc16(data[at + 2 : at + 4] + rest, None if side else 16 + min(8 * len(rest), guarded(data[at : at + 4], rest + bytes(64)))) == int.from_bytes(data[at + 4 : at + 6])
            good, bad = good + ok, bad + (not ok)
        if not offsets and table is None and (found := _table(data, at, body)):
            table = found
        else:
            offsets.append(at)
            samples += count
            kbit += rate
            parts.append(data[body : body + UNIT])
        at, sure = at + size, True
    return {"table": table, "frames": len(offsets), "samples": samples, "hz": hz, "good": good, "bad": bad, "skipped": skipped + max(0, end - at), "kbit": kbit // max(1, len(offsets)), "offsets": offsets, "payload": b"".join(parts), "seconds": max(0, samples - sum((table or {}).get(k, 0) for k in ("delay", "padding"))) / hz if hz else 0.0}


def _table(data: bytes, at: int, body: int) -> dict | None:
    """The counts and seek table of a Xing, Info or VBRI frame."""
    if data[body : body + 4] in (b"Xing", b"Info"):
        flags, k, out = int.from_bytes(data[body + 4 : body + 8]), body + 8, {"kind": data[body : body + 4].decode()}
        for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                out[name] = list(data[k : k + n]) if name == "toc" else int.from_bytes(data[k : k + n])
                k += n
        if data[k : k + 4] in (b"LAME", b"Lavc", b"Lavf") and len(data) >= k + 24:
            three = int.from_bytes(data[k + 21 : k + 24])
            out |= {"encoder": data[k : k + 9].decode("latin-1").rstrip("\0 "), "delay": three >> 12, "padding": three & 0xFFF}
        return out
    if data[at + 36 : at + 40] == b"VBRI":
        size, frames, n, scale, width = *struct.unpack(">II", data[at + 46 : at + 54]), *struct.unpack(">HHH", data[at + 54 : at + 60])
        toc = [int.from_bytes(data[at + 62 + i * width : at + 62 + (i + 1) * width]) * scale for i in range(n)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` → (id, n_bytes, media binary): every whole text as MPEG audio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                raw = [(t.as_py() or "").encode() for t in part.column(1)]
                media = [write(x + bytes([PAD]) * (-len(x) % UNIT or (UNIT if not x else 0))) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary")


FIELDS = "payload binary, tags array<string>, vbr_kind string, vbr_frames bigint, frames bigint, samples bigint, sample_rate int, kbit int, duration_s double, crc_good bigint, crc_bad bigint, skipped bigint, seek_offsets array<bigint>, texts map<string,string>"


def decode(media: DataFrame) -> DataFrame:
    """(id, n_bytes, media) → the same with payload, tags, table, durations, checksums and seek offsets of each stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                r = [read(m.as_py() or b"") for m in part.column(2)]
                col = lambda f, kind: pa.array([f(x) for x in r], kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns, col(lambda x: x["payload"], pa.binary()), col(lambda x: x["tags"], pa.list_(pa.string())), col(lambda x: (x["table"] or {}).get("kind"), pa.string()), col(lambda x: (x["table"] or {}).get("frames"), pa.int64()),
                        col(lambda x: x["frames"], pa.int64()), col(lambda x: x["samples"], pa.int64()), col(lambda x: x["hz"], pa.int32()), col(lambda x: x["kbit"], pa.int32()), col(lambda x: x["seconds"], pa.float64()),
                        col(lambda x: x["good"], pa.int64()), col(lambda x: x["bad"], pa.int64()), col(lambda x: x["skipped"], pa.int64()), col(lambda x: x["offsets"], pa.list_(pa.int64())), col(lambda x: list(x["texts"].items()), pa.map_(pa.string(), pa.string())),
                    ],
                    names=["id", "n_bytes", "media", *(f.split()[0] for f in FIELDS.split(", "))],
                )

    return media.select("id", "n_bytes", "media").mapInArrow(run, f"id {media.schema['id'].dataType.simpleString()}, n_bytes bigint, media binary, {FIELDS}")
