"""Media columns: texts kept losslessly in MPEG audio frames, and a probe for any MPEG audio stream.

The writer makes a stream that players accept: an ID3v2 tag, a Xing frame with frame count, byte count and seek
table, and MPEG-1 layer III frames (mono, 32 kHz) whose granules are empty, so they sound silent, and whose
ancillary bytes hold the payload. Every frame carries its checksum.

The probe skips junk until a frame header that the next one confirms, reads tags (ID3v2.2 to 2.4, with unsynchronisation
and all text encodings; ID3v1 only behind the last frame, so that no payload is taken for one) and the variable-bitrate
table (Xing and VBRI, with their seek entries), verifies the checksums of all layers, and gives exact durations (samples
over rate) and the byte offset of each frame. `seek_error` is the greatest distance in bytes between an entry of the seek
table and the frame it names, as found; null without a seek table or without frames.

Null text counts as empty; an empty payload is 64 zero bytes. Repeated texts give equal media. Extra columns are
not read. A null or unparsable stream gives zero frames and an empty payload.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import batch, columns, table

BLOCK = 64

# Fixed values of the MPEG audio format: kbit/s by (version 1?, layer) for indexes 1 to 14, and sample rates.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
VERSIONS = {0: 25, 2: 2, 3: 1}


@lru_cache(4096)
def header(word: bytes) -> tuple | None:
    """(version, layer, has checksum, bit/s, rate, channels, frame bytes, samples) of four header bytes, or None."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(word[1] >> 3 & 3), 4 - (word[1] >> 1 & 3)
    kbps, rate = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or kbps in (0, 15) or rate == 3:
        return None
    bps, hz, pad = BITRATES[version == 1, layer][kbps - 1] * 1000, RATES[version][rate], word[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12 * bps // hz + pad) * 4 if layer == 1 else samples // 8 * bps // hz + pad
    return version, layer, not word[1] & 1, bps, hz, 1 if word[3] >> 6 == 3 else 2, size, samples


@lru_cache(4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """Checksum of the first `bits` bits (default: all)."""
    crc = 0xFFFF
    for k in range(8 * len(data) if bits is None else bits):
        top = crc >> 15 ^ data[k >> 3] >> 7 - (k & 7) & 1
        crc = (crc << 1 ^ (0x8005 if top else 0)) & 0xFFFF
    return crc


# Fixed values of layer II: (subbands, bits of their allocation) in order.
ALLOCATION_2 = ((4, 4), (7, 3), (19, 2))
ALLOCATION_1 = ((11, 4), (12, 3), (7, 2))
ALLOCATION_1_LOW = ((2, 4), (10, 3))


def guarded_bits(version: int, layer: int, bps: int, hz: int, mode: int, bound: int, body: bytes) -> int:
    """How many bits of a frame's body (behind the checksum) its checksum covers in layers I and II."""
    channels, widths = 1 if mode == 3 else 2, [4] * 32
    if layer == 2:
        kbps = bps // 1000 // channels
        if version != 1:
            table, bands = ALLOCATION_2, 30
        elif kbps < 56:
            table, bands = ALLOCATION_1_LOW, 12 if hz == 32000 else 8
        else:
            table, bands = ALLOCATION_1, 30 if kbps >= 96 and hz != 48000 else 27
        widths = [w for n, w in table for _ in range(n)][:bands]
    word, total = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 64 * 8
    at = chosen = 0
    for band, width in enumerate(widths):
        shared = mode == 1 and band >= bound
        for _ in range(1 if shared else channels):
            value = word >> total - at - width & (1 << width) - 1
            chosen += bool(value) * (channels if shared else 1)
            at += width
    return at + 2 * chosen * (layer == 2)


def side_bytes(version: int, channels: int) -> int:
    """Bytes of layer III side information."""
    return (32 if channels == 2 else 17) if version == 1 else (17 if channels == 2 else 9)


_SIDE = bytes(17)
_HEADS = [bytes((0xFF, 0xFA, k + 1 << 4 | 2 << 2, 0xC0)) for k in range(14)]
_STARTS = [h + struct.pack(">H", crc16(h[2:] + _SIDE)) + _SIDE for h in _HEADS]
_ROOM = [header(h)[6] - len(s) for h, s in zip(_HEADS, _STARTS, strict=True)]


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write_mpeg(payload: bytes) -> bytes:
    """The payload as an MPEG audio stream: full frames at the highest bitrate, then the smallest that holds the rest."""
    most, frames = _ROOM[-1], []
    for i in range(0, len(payload), most):
        part = payload[i : i + most]
        k = next(k for k, room in enumerate(_ROOM) if room >= len(part))
        frames.append(_STARTS[k] + part + bytes(_ROOM[k] - len(part)))
    note = f"\0payload\0{len(payload)}".encode()
    tag = b"TXXX" + struct.pack(">IH", len(note), 0) + note
    tag = b"ID3\x03\0\0" + _synchsafe(len(tag)) + tag
    k = next(k for k, room in enumerate(_ROOM) if room >= 116)
    total, starts, at = len(_STARTS[k]) + _ROOM[k] + sum(map(len, frames)), [], len(_STARTS[k]) + _ROOM[k]
    for f in frames:
        starts.append(at)
        at += len(f)
    toc = bytes(starts[i * len(starts) // 100] * 256 // total for i in range(100)) if starts else bytes(100)
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return b"".join([tag, _STARTS[k], xing, bytes(_ROOM[k] - len(xing)), *frames])


ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def text_of(body: bytes, two: bool) -> tuple[str, str]:
    """The text of an ID3v2 text frame, with its description if it has `two`."""
    if not body or body[0] >= len(ENCODINGS):
        return "", ""
    wide, text = body[0] in (1, 2), body[1:]
    cut = -1
    if two:
        cut = next((k for k in range(0, len(text) - wide, 1 + wide) if not any(text[k : k + 1 + wide])), -1)
    parts = (text[:cut], text[cut + 1 + wide :]) if cut >= 0 else (b"", text)
    return tuple(p.decode(ENCODINGS[body[0]], "replace").rstrip("\0") for p in parts)


def read_id3(data: bytes) -> tuple[int, dict[str, str]]:
    """Size of an ID3v2 tag in front (0 without one) and its text frames: by name, own ones by description."""
    unsafe = lambda b: sum((x & 0x7F) << s for x, s in zip(b, (21, 14, 7, 0), strict=True))
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    version, flags, size = data[3], data[5], min(len(data), 10 + unsafe(data[6:10]))
    body, notes = data[10:size], {}
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at, head = 0, 6 if version == 2 else 10
    if flags & 0x40 and version > 2 and len(body) >= 4:  # an extended header
        at = unsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    while at + head <= len(body) and body[at : at + 1].isalnum():
        name = body[at : at + (3 if version == 2 else 4)].decode("latin-1")
        n = int.from_bytes(body[at + 3 : at + 6], "big") if version == 2 else unsafe(body[at + 4 : at + 8]) if version == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
        own = body[at + head : at + head + n]
        if version == 4 and body[at + 9] & 2:
            own = own.replace(b"\xff\0", b"\xff")
        if version == 4 and body[at + 9] & 1:  # a length stands before the frame
            own = own[4:]
        if name in ("TXXX", "TXX"):
            key, value = text_of(own, True)
            notes[key] = value
        elif name[0] == "T":
            notes[name] = text_of(own, False)[1]
        at += head + n
    return size, notes


def rate_table(frame: bytes, at: int) -> dict | None:
    """Kind, frame and byte counts (None if not given) and seek entries of a frame's variable-bitrate header; None if there is none, or a part of it is cut off.

    Entries of Xing are 256ths of the bytes for each hundredth of the time; those of VBRI are bytes for `step` frames each.
    """
    mark = frame[at : at + 4]
    if mark in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, p, found = struct.unpack(">I", frame[at + 4 : at + 8])[0], at + 8, []
        if len(frame) < p + 4 * (flags & 3).bit_count() + 100 * (flags >> 2 & 1):
            return None
        for bit in (1, 2):
            found.append(struct.unpack(">I", frame[p : p + 4])[0] if flags & bit else None)
            p += 4 * bool(flags & bit)
        return {"kind": mark.decode(), "frames": found[0], "bytes": found[1], "entries": list(frame[p : p + 100]) if flags & 4 else [], "step": 0}
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        total, frames, n, scale, width, step = struct.unpack(">IIHHHH", frame[46:62])
        if n and (not 1 <= width <= 4 or not step) or len(frame) < 62 + n * width:
            return None
        return {"kind": "VBRI", "frames": frames, "bytes": total, "entries": [scale * int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") for k in range(n)], "step": step}
    return None


def seek_points(found: dict, start: int, size: int, offsets: list[int], length: int) -> list[tuple[int, int]]:
    """(offset by the table, offset where the probe found that frame) for each entry of a seek table that names a frame.

    The table stands in the frame of `size` bytes at `start`; `offsets` are those of the frames behind it.
    """
    n, entries = len(offsets), found["entries"]
    if not n or not entries:
        return []
    if found["kind"] == "VBRI":
        named = itertools.accumulate(entries, initial=start + size)
        return [(p, offsets[i * found["step"]]) for i, p in enumerate(named) if i * found["step"] < n]
    whole = found["bytes"] or length - start
    return [(start + x * whole // 256, offsets[i * n // 100]) for i, x in enumerate(entries)]


def probe_mpeg(data: bytes | None) -> dict:
    """Frames, exact length, checksums, seek offsets and carried payload of an MPEG audio stream."""
    data = data or b""
    start, notes = read_id3(data)
    at_end = len(data)
    out = {"frames": 0, "samples": 0, "rate": 0, "offsets": [], "good": 0, "bad": 0, "junk": 0, "vbr": None, "seek": [], "bps": set()}
    at, kind, first, parts, frame_of_table = start, None, True, [], (0, 0)
    while at + 4 <= at_end:
        if at == at_end - 128 and not first and data[at : at + 3] == b"TAG":  # ID3v1, right behind a frame
            break
        h = header(data[at : at + 4])
        ok = h and at + h[6] <= at_end and kind in (None, (h[0], h[1], h[4]))
        if ok and kind is None and at + h[6] + 4 <= at_end:  # the first frame counts once another follows it
            n = header(data[at + h[6] : at + h[6] + 4])
            ok = n and (n[0], n[1], n[4]) == (h[0], h[1], h[4])
        if not ok:
            nxt = data.find(b"\xff", at + 1, at_end)
            nxt = at_end if nxt < 0 else nxt
            out["junk"] += nxt - at
            at = nxt
            continue
        version, layer, check, bps, hz, channels, size, samples = h
        kind, body = (version, layer, hz), at + 4 + 2 * check
        side = side_bytes(version, channels) if layer == 3 else 0
        if check:
            guarded = 8 * side if layer == 3 else guarded_bits(version, layer, bps, hz, data[at + 3] >> 6, 4 * (data[at + 3] >> 4 & 3) + 4, data[body : at + size])
            right = data[at + 4 : at + 6] == struct.pack(">H", crc16(data[at + 2 : at + 4] + data[body : body + -(-guarded // 8)], 16 + guarded))
            out["good" if right else "bad"] += 1
        table = rate_table(data[at : at + size], 4 + 2 * check + side) if first else None
        if table:
            out["vbr"], frame_of_table = table, (at, size)
        else:
            out["frames"] += 1
            out["samples"] += samples
            out["offsets"].append(at)
            out["bps"].add(bps)
            parts.append(data[body + side : at + size])
        out["rate"], first, at = hz, False, at + size
    payload = b"".join(parts)
    out["tags"] = notes
    if out["vbr"]:
        out["seek"] = seek_points(out["vbr"], *frame_of_table, out["offsets"], at_end)
    out["seek_error"] = max((abs(p - q) for p, q in out["seek"]), default=None)
    return out | {"payload": payload[: int(notes["payload"])] if notes.get("payload", "").isdigit() else payload}


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def store_audio(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each whole text's UTF-8, zero-padded to a positive multiple of 64, as MPEG audio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            yield batch(MEDIA, ids, [len(r) for r in raw], [write_mpeg(r + bytes(-len(r) % BLOCK if r else BLOCK)) for r in raw])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, n_bytes long, media binary")


PROBED = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("frames", pa.int64()), ("samples", pa.int64()), ("rate", pa.int32()), ("checksums_good", pa.int64()), ("checksums_bad", pa.int64()), ("seek_offsets", pa.list_(pa.int64())), ("seconds", pa.float64()), ("seek_error", pa.int64())]
)
PROBED_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, samples long, rate int, checksums_good long, checksums_bad long, seek_offsets array<long>, seconds double, seek_error long"


def read_audio(media: DataFrame) -> DataFrame:
    """What the stored streams hold: digests of payload and stream, exact duration (samples / rate), seek offsets, and how far the stored seek table is off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, streams in columns(batches):
            rows = []
            for i, n, stream in zip(ids, sizes, streams, strict=True):
                p, stream = probe_mpeg(stream), stream or b""
                seek = zlib.crc32(struct.pack(f">{len(p['offsets'])}Q", *p["offsets"]))
                v = p["vbr"]
                vbr = f"{v['kind']}:{v['frames']}:{v['bytes']}:{len(v['entries'])}:{p['seek_error']}" if v else "none"
                feature = f"frames={p['frames']};samples={p['samples']};rate={p['rate']};vbr={vbr};bps={min(p['bps'], default=0)}-{max(p['bps'], default=0)};crc={p['good']}/{p['bad']};junk={p['junk']};seek={seek}"
                rows.append((i, n, len(p["payload"]), hashlib.sha256(p["payload"]).hexdigest(), zlib.crc32(p["payload"][-BLOCK:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, p["frames"], p["samples"], p["rate"], p["good"], p["bad"], p["offsets"], p["samples"] / p["rate"] if p["rate"] else 0.0, p["seek_error"]))
            yield batch(PROBED, *(zip(*rows, strict=True) if rows else [[]] * len(PROBED)))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, PROBED_DDL)


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    probed = read_audio(store_audio(table(spark, sf_dir, "documents")))
    return probed.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "seconds", "seek_offsets", "seek_error")
