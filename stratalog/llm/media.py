"""Media columns: AVI motion-JPEG files made, parsed, decoded and cut into shots.

Every frame is a baseline grey JPEG. Its unit is the quantised DCT coefficient: one payload byte is one coefficient,
64 to a block. A byte x is coded as a coefficient of size category 8 (x below 128: x - 255, else x), whose eight extra bits are x
itself; the frame's own Huffman tables give that symbol one bit, and a restart marker after each block resets the DC
prediction. So a block's code is 64 * 9 bits, a whole number of bytes, and both directions are array operations.
All quantisers are 1, which makes storage lossless.

Reading takes any baseline frame: Huffman tables, restart intervals and subsampled colours as the frame has them; the frames above are the case that is
done by array operations. Shots are told by the histograms of the luminance samples, after dequantising and the inverse cosine transform.

Rows are independent: each is coded, parsed and cut in its own partition, without a shuffle.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.textbytes import map_batches

#: Most blocks of 8 x 8 in a frame; frames of one file are equally large.
FRAME_BLOCKS = 8
RATE = 25
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_COSINES = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32)

# Fixed values of the JPEG and AVI formats.
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, RST0 = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xD0
CODE_BYTES = 72


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head(blocks: int) -> bytes:
    """Everything of a frame up to its entropy-coded data: one row of `blocks` blocks."""
    table = lambda kind: bytes([kind, 1, *[0] * 15, 8])  # one symbol of one bit: size 8 after no zeros
    return (
        struct.pack(">BB", 0xFF, SOI)
        + _segment(DQT, bytes([0, *[1] * 64]))
        + _segment(SOF0, struct.pack(">BHHBBBB", 8, 8, 8 * blocks, 1, 1, 0x11, 0))
        + _segment(DHT, table(0x00) + table(0x10))
        + _segment(DRI, struct.pack(">H", 1))
        + _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def encode_frames(payload: np.ndarray, blocks: int) -> list[bytes]:
    """JPEG frames of `blocks` blocks each; the last is filled with zero units."""
    n = -(-len(payload) // (64 * blocks))
    units = np.zeros(n * blocks * 64, dtype=np.uint8)
    units[: len(payload)] = payload
    bits = np.zeros((n * blocks * 64, 9), dtype=np.uint8)
    bits[:, 1:] = np.unpackbits(units).reshape(-1, 8)
    code = np.packbits(bits.reshape(n * blocks, 576), axis=1)
    head, frames = _frame_head(blocks), []
    for k in range(n):
        own = code[k * blocks : (k + 1) * blocks]
        rst = np.empty((blocks, 2), dtype=np.uint8)
        rst[:, 0], rst[:, 1] = 0xFF, RST0 + np.arange(blocks) % 8
        flat, mark = np.concatenate([own, rst], axis=1), np.zeros((blocks, CODE_BYTES + 2), dtype=bool)
        mark[:, CODE_BYTES:] = True
        flat, mark = flat.ravel()[:-2], mark.ravel()[:-2]
        stuffed = np.flatnonzero((flat == 0xFF) & ~mark)
        frames.append(head + np.insert(flat, stuffed + 1, 0).tobytes() + struct.pack(">BB", 0xFF, EOI))
    return frames


def _codes(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol of the code that any 16 bits begin with; length 0: none."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, k = 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            own = slice(code << (16 - n), (code + 1) << (16 - n))
            length[own], symbol[own] = n, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


@dataclass
class Header:
    """What a frame's markers say up to its entropy-coded data, which starts at `data`."""

    width: int = 0
    height: int = 0
    restart: int = 0
    data: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal and vertical sampling, quantiser
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component's place, DC and AC table
    codes: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)


def read_header(frame: bytes) -> Header:
    if frame[:2] != struct.pack(">BB", 0xFF, SOI):
        raise ValueError("not a JPEG frame")
    at, head = 2, Header()
    while True:
        mark, code, size = struct.unpack_from(">BBH", frame, at)
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if mark != 0xFF:
            raise ValueError("damaged JPEG frame")
        if code == SOF0:
            head.height, head.width, n = struct.unpack_from(">HHB", body, 1)
            head.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif code in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a baseline JPEG frame")
        elif code == DRI:
            head.restart = struct.unpack(">H", body)[0]
        elif code == DQT:
            while body:
                wide = 1 + (body[0] >> 4)
                head.quantisers[body[0] & 15], body = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64), body[1 + 64 * wide :]
        elif code == DHT:
            while body:
                n = sum(body[1:17])
                head.codes[body[0]], body = (body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif code == SOS:
            places = {c[0]: k for k, c in enumerate(head.components)}
            head.scan = [(places[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            head.data = at
            return head


_OWN = (bytes([1, *[0] * 15]), b"\x08")


def _own_coefficients(head: Header, raw: np.ndarray) -> np.ndarray:
    """Of a frame whose tables hold the one symbol 8 and that restarts after each block: all blocks at once."""
    follows = np.concatenate([[False], raw[:-1] == 0xFF])
    raw = raw[~(follows & (raw == 0))]  # byte stuffing
    blocks = head.width * head.height // 64
    code = np.zeros(blocks * (CODE_BYTES + 2), dtype=np.uint8)
    code[: len(raw)] = raw
    bits = np.unpackbits(code.reshape(blocks, CODE_BYTES + 2)[:, :CODE_BYTES], axis=1).reshape(-1, 9)
    unit = np.packbits(bits[:, 1:]).astype(np.int16)
    return np.where(unit < 128, unit - 255, unit).reshape(head.height // 8, head.width // 8, 64)


def _coefficients(head: Header, raw: bytes) -> np.ndarray:
    """The first component's blocks of any baseline frame: rows, columns, 64 coefficients in zigzag order."""
    tables = {k: _codes(*v) for k, v in head.codes.items()}
    if any(k not in tables for _, td, ta in head.scan for k in (td, 0x10 | ta)):
        raise ValueError("a frame without its Huffman tables")
    most_h, most_v = (max(c[k] for c in head.components) for k in (1, 2))
    many = len(head.scan) > 1
    wide, high = (-(-head.width // (8 * most_h)), -(-head.height // (8 * most_v))) if many else (-(-head.width // 8), -(-head.height // 8))
    shape = [(c[1], c[2]) if many else (1, 1) for c in head.components]
    out = np.zeros((high * shape[0][1], wide * shape[0][0], 64), np.int64)
    every = head.restart or wide * high
    parts, start, k = [], 0, 0
    while (k := raw.find(b"\xff", k)) >= 0:
        follow = raw[k + 1] if k + 1 < len(raw) else EOI
        if follow == 0:
            k += 2
            continue
        parts.append(raw[start:k].replace(b"\xff\0", b"\xff"))
        start = k = k + 2
        if not RST0 <= follow < RST0 + 8:
            break
    else:
        parts.append(raw[start:].replace(b"\xff\0", b"\xff"))
    for n, part in enumerate(parts):
        part, at = part + b"\xff\xff\xff\xff", 0
        before = dict.fromkeys((c for c, _, _ in head.scan), 0)

        def take(n: int) -> int:
            nonlocal at
            value = int.from_bytes(part[at >> 3 : (at >> 3) + 4], "big") >> (32 - n - (at & 7)) & ((1 << n) - 1)
            at += n
            return value

        def symbol(table) -> int:
            nonlocal at
            key = int.from_bytes(part[at >> 3 : (at >> 3) + 3], "big") >> (8 - (at & 7)) & 0xFFFF
            if not table[0][key] or at >= 8 * len(part):
                raise ValueError("damaged JPEG frame")
            at += int(table[0][key])
            return int(table[1][key])

        def amount(size: int) -> int:
            value = take(size) if size else 0
            return value if not size or value >> (size - 1) else value - (1 << size) + 1

        for unit in range(n * every, min((n + 1) * every, wide * high)):
            for c, td, ta in head.scan:
                for j in range(shape[c][0] * shape[c][1]):
                    block = np.zeros(64, np.int64)
                    before[c] += amount(symbol(tables[td]))
                    block[0], k = before[c], 1
                    while k < 64:
                        both = symbol(tables[0x10 | ta])
                        run, size = both >> 4, both & 15
                        if not size and run < 15:
                            break
                        k += run
                        if size and k < 64:
                            block[k] = amount(size)
                        k += 1
                    if c == 0:
                        out[unit // wide * shape[0][1] + j // shape[0][0], unit % wide * shape[0][0] + j % shape[0][0]] = block
    return out


def coefficients(frame: bytes) -> tuple[Header, np.ndarray]:
    """A baseline frame's header and its first component's quantised coefficients: rows, columns, 64 in zigzag order."""
    head = read_header(frame)
    if head.restart == 1 and len(head.scan) == 1 and head.codes and all(v == _OWN for v in head.codes.values()):
        return head, _own_coefficients(head, np.frombuffer(frame, np.uint8)[head.data : -2])
    return head, _coefficients(head, frame[head.data :])


def units_of(blocks: np.ndarray) -> np.ndarray:
    """The bytes that `encode_frames` stored in a frame's coefficients."""
    return np.where(blocks < 0, blocks + 255, blocks).astype(np.uint8).ravel()


def pixels(head: Header, blocks: np.ndarray) -> np.ndarray:
    """The first component's samples, by dequantising and the inverse cosine transform."""
    natural = np.zeros(blocks.shape, np.float32)
    natural[..., _ZIGZAG] = blocks * head.quantisers[head.components[0][3]].astype(np.float32)
    square = _COSINES.T @ natural.reshape(*blocks.shape[:2], 8, 8) @ _COSINES
    image = np.clip(np.rint(square + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, blocks.shape[1] * 8)
    most_h, most_v = (max(c[k] for c in head.components) for k in (1, 2))
    return image[: -(-head.height * head.components[0][2] // most_v), : -(-head.width * head.components[0][1] // most_h)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(text: bytes) -> bytes:
    """A file holding text padded with zero bytes to a positive multiple of 64; the payload's size is kept in a `plen` chunk."""
    size = max(64, -(-len(text) // 64) * 64)
    payload = np.zeros(size, dtype=np.uint8)
    payload[: len(text)] = np.frombuffer(text, np.uint8)
    units = size // 64
    blocks = -(-units // -(-units // FRAME_BLOCKS))
    frames = encode_frames(payload, blocks)
    longest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, longest * RATE, 0, 0x10, len(frames), 0, 1, longest, 8 * blocks, 8, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), longest, 10000, 0, 0, 0, 8 * blocks, 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, 8 * blocks, 8, 1, 8, b"MJPG", 64 * blocks, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    movi, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c)
        at += len(c)
    body = b"AVI " + hdrl + _chunk(b"plen", struct.pack("<Q", size)) + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(media: bytes) -> tuple[float, int | None, list[bytes]]:
    """Frames a second, payload size (None in files of others) and the video frames, found through the RIFF index, or in their order where there is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, found = 12, {}
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        key = media[at + 8 : at + 12] if name == b"LIST" else name
        found.setdefault(key, (at + 8, size))
        at += 8 + size + size % 2
    if b"hdrl" not in found or b"movi" not in found:
        raise ValueError("an AVI file without its lists")
    step = struct.unpack_from("<I", media, found[b"hdrl"][0] + 12)[0]
    size = struct.unpack_from("<Q", media, found[b"plen"][0])[0] if b"plen" in found else None
    base, length = found[b"movi"]
    spots = []
    if b"idx1" in found:
        start, n = found[b"idx1"]
        for name, _, offset, size_ in struct.iter_unpack("<4sIII", media[start : start + n // 16 * 16]):
            if media[base + offset : base + offset + 4] != name:
                offset -= base  # some files count from their start
            spots.append((name, base + offset + 8, size_))
    else:
        at = base + 4
        while at + 8 <= base + length:
            own = struct.unpack_from("<I", media, at + 4)[0]
            spots.append((media[at : at + 4], at + 8, own))
            at += 8 + own + own % 2
    frames = [media[a : a + n] for name, a, n in spots if name[2:] in (b"dc", b"db") and n]
    return 1_000_000 / step if step else float(RATE), size, frames


def shots(histograms: np.ndarray, window: int = 8, factor: float = 2.0, floor: float = 0.08) -> list[tuple[int, int]]:
    """First and last frame of each shot: a cut where the difference of neighbours' histograms (rows, each of sum 1) tops floor and factor times the mean of the shot's last `window` differences."""
    change = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    sums = np.concatenate([[0.0], np.cumsum(change)])
    cuts, first = [0], 0
    for k, d in enumerate(change.tolist()):
        a = max(first, k - window)
        if k > a and d > max(floor, factor * (sums[k] - sums[a]) / (k - a)):
            cuts.append(k + 1)
            first = k + 1
    return [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], len(histograms)])]


def decoded(media: bytes) -> tuple[bytes | None, list[dict]]:
    """The payload of an AVI file (None for files of others) and its clips: shots with the seconds at which they start and end."""
    rate, size, frames = read_avi(media)
    units, bins = [], []
    for frame in frames:
        head, blocks = coefficients(frame)
        image = pixels(head, blocks)
        bins.append(np.bincount(image.ravel() >> 3, minlength=32) / max(1, image.size))
        if size is not None:
            units.append(units_of(blocks))
    payload = None if size is None else np.concatenate([np.zeros(0, np.uint8), *units])[:size].tobytes()
    found = shots(np.stack(bins)) if bins else []
    return payload, [{"clip": i, "start_s": a / rate, "end_s": (b + 1) / rate} for i, (a, b) in enumerate(found)]


ADDED = ("payload_bytes", "payload", "media_bytes", "media_sha256", "clips")


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and `media` (binary, an AVI file) of each whole text; a null text is empty and gives one block."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                raw = [x or b"" for x in part.column("raw").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([write_avi(x) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("raw")), run, f"doc_id {kind}, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """Read each AVI file back: all columns of media plus payload_bytes, `payload` (binary; null for files that encode_media did not make), the file's size and SHA-256, and `clips`, its timed shots.

    A null `media`, and one that is no baseline motion-JPEG file, has null results and no clips; repeated rows repeat; an empty table gives an empty result. Columns of the
    added names are replaced.
    """
    names = [c for c in media.columns if c not in ADDED]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in ADDED]
            for raw in batch.column("media").to_pylist():
                try:
                    payload, clips = decoded(raw) if raw is not None else (None, [])
                except (ValueError, struct.error, KeyError, IndexError):
                    payload, clips = None, []
                for x, v in zip(out, (None if payload is None else len(payload), payload, None if raw is None else len(raw), None if raw is None else hashlib.sha256(raw).hexdigest(), clips)):
                    x.append(v)
            clip = pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.string(), clip)))], [*names, *ADDED])

    fields = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in names)
    return map_batches(media.select(*[F.col(f"`{c}`") for c in names]), run, f"{fields}, payload_bytes long, payload binary, media_bytes long, media_sha256 string, clips array<struct<clip:int,start_s:double,end_s:double>>")


def clip_rows(decoded: DataFrame) -> DataFrame:
    """One row per shot: doc_id, clip, start_s, end_s."""
    return decoded.select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.clip", "c.start_s", "c.end_s")
