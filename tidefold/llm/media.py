"""Media columns: AVI files of lossless motion JPEG, their frames and shots.

A payload is stored as 24 x 24 frames of 8-bit samples. Every frame is a
lossless JPEG (process SOF3 of ITU-T T.81: prediction from the left neighbour,
differences coded by a Huffman table), self-contained, in an AVI file with
``hdrl``, ``movi`` and ``idx1``. Reading finds frames through the RIFF index
(or, without one, by walking ``movi``), parses the JPEG markers, and decodes
the frames of a batch in step, one numpy vector over ``TOGETHER`` frames for
each sample; a long text's frames are coded and decoded part by part.

Shots: grey-value histograms of neighbouring frames are compared; a cut is a
local maximum of the difference that exceeds the mean plus ``CUT_SIGMAS``
deviations of the differences in a window around it, and ``CUT_LEAST``. Clips
are the runs between cuts, with times from the file's frame rate.

Defined cases: null text counts as empty, a payload of one frame of 255s;
repeated rows are stored each; an empty table gives an empty result; other
columns are left out; damaged or foreign files raise ValueError in ``parse_avi``
and ``decode_frames``.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import or_empty

SIDE, FRAME, RATE, TOGETHER = 24, 576, 25, 4096
CUT_SIGMAS, CUT_LEAST, CUT_WINDOW, BINS = 3.0, 0.15, 12, 32
RESULT = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
    "media_sha256 string, feature string, clips array<struct<clip:int,first_frame:int,frames:int,start_s:double,end_s:double>>"
)

#: Lengths of the Huffman codes of the difference categories 0 to 8: one code table for text-like samples.
_LENGTHS = (4, 4, 3, 3, 3, 3, 3, 3, 4)


def huffman(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a JPEG table: codes of a length are consecutive."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _own_table() -> tuple[list[int], list[int]]:
    order = sorted(range(len(_LENGTHS)), key=lambda s: (_LENGTHS[s], s))
    return [sum(x == n for x in _LENGTHS) for n in range(1, 17)], order


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _headers() -> bytes:
    counts, symbols = _own_table()
    frame = struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)
    return b"\xff\xd8" + _segment(0xC3, frame) + _segment(0xC4, bytes([0, *counts, *symbols])) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def _predicted(samples: np.ndarray) -> np.ndarray:
    """The predictions of (frames, SIDE, SIDE) samples: left, at a row's start above, first 128."""
    p = np.empty(samples.shape, np.int16)
    p[:, :, 1:] = samples[:, :, :-1]
    p[:, 1:, 0] = samples[:, :-1, 0]
    p[:, 0, 0] = 128
    return p


_CATEGORY = np.array([int(x).bit_length() for x in range(256)], np.int64)


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """A lossless JPEG for each of (frames, FRAME) samples; ``TOGETHER`` frames at a time."""
    return [f for at in range(0, len(samples), TOGETHER) for f in _encode(samples[at : at + TOGETHER])]


def _encode(samples: np.ndarray) -> list[bytes]:
    n = len(samples)
    grid = samples.reshape(n, SIDE, SIDE).astype(np.int16)
    diff = (grid - _predicted(grid)).reshape(n, FRAME).astype(np.int64)
    cat = _CATEGORY[np.abs(diff)]
    table = huffman(*_own_table())
    codes, lengths = (np.array([table[s][k] for s in range(len(_LENGTHS))], np.int64) for k in (0, 1))
    extra = np.where(diff < 0, diff + (1 << cat) - 1, diff)
    bits, word = lengths[cat] + cat, (codes[cat] << cat) | extra
    ends = np.cumsum(bits, axis=1)
    sizes = -(-ends[:, -1] // 8)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = (base * 8)[:, None] + ends - bits
    pad = sizes * 8 - ends[:, -1]  # the last byte is filled with ones
    at, bits, word = (np.concatenate([x.ravel(), y]) for x, y in ((at, base * 8 + ends[:, -1]), (bits, pad), (word, (1 << pad) - 1)))
    shifted = word << (24 - (at & 7) - bits)
    total = int(sizes.sum())
    out = np.zeros(total + 3)
    for k in range(3):
        out += np.bincount((at >> 3) + k, weights=(shifted >> (16 - 8 * k)) & 255, minlength=total + 3)[: total + 3]
    data = out[:total].astype(np.uint8)
    # a byte 255 is followed by a zero
    full = data == 255
    place = np.arange(total) + np.cumsum(full) - full
    stuffed = np.zeros(total + int(full.sum()), np.uint8)
    stuffed[place] = data
    grown = np.concatenate([[0], np.cumsum(np.add.reduceat(full.astype(np.int64), base))])
    cuts = np.concatenate([base, [total]]) + grown
    raw, head = stuffed.tobytes(), _headers()
    return [head + raw[a:b] + b"\xff\xd9" for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def write_avi(frames: list[bytes], rate: int = RATE) -> bytes:
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    body, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        body.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + head + _list(b"movi", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _whole(read: Callable) -> Callable:
    """``read``, with ValueError for whatever a cut-off file lacks."""

    @functools.wraps(read)
    def checked(*args):
        try:
            return read(*args)
        except (IndexError, struct.error) as e:
            raise ValueError("the file ends too soon") from e

    return checked


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError("a chunk goes beyond its list")
        yield name, at + 8, size
        at += 8 + size + (size & 1)


@_whole
def parse_avi(data: bytes) -> tuple[float, list[tuple[int, int]]]:
    """(frames a second, (place, size) of each video frame), by the index where there is one."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movi, index = float(RATE), None, None
    for name, at, size in _chunks(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        if name == b"LIST" and data[at : at + 4] == b"hdrl":
            for sub, a, _ in _chunks(data, at + 4, at + size):
                if sub == b"avih":
                    rate = 1e6 / (struct.unpack_from("<I", data, a)[0] or 1_000_000 // RATE)
        elif name == b"LIST" and data[at : at + 4] == b"movi":
            movi = (at, size)
        elif name == b"idx1":
            index = (at, size)
    if movi is None:
        raise ValueError("no movi list")
    if index is None:
        return rate, [(a, n) for name, a, n in _chunks(data, movi[0] + 4, movi[0] + movi[1]) if name[2:] == b"dc"]
    frames = []
    for i in range(index[1] // 16):
        name, _, offset, size = struct.unpack_from("<4sIII", data, index[0] + 16 * i)
        if name[2:] == b"dc":
            if data[movi[0] + offset : movi[0] + offset + 4] != name:
                raise ValueError("the index does not point at a frame")
            frames.append((movi[0] + offset + 8, size))
    return rate, frames


def _parse_jpeg(data: bytes) -> tuple[tuple, int]:
    """((height, width, counts, symbols), where the coded samples begin)."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, shape, table = 2, None, None
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC3:
            bits, height, width, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts != 1:
                raise ValueError("only frames of one 8-bit component are read")
            shape = (height, width)
        elif marker == 0xC4:
            table = (tuple(body[1:17]), tuple(body[17 : 17 + sum(body[1:17])]))
        elif marker == 0xDA:
            if shape is None or table is None or body[3] != 1:
                raise ValueError("only lossless frames with prediction from the left are read")
            return (*shape, *table), at
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only lossless frames are read")


@_whole
def decode_frames(frames: list[bytes]) -> np.ndarray:
    """(frames, height * width) samples, decoded ``TOGETHER`` at a time; all frames must have one size and one code table."""
    if not frames:
        return np.zeros((0, FRAME), np.uint8)
    parts = [_decode(frames[at : at + TOGETHER]) for at in range(0, len(frames), TOGETHER)]
    if len({shape for shape, _ in parts}) > 1:
        raise ValueError("frames of different kinds")
    return np.concatenate([samples for _, samples in parts])


def _decode(frames: list[bytes]) -> tuple[tuple, np.ndarray]:
    parsed: dict[bytes, tuple] = {}
    bodies, shapes = [], set()
    for f in frames:  # frames with the same headers are parsed once
        known = next((k for k in parsed if f.startswith(k)), None)
        if known is None:
            shape, at = _parse_jpeg(f)
            parsed[known := f[:at]] = shape
        shapes.add(parsed[known])
        if f[-2:] != b"\xff\xd9":
            raise ValueError("a frame has no end")
        bodies.append(f[len(known) : -2])
    if len(shapes) > 1:
        raise ValueError("frames of different kinds")
    height, width, counts, symbols = shape = shapes.pop()
    look_n, look_s = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for s, (code, length) in huffman(list(counts), list(symbols)).items():
        low = code << (16 - length)
        look_n[low : low + (1 << (16 - length))], look_s[low : low + (1 << (16 - length))] = length, s
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(b) for b in bodies])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    stuffing = np.concatenate([[False], (raw[:-1] == 255) & (raw[1:] == 0)])
    before = np.concatenate([[0], np.cumsum(stuffing)])
    data = np.concatenate([raw[~stuffing], np.full(8, 255, np.uint8)])
    # 32 bits from every byte on
    wide = (data[:-3].astype(np.uint32) << 24) | (data[1:-2].astype(np.uint32) << 16) | (data[2:-1].astype(np.uint32) << 8) | data[3:]
    pos = (starts - before[starts]) * 8
    ends = (starts + sizes - before[starts + sizes]) * 8
    out = np.empty((height * width, len(frames)), np.int32)
    limit = len(wide) - 1
    for i in range(height * width):
        word = wide[np.minimum(pos >> 3, limit)] << (pos & 7).astype(np.uint32)
        top = word >> np.uint32(16)
        n, s = look_n[top].astype(np.int64), look_s[top].astype(np.int64)
        if not n.all():
            raise ValueError("an unknown code")
        # a code and its bits fit in 25 bits: categories above 8 do not occur in 8-bit frames
        extra = ((word.astype(np.int64) << n) & 0xFFFFFFFF) >> (32 - s)
        diff = np.where(extra < (1 << s) >> 1, extra - (1 << s) + 1, extra)
        previous = out[i - 1] if i % width else out[i - width] if i else 128
        out[i] = (previous + diff) & 0xFFFF
        pos = pos + n + s
    if (pos > ends).any() or (out > 255).any():
        raise ValueError("a frame is damaged")
    return shape, out.T.astype(np.uint8)


def _histograms(samples: np.ndarray) -> np.ndarray:
    frame = np.repeat(np.arange(len(samples)), samples.shape[1])
    return np.bincount(frame * BINS + (samples.ravel() >> 3), minlength=len(samples) * BINS).reshape(-1, BINS) / samples.shape[1]


def cuts(samples: np.ndarray) -> list[int]:
    """The frames that begin a shot (without frame 0)."""
    if len(samples) < 2:
        return []
    hist = np.concatenate([_histograms(samples[at : at + TOGETHER]) for at in range(0, len(samples), TOGETHER)])
    d = np.abs(hist[1:] - hist[:-1]).sum(axis=1) / 2
    total, squares = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    low, high = np.maximum(0, np.arange(len(d)) - CUT_WINDOW), np.minimum(len(d), np.arange(len(d)) + CUT_WINDOW + 1)
    others = np.maximum(1, high - low - 1)  # the difference itself does not count
    mean = (total[high] - total[low] - d) / others
    spread = np.sqrt(np.maximum(0, (squares[high] - squares[low] - d * d) / others - mean**2))
    left, right = np.concatenate([[-1], d[:-1]]), np.concatenate([d[1:], [-1]])
    return (1 + np.flatnonzero((d > mean + CUT_SIGMAS * spread) & (d > CUT_LEAST) & (d > left) & (d >= right))).tolist()


def clips(samples: np.ndarray, rate: float = RATE) -> list[dict]:
    """Timed clip rows between cuts."""
    at = [0, *cuts(samples), len(samples)]
    return [
        {"clip": i, "first_frame": a, "frames": b - a, "start_s": a / rate, "end_s": b / rate} for i, (a, b) in enumerate(zip(at, at[1:])) if b > a
    ]


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw + b"\xff" * ((-len(raw)) % FRAME if raw else FRAME)


def stored(texts: list[str]) -> list[bytes]:
    """The AVI file of each text."""
    loads = [payload(t) for t in texts]
    frames = encode_frames(np.frombuffer(b"".join(loads), np.uint8).reshape(-1, FRAME))
    ends = np.cumsum([len(p) // FRAME for p in loads]).tolist()
    return [write_avi(frames[a:b]) for a, b in zip([0, *ends], ends)]


def store(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: the media column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _groups(batches, "text", lambda t: len(t) + FRAME):
            columns = [pa.array(ids, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(stored(texts), pa.binary())]
            yield pa.record_batch(columns, ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", or_empty("text").alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def _groups(batches: Iterator[pa.RecordBatch], column: str, size, limit: int = 1 << 21) -> Iterator[tuple]:
    """Rows (doc_id, column[, n_bytes]) in groups of about ``limit`` bytes; they may span batches."""
    for batch in batches:
        names = ["doc_id", column] + ["n_bytes"] * ("n_bytes" in batch.schema.names)
        held: list[tuple] = []
        total = 0
        for row in zip(*(batch[c] for c in names)):
            held.append(tuple(x.as_py() for x in row))
            total += size(held[-1][1])
            if total >= limit:
                yield tuple(map(list, zip(*held)))
                held, total = [], 0
        if held:
            yield tuple(map(list, zip(*held)))


def examine(media: DataFrame) -> DataFrame:
    """Reads a media column back: digests of payload and file, features, clips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, files, sizes in _groups(batches, "media", len):
            parsed = [parse_avi(f) for f in files]
            samples = decode_frames([f[a : a + n] for f, (_, frames) in zip(files, parsed) for a, n in frames])
            rows, at = [], 0
            for doc, n_bytes, data, (rate, frames) in zip(ids, sizes, files, parsed):
                own = samples[at : at + len(frames)]
                at += len(frames)
                load, rows_of = own.tobytes(), clips(own, rate)
                feature = f"frames={len(own)};rate={rate:g};mean={own.mean():.3f};shots=" + ",".join(str(c["first_frame"]) for c in rows_of)
                digest = (hashlib.sha256(load).hexdigest(), zlib.crc32(load[-32:]), len(data), hashlib.sha256(data).hexdigest())
                rows.append((doc, n_bytes, len(load), *digest, feature, rows_of))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            kinds.append(pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"])

    return media.mapInArrow(run, RESULT)


def clip_rows(media: DataFrame) -> DataFrame:
    """A row for each clip of each file."""
    return examine(media).select("doc_id", F.inline("clips"))
