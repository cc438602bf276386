import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidefold.llm import media


def read_back(data):
    rate, frames = media.parse_avi(data)
    return media.decode_frames([data[a : a + n] for a, n in frames])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=900), min_size=1, max_size=4))
def test_lossless(texts):
    for text, data in zip(texts, media.stored(texts)):
        load = read_back(data).tobytes()
        assert load == media.payload(text) and len(load) % 576 == 0 and load[: len(text.encode())] == text.encode()


def test_extreme_samples():
    """All differences from -255 to 255, and runs of 255 that must be stuffed."""
    rng = np.random.default_rng(1)
    frames = np.concatenate([np.full((2, 576), 255), np.zeros((2, 576)), np.tile([0, 255], 288)[None], rng.integers(0, 256, (5, 576)), 255 - rng.integers(0, 2, (3, 576))]).astype(np.uint8)
    assert (media.decode_frames(media.encode_frames(frames)) == frames).all()


def slow_decode(frame):
    """Bit by bit, as the standard describes it."""
    (height, width, counts, symbols), at = media._parse_jpeg(frame)
    table = {v: k for k, v in media.huffman(list(counts), list(symbols)).items()}
    bits = "".join(f"{b:08b}" for b in frame[at:-2].replace(b"\xff\x00", b"\xff"))
    out, pos = [], 0
    for i in range(height * width):
        n, code = 0, 0
        while (code, n) not in table:
            code, n = 2 * code + int(bits[pos + n]), n + 1
        size = table[code, n]
        pos += n
        extra = int(bits[pos : pos + size] or "0", 2)
        pos += size
        diff = extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
        out.append((out[i - 1] if i % width else out[i - width] if i else 128) + diff)
    return out


def test_equals_a_bitwise_decoder():
    text = "Some text with ÿÿ and ümlauts. " * 30
    data = media.stored([text])[0]
    _, frames = media.parse_avi(data)
    for (a, n), row in zip(frames, read_back(data)):
        assert slow_decode(data[a : a + n]) == row.tolist()


def test_reads_without_an_index_and_rejects_damage():
    data = media.stored(["x" * 2000])[0]
    at = data.index(b"idx1")
    plain = data[:4] + struct.pack("<I", at - 8) + data[8:at]
    assert media.parse_avi(plain)[1] == media.parse_avi(data)[1]
    for bad in (b"RIFX" + data[4:], data[:60], data[: at + 16] + b"\x07" + data[at + 17 :]):
        with pytest.raises((ValueError, struct.error)):
            media.parse_avi(bad)
    frames = [data[a : a + n] for a, n in media.parse_avi(data)[1]]
    with pytest.raises(ValueError):
        media.decode_frames([frames[0][:-1]])
    with pytest.raises(ValueError):
        media.decode_frames([frames[0][:2] + b"\xff\xc0" + frames[0][4:]])


def test_shots():
    rng = np.random.default_rng(2)
    dark, light = rng.integers(0, 60, (20, 576)), rng.integers(180, 255, (15, 576))
    samples = np.concatenate([dark, light, dark]).astype(np.uint8)
    assert media.cuts(samples) == [20, 35]
    rows = media.clips(samples, 10.0)
    assert [(r["first_frame"], r["frames"], r["start_s"], r["end_s"]) for r in rows] == [(0, 20, 0.0, 2.0), (20, 15, 2.0, 3.5), (35, 20, 3.5, 5.5)]
    assert media.cuts(samples[:1]) == [] and media.cuts(np.repeat(samples[:1], 9, axis=0)) == []


@pytest.mark.parametrize("which", ["edge", "documents", "nothing"])
def test_query_columns(request, which):
    df = request.getfixturevalue(which)
    rows = media.examine(media.store(df)).collect()
    texts = df.select("doc_id", "text").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    expected = []
    for t in texts:
        raw = (t.text or "").encode()
        load = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        expected.append((t.doc_id, len(raw), len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-32:])))
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(expected, key=key)
    by_load = {}
    for r in rows:
        assert by_load.setdefault((r.payload_sha256, r.n_bytes), (r.media_sha256, r.feature, r.media_bytes)) == (r.media_sha256, r.feature, r.media_bytes)
        assert sum(c.frames for c in r.clips) * 576 == r.payload_bytes
    if which == "edge":
        assert media.clip_rows(media.store(df)).count() == sum(len(r.clips) for r in rows)


def test_frames_are_coded_part_by_part(monkeypatch):
    rng = np.random.default_rng(2)
    frames = np.repeat(rng.integers(0, 256, (23, 1), dtype=np.uint8), media.FRAME, axis=1) + rng.integers(0, 9, (23, media.FRAME), dtype=np.uint8)
    whole, cut = media.encode_frames(frames), media.cuts(frames)
    monkeypatch.setattr(media, "TOGETHER", 5)
    assert media.encode_frames(frames) == whole and (media.decode_frames(whole) == frames).all() and media.cuts(frames) == cut
    assert media.encode_frames(frames[:0]) == [] and media.cuts(frames[:0]) == []


def test_cut_off_files_raise_value_errors():
    file = media.stored(["some text " * 200])[0]
    frames = media.encode_frames(np.frombuffer(media.payload("x" * 700), np.uint8).reshape(-1, media.FRAME))
    for n in range(0, len(file), 7):
        with pytest.raises(ValueError):
            rate, places = media.parse_avi(file[:n])
            media.decode_frames([file[:n][a : a + k] for a, k in places] or [b""])
    for n in range(len(frames[0])):
        with pytest.raises(ValueError):
            media.decode_frames([frames[0][:n]])
