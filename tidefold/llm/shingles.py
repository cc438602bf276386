"""Vectorised five-word shingles and MinHash values of whole texts (numpy, a batch at a time)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS, HASHES, PART = 5, 216, 1 << 22
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240601)
_MULTIPLY = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; the longest so far is kept."""
    if len(_POWERS.get(base, ())) < n:
        with np.errstate(over="ignore"):
            factors = np.full(max(n, 1 << 16), base, np.uint64)
            factors[0] = 1
            _POWERS[base] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS[base][:n]


_INVERSE = pow(_P, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _parts(text: bytes, size: int) -> Iterator[bytes]:
    """Runs of about ``size`` bytes, cut before white space."""
    data, at = np.frombuffer(text, np.uint8), 0
    while at < len(text):
        end = at + size
        while end < len(text) and not len(cut := np.flatnonzero(_SPACE[data[end : end + size]])):
            end += size
        end = min(len(text), end + int(cut[0])) if end < len(text) else len(text)
        yield text[at:end]
        at = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, its text's place). A word is a run of bytes other than blank and 09 to 0D.

    A very long text (alone, from ``in_slices``) is taken part by part.
    """
    if len(texts) == 1 and len(texts[0]) > PART:
        w = np.concatenate([_word_hashes([part])[0] for part in _parts(texts[0], PART)])
        return w, np.zeros(len(w), np.int64)
    return _word_hashes(texts)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(data)), dtype=np.uint64)])
        w = mixed((total[ends] - total[starts]) * _powers(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    return w, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))))


def windows(w: np.ndarray, doc: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of each run of ``words`` words inside a text."""
    if len(w) < words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = np.zeros(len(w) - words + 1, np.uint64)
        for j in range(words):
            g = g * np.uint64(_Q) + w[j : len(w) - words + 1 + j]
        at = np.flatnonzero(doc[: len(g)] == doc[words - 1 :])
        return mixed(g[at]), at


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts one after another, how many each text has).

    A text of 1 to ``words`` - 1 words has one shingle, all its words; one
    without words has none.
    """
    w, doc = word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts))
    g, at = windows(w, doc, words)
    of = doc[at]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        first = np.concatenate([[0], np.cumsum(n)])
        with np.errstate(over="ignore"):
            extra = [mixed(np.array([np.sum(w[first[d] : first[d + 1]] * _powers(_Q, n[d])) + np.uint64(n[d])], np.uint64))[0] for d in short]
        g, of = np.concatenate([g, np.array(extra, np.uint64)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        g, of = g[order], of[order]
    return g, np.bincount(of, minlength=len(texts))


def signatures(hashes: np.ndarray, counts: np.ndarray, block: int = 16_384) -> np.ndarray:
    """MinHash values, ``(texts, HASHES)`` of 32 bits; rows of texts without shingles are all ones."""
    out = np.full((len(counts), HASHES), np.iinfo(np.uint32).max, np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum(counts)
    some = np.flatnonzero(counts)
    i = 0
    while i < len(some):
        start = ends[some[i]] - counts[some[i]]
        j = max(i + 1, int(np.searchsorted(ends[some], start + block, "right")))
        rows, part = some[i:j], low[start : ends[some[j - 1]]]
        cuts = ends[rows] - counts[rows] - start
        for k in range(HASHES):
            v = part * _MULTIPLY[k]
            v += _ADD[k]
            out[rows, k] = np.minimum.reduceat(v, cuts)
        i = j
    return out


def in_slices(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, UTF-8 texts) of about ``limit`` bytes; a longer text comes alone."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = t.encode()
        if held and size + len(b) > limit:
            yield first, held
            held, size, first = [], 0, i
        held.append(b)
        size += len(b)
    if held:
        yield first, held
