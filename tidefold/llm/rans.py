"""Static range asymmetric numeral coding of token ids in independent interleaved blocks.

State 64 bits, renormalised by 32-bit words; frequencies are quantised to a
sum of 2**20, at least 1 for each id that occurs. A block holds ``LANES``
interleaved states; all blocks of a segment are coded in step, as one numpy
vector, but each can be decoded alone from its entry in the index.
"""

from __future__ import annotations

import zlib

import numpy as np

SCALE_BITS, LANES, BLOCK = 20, 32, 1 << 15
LOW = np.uint64(1 << 31)
_U32, _BITS, _MASK = np.uint64(32), np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE_BITS, from the counts of ids (not all 0)."""
    goal, used = 1 << SCALE_BITS, counts > 0
    out = np.where(used, np.maximum(1, counts * (goal / counts.sum())).astype(np.int64), 0)
    order = np.lexsort((np.arange(len(out)), -out))
    excess, i = int(out.sum()) - goal, 0
    while excess:  # a few large ids take up the rounding
        k = order[i % int(used.sum())]
        step = min(excess, int(out[k]) - 1, max(1, int(out[k]) // 2)) if excess > 0 else excess
        out[k] -= step
        excess -= step
        i += 1
    return out


def _starts(freq: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)


def _steps(n: int) -> int:
    return -(-n // LANES)


def encode(ids: np.ndarray, freq: np.ndarray) -> list[dict]:
    """The blocks of ``ids``: n, words (uint32), states (uint64 for each lane), crc32 of the ids as uint32."""
    ids = np.asarray(ids)
    own = [ids[at : at + BLOCK] for at in range(0, len(ids), BLOCK)]
    blocks, steps, last = len(own), _steps(min(len(ids), BLOCK)), _steps(len(own[-1]))
    full = np.full(blocks * steps * LANES, int(np.argmax(freq)), np.int64)
    full[: len(ids)] = ids  # the last step is filled up with the likeliest id
    grid = np.ascontiguousarray(full.reshape(blocks, steps, LANES).transpose(1, 0, 2))
    f_of, c_of = freq.astype(np.uint64), _starts(freq)
    every = np.full((blocks, LANES), LOW, np.uint64)
    words, put = np.empty((steps, blocks, LANES), np.uint32), np.zeros((steps, blocks, LANES), bool)
    for t in range(steps - 1, -1, -1):
        k = blocks if t < last else blocks - 1  # the last block may have fewer steps
        x, s = every[:k], grid[t, :k]
        f, c = f_of[s], c_of[s]
        big = x >= (f << np.uint64(63 - SCALE_BITS))
        words[t, :k], put[t, :k] = x.astype(np.uint32), big
        x = np.where(big, x >> _U32, x)
        q = x // f
        every[:k] = (q << _BITS) + (x - q * f) + c
    words, put = words.transpose(1, 0, 2), put.transpose(1, 0, 2)
    return [{"n": len(o), "words": words[b][put[b]], "states": every[b].copy(), "crc32": zlib.crc32(o.astype("<u4").tobytes())} for b, o in enumerate(own)]


def decode(blocks: list[dict], freq: np.ndarray) -> list[np.ndarray]:
    """The ids of each block, which may differ in length only from long to short; raises ValueError where a check fails."""
    if not blocks:
        return []
    symbol_of = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.uint32), freq)
    f_of, c_of = freq.astype(np.uint64), _starts(freq)
    steps = np.array([_steps(b["n"]) for b in blocks])
    if (np.diff(steps) > 0).any():
        raise ValueError("a short block comes before a long one")
    sizes = [len(b["words"]) for b in blocks]
    words = np.concatenate([b["words"] for b in blocks] + [np.zeros(1, np.uint32)]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    ends = at + sizes
    every = np.array([b["states"] for b in blocks], np.uint64)
    grid = np.zeros((int(steps[0]), len(blocks), LANES), symbol_of.dtype)
    for t in range(int(steps[0])):
        k = int(np.searchsorted(-steps, -t, "left"))  # blocks that have this step
        slot = every[:k] & _MASK
        s = symbol_of[slot]
        grid[t, :k] = s
        x = f_of[s] * (every[:k] >> _BITS) + slot - c_of[s]
        need = x < LOW
        place = at[:k, None] + np.cumsum(need, axis=1) - 1
        every[:k] = np.where(need, (x << _U32) | words[np.clip(place, 0, len(words) - 1)], x)
        at[:k] += need.sum(axis=1)
    out = []
    for b, block in enumerate(blocks):
        ids = grid[: steps[b], b].reshape(-1)[: block["n"]].astype(np.int64)
        if at[b] != ends[b] or (every[b] != LOW).any() or zlib.crc32(ids.astype("<u4").tobytes()) != block["crc32"]:
            raise ValueError("a block is damaged")
        out.append(ids)
    return out
