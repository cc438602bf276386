"""Hash routing, and the published SipHash-2-4 with 128-bit output."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN, ROWS, WIDTH = 65536, 64, 512
CAPACITY = ROWS * WIDTH * 9 // 10


def selector(key: Column) -> Column:
    """16 bits of a hash which other engines share: the first four hex digits of MD5."""
    return F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int")


def signature(key: Column) -> Column:
    """32 further bits."""
    return F.conv(F.substring(F.md5(key), 5, 8), 16, 10).cast("bigint")


def num_shards(expected: Column) -> Column:
    """How many shards of a power-of-two span hold this many keys."""
    return (F.lit(SPAN) / F.pow(F.lit(2.0), F.floor(F.log2(F.lit(float(SPAN)) / F.greatest(expected / F.lit(float(CAPACITY)), F.lit(1.0)))))).cast("int")


def num_shards_of(expected: int, capacity: int = CAPACITY) -> int:
    return SPAN // 2 ** math.floor(math.log2(SPAN / max(expected / capacity, 1.0)))


def siphash128(data: bytes, key: bytes) -> tuple[int, int]:
    """SipHash-2-4-128 as its authors define it: 16 key bytes, two 64-bit words out."""
    full = (1 << 64) - 1

    def turn(x: int, n: int) -> int:
        return (x << n | x >> (64 - n)) & full

    k0, k1 = (int.from_bytes(key[i : i + 8], "little") for i in (0, 8))
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D ^ 0xEE, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]

    def rounds(n: int) -> None:
        for _ in range(n):
            for a, b, c, d, r, s in ((0, 1, 2, 3, 13, 16), (2, 1, 0, 3, 17, 21)):
                v[a] = (v[a] + v[b]) & full
                v[b] = turn(v[b], r) ^ v[a]
                if a == 0:
                    v[a] = turn(v[a], 32)
                    v[c] = (v[c] + v[d]) & full
                    v[d] = turn(v[d], s) ^ v[c]
                else:
                    v[a] = turn(v[a], 32)
                    v[c] = (v[c] + v[d]) & full
                    v[d] = turn(v[d], s) ^ v[c]

    padded = data + b"\0" * (7 - len(data) % 8) + bytes([len(data) & 255])
    for i in range(0, len(padded), 8):
        m = int.from_bytes(padded[i : i + 8], "little")
        v[3] ^= m
        rounds(2)
        v[0] ^= m
    v[2] ^= 0xEE
    rounds(4)
    first = v[0] ^ v[1] ^ v[2] ^ v[3]
    v[1] ^= 0xDD
    rounds(4)
    return first, v[0] ^ v[1] ^ v[2] ^ v[3]
