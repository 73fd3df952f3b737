"""Draws of replicates within a task: MD5 of 'seed-replicate-position' for all positions at once, and what follows from it.

The digests are those of ``md5`` in SQL. A text has one block of 64 bytes, whose words are the same for all positions but for the digits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Positions worked on at once, so that what is worked on stays in the cache.
CHUNK = 16_384


def _mixed(words: list, n: int) -> list[np.ndarray]:
    """The four words of the digests of ``n`` blocks; each of the 16 ``words`` is a number, the same for all, or an array."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        kind = i // 16
        g = (i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16
        if kind == 0:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif kind == 1:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif kind == 2:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        np.add(t, a, out=t)
        if isinstance(words[g], int):
            np.add(t, np.uint32((words[g] + _K[i]) & 0xFFFFFFFF), out=t)
        else:
            np.add(t, words[g], out=t)
            np.add(t, np.uint32(_K[i]), out=t)
        s = _TURNS[kind][i % 4]
        np.left_shift(t, np.uint32(s), out=u)
        np.right_shift(t, np.uint32(32 - s), out=t)
        np.bitwise_or(t, u, out=t)
        # the oldest word's memory takes the new one
        np.add(t, b, out=a)
        a, b, c, d = d, a, b, c
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), _START, strict=True)]


class Digests:
    """Digests of '<prefix><position>' for positions 0 to n - 1, for one prefix after another."""

    def __init__(self, n: int):
        self.n, self._length, self._digits = n, -1, []

    def _laid_out(self, length: int) -> None:
        """The digits of all positions, and the end mark, as words of a block in which ``length`` bytes come first."""
        self._length, self._digits = length, []
        first, size = 0, 1
        while first < self.n:
            last = min(self.n, 10**size)
            for low in range(first, last, CHUNK):
                rest, words = np.arange(low, min(last, low + CHUNK), dtype=np.uint32), {}
                for place in range(length + size - 1, length - 1, -1):
                    digit = (rest % np.uint32(10) + np.uint32(48)) << np.uint32(8 * (place % 4))
                    words[place // 4] = words[place // 4] | digit if place // 4 in words else digit
                    rest //= np.uint32(10)
                self._digits.append((low, len(rest), length + size, words))
            first, size = last, size + 1

    def of(self, prefix: str) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first position, the digests' four little-endian words) of each chunk."""
        text = prefix.encode()
        if self.n > 10**9 or len(text) > 40:
            raise ValueError("too long for one block")
        if len(text) != self._length:
            self._laid_out(len(text))
        for low, n, length, digits in self._digits:
            block = bytearray(64)
            block[: len(text)], block[length], block[56:58] = text, 0x80, (8 * length).to_bytes(2, "little")
            words = [int.from_bytes(block[4 * i : 4 * i + 4], "little") for i in range(16)]
            yield low, _mixed([w if i not in digits else digits[i] | np.uint32(w) for i, w in enumerate(words)], n)

    def drawn(self, prefix: str, units: int) -> np.ndarray:
        """The unit that each position takes: the first 32 bits modulo ``units``."""
        out = np.empty(self.n, np.int64)
        for low, (a, *_) in self.of(prefix):
            out[low : low + len(a)] = a.byteswap() % np.uint32(units)
        return out

    def order(self, prefix: str) -> np.ndarray:
        """Positions in the order of their digests' text, then of position."""
        high, low_bits = np.empty(self.n, np.uint64), None
        for low, (a, b, _, _) in self.of(prefix):
            high[low : low + len(a)] = (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()
        order = np.argsort(high)
        placed = high[order]
        if (placed[1:] == placed[:-1]).any():
            low_bits = np.empty(self.n, np.uint64)
            for low, (_, _, c, d) in self.of(prefix):
                low_bits[low : low + len(c)] = (c.byteswap().astype(np.uint64) << np.uint64(32)) | d.byteswap()
            order = np.lexsort((np.arange(self.n), low_bits, high))
        return order
