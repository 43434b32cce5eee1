"""Vectorised words and word hashes of many texts at once.

A word is a maximal run of bytes other than ``0x20`` and ``0x09-0x0D``.  The hash of a word is a sum of
random 64-bit values of its bytes times powers of an odd number, modulo 2**64, then mixed.  Prefix sums
give it for every word of a buffer in a few numpy passes.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables of up to a million entries are kept."""
    held = _powers.get(base)
    if held is not None and len(held) >= n:
        return held[:n]
    out = np.full(max(n, 1 << 16), base, np.uint64)
    out[0] = 1
    np.cumprod(out, out=out)
    if n <= 1 << 21:
        _powers[base] = out
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a byte buffer."""
    word = np.empty(len(buf) + 2, np.int8)
    word[0] = word[-1] = 0
    np.logical_not(SPACE[buf], out=word[1:-1].view(bool))
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges ``[start, end)`` of a buffer."""
    n = len(buf)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[buf] * powers(_BASE, n), out=total[1:])
    return mix((total[end] - total[start]) * powers(_INVERSE, n + 1)[start])


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` consecutive hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_BASE, len(h)), out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(_INVERSE, n))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts joined by line feeds as a byte array, and each text's offset in it (one more at the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), at


class Table:
    """Numbers by 64-bit key in an open-addressing hash table that grows; a key not in it has ``missing``."""

    def __init__(self, missing: int = -1) -> None:
        self.missing = missing
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self._room(1 << 16)

    def _room(self, slots: int) -> None:
        self.slots, self.keys, self.numbers = slots, np.zeros(slots, np.uint64), np.full(slots, self.missing, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key."""
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        out = self.numbers[slot]
        wrong = np.flatnonzero((out != self.missing) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (self.slots - 1)
            out[wrong] = self.numbers[slot[wrong]]
            wrong = wrong[(out[wrong] != self.missing) & (self.keys[slot[wrong]] != keys[wrong])]
        return out

    def put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Add distinct keys that it has not."""
        self.n += len(keys)
        if 2 * self.n > self.slots:
            held = self.numbers != self.missing
            keys, numbers = np.concatenate((self.keys[held], keys)), np.concatenate((self.numbers[held], numbers))
            self._room(1 << (4 * self.n - 1).bit_length())
        numbers = np.asarray(numbers, np.int32)
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        while len(keys):
            free = self.numbers[slot] == self.missing
            _, first = np.unique(slot, return_index=True)
            won = np.zeros(len(keys), bool)
            won[first] = True
            won &= free
            self.keys[slot[won]], self.numbers[slot[won]] = keys[won], numbers[won]
            keys, numbers, slot = keys[~won], numbers[~won], (slot[~won] + 1) & (self.slots - 1)
