"""A compressed FM-index over sequences of symbols: wavelet matrix, backward search, truncated matching statistics."""

from __future__ import annotations

import numpy as np

_WORD = np.uint64(64)
_ONE = np.uint64(1)


class Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = i >> 6
        low = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class Wavelet:
    """Wavelet matrix over symbols below ``2**levels``: rank of a symbol in ``levels`` bit-vector ranks."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[Bits] = []
        self.zeros: list[int] = []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            b = (s >> level) & 1
            self.bits.append(Bits(b))
            self.zeros.append(int(len(b) - b.sum()))
            s = np.concatenate((s[b == 0], s[b == 1]))
        self.base = self._place(np.arange(sigma), np.zeros(sigma, np.int64))

    def _place(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self.bits[k].rank(i)
            i = np.where((c >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol ``c`` before position ``i``, elementwise."""
        return self._place(c, i) - self.base[c]


class FMIndex:
    """Index of a text of symbols (0 separates sequences) for patterns of ``depth`` symbols.

    Suffixes are sorted by their first 64 symbols, which fixes the interval of every pattern of up to 63.  Kept are
    the wavelet matrix of the Burrows-Wheeler transform, symbol counts, and for the runs of suffixes that agree on
    ``depth`` symbols a boundary bit vector and the smallest owner.
    """

    def __init__(self, text: np.ndarray, sigma: int, owner: np.ndarray, depth: int) -> None:
        if not 32 <= depth < 63:
            raise ValueError("depth must lie in 32..62")
        n = len(text)
        rank = text.astype(np.int64)
        at_32 = rank
        for step in (1, 2, 4, 8, 16, 32):
            if step == 32:
                at_32 = rank
            nxt = np.full(n, -1, np.int64)
            nxt[: n - step] = rank[step:] if step < n else []
            _, rank = np.unique(rank * np.int64(n + sigma + 2) + nxt + 1, return_inverse=True)
        order = np.argsort(rank, kind="stable")
        self.n, self.depth, self.sigma = n, depth, sigma
        self.wavelet = Wavelet(text[order - 1].astype(np.int64), sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        far = np.full(n + depth, -1, np.int64)
        far[:n] = at_32
        head, tail = at_32[order], far[order + depth - 32]
        starts = np.ones(n, bool)
        starts[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
        self.runs = Bits(starts)
        self.run_at = np.append(np.flatnonzero(starts), n)
        self.least = np.minimum.reduceat(owner[order], self.run_at[:-1]) if n else owner

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of ``c`` before each pattern."""
        return self.first[c] + self.wavelet.rank(c, lo), self.first[c] + self.wavelet.rank(c, hi)

    def least_owner(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each sequence ``text[start:start+size]``, streamed from its end, the smallest owner of the window
        of ``depth`` symbols at every position; positions without a whole window, or a match that long, get the
        largest integer.

        All sequences advance together.  Once a match is ``depth`` long, the step to the next window extends it by
        one symbol on the left and widens the interval to the run of suffixes agreeing on ``depth`` symbols.
        """
        out = np.full(len(text), np.iinfo(np.int64).max)
        order = np.argsort(-size, kind="stable")
        lo, hi = np.zeros(len(size), np.int64), np.full(len(size), self.n, np.int64)
        length = np.zeros(len(size), np.int64)
        for t in range(int(size.max(initial=0))):
            live = order[: np.searchsorted(-size[order], -t, "left")]
            at = start[live] + size[live] - 1 - t
            c = text[at]
            a, b = self.extend(c, lo[live], hi[live])
            lost = a >= b
            length[live] = np.where(lost, 0, length[live] + 1)
            lo[live], hi[live] = np.where(lost, 0, a), np.where(lost, self.n, b)
            full = live[length[live] >= self.depth]
            if len(full):
                run = self.runs.rank(lo[full] + 1) - 1
                lo[full], hi[full] = self.run_at[run], self.run_at[run + 1]
                out[start[full] + size[full] - 1 - t] = self.least[run]
        return out
