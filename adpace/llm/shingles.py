"""Word shingles as sorted 64-bit keys, a whole Arrow batch at a time."""

from __future__ import annotations

import numpy as np

#: Odd, so that powers have inverses modulo 2**64.
_BASE = 0x2D358DCCAA6C78A5 | 1
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at a time; a longer text is one step of its own.
STEP = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), 1 << 64))
        out = np.concatenate([out, out * step])
    return out[:n]


class Shingler:
    """Distinct shingles of ``width`` words of ASCII-lower-cased texts."""

    def __init__(self, width: int):
        self.width = width
        self.powers = self.inverse = np.ones(0, dtype=np.uint64)

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """A sorted array of distinct keys for each text: empty without words, one key if there are few."""
        out: list[np.ndarray] = []
        waiting: list[bytes] = []
        size = 0
        for text in texts:
            waiting.append(text or b"")
            size += len(waiting[-1])
            if size >= STEP:
                out += self._step(waiting)
                waiting, size = [], 0
        return out + self._step(waiting) if waiting else out

    def _step(self, texts: list[bytes]) -> list[np.ndarray]:
        # A space around each text ends its words.
        joined = np.frombuffer(b" " + b" ".join(texts).lower() + b" ", dtype=np.uint8)
        if len(self.powers) < len(joined):
            n = 1 << len(joined).bit_length()
            self.powers = _powers(_BASE, n)
            self.inverse = _powers(pow(_BASE, -1, 1 << 64), n)
        space = _IS_SPACE[joined]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        upto = np.zeros(len(joined) + 1, dtype=np.uint64)
        np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * self.powers[: len(joined)], out=upto[1:])
        words = mixed((upto[ends] - upto[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        borders = np.cumsum([1, *[len(t) + 1 for t in texts]])
        at = np.searchsorted(starts, borders)
        return [self._one(words[at[i] : at[i + 1]]) for i in range(len(texts))]

    def _one(self, words: np.ndarray) -> np.ndarray:
        n = len(words)
        if not n:
            return words
        if n < self.width:
            return mixed(_chain(words, n) + np.uint64(n))[:1]
        return np.unique(mixed(_chain(words, self.width)))


def _chain(words: np.ndarray, width: int) -> np.ndarray:
    """One key for each run of ``width`` words, in their order."""
    n = len(words) - width + 1
    key = words[:n].copy()
    for i in range(1, width):
        key = key * np.uint64(_MIX[0]) + words[i : i + n]
    return key
