"""Words of many texts at once, as hashes and byte places."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
_VALUE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
TOGETHER = 1 << 20          # bytes whose words are hashed together
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    stream: bytes            # all texts, a line feed after each
    begin: np.ndarray        # byte place of each word
    end: np.ndarray
    hash: np.ndarray         # 64 bits per word
    first: np.ndarray        # first word of each text, and the number of words at the end

    def __init__(self, texts: list[bytes]) -> None:
        self.stream = b"\n".join([*texts, b""])
        raw = np.frombuffer(self.stream, np.uint8)
        edge = np.flatnonzero(np.diff(BLANK[raw].astype(np.int8), prepend=np.int8(1)))
        self.begin, self.end = edge[::2], edge[1::2]         # the stream ends with a blank
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.concatenate([[0], np.searchsorted(self.begin, text_ends)])
        if not len(self.begin):
            self.hash = np.empty(0, np.uint64)
            return
        self.hash = np.empty(len(self.begin), np.uint64)
        for i, j in _stretches(self.begin, self.end):
            low, high = int(self.begin[i]), int(self.end[j - 1])
            up, down = _powers(high - low)
            total = np.cumsum(_VALUE[raw[low:high]] * up[:high - low])          # up to and with each byte
            begin, end = self.begin[i:j] - low, self.end[i:j] - low
            before = np.where(begin > 0, total[begin - 1], np.uint64(0))
            self.hash[i:j] = mixed((total[end - 1] - before) * down[begin])


def _stretches(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words that lie within `TOGETHER` bytes; a longer word is a range of its own."""
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + TOGETHER, "right")))
        yield i, j
        i = j


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for the usual length."""
    if n <= TOGETHER and _POWERS:
        return _POWERS[0], _POWERS[1]
    made = [np.cumprod(np.append(np.uint64(1), np.full(max(n, TOGETHER) - 1, b, np.uint64))) for b in (int(_BASE), pow(int(_BASE), -1, 1 << 64))]
    if n <= TOGETHER:
        _POWERS[:] = made
    return made[0], made[1]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each word; empty if there are fewer."""
    m = max(len(hashes) - n + 1, 0)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * _BASE + hashes[i:i + m]
    return mixed(out)


def least(values: np.ndarray, n: int) -> np.ndarray:
    """Smallest of the n values that begin at each place."""
    out, width = values, 1
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[:len(values) - n + 1], out[n - width:n - width + len(values) - n + 1]) if len(values) >= n else values[:0]
