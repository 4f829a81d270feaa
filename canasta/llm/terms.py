"""Terms of many texts at once: numbers of a bounded vocabulary, in memory that does not depend on the length of a text.

A term is a run of ASCII digits, ASCII letters and characters beyond ASCII; only A-Z count as a-z.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from canasta.llm.words import mixed

SLICE = 1 << 20                  # bytes of a text that are handled together, about
SHARD = 4 << 20                  # bytes of slices that are handled together
INSIDE = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    INSIDE[_a:_b] = True
BETWEEN = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_BASE = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + SLICE // 4)
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def hashed(stream: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, size, hash) of the terms of a stream; its last byte must be no part of a term."""
    raw = np.frombuffer(stream, np.uint8)
    edge = np.flatnonzero(np.diff(INSIDE[raw].view(np.int8), prepend=np.int8(0)))
    begin, end = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    total = np.cumsum(_VALUE[raw] * up[:len(raw)])           # up to and with each byte
    before = np.where(begin > 0, total[begin - 1], np.uint64(0)) if len(begin) else total[:0]
    return begin, end - begin, mixed((total[end - 1] - before) * down[begin])


def slices(text: bytes, longest: int) -> Iterator[bytes]:
    """A text in parts of about `SLICE` bytes, cut between terms. A term with more than `longest` bytes at a cut is shortened, to more than
    `longest` bytes."""
    begin = 0
    while len(text) - begin > SLICE + longest + 1:
        bound = begin + SLICE
        hit = BETWEEN.search(text, bound)
        end = hit.start() if hit else len(text)
        yield text[begin:min(end, bound + longest + 1)]
        begin = end
    yield text[begin:]


def shards(texts: list[bytes], longest: int) -> Iterator[list[tuple[int, bytes]]]:
    """Lists of (number of the text, part of it) of about `SHARD` bytes each, in order; every text has a part."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for part in slices(text, longest):
            if held and size + len(part) > SHARD:
                yield held
                held, size = [], 0
            held.append((i, part))
            size += len(part)
    if held:
        yield held


class Vocabulary:
    """Numbers 1, 2, ... of terms; 0 stands for every other term. Terms are told apart by 64-bit hashes."""

    def __init__(self, hashes: np.ndarray, longest: int) -> None:
        self.hashes = np.unique(hashes)
        self.longest = longest           # bytes of its longest term

    def __len__(self) -> int:
        return len(self.hashes)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0).astype(np.int32)

    def read(self, shard: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(text, number) of every term of a shard."""
        texts, numbers = [], []
        for i, j in _runs([len(part) for _, part in shard]):
            begin, size, hash_ = hashed(b"\n".join([*(part for _, part in shard[i:j]), b""]))
            ends = np.cumsum([len(part) + 1 for _, part in shard[i:j]])
            owner = np.array([text for text, _ in shard[i:j]], np.int64)
            texts.append(owner[np.searchsorted(ends, begin, "right")])
            numbers.append(np.where(size <= self.longest, self.numbers(hash_), 0).astype(np.int32))
        return np.concatenate(texts), np.concatenate(numbers)


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > SLICE:
            yield begin, i
            begin, total = i, 0
        total += n
    yield begin, len(sizes)
