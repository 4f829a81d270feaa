"""Token ids of whole texts with a byte-level BPE tokenizer file, fast on repeated words.

In a byte-level BPE of this kind a blank after a character that is no white space always begins a new piece, and so does the last
blank of a run of white space before a word. So does a point or the like after an ASCII letter, and a line feed between a visible ASCII character and
an ASCII letter is a piece of its own. A text is therefore cut there, and every different word is encoded once by the tokenizer and remembered
in arrays (a bounded memory), which all words of many texts are looked up in together. A text with a blank between other white space is
encoded as a whole, and so is one that holds a string of the tokenizer's added tokens.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from canasta.llm.terms import powers
from canasta.llm.words import mixed

WORDS = 1_500_000                            # remembered, some 100 MB; beyond that memory starts anew
SLOTS = 22                                   # bits of the number of slots
TOGETHER = 1 << 20                           # bytes of text whose words are looked up together
LINE = 2_000                                 # new words that are encoded as one line
_INNER_BLANK = re.compile(r"\s (?:\s|\Z)")
_VALUES = np.random.default_rng(31).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
_KIND = np.zeros(256, np.uint8)               # 1: other visible ASCII characters, 2: letters, 3: points and the like, 4: line feed, 5: blank
_KIND[0x21:0x7F] = 1
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 2
_KIND[[ord(c) for c in ".,;:!?"]] = 3
_KIND[10], _KIND[32] = 4, 5


class Memory:
    """Ids of words, found by two 64-bit hashes: an open hash table in arrays."""

    def __init__(self) -> None:
        self.slots = np.full(1 << SLOTS, -1, np.int32)
        self.n = self.used = 0
        self.h1, self.h2 = (np.empty(1 << 16, np.uint64) for _ in range(2))
        self.at, self.count = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32)
        self.ids = np.empty(1 << 18, np.uint32)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if it is not known."""
        out, todo, slot = np.full(len(h1), -1, np.int64), np.arange(len(h1)), (h1 >> np.uint64(64 - SLOTS)).astype(np.int64)
        while len(todo):
            entry = self.slots[slot]
            hit = (entry >= 0) & (self.h1[entry] == h1[todo]) & (self.h2[entry] == h2[todo])
            out[todo[hit]] = entry[hit]
            on = (entry >= 0) & ~hit
            todo, slot = todo[on], (slot[on] + 1) & ((1 << SLOTS) - 1)
        return out

    def add(self, h1: np.ndarray, h2: np.ndarray, ids: list[bytes]) -> None:
        """Different words that are not known yet."""
        sizes = np.array([len(x) // 4 for x in ids], np.int32)
        flat = np.frombuffer(b"".join(ids), "<u4")
        end, last = self.n + len(ids), self.used + len(flat)
        for name in ("h1", "h2", "at", "count"):
            if len(getattr(self, name)) < end:
                setattr(self, name, np.resize(getattr(self, name), max(end, 2 * len(getattr(self, name)))))
        if len(self.ids) < last:
            self.ids = np.resize(self.ids, max(last, 2 * len(self.ids)))
        self.h1[self.n:end], self.h2[self.n:end], self.count[self.n:end] = h1, h2, sizes
        self.at[self.n:end] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used:last] = flat
        todo, slot = np.arange(self.n, end, dtype=np.int32), (h1 >> np.uint64(64 - SLOTS)).astype(np.int64)
        self.n, self.used = end, last
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]              # of several words that want a slot one gets it
            on = self.slots[slot] != todo
            todo, slot = todo[on], (slot[on] + 1) & ((1 << SLOTS) - 1)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # strings that the tokenizer finds before it looks for words, such as <|endoftext|>
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.blank = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True    # tokens that begin with a blank
        self.memory = Memory()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk. Words with a blank before them are encoded as one line, and told apart by the blanks' tokens."""
        line = [c for c in chunks if c[:1] == " " and len(c) > 1 and not c[1].isspace() and not c[-1].isspace()]
        joined = "".join(line)
        if any(x in joined for x in self.added):         # only across words: the text has none
            return self.whole(chunks)
        ids = np.frombuffer(self.whole([joined])[0], "<u4") if line else np.empty(0, "<u4")
        begins = np.flatnonzero(self.blank[ids]).tolist() if line else []
        if len(begins) != len(line):
            return self.whole(chunks)
        data, ends = ids.tobytes(), [*begins[1:], len(ids)]
        own = {c: data[4 * a:4 * b] for c, a, b in zip(line, begins, ends)}
        rest = [c for c in chunks if c not in own]
        own.update(zip(rest, self.whole(rest)) if rest else ())
        return [own[c] for c in chunks]

    def _pieces(self, texts: list[str], out: list[list[bytes]]) -> Iterator[tuple[int, bytes]]:
        """(text, part of it) of the texts that can be cut at blanks; the others are encoded into `out`."""
        for i, text in enumerate(texts):
            if _INNER_BLANK.search(text) or any(x in text for x in self.added):
                out[i] = self.whole([text])
                continue
            data, begin = text.encode(), 0
            while begin < len(data) or not begin:
                cut = data.find(b" ", begin + TOGETHER) if len(data) - begin > TOGETHER else -1
                end = cut if cut >= 0 else len(data)
                yield i, data[begin:end]
                if end == len(data):
                    break
                begin = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0

        def flush():
            for (i, _), ids in zip(held, self._parts([p for _, p in held])):
                out[i].append(ids)

        for piece in self._pieces(texts, out):
            if len(piece[1]) > 2 * TOGETHER:                 # a word longer than that
                flush()
                held, size = [], 0
                out[piece[0]] += self.whole([piece[1].decode()])
                continue
            if held and size + len(piece[1]) > TOGETHER:
                flush()
                held, size = [], 0
            held.append(piece)
            size += len(piece[1])
        flush()
        return [b"".join(x) for x in out]

    def ids(self, text: str) -> bytes:
        return self.encode([text])[0]

    def _parts(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part."""
        if not parts:
            return []
        stream = b"".join(parts)
        raw = np.frombuffer(stream, np.uint8)
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        kind = np.concatenate([np.zeros(2, np.uint8), _KIND[raw]])
        inside = np.ones(len(raw), np.uint8)                 # 0 and 1 from a part's beginning: what is before belongs to another part
        starts = first[:-1][np.diff(first) > 0]
        inside[starts] = 0
        one, two, this = kind[1:-1], kind[:-2], kind[2:]
        second = np.ones(len(raw), bool)
        second[starts[starts + 1 < len(raw)] + 1] = False
        cut = (this == 5) | (inside > 0) & ((this == 3) & (one == 2) | (this == 4) & (one > 0) & (one < 4) | second & (this == 2) & (one == 4) & (two > 0) & (two < 4))
        cut[starts] = True
        begins = np.flatnonzero(cut)
        if not len(begins):
            return [b""] * len(parts)
        ends = np.append(begins[1:], len(raw))
        up, down = powers(len(raw) + 1)
        hashes = []
        for value in _VALUES:
            total = np.concatenate([[np.uint64(0)], np.cumsum(value[raw] * up[:len(raw)])])
            hashes.append(mixed((total[ends] - total[begins]) * down[begins] ^ (ends - begins).astype(np.uint64)))
        h1, h2 = hashes
        known = self.memory.find(h1, h2)
        while (known < 0).any():
            missing = np.flatnonzero(known < 0)
            new = missing[np.unique(h1[missing], return_index=True)[1]]
            if self.memory.n + len(new) > WORDS and self.memory.n:
                self.memory = Memory()
                known[:] = -1
                continue
            chunks = [stream[a:b].decode() for a, b in zip(begins[new].tolist(), ends[new].tolist())]
            ids = [x for k in range(0, len(chunks), LINE) for x in self._chunks(chunks[k:k + LINE])]
            self.memory.add(h1[new], h2[new], ids)
            known[missing] = self.memory.find(h1[missing], h2[missing])
        count = self.memory.count[known].astype(np.int64)
        upto = np.cumsum(count)
        flat = self.memory.ids[np.repeat(self.memory.at[known] - (upto - count), count) + np.arange(upto[-1])].astype("<u4").tobytes()
        edge = np.concatenate([[0], upto])[np.searchsorted(begins, first)].tolist()
        return [flat[4 * a:4 * b] for a, b in zip(edge, edge[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """The task process's encoder for a tokenizer file; by default the public 50k byte-level BPE installed there."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
