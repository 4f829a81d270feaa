"""Packing token sequences into windows of equal capacity by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows, which stand alone, and a rest of less than one window. Rests are gathered into blocks of
a bounded number of windows and cut into items of at most `ITEM` ids. Differencing starts with one partition per item (the item
in one window, the others empty) and always merges the two partitions with the largest imbalance, the fullest window of one with
the emptiest of the other, until one partition is left: near-equal windows. The number of windows begins at the least possible one
and rises by one whenever the fullest window exceeds the capacity.

A block lies within one task, so packing needs no shuffle and no driver; a task ends with one block that may hold a partly filled window.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canasta.llm.batches import map_arrow
from canasta.llm.tokens import encoder

CAPACITY = 1024
WINDOWS = 96         # of a block, about
ITEM = 256           # longest item; a document's rest has at most CAPACITY / ITEM of them


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: item numbers per window. Ties are broken by the items' order."""
    left: list[int] = []     # a node joins two parts of a window: two lower nodes; nodes below len(sizes) are items
    right: list[int] = []
    heap = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1)
        sums[0], nodes[0] = sizes[i], i
        heap.append((-sizes[i], len(heap), sums, nodes))
    count = len(heap)
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, other, others = heap[0]
        sums, mate = sums + other[::-1], others[::-1]
        both = np.flatnonzero((nodes >= 0) & (mate >= 0))
        joined = np.where(nodes >= 0, nodes, mate)
        joined[both] = len(sizes) + len(left) + np.arange(len(both))
        left += nodes[both].tolist()
        right += mate[both].tolist()
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heapreplace(heap, (int(sums[-1] - sums[0]), count, sums, joined[order]))
        count += 1
    out = []
    for node in heap[0][3].tolist() if heap else []:
        items, todo = [], [node] if node >= 0 else []
        while todo:
            x = todo.pop()
            if x < len(sizes):
                items.append(x)
            else:
                todo += [right[x - len(sizes)], left[x - len(sizes)]]
        out.append(sorted(items))
    return out


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows within the capacity; every size is at most the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, windows)
        if all(sum(sizes[i] for i in part) <= capacity for part in parts):
            return [part for part in parts if part]
        windows += 1


def pack(documents: Iterable[tuple[int, int]], capacity: int = CAPACITY, windows: int = WINDOWS, item: int = ITEM) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Pieces (document, start, length, sequence, offset) for a stream of (document, tokens).

    The full windows of a document come before the next document is read, its rest when its block is closed. A document without
    tokens has no piece.
    """
    sequence, rests, total = 0, [], 0

    def close():
        nonlocal sequence
        out = []
        for part in balanced([n for _, _, n in rests], capacity):
            offset = 0
            for i in part:
                out.append((*rests[i], sequence, offset))
                offset += rests[i][2]
            sequence += 1
        return out

    for document, tokens in documents:
        full = tokens - tokens % capacity
        if full:
            yield [(document, start, capacity, sequence + start // capacity, 0) for start in range(0, full, capacity)]
            sequence += full // capacity
        rests += [(document, start, min(item, tokens - start)) for start in range(full, tokens, item)]
        total += tokens - full
        if total >= windows * capacity:
            yield close()
            rests, total = [], 0
    if rests:
        yield close()


PIECE = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0,
                   capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start (ids of the document before it), length, ids_crc32, doc_tokens, sequence_id and offset.

    A document's ids are those of its whole text without special tokens, then `end_id`; a null or empty text has that id alone. Each id
    lies in one piece; pieces fill a sequence without gaps. Repeated rows are packed as often as they occur; null keys stay
    null. `with_ids` adds the ids as little-endian 32-bit numbers. Sequences are numbered within a task (task number times 2^40 on):
    the same input splits give the same result, also when a task is repeated.
    """
    source = docs.select(F.col(key), F.col(text))
    names = [key, *PIECE, *(["ids"] if with_ids else [])]
    kind = source.schema[key].dataType.simpleString()
    kinds = f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in PIECE) + (", ids binary" if with_ids else "")

    def run(batches):
        ids_of, first = encoder(tokenizer), TaskContext.get().partitionId() << 40
        last = int(end_id).to_bytes(4, "little")
        held: dict[int, tuple] = {}          # document -> key, tokens, ids from `begin` on, begin
        key_type = None

        def documents():
            nonlocal key_type
            number = 0
            for batch in batches:
                key_type = batch.schema.field(0).type
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for k, ids in zip(batch.column(0).to_pylist(), ids_of.encode(texts)):
                    ids += last
                    held[number] = (k, len(ids) // 4, ids, 0)
                    yield number, len(ids) // 4
                    number += 1

        out: list[tuple] = []

        def flush():
            columns = list(zip(*out))
            arrays = [pa.array(columns[0], key_type), *[pa.array(c, pa.int64()) for c in columns[1:7]]]
            return pa.RecordBatch.from_arrays([*arrays, *([pa.array(columns[7], pa.binary())] if with_ids else [])], names)

        for pieces in pack(documents(), capacity):
            for document, start, length, sequence, offset in pieces:
                k, tokens, ids, begin = held[document]
                own = ids[4 * (start - begin):4 * (start - begin + length)]
                out.append((k, start, length, zlib.crc32(own), tokens, first + sequence, offset, own))
            for document in {x[0] for x in pieces}:
                k, tokens, ids, begin = held.pop(document)
                full = tokens - tokens % capacity
                if begin < full < tokens:    # its rest waits for the block
                    held[document] = (k, tokens, ids[4 * (full - begin):], full)
            if len(out) >= 4096:
                yield flush()
                out = []
        if out:
            yield flush()

    return map_arrow(source, run, kinds)


def digest(docs: DataFrame) -> DataFrame:
    """One row per piece of every document."""
    return pack_documents(docs)
