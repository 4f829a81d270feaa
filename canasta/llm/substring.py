"""Removal of repeated passages with compressed FM-indexes.

A window is a run of `WINDOW` consecutive words. Every window has a key, the smallest hash of the short word groups in it; equal windows
have equal keys, and neighbouring windows mostly share one. Consecutive windows with one key are a segment. Keys that occur in one
document only are left out; the other segments, equal ones folded, go to shards by key. Each shard builds an FM-index of its segments
(words sorted in order of the next WINDOW words, the preceding words in a wavelet matrix of packed bits) and streams the segments
through it: backward search, dropping the last word after each step, gives for each window the interval of its occurrences and with
that the smallest document that has it. Windows whose smallest document is smaller than their own are removed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canasta.llm.batches import groups, map_arrow, texts_of
from canasta.llm.words import Words, grams, least
from canasta.operators.skew import cut

WINDOW = 13
GROUP = 4                   # words of a group whose hash may become a window's key
RUN = 64                    # windows of a segment at most; longer ones are cut
HOT = 50_000                # a key in more documents than this is replaced by the hash of each whole window
SHARD_WORDS = 400_000       # of an index, about
PARSED = 1 << 20            # bytes of texts that are parsed together


class Wavelet:
    """Wavelet matrix: occurrences of a symbol before a place, from one packed bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level & 1).astype(np.uint8)
            packed = np.packbits(np.pad(bit, (0, 64 - len(bit) % 64)), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.start = self._down(np.arange(size), np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for i, level in enumerate(reversed(range(self.levels))):
            word = place >> 6
            below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[i][word] + np.bitwise_count(self.bits[i][word] & below)
            place = np.where(symbol >> level & 1, self.zeros[i] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._down(symbol, place) - self.start[symbol]


class FmIndex:
    """Index of segments of words. Suffixes are sorted by their first `window` words, which is all that patterns of that length need."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> None:
        self.window = window
        self.alphabet, symbols = np.unique(words, return_inverse=True)
        text = np.zeros(len(words) + len(sizes), np.int64)          # 0 stands between segments
        text[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = symbols + 1
        self.segment = np.repeat(np.arange(len(sizes)), sizes + 1)
        rank, width = text, 1
        while width * 2 <= window:                                   # prefix doubling
            pair = rank * (int(rank.max()) + 1) + np.roll(rank, -width)
            rank, width = np.unique(pair, return_inverse=True)[1], width * 2
        base = int(rank.max()) + 1
        whole = rank * base + np.roll(rank, -(window - width))
        short = rank * base + np.roll(rank, -(window - 1 - width)) if window > width else None
        order = np.argsort(whole, kind="stable")
        self.segment = self.segment[order]
        whole = whole[order]
        self.begins = np.flatnonzero(np.diff(whole, prepend=-1))
        self.group = np.cumsum(np.diff(whole, prepend=-1) != 0) - 1
        if short is None:
            raise ValueError("the window must not be a power of two")
        parent = np.flatnonzero(np.diff(short[order], prepend=-1))
        of = np.repeat(np.arange(len(parent)), np.diff(np.append(parent, len(order))))
        self.low, self.high = parent[of], np.append(parent, len(order))[of + 1]
        before = text[order - 1]
        size = len(self.alphabet) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])[:-1]
        self.wavelet = Wavelet(before, size)
        self.n = len(order)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbol of each word; 0 for one that the index does not have."""
        if not len(self.alphabet):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, 0)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of the patterns with one more word in front."""
        low = self.first[symbol] + self.wavelet.rank(symbol, low)
        high = self.first[symbol] + self.wavelet.rank(symbol, high)
        return low, np.where(symbol > 0, high, low)

    def matches(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval (low, high) of every window of the streamed segments, in their order; empty where the index does not have it."""
        k = self.window
        symbols, begins = self.symbols(words), np.cumsum(sizes) - sizes
        windows = np.maximum(sizes - k + 1, 0)
        out = np.cumsum(windows) - windows
        low_of, high_of = np.zeros(int(windows.sum()), np.int64), np.zeros(int(windows.sum()), np.int64)
        lanes = np.argsort(-windows, kind="stable")
        counts = windows[lanes]

        def seed(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Intervals of the k - 1 words from each place on."""
            low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n)
            for i in reversed(range(k - 1)):
                low, high = self.step(symbols[at + i], low, high)
            return low, high

        lanes = lanes[counts > 0]
        low, high = seed(begins[lanes] + sizes[lanes] - k + 1)
        for s in range(int(counts[0]) if len(lanes) else 0):
            active = int(np.searchsorted(-counts, -s, "left"))       # lanes with more than s windows
            lane, low, high = lanes[:active], low[:active], high[:active]
            at = windows[lane] - 1 - s
            low, high = self.step(symbols[begins[lane] + at], low, high)
            low_of[out[lane] + at], high_of[out[lane] + at] = low, high
            found = high > low
            row = np.where(found, low, 0)
            low, high = self.low[row], self.high[row]                # without the last word
            lost = np.flatnonzero(~found & (at > 0))
            if len(lost):
                low[lost], high[lost] = seed(begins[lane[lost]] + at[lost])
        return low_of, high_of


def least_documents(words: np.ndarray, sizes: np.ndarray, documents: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For every window of every segment, the smallest document of a segment that has it."""
    index = FmIndex(words, sizes, window)
    low, _ = index.matches(words, sizes)
    smallest = np.minimum.reduceat(documents[index.segment], index.begins)
    return smallest[index.group[low]]


def _keys(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, text and key of every window."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    n = max(len(text) - window + 1, 0)
    at = np.flatnonzero(text[:n] == text[window - 1:window - 1 + n])
    key = least(grams(words.hash, GROUP), window - GROUP + 1)[at]
    return at, text[at], key.view(np.int64)


def _runs(at: np.ndarray, text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a run of consecutive windows with one key begins."""
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return np.flatnonzero(new)


def _parsed(batch: pa.RecordBatch, texts: list[bytes]):
    for a, b in groups([len(t) for t in texts], PARSED):
        yield a, Words(texts[a:b])


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, z): z is the compressed text, mark a hash that tells rows of one id apart."""
    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([z.compress(t) for t in texts_of(batch.column(2))], pa.binary())],
                                             ["doc_id", "mark", "z"])
    return map_arrow(docs, run, "doc_id long, mark long, z binary")


def _unpacked(column: pa.Array) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(v) for v in column.to_pylist()]


CONTENT = ["route", "h1", "h2"]


def shared_segments(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, mark, route, at, words, h1, h2): the segments whose key occurs in more than one document, written to the shared folder."""

    def keyed(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, words in _parsed(batch, texts_of(batch.column(1))):
                at, text, key = _keys(words, window)
                run = _runs(at, text, key)
                yield pa.RecordBatch.from_arrays([pa.array(key[run]), pa.array(ids[a + text[run]])], ["key", "doc_id"])

    keys = map_arrow(docs.select("doc_id", "text"), keyed, "key long, doc_id long")
    shared = (keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n"))
              .where(F.col("a") < F.col("b")).select("key", (F.col("n") > HOT).alias("hot")))
    wanted = (keys.join(shared, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot")))

    def segments(batches):
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists, hots = batch.column(3), batch.column(4)
            out: list[list] = [[] for _ in range(5)]
            for a, words in _parsed(batch, _unpacked(batch.column(2))):
                at, text, key = _keys(words, window)
                whole = grams(words.hash, window).view(np.int64)
                bounds = np.searchsorted(text, np.arange(len(words.first)))
                for i in range(len(words.first) - 1):
                    mine = slice(int(bounds[i]), int(bounds[i + 1]))
                    own, places = key[mine], at[mine]
                    keep = np.isin(own, lists[a + i].values.to_numpy())
                    hot = np.isin(own, hots[a + i].values.to_numpy()) if len(hots[a + i]) else np.zeros(len(own), bool)
                    route = np.where(hot, whole[places], own)
                    new = np.ones(len(own), bool)
                    new[1:] = (route[1:] != route[:-1]) | hot[1:]
                    begin = np.flatnonzero(new)
                    size = np.diff(np.append(begin, len(own)))
                    for s, n in zip(begin.tolist(), size.tolist()):
                        for r in range(s, s + n, RUN):
                            if keep[r]:
                                first, last = int(places[r]), int(places[r]) + min(RUN, s + n - r) + window - 2
                                out[0].append(ids[a + i])
                                out[1].append(marks[a + i])
                                out[2].append(route[r])
                                out[3].append(first - int(words.first[i]))
                                out[4].append(words.stream[words.begin[first]:words.end[last]])
            yield pa.RecordBatch.from_arrays([*[pa.array(np.array(c, np.int64)) for c in out[:3]], pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())],
                                             ["doc_id", "mark", "route", "at", "words"])

    found = map_arrow(_packed(docs.select("doc_id", "mark", "text")).join(wanted, "doc_id"), segments, "doc_id long, mark long, route long, at int, words binary")
    return cut(found.select("*", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2")), "segments", "zstd")


def searched_segments(found: DataFrame, window: int) -> DataFrame:
    """(route, h1, h2, best): for each different segment the smallest document per window, written to the shared folder."""
    different = cut(found.groupBy(*CONTENT).agg(F.min("doc_id").alias("doc_id"), F.first("words").alias("words")), "different_segments", "zstd")
    size = different.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = max(1, -(-size // (6 * SHARD_WORDS)))

    def searched(batches):
        def shard(rows: pa.Table) -> pa.RecordBatch:
            words = Words(texts_of(rows.column("words").combine_chunks()))
            sizes = np.diff(words.first)
            best = least_documents(words.hash, sizes, rows.column("doc_id").to_numpy(), window)
            offsets = np.concatenate([[0], np.cumsum(np.maximum(sizes - window + 1, 0))]).astype(np.int32)
            return pa.RecordBatch.from_arrays([*[rows.column(c).combine_chunks() for c in CONTENT], pa.ListArray.from_arrays(offsets, pa.array(best))], [*CONTENT, "best"])

        yield from by_group(batches, "shard", shard)

    dealt = different.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)).cast("int")).repartition("shard").sortWithinPartitions("shard")
    return cut(map_arrow(dealt, searched, "route long, h1 long, h2 long, best array<long>"), "searched_segments", "zstd")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, mark, starts): first words of the windows to remove, for documents (doc_id, mark, text) that have some."""
    if window <= GROUP or window & (window - 1) == 0:
        raise ValueError(f"the window must be longer than {GROUP} and no power of two")
    found = shared_segments(docs, window)
    best = searched_segments(found, window)
    windows = F.transform("best", lambda d, i: F.when(d < F.col("doc_id"), F.col("at") + i))
    gone = F.filter(windows, lambda x: x.isNotNull())
    return (found.select("doc_id", "mark", "at", *CONTENT).join(best, CONTENT).select("doc_id", "mark", gone.alias("gone")).where(F.size("gone") > 0)
            .groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("gone")).alias("starts")))


def by_group(batches, column: str, handle: Callable[[pa.Table], pa.RecordBatch]):
    """`handle` for each group of rows with one value of a sorted column; memory holds one group."""
    held: list[pa.Table] = []
    value = None
    for batch in batches:
        data = pa.Table.from_batches([batch])
        if not data.num_rows:
            continue
        values = data.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), data.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if held and values[a] != value:
                yield handle(pa.concat_tables(held))
                held = []
            value = values[a]
            held.append(data.slice(a, b - a))
    if held:
        yield handle(pa.concat_tables(held))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept) per row: `kept` is the text without the words covered by a window that also starts in a document with a
    smaller key, its words joined by one blank.

    Words are runs of other characters than ASCII white space. Null and empty texts have no words; texts shorter than a window keep
    all. Rows with one key are not smaller than each other. A row without key keeps all its words and is no source for others.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    gone = repeated_windows(rows.where(F.col("doc_id").isNotNull()), window)
    joined = _packed(rows.select("doc_id", "mark", "text")).join(gone, ["doc_id", "mark"], "left")

    def clean(batches):
        for batch in batches:
            starts = batch.column(batch.schema.get_field_index("starts"))
            counts, removed, kept = [], [], []
            for t, s in zip(_unpacked(batch.column(batch.schema.get_field_index("z"))), starts):
                words = t.split()                      # bytes split at ASCII white space
                counts.append(len(words))
                if s.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(s.values.to_numpy())
                    edge[at] += 1
                    np.subtract.at(edge, at + window, 1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [w for w, x in zip(words, stay.tolist()) if x]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(kept, pa.binary()).cast(pa.string())], [key, "n_words", "n_removed", "kept"])

    return map_arrow(joined, clean, f"`{key}` long, n_words long, n_removed long, kept string")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words' digest for every row."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS words
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
first AS (SELECT words, min(doc_id) AS least FROM windows GROUP BY words),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM windows JOIN first USING (words) WHERE least < doc_id),
placed AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w),
kept AS (SELECT placed.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY placed.k) AS text FROM placed ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""
