"""Benchmark decontamination with an FM-index per training shard.

The benchmark's windows of `window` words (a shorter item is one window) are phrases over a small vocabulary. A task reads its documents in shards
of a few megabytes. A shard's index holds the runs of vocabulary words that are long enough for a phrase: their suffixes in order, the
word before each suffix in a wavelet matrix, and the positions of every 16th suffix and of every run's first word. Phrases are searched
backwards, all at once, through wavelet ranks; a phrase's rows walk back word by word to a sampled position, which gives the place.
Places become spans of words, overlapping ones are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canasta.llm.batches import map_arrow, texts_of
from canasta.llm.substring import Wavelet
from canasta.llm.terms import BETWEEN, Vocabulary, hashed, shards
from canasta.operators.skew import cut

WINDOW = 10
SAMPLED = 16                # text positions between two that the index keeps
PIECE = 1 << 14             # words of an item that stand in one row
BLOCK = 1 << 20             # words of the benchmark that are sent to the tasks at once; more words are more blocks


class Ranks(Wavelet):
    """A wavelet matrix that also tells the symbol at a place."""

    def before(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each place, number of that symbol before it)."""
        symbol = np.zeros(len(place), np.int64)
        for i in range(self.levels):
            word, low = place >> 6, (place & 63).astype(np.uint64)
            bits = self.bits[i][word]
            bit = (bits >> low & np.uint64(1)).astype(np.int64)
            ones = self.ones[i][word] + np.bitwise_count(bits & ((np.uint64(1) << low) - np.uint64(1)))
            place = np.where(bit, self.zeros[i] + ones, place - ones)
            symbol = symbol << 1 | bit
        return symbol, place - self.start[symbol]


def suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Suffixes of a text of symbols 1 to `symbols` - 1 in order. Symbol 0 ends a run: every 0 differs from all others, an earlier one
    is smaller. Prefixes double in length until all suffixes differ; only those that do not are sorted again."""
    n = len(text)
    width = max(1, int(symbols - 1).bit_length())
    length = max(1, 62 // width)
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(length):
        symbol = np.where(alive[:n - i] if i else alive, text[i:] if i else text, 0) if i < n else np.zeros(0, np.int64)
        key <<= width
        key[:len(symbol)] |= symbol
        alive[:len(symbol)] &= symbol > 0
        alive[len(symbol):] = False
    order = np.argsort(key)
    sorted_ = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    del key, sorted_
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    todo = np.flatnonzero(~alone)                       # rows whose suffixes are not told apart yet
    while len(todo):
        at = order[todo]
        # a suffix whose compared prefix holds its 0 is placed by its position, later ones by what follows the prefix
        second = np.where(alive[at], rank[np.minimum(at + length, n - 1)], at)
        sub = np.lexsort((second, rank[at]))
        at, second = at[sub], second[sub]
        group = rank[at]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        order[todo] = at
        ends_with = alive[at] & alive[np.minimum(at + length, n - 1)]
        rank[at] = todo[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        alive[at] = ends_with
        length *= 2
        todo = todo[~(new & np.append(new[1:], True))]
    return order


class ShardIndex:
    """FM-index of a text of runs, a 0 after each."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        order = suffix_order(text, symbols)
        self.n = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:-1]
        self.ranks = Ranks(text[order - 1].astype(np.int64), symbols)
        begins = np.ones(self.n, bool)
        begins[1:] = text[:-1] == 0
        kept = begins[order] | (order % SAMPLED == 0)
        self.kept, self.number, self.sample = kept, np.cumsum(kept) - 1, order[kept]

    def find(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, low, high) of the phrases that occur; row i of `phrases` ends with `sizes[i]` symbols."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(which), np.int64), np.full(len(which), self.n)
        done = []
        for step in range(1, phrases.shape[1] + 1):
            symbol = phrases[which, -step]
            low = self.first[symbol] + self.ranks.rank(symbol, low)
            high = self.first[symbol] + self.ranks.rank(symbol, high)
            found = high > low
            full = found & (sizes[which] == step)
            done.append((which[full], low[full], high[full]))
            found &= ~full
            which, low, high = which[found], low[found], high[found]
            if not len(which):
                break
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes at these rows."""
        out, todo, walked = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            hit = self.kept[rows]
            out[todo[hit]] = self.sample[self.number[rows[hit]]] + walked
            todo, rows = todo[~hit], rows[~hit]
            symbol, rank = self.ranks.before(rows)
            rows = self.first[symbol] + rank
            walked += 1
        return out


@dataclass
class Phrases:
    """A block of the benchmark."""
    vocabulary: Vocabulary
    symbols: np.ndarray         # phrase x word, at the right end of each row
    sizes: np.ndarray
    first: np.ndarray           # first of the phrase's items in `items`, and their number at the end
    items: np.ndarray
    names: list[str | None]

    @classmethod
    def of(cls, pieces: pa.Table, window: int) -> Phrases:
        hashes = pieces.column("hashes").combine_chunks()
        flat = hashes.flatten().to_numpy().view(np.uint64)
        vocabulary = Vocabulary(flat, max(pieces.column("longest").to_pylist(), default=0))
        numbers, names, found = vocabulary.numbers(flat), {}, []
        begin = 0
        for name, n in zip(pieces.column("item").to_pylist(), pieces.column("n").to_pylist()):
            k = min(window, n)
            rows = np.lib.stride_tricks.sliding_window_view(numbers[begin:begin + n], k)
            rows = np.pad(rows, ((0, 0), (window - k, 0)))
            found.append(np.column_stack([rows, np.full(len(rows), names.setdefault(name, len(names)), np.int32)]))
            begin += n
        both = np.unique(np.concatenate([*found, np.zeros((0, window + 1), np.int32)]), axis=0)
        new = np.ones(len(both), bool)
        new[1:] = (both[1:, :-1] != both[:-1, :-1]).any(1)
        at = np.flatnonzero(new)
        symbols = both[at, :-1]
        return cls(vocabulary, symbols, (symbols > 0).sum(1), np.append(at, len(both)), both[:, -1], list(names))

    def search(self, text: np.ndarray, number: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, length, phrase) of all occurrences in words of which `text` is the text and `number` the vocabulary's number."""
        empty = np.zeros(0, np.int64)
        valid = np.flatnonzero(number)
        new = np.ones(len(valid), bool)
        new[1:] = (valid[1:] != valid[:-1] + 1) | (text[valid[1:]] != text[valid[:-1]])
        run = np.cumsum(new) - 1
        stay = np.bincount(run)[run] >= least if len(run) else np.zeros(0, bool)
        valid, new = valid[stay], new[stay]
        if not len(valid) or not len(self.sizes):
            return empty, empty, empty
        place = np.arange(len(valid)) + np.cumsum(new) - 1
        body = np.zeros(place[-1] + 2, np.int64)
        body[place] = number[valid]
        word = np.zeros(len(body), np.int64)
        word[place] = valid
        index = ShardIndex(body, len(self.vocabulary) + 1)
        phrase, low, high = index.find(self.symbols, self.sizes)
        count = high - low
        rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        phrase = np.repeat(phrase, count)
        return word[index.locate(rows)], self.sizes[phrase], phrase


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def leaks_of(texts: list[bytes], phrases: Phrases, window: int = WINDOW) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """(number of words, merged spans of hit words, names of the items that occur, sorted) of each text."""
    counts = np.zeros(len(texts), np.int64)
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    least = int(phrases.sizes.min()) if len(phrases.sizes) else 1
    rest_of, rest = -1, np.zeros(0, np.int32)            # a text that goes on in the next shard, and its last words
    for shard in shards(texts, phrases.vocabulary.longest):
        text, number = phrases.vocabulary.read(shard)
        held = rest if rest_of == shard[0][0] else rest[:0]
        text, number = np.concatenate([np.full(len(held), rest_of), text]), np.concatenate([held, number])
        at, size, phrase = phrases.search(text, number, least)
        if len(at):
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.subtract.at(edge, at + size, 1)
            hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            new = np.ones(len(hit), bool)
            new[1:] = (hit[1:] != hit[:-1] + 1) | (text[hit[1:]] != text[hit[:-1]])
            begin = np.flatnonzero(new)
            own = np.searchsorted(text, text[hit[begin]])       # the text's first word in this shard
            shift = counts[text[hit[begin]]] - np.where(text[hit[begin]] == rest_of, len(held), 0) - own
            for t, a, b in zip(text[hit[begin]].tolist(), (hit[begin] + shift).tolist(), (np.append(begin[1:], len(hit)) - begin).tolist()):
                spans[t].append((a, a + b))
            pair = np.unique(text[at] * len(phrases.sizes) + phrase)
            t, p = pair // len(phrases.sizes), pair % len(phrases.sizes)
            n = phrases.first[p + 1] - phrases.first[p]
            item = phrases.items[np.repeat(phrases.first[p] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            pair = np.unique(np.repeat(t, n) * len(phrases.names) + item)
            for t, i in zip((pair // len(phrases.names)).tolist(), (pair % len(phrases.names)).tolist()):
                if phrases.names[i] is not None:
                    items[t].add(phrases.names[i])
        counts += np.bincount(text[len(held):], minlength=len(texts))
        rest_of = shard[-1][0]
        mine = number[np.searchsorted(text, rest_of):]
        rest = mine[max(0, len(mine) - window + 1):]
    for n, s, names in zip(counts.tolist(), spans, items):
        yield n, merged(s), sorted(names)


def _pieces(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(item, n, longest, hashes): the items' words in pieces that share `window` - 1 words with the next one; no piece for an item without words."""
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for name, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                _, size, hash_ = hashed(t + b"\n")
                for a in range(0, max(len(hash_) - window + 1, min(1, len(hash_))), PIECE):
                    own = hash_[a:a + PIECE + window - 1]
                    for column, x in zip(out, (name, len(own), int(size[a:a + len(own)].max()), own.view(np.int64))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()),
                                              pa.array(out[3], pa.list_(pa.int64()))], ["item", "n", "longest", "hashes"])

    return map_arrow(items.select(F.col(item).cast("string"), F.col(text)).distinct(), run, "item string, n int, longest int, hashes array<long>")


def _blocks(items: DataFrame, item: str, text: str, window: int, block: int) -> Iterator[Phrases]:
    """The benchmark's phrases in blocks of about `block` words; the driver holds one at a time."""
    pieces = cut(_pieces(items, item, text, window), "pieces")
    blocks = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // block))
    for i in range(blocks):
        yield Phrases.of(pieces.where(F.pmod(F.xxhash64("item", "hashes"), F.lit(blocks)) == i).toArrow(), window)


SPANS = "array<struct<start:long,end:long>>"


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
               window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(key, text_hash, n_words, spans, items) for every row of `docs`: merged spans of words (start, end without) inside any occurrence of a
    window of an item, and the names (keys as strings, sorted) of the items that have one.

    Null and empty texts have no words and no spans, items without words no windows. Repeated rows of `docs` stay repeated; items that repeat a
    key are one item, an item without key hits words but has no name. A benchmark of more than `block` words is searched in several
    passes over the documents, whose spans are merged. `text_hash` (two 64-bit hashes of the text) tells rows of one key apart.
    """
    source = docs.select(F.col(key), F.col(text))
    spark, kind = docs.sparkSession, source.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def passed(phrases: Phrases) -> DataFrame:
        sent = spark.sparkContext.broadcast(phrases)

        def run(batches):
            for batch in batches:
                found = list(leaks_of(texts_of(batch.column(1)), sent.value, window))
                columns = [pa.array([x[0] for x in found], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in found], span),
                           pa.array([x[2] for x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *columns], [key, "h1", "h2", "n_words", "spans", "items"])

        hashes = [F.xxhash64(F.lit(seed), F.col(text)).alias(f"h{seed}") for seed in (1, 2)]
        return map_arrow(source.select(key, text, *hashes), run, f"`{key}` {kind}, h1 long, h2 long, n_words long, spans {SPANS}, items array<string>")

    passes = [passed(phrases) for phrases in _blocks(items, item, item_text, window, block)]
    found = passes[0]
    if len(passes) > 1:
        for other in passes[1:]:
            found = found.unionAll(other)
        # equal rows have equal results in each pass, so sets fold them
        found = (found.groupBy(key, "h1", "h2", "n_words").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.collect_set("items").alias("items"),
                                                               (F.count(F.lit(1)) / len(passes)).cast("long").alias("_n")))

        def joined(batches):
            for batch in batches:
                spans = [merged([(s["start"], s["end"]) for s in row]) for row in batch.column(4).to_pylist()]
                columns = [*batch.columns[:4], pa.array([[{"start": a, "end": b} for a, b in row] for row in spans], span), *batch.columns[5:]]
                yield pa.RecordBatch.from_arrays(columns, names)

        names = [key, "h1", "h2", "n_words", "spans", "items", "_n"]
        found = found.select(key, "h1", "h2", "n_words", "spans", F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"), "_n")
        found = map_arrow(found, joined, f"`{key}` {kind}, h1 long, h2 long, n_words long, spans {SPANS}, items array<string>, _n long")
        found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    return found.select(key, F.struct("h1", "h2").alias("text_hash"), "n_words", "spans", "items")


def remove_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
                 window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """`docs` with the hit words and what stands between them cut out of the text. Other texts, also null ones, and all columns stay as they are."""
    leaks = find_leaks(docs, items, key, text, item, item_text, window, block).where(F.size("spans") > 0)
    gone = cut(leaks.select(F.col("text_hash.h1").alias("_h1"), F.col("text_hash.h2").alias("_h2"), F.col("spans").alias("_spans"))
               .groupBy("_h1", "_h2").agg(F.first("_spans").alias("_spans")), "leaks")
    hashes = {f"_h{seed}": F.xxhash64(F.lit(seed), F.col(text)) for seed in (1, 2)}
    joined = docs.withColumns(hashes).join(gone, ["_h1", "_h2"], "left")
    clean = joined.where(F.col("_spans").isNull()).select(docs.columns)
    hit = joined.where(F.col("_spans").isNotNull()).select(docs.columns + ["_spans"])
    at, names = hit.columns.index(text), docs.columns

    def run(batches):
        for batch in batches:
            texts = [_without(t, s) for t, s in zip(texts_of(batch.column(at)), batch.column(len(names)).to_pylist())]
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return clean.unionAll(map_arrow(hit, run, docs.schema))


def _without(text: bytes, spans: list[dict]) -> str:
    """A text without spans of its words."""
    begins, ends, at = [], [], 0
    for part in slices_with_place(text):
        begin, size, _ = hashed(part + b"\n")
        begins.append(begin + at)
        ends.append(begin + size + at)
        at += len(part)
    begin, end = np.concatenate(begins), np.concatenate(ends)
    out, last = [], 0
    for s in spans:
        out.append(text[last:begin[s["start"]]])
        last = int(end[s["end"] - 1])
    return b"".join([*out, text[last:]]).decode()


def slices_with_place(text: bytes) -> Iterator[bytes]:
    """Parts of a text between terms that join to the text."""
    begin = 0
    while begin < len(text) or not begin:
        hit = BETWEEN.search(text, begin + (1 << 20))
        end = hit.start() if hit else len(text)
        yield text[begin:end]
        begin = end
        if end == len(text):
            return


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """What the contract asks of every document."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return find_leaks(docs, items).select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                                          F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
phrases AS (
  SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS words
  FROM (SELECT item, ws, least({WINDOW}, len(ws)) AS k, unnest(range(1, len(ws) - least({WINDOW}, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
seen AS (
  SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS words
  FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM phrases) WHERE len(ws) >= k)),
hits AS (SELECT r, i, k, item FROM seen JOIN phrases USING (k, words)),
covered AS (SELECT r, count(DISTINCT w) AS n FROM (SELECT r, unnest(range(i, i + k)) AS w FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
named AS (SELECT r, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
       coalesce(named.h, sha256('')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""
