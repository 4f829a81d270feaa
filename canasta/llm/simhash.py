"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2h bits have a common point that differs from either in at most h bits. So every distinct
fingerprint is sent to all points within h bits of it, the points are shuffled, and fingerprints that meet are linked. Those that
meet in a point are at most as many as the ball has points (65 for h = 1), whatever the data; a chain through them links them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canasta.llm.batches import groups as groups_of, map_arrow, texts_of
from canasta.llm.graph import components
from canasta.llm.words import Words, grams
from canasta.operators.skew import attach, cut, discard, hashable

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
HASHES = 1 << 16     # shingle hashes whose bits are counted together


def shingle_hashes(words: list[bytes], size: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of `size` words, in parts; fewer words make one shingle."""
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    n = len(words) - k + 1
    hashed = xxhash.xxh64_intdigest
    spans = list(zip(begins[:n].tolist(), ends[k - 1:].tolist()))
    for i in range(0, n, HASHES):
        yield np.array([hashed(line[a:b], seed) for a, b in spans[i:i + HASHES]], "<u8")


def majority(parts: Iterable[np.ndarray], width: int) -> np.ndarray:
    """Packed bits that more than half of the hashes have; parts are hash x 64-bit word."""
    ones, n = np.zeros(64 * width, np.int64), 0
    for part in parts:
        ones += np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(len(part), 8 * width), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(part)
    return np.packbits(ones * 2 > n, bitorder="little")


def fingerprint(text: bytes, words_per_shingle: int = 3, seed: int = 42) -> int:
    """64 bits; a bit is 1 if more than half of the shingles' XXH64 values have it. A text without words gives 0."""
    words = text.translate(LOWER).split()      # bytes split at space and \x09-\x0d only
    return int(majority(shingle_hashes(words, words_per_shingle, seed), 1).view("<u8")[0]) if words else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp as signed long) per row; a null text counts as empty."""
    source = docs.select(F.col(key), F.col(text))

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(t) for t in texts_of(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], [key, "fp"])

    return map_arrow(source, run, f"`{key}` {source.schema[key].dataType.simpleString()}, fp long")


def close_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints of column fp that connect the same groups as all pairs within `radius` do.

    Every link is checked to be within the radius. `radius` must be even: then all fingerprints that meet in a point
    lie within it of each other, and neighbours in the point's sorted list are enough.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even")
    masks = [sum(1 << i for i in bits) for r in range(radius // 2 + 1) for bits in combinations(range(64), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    points = prints.select("fp").distinct().select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in signed])).alias("point"))
    met = points.select("fp", F.lag("fp").over(Window.partitionBy("point").orderBy("fp")).alias("before"))
    return (met.where(F.col("before").isNotNull()).select(F.col("before").alias("a"), F.col("fp").alias("b")).distinct()
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """(key, fp, component_id) per row of `docs`: component_id is the smallest key of the documents that links reach.

    Documents without words share fingerprint 0 and so one group. Repeated rows stay repeated. Null keys take part as links
    and get the component of their group, null if no document in it has a key. Copies are folded to their fingerprint first.
    """
    prints = cut(fingerprints(docs, key, text), "fingerprints")
    roots = cut(components(close_links(prints, radius)).select(F.col("node").alias("fp"), "root"), "roots")
    first = (prints.groupBy("fp").agg(F.min(key).alias("_first")).join(roots, "fp", "left")
             .select("fp", F.coalesce("root", "fp").alias("_root"), "_first"))
    least = first.groupBy("_root").agg(F.min("_first").alias("component_id"))
    return prints.join(first.join(least, "_root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hex and component_id for every row."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SHINGLE = 5              # words
SHARE = 4, 5             # two texts are near copies if they share 4/5 of the shingles that either has
TOGETHER = 1 << 18       # bytes of text whose words are hashed together
SAMPLE = 5_000           # texts whose shingles tell which are common
COMMON, MOST = 4, 500_000    # texts of the sample with a common shingle, and shingles the driver takes; both decide the order only
FEW = 32                 # texts of a bucket whose pairs are listed
BLOCK = 2048             # texts of a block of a larger bucket


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the 5-word shingles of each text; fewer words make one shingle, none an empty set."""
    out = []
    for i, j in groups_of([len(t) for t in texts], TOGETHER):
        words = Words([t.translate(LOWER) for t in texts[i:j]])
        parts = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        out += [np.unique(grams(h, min(SHINGLE, len(h)))) if len(h) else h for h in parts]
    return out


def prefix(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare before common ones, of which a set that shares 4/5 with it has at least one in its own prefix."""
    n = len(shingles)
    if not n:
        return shingles
    late = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        late = np.where(common[at] == shingles, rank[at] + 1, 0)
    return shingles[np.lexsort((shingles, late))][:n - -(-SHARE[0] * n // SHARE[1]) + 1]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.array(flat))


def _sets(rows: DataFrame, text: str) -> DataFrame:
    """(id, s): the shingles of each text, written to the shared folder."""
    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([digest_of(t) for t in texts], pa.binary()), _lists(shingle_sets(texts))], ["id", "s"])

    found = map_arrow(rows.select(F.col(text)), run, "id binary, s array<long>")
    return cut(found.groupBy("id").agg(F.first("s").alias("s")), "sets")      # rows that repeat key and text


def digest_of(text: bytes) -> bytes:
    """128 bits that tell texts apart by their words; A-Z count as a-z."""
    return hashlib.blake2b(b" ".join(text.translate(LOWER).split()), digest_size=16).digest()


def _common(rows: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles in order of hash and their rank by frequency, from a sample of distinct texts that depends on the texts only."""
    step = max(1, rows.count() // SAMPLE)
    sets = _sets(rows.where(F.pmod(F.xxhash64(text), F.lit(step)) == 0), text)
    found = (sets.select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
             .orderBy(F.desc("n"), "s").limit(MOST).toArrow())
    discard(sets)
    common = found.column("s").to_numpy().view(np.uint64)
    order = np.argsort(common)
    return common[order], order


def _fits(n, m, i, j):
    """May sets of n and m shingles be near copies if the first one they share is at places i and j of theirs?"""
    a, b = SHARE
    rest = F.least(n - i, m - j) if not isinstance(n, (int, np.integer)) else np.minimum(n - i, m - j)
    return rest * (a + b) >= (n + m) * a


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set, about two bits per shingle: bit i tells if an odd number of shingles has the low bits i."""
    size = 64 << max(0, (2 * len(shingles) - 1).bit_length() - 6)
    bits = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def _sketches(rows: DataFrame, text: str) -> DataFrame:
    """(id, m, k): number of shingles and sketch of each text, written to the shared folder."""
    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(0))
            sets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([pa.array([digest_of(t) for t in texts], pa.binary()), pa.array([len(x) for x in sets], pa.int32()),
                                              pa.array([sketch(x) for x in sets], pa.list_(pa.int64()))], ["id", "m", "k"])

    found = map_arrow(rows.select(F.col(text)), run, "id binary, m int, k array<long>")
    return cut(found.groupBy("id").agg(F.first("m").alias("m"), F.first("k").alias("k")), "sketches")


def _may_share(n, m, s, t):
    """May sets of n and m shingles with these sketches share 4/5? Shingles that only one has leave at least as many odd bits."""
    wide, narrow = F.when(F.size(s) >= F.size(t), s).otherwise(t), F.when(F.size(s) >= F.size(t), t).otherwise(s)
    half = F.size(narrow)
    folded = F.when(F.size(wide) == half, wide).otherwise(F.zip_with(F.slice(wide, F.lit(1), half), F.slice(wide, half + 1, half), lambda x, y: x.bitwiseXOR(y)))
    odd = F.aggregate(F.zip_with(narrow, folded, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    a, b = SHARE
    return (F.size(wide) > 2 * half) | (odd * (a + b) <= (n + m) * (b - a))


def _alike(pairs: DataFrame, rows: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) of texts that share 4/5 of their shingles, written to the shared folder. Sketches rule most others out before any set
    is sent."""
    ends = lambda pairs: pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    pairs = cut(pairs.distinct(), "pairs")
    sketches = _sketches(_rows_of(ends(pairs), rows, texts), text)
    both = pairs.join(sketches.toDF("a", "n", "s"), "a").join(sketches.toDF("b", "m", "t"), "b")
    close = cut(both.where(_may_share(F.col("n"), F.col("m"), F.col("s"), F.col("t"))).select("a", "b"), "close")
    discard(pairs, sketches)
    sets = _sets(_rows_of(ends(close), rows, texts), text)
    both = close.join(sets.toDF("a", "s"), "a").join(sets.toDF("b", "t"), "b")
    a, b = SHARE
    links = cut(both.where(F.size(F.array_intersect("s", "t")) * (a + b) >= (F.size("s") + F.size("t")) * a).select("a", "b"), "near")
    discard(close, sets)
    return links


def _rows_of(ids: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """A row of each of these texts; rows alike in all columns come together."""
    return rows.join(texts.join(ids, "id").select("first._row"), "_row", "left_semi")


def _cell(ids: list[bytes], comp: np.ndarray, side: np.ndarray, n: np.ndarray, pos: np.ndarray, flat: np.ndarray, across: bool) -> list[tuple[bytes, bytes]]:
    """Links between texts of a cell that connect what all its pairs connect; `across`: only pairs from different blocks."""
    flat = np.unique(flat, return_inverse=True)[1]
    ends = np.cumsum(n)
    starts, root, links = ends - n, comp.copy(), []
    mark = np.zeros(int(flat.max()) + 1, np.int64)
    for i in range(len(ids) - 1):
        j = np.flatnonzero((root != root[i]) & ((side != side[i]) if across else True) & (np.arange(len(ids)) > i) & _fits(n[i], n, pos[i], pos))
        if not len(j):
            continue
        own = flat[starts[i]:ends[i]]
        mark[own] = 1
        if len(j) * 4 < len(ids):
            shared = np.array([mark[flat[starts[k]:ends[k]]].sum() for k in j])
        else:
            shared = np.add.reduceat(mark[flat], starts)[j]
        mark[own] = 0
        for k in j[shared * sum(SHARE) >= (n[i] + n[j]) * SHARE[0]]:
            if root[k] != root[i]:
                root[root == root[k]] = root[i]
                links.append((ids[i], ids[k]))
    return links


CELL = ["token", "i", "j"]


def _by_cell(batches, handle):
    """`handle` of the rows of each cell, batch by batch; the rows of a cell come one after another."""
    rest = None
    for batch in batches:
        data = pa.Table.from_batches([batch])
        data = data if rest is None else pa.concat_tables([rest, data])
        if not data.num_rows:
            continue
        new = np.zeros(data.num_rows, bool)
        for c in CELL:
            k = data.column(c).to_numpy()
            new[1:] |= k[1:] != k[:-1]
        begins = np.concatenate([[0], np.flatnonzero(new)])
        found = [handle(data.slice(a, b - a)) for a, b in zip(begins[:-1], begins[1:]) if b - a > 1]
        yield from (x for x in found if x.num_rows)
        rest = data.slice(begins[-1])
    if rest is not None and rest.num_rows > 1:
        yield handle(rest)


def _possible(comp: np.ndarray, side: np.ndarray, n: np.ndarray, pos: np.ndarray, sketches: list[np.ndarray], across: bool) -> np.ndarray:
    """Which texts of a cell may be alike one that they are not connected with, by their sketches."""
    size = np.array([len(k) for k in sketches])
    out = np.zeros(len(n), bool)
    a, b = SHARE
    for width in np.unique(size):                      # with sketches as wide, or twice as wide and folded
        near = np.flatnonzero((size == width) | (size == 2 * width))
        table = np.array([k if len(k) == width else k[:width] ^ k[width:] for k in (sketches[i] for i in near)]).view(np.uint64)
        for at in np.flatnonzero(size[near] == width):
            i = near[at]
            open_ = (comp[near] != comp[i]) & ((side[near] != side[i]) if across else True) & _fits(n[i], n[near], pos[i], pos[near])
            j = np.flatnonzero(open_)
            odd = np.bitwise_count(table[j] ^ table[at]).sum(1, dtype=np.int64)
            hit = near[j[odd * (a + b) <= (n[i] + n[near[j]]) * (b - a)]]
            if len(hit):
                out[i] = out[hit] = True
    return out


def _grid(rest: DataFrame, rows: DataFrame, texts: DataFrame, text: str, block: int) -> DataFrame:
    """Links between texts (token, id, n, pos, comp, c) of large buckets, written to the shared folder: blocks of a bucket become a grid of
    cells, compared in parallel, by sketches first; the sets are sent only to cells where their text has a possible partner."""
    sketches = _sketches(_rows_of(rest.select("id").distinct(), rows, texts), text)
    parts = F.ceil(F.col("c") / block).cast("int")
    met = rest.withColumn("parts", parts).withColumn("side", F.pmod(F.xxhash64("id", "token"), F.col("parts").cast("long")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("token", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "id", "comp", "side", "n", "pos")
    names = [*CELL, "id", "comp", "side", "n", "pos"]
    dealt = lambda df, extra: df.select(*names, extra).repartition(*CELL).sortWithinPartitions(*CELL, "id")

    def columns(group: pa.Table):
        column = lambda c: group.column(c).to_numpy()
        comp = group.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        return comp, column("side"), column("n").astype(np.int64), column("pos").astype(np.int64), across

    def sifted(batches):
        def possible(group: pa.Table) -> pa.RecordBatch:
            comp, side, n, pos, across = columns(group)
            lists = group.column("k").combine_chunks()
            ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
            hit = _possible(comp, side, n, pos, [flat[a:b] for a, b in zip(ends[:-1], ends[1:])], across)
            chosen = group.filter(pa.array(hit)).combine_chunks()
            return pa.RecordBatch.from_arrays([chosen.column(c).combine_chunks() for c in names], names)
        yield from _by_cell(batches, possible)

    kinds = "token long, i int, j int, id binary, comp binary, side int, n int, pos int"
    open_ = cut(map_arrow(dealt(met.join(sketches.drop("m"), "id"), "k"), sifted, kinds), "cells", "zstd")
    discard(sketches)
    sets = _sets(_rows_of(open_.select("id").distinct(), rows, texts), text)

    def compared(batches):
        def links(group: pa.Table) -> pa.RecordBatch:
            comp, side, n, pos, across = columns(group)
            found = _cell(group.column("id").to_pylist(), comp, side, n, pos, group.column("s").combine_chunks().flatten().to_numpy(), across)
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.binary()) for c in (0, 1)], ["a", "b"])
        yield from _by_cell(batches, links)

    links = cut(map_arrow(dealt(open_.join(sets, "id"), "s"), compared, "a binary, b binary"), "near")
    discard(open_, sets)
    return links


def print_links(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts (id, fp) that connect the same groups as all pairs with fingerprints within 2 bits do: a text and the first one of
    its fingerprint, and the first texts of close fingerprints."""
    heads = cut(texts.groupBy("fp").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")), "heads")
    own = attach(texts, heads, ["fp"], "n", "inner").where(F.col("id") != F.col("head")).select(F.col("head").alias("a"), F.col("id").alias("b"))
    far = close_links(heads.select("fp")).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    return own.union(far.select(F.least("x", "y"), F.greatest("x", "y")))


def _known(links: DataFrame) -> DataFrame:
    """(id, root) of the texts that links connect, written to the shared folder."""
    return cut(components(links).select(F.col("node").alias("id"), "root"), "roots")


def _unconnected(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(token, id, n, pos, comp): the rows of `met` under tokens whose texts are not all connected yet, written to the shared folder."""
    known = met.join(roots, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
    mixed = known.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where(F.col("x") != F.col("y")).select("token")
    return cut(known.join(mixed, "token", "left_semi"), "open", "zstd")


def near_links(met: DataFrame, links: DataFrame, rows: DataFrame, texts: DataFrame, text: str = "text", few: int = FEW, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that with the verified `links` connect the same groups as all pairs of near copies do; every link is verified on all shingles.

    `met` (token, id, n, pos) has the prefix tokens that more than one text has, of sets of n shingles. Near copies share such a token. Each text is
    compared with the one that has the token earliest in its prefix (an original has no rare shingles of its own, its copies have). Tokens whose
    texts `links` and these connect need no further look. Of the others, all pairs of a token's texts that are still apart are
    compared, listed where they are few, by a grid of blocks where they are many.
    """
    lead = met.groupBy("token").agg(F.min(F.struct("pos", "id", "n")).alias("lead"))
    first = met.join(lead, "token").where((F.col("id") != F.col("lead.id")) & _fits(F.col("n"), F.col("lead.n"), F.col("pos"), F.col("lead.pos")))
    found = [links, _alike(first.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")), rows, texts, text)]
    roots = _known(found[0].union(found[1]))
    rest = _unconnected(met, roots)
    discard(roots)
    counts = rest.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    rest_ = cut(rest.join(counts, "token"), "counted", "zstd")
    discard(rest)
    small = rest_.where(F.col("c") <= few)
    left, right = (small.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("id", "n", "pos", "comp")]) for k in "12")
    pairs = (left.join(right, "token").where((F.col("id1") < F.col("id2")) & (F.col("comp1") != F.col("comp2")))
             .where(_fits(F.col("n1"), F.col("n2"), F.col("pos1"), F.col("pos2"))))
    found.append(_alike(pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b")), rows, texts, text))
    found.append(_grid(rest_.where(F.col("c") > few), rows, texts, text, block))
    discard(rest_)
    done = cut(found[0].union(found[1]).union(found[2]).union(found[3]), "links")
    discard(*found)
    return done


def _prefixes(rows: DataFrame, text: str) -> DataFrame:
    """(token, id, n, pos) of the prefix of every row's set."""
    sent = rows.sparkSession.sparkContext.broadcast(_common(rows, text))

    def run(batches):
        common, rank = sent.value
        for batch in batches:
            texts = texts_of(batch.column(0))
            sets = shingle_sets(texts)
            parts = [prefix(x, common, rank) for x in sets]
            sizes = [len(x) for x in parts]
            flat = np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64)
            ids = pa.array([digest_of(t) for t in texts], pa.binary()).take(pa.array(np.repeat(np.arange(len(texts)), sizes)))
            pos = np.concatenate([*[np.arange(n, dtype=np.int32) for n in sizes], np.empty(0, np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(flat), ids, pa.array(np.repeat([len(x) for x in sets], sizes).astype(np.int32)), pa.array(pos)],
                                             ["token", "id", "n", "pos"])

    return map_arrow(rows.select(F.col(text)), run, "token long, id binary, n int, pos int")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", few: int = FEW, block: int = BLOCK) -> DataFrame:
    """`docs` without near-duplicates, that is texts which share at least 4/5 of the 5-word shingles that either has: of each group that
    such pairs connect the row with the smallest key stays (of rows that repeat it, one; a null key comes last). Shingles are compared as
    64-bit hashes, none is left out. Texts with the same words, upper and lower case A-Z alike, are copies whatever their length; texts
    without words are copies of each other. All columns come back as they were.

    First come the pairs whose SimHash fingerprints over 5-word shingles differ in at most 2 of 64 bits, found by ball hashing as in `groups`, each decided
    on all shingles. Texts that share 4/5 of their shingles differ in some 10 bits, and balls of half that radius have 8 million points; so the pairs that
    fingerprints cannot reach are found by shared rare shingles: of each set the first fifth is taken, rare shingles first, and two near
    copies always have one of these in common (`near_links`).
    """
    marks = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in hashable(docs)])), 16, "0") for seed in (1, 2)]
    rows = docs.withColumn("_row", F.unhex(F.concat(*marks)))           # equal for rows that are alike in all columns
    source = rows.select("_row", F.col(key), F.col(text))

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(2))
            prints = []
            for i, j in groups_of([len(t) for t in texts], TOGETHER):
                words = Words([t.translate(LOWER) for t in texts[i:j]])
                for a, b in zip(words.first[:-1], words.first[1:]):
                    shingles = grams(words.hash[a:b], min(SHINGLE, b - a)) if b > a else words.hash[:0]
                    prints.append(majority((shingles[k:k + HASHES] for k in range(0, len(shingles), HASHES)), 1).view("<i8")[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([digest_of(t) for t in texts], pa.binary()), pa.array(np.array(prints, np.int64))],
                                             ["_row", "key", "id", "fp"])

    kind = source.schema[key].dataType.simpleString()
    prints = cut(map_arrow(source, run, f"_row binary, key {kind}, id binary, fp long"), "prints")
    place = F.struct(F.col("key").isNull().alias("none"), "key", "_row")
    texts = cut(prints.groupBy("id", "fp").agg(F.min(place).alias("first")), "texts")
    source = source.drop(key)
    links = _alike(print_links(texts.select("id", "fp")), source, texts, text)
    entries = _prefixes(source, text)
    own = F.xxhash64("id")
    shared = cut(entries.groupBy("token").agg(F.min(own).alias("x"), F.max(own).alias("y")).where(F.col("x") != F.col("y")).select("token"), "shared")
    met = cut(entries.join(shared, "token").groupBy("token", "id", "n", "pos").agg(F.lit(1).alias("one")).drop("one"), "met", "zstd")
    discard(shared)
    links = near_links(met, links, source, texts, text, few, block)
    discard(met)
    roots = _known(links)
    kept = texts.join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row"))
    kept = cut(kept.join(prints.groupBy("_row").agg(F.count(F.lit(1)).alias("_n")), "_row"), "kept")
    discard(links, roots, prints, texts)
    one = rows.join(kept.where(F.col("_n") == 1).select("_row"), "_row", "left_semi")
    same = rows.join(kept.where(F.col("_n") > 1).select("_row"), "_row", "left_semi").dropDuplicates(["_row"])
    return one.unionAll(same).drop("_row")
