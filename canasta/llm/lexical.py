"""Ranked lexical search with norm buckets in the manner of LEMP.

A document is a vector of whole-numbered impacts over the terms of the asked items, an item a vector of term weights times repeats; a score is
their inner product. Documents are ordered by length (Euclidean norm) and cut into buckets. For an item with a known k-th best score a
bucket is left out if the product of the two lengths (Cauchy-Schwarz) or the sum of the bucket's largest coordinates cannot reach it. Inside
a bucket the item's strongest coordinates are added up first, as far as a document without them could still qualify; each document seen gets
an upper bound from its sum and from the rest, by coordinates and by Cauchy-Schwarz on the rest of both vectors. Those
whose bound reaches the k-th best are scored exactly in 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canasta.llm.batches import map_arrow, texts_of
from canasta.llm.terms import Vocabulary, hashed, shards
from canasta.operators.skew import cut

# Fixed values of the score.
SCALE, TOP, TF, NORM = 1000, 1_000_000_000, 1000, 8
BASE, SLOPE = 25, 75

K = 10
BUCKET = 4096               # documents of a bucket
BLOCK = 500_000             # terms of items that are asked together, about
SAMPLE = 20_000             # documents whose scores give first bounds of the k-th best; the result does not depend on it
SLACK = 1 - 1e-9            # bounds are doubles, scores are not


@dataclass
class Items:
    """A block of items as vectors over their own terms 0, 1, ..."""
    vocabulary: Vocabulary
    names: pa.Array             # key of each item
    marks: np.ndarray           # tells texts of one key apart
    first: np.ndarray           # first entry of each item, and the number of entries
    term: np.ndarray
    times: np.ndarray           # repeats of the term in the item

    @classmethod
    def of(cls, rows: pa.Table) -> Items:
        flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy()
        hashes = flat("hashes").view(np.uint64)
        vocabulary = Vocabulary(hashes, max(rows.column("longest").to_pylist(), default=0))
        sizes = rows.column("n").to_numpy().astype(np.int64)
        return cls(vocabulary, rows.column("item").combine_chunks(), rows.column("mark").to_numpy(), np.concatenate([[0], np.cumsum(sizes)]),
                   vocabulary.numbers(hashes).astype(np.int64) - 1, flat("times"))


def _item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, mark, n, longest, hashes, times): the distinct terms of each distinct (key, text)."""
    source = items.select(F.col(item), F.col(text)).distinct().select(F.col(item), F.xxhash64(F.col(text)), F.col(text))
    kind = source.schema[item].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t in texts_of(batch.column(2)):
                _, size, hash_ = hashed(t + b"\n")
                terms, times = np.unique(hash_, return_counts=True)
                for column, x in zip(out, (len(terms), int(size.max()) if len(size) else 0, terms.view(np.int64), times.astype(np.int64))):
                    column.append(x)
            numbers, lists = pa.int32(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], numbers), pa.array(out[1], numbers), pa.array(out[2], lists),
                                              pa.array(out[3], lists)], ["item", "mark", "n", "longest", "hashes", "times"])

    return map_arrow(source, run, f"item {kind}, mark long, n int, longest int, hashes array<long>, times array<long>")


def _lists(values: np.ndarray, sizes: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values, kind))


def counted(texts: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms with repeats, distinct vocabulary terms) per text, and of the latter (term, repeats) one text after another."""
    total, keys, counts = np.zeros(len(texts), np.int64), [], []
    size = len(vocabulary) + 1
    for shard in shards(texts, vocabulary.longest):
        text, number = vocabulary.read(shard)
        total += np.bincount(text, minlength=len(texts))
        key, n = np.unique(text[number > 0] * size + number[number > 0], return_counts=True)
        keys.append(key)
        counts.append(n)
    key, back = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_inverse=True)
    n = np.bincount(back, np.concatenate([*counts, np.zeros(0, np.int64)]), len(key)).astype(np.int64)
    return total, np.bincount(key // size, minlength=len(texts)), key % size - 1, n


def _vectors(docs: DataFrame, key: str, text: str, sent) -> DataFrame:
    """(id, n, terms, times) of every document that has a term, written to the shared folder."""
    def run(batches):
        for batch in batches:
            total, distinct, term, times = counted(texts_of(batch.column(1)), sent.value.vocabulary)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), _lists(term, distinct, pa.int32()), _lists(times, distinct, pa.int64())],
                                             ["id", "n", "terms", "times"])
            yield out.filter(pa.array(total > 0))

    return cut(map_arrow(docs.select(F.col(key).cast("long"), F.col(text)), run, "id long, n long, terms array<int>, times array<long>"), "vectors", "zstd")


@dataclass
class Scoring:
    """Statistics of all documents: their number, their terms, and the weight of each term."""
    documents: int
    terms: int
    weight: np.ndarray

    @classmethod
    def of(cls, vectors: DataFrame, size: int) -> Scoring:
        n, total = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = np.zeros(size, np.int64)
        # as many rows as the block of items has terms
        for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toArrow().to_batches():
            df[row.column(0).to_numpy()] = row.column(1).to_numpy()
        return cls(n, total or 0, np.array([math.floor(SCALE * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64))

    def impacts(self, n: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Impact of each term of documents with n terms."""
        m = BASE + (SLOPE * n * self.documents) // max(self.terms, 1)
        return TOP * times // (TF * times + NORM * m)


class Bucket:
    """Documents as impacts, held by document and by term."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int) -> None:
        self.ids, self.term, self.impact = ids, term, impact
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        document = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(term, kind="stable")
        self.document, self.posted = document[order], impact[order].astype(np.float64)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=terms))])
        self.largest = np.zeros(terms)
        held = np.flatnonzero(np.diff(self.begin))
        if len(held):
            self.largest[held] = np.maximum.reduceat(self.posted, self.begin[held])
        self.square = np.bincount(document, impact.astype(np.float64) ** 2, len(ids))
        self.norm = math.sqrt(self.square.max(initial=0))

    def candidates(self, term: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
        """Documents whose score with an item may be `least` or more, and is above 0."""
        least *= SLACK
        if math.sqrt(float(weight @ weight)) * self.norm < least:
            return np.zeros(0, np.int64)
        reach = weight * self.largest[term]
        order = np.argsort(-reach, kind="stable")
        term, weight, reach = term[order], weight[order], reach[order]
        rest = np.append(np.cumsum(reach[::-1])[::-1], 0.0)            # what coordinates i, i + 1, ... can add
        focus = int(np.searchsorted(-rest, -max(least, 1e-9), "right"))
        if not focus:
            return np.zeros(0, np.int64)
        part, seen = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        for t, w in zip(term[:focus].tolist(), weight[:focus].tolist()):
            own, x = self.document[self.begin[t]:self.begin[t + 1]], self.posted[self.begin[t]:self.begin[t + 1]]
            part[own] += w * x
            seen[own] += x * x
        far = weight[focus:]
        other = np.minimum(rest[focus], math.sqrt(float(far @ far)) * np.sqrt(np.maximum(self.square - seen, 0)) * (1 + 1e-9))
        return np.flatnonzero((part > 0) & (part + other >= least))

    def scores(self, documents: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores; `weights` has a place for every term."""
        begin, n = self.first[documents], self.first[documents + 1] - self.first[documents]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.add.reduceat(weights[self.term[at]] * self.impact[at], np.cumsum(n) - n)


class Best:
    """The k best documents of each item so far, and the least score that may still enter."""

    def __init__(self, items: Items, scoring: Scoring, least: np.ndarray, k: int) -> None:
        self.items, self.k, self.least = items, k, least.astype(np.int64)
        self.weight = items.times * scoring.weight[items.term]
        self.dense = np.zeros(len(items.vocabulary), np.int64)
        self.score = [np.zeros(0, np.int64) for _ in least]
        self.id = [np.zeros(0, np.int64) for _ in least]
        self.missing = [np.zeros(0, bool) for _ in least]
        self.scored = 0                                     # for tests

    def see(self, bucket: Bucket, missing: np.ndarray) -> None:
        for q in range(len(self.least)):
            mine = slice(self.items.first[q], self.items.first[q + 1])
            term, weight = self.items.term[mine], self.weight[mine]
            found = bucket.candidates(term, weight.astype(np.float64), float(self.least[q]))
            if not len(found):
                continue
            self.dense[term] = weight
            score = bucket.scores(found, self.dense)
            self.dense[term] = 0
            self.scored += len(found)
            good = score >= max(self.least[q], 1)
            score, id_ = np.append(self.score[q], score[good]), np.append(self.id[q], bucket.ids[found[good]])
            none = np.append(self.missing[q], missing[found[good]])
            first = np.lexsort((id_, none, -score))[:self.k]
            self.score[q], self.id[q], self.missing[q] = score[first], id_[first], none[first]
            if len(first) == self.k:
                self.least[q] = max(self.least[q], score[first[-1]])

    def rows(self) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(self.least)), [len(x) for x in self.score])
        join = lambda parts, kind: np.concatenate([*parts, np.zeros(0, kind)])
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(join(self.id, np.int64), pa.int64(), mask=join(self.missing, bool)), pa.array(join(self.score, np.int64))],
                                          ["q", "id", "score"])


def _searched(vectors: DataFrame, sent, scoring, least, k: int, bucket: int) -> DataFrame:
    """(q, id, score): the k best of each task's documents for each item, as far as they reach `least`. Documents come longest first."""
    def run(batches):
        items, stats, bound = sent.value, scoring.value, least.value
        best = Best(items, stats, bound, k)
        for batch in _gathered(batches, bucket):
            column = lambda c: batch.column(c).combine_chunks()
            term, sizes = column("terms").flatten().to_numpy(), np.diff(column("terms").offsets.to_numpy()).astype(np.int64)
            impact = stats.impacts(np.repeat(column("n").to_numpy(), sizes), column("times").flatten().to_numpy())
            id_ = column("id")
            best.see(Bucket(id_.fill_null(0).to_numpy(), sizes, term, impact, len(items.vocabulary)), id_.is_null().to_numpy(zero_copy_only=False))
        yield best.rows()

    return map_arrow(vectors.select("id", "n", "terms", "times"), run, "q long, id long, score long")


def _gathered(batches, rows: int) -> Iterator[pa.Table]:
    """Tables of `rows` rows, the last one of fewer."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(rows - n, batch.num_rows - at)
            held.append(batch.slice(at, take))
            at, n = at + take, n + take
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _lengths(vectors: DataFrame, scoring) -> DataFrame:
    """`vectors` of documents with a term of the items, and their length."""
    def run(batches):
        for batch in batches:
            n, lists, times = batch.column(1), batch.column(2), batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            impact = scoring.value.impacts(np.repeat(n.to_numpy(), sizes), times.flatten().to_numpy()).astype(np.float64)
            norm = np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), impact ** 2, len(sizes)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm)], ["id", "n", "terms", "times", "norm"])

    return map_arrow(vectors.where(F.size("terms") > 0), run, "id long, n long, terms array<int>, times array<long>, norm double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def _search(spark: SparkSession, docs: DataFrame, key: str, text: str, items: Items, item_type: str, k: int, bucket: int, sample: int) -> DataFrame:
    send = spark.sparkContext.broadcast
    sent = send(items)
    vectors = _vectors(docs, key, text, sent)
    stats = Scoring.of(vectors, len(items.vocabulary))
    scoring = send(stats)
    step = max(1, stats.documents // sample)
    some = vectors.where(F.pmod(F.xxhash64("id", "terms", "n"), F.lit(step)) == 0)
    least = np.zeros(len(items.names), np.int64)
    # at most k rows for each item of the block
    for row in _ranked(_searched(some, sent, scoring, send(least), k, bucket), k).where(F.col("rank") == k).select("q", "score").toArrow().to_batches():
        least[row.column(0).to_numpy()] = row.column(1).to_numpy()
    ordered = _lengths(vectors, scoring)
    ordered = ordered.repartitionByRange(F.desc("norm"), F.xxhash64("id", "terms")).sortWithinPartitions(F.desc("norm"))
    best = _ranked(_searched(ordered, sent, scoring, send(least), k, bucket), k)
    names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(items.names))), "_item": items.names})).select("q", F.col("_item").cast(item_type))
    return best.join(F.broadcast(names), "q").select("_item", "rank", "id", "score")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = K,
           bucket: int = BUCKET, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(item, rank, key, score): the `k` documents with the highest scores above 0 for each item, equal scores by key (a null key last).

    Every row of `docs` is a document of its own; those without a term are not counted. Null and empty texts have no terms. Rows of `items` that
    repeat key and text are one item; other texts under one key rank on their own. Items without a term that a document has give no row. Keys are
    whole numbers. Items are asked in blocks of about `block` distinct terms, each in a pass over all documents; what is sent
    to the tasks is bounded by the block.
    """
    spark = docs.sparkSession
    terms = cut(_item_terms(items, item, item_text), "item_terms")
    blocks = max(1, -(-(terms.agg(F.sum("n")).first()[0] or 0) // block))
    item_type = terms.schema["item"].dataType.simpleString()
    done = None
    for i in range(blocks):
        asked = Items.of(terms.where(F.pmod(F.xxhash64("item", "mark"), F.lit(blocks)) == i).toArrow())
        found = _search(spark, docs, key, text, asked, item_type, k, bucket, sample)
        done = found if done is None else done.unionAll(found)
    return done.toDF(item, "rank", key, "score")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search(docs, items)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
stats AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, floor({SCALE} * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, stats GROUP BY t, n),
m AS (SELECT r, doc_id, {BASE} + ({SLOPE} * len(ts) * n) // l AS m FROM d, stats WHERE len(ts) > 0),
q AS (SELECT i, item_id, t, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY i, item_id, t),
scored AS (SELECT i, item_id, r, doc_id, sum(times * w * (({TOP} * tf) // ({TF} * tf + {NORM} * m)))::BIGINT AS score
           FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {K}"""
