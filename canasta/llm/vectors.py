"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A rotation flips signs at random and applies the Hadamard transform, three times. A vector's hash is the signed axis that it then lies
nearest to; a table joins several such hashes into a bucket. A vector is stored in its own bucket of every table and also visits the
buckets that it misses by least (multiprobe). Vectors that meet in a bucket, one of them at home there, are compared exactly. The
number of hashes per table follows from the number of vectors, the number of tables from the wanted recall at the threshold.

Equal vectors are folded first. Large buckets are cut into blocks and become a grid of block pairs. A pair counts in the first of
the buckets in which its two vectors meet, so counts add up without listing pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canasta.llm.batches import map_arrow
from canasta.llm.graph import components
from canasta.operators.skew import cut

COSINE = 0.93
PROBES = 8
ALTERNATIVES = 3         # nearest axes per hash from which probes are combined
RECALL = 0.995           # of pairs exactly at the threshold
BLOCK = 1024             # vectors of a block of a bucket
SEED = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis (a power of two), scaled to keep lengths."""
    n, shape = x.shape[-1], x.shape
    x = x.reshape(-1, n)
    step = 1
    while step < n:
        x = x.reshape(-1, n // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        step *= 2
    return x.reshape(shape) / np.sqrt(n)


@dataclass(frozen=True)
class Hashing:
    """Tables of `hashes` cross-polytope hashes each over vectors with `dim` components."""
    dim: int
    hashes: int
    tables: int
    probes: int = PROBES

    def signs(self) -> np.ndarray:
        width = 1 << max(1, (self.dim - 1).bit_length())
        return np.random.default_rng(SEED).choice([-1.0, 1.0], (self.tables, self.hashes, 3, width))

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """vector x table x probe: bucket numbers, the vector's own first."""
        signs = self.signs()
        width = signs.shape[-1]
        x = np.pad(np.asarray(x, np.float64), ((0, 0), (0, width - x.shape[1])))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        few = min(ALTERNATIVES, width)
        combos = np.array(list(product(range(few), repeat=self.hashes)))
        probes = min(self.probes, len(combos))
        out = np.empty((len(x), self.tables, probes), np.int64)
        for t in range(self.tables):
            axes, misses = [], []
            for h in range(self.hashes):
                y = x
                for r in range(3):
                    y = hadamard(y * signs[t, h, r])
                size = np.abs(y)
                near = np.argpartition(-size, few - 1, axis=1)[:, :few] if few < width else np.tile(np.arange(width), (len(x), 1))
                order = np.argsort(-np.take_along_axis(size, near, 1), axis=1, kind="stable")
                near = np.take_along_axis(near, order, 1)
                value = np.take_along_axis(y, near, 1)
                axes.append(near * 2 + (value < 0))
                misses.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
            total = sum(m[:, combos[:, h]] for h, m in enumerate(misses))
            best = np.argsort(total, axis=1, kind="stable")[:, :probes]
            number = np.zeros((len(x), probes), np.int64)
            for h in range(self.hashes):
                number = number * (2 * width) + np.take_along_axis(axes[h], combos[best, h], 1)
            out[:, t] = number
        return out


def choose(dim: int, count: int, cosine: float = COSINE, recall: float = RECALL, probes: int = PROBES, sample: int = 2000) -> Hashing:
    """Enough hashes per table for one vector per bucket; enough tables that random pairs at the threshold meet with the wanted probability."""
    width = 1 << max(1, (dim - 1).bit_length())
    hashes = max(1, int(np.ceil(np.log(max(count, 2)) / np.log(2 * width))))
    rng = np.random.default_rng(SEED)
    a = rng.standard_normal((sample, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((sample, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b = cosine * a + np.sqrt(1 - cosine ** 2) * b
    one = Hashing(dim, hashes, 4, probes)
    x, y = one.buckets(a), one.buckets(b)
    meet = (x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)
    p = min(max(float(meet.mean()), 1e-3), 1 - 1e-9)
    return Hashing(dim, hashes, max(2, int(np.ceil(np.log(1 - recall) / np.log(1 - p)))), probes)


def _linked(home: np.ndarray, side: np.ndarray, vectors: np.ndarray, buckets: np.ndarray, table: int, bucket: int, across: bool, cosine: float):
    """Index pairs of a group that are linked and meet here first; across: only pairs from different blocks."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
    keep = home[i] | home[j]
    if across:
        keep &= side[i] != side[j]
    i, j = i[keep], j[keep]
    for t in range(table):                         # those that met in an earlier table count there
        if not len(i):
            return i, j
        x, y = buckets[i, t], buckets[j, t]
        new = ~((x[:, :1] == y).any(1) | (y[:, :1] == x).any(1))
        i, j = i[new], j[new]
    x, y = buckets[i, table], buckets[j, table]
    # in this table the two may meet at either's home; the first row's home comes first
    first = np.where((x[:, :1] == y).any(1), x[:, 0], y[:, 0])
    return i[first == bucket], j[first == bucket]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if (root == before).all():
            return root


GROUP = ["label", "t", "bucket", "i", "j"]


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE,
                    recall: float = RECALL, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) per row: rows are linked if their labels are equal and their cosine is at least `cosine`.

    Every reported link is checked in double precision; `recall` is the chance that a pair at the threshold is found (closer pairs are
    found more often). n_links counts linked rows, repeated ones and copies too. component_id is the smallest key that links reach, null if none
    has one. A vector that is null, empty, zero or holds null or non-finite components, or whose label is null, has no link
    and is its own component. Vectors of different lengths are not compared. An empty table gives an empty result.
    """
    x = F.col("v")
    usable = (F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0)
              & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0))
    rows = table.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = cut(rows.select("key", F.when(usable, F.col("label")).alias("label"), F.when(usable, x).alias("v"),
                           F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")), "vectors")
    copies = ["label", "h1", "h2"]
    folded = (rows.where(F.col("v").isNotNull()).groupBy(*copies).agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("least"), F.first("v").alias("v"))
              .withColumn("rep", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    folded = cut(folded, "folded")
    links, edges = None, None
    for dim, count in sorted((r["dim"], r["n"]) for r in folded.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()):
        found = cut(_links_of(folded.where(F.col("dim") == dim), choose(dim, count, cosine, recall, probes), cosine, block), "found")
        links = found if links is None else links.union(found)
    if links is None:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), "root")
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    facts = (folded.select(*copies, "rep", "copies", "least").join(roots, "rep", "left").join(counts, "rep", "left")
             .withColumn("root", F.coalesce("root", "rep")))
    least = facts.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = facts.join(least, "root").select(*copies, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("_in"))
    done = rows.select("key", *copies).join(cut(facts, "facts"), copies, "left")
    component = F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("key"))
    return done.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                       (F.coalesce(F.col("key") == component, F.lit(True))).alias("kept"))


def _links_of(reps: DataFrame, hashing: Hashing, cosine: float, block: int) -> DataFrame:
    """(rep, n, root): per group of compared vectors, the linked copies of each and the smallest one of its component there."""
    def hashed(batches):
        for batch in batches:
            column = batch.column(3)
            v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), hashing.dim)
            flat = hashing.buckets(v).reshape(len(v), -1)
            lists = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["rep", "label", "copies", "v", "buckets"])

    label = reps.schema["label"].dataType.simpleString()
    index = cut(map_arrow(reps.select("rep", "label", "copies", "v"), hashed, f"rep long, label {label}, copies long, v array<double>, buckets array<long>"), "index")
    probes = hashing.buckets(np.ones((1, hashing.dim))).shape[2]
    spots = index.select("rep", "label", F.posexplode("buckets").alias("p", "bucket"))
    spots = spots.select("rep", "label", F.expr(f"p div {probes}").cast("int").alias("t"), (F.col("p") % probes == 0).alias("home"), "bucket")
    place = ["label", "t", "bucket"]
    sizes = spots.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any")).where((F.col("n") > 1) & F.col("any")).drop("any")
    met = spots.join(sizes, place)
    parts = F.ceil(F.col("n") / block).cast("int")
    met = met.withColumn("parts", parts).withColumn("side", F.pmod(F.xxhash64("rep", "t"), F.col("parts").cast("long")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("rep", *place, "home", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    full = met.join(index.select("rep", "copies", "v", "buckets"), "rep")
    names = [*GROUP, "rep", "home", "side", "copies", "v", "buckets"]
    full = full.select(names).repartition(*GROUP).sortWithinPartitions(*GROUP, "rep")

    def compared(batches):
        rest: pa.Table | None = None

        def links(group: pa.Table):
            rep = group.column("rep").to_numpy()
            v = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1)
            spots = group.column("buckets").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rep), hashing.tables, -1)
            one = lambda c: group.column(c)[0].as_py()
            i, j = _linked(group.column("home").to_numpy(zero_copy_only=False).astype(bool), group.column("side").to_numpy(), v, spots, one("t"), one("bucket"),
                           one("i") != one("j"), cosine)
            if not len(i):
                return None
            copies = group.column("copies").to_numpy()
            n = np.bincount(i, copies[j], len(rep)).astype(np.int64) + np.bincount(j, copies[i], len(rep)).astype(np.int64)
            some = np.flatnonzero(n)
            return rep[some], n[some], rep[_roots(len(rep), i, j)][some]

        def split(data: pa.Table, last: bool):
            keys = [data.column(c).to_numpy(zero_copy_only=False) for c in GROUP]
            new = np.zeros(data.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            begins = np.concatenate([[0], np.flatnonzero(new), [data.num_rows]])
            out = [links(data.slice(a, b - a)) for a, b in zip(begins[:-1 if last else -2], begins[1:]) if b - a > 1]
            out = [x for x in out if x is not None]
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in out] or [np.empty(0, np.int64)])) for c in range(3)], ["rep", "n", "root"])
            return batch, None if last else data.slice(begins[-2])

        for batch in batches:
            data = pa.Table.from_batches([batch])
            data = data if rest is None else pa.concat_tables([rest, data]).combine_chunks()
            if data.num_rows:
                out, rest = split(data, False)
                yield out
        if rest is not None and rest.num_rows:
            yield split(rest, True)[0]

    return map_arrow(full, compared, "rep long, n long, root long")


def digest(table: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    return near_duplicates(table)


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id"""
