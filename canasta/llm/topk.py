"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

Candidates are dealt into blocks and queries too; each pair of blocks is one small task. A candidate block keeps, for every component, its
candidates sorted by that component. For a query every list is read in the order that its component's sign makes best first, ever
deeper; what has been read gives each candidate a lower bound (unread parts at the list's worst value) and an upper bound (unread parts
at the value where the list has been read to). Reading stops when all candidates but a few have upper bounds below the k-th best lower
bound; the few get their final scores. The blocks' results meet in a top-k per query, which Spark limits before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canasta.llm.batches import deliver
from canasta.operators.skew import cut

SCALE = 1024
K = 10
BLOCK = 4096            # candidates of a block
QUERIES = 256           # queries of a block
DEPTHS = (1, 2, 4, 6, 7, 8)   # depths at which bounds are looked at, in eighths of the lists
FEW = 4                 # one in so many candidates may be left for final scores when reading stops


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as double; null for a null vector or one with null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Lists:
    """A block of candidates as one list per component, sorted from the largest value down.

    What has been read of the lists to a depth is the same for all queries that read them from the same end, so a block of queries
    reads together: bounds are two matrix products per depth. Whole numbers below 2^53 are exact in them.
    """

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        order = np.argsort(-values, axis=0, kind="stable")
        self.values = values.astype(np.float64)                     # candidate x component
        self.sorted = np.take_along_axis(self.values, order, 0)     # rank x component
        self.rank = np.empty((n, values.shape[1]), np.int32)
        np.put_along_axis(self.rank, order, np.arange(n, dtype=np.int32)[:, None], 0)
        self.read = 0                                               # list entries read, for tests

    def best(self, queries: np.ndarray, k: int, shut: np.ndarray) -> list[np.ndarray]:
        """For each query the candidates whose score may be among the k best, ties included. `shut` (candidate x query) are left out."""
        n, d = self.values.shape
        out: list = [None] * len(queries)
        active = np.arange(len(queries))
        before = 0
        for share in DEPTHS:
            depth = -(-n * share // DEPTHS[-1])
            ask = queries[active].astype(np.float64).T
            above, below = np.maximum(ask, 0), np.minimum(ask, 0)   # lists read from the top and from the bottom
            top, bottom = self.rank < depth, self.rank >= n - depth
            bounds = [np.where(top, self.values, self.sorted[x]) @ above + np.where(bottom, self.values, self.sorted[y]) @ below
                      for x, y in ((n - 1, 0), (depth - 1, n - depth))]
            low, high = bounds
            low[shut[:, active]] = -np.inf
            reach = np.partition(low, max(n - k, 0), axis=0)[max(n - k, 0)]
            may = (high >= reach) & ~shut[:, active]
            self.read += (depth - before) * d * len(active)
            before = depth
            done = (may.sum(0) <= max(4 * k, n // FEW)) | (depth == n)
            for q in np.flatnonzero(done):
                out[active[q]] = np.flatnonzero(may[:, q])
            active = active[~done]
            if not len(active):
                break
        return out


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE,
          block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, key, score): the `k` candidates with the largest integer inner products for each row where `is_query`.

    Candidates are all rows but those with the query's own key; ties go to the smaller key, a null key last. Vectors that are null or hold null
    or non-finite components take no part; neither do empty ones. Vectors are compared with those of their own length. Repeated queries
    (same key and vector) count once, repeated candidates each by itself. `is_query` is false where null. Scores must
    stay below 2^53. Every query meets every candidate, in blocks: the work is the product of their numbers, each task's
    share is block x query_block.
    """
    deliver(vectors.sparkSession)
    all_ = vectors.select(F.col(key).alias("id"), quantised(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.size("v") > 0)
    all_ = cut(all_.withColumn("dim", F.size("v")), "quantised")
    asked = all_.where("q").select("id", "v", "dim").distinct()
    blocks = max(1, -(-all_.count() // block))
    query_blocks = max(1, -(-asked.count() // query_block))
    here = F.pmod(F.xxhash64("v", "id"), F.lit(blocks))
    there = F.pmod(F.xxhash64("v", "id", F.lit(1)), F.lit(query_blocks))
    copied = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    spread = lambda df, b, q: df.select(b.alias("b"), "*").select(q.alias("qb"), "*")
    candidates = spread(all_.select("id", "v", "dim"), here, copied(query_blocks))
    asked = spread(asked, copied(blocks), there)

    def matrix(table: pa.Table) -> np.ndarray:
        column = table.column("v").combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if asked.num_rows and held.num_rows:
            order = held.column("id").combine_chunks()
            ids, missing = order.fill_null(0).to_numpy(zero_copy_only=False), order.is_null().to_numpy(zero_copy_only=False)
            values, queries = matrix(held), matrix(asked)
            own = ~missing[:, None] & (ids[:, None] == asked.column("id").to_numpy()[None])
            for mark, (q, query, left) in enumerate(zip(asked.column("id").to_pylist(), queries, Lists(values).best(queries, k, own))):
                score = values[left] @ query
                first = left[np.lexsort((ids[left], missing[left], -score))][:k]
                for i in first:
                    out[0].append(q)
                    out[1].append(mark)
                    out[2].append(None if missing[i] else int(ids[i]))
                    out[3].append(int(values[i] @ query))
        hashes = asked.column("h").to_pylist() if asked.num_rows else []
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "h": pa.array([hashes[m] for m in out[1]], pa.int64()), "id": pa.array(out[2], pa.int64()),
                         "score": pa.array(out[3], pa.int64())})

    asked = asked.withColumn("h", F.xxhash64("v"))
    found = asked.groupBy("b", "qb", "dim").cogroup(candidates.groupBy("b", "qb", "dim")).applyInArrow(run, "query_id long, h long, id long, score long")
    place = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return (found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score"))


def digest(vectors: DataFrame) -> DataFrame:
    """The ten best for every hundredth vector."""
    return top_k(vectors, F.col("vec_id") % 100 == 0)


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT DISTINCT vec_id AS query_id, v AS q FROM v WHERE vec_id % 100 = 0),
scored AS (SELECT query_id, vec_id, CAST(list_inner_product(q, v) AS BIGINT) AS score FROM q JOIN v ON len(q) = len(v) AND query_id IS DISTINCT FROM vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}"""
