"""Mixing overlapping sources to target weights with a minimum-cost flow.

Documents are added up by membership pattern (the set of sources they belong to). Words flow from patterns to the quotas of their sources;
the k-th use of a pattern's words costs k - 1 per word, so repetition costs are convex and no word is repeated while another can
serve. The flow runs over patterns and sources alone. Each pattern then takes whole passes over its documents and, for what is left, documents
in seeded order.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canasta.operators.skew import cut, hashable

# Fixed values of the mix.
WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)      # words of the mix for each word of the corpus
USES = 2                    # most uses of a document

SEED = 11
SLICES = 4096               # slices of a pattern's seeded order; only the slice at the border is sorted by row
AHEAD = 64                  # documents after the border that may fill what is left
PATTERNS = 100_000          # bound of what the driver and the broadcast hold


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, budget: Fraction, weights: Sequence[int] = WEIGHTS, most: int = USES) -> dict:
    """Share of the budget per source: by weights that repeat in code-point order (null last), at most `most` times the source's
    size; what is above goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, Fraction(budget), list(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def route(patterns: dict[tuple, int], quotas: dict, uses: int = USES) -> dict[tuple, int]:
    """Words taken per pattern by a minimum-cost flow: pattern p has its size at cost 0, again at cost 1, and so on; p reaches its
    sources; a source accepts its quota. Connected parts of the graph are solved apart, by shortest augmenting paths."""
    near = defaultdict(list)
    for p in patterns:
        for s in set(p):
            near[s].append(p)
    taken, seen = {}, set()
    for start in patterns:
        if start in seen:
            continue
        seen.add(start)
        part, todo = [], [start]
        while todo:
            p = todo.pop()
            part.append(p)
            for s in p:
                for q in near.pop(s, []):
                    if q not in seen:
                        seen.add(q)
                        todo.append(q)
        taken |= _flow({p: patterns[p] for p in part}, quotas, uses)
    return taken


def _flow(patterns: dict[tuple, int], quotas: dict, uses: int) -> dict[tuple, int]:
    heads, room, cost, edges = [], [], [], defaultdict(list)

    def edge(a, b, capacity: int, price: int) -> None:
        for x, y, c, w in ((a, b, capacity, price), (b, a, 0, -price)):
            edges[x].append(len(heads))
            heads.append(y)
            room.append(c)
            cost.append(w)

    total = sum(patterns.values()) * uses
    for p, n in patterns.items():
        for k in range(uses):
            edge("from", ("p", p), n, k)
        for s in set(p):
            edge(("p", p), ("s", s), total, 0)
    for s in {s for p in patterns for s in p}:
        edge(("s", s), "to", quotas[s], 0)
    while True:
        far, via, todo, waiting = {"from": 0}, {}, deque(["from"]), {"from"}
        while todo:
            x = todo.popleft()
            waiting.discard(x)
            for e in edges[x]:
                y = heads[e]
                if room[e] and far[x] + cost[e] < far.get(y, 1 << 60):
                    far[y], via[y] = far[x] + cost[e], e
                    if y not in waiting:
                        waiting.add(y)
                        todo.append(y)
        if "to" not in via:
            break
        path, y = [], "to"
        while y != "from":
            path.append(via[y])
            y = heads[via[y] ^ 1]
        step = min(room[e] for e in path)
        for e in path:
            room[e] -= step
            room[e ^ 1] += step
    return {p: sum(room[e ^ 1] for e in edges["from"] if heads[e] == ("p", p)) for p in patterns}


def mix(docs: DataFrame, key: str, text: str, sources: Column, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, uses: int = USES,
        seed: int = SEED, max_patterns: int = PATTERNS, row: str | None = None) -> tuple[DataFrame, dict, dict]:
    """(rows, sizes, targets). `rows` has _row (a number of its own for each row of `docs`, in no order), key, sources, size and copies.

    `sources` is an array of strings per document; a null is a source of its own, an empty array belongs nowhere and is not taken. Every
    row counts, repeated ones too. Documents are ordered by a seeded hash of key and text, ties by key, text and then `row`, a column that is carried along (only rows
    alike in all of these are chosen among by their place in the input); `copies` is the number of times a document is taken whole, 0 to `uses`. A pattern's rest is filled by documents in that order up to the first that does not fit, by those
    of the next `AHEAD` that fit, and then by the one document that comes nearest to what still lacks, if that brings the sum nearer. Without words all targets are 0; a document without words is not taken.
    """
    carried = [F.col(row).alias("_mark")] if row else [F.lit(0).alias("_mark")]
    rows = cut(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key), F.array_sort(F.array_distinct(sources)).alias("sources"),
                           words(F.col(text)).alias("size"), F.xxhash64(F.col(key), F.col(text), F.lit(seed)).alias("_u"), F.xxhash64(F.lit(seed), F.col(text)).alias("_v"), *carried), "mix")
    order = ["_u", key, "_v", "_mark", "_row"]
    slice_ = F.shiftright(F.col("_u"), 52) + 2048
    rows = rows.withColumn("_slice", F.lit(0) + slice_)
    summed = rows.groupBy("sources").agg(F.sum("size").alias("n")).limit(max_patterns + 1).collect()
    if len(summed) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = {tuple(r["sources"]): int(r["n"]) for r in summed if r["sources"]}
    sizes: dict = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    wanted = targets(dict(sizes), share * sum(patterns.values()), weights, uses)
    taken = route(patterns, {s: round(t) for s, t in wanted.items()}, uses)
    plan = [(list(p), taken[p] // n if n else 0, taken[p] % n if n else 0) for p, n in patterns.items()]
    kind = T.StructType([T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("_passes", T.LongType()), T.StructField("_rest", T.LongType())])
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(plan, kind)), "sources", "left")

    slices = rows.where(F.col("_rest") > 0).groupBy("sources", "_slice", "_rest").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("sources").orderBy("_slice"))
    border = (slices.withColumn("upto", upto).where((F.col("upto") - F.col("n") <= F.col("_rest")) & (F.col("upto") > F.col("_rest")))
              .groupBy("sources").agg(F.min("_slice").alias("_border"), (F.min(F.col("upto") - F.col("n"))).alias("_before")))
    placed = rows.join(F.broadcast(cut(border, "borders")), "sources", "left")
    inside = placed.where(F.col("_slice") == F.col("_border"))
    running = F.sum("size").over(Window.partitionBy("sources").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    fitting = cut(inside.withColumn("_upto", F.col("_before") + running).where(F.col("_upto") <= F.col("_rest")).select("_row", "sources", "_upto"), "border_rows")
    reached = fitting.groupBy("sources").agg(F.max("_upto").alias("_reached"))
    chosen = placed.join(F.broadcast(cut(reached, "reached")), "sources", "left").join(fitting.select("_row", F.lit(1).alias("_fits")), "_row", "left")
    extra = F.when(F.col("_slice") < F.col("_border"), 1).otherwise(F.coalesce("_fits", F.lit(0)))
    chosen = (chosen.withColumn("_extra", F.coalesce(extra, F.lit(0))).withColumn("_lack", F.col("_rest") - F.coalesce("_reached", "_before")).drop("_fits", "_reached"))
    # the next documents in the order, as far as they fit
    following = F.row_number().over(Window.partitionBy("sources").orderBy(*order))
    ahead = (chosen.where((F.col("_extra") == 0) & (F.col("_slice") >= F.col("_border"))).withColumn("_n", following).where(F.col("_n") <= AHEAD)
             .groupBy("sources", "_lack").agg(F.array_sort(F.collect_list(F.struct("_n", "_row", "size"))).alias("next")))
    empty = F.struct(F.col("_lack").alias("lack"), F.array().cast("array<bigint>").alias("rows"))
    fill = F.aggregate("next", empty, lambda acc, d: F.when(d["size"] <= acc["lack"], F.struct(
        (acc["lack"] - d["size"]).alias("lack"), F.array_append(acc["rows"], d["_row"]).alias("rows"))).otherwise(acc))
    filled = cut(ahead.select("sources", fill.alias("f")).select("sources", F.col("f.lack").alias("_left"), F.col("f.rows").alias("_rows")), "filled")
    chosen = (chosen.join(F.broadcast(filled), "sources", "left")
              .withColumn("_extra", F.greatest("_extra", F.coalesce(F.array_contains("_rows", F.col("_row")), F.lit(False)).cast("int")))
              .withColumn("_left", F.coalesce("_left", "_lack")).withColumn("_miss", F.abs(F.col("size") - F.col("_left"))))
    nearest = (chosen.where((F.col("_extra") == 0) & (F.col("_miss") < F.col("_left"))).groupBy("sources")
               .agg(F.min_by("_row", F.struct("_miss", *order)).alias("_nearest")))
    copies = F.coalesce("_passes", F.lit(0)) + F.col("_extra") + F.coalesce((F.col("_row") == F.col("_nearest")).cast("int"), F.lit(0))
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0))
    done = chosen.join(F.broadcast(cut(nearest, "nearest")), "sources", "left").select("_row", key, "sources", "size", copies.alias("copies"), "_mark")
    return done, dict(sizes), wanted


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: rows of `docs` that are not taken are gone, rows taken twice occur twice; columns as they were."""
    marks = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in hashable(docs)])), 16, "0") for seed in (1, 2)]
    marked = docs.withColumn("_docs_row", F.concat(*marks))             # equal for rows that are alike in all columns
    done, _, _ = mix(marked.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(source).alias("_source"), "_docs_row"), "_key", "_text", F.array("_source"), row="_docs_row")
    taken = cut(done.groupBy(F.col("_mark").alias("_docs_row")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_n")).where(F.col("_copies") > 0), "taken")
    one = marked.join(taken.where(F.col("_n") == 1), "_docs_row")
    # of rows alike in all columns one stands for all, with their copies
    same = marked.join(taken.where(F.col("_n") > 1), "_docs_row").dropDuplicates(["_docs_row"])
    return one.unionByName(same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row."""
    done, sizes, wanted = mix(docs, "doc_id", "text", F.array("source"))
    kind = T.StructType([T.StructField("_source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    facts = F.broadcast(docs.sparkSession.createDataFrame([(s, n, float(wanted[s])) for s, n in sizes.items()], kind))
    out = done.withColumn("_source", F.col("sources")[0])
    return out.join(facts, out["_source"].eqNullSafe(facts["_source"]), "left").select(
        "doc_id", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
        (F.col("size") * F.col("copies")).cast("long").alias("taken"))
