"""Prefix trie of conversations, its subtree sums by a depth-band rollup.

A node is a distinct sequence of first turns. Turns are numbered without gathering a conversation (a range sort, counts per block), and a
prefix is known by the exclusive-or of two 64-bit hashes of its placed turns, which is summed up in stretches. A node's sums go to its ancestors in
two steps: within a band of `BAND` depths every node is exploded to the ancestors in its band alone; then the band roots, which hold the
sums of their band, form a trie of their own of 1/`BAND` the depth, which is rolled up in the same way, and each completed band-root total goes to the
ancestors in the band above. No row is exploded to more than `BAND` rows and the number of rounds is the logarithm of the depth to the base `BAND`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canasta.llm.batches import map_arrow
from canasta.operators.skew import attach, cut

BAND = 16
STRETCH = 65_536            # turns of a conversation whose hashes are summed up in one task
# Fixed values of the rebuilding.
FAMILY = 100                # conversations c - c % FAMILY, ... share the first turns of the first of them
HEADS = 6                   # crc32 of the decimal number modulo HEADS turns of it


def numbered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, c1, c2, chars): turns numbered from 1 by turn (null first), then role and text; hashes of role and text, code points of the text.

    Null roles and texts are empty. Repeated rows are turns of their own. Rows without conversation take no part. A conversation's
    rows are not gathered: equal rows are folded, all rows sorted by range, and numbered by running counts within (conversation, range).
    """
    turns = (rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                                                        F.coalesce(F.col(text), F.lit("")).alias("text"))
             .groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")))
    order = ["turn", "role", "text"]
    blocks = cut(turns.repartitionByRange("conv", *order).withColumn("block", F.spark_partition_id())
                 .withColumn("upto", F.sum("n").over(Window.partitionBy("conv", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
                 .select("conv", "block", "n", "upto", F.xxhash64("role", "text").alias("c1"), F.xxhash64(F.lit(1), "text", "role").alias("c2"),
                         F.length("text").cast("long").alias("chars")), "turns")
    sums = blocks.groupBy("conv", "block").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # only a range's first conversation can have turns in an earlier range: at most one row per range
    offsets = cut(sums.withColumn("before", before).where(F.col("before") > 0).select("conv", "block", "before"), "offsets")
    placed = blocks.join(offsets, ["conv", "block"], "left").withColumn("upto", F.col("upto") + F.coalesce("before", F.lit(0)))
    return placed.select("conv", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, "upto")).alias("pos"), "c1", "c2", "chars")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after the first h turns of each conversation c are replaced by those of conversation c - c % family.

    h is the unsigned crc32 of the decimal number modulo `heads`. Conversations are (conv, size), turns (conv, depth, c1, c2, chars) with
    depths from 1. A conversation without its first one loses its first h turns.
    """
    turns = cut(turns, "numbered")
    counts = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv") - F.col("conv") % family
    convs = counts.select("conv", "n", base.alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h"))
    known = counts.where(F.col("conv") % family == 0).select(F.col("conv").alias("base"), F.col("n").alias("_of_base"))
    given = F.least("h", F.coalesce("_of_base", F.lit(0)))
    convs = cut(convs.join(known, "base", "left").select("conv", "n", "base", "h", given.alias("given"), (given + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "convs")
    first = turns.where((F.col("pos") < heads) & (F.col("conv") % family == 0)).withColumnRenamed("conv", "base")
    head = convs.join(first, "base").where(F.col("pos") <= F.col("h")).select("conv", F.col("pos").alias("depth"), "c1", "c2", "chars")
    own = (attach(turns, convs.select("conv", "n", "h", "given"), ["conv"], "n", "inner").where(F.col("pos") > F.col("h"))
           .select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("depth"), "c1", "c2", "chars"))
    return convs.select("conv", "size"), head.unionAll(own)


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def prefixes(convs: DataFrame, turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(conv, depth, x1, x2, b1, b2, chars, last) for every conversation and depth from 0: x is the hash of the first `depth` turns, b that of
    one turn less, `last` marks a conversation's end. Written to the shared folder."""
    here = turns.select("conv", "depth", "chars", F.expr(f"(depth - 1) div {stretch}").alias("part"), F.xxhash64("depth", "c1", "c2").alias("p1"), F.xxhash64(F.lit(1), "c2", "c1", "depth").alias("p2"))
    running = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    here = cut(here.select("*", F.bit_xor("p1").over(running).alias("x1"), F.bit_xor("p2").over(running).alias("x2")), "stretches")
    sums = here.groupBy("conv", "part").agg(F.bit_xor("p1").alias("s1"), F.bit_xor("p2").alias("s2"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sums.select("conv", "part", F.bit_xor("s1").over(earlier).alias("o1"), F.bit_xor("s2").over(earlier).alias("o2")).where(F.col("part") > 0), "offsets")
    none = F.lit(0).cast("long")
    x = {k: _xor(F.col(f"x{k}"), F.coalesce(f"o{k}", none)) for k in "12"}
    rows = here.join(offsets, ["conv", "part"], "left").select("conv", "depth", x["1"].alias("x1"), x["2"].alias("x2"), _xor(x["1"], F.col("p1")).alias("b1"),
                                                              _xor(x["2"], F.col("p2")).alias("b2"), "chars")
    rows = attach(rows, convs.withColumn("_rows", F.greatest("size", F.lit(1))), ["conv"], "_rows", "inner").select(*rows.columns, (F.col("depth") == F.col("size")).alias("last"))
    null = F.lit(None).cast("long")
    roots = convs.select("conv", none.alias("depth"), none.alias("x1"), none.alias("x2"), null.alias("b1"), null.alias("b2"), none.alias("chars"), (F.col("size") == 0).alias("last"))
    return cut(rows.unionAll(roots), "prefixes")


def rollup(paths: DataFrame, values: DataFrame, names: list[str], top: int, band: int = BAND) -> DataFrame:
    """(level, node, names): sums over the subtree of every node, itself included.

    `paths` (conv, level, node) has for every conversation the node of each level from 0; a node is known by its level and its smallest
    conversation. `values` (level, node, names) has one row per node, `top` is the largest level.
    """
    upto = Window.partitionBy("conv", "band").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    way = paths.withColumn("band", F.expr(f"level div {band}")).withColumn("way", F.collect_list("node").over(upto))
    way = cut(way.where((F.col("conv") == F.col("node")) | (F.col("level") % band == band - 1)).select("conv", "level", "node", "way"), "ways")
    mine = way.where(F.col("conv") == F.col("node")).select("level", "node", "way")
    spread = lambda df: df.select((F.col("level") - F.col("level") % band).alias("_begin"), *names, F.posexplode("way").alias("_at", "node")).select(
        (F.col("_begin") + F.col("_at")).alias("level"), "node", *names)
    summed = lambda df: df.groupBy("level", "node").agg(*[F.sum(c).alias(c) for c in names])
    within = cut(summed(spread(values.join(mine, ["level", "node"]))), "band_sums")
    if top < band:
        return within
    up = lambda df: df.where(F.col("level") % band == 0).withColumn("level", F.expr(f"level div {band}"))
    roots = rollup(up(paths), up(within), names, top // band, band)
    given = roots.where(F.col("level") > 0).select((F.col("level") * band - 1).alias("level"), F.col("node").alias("conv"), *names)
    above = way.where(F.col("level") % band == band - 1).select("conv", "level", "way")
    return cut(summed(within.unionAll(spread(given.join(above, ["conv", "level"])))), "sums")


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256): digest of the conversations (conv, depth, node), ascending, as decimal numbers with commas between.

    A digest reads its text in order, so a node's numbers pass through one task, sorted by Spark and hashed as they come: no list is held.
    """
    def run(batches):
        held, state = None, None
        for batch in batches:
            depth, node, conv = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(depth) != 0) | (np.diff(node) != 0)) + 1 if len(conv) else []
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(conv)]):
                if a == b:
                    continue
                own = (int(depth[a]), int(node[a]))
                line = ",".join(map(str, conv[a:b].tolist())).encode()
                if own == held:
                    state.update(b"," + line)
                else:
                    if held is not None:
                        out.append((*held, state.hexdigest()))
                    held, state = own, hashlib.sha256(line)
            yield table(out)
        if held is not None:
            yield table([(*held, state.hexdigest())])

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["depth", "node", "ends_sha256"])

    dealt = rows.select("depth", "node", "conv").repartition("depth", "node").sortWithinPartitions("depth", "node", "conv")
    return map_arrow(dealt, run, "depth long, node long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame, band: int = BAND, stretch: int = STRETCH) -> DataFrame:
    """(conv, depth, parent, n_convs, n_children, n_leaves, saved, ends_sha256), one row per distinct sequence of first turns.

    `convs` (conv, size) has every conversation once with its number of turns, `turns` (conv, depth, c1, c2, chars) their turns, depths from 1 without a gap. A
    node is known by its depth and its smallest member `conv`; `parent` is that of the node above (null for the root). `saved` sums over the
    subtree what sharing a turn saves: (members - 1) times its code points. No conversation: no node, not even a root.
    """
    rows = prefixes(convs, turns, stretch)
    key = ["depth", "x1", "x2"]
    nodes = rows.groupBy(*key).agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"), F.min("b1").alias("b1"), F.min("b2").alias("b2"))
    nodes = cut(nodes, "nodes")
    children = nodes.where(F.col("depth") > 0).groupBy((F.col("depth") - 1).alias("depth"), F.col("b1").alias("x1"), F.col("b2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    parents = nodes.where(F.col("n_children") > 0).select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("b1"), F.col("x2").alias("b2"), F.col("node").alias("parent"),
                                                          F.col("n_children").alias("_children"))
    nodes = cut(attach(nodes, parents, ["depth", "b1", "b2"], "_children").select("depth", "node", "parent", "n_convs", "n_children", "chars", "x1", "x2"), "nodes")
    members = cut(attach(rows.select("conv", *key, "last"), nodes.select(*key, "node", "n_convs"), key, "n_convs", "inner").select("conv", "depth", "node", "last"), "members")
    values = nodes.select(F.col("depth").alias("level"), "node", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    top = nodes.agg(F.max("depth")).first()[0] or 0
    sums = rollup(members.select("conv", F.col("depth").alias("level"), "node"), values, ["n_leaves", "saved"], top, band).withColumnRenamed("level", "depth")
    ends = _ends(members.where("last"))
    done = nodes.join(sums, ["depth", "node"]).join(ends, ["depth", "node"], "left")
    return done.select(F.col("node").alias("conv"), "depth", "parent", "n_convs", "n_children", "n_leaves", "saved",
                       F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def digest(rows: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    nodes = trie(*rebuilt(numbered_turns(rows)))
    return nodes.toDF("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_CRC = ("xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], "
        "lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT)")
SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n, c - c % {FAMILY} AS base, {_CRC} % {HEADS} AS h FROM t GROUP BY c),
convs AS (SELECT n.c, n.n, n.base, n.h, least(n.h, coalesce(b.n, 0)) AS given FROM n LEFT JOIN n b ON b.c = n.base),
turns AS (SELECT convs.c, pos AS d, role, text FROM convs JOIN t ON t.c = base WHERE pos <= h
          UNION ALL SELECT c, pos - h + given, role, text FROM convs JOIN t USING (c) WHERE pos > h),
firsts AS (SELECT c, d, length(text) AS chars, list([role, text]) OVER (PARTITION BY c ORDER BY d) AS k FROM turns UNION ALL SELECT c, 0, 0, [] FROM convs),
nodes AS (SELECT d, k, min(c) AS m, count(*) AS n, any_value(chars) AS chars FROM firsts GROUP BY d, k),
members AS (SELECT c, d, m FROM firsts JOIN nodes USING (d, k)),
up AS (SELECT nodes.d, nodes.m, nodes.n, (nodes.n - 1) * chars AS saved, p.m AS parent FROM nodes LEFT JOIN members p ON p.c = nodes.m AND p.d = nodes.d - 1),
children AS (SELECT d - 1 AS d, parent AS m, count(*) AS n FROM up WHERE d > 0 GROUP BY d, parent),
valued AS (SELECT up.d, up.m, up.saved, CASE WHEN children.n IS NULL THEN 1 ELSE 0 END AS leaf FROM up LEFT JOIN children USING (d, m)),
sums AS (SELECT a.d, a.m, sum(leaf) AS leaves, sum(saved) AS saved FROM valued v JOIN members a ON a.c = v.m AND a.d <= v.d GROUP BY a.d, a.m),
ends AS (SELECT d, m, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS h FROM members JOIN (SELECT c, given + greatest(n - h, 0) AS d FROM convs) USING (c, d) GROUP BY d, m)
SELECT m AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, up.n AS n_convs, CAST(coalesce(children.n, 0) AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, coalesce(ends.h, sha256('')) AS ends_sha256
FROM up JOIN sums USING (d, m) LEFT JOIN children USING (d, m) LEFT JOIN ends USING (d, m)"""
