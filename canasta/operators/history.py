"""Replay of review sessions with undo and redo, in parallel within a session.

A session is a sequence of steps: a change (of one or several products), an undo or a redo. Its state is two numbers, the position on the stack of
changes and its top, up to which redo may go. Short sessions are folded in one row each. Long ones are cut into blocks of at most `BLOCK` steps, which are folded in parallel, each
from an assumed state. A block whose assumed state is not the one that the block before it ends with is folded again: the correction is carried
along the session as a running sum, for a block passes a shift on unless an undo met the empty stack. The states before the first wrong
block are exact, so the rounds end; mostly the second round finds nothing to correct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canasta.operators.skew import cut, discard

BLOCK = 1024
UNDO, CHANGE, REDO = -1, 0, 1
PLACE = ["session_id", "part", "block"]


def session_steps(log: DataFrame) -> DataFrame:
    """(session_id, seq, code): one row per step; log rows that share session and seq are one step, a change of several products."""
    code = F.when(F.col("action") == "undo", UNDO).when(F.col("action") == "redo", REDO).otherwise(CHANGE)
    return log.groupBy("session_id", "seq").agg(F.min(code).alias("code"))


def step_blocks(steps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(session_id, part, block, steps): at most `block` steps in order; part and block order the blocks of a session.

    The steps are sorted by range, so a long session lies in several tasks, and are numbered within (session, range).
    """
    ranged = steps.repartitionByRange("session_id", "seq").withColumn("part", F.spark_partition_id())
    number = F.row_number().over(Window.partitionBy("session_id", "part").orderBy("seq"))
    numbered = ranged.withColumn("block", F.floor((number - 1) / block).cast("long"))
    return numbered.groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct("seq", "code"))).alias("steps"))


def _after(at: Column, top: Column, code: Column) -> tuple[Column, Column]:
    moved = F.when(code == CHANGE, at + 1).when(code == UNDO, F.greatest(at - 1, F.lit(0))).otherwise(F.least(at + 1, top))
    return moved, F.when(code == CHANGE, at + 1).otherwise(top)


def _ended(steps: Column, at: Column, top: Column) -> Column:
    """State after a block: at, top; `shifts`: no undo met the empty stack; `changed`: the top is the block's own."""
    def step(s: Column, x: Column) -> Column:
        new_at, new_top = _after(s["at"], s["top"], x["code"])
        return F.struct(new_at.alias("at"), new_top.alias("top"), (s["shifts"] & ~((x["code"] == UNDO) & (s["at"] == 0))).alias("shifts"),
                        (s["changed"] | (x["code"] == CHANGE)).alias("changed"))

    start = F.struct(at.alias("at"), top.alias("top"), F.lit(True).alias("shifts"), F.lit(False).alias("changed"))
    return F.aggregate(steps, start, step)


def _positions(steps: Column, at: Column, top: Column) -> Column:
    """Position after each step of a block."""
    def step(s: Column, x: Column) -> Column:
        new_at, new_top = _after(s["at"], s["top"], x["code"])
        return F.struct(new_at.alias("at"), new_top.alias("top"), F.array_append(s["places"], new_at).alias("places"))

    start = F.struct(at.alias("at"), top.alias("top"), F.array().cast("array<bigint>").alias("places"))
    return F.aggregate(steps, start, step)["places"]


def entry_states(blocks: DataFrame) -> DataFrame:
    """(session_id, part, block, at, top): the exact state before every block, written to the shared folder."""
    zero = F.lit(0).cast("long")
    states = blocks.select(*PLACE, zero.alias("at"), zero.alias("top"))
    order = Window.partitionBy("session_id").orderBy("part", "block")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    previous = lambda c, default=0: F.coalesce(F.lag(c).over(order), F.lit(default))
    written = None
    while True:
        end = _ended(F.col("steps"), F.col("at"), F.col("top"))
        run = blocks.join(states, PLACE).select(*PLACE, "at", "top", end.alias("end"))
        run = run.select(*PLACE, "at", "top", (previous("end.at") - F.col("at")).alias("off"), (previous("end.top") - F.col("top")).alias("off_top"),
                         previous("end.shifts", False).alias("shifts"), previous("end.changed", False).alias("changed"))
        run = cut(run, "replay")
        if written is not None:
            discard(written)
        written = run
        if not run.where((F.col("off") != 0) | (F.col("off_top") != 0)).limit(1).count():
            return run.select(*PLACE, "at", "top")
        # a correction goes on through blocks that shift, and stops at those that do not
        group = F.sum((~F.col("shifts")).cast("int")).over(upto)
        within = Window.partitionBy("session_id", "group").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, 0)
        run = run.withColumn("group", group).withColumn("move", F.sum("off").over(within))
        own = F.when(F.col("changed") & F.col("shifts"), F.coalesce(F.lag("move").over(order), zero)).otherwise(zero)
        run = run.withColumn("base", F.col("off_top") + own).withColumn("group", F.sum(F.col("changed").cast("int")).over(upto))
        at = F.greatest(F.col("at") + F.col("move"), zero)
        states = run.withColumn("_at", at).select(*PLACE, F.col("_at").alias("at"), F.greatest(F.col("top") + F.sum("base").over(within), F.col("_at")).alias("top"))


def _stack(steps: Column, seq: T.DataType) -> Column:
    """The changes on the stack after all steps of a short session, bottom first."""
    def step(s: Column, x: Column) -> Column:
        at, made, change = s["at"], s["made"], x["code"] == CHANGE
        moved = F.when(change, at + 1).when(x["code"] == UNDO, F.greatest(at - 1, F.lit(0))).otherwise(F.least(at + 1, F.size(made)))
        return F.struct(moved.alias("at"), F.when(change, F.concat(F.slice(made, F.lit(1), at), F.array(x["seq"]))).otherwise(made).alias("made"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(T.ArrayType(seq)).alias("made"))
    return F.aggregate(steps, start, step, lambda s: F.slice(s["made"], F.lit(1), s["at"]))


def _short_sessions(log: DataFrame) -> DataFrame:
    """(session_id, level, seq) of the changes that are left, of sessions that each fit into one block: one shuffle brings a session together."""
    steps = session_steps(log.select("session_id", "seq", "action").repartition("session_id"))
    sessions = steps.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "code"))).alias("steps"))
    left = sessions.select("session_id", F.posexplode(_stack(F.col("steps"), log.schema["seq"].dataType)).alias("level", "seq"))
    return left.withColumn("level", F.col("level").cast("long") + 1)


def _long_sessions(log: DataFrame, block: int) -> DataFrame:
    """(session_id, level, seq) of the changes that are left, of sessions of any length."""
    blocks = cut(step_blocks(session_steps(log), block), "blocks")
    placed = blocks.join(entry_states(blocks), PLACE).select("session_id", F.explode(F.arrays_zip("steps", _positions(F.col("steps"), F.col("at"), F.col("top")).alias("level"))).alias("x"))
    placed = placed.select("session_id", "x.steps.seq", "x.steps.code", "x.level")
    ends = placed.groupBy("session_id").agg(F.max_by("level", "seq").alias("depth"), F.count(F.lit(1)).alias("_n"))
    made = placed.where(F.col("code") == CHANGE).groupBy("session_id", "level").agg(F.max("seq").alias("seq"))
    # the join on the session has one row per session on one side, so Spark splits a large session's other side
    return made.join(ends, "session_id").where(F.col("level") <= F.col("depth")).select("session_id", "level", "seq")


def undo_redo_replay(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """The changes still applied at the end of each session: session_id, level, seq, product_code, action, price.

    `log` has session_id, seq, product_code, action, price; rows that share session and seq are one step, so a change may cover several
    products and is undone as a whole. Undo steps back, redo forward, and a new change ends what could be redone. The surviving change of
    a level is the last one written there. Sessions of more than `block` rows are cut into blocks (see the module), so none is held in a task;
    the others are folded in one row each.
    """
    sizes = log.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0]
    if most is None or most <= block:
        alive = _short_sessions(log)
    else:
        long = cut(sizes.where(F.col("_n") > block).select("session_id"), "long_sessions")
        alive = _short_sessions(log.join(long, "session_id", "left_anti")).unionByName(_long_sessions(log.join(long, "session_id", "left_semi"), block))
    return alive.join(log.select("session_id", "seq", "product_code", "action", "price"), ["session_id", "seq"])
