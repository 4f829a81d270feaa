"""Building blocks that stay parallel when one key holds a large share of all rows.

No helper here gathers the rows of a key in one task: sizes come from partial aggregates, group values go back to the
rows through a join whose hot keys are salted, and exact quantiles rank a hot key's values band by band.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of one key that a single task may hold. The list of hotter keys is broadcast: it cannot have more than
# total rows / HOT_ROWS entries (125,000 short rows for 5e11 listings), so its size is bounded by construction.
HOT_ROWS = 4_000_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


# Spark then deletes the shuffle files of an execution when it ends, on all executors.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "step", codec: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: short plans, no recomputation, survives executor loss. The shuffle files of the write
    are deleted with it; the table stays until `discard`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that `cut` has written and that no later step reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly per-row work on a table that was read in fewer splits; large tables stay as they are.
    `df` is a scan with narrow steps."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def hashable(df: DataFrame) -> list[str]:
    """Columns that `xxhash64` takes: all without a map."""
    def has_map(t):
        if isinstance(t, T.MapType):
            return True
        if isinstance(t, T.ArrayType):
            return has_map(t.elementType)
        return isinstance(t, T.StructType) and any(has_map(f.dataType) for f in t.fields)
    return [f.name for f in df.schema.fields if not has_map(f.dataType)]


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str], size: str, how: str = "left",
           hot_rows: int = HOT_ROWS, optional: bool = False) -> DataFrame:
    """Join `stats` to `rows`. `size` is the column of `stats` with the number of rows of the key.

    Keys above `hot_rows` are spread over ceil(size / hot_rows) tasks by a salt; their stats row is repeated as often. If a written table of
    stats has no such key, the join is on the keys alone, so rows that lie by them already are not shuffled again. `optional` tells Spark that
    a key has one row of stats, which lets it leave out a left join whose columns nobody reads.
    """
    keys = list(keys)
    if "written_to" in vars(stats) and stats.where(F.col(size) > hot_rows).isEmpty():
        return rows.join(stats.dropDuplicates(keys) if optional else stats, keys, how)
    parts = F.ceil(F.col(size) / F.lit(hot_rows)).cast("int")
    hot = stats.where(F.col(size) > hot_rows).select(*keys, parts.alias("_parts")).distinct()
    salted = (rows.join(F.broadcast(hot), keys, "left")
              .withColumn("_salt", F.coalesce(_salt(rows, F.col("_parts")), F.lit(0))).drop("_parts"))
    repeated = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def _salt(df: DataFrame, parts: Column) -> Column:
    return F.pmod(F.xxhash64(*hashable(df)) + F.spark_partition_id() * 7919, parts.cast("long")).cast("int")


def grid_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, hot_pairs: int = 50_000_000) -> DataFrame:
    """Inner equi-join of two tables that may both repeat a key often.

    A key with too many rows on a side, or too many pairs, becomes a grid of tasks: each side is salted along its own
    axis and repeated along the other. The list of such keys is broadcast; it has at most
    (rows left + rows right) / hot_rows + pairs / hot_pairs entries. Both inputs are read twice: pass written tables.
    """
    keys = list(keys)
    n, m = F.col("_n"), F.col("_m")
    sizes = (left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), keys))
    rows, cols = F.ceil(n / hot_rows), F.ceil(m / hot_rows)
    more = F.ceil(n.cast("double") * m / rows / cols / hot_pairs)
    hot = (sizes.select(*keys, (rows * F.when(n >= m, more).otherwise(1)).cast("int").alias("_rows"),
                        (cols * F.when(n < m, more).otherwise(1)).cast("int").alias("_cols"))
           .where(F.col("_rows") * F.col("_cols") > 1))
    hot = cut(hot, "hot_keys")
    if hot.isEmpty():        # a small table is broadcast, and the other one keeps its tasks, however many rows a key joins
        return left.join(right, keys)

    def placed(df: DataFrame, own: str, other: str) -> DataFrame:
        spot = F.coalesce(_salt(df, F.col(f"_{own}s")), F.lit(0)).alias(f"_{own}")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"_{other}s"), F.lit(1)) - 1)).alias(f"_{other}")
        return df.join(F.broadcast(hot), keys, "left").select(*df.columns, spot, copies)

    return placed(left, "row", "col").join(placed(right, "col", "row"), [*keys, "_row", "_col"]).drop("_row", "_col")


def value_band(value: Column, per_unit: int = 4096) -> Column:
    """A coarse, order-preserving number for a value: 4096 bands per factor e, mirrored below zero."""
    log_band = F.floor(F.ln(F.abs(value)) * per_unit)
    return (F.when(value > 0, F.lit(10_000_000) + log_band)
            .when(value < 0, F.lit(-10_000_000) - log_band).otherwise(F.lit(0)).cast("long"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float | str],
                    logs: dict[str, float | str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Linear-interpolated quantiles per key, exact for any group size; NULL values are left out.

    Equal values are first folded into (value, count). Ranks are running counts within (key, band): an ordinary key
    has the single band 0, a key with more than `hot_rows` distinct values is cut into value bands, whose few counts
    give the rank offset. `logs` asks for quantiles of ln(value), interpolated between the same two neighbours. A quantile may be the name of
    one of the keys, for ranks that differ from key to key.
    Output: keys, n (values), distinct_n, one column per name.
    """
    keys, logs = list(keys), logs or {}
    folded = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c")))
    hot = (folded.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"))
           .where(F.col("_d") > hot_rows).select(*keys, "_n"))
    banded = (folded.join(F.broadcast(hot), keys, "left")
              .withColumn("_band", F.when(F.col("_n").isNotNull(), value_band(F.col("_v"))).otherwise(F.lit(0))))
    band = Window.partitionBy(*keys, "_band")
    ranked = (banded.withColumn("_upto", F.sum("_c").over(band.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_n", F.coalesce("_n", F.sum("_c").over(band))))
    before = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (banded.where(F.col("_n").isNotNull()).groupBy(*keys, "_band").agg(F.sum("_c").alias("_bc"))
               .select(*keys, "_band", F.coalesce(F.sum("_bc").over(before), F.lit(0)).alias("_off")))
    ranked = ranked.join(offsets, [*keys, "_band"], "left").withColumn("_upto", F.col("_upto") + F.coalesce("_off", F.lit(0)))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto")), F.col("_v")))

    wanted = list(dict.fromkeys([*quantiles.values(), *logs.values()]))
    names = {q: f"_{i}" for i, q in enumerate(wanted)}

    def spot(q: float | str) -> Column:
        rank = F.least(F.greatest(F.col(q), F.lit(0.0)), F.lit(1.0)) if isinstance(q, str) else F.lit(min(max(float(q), 0.0), 1.0))
        return rank

    picks = [x for q in wanted for x in (at(F.floor((F.col("_n") - 1) * spot(q))).alias(f"_lo{names[q]}"), at(F.ceil((F.col("_n") - 1) * spot(q))).alias(f"_hi{names[q]}"))]
    small = ranked.groupBy(*keys).agg(F.max("_n").alias("n"), F.count(F.lit(1)).alias("distinct_n"), *picks)

    def between(q: float | str, f: Callable[[Column], Column]) -> Column:
        place = (F.col("n") - 1) * spot(q)
        low, high = f(F.col(f"_lo{names[q]}")), f(F.col(f"_hi{names[q]}"))
        return low + (high - low) * (place - F.floor(place))

    return small.select(*keys, "n", "distinct_n",
                        *[between(q, lambda c: c).alias(name) for name, q in quantiles.items()],
                        *[between(q, F.ln).alias(name) for name, q in logs.items()])
