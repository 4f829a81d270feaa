"""Size peers, near-duplicates and price outliers: which accepted listings set the market price.

Every function takes a candidates table keyed by (product_code, store, sku) and returns it with more columns; no row is
dropped, so the audit trail stays whole. `accepted` says which rows are still in play.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canasta.functions.money import fixed
from canasta.functions.text import token_jaccard
from canasta.operators.skew import HOT_ROWS, attach, cut, exact_quantiles, grid_join
from canasta.settings import PriceSettings

PRODUCT = ["product_code"]
PRODUCT_STORE = ["product_code", "store"]

# Listings of one product and store that are compared inside one row; larger groups are resolved in rounds.
FOLD_ROWS = 256


def _in(value: Column, low: float, high: float) -> Column:
    return value.between(F.lit(low), F.lit(high))


def _sized() -> Column:
    return F.col("accepted") & F.coalesce(F.col("size_ratio") > 0, F.lit(False))


def _neutral(df: DataFrame) -> Column:
    return F.coalesce(F.col("size_neutral"), F.lit(False)) if "size_neutral" in df.columns else F.lit(False)


def size_bands(cands: DataFrame, settings: PriceSettings = PriceSettings()) -> DataFrame:
    """One row per product: how many sizes are near the target's and which peer group follows from it."""
    s, ratio, sized = settings, F.col("size_ratio"), _sized()
    counts = cands.groupBy(*PRODUCT).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("accepted").alias("n_accepted"), F.count_if(sized).alias("n_sized"),
        F.count_if(sized & _in(ratio, s.preferred_low, s.preferred_high)).alias("n_preferred"),
        F.count_if(sized & _in(ratio, s.close_low, s.close_high)).alias("n_close"),
        F.count_if(sized & ~_neutral(cands)).alias("n_packaged"))
    preferred, close = F.col("n_preferred"), F.col("n_close")
    strategy = (F.when(F.col("n_sized") == 0, "NO SIZE DATA")
                .when((preferred >= s.min_preferred) & ((preferred >= s.min_good_matches) | (close <= preferred)), "PREFERRED")
                .when(close >= 2, "CLOSE").otherwise("FALLBACK"))
    return counts.withColumn("strategy", strategy)


def size_band(cands: DataFrame, settings: PriceSettings = PriceSettings(), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each candidate with the peer-group strategy of its product (counted over all stores)."""
    bands = cut(size_bands(cands, settings).select(*PRODUCT, "n_rows", "strategy", "n_packaged"), "bands")
    return attach(cands, bands, PRODUCT, "n_rows", hot_rows=hot_rows).drop("n_rows")


def size_neutral(banded: DataFrame) -> DataFrame:
    """Marks the sold-by-weight rows that sit out the choice of a fallback size group and rejoin afterwards."""
    aside = (F.col("strategy") == "FALLBACK") & _sized() & _neutral(banded) & (F.col("n_packaged") > 0)
    return banded.withColumn("set_aside", aside)


def retail_cluster(banded: DataFrame, settings: PriceSettings = PriceSettings(), hot_rows: int = HOT_ROWS) -> DataFrame:
    """The anchor size of each fallback product: best tier first, then the size nearest to the target's.

    A group holds the sizes within `cluster_factor` of its anchor. Tier 3: enough listings from two stores; 2 and 1:
    a few listings with and without two stores. Sizes are cut into bands one factor wide, so a group reaches at most
    into the two neighbouring bands. Tiers only ask for `min_good_matches` listings and two stores, so the few smallest
    and largest sizes of each (band, store) answer every anchor exactly and no pair of listings is formed.
    Equally near anchors: the smaller size wins.
    """
    return _cluster(size_neutral(banded), settings, hot_rows)


def _cluster(marked: DataFrame, s: PriceSettings, hot_rows: int) -> DataFrame:
    """`retail_cluster` of rows that are marked by `size_neutral`."""
    factor, few = s.cluster_factor, max(1, s.min_preferred)
    enough = max(few, s.min_good_matches)
    width = math.log(factor) * (1 + 1e-9)
    base = marked.where((F.col("strategy") == "FALLBACK") & _sized() & ~F.col("set_aside"))
    sizes = (base.groupBy(*PRODUCT_STORE, "size_ratio").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("band", F.floor(F.ln("size_ratio") / F.lit(width)).cast("long")))

    def ends(order: Column) -> DataFrame:
        w = Window.partitionBy(*PRODUCT_STORE, "band").orderBy(order)
        return sizes.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= enough).drop("_r")

    edge = ends(F.col("size_ratio").asc()).unionByName(ends(F.col("size_ratio").desc())).distinct()
    reach = (edge.withColumn("band", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])))
             .groupBy(*PRODUCT, "band")
             .agg(F.collect_list(F.struct(F.col("size_ratio").alias("r"), "store", F.least("n", F.lit(enough)).alias("n"))).alias("near")))
    totals = base.groupBy(*PRODUCT).agg(F.min("store").alias("_s0"), F.max("store").alias("_s1"))
    anchors = sizes.select(*PRODUCT, "band", F.col("size_ratio").alias("anchor")).distinct()
    spots = anchors.groupBy(*PRODUCT, "band").agg(F.count(F.lit(1)).alias("_n"))
    anchors = attach(anchors, reach.join(spots, [*PRODUCT, "band"]).join(totals, PRODUCT), [*PRODUCT, "band"], "_n", "inner", hot_rows)
    inside = F.filter("near", lambda x: (x["r"] / F.col("anchor")).between(F.lit(1 / factor), F.lit(factor)))
    anchors = (anchors.withColumn("inside", inside)
               .select(*PRODUCT, "anchor", "_s0", "_s1",
                       F.aggregate("inside", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("members"),
                       (F.array_min(F.transform("inside", lambda x: x["store"])) != F.array_max(F.transform("inside", lambda x: x["store"]))).alias("_two")))
    multi = F.col("_two") | (F.col("_s0") == F.col("_s1"))
    tier = (F.when((F.col("members") >= enough) & multi, 3).when(F.col("members") >= few, F.when(multi, 2).otherwise(1)).otherwise(0))
    best = F.max(F.struct(tier.alias("tier"), (-size_distance(F.col("anchor"))).alias("near"), (-F.col("anchor")).alias("small")))
    return (anchors.groupBy(*PRODUCT).agg(best.alias("b"))
            .select(*PRODUCT, (-F.col("b.small")).alias("anchor"), F.col("b.tier").alias("tier")))


def size_distance(ratio: Column) -> Column:
    """Grows with |ln(ratio)|; a plain division, so equal distances compare equal on every platform."""
    return F.greatest(ratio, 1 / ratio)


def in_cluster(settings: PriceSettings = PriceSettings()) -> Column:
    f = settings.cluster_factor
    return F.coalesce((F.col("size_ratio") / F.col("anchor")).between(F.lit(1 / f), F.lit(f)), F.lit(False))


def closest_per_store(cluster: DataFrame, k: int = 10) -> DataFrame:
    """The k listings of each product and store whose size is nearest to the target's (sku breaks ties)."""
    w = Window.partitionBy(*PRODUCT_STORE).orderBy(size_distance(F.col("size_ratio")), "sku", "price")
    return cluster.withColumn("closeness", F.row_number().over(w)).where(F.col("closeness") <= k)


def size_filter(cands: DataFrame, settings: PriceSettings = PriceSettings(), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keep the peer group of each product: adds strategy, anchor, `size_kept` and the reason text."""
    return _size_text(_size_peers(cands, settings, hot_rows)[0], settings)


def _size_peers(cands: DataFrame, s: PriceSettings, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """(candidates with strategy, set_aside, anchor and size_kept, one row per product with strategy and anchor).

    The rows are written once, with their strategy; only those of fallback products meet the anchors and cut-offs.
    """
    bands = cut(size_bands(cands, s).select(*PRODUCT, "n_rows", "strategy", "n_packaged"), "bands")
    banded = cut(size_neutral(attach(cands, bands, PRODUCT, "n_rows", hot_rows=hot_rows)).drop("n_rows", "n_packaged"), "banded")
    fallback = banded.where(F.col("strategy") == "FALLBACK")
    anchors = cut(_cluster(fallback, s, hot_rows).select(*PRODUCT, "anchor"), "anchors")
    weighted = cut(anchors.join(bands.select(*PRODUCT, "n_rows"), PRODUCT), "weighted")
    members = attach(fallback.where(_sized() & ~F.col("set_aside")), weighted, PRODUCT, "n_rows", "inner", hot_rows).where(in_cluster(s))
    # The k-th nearest listing of each store is the cut-off; the limited window keeps k rows per map task.
    last = (closest_per_store(members, s.fallback_per_store).groupBy(*PRODUCT_STORE)
            .agg(F.max(F.struct(size_distance(F.col("size_ratio")).alias("d"), "sku", "price")).alias("last")))
    sizes = fallback.groupBy(*PRODUCT_STORE).agg(F.count(F.lit(1)).alias("_rows"))
    groups = cut(sizes.join(anchors, PRODUCT).join(last, PRODUCT_STORE, "left"), "size_groups")
    # Written, for the steps that follow read it several times.
    full = cut(attach(fallback, groups, PRODUCT_STORE, "_rows", hot_rows=hot_rows).drop("_rows"), "fallback")
    others = banded.where(F.coalesce(F.col("strategy") != "FALLBACK", F.lit(True)))
    full = full.unionByName(others.withColumns({c: F.lit(None).cast(full.schema[c].dataType) for c in ("anchor", "last")}))
    ratio, sized, strategy = F.col("size_ratio"), _sized(), F.col("strategy")
    near = F.struct(size_distance(ratio).alias("d"), F.col("sku"), F.col("price"))
    kept = (F.when(~F.col("accepted"), False).when(strategy == "NO SIZE DATA", True).when(F.col("set_aside"), True)
            .when(~sized, False)
            .when(strategy == "PREFERRED", _in(ratio, s.preferred_low, s.preferred_high))
            .when(strategy == "CLOSE", _in(ratio, s.close_low, s.close_high))
            .otherwise(in_cluster(s) & F.coalesce(near <= F.col("last"), F.lit(False))))
    return full.withColumn("size_kept", kept).drop("last"), bands.select(*PRODUCT, "strategy").join(anchors, PRODUCT, "left")


def _size_text(rows: DataFrame, s: PriceSettings) -> DataFrame:
    """Adds size_strategy and size_reason."""
    ratio, strategy = F.col("size_ratio"), F.col("strategy")
    label = (F.when(strategy == "PREFERRED", f"PREFERRED {s.preferred_low:.2f}-{s.preferred_high:.2f}x")
             .when(strategy == "CLOSE", f"CLOSE {s.close_low:.2f}-{s.close_high:.2f}x")
             .when(strategy == "FALLBACK", F.concat(F.lit("FALLBACK NEAREST RETAIL SIZE around "), fixed(F.col("anchor")), F.lit("x")))
             .otherwise(strategy))
    r2 = fixed(ratio)
    reason = (F.when(~F.col("accepted"), None).when(strategy == "NO SIZE DATA", None)
              .when(F.col("set_aside"), F.concat(F.lit("accepted; sold by weight (any quantity); size strategy="), "size_strategy"))
              .when(ratio.isNull(), "SIZE PEER REMOVED: unit-size ratio unavailable while sized peers exist")
              .when(F.col("size_kept"), F.concat(F.lit("accepted; size strategy="), "size_strategy", F.lit("; ratio="), r2))
              .otherwise(F.concat(F.lit("SIZE-DISTANT MATCH REMOVED: ratio="), r2, F.lit("; strategy="), "size_strategy")))
    return rows.withColumn("size_strategy", label).withColumn("size_reason", reason)


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| over the larger magnitude; NULL when unknown or both zero."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNotNull() & b.isNotNull() & (top > 0), F.abs(a - b) / top)


def near_duplicate(a: Column, b: Column, settings: PriceSettings = PriceSettings()) -> Column:
    """Two listings (structs sku, kg, u, toks) of one product and store describe the same article."""
    s = settings
    close = (F.coalesce(relative_difference(a["kg"], b["kg"]) <= F.lit(s.duplicate_size), F.lit(False))
             & F.coalesce(relative_difference(a["u"], b["u"]) <= F.lit(s.duplicate_price), F.lit(False)))
    names = (((F.array_sort(a["toks"]) == F.array_sort(b["toks"])) & (F.round(a["kg"], 3) == F.round(b["kg"], 3)))
             | (token_jaccard(a["toks"], b["toks"]) >= F.lit(s.duplicate_jaccard)))
    return (a["sku"] == b["sku"]) | (close & names)


def _words(df: DataFrame) -> Column:
    return F.array_sort(F.array_distinct("tokens")) if "tokens" in df.columns else F.array(F.lit("*"))


TWIN = [*PRODUCT_STORE, "_kg", "_u", "_t"]


def _fold(lists: DataFrame, settings: PriceSettings) -> Column:
    """The greedy choice over `xs` (structs with x, in order): the same structs with the sku they repeat, NULL if kept."""
    item = lists.schema["xs"].dataType.elementType
    named = "toks" in item["x"].dataType.names
    fields = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in item.fields)
    start = F.array().cast(f"array<struct<{fields},keeper:string>>")

    def listing(x: Column) -> dict[str, Column]:
        return {c: x[c] for c in ("sku", "kg", "u")} | {"toks": x["toks"] if named else F.array(F.lit("*"))}

    def step(done: Column, e: Column) -> Column:
        hits = F.filter(done, lambda k: k["keeper"].isNull() & near_duplicate(listing(k["x"]), listing(e["x"]), settings))
        last = F.get(done, F.size(done) - 1)
        repeat = F.coalesce(last["x"]["sku"] == e["x"]["sku"], F.lit(False))
        keeper = F.when(repeat, F.coalesce(last["keeper"], last["x"]["sku"])).otherwise(F.get(hits, F.lit(0))["x"]["sku"])
        return F.concat(done, F.array(F.struct(*[e[f.name].alias(f.name) for f in item.fields], keeper.alias("keeper"))))

    return F.aggregate("xs", start, step)


def _by_size(rows: DataFrame, fold_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups that one row can hold, and the rows of larger groups (None if there are none).

    Sizes come from counts that Spark combines before the shuffle; no row of a large group is gathered.
    """
    sizes = cut(rows.groupBy(*PRODUCT_STORE).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > fold_rows), "large_groups")
    if sizes.isEmpty():
        return rows, None
    groups = sizes.select(*PRODUCT_STORE)
    return rows.join(groups, PRODUCT_STORE, "left_anti"), rows.join(groups, PRODUCT_STORE, "left_semi")


def _lists(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of each product and store as one array in the order of x: by sku and then unit price, size and words."""
    entry = F.struct("x", *columns)
    return rows.groupBy(*PRODUCT_STORE).agg(F.array_sort(F.collect_list(entry)).alias("xs"))


def dedupe_greedy(cands: DataFrame, settings: PriceSettings = PriceSettings(), live: str = "accepted",
                  fold_rows: int = FOLD_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds `duplicate_of`: the sku of the kept listing of the same product and store that a row repeats, else NULL.

    Rows are taken in sku order (then unit price, size, words); a row is kept unless it nearly repeats a kept one. Of rows that
    repeat a sku the first stands for all: the others repeat it, or what it repeats. Groups of up to `fold_rows` are decided inside one
    row, with a single shuffle of the listings, and written to the shared folder. Larger groups are decided on one representative of
    all listings that agree in size, unit price and words: by the same fold if few are left, otherwise in parallel rounds. The result
    does not depend on which way a group takes.
    """
    usable = F.coalesce(F.col(live) & (F.col("kg") > 0) & (F.col("price_per_kg") > 0), F.lit(False))
    # A value of a listing is carried once: in x if the choice reads it, else in row.
    x = F.struct("sku", F.col("price_per_kg").alias("u"), F.col("kg").cast("double").alias("kg"), *([_words(cands).alias("toks")] if "tokens" in cands.columns else []))
    in_x = {"sku": "x.sku", "price_per_kg": "x.u"} | ({"kg": "x.kg"} if cands.schema["kg"].dataType == T.DoubleType() else {})
    rest = [c for c in cands.columns if c not in in_x and c not in PRODUCT_STORE]
    small, large = _by_size(cands.where(usable), fold_rows)
    lists = _lists(small.select(*PRODUCT_STORE, x.alias("x"), F.struct(*rest).alias("row")), ["row"])
    taken = lists.select(*PRODUCT_STORE, F.inline(_fold(lists, settings)))
    columns = [F.col(c if c in PRODUCT_STORE else in_x.get(c, f"row.{c}")).alias(c) for c in cands.columns]
    out = cut(taken.select(*columns, F.col("keeper").alias("duplicate_of")), "decided")
    out = out.unionByName(cands.where(~usable).withColumn("duplicate_of", F.lit(None).cast("string")))
    if large is None:
        return out
    again = Window.partitionBy(*PRODUCT_STORE, "sku").orderBy("price_per_kg", "kg", _words(cands))
    numbered = cut(large.withColumn("_again", F.row_number().over(again) > 1), "large_rows")
    first = cut(_dedupe_large(numbered.where(~F.col("_again")).drop("_again"), settings, fold_rows, hot_rows), "large_decided")
    repeats = numbered.where("_again").drop("_again")
    keys = [*PRODUCT_STORE, "sku"]
    fate = first.select(*keys, F.coalesce("duplicate_of", "sku").alias("duplicate_of"))
    sizes = repeats.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return out.unionByName(first).unionByName(attach(repeats, fate.join(sizes, keys), keys, "_n", hot_rows=hot_rows).drop("_n"))


def _dedupe_large(cands: DataFrame, settings: PriceSettings, fold_rows: int, hot_rows: int) -> DataFrame:
    """The same for large groups in which no sku repeats."""
    rows = cands.withColumns({"_kg": F.col("kg").cast("double"), "_u": F.col("price_per_kg"), "_t": _words(cands)})
    twins = rows.groupBy(*TWIN).agg(F.min("sku").alias("sku"), F.count(F.lit(1)).alias("twins"))
    x = F.struct("sku", F.col("_u").alias("u"), F.col("_kg").alias("kg"), F.col("_t").alias("toks"))
    reps = cut(twins.select(*PRODUCT_STORE, "twins", x.alias("x")), "representatives")
    small, large = _by_size(reps, fold_rows)
    lists = _lists(small, ["twins"])
    decided = lists.select(*PRODUCT_STORE, F.inline(_fold(lists, settings))).withColumn("keeper", F.coalesce("keeper", "x.sku"))
    decided = cut(decided, "decided")
    if large is not None:
        decided = decided.unionByName(dedupe_rounds(large, settings))
    verdict = decided.select(*PRODUCT_STORE, F.col("x.kg").alias("_kg"), F.col("x.u").alias("_u"), F.col("x.toks").alias("_t"), "twins", "keeper")
    full = attach(rows, verdict, TWIN, "twins", hot_rows=hot_rows)
    return full.select(*cands.columns, F.when(F.col("keeper") != F.col("sku"), F.col("keeper")).alias("duplicate_of"))


def dedupe_rounds(reps: DataFrame, settings: PriceSettings = PriceSettings()) -> DataFrame:
    """The greedy choice for large groups (product_code, store, x, twins), decided in parallel.

    Near-duplicates differ by a bounded factor in size and unit price and share one of a few rare words, so they meet
    in neighbouring cells of a (size, price) grid under one of those words. A row that is the earliest in every
    neighbourhood it belongs to is kept for certain; what nearly repeats it goes; the rest is looked at again.
    """
    s = settings
    wide = [-math.log(1 - t) * (1 + 1e-9) for t in (s.duplicate_size, s.duplicate_price)]
    group, cell = PRODUCT_STORE, [*PRODUCT_STORE, "ck", "cp", "t"]
    freq = reps.select(F.explode("x.toks").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    ranked = (reps.select(*group, F.col("x.sku").alias("sku"), F.explode_outer("x.toks").alias("t")).join(freq, "t", "left")
              .groupBy(*group, "sku").agg(F.array_sort(F.collect_list(F.struct("df", F.coalesce("t", F.lit("")).alias("t")))).alias("by_df")))
    size = F.size("x.toks")
    prefix = F.greatest(size - F.ceil(size * F.lit(s.duplicate_jaccard - 1e-9)) + 1, F.lit(1)).cast("int")
    open_rows = cut(reps.withColumn("sku", F.col("x.sku")).join(ranked, [*group, "sku"])
                    .select(*group, "x", "twins", "sku",
                            F.floor(F.ln("x.kg") / F.lit(wide[0])).alias("ck"), F.floor(F.ln("x.u") / F.lit(wide[1])).alias("cp"),
                            F.transform(F.slice("by_df", F.lit(1), prefix), lambda e: e["t"]).alias("ts")), "open")
    everything = open_rows

    def blocks(df: DataFrame) -> DataFrame:
        return df.select(*group, "sku", "x", "ck", "cp", F.explode("ts").alias("t"))

    def around(df: DataFrame) -> DataFrame:
        for c in ("ck", "cp"):
            df = df.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
        return df

    kept_parts = []
    while not open_rows.isEmpty():
        here = blocks(open_rows)
        lead = here.groupBy(*cell).agg(F.min("sku").alias("lead"), F.count(F.lit(1)).alias("n"))
        near = around(lead.drop("n")).groupBy(*cell).agg(F.min("lead").alias("lead")).join(lead.select(*cell, "n"), cell)
        first = (attach(here.select(*cell, "sku"), near, cell, "n").groupBy(*group, "sku").agg(F.min("lead").alias("lead"))
                 .where(F.col("lead") == F.col("sku")).select(*group, "sku"))
        kept = cut(open_rows.join(first, [*group, "sku"], "left_semi"), "kept")
        kept_parts.append(kept)
        reach = around(blocks(kept)).select(*cell, F.col("x").alias("k"))
        gone = (grid_join(cut(here, "blocks"), cut(reach, "reach"), cell).where(near_duplicate(F.col("k"), F.col("x"), s)).select(*group, "sku").distinct())
        open_rows = cut(open_rows.join(gone, [*group, "sku"], "left_anti"), "open")
    kept = reduce(DataFrame.unionByName, kept_parts)
    reach = around(blocks(kept)).select(*cell, F.col("x").alias("k"))
    keeper = (grid_join(cut(blocks(everything), "blocks"), cut(reach, "reach"), cell)
              .where((F.col("k.sku") < F.col("sku")) & near_duplicate(F.col("k"), F.col("x"), s))
              .groupBy(*group, "sku").agg(F.min("k.sku").alias("keeper")))
    return (everything.select(*group, "x", "twins", "sku").join(keeper, [*group, "sku"], "left")
            .select(*group, "x", "twins", F.coalesce("keeper", "sku").alias("keeper")))


def outlier_tests(cands: DataFrame, settings: PriceSettings = PriceSettings(), live: str = "accepted",
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds the product's median, the hard band verdict `off_band`, the robust score `mad_z` and `off_mad`.

    Prices are pooled over all stores. The band needs three positive prices, the robust score five; the spread of the
    logarithms includes rows outside the band and is floored, and only rows inside the band are tested with it.
    """
    return _outlier_tests(cands, settings, live, hot_rows)[0]


def _outlier_tests(cands: DataFrame, s: PriceSettings, live: str, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """(`outlier_tests`, one row per product with n_prices and median_price). The scores need the prices alone; whole rows are joined once."""
    u = F.col("price_per_kg")
    valid = F.col(live) & F.coalesce(u > 0, F.lit(False))
    priced = cands.where(valid).select(*PRODUCT, "price_per_kg")
    centre = exact_quantiles(priced, PRODUCT, "price_per_kg", {"median_price": 0.5}, {"_log_median": 0.5}, hot_rows)
    sizes = cands.groupBy(*PRODUCT).agg(F.count(F.lit(1)).alias("_rows"))
    centre = cut(sizes.join(centre.select(*PRODUCT, F.col("n").alias("n_prices"), "median_price", "_log_median"), PRODUCT, "left"), "centre")
    dist = F.abs(F.ln(u) - F.col("_log_median"))
    tested = cut(centre.where(F.col("n_prices") >= 5).select(*PRODUCT, "_log_median", "_rows"), "tested")
    far = attach(priced, tested, PRODUCT, "_rows", "inner", hot_rows).select(*PRODUCT, dist.alias("_d"))
    mad = exact_quantiles(far, PRODUCT, "_d", {"_mad": 0.5}, hot_rows=hot_rows).select(*PRODUCT, "_mad")
    stats = cut(centre.join(mad, PRODUCT, "left"), "price_stats")
    rows = attach(cands, stats, PRODUCT, "_rows", hot_rows=hot_rows).drop("_rows")
    off_band = valid & (F.col("n_prices") >= 3) & ((u < F.col("median_price") * s.outlier_low) | (u > F.col("median_price") * s.outlier_high))
    z = F.when(valid & (F.col("n_prices") >= 5), F.lit(0.6745) * dist / F.greatest(F.col("_mad"), F.lit(s.mad_floor)))
    rows = (rows.withColumn("off_band", F.coalesce(off_band, F.lit(False))).withColumn("mad_z", z)
            .withColumn("off_mad", F.coalesce((F.col("mad_z") > s.mad_z_limit) & ~F.col("off_band"), F.lit(False)))
            .drop("_log_median", "_mad"))
    return rows, centre.select(*PRODUCT, "n_prices", "median_price")


def _keeper_titles(rows: DataFrame, hot_rows: int) -> DataFrame:
    """Adds `_of`: the title of the listing that a near-duplicate repeats (NULL for other rows and without titles)."""
    nothing = F.lit(None).cast("string")
    if "title" not in rows.columns:
        return rows.withColumn("_of", nothing)
    keys, repeats = [*PRODUCT_STORE, "duplicate_of"], rows.where(F.col("duplicate_of").isNotNull())
    counts = repeats.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    titles = rows.select(*PRODUCT_STORE, F.col("sku").alias("duplicate_of"), F.col("title").alias("_of")).join(counts, keys)
    named = attach(repeats, titles, keys, "_n", hot_rows=hot_rows).drop("_n")
    return rows.where(F.col("duplicate_of").isNull()).withColumn("_of", nothing).unionByName(named)


def clean_listings(cands: DataFrame, settings: PriceSettings = PriceSettings(), hot_rows: int = HOT_ROWS,
                   rejected: tuple[DataFrame, DataFrame] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Size peers over all stores, then near-duplicates per store, then price outliers over all stores.

    Every row ends with one `status`: REJECTED (before cleaning), SIZE, DUPLICATE, OUTLIER or ACCEPTED, a reason and its code (the
    status for the three steps here, the rule's code for earlier ones).
    Rows rejected before go past the three steps, those of other sizes past the last two; they take the figures of their product at the end,
    by a join that Spark leaves out if nobody reads these figures. The first two steps are written
    to the shared folder, so no step is computed twice.
    `rejected`: further rows that were rejected before, with the columns of `cands`, and how many there are (product_code, _rows). They may
    be a plan that is not written: it is computed by who reads the result.
    `columns`: what the caller wants of the rows (columns of `cands`, status, reason_code, duplicate_of); then no step carries anything else.
    """
    s = settings
    had = list(cands.columns)
    had_reason = F.col("reason") if "reason" in cands.columns else F.lit(None).cast("string")
    cands = cands.withColumn("reason", had_reason)
    out = F.coalesce(~F.col("accepted"), F.lit(False))
    sized, peers = _size_peers(cands.where(~out), s, hot_rows)
    removed = F.coalesce(~F.col("size_kept"), F.lit(False))
    if columns is not None:
        return _ends(cands.where(out), sized, columns, s, hot_rows)
    single = (dedupe_greedy(sized.where(~removed), s, "size_kept", hot_rows=hot_rows)
              .withColumn("_unique", F.col("size_kept") & F.col("duplicate_of").isNull()))
    single = _keeper_titles(single, hot_rows)
    tested, centre = _outlier_tests(single, s, "_unique", hot_rows)
    no, text = F.lit(False), F.lit(None).cast("string")
    past = (cands.where(out).withColumns({"set_aside": no, "size_kept": no})
            .unionByName(sized.where(removed).drop("strategy", "anchor")))
    sizes = past.groupBy(*PRODUCT).agg(F.count(F.lit(1)).alias("_rows"))
    if rejected is not None:
        past = past.unionByName(rejected[0].select(*had).withColumn("reason", F.col("reason") if "reason" in had else text).withColumns({"set_aside": no, "size_kept": no}))
        sizes = sizes.unionByName(rejected[1].select(*PRODUCT, "_rows")).groupBy(*PRODUCT).agg(F.sum("_rows").alias("_rows"))
    figures = cut(sizes.join(peers, PRODUCT, "left").join(centre, PRODUCT, "left"), "product_figures")
    past = attach(past, figures, PRODUCT, "_rows", hot_rows=hot_rows, optional=True).drop("_rows").withColumns({
        "strategy": F.when(F.col("product_code").isNotNull(), F.coalesce("strategy", F.lit("NO SIZE DATA"))), "duplicate_of": text,
        "_unique": no, "_of": text, "off_band": no, "mad_z": F.lit(None).cast("double"), "off_mad": no})
    tested = _size_text(tested.unionByName(past), s)
    u, med = F.col("price_per_kg"), F.col("median_price")
    against = F.concat(F.lit("$"), fixed(u), F.lit("/kg vs median $"), fixed(med), F.lit("/kg "))
    why = (F.when(F.col("status") == "REJECTED", F.col("reason"))
           .when(F.col("status") == "DUPLICATE", F.concat(
               F.lit("NEAR-DUPLICATE REMOVED: overlaps SKU "), "duplicate_of", F.coalesce(F.concat(F.lit(" ("), "_of", F.lit(")")), F.lit(""))))
           .when(F.col("off_band"), F.concat(F.lit("PRICE OUTLIER REMOVED: "), against,
                 F.lit("(hard band $"), fixed(med * s.outlier_low), F.lit("-$"), fixed(med * s.outlier_high), F.lit(")")))
           .when(F.col("off_mad"), F.concat(F.lit("ROBUST PRICE OUTLIER REMOVED: "), against, F.lit("(log-MAD z="), fixed(F.col("mad_z")), F.lit(")")))
           .otherwise(F.coalesce("size_reason", "reason")))
    return (tested.withColumn("status", _status()).withColumn("reason", why).withColumn("reason_code", _code(cands))
            .drop("_unique", "size_reason", "_of"))


def _status() -> Column:
    return (F.when(~F.col("accepted"), "REJECTED").when(~F.col("size_kept"), "SIZE")
            .when(F.col("duplicate_of").isNotNull(), "DUPLICATE")
            .when(F.col("off_band") | F.col("off_mad"), "OUTLIER").otherwise("ACCEPTED"))


def _code(cands: DataFrame) -> Column:
    return F.when(F.col("status").isin("SIZE", "DUPLICATE", "OUTLIER"), F.col("status")).otherwise(
        F.col("reason_code") if "reason_code" in cands.columns else F.when(F.col("status") == "ACCEPTED", "OK"))


def _ends(past: DataFrame, sized: DataFrame, columns: Sequence[str], s: PriceSettings, hot_rows: int) -> DataFrame:
    """`clean_listings` for a caller that wants few columns: `past` was rejected before, `sized` are the others after the size step."""
    wanted = [c for c in past.columns if c in {*PRODUCT, "price_per_kg", "accepted", "reason_code", *columns}]
    read = [c for c in past.columns if c in {*wanted, *PRODUCT_STORE, "sku", "kg", "tokens"}]
    removed = F.coalesce(~F.col("size_kept"), F.lit(False))
    single = dedupe_greedy(sized.where(~removed).select(*read, "size_kept"), s, "size_kept", hot_rows=hot_rows).select(
        *wanted, "size_kept", "duplicate_of", (F.col("size_kept") & F.col("duplicate_of").isNull()).alias("_unique"))
    tested = _outlier_tests(single, s, "_unique", hot_rows)[0].select(*wanted, "size_kept", "duplicate_of", "off_band", "off_mad")
    no = F.lit(False)
    rest = past.select(*wanted, no.alias("size_kept")).unionByName(sized.where(removed).select(*wanted, "size_kept"))
    rows = tested.unionByName(rest.withColumns({"duplicate_of": F.lit(None).cast("string"), "off_band": no, "off_mad": no}))
    return rows.withColumn("status", _status()).withColumn("reason_code", _code(past)).select(*columns)


def cleaning_counts(cleaned: DataFrame) -> DataFrame:
    """Per product and store: rows before cleaning, rows removed by each step, rows kept and rejected."""
    status = F.col("status")
    return cleaned.groupBy(*PRODUCT_STORE).agg(
        F.count_if(status != "REJECTED").alias("raw_accepted"), F.count_if(status == "SIZE").alias("size_removed"),
        F.count_if(status == "DUPLICATE").alias("duplicates"), F.count_if(status == "OUTLIER").alias("outliers"),
        F.count_if(status == "ACCEPTED").alias("accepted"), F.count_if(status != "ACCEPTED").alias("rejected"))


def reason_breakdown(cleaned: DataFrame) -> DataFrame:
    """How many listings and products end in each status (products are counted once, however many rows they have)."""
    per_product = cleaned.groupBy("status", *PRODUCT).agg(F.count(F.lit(1)).alias("n"))
    return per_product.groupBy("status").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("products"))
