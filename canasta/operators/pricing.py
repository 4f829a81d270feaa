"""From clean listings to one market price per kg and one estimate per product."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canasta.functions.money import fixed
from canasta.operators.cleaning import PRODUCT, PRODUCT_STORE
from canasta.operators.skew import HOT_ROWS, cut, exact_quantiles
from canasta.settings import PriceSettings


def percentile_linear(df: DataFrame, keys: list[str], value: str, q: float, name: str = "percentile",
                      hot_rows: int = HOT_ROWS) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: q}, hot_rows=hot_rows).select(*keys, name)


def price_level(df: DataFrame, keys: list[str], settings: PriceSettings = PriceSettings(), hot_rows: int = HOT_ROWS) -> DataFrame:
    """One price per key at the chosen level: the median, the economy percentile, otherwise the mean."""
    level = settings.price_level.lower()
    if level in ("median", "economy"):
        q = 0.5 if level == "median" else settings.economy_percentile
        return percentile_linear(df, keys, "price_per_kg", q, "level_price", hot_rows)
    return df.where("price_per_kg is not null").groupBy(*keys).agg(F.avg("price_per_kg").alias("level_price"))


# Prices of a key that are summed one after the other in an ordered mean.
STRETCH = 1_000_000


def ordered_means(clean: DataFrame, keys: list[str], stretch: int = STRETCH) -> DataFrame:
    """`average` and `n` of price_per_kg per key, summed in the order of `file` and `row`: the last bit, and so the text of an average that lies half
    way between two cents, does not depend on how the rows were dealt over tasks. Only a key with more than `stretch` prices is summed by stretches of
    as many rows of a file, whose sums are added in their order; a task holds at most `stretch` prices of a key at once."""
    rows = clean.where(F.col("price_per_kg").isNotNull()).select(*keys, "file", "row", F.col("price_per_kg").alias("u"))
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > stretch).select(*keys, F.lit(True).alias("_large"))
    total = lambda prices: F.aggregate(prices, F.lit(0.0), lambda s, x: s + x)
    prices = F.transform(F.array_sort(F.collect_list(F.struct("row", "u"))), lambda x: x["u"])
    parts = (rows.join(F.broadcast(large), keys, "left").groupBy(*keys, "file", "_large", F.when(F.col("_large"), F.floor(F.col("row") / stretch)).alias("part"))
             .agg(prices.alias("u"), F.count(F.lit(1)).alias("n")).withColumn("u", F.when(F.col("_large"), F.array(total(F.col("u")))).otherwise(F.col("u"))))
    in_order = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("file", "part", "u"))), lambda x: x["u"]))
    return parts.groupBy(*keys).agg(total(in_order).alias("_sum"), F.sum("n").alias("n")).select(*keys, (F.col("_sum") / F.col("n")).alias("average"), "n")


def store_stats(clean: DataFrame, settings: PriceSettings = PriceSettings(), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mean, median, economy price and number of listings per product and store. Means of listings with `file` and `row` are `ordered_means`."""
    middle = exact_quantiles(clean, PRODUCT_STORE, "price_per_kg",
                             {"median": 0.5, "economy": settings.economy_percentile}, hot_rows=hot_rows)
    means = (ordered_means(clean, PRODUCT_STORE) if {"file", "row"} <= set(clean.columns) else clean.where("price_per_kg is not null")
             .groupBy(*PRODUCT_STORE).agg(F.avg("price_per_kg").alias("average"), F.count(F.lit(1)).alias("n")))
    return means.join(middle.drop("n", "distinct_n"), PRODUCT_STORE)


def store_balanced(stats: DataFrame, settings: PriceSettings = PriceSettings()) -> DataFrame:
    """Stores combined with the weight min(listings, cap); `market` follows the price level."""
    weight = F.least(F.col("n"), F.lit(max(1, settings.store_weight_cap)))

    def balanced(c: str) -> Column:
        return F.sum(F.col(c) * weight) / F.sum(weight)

    chosen = {"average": "average", "economy": "economy"}.get(settings.price_level.lower(), "median")
    return stats.groupBy(*PRODUCT).agg(balanced("average").alias("average"), balanced("economy").alias("economy"),
                                       balanced(chosen).alias("market"), F.count(F.lit(1)).alias("store_count"),
                                       F.sum("n").alias("n"))


def all_candidates(clean: DataFrame, settings: PriceSettings = PriceSettings(), hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same three figures over all listings of a product together."""
    middle = exact_quantiles(clean, PRODUCT, "price_per_kg", {"median": 0.5, "economy": settings.economy_percentile}, hot_rows=hot_rows)
    means = (clean.where("price_per_kg is not null").groupBy(*PRODUCT)
             .agg(F.avg("price_per_kg").alias("average"), F.count(F.lit(1)).alias("n")))
    level = settings.price_level.lower()
    market = F.col(level if level in ("median", "economy") else "average")
    return means.join(middle.drop("n", "distinct_n"), PRODUCT).select(*PRODUCT, "average", "economy", market.alias("market"), "n")


def spread_stats(clean: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Median, extremes, max/min, population CV and the spread ratio of each product's prices.

    The spread ratio is max/min below five positive prices, else the 90th over the 10th percentile.
    """
    u = F.col("price_per_kg")
    middle = exact_quantiles(clean, PRODUCT, "price_per_kg", {"median": 0.5}, hot_rows=hot_rows).select(*PRODUCT, "median")
    tails = (exact_quantiles(clean.where(u > 0), PRODUCT, "price_per_kg", {"_p10": 0.10, "_p90": 0.90}, hot_rows=hot_rows)
             .select(*PRODUCT, F.col("n").alias("_pos"), "_p10", "_p90"))
    base = clean.where(u.isNotNull()).groupBy(*PRODUCT).agg(
        F.min(u).alias("min"), F.max(u).alias("max"), F.avg(u).alias("_mean"), F.stddev_pop(u).alias("_sd"),
        F.count(F.lit(1)).alias("n"), F.min(F.when(u > 0, u)).alias("_min_pos"))
    spread = (F.when(F.col("_pos").isNull(), F.lit(0.0)).when(F.col("_pos") < 5, F.col("max") / F.col("_min_pos"))
              .otherwise(F.col("_p90") / F.col("_p10")))
    ratio = F.when(F.col("min") > 0, F.col("max") / F.col("min")).otherwise(F.lit(float("inf")))
    cv = F.when((F.col("n") > 1) & (F.col("_mean") != 0), F.try_divide("_sd", "_mean")).otherwise(F.lit(0.0))
    return (base.join(middle, PRODUCT).join(tails, PRODUCT, "left")
            .select(*PRODUCT, "n", "median", "min", "max", ratio.alias("ratio"), cv.alias("cv"), spread.alias("spread")))


def estimate_price(market: Column, kg: Column, settings: PriceSettings = PriceSettings()) -> Column:
    return market * kg * F.lit(settings.market_percent)


def min_max_estimate(low: Column, high: Column, kg: Column, settings: PriceSettings = PriceSettings()) -> Column:
    usable = kg.isNotNull() & (kg != 0) & low.isNotNull() & high.isNotNull()
    return F.struct(F.when(usable, estimate_price(low, kg, settings)).alias("low"),
                    F.when(usable, estimate_price(high, kg, settings)).alias("high"))


def market_per_kg(estimate: Column, kg: Column, percent: Column) -> Column:
    return F.try_divide(estimate, kg * percent)


def store_averages_text(stats: DataFrame, stores: list) -> DataFrame:
    """`store=$x/kg (n=k)` in the order of `stores` (the configured list bounds each group)."""
    place = F.array_position(F.array(*[F.lit(x) for x in stores]), F.col("store"))
    text = F.concat(F.col("store").cast("string"), F.lit("=$"), fixed(F.col("average")), F.lit("/kg (n="), F.col("n").cast("string"), F.lit(")"))
    return (stats.where(place > 0).groupBy(*PRODUCT)
            .agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), text.alias("t"), F.col("store").cast("string").alias("s")))).alias("l"))
            .select(*PRODUCT, F.array_join(F.transform("l", lambda e: e["t"]), " | ").alias("store_averages"),
                    F.array_join(F.transform("l", lambda e: e["s"]), ", ").alias("stores_used"),
                    F.size("l").cast("long").alias("store_count")))


def parse_store_counts(df: DataFrame, text: str = "store_averages") -> DataFrame:
    """One row per store read back from the text of `store_averages_text`."""
    pattern = F.lit(r"([^|=]+)=.*?\(n=(\d+)\)")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("s"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("n"))
    return (df.select(*PRODUCT, F.explode(pairs).alias("e"))
            .select(*PRODUCT, F.trim("e.s").alias("store"), F.col("e.n").cast("long").alias("n")))


def market_levels(clean: DataFrame, settings: PriceSettings = PriceSettings(), balanced: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Market price of each product in the store-balanced or pooled mode: average, economy, market, store_count."""
    if balanced:
        return store_balanced(store_stats(clean, settings, hot_rows), settings).drop("n")
    stores = clean.where("price_per_kg is not null").groupBy(*PRODUCT_STORE).count().groupBy(*PRODUCT).agg(F.count(F.lit(1)).alias("store_count"))
    return all_candidates(clean, settings, hot_rows).drop("n").join(stores, PRODUCT)


def estimates(clean: DataFrame, settings: PriceSettings = PriceSettings(), balanced: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`market_levels` with the spread of the prices."""
    return market_levels(clean, settings, balanced, hot_rows).join(spread_stats(clean, hot_rows), PRODUCT)


# Listings of a product whose prices may lie in one row; products with more are ranked by `exact_quantiles`.
LIST_ROWS = 50_000


def large_products(listings: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame | None:
    """Products with more than `list_rows` listings, None if there are none. One pass over the listings, which is run at once."""
    sizes = listings.groupBy(*PRODUCT).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0]
    return cut(sizes.where(F.col("_n") > list_rows).select(*PRODUCT), "large") if most is not None and most > list_rows else None


def listing_figures(rows: DataFrame, large: DataFrame | None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Everything that the listings of a product say about its price, in one shuffle.

    `rows`: product_code, store, price_per_kg (NULL: the listing is counted only), optionally `_q` (the economy percentile, one per product; the
    settings' otherwise) and `unpriced` (boolean). `large` names the products with more than `LIST_ROWS` rows. Output per product: listings, unpriced,
    n (prices), stores (array of store, n, average, median, economy in order of store), average, median, economy and the columns of `spread_stats`.
    """
    rows = rows.select(*PRODUCT_STORE, "price_per_kg", (F.col("_q") if "_q" in rows.columns else F.lit(PriceSettings().economy_percentile)).cast("double").alias("_q"),
                       (F.col("unpriced") if "unpriced" in rows.columns else F.lit(False)).alias("unpriced"))
    if large is None:
        return _listed_figures(rows)
    return _listed_figures(rows.join(large, PRODUCT, "left_anti")).unionByName(_ranked_figures(cut(rows.join(large, PRODUCT, "left_semi"), "large_rows"), hot_rows))


def _between(prices: Column, n: Column, q: Column, first: Column | int = 0) -> Column:
    """Linear-interpolated quantile of the `n` sorted prices from index `first` on; NULL without any."""
    place = (n - 1) * F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0))
    low, high = (F.get(prices, (first + f(place)).cast("int")) for f in (F.floor, F.ceil))
    return F.when(n > 0, low + (high - low) * (place - F.floor(place)))


def _listed_figures(rows: DataFrame) -> DataFrame:
    u, n, q, prices = F.col("price_per_kg"), F.col("n"), F.col("_q"), F.col("prices")
    by_store = (rows.repartition(*PRODUCT).groupBy(*PRODUCT, "_q", "store")
                .agg(F.count(F.lit(1)).alias("listings"), F.count_if("unpriced").alias("unpriced"), F.count(u).alias("n"), F.count_if(u > 0).alias("pos"),
                     F.avg(u).alias("average"), F.var_pop(u).alias("var"), F.sort_array(F.collect_list(u)).alias("prices")))
    store = F.struct("store", "n", "average", _between(prices, n, F.lit(0.5)).alias("median"), _between(prices, n, q).alias("economy"), "var")
    one = by_store.groupBy(*PRODUCT, "_q").agg(
        F.sum("listings").alias("listings"), F.sum("unpriced").alias("unpriced"), F.sum("n").alias("n"), F.sum("pos").alias("pos"),
        F.sort_array(F.collect_list(F.when(n > 0, store))).alias("stores"), F.sort_array(F.flatten(F.collect_list("prices"))).alias("prices"))
    total = lambda f: F.aggregate("stores", F.lit(0.0), lambda s, x: s + x["n"] * f(x))
    one = one.withColumn("average", F.when(n > 0, total(lambda x: x["average"]) / n))
    off = total(lambda x: x["var"] + (x["average"] - F.col("average")) * (x["average"] - F.col("average")))
    low, high, pos = F.get(prices, F.lit(0)), F.get(prices, (n - 1).cast("int")), F.col("pos")
    above = lambda p: _between(prices, pos, F.lit(p), n - pos)
    spread = F.when(pos == 0, 0.0).when(pos < 5, high / F.get(prices, (n - pos).cast("int"))).otherwise(above(0.9) / above(0.1))
    return one.select(
        *PRODUCT, "listings", "unpriced", "n", F.transform("stores", lambda x: F.struct(x["store"].alias("store"), x["n"].alias("n"), x["average"].alias("average"),
                                                                                     x["median"].alias("median"), x["economy"].alias("economy"))).alias("stores"),
        "average", _between(prices, n, F.lit(0.5)).alias("median"), _between(prices, n, q).alias("economy"), low.alias("min"), high.alias("max"),
        F.when(low > 0, high / low).when(n > 0, F.lit(float("inf"))).alias("ratio"),
        F.when((n > 1) & (F.col("average") != 0), F.try_divide(F.sqrt(off / n), F.col("average"))).when(n > 0, 0.0).alias("cv"), F.when(n > 0, spread).alias("spread"))


def _ranked_figures(rows: DataFrame, hot_rows: int) -> DataFrame:
    def figures(keys: list[str]) -> DataFrame:
        middle = exact_quantiles(rows, [*keys, "_q"], "price_per_kg", {"median": 0.5, "economy": "_q"}, hot_rows=hot_rows).select(*keys, "median", "economy")
        means = rows.where("price_per_kg is not null").groupBy(*keys).agg(F.avg("price_per_kg").alias("average"), F.count(F.lit(1)).alias("n"))
        return means.join(middle, keys)

    stores = figures(PRODUCT_STORE).groupBy(*PRODUCT).agg(F.sort_array(F.collect_list(F.struct("store", "n", "average", "median", "economy"))).alias("stores"))
    spread = spread_stats(rows, hot_rows).select(*PRODUCT, "min", "max", "ratio", "cv", "spread")
    counts = rows.groupBy(*PRODUCT).agg(F.count(F.lit(1)).alias("listings"), F.count_if("unpriced").alias("unpriced"))
    out = counts.join(figures(PRODUCT), PRODUCT, "left").join(stores, PRODUCT, "left").join(spread, PRODUCT, "left")
    empty = F.array().cast(stores.schema["stores"].dataType)
    return out.select(*PRODUCT, "listings", "unpriced", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("stores", empty).alias("stores"),
                      "average", "median", "economy", "min", "max", "ratio", "cv", "spread")


def capped(stores: Column, cap: Column | int) -> Column:
    """Listings of all stores, each store's at most `cap`."""
    return F.aggregate(stores, F.lit(0).cast("long"), lambda s, x: s + F.least(x["n"], (F.lit(cap) if isinstance(cap, int) else cap).cast("long")))


def balanced(stores: Column, value: Callable[[Column], Column], cap: Column | int) -> Column:
    """`store_balanced` of one product's stores: the mean of a figure with the weight min(listings, cap)."""
    cap = F.greatest(F.lit(1), F.lit(cap) if isinstance(cap, int) else cap).cast("long")
    return F.aggregate(stores, F.lit(0.0), lambda s, x: s + value(x) * F.least(x["n"], cap)) / F.when(F.size(stores) > 0, capped(stores, cap))


def at_level(figures: Column | None, level: Column | str, other: str) -> Column:
    """The figure that a price level asks for, of a struct or (None) of the row; levels without a name take `other`."""
    level = F.lower(F.lit(level) if isinstance(level, str) else level)
    of = (lambda c: F.col(c)) if figures is None else (lambda c: figures[c])
    out = of(other)
    for name in ("median", "average", "economy"):
        if name != other:
            out = F.when(level == name, of(name)).otherwise(out)
    return out


def estimates_as_stored(figures: DataFrame) -> DataFrame:
    """`figures` (`listing_figures`, which has ranked the stored percentile) of products that were priced with settings of their own: store_weight_cap,
    price_level and average_mode are columns. `average` and `economy` become those of the mode, `market` is added."""
    level, stores, cap = F.col("price_level"), F.col("stores"), F.col("store_weight_cap")
    together = F.col("average_mode") == "all_candidates"
    by_store = lambda value: balanced(stores, value, cap)
    return figures.withColumns({
        "market": F.when(together, at_level(None, level, "average")).otherwise(by_store(lambda x: at_level(x, level, "median"))),
        "average": F.when(together, F.col("average")).otherwise(by_store(lambda x: x["average"])),
        "economy": F.when(together, F.col("economy")).otherwise(by_store(lambda x: x["economy"]))})


def manual_average(df: DataFrame, keys: list[str], text: str = "typed") -> DataFrame:
    """Average of typed store prices: blanks are ignored and one invalid entry blocks the product."""
    value = F.regexp_replace(F.trim(text), ",", ".").try_cast("decimal(18,6)")   # exact sums in any row order
    filled = F.coalesce(F.trim(text) != "", F.lit(False))
    valid = F.coalesce(F.round(value, 2) > 0, F.lit(False))
    return df.groupBy(*keys).agg(
        F.count_if(filled & valid).alias("stores"), F.coalesce(F.bool_or(filled & ~valid), F.lit(False)).alias("blocked"),
        F.avg(F.when(filled & valid, value)).alias("_a")).select(
        *keys, "stores", "blocked", F.when(~F.col("blocked"), F.round("_a", 2).cast("double")).alias("average"))


def dashboard_kpis(summary: DataFrame, audit: DataFrame) -> DataFrame:
    """Processed products, with price, with two stores, without alerts, listings checked; shares of the first."""
    s = summary.agg(F.count(F.lit(1)).alias("total"), F.count("estimate").alias("priced"),
                    F.count_if(F.coalesce("store_count", F.lit(0)) >= 2).alias("multi"), F.count_if(F.col("quality") == "OK").alias("ok"))

    def row(name: str, col: str) -> Column:
        return F.struct(F.lit(name).alias("indicator"), F.col(col).alias("quantity"), F.try_divide(F.col(col), F.col("total")).alias("share"))

    shares = s.select(F.inline(F.array(row("products", "total"), row("with_price", "priced"), row("two_stores", "multi"), row("no_alerts", "ok"))))
    checked = audit.agg(F.count(F.lit(1)).alias("quantity"))
    return shares.unionByName(checked.select(F.lit("listings").alias("indicator"), "quantity", F.lit(None).cast("double").alias("share")))


def run_summary(summary: DataFrame) -> DataFrame:
    return (summary.agg(F.count(F.lit(1)).alias("n"), F.count("estimate").alias("est"), F.count_if(F.col("quality") == "OK").alias("ok"),
                        F.count_if(F.coalesce("large_change", F.lit(False))).alias("big_changes"))
            .select("n", "est", "ok", (F.col("est") - F.col("ok")).alias("review"), (F.col("n") - F.col("est")).alias("none"), "big_changes"))
