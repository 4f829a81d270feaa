"""The whole run: catalogue and retail listings in, one priced summary row per product and the full audit out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canasta.functions import quantity as Q
from canasta.operators import candidates, cleaning, flags, identity, pricing
from canasta.operators.cleaning import PRODUCT, PRODUCT_STORE
from canasta.operators.skew import HOT_ROWS, attach, cut, grid_join, spread
from canasta.settings import PriceSettings
from canasta.vocabulary import SPANISH, Vocabulary

AUDIT = ["product_code", "target_name", "store", "sku", "title", "query_rank", "query", "regular_price", "final_price", "price", "chosen_basis",
         "kg", "target_unit_kg", "candidate_unit_kg", "size_ratio", "size_neutral", "price_per_kg", "quantity_source", "accepted", "reason_code",
         "reason", "tokens"]


def match(targets: DataFrame, listings: DataFrame, settings: PriceSettings = PriceSettings(), v: Vocabulary = SPANISH,
          hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(analysed targets, candidates with the verdict of the identity rules). Candidates that a rule on words rejects are a plan over the written
    verdicts of the classes; the others are written to the shared folder.
    """
    t, judged, rejected, *_ = _judge(targets, listings, settings, v, hot_rows)
    return t, judged.unionByName(rejected)


def _judge(targets: DataFrame, listings: DataFrame, settings: PriceSettings, v: Vocabulary,
           hot_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, Callable[[list[str]], DataFrame], DataFrame]:
    """(analysed targets, candidates that the rules on words let pass, those that they reject, how many these are by class and the given columns, the
    products of the classes).

    Names are analysed once per row, before any join. Products whose names and queries agree up to sizes are one class: a class is searched
    and meets the rules on words once per listing, whatever the number of its products. The products then take the verdicts of their class
    and meet the rules on sizes; classes with very many pairs become a grid of tasks. What a rule on words rejects is the same for all
    products of a class: it is not written once per product, and counts of it are taken by class. Listings that only a query of many classes finds
    and that lack a needed word are not even written by class (`shared_search`): they are counted by list of queries, less the written ones.
    """
    t = cut(identity.target_features(spread(targets), v), "targets")
    once = candidates.first_listing(listings, ("store", "sku"), ("title", "regular_price", "final_price", "price"))
    found_in = cut(identity.listing_features(once, v), "listings")
    # A product that repeats with several names asks the queries of all of them.
    asked = (t.select(*PRODUCT, F.posexplode("t_search.queries").alias("query_rank", "query")).groupBy(*PRODUCT)
             .agg(F.array_sort(F.collect_set(F.struct("query_rank", "query"))).alias("asked"), F.count(F.lit(1)).alias("_n")))
    read = identity.WORDS_OF_TARGET
    worded = attach(t, cut(asked, "asked"), PRODUCT, "_n", "inner", hot_rows).drop("_n").withColumn("_words", F.struct("asked", *read))
    classes = worded.groupBy("_words").agg(F.count(F.lit(1)).alias("_n")).withColumn("t_class", F.monotonically_increasing_id())
    classes = cut(classes, "classes")
    members = attach(worded, classes, ["_words"], "_n", "inner", hot_rows)
    members = cut(members.select(*PRODUCT, "t_class", "name", "weight_kg", "t_all", "t_head", "t_family", "t_size", "t_count", "t_dims", "t_kind", "t_basis"), "members")
    of_class = classes.select("t_class", F.col("_n").alias("_members"), *[F.col(f"_words.{c}").alias(c) for c in read])
    own, found, shared = candidates.shared_search(classes.select("t_class", F.inline("_words.asked")), of_class.select("t_class", identity.needed_words(v).alias("need")),
                                                  found_in, "t_class", hot_rows)
    sizes = found.groupBy("t_class").agg(F.count(F.lit(1)).alias("_n"))
    # Written, so that Spark knows its size: a small table of classes is broadcast and no pair is shuffled with its features.
    wanted = cut(of_class.join(own, "t_class").join(sizes, "t_class", "left").withColumn("_n", F.coalesce("_n", F.lit(0))), "wanted")
    pairs = attach(grid_join(found, found_in, ["store", "sku"], hot_rows), wanted, ["t_class"], "_n", "inner", hot_rows)
    first = lambda queries: F.get(queries, F.lit(0))
    pairs = pairs.withColumns({"_hit": first(candidates.matching()), "shared_rank": first(candidates.matching(lambda a: a["shared"]))["query_rank"]})
    listed = [c for c in found_in.columns if not c.startswith("l_") and c != "attrs"]
    sized = ["l_ordered", "l_size", "l_dims", "l_kind", "l_mass", "l_count"]
    verdicts = cut(identity.word_verdicts(pairs, v).select("t_class", "_hit.query_rank", "_hit.query", "shared_rank", *listed, *sized, "w_first", "w_last"), "verdicts")
    page = ["page"] if "page" in listings.columns else []

    def judged_as(rows: DataFrame, judge) -> DataFrame:
        rows = judge(rows, settings, v)
        return rows.withColumns({"target_name": F.col("name"), "tokens": F.col("l_ordered")}).select(*AUDIT, *page)

    def of_products(part: DataFrame) -> DataFrame:
        # The verdicts are few and may lie in one file, their products are many.
        return grid_join(spread(part.drop("shared_rank")), members, ["t_class"], hot_rows)

    def unwritten() -> DataFrame:
        """What a shared query finds for a class and `found` does not have. Products ride in rows of some 200 of a class, so no pair is shuffled."""
        group = F.pmod(F.xxhash64(*PRODUCT), F.ceil(F.col("_members") / 200)).alias("_group")
        own_columns = [c for c in members.columns if c != "t_class"]
        groups = (members.join(classes.select("t_class", F.col("_n").alias("_members")), "t_class")
                  .groupBy("t_class", group).agg(F.collect_list(F.struct(*[F.col(c).alias(f"_{c}") for c in own_columns])).alias("_products")))
        groups = groups.join(wanted.where(F.col("list_id").isNotNull()).drop("_n", "_members"), "t_class")
        load = F.least(F.col("_rows") * F.col("_keys"), F.lit(64 * PAIRS))
        loads = shared.groupBy("list_id").agg(F.count(F.lit(1)).alias("_rows")).join(own.groupBy("list_id").agg(F.count(F.lit(1)).alias("_keys")), "list_id")
        tasks = 4 * members.sparkSession.sparkContext.defaultParallelism
        rows = shared.join(found_in, ["store", "sku"]).repartition(tasks)
        rows = attach(rows, groups.join(loads.select("list_id", load.alias("_load")), "list_id").repartition(tasks), ["list_id"], "_load", "inner", PAIRS)
        rows = rows.where(~candidates.holds("need") & (F.size(candidates.matching(lambda a: ~a["shared"])) == 0))
        rows = identity.refused_without_needed(rows, v).select(*listed, *sized, "query_rank", "query", "w_first", F.explode("_products").alias("_product"))
        return rows.select(*rows.columns[:-1], *[F.col(f"_product._{c}").alias(c) for c in own_columns])

    def refused(keys: list[str]) -> DataFrame:
        rows = F.count(F.lit(1)).alias("_rows")
        by_list = shared.join(found_in.select("store", "sku", *page), ["store", "sku"]) if page else shared
        by_list = by_list.groupBy("list_id", *keys).agg(rows).join(own.select("t_class", "list_id"), "list_id")
        written = verdicts.where(F.col("shared_rank").isNotNull()).withColumn("query_rank", F.col("shared_rank")).groupBy("t_class", *keys).agg(rows)
        counts = verdicts.where(F.col("w_first").isNotNull()).groupBy("t_class", *keys).agg(rows)
        counts = counts.unionByName(by_list.select("t_class", *keys, "_rows")).unionByName(written.withColumn("_rows", -F.col("_rows")))
        return counts.groupBy("t_class", *keys).agg(F.sum("_rows").alias("_rows")).where(F.col("_rows") > 0)

    judged = cut(judged_as(of_products(verdicts.where(F.col("w_first").isNull())), identity.apply_to_worded), "candidates")
    rejected = judged_as(of_products(verdicts.where(F.col("w_first").isNotNull())), identity.refused_by_words)
    return t, judged, rejected.unionByName(judged_as(unwritten(), identity.refused_by_words)), refused, members.select(*PRODUCT, "t_class")


# Pairs of a class and a listing that one task meets when the rejected candidates are read.
PAIRS = 2_000_000


def _by_product(counts: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """(product_code, keys, _rows): how many rejected candidates each product has, from the counts of its class."""
    return counts.join(members, "t_class").groupBy(*PRODUCT, *keys).agg(F.sum("_rows").alias("_rows"))


def price_run(targets: DataFrame, listings: DataFrame, stores: list, settings: PriceSettings = PriceSettings(), v: Vocabulary = SPANISH,
              balanced: bool = True, hot_rows: int = HOT_ROWS, first_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, audit). `targets`: product_code, name, weight_kg, context. `listings`: store, sku, title, attrs, regular_price,
    final_price, price, price_basis; of rows that repeat (store, sku) the first by title and prices counts, and
    rows without a sku are left out. Every candidate stays in the audit with a status and a reason.

    With `first_pages`, listings have a `page` and the search stops as `deep_search` says: a store's pages are read query by query until the evidence
    suffices, those after the first ones only where too few good matches were found. Candidates on pages that are not read are no candidates.
    """
    s = settings
    t, judged, rejected, refused, members = _judge(targets, listings, s, v, hot_rows)
    if first_pages is None:
        sizes = _by_product(refused([]), members, [])
    else:
        page = ["store", *candidates.PAGE]
        by_page = cut(_by_product(refused(page), members, page), "refused_pages")
        counts = candidates.page_counts(judged, s).unionByName(by_page.withColumns({c: F.lit(0).cast("long") for c in ("close", "good")}))
        counts = counts.groupBy(*PRODUCT, *page).agg(*[F.sum(c).alias(c) for c in ("close", "good", "_rows")])
        read = candidates.pages_read(counts, first_pages, s)
        judged, rejected = cut(candidates.on_pages(judged, read, hot_rows), "read"), candidates.on_pages(rejected, read, hot_rows)
        sizes = by_page.join(read.select(*PRODUCT, *page), [*PRODUCT, *page]).groupBy(*PRODUCT).agg(F.sum("_rows").alias("_rows"))
    sizes = cut(sizes, "refused")
    # Not written: the steps in it are, and a reader computes rejected candidates only if it asks for them.
    audit = cleaning.clean_listings(judged, s, hot_rows, (rejected, sizes))
    clean = cut(audit.where(F.col("status") == "ACCEPTED").select(*PRODUCT_STORE, "price_per_kg"), "clean")
    past = judged.where(~F.col("accepted")).groupBy(*PRODUCT).agg(F.count(F.lit(1)).alias("_rows")).unionByName(sizes)
    past = past.groupBy(*PRODUCT).agg(F.sum("_rows").alias("rejected"))
    names = ["raw_accepted", "size_removed", "duplicates", "outliers", "accepted", "rejected"]
    counts = cleaning.cleaning_counts(audit.where(F.col("status") != "REJECTED")).select(*PRODUCT, *names)
    counts = counts.unionByName(past.select(*PRODUCT, *[F.lit(0).cast("long").alias(c) for c in names[:-1]], "rejected"))
    counts = counts.groupBy(*PRODUCT).agg(*[F.sum(c).alias(c) for c in names])
    market = pricing.estimates(clean, s, balanced, hot_rows).drop("n")
    texts = pricing.store_averages_text(pricing.store_stats(clean, s, hot_rows), stores).drop("store_count")
    rows = t
    for part in (counts, market, texts):
        rows = rows.join(part, PRODUCT, "left")
    zero = ["raw_accepted", "size_removed", "duplicates", "outliers", "accepted", "rejected", "store_count"]
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero}).withColumns({
        "target_kg": F.col("t_qty.kg"), "target_source": F.col("t_qty.source"), "confidence": F.col("t_search.confidence"),
        "size_text": Q.quantity_warning(F.col("t_basis"), F.col("t_size.total_kg"), F.col("weight_kg"), s)})
    quality = flags.quality_flags(F.col("accepted"), F.col("store_count"), F.col("confidence"), len(stores), F.col("size_text.warning"), F.lit(""), s)
    notes = flags.joined([flags.spread_note(F.col("spread"), F.col("ratio"), F.col("cv"), F.col("t_variety"), s), F.col("size_text.note")])
    summary = rows.select(
        *PRODUCT, "name", F.array_join("t_search.queries", " | ").alias("queries"), "confidence", F.col("t_search.warning").alias("search_warning"),
        F.array_join("t_mods", ", ").alias("modifiers"), "stores_used", "store_count", F.lit("store_balanced" if balanced else "all_candidates").alias("average_mode"),
        "store_averages", "raw_accepted", "size_removed", "duplicates", "outliers", F.col("accepted").alias("n"), "rejected", "target_kg", "target_source",
        "average", "median", "economy", F.lit(s.price_level).alias("price_level"), pricing.estimate_price(F.col("market"), F.col("target_kg"), s).alias("estimate"),
        "min", "max", "ratio", "cv", F.lit(s.price_basis).alias("price_basis"), quality.alias("quality"), F.lit("").alias("request_error"), notes.alias("notes"),
        F.lit(s.market_percent).alias("market_percent"), F.lit(s.store_weight_cap).alias("store_weight_cap"), F.lit(s.economy_percentile).alias("economy_percentile"))
    return summary, audit
