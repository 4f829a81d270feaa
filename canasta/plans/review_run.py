"""From the output of a price run to the review list, the decisions and the export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canasta.operators import flags, review
from canasta.operators.cleaning import PRODUCT, PRODUCT_STORE
from canasta.settings import PriceSettings, ReviewPolicy
from canasta.sources import tables


def review_items(summary: DataFrame, audit: DataFrame, current: DataFrame, settings: PriceSettings = PriceSettings(), policy: ReviewPolicy = ReviewPolicy()) -> DataFrame:
    """The review list of a run: every summary row with its comparison, support, flags, score, points, notes and group of matches.

    `summary` and `audit` are what `price_run` returns, `current` has product_code, current_price and id. The support counts accepted listings,
    each store capped by the policy. Products without current price or id stay in the list.
    """
    accepted = audit.where(F.col("status") == "ACCEPTED").groupBy(*PRODUCT_STORE).agg(F.count(F.lit(1)).alias("n"))
    rows = flags.compare_current(summary, current, settings).join(review.store_support(accepted, policy), PRODUCT, "left")
    rows = review.graded(rows.withColumn("support", F.coalesce("support", F.lit(0))), settings, policy)
    notes = review.review_notes(F.col("n"), F.col("store_count"), F.col("estimate"), F.col("current_price"), F.col("quality"), F.col("confidence"),
                                F.col("request_error"), F.col("cv"), F.col("id"), settings)
    return rows.withColumns({"review_notes": notes, "match_group": review.match_group(F.col("queries"))})


def approved_lines(items: DataFrame, log: DataFrame, include_unchanged: bool = False) -> DataFrame:
    """The export lines of the decisions that a log leaves, or `tables.ExportStopped`."""
    return tables.export_lines(review.current_state(log, items), include_unchanged)
