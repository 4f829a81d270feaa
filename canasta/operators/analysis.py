"""The performance analysis: every product with its own columns, its result and the comparison with the current price."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canasta.operators import flags
from canasta.settings import PriceSettings

# Catalogue columns that a result repeats under a name of its own.
REPEATED = ("code", "name", "erp")


def performance_analysis(products: DataFrame, summary: DataFrame, current: DataFrame, settings: PriceSettings = PriceSettings(),
                         store_names: dict[str, str] | None = None, owner: str = "") -> DataFrame:
    """One row per catalogue row that has a result: the catalogue's own columns, all result columns, the comparison and needs_review.

    `products` is `scan_catalog` output (its `original` struct holds the file's columns, `source` the names of the fields found there). Rows meet by
    the column `row` where both tables have it, else by product_code. Columns that repeat the code, the name or the ERP id are left out; a
    catalogue column named like a result column gets the ending " (product)".
    """
    keys = ["row"] if "row" in products.columns and "row" in summary.columns else ["product_code"]
    compared = flags.compare_current(summary, current, settings)
    shown = flags.display_values(compared, store_names, owner=owner).withColumn("needs_review", F.when(F.col("quality") == "OK", "NO").otherwise("YES"))
    known = {f.name: f.metadata.get("field") for f in products.schema["original"].dataType.fields}
    own = [name for name, field in known.items() if field not in REPEATED]
    named = {name: f"{name} (product)" if name in shown.columns else name for name in own}
    rows = products.select(*keys, *[F.col("original")[name].alias(shown_as) for name, shown_as in named.items()])
    return rows.join(shown, keys).select(*named.values(), *shown.columns)
