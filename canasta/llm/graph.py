"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canasta.operators.skew import cut, discard


FEW_LINKS = 200_000         # links that are handled in one partition, as Spark would coalesce so small a table by itself


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another one; root is the component's smallest node.

    Each round links every node to the smallest node it knows, first among its larger neighbours and then among its smaller ones,
    and writes the shorter link table to the shared folder. A node's neighbours meet only as a minimum, which Spark combines before the
    shuffle, and as rows of a join whose large keys it splits; no group of neighbours is gathered. Rounds grow with the
    logarithm of the longest path. Links with a null end are left out.
    """
    x, y = F.col(a), F.col(b)
    links = cut(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "links")
    mark = None
    while True:
        seen = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                links.select(F.col("v"), F.col("v")).distinct())
        mark = seen
        own = links.coalesce(1) if seen[0] <= FEW_LINKS else links
        both = own.union(own.select(F.col("v"), F.col("u")))
        both = both.coalesce(1) if seen[0] <= FEW_LINKS else both
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", "m")).where(F.col("u") != F.col("v")).distinct())
        links, old = cut(small, "links"), links
        discard(old)
