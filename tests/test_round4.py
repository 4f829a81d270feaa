"""Findings of round 4: candidates of broad queries."""

from pyspark.sql import functions as F

from canasta.operators import candidates, pricing
from canasta.operators.skew import cut
from canasta.plans import price_run as run
from canasta.settings import PriceSettings
from canasta.sources import fixtures
from canasta.vocabulary import SPANISH

PAGE = ["store", "query_rank", "page"]


def judged(targets, listings, monkeypatch):
    """What `_judge` gives, and the tables that it writes on the way."""
    written = {}

    def kept(df, name="step", codec=None):
        written[name] = cut(df, name, codec)
        return written[name]

    monkeypatch.setattr(run, "cut", kept)
    return run._judge(targets, listings, PriceSettings(), SPANISH, 1000), written


def test_listings_that_a_broad_query_finds_are_not_written_per_class(spark, monkeypatch):
    blank = {c: F.lit("") for c in ("line", "family", "description", "grp", "category")}
    context = F.struct(*[c.alias(k) for k, c in blank.items()])
    none = F.lit(None)
    rows = {}
    for series in (8, 16):
        targets = spark.range(series).select(F.col("id").alias("product_code"), F.concat(F.lit("Leche entera serie"), "id").alias("name"), F.lit(1.0).alias("weight_kg"), context.alias("context"))
        listings = spark.range(30 * series).select(
            (F.col("id") % 4).alias("store"), F.col("id").cast("string").alias("sku"), F.concat(F.lit("Leche entera serie"), F.col("id") % series, F.lit(" 1kg")).alias("title"),
            F.create_map().cast("map<string,string>").alias("attrs"), F.lit(1.0).alias("regular_price"), *[none.cast("double").alias(c) for c in ("final_price", "price")], none.cast("string").alias("price_basis"))
        (_, passed, rejected, refused, _), written = judged(targets, listings, monkeypatch)
        rows[series] = written["verdicts"].count()
        assert passed.count() == 30 * series and rejected.count() == 30 * series * (series - 1)          # each product finds every listing
        assert {r._rows for r in refused([]).collect()} == {30 * (series - 1)}
    assert rows == {8: 240, 16: 480}


def test_sharing_queries_changes_no_candidate(spark, folder, monkeypatch):
    targets, listings = fixtures.catalog(spark, folder), fixtures.retail(spark, folder)
    # one more word, which the shorter queries of a name do not ask for
    targets = targets.withColumn("name", F.concat("name", F.lit(" zeta"), F.col("product_code") % 3))
    listings = listings.withColumns({"page": F.col("sku").cast("int") % 3 + 1, "title": F.concat("title", F.lit(" zeta"), F.col("sku").cast("int") % 3)})
    found = []
    for keys, rows in ((0, 0), (2, 5), (10**9, 10**9)):        # every query shared, some, none
        monkeypatch.setattr(candidates, "SHARED_KEYS", keys)
        monkeypatch.setattr(candidates, "SHARED_ROWS", rows)
        (_, passed, rejected, refused, members), written = judged(targets, listings, monkeypatch)
        counts = [sorted(map(tuple, run._by_product(refused(k), members, k).collect())) for k in ([], PAGE)]
        seen = rejected.groupBy("product_code", *PAGE).count().collect()
        assert sorted(map(tuple, seen)) == sorted((p, *rest) for p, *rest in counts[1])
        found.append((sorted(map(str, passed.collect())), sorted(map(str, rejected.collect())), counts, written["verdicts"].count()))
    assert found[0][:3] == found[1][:3] == found[2][:3] and len(found[0][1]) > 500
    assert found[0][3] <= found[1][3] < found[2][3]


def test_averages_of_few_prices_are_summed_in_order_wherever_they_stand(spark):
    prices = [0.1, 1e16, 0.3, -1e16, 0.7]
    places = [("a", 999_998), ("a", 999_999), ("a", 1_000_000), ("b", 5), ("b", 2_000_000)]
    rows = spark.createDataFrame([(1, 2, p, *x) for p, x in zip(prices, places)], "product_code long, store long, price_per_kg double, file string, row long")
    want = 0.0
    for p in prices:
        want += p
    assert [(r.average, r.n) for r in pricing.store_stats(rows.repartition(3)).collect()] == [(want / 5, 5)]
    by_stretch = pricing.ordered_means(rows, ["product_code"], stretch=4).collect()
    assert by_stretch[0].n == 5
