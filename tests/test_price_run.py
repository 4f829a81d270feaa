"""The whole run on a small catalogue: every candidate ends once, figures follow from the audit."""

import pytest
from pyspark.sql import functions as F

from canasta.plans.price_run import price_run
from canasta.sources import fixtures


def test_price_run(spark, folder):
    targets, listings = fixtures.series_catalog(spark, folder)
    summary, audit = price_run(targets, listings, stores=[0, 1, 2, 3])
    rows = {r.product_code: r for r in summary.collect()}
    evidence = audit.collect()
    assert len(rows) == targets.count()
    assert len({(r.product_code, r.store, r.sku) for r in evidence}) == len(evidence)
    assert {r.status for r in evidence} >= {"ACCEPTED", "REJECTED", "SIZE"}
    assert all(r.reason for r in evidence)
    titles = {(r.product_code, r.store, r.sku): r.title for r in evidence}
    repeats = [r for r in evidence if r.status == "DUPLICATE"]
    assert repeats and all(r.reason == f"NEAR-DUPLICATE REMOVED: overlaps SKU {r.duplicate_of} ({titles[r.product_code, r.store, r.duplicate_of]})" for r in repeats)
    per = {}
    for r in evidence:
        if r.status == "ACCEPTED":
            per.setdefault(r.product_code, {}).setdefault(r.store, []).append(r.price_per_kg)
    for code, r in rows.items():
        stores = per.get(code, {})
        assert r.n == sum(map(len, stores.values())) and r.store_count == len(stores)
        if not stores:
            assert r.estimate is None and r.quality.startswith("NO MATCHES")
            continue

        def low(values):
            values = sorted(values)
            k = (len(values) - 1) * 0.25
            a, b = values[int(k)], values[min(int(k) + 1, len(values) - 1)]
            return a + (b - a) * (k - int(k))

        weight = {s: min(len(x), 3) for s, x in stores.items()}
        market = sum(low(x) * weight[s] for s, x in stores.items()) / sum(weight.values())
        assert r.economy == pytest.approx(market)
        assert r.estimate == pytest.approx(market * r.target_kg * 0.2)
    assert sum(r.estimate is not None for r in rows.values()) > len(rows) / 2


def test_candidate_join_equals_brute_force(spark, folder):
    from canasta.functions.text import semantic_tokens
    from canasta.operators import candidates, identity
    from canasta.operators.skew import cut
    targets, listings = fixtures.series_catalog(spark, folder)
    t, found_in = cut(identity.target_features(targets)), cut(identity.listing_features(listings))
    got = {(r.product_code, r.store, r.sku): r.query_rank for r in candidates.candidate_join(t, found_in).collect()}
    salted = {(r.product_code, r.store, r.sku): r.query_rank for r in candidates.candidate_join(t, found_in, hot_rows=5).collect()}
    texts = {q for r in t.select("t_search.queries").collect() for q in r.queries}
    words = {r.q: set(r.w) for r in spark.createDataFrame([(q,) for q in texts], "q string").withColumn("w", semantic_tokens(F.col("q"))).collect()}
    shelf = [(r.store, r.sku, set(r.l_tokens)) for r in found_in.select("store", "sku", "l_tokens").collect()]
    want = {}
    for r in t.select("product_code", "t_search.queries").collect():
        for rank, q in enumerate(r.queries):
            for store, sku, held in shelf:
                if words[q] and words[q] <= held:
                    want.setdefault((r.product_code, store, sku), rank)
    assert got == want and salted == want and len(want) > 100
