"""Findings of round 3: work that grew faster than its input."""

import random

import pytest
from pyspark.sql import functions as F

from canasta.operators import cleaning, history, pricing, review
from canasta.operators.skew import cut, grid_join
from canasta.plans import numeric, price_run as run, reviewing
from canasta.sources import fixtures


def test_products_that_differ_in_size_only_are_searched_and_judged_once(spark, folder, monkeypatch):
    written = {}

    def kept(df, name="step", codec=None):
        written[name] = cut(df, name, codec)
        return written[name]

    monkeypatch.setattr(run, "cut", kept)
    targets, listings = fixtures.series_catalog(spark, folder)
    t, judged = run.match(targets.unionByName(targets.withColumn("product_code", F.col("product_code") + 1_000_000)), listings)
    assert "verdicts" in written and written["verdicts"].count() * 2 <= judged.count()
    cols = [c for c in judged.columns if c not in ("product_code", "tokens")]
    one, two = (judged.where((F.col("product_code") >= 1_000_000) == twin).select(F.col("product_code") % 1_000_000, *cols) for twin in (False, True))
    assert one.count() > 100 and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_grid_join_without_hot_keys_keeps_the_tasks_of_the_larger_side(spark):
    left = cut(spark.range(1000).selectExpr("id", "id % 10 AS k").repartition(5))
    right = cut(spark.range(100).selectExpr("id AS other", "id % 10 AS k"))
    joined = grid_join(left, right, ["k"])
    assert joined.count() == 10_000
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString() and "_row" not in joined._jdf.queryExecution().toString()
    assert sorted(grid_join(left, right, ["k"], hot_rows=7).collect()) == sorted(joined.collect())


def test_candidates_that_a_word_rule_rejects_are_not_written_and_still_counted(spark, folder, monkeypatch):
    written = {}

    def kept(df, name="step", codec=None):
        written[name] = cut(df, name, codec)
        return written[name]

    monkeypatch.setattr(run, "cut", kept)
    targets, listings = fixtures.series_catalog(spark, folder)
    paged = listings.withColumn("page", (F.floor(F.col("sku").cast("bigint") / 4) % 5 + 1).cast("int"))
    summary, audit = run.price_run(targets, paged, stores=[0, 1, 2, 3], first_pages=2)
    ends = {r.product_code: (r.n, r.rejected) for r in audit.groupBy("product_code").agg(
        F.count_if(F.col("status") == "ACCEPTED").alias("n"), F.count_if(F.col("status") != "ACCEPTED").alias("rejected")).collect()}
    refused = audit.join(written["read"], ["product_code", "store", "sku"], "left_anti").select("status", "reason").collect()
    assert len(refused) > 0 and all(r.status == "REJECTED" and r.reason for r in refused)
    assert {r.product_code: (r.n, r.rejected) for r in summary.collect() if r.n + r.rejected} == ends


def test_averages_are_summed_in_the_order_of_the_file(spark):
    prices = [0.1, 0.2, 0.3, 1e16, -1e16, 0.7]
    rows = spark.createDataFrame([(1, 2, p, "f", i) for i, p in enumerate(prices)], "product_code long, store long, price_per_kg double, file string, row long")
    want = 0.0
    for p in prices:
        want += p
    for parts in (1, 3, 6):
        got = pricing.store_stats(rows.orderBy(F.col("row").desc()).repartition(parts)).collect()
        assert [(r.average, r.n) for r in got] == [(want / 6, 6)]
    several = pricing.ordered_means(rows, ["product_code", "store"], stretch=2).collect()
    assert [r.average for r in several] == [((0.1 + 0.2) + (0.3 + 1e16) + (-1e16 + 0.7)) / 6]


def test_cleaning_for_few_columns_ends_every_row_alike(spark, folder):
    rows = numeric.x1_holes(spark, folder).select(*numeric.CLEANED)
    want = cleaning.clean_listings(rows)
    columns = [*numeric.KEY, "status", "reason_code", "duplicate_of"]
    got = cleaning.clean_listings(rows, columns=columns)
    assert got.columns == columns and sorted(map(str, got.collect())) == sorted(map(str, want.select(*columns).collect()))
    # figures of the product that nobody reads are not joined to the rows that fell out before
    assert want.select("status")._jdf.queryExecution().optimizedPlan().toString().count("Join") < want._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert got.where("status = 'SIZE'").count() > 100


def reads(df, column):
    """How often a plan reads the table that has the column."""
    return sum("Relation [" in line and f"{column}#" in line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_evidence_of_the_items_comes_from_one_pass_over_the_listings(spark, folder):
    assert reads(reviewing.items(spark, folder), "l_partkey") == 1


def test_figures_of_large_and_small_products_agree(spark):
    rng = random.Random(5)
    price = [None, -2.0, 0.0, 0.5, 1.0, 1.0, 3.0, 7.25, 19.0]
    rows = [(p, s, rng.choice(price[: p % 9 + 1] if p % 3 else price[4:]), p / 40, rng.random() < 0.2) for p in range(30) for s in range(4) for _ in range(rng.randint(0, 9))]
    rows += [(99, 1, None, 0.5, True)]
    df = spark.createDataFrame(rows, "product_code long, store long, price_per_kg double, _q double, unpriced boolean").repartition(3)
    large = df.groupBy("product_code").count().where("count > 12").select("product_code")
    listed, both, ranked = (sorted(pricing.listing_figures(df, x, hot_rows).collect()) for x, hot_rows in ((None, 100), (large, 100), (df.select("product_code").distinct(), 3)))
    assert pricing.large_products(df, 100) is None and pricing.large_products(df, 12).count() == large.count() > 5
    flat = lambda rows: [v for r in rows for v in [*r[:4], *[x for s in r[4] for x in s], *r[5:]]]
    assert flat(listed) == pytest.approx(flat(both), nan_ok=True) and flat(listed) == pytest.approx(flat(ranked), nan_ok=True)
    stats = {(r.product_code, r.store): (r.n, r.average, r.median) for r in pricing.store_stats(df).collect()}
    assert {(r.product_code, s.store): (s.n, pytest.approx(s.average), s.median) for r in listed for s in r.stores} == stats
    spread = {r.product_code: tuple(r)[1:] for r in pricing.spread_stats(df).collect()}
    assert {r.product_code: tuple(pytest.approx(r[c]) for c in ("n", "median", "min", "max", "ratio", "cv", "spread")) for r in listed if r.n} == spread
    assert [tuple(r)[:5] for r in listed if r.product_code == 99] == [(99, 1, 1, 0, [])]


def test_recalculation_ranks_large_products_alike(spark):
    rng = random.Random(6)
    rows = [(p, s, f"{s}-{i}", rng.random() < 0.7, rng.choice([None, 1.0, 2.0, 2.5, 8.0])) for p in range(12) for s in "ab" for i in range(rng.randint(1, 9))]
    audit = spark.createDataFrame(rows, "product_code int, store string, sku string, accepted boolean, price_per_kg double")
    overrides = audit.where("sku like '%-0'").select("product_code", "store", "sku", (~F.col("accepted")).alias("included"))
    summary = spark.createDataFrame([(p, 2.0, "LOW", "OK", p / 12, ["median", "average", "economy"][p % 3], ["store_balanced", "all_candidates"][p % 2], 1 + p % 4) for p in range(12)],
                                    "product_code int, target_kg double, confidence string, quality string, economy_percentile double, price_level string, average_mode string, store_weight_cap int")
    key = lambda r: r.product_code
    small, large = (sorted(review.override_recalc(audit, overrides, summary, stores=["a", "b"], list_rows=x, hot_rows=y).collect(), key=key) for x, y in ((1000, 1000), (6, 5)))
    assert len(small) == 12 and all(a[c] == pytest.approx(b[c]) for a, b in zip(small, large) for c in a.asDict())
    assert any(r.problem for r in small) and any(r.estimate for r in small)


def test_current_state_computes_its_items_once(spark, folder):
    items = reviewing.items(spark, folder).select("product_code", "estimate", "current_price")
    state = reviewing.current_state(spark, folder)
    assert reads(state, "l_partkey") == 0 and reads(state, "event_id") == 0      # written once, before the log is judged and replayed
    few = fixtures.steps(spark, folder).where("seq % 4 = 0")
    made = {(r.seq, r.product_code) for r in review.validate_decisions(few, items).where("error IS NULL").collect()}
    assert reads(review.validate_decisions(few, items), "l_partkey") == 0 and len(made) > 20


def test_sessions_of_one_block_are_folded_without_blocks(spark, monkeypatch):
    rng, rows = random.Random(8), []
    for k in range(60):
        for seq in range(rng.randint(1, 40)):
            action = rng.choices(["accepted", "undo", "redo"], [(6, 3, 3), (1, 3, 3), (1, 1, 4)][k % 3])[0]
            rows += [(f"s{k}", seq, i, action, 1.0) for i in range(rng.choice([1, 1, 3]) if action == "accepted" else 1)]
    log = spark.createDataFrame(rows, "session_id string, seq long, product_code long, action string, price double").repartition(4)
    found = [sorted(map(tuple, history.undo_redo_replay(log, block).collect())) for block in (1, 20)]      # all sessions in blocks, the longer ones, none
    monkeypatch.setattr(history, "entry_states", None)
    assert found[0] == found[1] == sorted(map(tuple, history.undo_redo_replay(log).collect())) and len(found[0]) > 100
