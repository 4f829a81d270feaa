"""The skew paths must give the same rows as the plain ones: tiny thresholds force every branch."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from canasta.operators import cleaning, history, review, skew
from canasta.settings import PriceSettings


def lopsided(spark, n=3000):
    rng = random.Random(7)
    rows = [(1 if rng.random() < 0.6 else rng.randrange(2, 40), rng.randrange(4), f"s{i:05d}", round(rng.uniform(0.2, 9.0), 2),
             round(rng.choice([1.0, 2.0, 5.0]) * rng.uniform(0.7, 1.4), 2), rng.random() < 0.2) for i in range(n)]
    df = spark.createDataFrame(rows, "product_code int, store int, sku string, price double, kg double, size_neutral boolean")
    return df.withColumns({"price_per_kg": F.col("price") / F.col("kg"), "size_ratio": F.col("kg") / F.when(F.col("product_code") % 3 == 0, 40.0).otherwise(2.0),
                           "accepted": F.lit(True), "store": F.col("store").cast("bigint")})


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_attach_salts_hot_keys(spark):
    df = lopsided(spark)
    stats = df.groupBy("product_code").agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("top"))
    plain = skew.attach(df, stats, ["product_code"], "n")
    salted = skew.attach(df, stats, ["product_code"], "n", hot_rows=50)
    assert rows(plain, "sku", "n", "top") == rows(salted, "sku", "n", "top")
    assert salted.count() == df.count()


def test_exact_quantiles_of_hot_keys_and_copies(spark):
    df = lopsided(spark).unionByName(lopsided(spark)).select("product_code", "price")
    got = skew.exact_quantiles(df, ["product_code"], "price", {"q": 0.25, "m": 0.5}, hot_rows=20)
    data = {}
    for code, price in df.collect():
        data.setdefault(code, []).append(price)
    for r in got.collect():
        values = sorted(data[r.product_code])
        k = (len(values) - 1) * 0.25
        low = values[int(k)]
        high = values[min(int(k) + 1, len(values) - 1)]
        assert abs(r.q - (low + (high - low) * (k - int(k)))) < 1e-9
        assert abs(r.m - statistics.median(values)) < 1e-9
        assert r.n == len(values)


def test_value_bands_keep_order(spark):
    df = spark.createDataFrame([(-5.0,), (-0.1,), (0.0,), (1e-9,), (0.3,), (0.30001,), (7.0,)], "v double").select("v", skew.value_band(F.col("v")).alias("b"))
    bands = [r.b for r in df.orderBy("v").collect()]
    assert bands == sorted(bands)


def brute_greedy(items, s=PriceSettings()):
    kept, out = [], {}
    for sku, kg, u, toks in sorted(items):
        def near(k):
            rel = lambda a, b: abs(a - b) / max(a, b)
            if rel(kg, k[1]) > s.duplicate_size or rel(u, k[2]) > s.duplicate_price:
                return False
            a, b = set(toks), set(k[3])
            return (a == b and round(kg, 3) == round(k[1], 3)) or bool(a and b and len(a & b) / len(a | b) >= s.duplicate_jaccard)
        hit = next((k for k in kept if near(k)), None)
        out[sku] = hit[0] if hit else None
        if hit is None:
            kept.append((sku, kg, u, toks))
    return out


def test_greedy_rounds_equal_the_sequential_choice(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    data = [(rng.choice([1, 1, 1, 2]), 0, f"k{i:04d}", rng.uniform(0.9, 1.6), rng.uniform(2.0, 3.5), sorted(rng.sample(vocab, rng.choice([5, 6, 10, 11]))), True)
            for i in range(110)] + [(1, 0, f"z{i:04d}", 1.25, 2.5, ["a", "b"], True) for i in range(30)]
    df = spark.createDataFrame(data, "product_code int, store bigint, sku string, kg double, price_per_kg double, tokens array<string>, accepted boolean")
    expected = {}
    for code in (1, 2):
        expected.update(brute_greedy([(r[2], r[3], r[4], r[5]) for r in data if r[0] == code]))
    folded = {r.sku: r.duplicate_of for r in cleaning.dedupe_greedy(df, fold_rows=10_000).collect()}
    rounds = {r.sku: r.duplicate_of for r in cleaning.dedupe_greedy(df, fold_rows=8, hot_rows=10).collect()}
    assert folded == expected
    assert rounds == expected
    assert any(expected.values()) and not all(expected.values())


def test_repeated_skus_have_one_answer_for_every_group_size(spark):
    """The first row of a sku stands for its repeats, whichever way a group is decided."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(9)]
    data = [(1, 0, f"k{rng.randrange(20):02d}", round(rng.uniform(0.9, 1.4), 2), round(rng.uniform(2.0, 3.0), 2), sorted(rng.sample(vocab, rng.choice([5, 8]))), True)
            for i in range(45)] + [(2, 0, "a", 1.0, 2.0, ["x"], True), (2, 0, "a", 5.0, 9.0, ["x"], True), (2, 0, "b", 20.0, 50.0, ["x"], True)]
    df = spark.createDataFrame(data, "product_code int, store bigint, sku string, kg double, price_per_kg double, tokens array<string>, accepted boolean")
    firsts = {}
    for r in sorted(data, key=lambda r: (r[0], r[2], r[4], r[3], r[5])):
        firsts.setdefault((r[0], r[2]), r)
    choice = {}
    for code in (1, 2):
        choice |= {(code, k): v for k, v in brute_greedy([(r[2], r[3], r[4], r[5]) for (c, _), r in firsts.items() if c == code]).items()}
    expected = sorted((r[0], r[2], r[3], r[4], str(choice[r[0], r[2]] if r is firsts[r[0], r[2]] else choice[r[0], r[2]] or r[2])) for r in data)
    for fold_rows in (1, 8, 10_000):
        got = cleaning.dedupe_greedy(df, fold_rows=fold_rows, hot_rows=10).collect()
        assert sorted((r.product_code, r.sku, r.kg, r.price_per_kg, str(r.duplicate_of)) for r in got) == expected, fold_rows


def test_clean_listings_does_not_depend_on_skew_thresholds_or_partitions(spark):
    df = lopsided(spark, 1500)
    cols = ("sku", "status", "duplicate_of")
    plain = rows(cleaning.clean_listings(df), *cols)
    other = rows(cleaning.clean_listings(df.repartition(7, "sku"), hot_rows=40), *cols)
    assert plain == other
    assert len(plain) == 1500


def test_retail_cluster_against_brute_force(spark):
    import math
    rng = random.Random(11)
    data = [(p, rng.choice([0, 0, 0, 1, 2]) if p % 2 else 0, f"s{i}", round(math.exp(rng.uniform(-4, -1.0)), 4), True)
            for i, p in enumerate(rng.choices(range(60), k=900))]
    df = spark.createDataFrame(data, "product_code int, store int, sku string, size_ratio double, accepted boolean")
    got = {r.product_code: (r.anchor, r.tier) for r in cleaning.retail_cluster(cleaning.size_band(df)).collect()}
    for p, (anchor, tier) in got.items():
        mine = [(r[3], r[1]) for r in data if r[0] == p]
        stores = len({s for _, s in mine})

        def key(a):
            members = [(r, s) for r, s in mine if 1 / 1.75 <= r / a <= 1.75]
            multi = len({s for _, s in members}) >= min(2, stores)
            t = 3 if len(members) >= 5 and multi else (2 if multi else 1) if len(members) >= 3 else 0
            return (t, -max(a, 1 / a), -a)
        best = max((r for r, _ in mine), key=key)
        assert (anchor, tier) == (best, key(best)[0])
    assert len(got) == 60


def test_grid_join_of_two_hot_sides(spark):
    left = spark.createDataFrame([(1 if i < 90 else i, f"l{i}") for i in range(120)], "k int, a string")
    right = spark.createDataFrame([(1 if i < 70 else i + 20, f"r{i}") for i in range(120)], "k int, b string")
    plain = rows(left.join(right, "k"), "k", "a", "b")
    assert rows(skew.grid_join(left, right, ["k"], hot_rows=20, hot_pairs=100), "k", "a", "b") == plain
    assert rows(skew.grid_join(left, right, ["k"]), "k", "a", "b") == plain


def stacks(rows):
    """Surviving changes by a list-based stack per session."""
    sessions, out = {}, set()
    for row in rows:
        sessions.setdefault(row[0], {}).setdefault(row[1], []).append(row)
    for name, steps in sessions.items():
        done, undone = [], []
        for seq in sorted(steps):
            action = steps[seq][0][3]
            if action == "undo":
                undone += [done.pop()] if done else []
            elif action == "redo":
                done += [undone.pop()] if undone else []
            else:
                done, undone = done + [seq], []
        out |= {(name, level, seq, *row[2:]) for level, seq in enumerate(done, 1) for row in steps[seq]}
    return out


@pytest.mark.parametrize("block", [1024, 16, 3])
def test_one_long_session_is_replayed_in_blocks(spark, block):
    r, rows = random.Random(1), []
    # (steps, weights of change, undo, redo): among them stacks that run empty, and redo that has nothing left
    for k, (n, weights) in enumerate([(4000, (8, 3, 3)), (900, (5, 5, 5)), (900, (1, 8, 4)), (900, (1, 4, 8)), (300, (0, 1, 1)), (1, (1, 0, 0)), (700, (1, 20, 1)), (700, (1, 1, 20))]):
        seq = 0
        for _ in range(n):
            seq += r.randint(1, 3)
            action = r.choices(["change", "undo", "redo"], weights)[0]
            keys = range(r.choice([1, 1, 3])) if action == "change" else [0]
            rows += [(f"s{k}", seq, 100 * k + i, r.choice(["accepted", "rejected"]) if action == "change" else action, 1.5) for i in keys]
    log = spark.createDataFrame(rows, "session_id string, seq long, product_code long, action string, price double").repartition(5)
    found = history.undo_redo_replay(log, block).select("session_id", "level", "seq", "product_code", "action", "price")
    assert {tuple(x) for x in found.collect()} == stacks(rows)
    steps = history.step_blocks(history.session_steps(log), block).select(F.size("steps").alias("n"))
    assert steps.agg(F.max("n")).first()[0] <= block
    assert history.undo_redo_replay(log.limit(0)).count() == 0


def test_changes_that_cannot_be_made_are_no_steps(spark):
    items = spark.createDataFrame([(1, 5.0, None), (2, None, None), (3, None, 4.0)], "product_code long, estimate double, current_price double")
    log = spark.createDataFrame([("s", 1, 1, "accepted", None), ("s", 2, 1, "manual", 9.0), ("s", 3, 1, "accepted", None), ("s", 3, 2, "accepted", None),
                                 ("s", 4, 1, "manual", 7.0), ("s", 4, 3, "manual", 7.0), ("s", 5, 0, "undo", None), ("s", 6, 3, "accepted", None)],
                                "session_id string, seq long, product_code long, action string, price double")
    errors = {(x.seq, x.product_code): x.error for x in review.validate_decisions(log.where("action <> 'undo'"), items).collect()}
    assert [k for k, e in sorted(errors.items()) if e is None] == [(1, 1), (2, 1), (6, 3)]
    state = {x.product_code: (x.decision, x.price) for x in review.current_state(log, items).collect()}
    assert state == {1: ("accepted", 5.0), 2: ("pending", None), 3: ("accepted", 4.0)}


def test_quantile_ranks_may_differ_from_key_to_key(spark):
    rng = random.Random(3)
    rows = [(k, k / 10, rng.choice([1.0, 2.0, 2.5, 7.0, 9.0, None])) for k in range(-1, 12) for _ in range(40)]
    df = spark.createDataFrame(rows, "k int, q double, v double")
    for hot_rows in (1_000_000, 2):
        found = {r.k: (r.own, r.median) for r in skew.exact_quantiles(df, ["k", "q"], "v", {"own": "q", "median": 0.5}, hot_rows=hot_rows).collect()}
        for k in found:
            values = sorted(v for i, _, v in rows if i == k and v is not None)
            spots = [(len(values) - 1) * q for q in (min(max(k / 10, 0), 1), 0.5)]
            assert found[k] == tuple(pytest.approx(values[int(s)] + (values[min(int(s) + 1, len(values) - 1)] - values[int(s)]) * (s - int(s))) for s in spots)


def test_tables_that_nothing_reads_are_deleted(spark):
    table = skew.cut(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert table.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    skew.discard(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(table.written_to)
