"""What the steps of a run carry and look up."""

from pyspark.sql import functions as F

from canasta.operators import identity
from canasta.operators.skew import attach, cut
from canasta.plans import matching


def test_rejected_pairs_look_up_no_position(spark, folder):
    """The place of the first word is looked up for pairs that pass the first two rules, with the same verdicts."""
    rows = identity.pair_features(matching.pairs(spark, folder), in_order=True).select("p_early", "p_first").collect()
    assert len(rows) > 2000 and all(r.p_first is None for r in rows if r.p_early is not None)
    assert 0 < sum(r.p_first is not None for r in rows) == sum(r.p_early is None for r in rows)


def test_names_are_analysed_once_per_text(spark, monkeypatch):
    """rows with one title and the same attributes share an analysis; NULL texts keep their row."""
    shown = "store int, sku string, title string, attrs map<string,string>"
    rows = [(i % 4, str(i), ["Leche Entera 900ml", None, "Arroz 2 kg"][i % 3], [{}, {"unit": "kg"}, None, {"size": "500g"}][i % 4]) for i in range(60)]
    written = {}
    monkeypatch.setattr(identity, "cut", lambda df, name: written.setdefault(name, cut(df, name)))
    got = identity.listing_features(spark.createDataFrame(rows, shown), hot_rows=2).select("sku", "title", "attrs", "l_tokens", "l_mass.kg").collect()
    assert written["analysed"].count() == 12 and len(got) == 60 and all(r.l_tokens is not None for r in got)
    back = {r.sku: r for r in got}
    assert all(back[sku].title == (title or "") and back[sku].attrs == attrs for _, sku, title, attrs in rows)
    assert back["0"].kg == 0.9 and back["2"].l_tokens == back["5"].l_tokens


def test_written_figures_without_large_keys_meet_rows_where_they_lie(spark):
    """No salt is joined on when a written table of figures has no key above the limit."""
    rows = spark.range(40).select((F.col("id") % 4).alias("k"), "id")
    figures = cut(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")), "figures")
    plain, salted = attach(rows, figures, ["k"], "n"), attach(rows, figures, ["k"], "n", hot_rows=5)
    assert plain.columns == salted.columns and sorted(plain.collect()) == sorted(salted.collect())
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "_salt" in plan(salted) and "_salt" not in plan(plain)
