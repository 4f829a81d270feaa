"""Worked examples as small tables."""

import pytest
from pyspark.sql import functions as F

from canasta.functions import money, quantity, text
from canasta.operators import flags, pricing, review, catalog
from canasta.settings import PriceSettings
from canasta.sources import tables


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("name,total,unit", [
    ("Atún 12 x 170g", 2.04, 0.17), ("Agua 24/400ml", 0.4, 0.4), ("Carne 1 1/2 lb", 0.680388555, 0.680388555), ("Jugo 200ml 6 unidades", 1.2, 0.2),
    ("Galón 1/4GAL", 0.946352946, 0.946352946), ("Leche 2 5 LTS", 2.5, 2.5), ("Soda 6 2LT", 2.0, 2.0), ("Agua 1 89L", 1.89, 1.89), ("Tomate 3X3 KILO", 1.0, 1.0),
    ("Jamón por libra", 0.45359237, 0.45359237), ("Queso media libra", 0.226796185, 0.226796185), ("Soda 12 fl oz 6 pack", 6 * 12 * 0.028349523125, 12 * 0.028349523125),
    ("Arroz 12 unidades 1 kg", 1.0, 1.0), ("Pack de 4 Atún 100g", 0.4, 0.1), ("six pack cerveza 355ml", 2.13, 0.355), ("Jamon 4X4", None, None)])
def test_parse_quantity(spark, name, total, unit):
    q = one(spark, name, quantity.parse_quantity)
    assert q.total_kg == pytest.approx(total) and q.unit_kg == pytest.approx(unit)


@pytest.mark.parametrize("raw,fixed", [("2 5 LTS", "2.5lts"), ("1 8 L", "1.8l"), ("6 2LT", "6/2lt"), ("1 89L", "1.89l"), ("24/4 5 kg", "24/4 5 kg")])
def test_repair_decimals(spark, raw, fixed):
    assert one(spark, raw, text.repair_decimals) == fixed


@pytest.mark.parametrize("name,n", [("Huevos 5 docenas", 60), ("Pan media docena", 6), ("Platos 4/50UN", 50), ("Motas Nylon 300 Unidad", None), ("Bolsa De 50 Un", 50)])
def test_parse_count(spark, name, n):
    assert one(spark, name, quantity.parse_count).n == n


@pytest.mark.parametrize("name,n", [("Fiambreras 7x7 C/D Termo Foam 50", 50), ("Lechuga Und", 1), ("Huevos docena", 12), ("Vaso 16oz", 1), ("Escoba", None)])
def test_parse_count_loose(spark, name, n):
    assert one(spark, name, lambda c: quantity.parse_count(c, True)).n == n


@pytest.mark.parametrize("word,base", [("nueces", "nuez"), ("sabores", "sabor"), ("vegetales", "vegetal"), ("tomates", "tomate"), ("entera", "entero"), ("juice", "jugo"), ("frijoles", "frijol")])
def test_canonical_word(spark, word, base):
    assert one(spark, word, text.canonical_word) == base


def test_repair_mojibake(spark):
    assert one(spark, "TÃ© FrÃ­o", text.repair_mojibake) == "Té Frío"
    assert one(spark, "Ã x — é", text.repair_mojibake) == "Ã x — é"


@pytest.mark.parametrize("raw,comma,value", [("1,234.50", False, 1234.5), ("1.234,50", False, 1234.5), ("5,02", True, 5.02), ("5,02", False, 502.0), ("$ 7", False, 7.0), ("inf", False, None), ("x", False, None)])
def test_parse_money(spark, raw, comma, value):
    assert one(spark, raw, lambda c: money.parse_money(c, comma)) == value


def test_search_queries(spark):
    from canasta.operators.identity import target_features
    names = ["Alimento licuado para bebé", "Embutidos varios 17kg (chorizos)", "Pan muffin", "Leche entera en polvo", "caja 12"]
    rows = spark.createDataFrame([(i, n, None, ("", "", "", "", "")) for i, n in enumerate(names)],
                                 "product_code int, name string, weight_kg double, context struct<line:string,family:string,description:string,grp:string,category:string>")
    got = {r.product_code: r.t_search for r in target_features(rows).collect()}
    assert got[0].queries == ["alimento licuado bebe", "alimento bebe", "alimento licuado", "licuado bebe", "colado"]
    assert got[1].queries == ["embutido", "chorizo", "jamon", "mortadela", "pepperoni", "salami", "salchicha"] and got[1].confidence == "LOW"
    assert got[2].queries == ["pan muffin", "muffin"] and got[2].confidence == "MEDIUM"
    assert got[3].queries == ["leche entera polvo", "leche polvo", "leche entera"] and got[3].confidence == "HIGH"
    assert got[4].queries == [] and got[4].confidence == "LOW"


def test_price_levels_and_weights(spark):
    df = spark.createDataFrame([(1, v) for v in (2.0, 3.0, 4.0, 7.0)], "product_code int, price_per_kg double")
    value = lambda level: pricing.price_level(df, ["product_code"], PriceSettings(price_level=level)).first().level_price
    assert (value("economy"), value("median"), value("average")) == (2.75, 3.5, 4.0)
    stats = spark.createDataFrame([(1, "a", 4.0, 4.0, 4.0, 12), (1, "b", 3.8, 3.8, 3.8, 1), (1, "c", 4.1, 4.1, 4.1, 15)],
                                  "product_code int, store string, average double, median double, economy double, n long")
    assert pricing.store_balanced(stats).first().market == pytest.approx((12 + 3.8 + 12.3) / 7)
    cv = spark.createDataFrame([(1, v) for v in (3.0, 4.0, 5.0)], "product_code int, price_per_kg double")
    assert round(pricing.spread_stats(cv).first().cv, 3) == 0.204


def test_jaccard(spark):
    df = spark.createDataFrame([(list("abcd"), list("abcde"))], "a array<string>, b array<string>")
    assert df.select(text.token_jaccard(F.col("a"), F.col("b"))).first()[0] == 0.8


def test_large_change_is_strict(spark):
    df = spark.createDataFrame([(6.00,), (6.01,)], "e double").select(flags.large_change(flags.price_change(F.col("e"), F.lit(5.0))).alias("x"))
    assert [r.x for r in df.collect()] == [False, True]


def test_same_id_forms(spark):
    long, short = "01s41000004hcm1AAA", "01s41000004hcm1"
    df = spark.createDataFrame([(short,), (long,), ("01s41000004hcm2",), ("",), (None,)], "pricebook string")
    assert catalog.pricebook_filter(df, long).count() == 2 and catalog.pricebook_filter(df, short).count() == 2


def test_required_columns(spark):
    with pytest.raises(ValueError, match="weight_kg"):
        tables.scan_catalog(spark.createDataFrame([("1", "x")], "`Código de producto` string, `Nombre del producto` string"))


def test_settings_are_checked():
    assert PriceSettings.from_mapping({"store_weight_cap": "5"}).store_weight_cap == 5
    with pytest.raises(ValueError):
        PriceSettings.from_mapping({"nope": 1})
    with pytest.raises(ValueError):
        PriceSettings(close_low=2.0)


def test_files(spark, tmp_path):
    path = str(tmp_path / "book.csv")
    with open(path, "w", encoding="latin-1") as f:
        f.write("Código;Precio;Id\n7;1.234,50;A\n8;;B\n")
    book = tables.scan_price_book(tables.scan_delimited(spark, path, ";", "ISO-8859-1"))
    assert {r.product_code: r.current_price for r in catalog.price_map(book, True).collect()} == {"7": 1234.5}
    read = lambda **how: [r.Precio for r in tables.scan_delimited(spark, path, ";", "ISO-8859-1", amounts=["Precio"], **how).collect()]
    assert read() == [1234.5, None]
    with open(path, "w", encoding="latin-1") as f:
        f.write("Código;Precio\n7;1,234\n")
    assert (read(), read(decimal_comma=False)) == ([1.234], [1234.0])
    kind = "product_code string, id string, decision string, price double, current_price double"
    approved = spark.createDataFrame([("p", "A", "accepted", 2.5, 1.0), ("q", "", "pending", None, 3.0)], kind)
    tables.write_prices(approved, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()] == [("A", "2.50")]
    for state, whole, problem in ((approved, True, ("missing id", "q")), (approved.where("id = ''"), False, ("nothing approved", "")),
                                  (approved.withColumn("id", F.lit(None).cast("string")), False, ("missing id", "p")),
                                  (approved.withColumn("price", F.lit(0.001)), False, ("invalid price", "p"))):
        with pytest.raises(tables.ExportStopped) as stop:
            tables.write_prices(state, str(tmp_path / "stopped"), whole)
        assert problem in stop.value.problems and not (tmp_path / "stopped").exists()
    audit = spark.createDataFrame([(1, "s", "x"), (1, "t", "y")], "product_code int, store string, sku string")
    tables.write_results(approved, audit, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run/audit")).count() == 2


def test_orders_of_lists(spark):
    rows = spark.createDataFrame([(1, "b", None), (2, "Á", 3.0), (3, "c", 1.0), (4, "a", 3.0)], "product_code int, name string, v double")
    codes = lambda df: [r.product_code for r in df.collect()]
    assert codes(review.review_sort(rows, "v")) == [3, 2, 4, 1]
    assert codes(review.review_sort(rows, "v", descending=True)) == [1, 4, 2, 3]
    audit = rows.withColumns({"store": F.lit("s"), "sku": F.col("name")})
    assert codes(review.candidate_sort(audit, "v", descending=True)) == [2, 4, 3, 1] and codes(review.candidate_sort(audit, "v")) == [3, 2, 4, 1]


def test_recalculation_uses_the_settings_of_its_row(spark):
    audit = spark.createDataFrame([(p, s, f"{s}{i}", True, float(v)) for p in (1, 2, 3) for s, vs in (("a", (1, 2, 3, 4)), ("b", (10,))) for i, v in enumerate(vs)],
                                  "product_code int, store string, sku string, accepted boolean, price_per_kg double")
    overrides = spark.createDataFrame([(p, "b", "b0", True) for p in (1, 2, 3)], "product_code int, store string, sku string, included boolean")
    summary = spark.createDataFrame([(1, 2.0, "HIGH", "OK", 0.2, "median"), (2, 2.0, "HIGH", "OK", 0.5, "median"), (3, 2.0, "HIGH", "OK", None, None)],
                                    "product_code int, target_kg double, confidence string, quality string, market_percent double, price_level string")
    got = {r.product_code: (r.market, r.estimate, r.store_averages) for r in review.override_recalc(audit, overrides, summary, stores=["a", "b"]).collect()}
    median, economy, text = (2.5 * 3 + 10) / 4, (1.75 * 3 + 10) / 4, "a=$2.50/kg (n=4) | b=$10.00/kg (n=1)"
    assert got == {1: (median, pytest.approx(median * 0.4), text), 2: (median, median, text), 3: (economy, pytest.approx(economy * 0.4), text)}


def test_undo_redo(spark):
    log = [("s", 1, 10, "accepted", 1.0), ("s", 2, 11, "rejected", None), ("s", 3, 0, "undo", None), ("s", 4, 0, "undo", None), ("s", 5, 0, "undo", None),
           ("s", 6, 0, "redo", None), ("s", 7, 12, "manual", 3.0), ("s", 8, 0, "redo", None), ("t", 1, 9, "accepted", 1.0), ("t", 2, 0, "undo", None)]
    df = spark.createDataFrame(log, "session_id string, seq bigint, product_code int, action string, price double")
    got = sorted((r.session_id, r.level, r.seq) for r in review.undo_redo_replay(df).collect())
    assert got == [("s", 1, 1), ("s", 2, 7)]


def test_manual_average(spark):
    df = spark.createDataFrame([(1, "2,50"), (1, ""), (1, "3.5"), (2, "x"), (2, "1"), (3, " ")], "product_code int, typed string")
    got = {r.product_code: (r.stores, r.blocked, r.average) for r in pricing.manual_average(df, ["product_code"]).collect()}
    assert got == {1: (2, False, 3.0), 2: (1, True, None), 3: (0, False, None)}
