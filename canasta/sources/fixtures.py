"""Listings, catalogue, price book, decision log and text views over the TPC-H-like test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canasta.operators.skew import spread


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def listings(spark: SparkSession, folder: str, numbered: bool = False) -> DataFrame:
    """Each line item is a store's listing for the product (part) it refers to. `numbered` adds where it stands: file and row."""
    part = read(spark, folder, "part").select("p_partkey", "p_size")
    item = read(spark, folder, "lineitem")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")] if numbered else []
    item = item.select("*", *place)
    price, kg = F.col("l_extendedprice"), F.col("l_quantity")
    return (item.join(part, item.l_partkey == part.p_partkey)
            .select(F.col("l_partkey").alias("product_code"),
                    (F.col("l_suppkey") % 4).alias("store"),
                    F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("sku"),
                    kg.alias("kg"), price.alias("price"), price.alias("regular_price"),
                    (price * (1 - F.col("l_discount"))).alias("final_price"), F.col("l_discount").alias("discount"),
                    (price / kg).alias("price_per_kg"), F.col("p_size").alias("target_kg"),
                    (kg / F.col("p_size")).alias("size_ratio"), F.col("l_shipdate").alias("ts"),
                    F.col("l_linenumber").alias("page"), (F.col("l_tax") == 0.0).alias("size_neutral"),
                    (F.col("l_returnflag") != "R").alias("accepted"), *[c for c in ("file", "row") if numbered]))


def current_prices(spark: SparkSession, folder: str) -> DataFrame:
    """The current price of each product; every tenth has none and every seventh no export id."""
    key = F.col("p_partkey")
    return read(spark, folder, "part").select(
        key.alias("product_code"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.col("p_type").alias("type"),
        F.when(key % 10 != 0, F.col("p_retailprice") * 10).alias("current_price"),
        F.when(key % 7 != 0, F.concat(F.lit("ID"), key.cast("string"))).otherwise(F.lit("")).alias("id"))


def price_book(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as price-book rows; codes repeat inside a book, so uniqueness checks have hits."""
    return read(spark, folder, "orders").select(
        F.col("o_custkey").alias("code"), F.concat(F.lit("01s4100000000"), F.col("o_orderstatus"), F.lit("x")).alias("pricebook"),
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").cast("string").alias("price"),
        F.col("o_orderpriority").alias("name"))


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a decision log; one session per user and day."""
    action = (F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "rejected")
              .when(F.col("event_type") == "signup", "manual").when(F.col("event_type") == "click", "undo")
              .otherwise("redo"))
    return read(spark, folder, "events").select(
        F.concat_ws("/", "user_id", F.to_date("ts")).alias("session_id"), F.col("event_id").alias("seq"),
        F.col("user_id").alias("product_code"), action.alias("action"), F.col("value").alias("price"), "ts")


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """X6 with changes of several products: every third event decides on three of them, rows of one step share session_id and seq."""
    key = F.col("product_code")
    several = (F.col("seq") % 3 == 0) & ~F.col("action").isin("undo", "redo")
    keys = F.when(several, F.array(key, key + 1, key + 2)).otherwise(F.array(key))
    return decisions(spark, folder).select("session_id", "seq", F.explode(keys).alias("product_code"), "action", "price", "ts")


def pick(index: Column, words: list[str]) -> Column:
    """The word at `index` modulo the length of the list."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(index, F.lit(len(words))) + 1).cast("int"))


# Catalogue and retail names in the vocabulary of the rules; (name, line, family, category) and titles.
TARGETS = [
    ("Leche entera", "Leche entera", "Lacteos", "Alimento"), ("Agua", "", "Bebidas", "Alimento"),
    ("Agua saborizada", "", "Bebidas", "Alimento"), ("Arroz primera", "", "Granos", "Alimento"), ("Vinagre", "", "", "Alimento"),
    ("Tomate en lata", "", "", "Alimento"), ("Tomates", "", "Fruver", "Alimento"), ("Pollo entero", "Aves", "Carnicos", "Alimento"),
    ("Jugo de limón concentrado", "", "", "Alimento"), ("Embutidos varios (chorizos, mortadelas)", "", "Carnicos", "Alimento"),
    ("Alimento licuado para bebé", "", "", "Alimento"), ("Vasos plásticos 9oz 150und", "", "", "No alimento"),
    ("Galleta", "", "", ""), ("Masa para pan", "", "Panadería", "Alimento"), ("Rollos de queso", "", "Panadería", "Alimento"),
    ("Hongos", "", "", "Alimento"), ("Aceite vegetal", "", "", "Alimento"), ("Helado variado", "", "", ""),
    ("Pan muffin", "", "", "Alimento"), ("Leche", "Leche en polvo", "", "Alimento"), ("Fiambreras 7x7 200 unid", "", "", "No alimento"),
    ("Harina de maíz", "", "", ""), ("Huevos de gallina", "", "", "Alimento"), ("Alcohol en gel", "", "", ""), ("del", "", "", "")]
TITLES = [
    "Leche Entera Estrella", "Leche Entera en Polvo", "Leche Descremada", "Agua Mineral con Gas", "Agua Saborizada Limón",
    "Agua Oxigenada", "Arroz Primera", "Arroz Integral", "Vinagre Blanco", "Vinagre de Manzana", "Tomate Enlatado Pelado",
    "Tomate Fresco a Granel", "Pasta de Tomate", "Pollo Entero Congelado", "Pollo Asado Entero", "Puré Gerber Bebé Manzana",
    "Detergente Limón", "Jugo de Limón Concentrado", "Jugo Piña y Limón Concentrado", "Chorizo Parrillero", "Salsa Maggi con Hongos",
    "Marca Fina con Hongos", "Champiñones Enteros", "Galletas Chocolate Orgánico", "Galleta Soda Perro", "Pan de Masa Madre",
    "Queso Crema Rollo", "Aceite Vegetal Spray", "Alimento para Perro Pollo", "Helado Vainilla Ron", "Vasos Plásticos Foam 16oz",
    "Fiambreras Plásticas 8x8", "Huevos de Codorniz", "Harina de Maíz Precocida", "Muffin Mezcla Pan", "Super Marca Gran Oferta Nueva Agua",
    "Hongos Empanizado", "Cerveza sin Alcohol Agua", "100"]


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """X2 targets: one catalogue product per part; `grp` gathers the parts that are compared with each other."""
    key = F.col("p_partkey")
    i = key * 7 + F.floor(key / 12)
    col = lambda k: pick(i, [t[k] for t in TARGETS])
    size = F.when(key % 3 == 0, F.concat(F.lit(" "), F.col("p_size"), F.lit("g"))).when(key % 3 == 1, F.concat(F.lit(" "), F.col("p_size"), F.lit("ml"))).otherwise("")
    blank = F.lit("")
    return spread(read(spark, folder, "part")).select(
        key.alias("product_code"), F.floor(key / 12).alias("grp"), F.concat(col(0), size).alias("name"),
        F.when(key % 4 != 0, F.col("p_size") / 40.0).alias("weight_kg"), F.col("p_type").alias("product_type"),
        F.struct(col(1).alias("line"), col(2).alias("family"), blank.alias("description"), blank.alias("grp"), col(3).alias("category")).alias("context"))


def retail(spark: SparkSession, folder: str) -> DataFrame:
    """X2 listings: one retail title per part, with prices and unit attributes."""
    key = F.col("p_partkey")
    size = (F.when(key % 5 == 0, F.concat(F.lit(" "), F.col("p_size"), F.lit("g"))).when(key % 5 == 1, F.concat(F.lit(" "), F.col("p_size"), F.lit("ml")))
            .when(key % 5 == 2, F.concat(F.lit(" "), F.col("p_size"), F.lit(" unidades"))).otherwise(""))
    attrs = F.when(key % 3 == 0, F.create_map(F.lit("unit"), F.lit("kg"))).when(
        key % 3 == 1, F.create_map(F.lit("size"), F.concat(F.col("p_size"), F.lit("g")))).otherwise(F.create_map().cast("map<string,string>"))
    return spread(read(spark, folder, "part")).select(
        (key % 4).alias("store"), key.cast("string").alias("sku"), F.floor(key / 12).alias("grp"),
        F.concat(pick(key * 5 + F.floor(key / 12), TITLES), size).alias("title"), attrs.alias("attrs"),
        F.when(key % 6 != 0, F.col("p_retailprice") / 100).alias("regular_price"), F.when(key % 10 != 0, F.col("p_retailprice") / 110).alias("final_price"),
        F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("price_basis"))


# A package size written in twelve ways.
QUANTITY_TEXTS = ["Leche {n} x 170g", "Jugo {n}ml x 6", "Helado 1/2 gl", "Agua 24/{n}ml", "Soda Pet 6 2LT", "Arroz {n} kg",
                  "Salami por Media Libra", "Escoba plástica", "Huevos {n} unidades", "Té Frío {n}ml 6 pack", "Tomate 3x3 kilo", "Pan {n} docenas"]


def quantity_text(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    text = F.replace(pick(key, QUANTITY_TEXTS), F.lit("{n}"), F.col("p_size").cast("string"))
    attrs = F.when(key % 5 == 0, F.create_map(F.lit("unit"), F.lit("kg"))).when(
        key % 5 == 1, F.create_map(F.lit("size"), F.concat(F.col("p_size"), F.lit("g")))).otherwise(F.create_map().cast("map<string,string>"))
    return spread(read(spark, folder, "part")).select(key.alias("product_code"), text.alias("text"), F.col("p_size").alias("n"), attrs.alias("attrs"))


def series_catalog(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """X2 with a series word shared by sixty parts: each product finds the listings of its own series only, so candidates
    grow in step with the tables. Four of five titles carry the product's own words."""
    key = F.col("p_partkey")
    word = F.concat(F.lit("serie"), F.floor(key / 60).cast("string"))
    group = F.floor(key / 60)
    part = spread(read(spark, folder, "part"))
    blank = F.lit("")
    names = [t[0] for t in TARGETS[:6]]
    name = pick(group, names)
    targets = part.select(
        key.alias("product_code"), F.concat_ws(" ", name, word, F.concat((F.col("p_size") * 20).cast("string"), F.lit("g"))).alias("name"),
        F.when(key % 4 != 0, F.col("p_size") / 40.0).alias("weight_kg"),
        F.struct(*[blank.alias(c) for c in ("line", "family", "description", "grp")], F.lit("Alimento").alias("category")).alias("context"))
    title = F.when(key % 5 == 0, pick(key, TITLES)).otherwise(F.concat_ws(" ", name, pick(key, ["Estrella", "Bonlac", "Dos Pinos", "Super"])))
    listings = part.select(
        (key % 4).alias("store"), key.cast("string").alias("sku"),
        F.concat_ws(" ", title, word, F.concat((F.col("p_size") * 20).cast("string"), F.lit("g"))).alias("title"),
        F.create_map().cast("map<string,string>").alias("attrs"),
        (F.col("p_retailprice") / 400 * (F.col("p_size") + 10) / 30).alias("regular_price"), F.lit(None).cast("double").alias("final_price"),
        F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("price_basis"))
    return targets, listings
