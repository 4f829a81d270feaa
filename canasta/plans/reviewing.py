"""Catalogue filters, price book, flags, comparison with current prices, review and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from canasta.functions.money import fixed
from canasta.operators import analysis, catalog, flags, pricing, review
from canasta.operators.cleaning import PRODUCT
from canasta.operators.skew import cut
from canasta.plans.numeric import KEY, KEYS, X1, near, r, x1
from canasta.plans.registry import query
from canasta.plans.texts import norm
from canasta.settings import PriceSettings, ReviewPolicy
from canasta.sources import fixtures, tables

SIZE_TEXT = "TARGET SIZE WARNING: name parses to 1.000kg but spreadsheet weight is 2.500kg"

ITEMS = f"""{X1}, e AS (SELECT * FROM x WHERE accepted AND size_ratio BETWEEN 0.67::DOUBLE AND 1.5::DOUBLE),
 st AS (SELECT product_code, store, avg(price_per_kg) AS average, quantile_cont(price_per_kg, 0.25) AS economy, count(*) AS n FROM e GROUP BY 1, 2),
 ba AS (SELECT product_code, sum(economy * least(n, 3)) / sum(least(n, 3)) AS market, count(*) AS store_count, sum(n)::BIGINT AS n, sum(least(n, 3))::BIGINT AS support FROM st GROUP BY 1),
 sp AS (SELECT product_code, max(price_per_kg) / min(price_per_kg) AS ratio, min(price_per_kg) AS low, max(price_per_kg) AS high,
   CASE WHEN count(*) > 1 THEN stddev_pop(price_per_kg) / avg(price_per_kg) ELSE 0 END AS cv,
   CASE WHEN count(*) < 5 THEN max(price_per_kg) / min(price_per_kg) ELSE quantile_cont(price_per_kg, 0.9) / quantile_cont(price_per_kg, 0.1) END AS spread FROM e GROUP BY 1),
 i0 AS (SELECT p_partkey AS product_code, p_name || ' ' || p_brand AS name, p_type AS type, p_brand AS category, p_size::DOUBLE AS target_kg, coalesce(n, 0) AS n,
   coalesce(store_count, 0) AS store_count, coalesce(support, 0) AS support, ratio, cv, spread, low, high, market * p_size * 0.2 AS estimate,
   ['HIGH', 'MEDIUM', 'LOW'][p_partkey % 3 + 1] AS confidence, CASE WHEN p_partkey % 13 = 0 THEN 'timeout' ELSE '' END AS request_error, p_partkey % 4 = 0 AS variety,
   CASE WHEN p_partkey % 17 = 0 THEN '{SIZE_TEXT}' ELSE '' END AS size_warning,
   CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice * 10 END AS current_price, CASE WHEN p_partkey % 7 <> 0 THEN 'ID' || p_partkey ELSE '' END AS id
  FROM part LEFT JOIN ba ON ba.product_code = p_partkey LEFT JOIN sp ON sp.product_code = p_partkey),
 i1 AS (SELECT *, concat_ws(' | ', CASE WHEN n = 0 THEN 'NO MATCHES' WHEN n <= 2 THEN 'VERY HIGH RISK: only ' || n || ' clean match(es)' WHEN n < 5 THEN 'HIGH RISK: only ' || n || ' clean match(es); need 5' END,
   CASE WHEN store_count = 1 THEN 'ONE STORE ONLY' END, CASE WHEN confidence = 'LOW' AND (n < 5 OR store_count < 2) THEN 'LOW SEARCH CONFIDENCE' END, nullif(size_warning, ''),
   CASE WHEN request_error <> '' THEN CASE WHEN store_count > 0 THEN 'PARTIAL REQUEST ERROR' ELSE 'REQUEST ERROR' END END) AS fl FROM i0),
 it AS (SELECT *, CASE WHEN fl = '' THEN 'OK' ELSE fl END AS quality, CASE WHEN current_price <> 0 THEN (estimate - current_price) / current_price END AS difference,
   coalesce(abs((estimate - current_price) / current_price) > 0.2::DOUBLE, false) AS large_change FROM i1)"""


def items(spark, folder):
    """One row per product: evidence from the listings of a close size, the estimate, flags and the current price."""
    close = x1(spark, folder).where(F.col("accepted") & F.col("size_ratio").between(0.67, 1.5))
    figures = pricing.listing_figures(close, pricing.large_products(close))
    stores, settings, policy = F.col("stores"), PriceSettings(), ReviewPolicy()
    market = pricing.balanced(stores, lambda x: pricing.at_level(x, settings.price_level, "median"), settings.store_weight_cap)
    evidence = figures.select(*PRODUCT, F.col("n").alias("_n"), F.size(stores).cast("long").alias("_stores"), pricing.capped(stores, policy.matches_per_store).alias("support"),
                              market.alias("market"), "ratio", "cv", "spread", F.col("min").alias("low"), F.col("max").alias("high"))
    key = F.col("p_partkey")
    base = fixtures.read(spark, folder, "part").select(
        key.alias("product_code"), F.col("p_brand").alias("category"), F.col("p_size").cast("double").alias("target_kg"),
        fixtures.pick(key, ["HIGH", "MEDIUM", "LOW"]).alias("confidence"), F.when(key % 13 == 0, "timeout").otherwise("").alias("request_error"),
        (key % 4 == 0).alias("variety"), F.when(key % 17 == 0, SIZE_TEXT).otherwise("").alias("size_warning"))
    rows = base.join(fixtures.current_prices(spark, folder), "product_code")
    rows = rows.join(evidence, "product_code", "left")
    rows = rows.withColumns({"n": F.coalesce("_n", F.lit(0)), "store_count": F.coalesce("_stores", F.lit(0)), "support": F.coalesce("support", F.lit(0)),
                             "estimate": pricing.estimate_price(F.col("market"), F.col("target_kg"))}).drop("_n", "_stores")
    quality = flags.quality_flags(F.col("n"), F.col("store_count"), F.col("confidence"), 4, F.col("size_warning"), F.col("request_error"))
    change = flags.price_change(F.col("estimate"), F.col("current_price"))
    return (rows.withColumns({"quality": quality, "difference": change})
            .withColumn("large_change", flags.large_change(F.col("difference"))))


# -- catalogue and price book ------------------------------------------------------------------------------------

def raw_catalog(spark, folder):
    """Part as a catalogue file: Spanish headers, padded names, every eleventh name blank."""
    key = F.col("p_partkey")
    name = F.when(key % 11 == 0, " ").otherwise(F.concat(F.lit("  "), "p_name", F.lit(" ")))
    return fixtures.read(spark, folder, "part").select(
        key.alias("CODIGO DE PRODUCTO"), name.alias("Nombre del  producto"), F.col("p_size").cast("string").alias("Unidad de peso en KG"),
        F.col("p_type").alias("Sub-Familia de productos"), F.col("p_brand").alias("Línea de producto"), F.lit("").alias("Familia de Productos"),
        F.lit(None).cast("string").alias("Descripción del producto"), F.lit("g").alias("Grupo de Productos"), F.lit("Alimento").alias("Categoría RepTrim"),
        F.col("p_retailprice").alias("Precio"))


@query("scan_catalog", """SELECT p_partkey + 1 AS row, p_partkey AS product_code, 'E' || p_partkey AS erp, trim(p_name) AS name, p_size + 0.5::DOUBLE AS weight_kg, p_type AS product_type, p_brand AS line, '' AS family, '' AS description,
 'g' AS grp, 'Alimento' AS category, p_size || ',5' AS weight_text, p_retailprice AS price FROM part WHERE p_partkey % 11 <> 0""")
def scan_catalog(spark, folder):
    key = F.col("CODIGO DE PRODUCTO")
    raw = raw_catalog(spark, folder).withColumns({"#": key + 1, "ERP Id (QBO)": F.concat(F.lit("E"), key.cast("string")), "Unidad de peso en KG": F.concat("Unidad de peso en KG", F.lit(",5"))})
    rows = tables.scan_catalog(raw, decimal_comma=True, row="#")
    return rows.select("row", "product_code", "erp", "name", "weight_kg", "product_type", "context.*", F.col("original")["Unidad de peso en KG"].alias("weight_text"), F.col("original")["Precio"].alias("price"))


@query("resolve_columns", "SELECT o_custkey AS code, o_totalprice AS price, o_orderkey AS id, o_orderstatus AS pricebook FROM orders")
def resolve_columns(spark, folder):
    raw = fixtures.read(spark, folder, "orders").select(F.col("o_custkey").alias("PRODUCT-CODE"), F.col("o_totalprice").alias("Precio de Lista"),
                                                        F.col("o_totalprice").alias("precio"), F.col("o_orderkey").alias("ID"), F.col("o_orderstatus").alias("price book id"))
    return tables.resolve_columns(raw, tables.PRICE_BOOK_HEADERS)


@query("scan_price_book", "SELECT o_custkey AS code, o_totalprice::VARCHAR AS price, o_orderkey::VARCHAR AS id, '01s4100000000' || o_orderstatus || 'x' AS pricebook, o_orderpriority AS name FROM orders")
def scan_price_book(spark, folder):
    raw = fixtures.price_book(spark, folder).withColumnsRenamed({"code": "Código", "price": "Unit Price", "id": "PricebookEntryId", "pricebook": "Price Book: ID"})
    return tables.scan_price_book(raw.withColumn("Extra", F.lit(1)))


@query("filter_type", "SELECT p_partkey AS product_code FROM part WHERE p_type = 'ECONOMY'")
def filter_type(spark, folder):
    return catalog.type_equals(fixtures.current_prices(spark, folder), "Écónomy ", "type").select("product_code")


@query("list_types", "SELECT DISTINCT p_type AS type FROM part")
def list_types(spark, folder):
    return catalog.list_types(fixtures.current_prices(spark, folder), "type")


@query("rerun_subset", f"WITH {ITEMS} SELECT product_code, name FROM it WHERE quality <> 'OK'")
def rerun_subset(spark, folder):
    problems = items(spark, folder).where(F.col("quality") != "OK")
    return catalog.code_filter(fixtures.current_prices(spark, folder), problems).select("product_code", "name")


@query("limit_first", "SELECT p_partkey AS product_code FROM part WHERE p_name LIKE '%small%' ORDER BY 1 LIMIT 25")
def limit_first(spark, folder):
    rows = catalog.name_contains(fixtures.current_prices(spark, folder), "Smáll")
    return catalog.limit_first(rows, 25).select("product_code")


@query("pricebook_filter", "SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_orderstatus = 'F'")
def pricebook_filter(spark, folder):
    """The 18-character form of a book id finds the rows that carry its 15-character form."""
    return catalog.pricebook_filter(fixtures.price_book(spark, folder), "01s4100000000FxAAA").select("id")


BOOK = """b AS (SELECT '01s4100000000' || o_orderstatus || 'x' AS pricebook, o_custkey AS code, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE (o_orderkey // 2)::VARCHAR END AS id, o_orderkey % 8 AS k, o_totalprice AS v FROM orders)"""


def books(spark, folder):
    """All price books in one table; every second row carries the 18-character form of its book's id."""
    key = F.col("id").cast("bigint")
    price = F.when(key % 8 == 0, F.concat(F.lit("-"), "price")).when(key % 8 == 1, "n/a").when(key % 8 == 2, "").otherwise(F.col("price"))
    rows = fixtures.price_book(spark, folder).withColumn("pricebook", F.when(key % 2 == 0, F.concat("pricebook", F.lit("AAA"))).otherwise(F.col("pricebook")))
    return rows.withColumn("price", price).withColumn("id", F.when(key % 9 == 0, "").otherwise(F.floor(key / 2).cast("string")))


@query("unique_keys", f"""WITH {BOOK} SELECT pricebook, 'repeated code' AS problem, code::VARCHAR AS key, count(*) AS n FROM b GROUP BY pricebook, code HAVING count(*) > 1
 UNION ALL SELECT pricebook, 'repeated id', id, count(*) FROM b WHERE id <> '' GROUP BY pricebook, id HAVING count(*) > 1""")
def unique_keys(spark, folder):
    return catalog.book_violations(books(spark, folder)).where(F.col("problem").startswith("repeated"))


@query("valid_unit_price", f"WITH {BOOK} SELECT pricebook, 'invalid price' AS problem, code::VARCHAR AS key, 1::BIGINT AS n FROM b WHERE k IN (0, 1)")
def valid_unit_price(spark, folder):
    return catalog.book_violations(books(spark, folder)).where(F.col("problem") == "invalid price")


@query("price_map", f"WITH {BOOK} SELECT pricebook, code::VARCHAR AS product_code, CASE WHEN k = 0 THEN -v ELSE v END AS current_price FROM b WHERE k NOT IN (1, 2)")
def price_map(spark, folder):
    return catalog.price_map(books(spark, folder))


# -- flags and comparison ----------------------------------------------------------------------------------------

@query("quality_flags", f"WITH {ITEMS} SELECT product_code, quality FROM it")
def quality_flags(spark, folder):
    return items(spark, folder).select("product_code", "quality")


@query("spread_note", f"""WITH {ITEMS} SELECT product_code, CASE WHEN ratio IS NOT NULL AND (spread >= CASE WHEN variety THEN 2.625 ELSE 1.75 END OR coalesce(cv, 0) >= CASE WHEN variety THEN 0.45 ELSE 0.3 END)
 THEN 'PRICE SPREAD: ratio=' || printf('%.2f', ratio) || ', CV=' || printf('%.1f', cv * 100) || '%' ELSE '' END AS note FROM it""")
def spread_note(spark, folder):
    note = flags.spread_note(F.col("spread"), F.col("ratio"), F.col("cv"), F.col("variety"))
    return items(spark, folder).select("product_code", note.alias("note"))


EXTREMES = "round(low * target_kg * 0.2::DOUBLE + 3.7e-6, 4) AS min_estimate, round(high * target_kg * 0.2::DOUBLE + 3.7e-6, 4) AS max_estimate, round((low * target_kg * 0.2 - current_price) / current_price + 3.7e-6, 4) AS min_change, round((high * target_kg * 0.2 - current_price) / current_price + 3.7e-6, 4) AS max_change"


def priced_items(spark, folder):
    return items(spark, folder).drop("current_price", "id", "difference", "large_change").withColumnsRenamed({"low": "min", "high": "max"})


@query("compare_current", f"""WITH {ITEMS} SELECT product_code, round(estimate + 3.7e-6, 4) AS estimate, round(current_price + 3.7e-6, 4) AS current_price, id, round(difference + 3.7e-6, 4) AS difference, large_change,
 {EXTREMES} FROM it""")
def compare_current(spark, folder):
    out = flags.compare_current(priced_items(spark, folder), fixtures.current_prices(spark, folder))
    return out.select("product_code", r("estimate"), r("current_price"), "id", r("difference"), "large_change", *[near(c).alias(c) for c in ("min_estimate", "max_estimate", "min_change", "max_change")])


@query("large_change", f"WITH {ITEMS} SELECT product_code, large_change FROM it")
def large_change(spark, folder):
    return items(spark, folder).select("product_code", "large_change")


ALERT = """array_to_string(list_filter(list_transform(string_split(quality, ' | '), lambda f: CASE WHEN f = 'OK' THEN '' WHEN f = 'NO MATCHES' THEN 'Sin productos comparables'
 WHEN f LIKE 'VERY HIGH RISK%' THEN 'Riesgo muy alto: solo ' || regexp_extract(f, 'only (\\d+)', 1) || ' producto(s) comparable(s)'
 WHEN f LIKE 'HIGH RISK%' THEN 'Riesgo alto: solo ' || regexp_extract(f, 'only (\\d+)', 1) || ' productos comparables (se buscan 5)'
 WHEN f = 'ONE STORE ONLY' THEN 'Un solo supermercado' WHEN f = 'LOW SEARCH CONFIDENCE' THEN 'Búsqueda poco precisa'
 WHEN f LIKE 'TARGET%' THEN 'Revisar el peso: el nombre indica 1 kg y la hoja 2.5 kg' WHEN f LIKE 'PARTIAL%' THEN 'Falló la consulta a algún supermercado'
 ELSE 'Falló la consulta a los supermercados' END), lambda f: f <> ''), ' · ')"""


@query("alert_text", f"WITH {ITEMS} SELECT product_code, {ALERT} AS alerts FROM it")
def alert_text(spark, folder):
    return items(spark, folder).select("product_code", flags.alert_text(F.col("quality")).alias("alerts"))


@query("needs_review", f"""WITH {ITEMS} SELECT product_code, quality <> 'OK' OR large_change AS needed, concat_ws(' · ', CASE WHEN quality <> 'OK' THEN {ALERT} END,
 CASE WHEN large_change THEN 'Cambio de precio de ' || CASE WHEN difference >= 0 THEN '+' ELSE '' END || printf('%.0f', difference * 100) || '% frente al actual (límite ±20%)' END) AS reason FROM it""")
def needs_review(spark, folder):
    need = flags.needs_review(F.col("quality"), F.col("difference"))
    return items(spark, folder).withColumn("w", need).select("product_code", "w.needed", "w.reason")


CODES = """list_sort(list_distinct(list_concat(list_filter(list_transform(string_split(quality, ' | '), lambda f: CASE WHEN split_part(f, ':', 1) = 'PARTIAL REQUEST ERROR' THEN 'REQUEST ERROR'
 ELSE split_part(f, ':', 1) END), lambda f: f <> 'OK'), CASE WHEN request_error <> '' THEN ['REQUEST ERROR'] ELSE []::VARCHAR[] END)))"""


@query("flag_codes", f"WITH {ITEMS} SELECT product_code, array_to_string({CODES}, '|') AS codes FROM it")
def flag_codes(spark, folder):
    return items(spark, folder).select("product_code", F.array_join(flags.flag_codes(F.col("quality"), F.col("request_error")), "|").alias("codes"))


# One technical reason per sentence: (reason, Spanish, English, short Spanish, short English); a short form of None is the long one.
REASON_CASES = [
    ("missing required identity word(s): leche, polvo", "Le faltan palabras clave: leche, polvo", "Missing key words: leche, polvo", None, None),
    ("accepted; size strategy=CLOSE 0.67-1.50x; ratio=0.82", "Aceptado: tamaño cercano (82 % del producto)", "Accepted: close size (82 % of the product)", "Tamaño cercano (82 %)", "Close size (82 %)"),
    ("PRICE OUTLIER REMOVED: $9.10/kg vs median $3.00/kg (hard band $1.50-$6.00)", "Precio fuera de rango: $9.10/kg frente a la mediana $3.00/kg", "Price out of range: $9.10/kg vs median $3.00/kg", None, None),
    ("unexpected subtype for plain 'agua': gas", "Variante distinta de «agua»: gas", "Different kind of “agua”: gas", None, None),
    ("different dimensions: target 7x7, candidate 8x8", "Medidas distintas: propias 7x7, tienda 8x8", "Different dimensions: own 7x7, store 8x8", None, None),
    ("SIZE PEER REMOVED: unit-size ratio unavailable while sized peers exist", "Sin tamaño, mientras otros productos sí lo tienen", "No size, while other listings have one", None, None),
    ("something else", "something else", "something else", None, None),
    ("accepted; sold by weight (any quantity); size strategy=CLOSE", "Aceptado: se vende por peso", "Accepted: sold by weight", "Se vende por peso", "Sold by weight"),
    ("accepted; size strategy=PREFERRED 0.80-1.25x; ratio=1.10", "Aceptado: tamaño parecido (110 % del producto)", "Accepted: similar size (110 % of the product)", "Tamaño parecido (110 %)", "Similar size (110 %)"),
    ("accepted; size strategy=FALLBACK NEAREST RETAIL SIZE around 2.00x; ratio=2.50", "Aceptado: el tamaño más cercano disponible (250 % del producto)", "Accepted: nearest size available (250 % of the product)",
     "El tamaño más cercano disponible (250 %)", "Nearest size available (250 %)"),
    ("accepted by identity/subtype rules", "Aceptado", "Accepted", None, None),
    ("SIZE-DISTANT MATCH REMOVED: ratio=3.00; strategy=CLOSE 0.67-1.50x", "Tamaño muy distinto (300 % del producto)", "Size too different (300 % of the product)", "Tamaño muy distinto (300 %)", "Size too different (300 %)"),
    ("cannot normalize candidate to kg from title or safe attributes", "No se pudo leer el tamaño del paquete", "The package size couldn't be read", None, None),
    ("cannot count units in candidate title (target is priced per unit)", "No se pudieron contar las unidades del paquete", "The number of units couldn't be read", None, None),
    ("missing usable retailer price", "El supermercado no muestra un precio válido", "The store shows no usable price", None, None),
    ("different item size: target 0.255, candidate 0.454 (kg/L)", "Tamaño por unidad distinto: propio 0.255, tienda 0.454 (kg/L)", "Different unit size: own 0.255, store 0.454 (kg/L)", None, None),
    ("target word only appears after 'con' (ingredient/flavour, not the product)", "La palabra clave solo aparece después de «con» (ingrediente o sabor, no el producto)",
     "The key word only appears after “con” (ingredient or flavour, not the product)", None, None),
    ("different product: title leads with 'galleta'", "Otro producto: el nombre empieza con «galleta»", "Different product: the name starts with “galleta”", None, None),
    ("speciality/premium version of the product: gourmet", "Versión especial o premium: gourmet", "Special or premium version: gourmet", None, None),
    ("preparation/mix, not the product itself: mezcla", "Mezcla o preparado, no el producto: mezcla", "Mix or preparation, not the product: mezcla", None, None),
    ("made from/with 'arroz', not the product itself", "Hecho con «arroz», no es el producto", "Made with “arroz”, not the product itself", None, None),
    ("false-positive family term(s): coco", "Coincidencia engañosa: coco", "Misleading match: coco", None, None),
    ("generic-family false positive term(s): tonica", "Coincidencia engañosa: tonica", "Misleading match: tonica", None, None),
    ("alcoholic product: cerveza", "Producto alcohólico: cerveza", "Alcoholic product: cerveza", None, None),
    ("pet product: perro", "Producto para mascotas: perro", "Pet product: perro", None, None),
    ("non-food product for a food target: jabon", "No es un alimento: jabon", "Not a food product: jabon", None, None),
    ("breaded/prepared version of the product: empanizado", "Versión empanizada o preparada: empanizado", "Breaded or prepared version: empanizado", None, None),
    ("processed/canned product for a fresh-produce target: lata", "Procesado o enlatado (se busca fresco): lata", "Processed or canned (fresh wanted): lata", None, None),
    ("cooked/deli/seasoned version of a raw meat product: ahumado", "Versión cocida o de charcutería: ahumado", "Cooked or deli version: ahumado", None, None),
    ("physical-form mismatch: liquid target vs mass-labelled candidate", "Forma distinta (sólido frente a líquido)", "Different form (solid vs liquid)", None, None),
    ("different/extra flavour(s): fresa", "Sabor distinto o adicional: fresa", "Different or extra flavour: fresa", None, None),
    ("NEAR-DUPLICATE REMOVED: overlaps SKU 4-2-9 (Leche entera 1L)", "Duplicado de «Leche entera 1L»", "Duplicate of “Leche entera 1L”", None, None),
    ("generic product word 'agua' appears too late in candidate title (position 5)", "«agua» aparece muy tarde en el nombre", "“agua” appears too late in the name", None, None),
]
REASON_SAMPLES, REASON_ES, REASON_EN = ([c[i] for c in REASON_CASES] for i in range(3))
SHORT_ES, SHORT_EN = [c[3] or c[1] for c in REASON_CASES], [c[4] or c[2] for c in REASON_CASES]
N_REASONS = len(REASON_CASES)


def sql_list(items_) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items_) + "]"


@query("reason_text", f"""SELECT l_orderkey AS o, l_linenumber AS l, {sql_list(REASON_ES)}[l_partkey % {N_REASONS} + 1] AS es, {sql_list(REASON_EN)}[l_partkey % {N_REASONS} + 1] AS en,
 {sql_list(SHORT_ES)}[l_partkey % {N_REASONS} + 1] AS short_es, {sql_list(SHORT_EN)}[l_partkey % {N_REASONS} + 1] AS short_en FROM lineitem""")
def reason_text(spark, folder):
    reason = fixtures.pick(F.col("l_partkey"), REASON_SAMPLES)
    rows = fixtures.read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), reason.alias("reason"))
    text = lambda **how: flags.reason_text(F.col("reason"), **how)
    return rows.select("o", "l", text().alias("es"), text(lang="en").alias("en"), text(short=True).alias("short_es"), text(lang="en", short=True).alias("short_en"))


@query("display_values", f"""WITH {X1} SELECT {KEYS}, round(price / (kg * 0.2::DOUBLE) + 3.7e-6, 4) AS market_per_kg, CASE WHEN store = 0 THEN 'Rey, Super Xtra' WHEN store = 1 THEN 'Rey, other' ELSE '' END AS store_names,
 CASE WHEN store = 0 THEN 'Sin productos comparables · Un solo supermercado' ELSE '' END AS alerts, {sql_list(REASON_ES)}[product_code % {N_REASONS} + 1] AS reason_shown FROM x""")
def display_values(spark, folder):
    """Each listing as a summary row of its own."""
    store = F.col("store")
    rows = x1(spark, folder).withColumns({
        "estimate": F.col("price"), "target_kg": F.col("kg"), "market_percent": F.lit(0.2), "stores_used": F.when(store == 0, "rey,xtra").when(store == 1, " rey , other,"),
        "quality": F.when(store == 0, "NO MATCHES | ONE STORE ONLY").otherwise("OK"), "reason": fixtures.pick(F.col("product_code"), REASON_SAMPLES)})
    shown = flags.display_values(rows, {"rey": "Rey", "xtra": "Super Xtra"})
    return shown.select(*KEY, r("market_per_kg"), "store_names", "alerts", "reason_shown")


@query("display_columns", f"""WITH {X1} SELECT product_code AS "Código de producto", store AS "Supermercado (código)", sku AS "SKU", price AS "Precio",
 CASE WHEN accepted THEN 'Aceptado' ELSE 'Rechazado' END AS "Estado" FROM x""")
def display_columns(spark, folder):
    rows = x1(spark, folder).select("product_code", "store", "sku", "price", F.when(F.col("accepted"), "ACCEPTED").otherwise("REJECTED").alias("verdict"))
    there = flags.display_columns(rows, flags.AUDIT_HEADERS)
    back = flags.display_columns(there, flags.AUDIT_HEADERS, back=True)
    return flags.display_columns(back, flags.AUDIT_HEADERS)


@query("dashboard_kpis", f"""WITH {ITEMS}, k AS (SELECT count(*) AS t, count(estimate) AS p, count(*) FILTER (store_count >= 2) AS m, count(*) FILTER (quality = 'OK') AS o, (SELECT count(*) FROM lineitem) AS c FROM it)
 SELECT 'products' AS indicator, t AS quantity, 1::DOUBLE AS share FROM k UNION ALL SELECT 'with_price', p, p / t FROM k UNION ALL SELECT 'two_stores', m, m / t FROM k
 UNION ALL SELECT 'no_alerts', o, o / t FROM k UNION ALL SELECT 'listings', c, NULL FROM k""")
def dashboard_kpis(spark, folder):
    return pricing.dashboard_kpis(items(spark, folder), x1(spark, folder))


@query("run_summary", f"""WITH {ITEMS} SELECT count(*) AS n, count(estimate) AS est, count(*) FILTER (quality = 'OK') AS ok, count(estimate) - count(*) FILTER (quality = 'OK') AS review,
 count(*) - count(estimate) AS none, count(*) FILTER (large_change) AS big_changes FROM it""")
def run_summary(spark, folder):
    return pricing.run_summary(items(spark, folder))


@query("analysis_join", f"""WITH {ITEMS} SELECT p_size::VARCHAR AS "Unidad de peso en KG", p_type AS "Sub-Familia de productos", p_brand AS "Línea de producto", '' AS "Familia de Productos", NULL::VARCHAR AS "Descripción del producto",
 'g' AS "Grupo de Productos", 'Alimento' AS "Categoría RepTrim", p_retailprice AS "Precio", product_code, name, type, category, confidence, n, store_count, quality, round(target_kg, 4) AS target_kg, round(estimate + 3.7e-6, 4) AS estimate,
 round(current_price + 3.7e-6, 4) AS current_price, id, round(difference + 3.7e-6, 4) AS difference, large_change, {EXTREMES}, {ALERT} AS alerts, CASE WHEN quality = 'OK' THEN 'NO' ELSE 'YES' END AS needs_review
 FROM it JOIN part ON p_partkey = product_code WHERE p_partkey % 11 <> 0""")
def analysis_join(spark, folder):
    """Every column of the catalogue file with every result column (repeated ones once) and the comparison, for products named in the catalogue."""
    kept = ["product_code", "name", "type", "category", "confidence", "n", "store_count", "quality", "target_kg", "estimate", "min", "max"]
    out = analysis.performance_analysis(tables.scan_catalog(raw_catalog(spark, folder)), priced_items(spark, folder).select(kept), fixtures.current_prices(spark, folder)).drop("min", "max")
    return out.withColumns({c: near(c) for c in ("estimate", "current_price", "difference", "min_estimate", "max_estimate", "min_change", "max_change")})


@query("category_merge", """SELECT p_partkey AS product_code, CASE WHEN p_partkey % 2 = 0 THEN p_type WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS type FROM part""")
def category_merge(spark, folder):
    key = F.col("p_partkey")
    part = fixtures.read(spark, folder, "part")
    base = part.select(key.alias("product_code"), F.col("p_name").alias("type"))
    product = part.where(key % 5 != 4).select(key.alias("product_code"), F.when(key % 3 == 0, F.col("p_brand")).otherwise("").alias("type"))
    product = product.unionByName(part.where(key % 5 == 4).select(key.alias("product_code"), F.when(key % 3 == 0, F.col("p_brand")).alias("type")))
    result = part.select(key.alias("product_code"), F.when(key % 2 == 0, F.col("p_type")).alias("type"))
    return review.category_merge(base, product, result, ["type"])


# -- review ------------------------------------------------------------------------------------------------------

POINTS = """20 * least(1::DOUBLE, store_count / 3) + 20 * least(1::DOUBLE, support / 9) + 20 * CASE confidence WHEN 'HIGH' THEN 1::DOUBLE WHEN 'MEDIUM' THEN 0.65::DOUBLE ELSE 0.25::DOUBLE END
 + 25 * CASE WHEN coalesce(round(current_price, 2) > 0 AND round(estimate, 2) > 0, false) THEN CASE WHEN abs(estimate - current_price) / current_price <= 0.2::DOUBLE + 1e-12 THEN 1::DOUBLE
   ELSE 0.2::DOUBLE / (abs(estimate - current_price) / current_price) END WHEN NOT coalesce(round(current_price, 2) > 0, false) THEN 0.25::DOUBLE ELSE 0::DOUBLE END
 + 15 * CASE WHEN cv IS NULL THEN 0::DOUBLE WHEN cv <= 0.3::DOUBLE THEN 1::DOUBLE ELSE 0.3::DOUBLE / cv END"""


def points():
    return review.confidence_points(F.col("store_count"), F.col("support"), F.col("confidence"), F.col("estimate"), F.col("current_price"), F.col("cv"))


@query("confidence_points", f"WITH {ITEMS} SELECT product_code, round({POINTS} + 3.7e-6, 4) AS points FROM it")
def confidence_points(spark, folder):
    return items(spark, folder).withColumn("points", points()).select("product_code", r("points"))


GRADE = f"""gr0 AS (SELECT *, {POINTS} AS pts, {CODES} AS codes FROM it),
 gr1 AS (SELECT *, greatest(0, least(100, pts - coalesce(list_sum(list_transform(codes, lambda f: CASE f WHEN 'VERY HIGH RISK' THEN 25 WHEN 'HIGH RISK' THEN 15 WHEN 'LOW SEARCH CONFIDENCE' THEN 5
   WHEN 'ONE STORE ONLY' THEN 5 WHEN 'TARGET SIZE WARNING' THEN 20 ELSE 10 END)), 0)))::DOUBLE AS lf,
  least(coalesce(list_min(list_transform(codes, lambda f: CASE f WHEN 'NO MATCHES' THEN 1 WHEN 'VERY HIGH RISK' THEN 2 WHEN 'HIGH RISK' THEN 3 WHEN 'TARGET SIZE WARNING' THEN 2 WHEN 'REQUEST ERROR' THEN 3 ELSE 5 END)), 5),
   CASE WHEN coalesce(abs(estimate - current_price) / current_price > 0.2::DOUBLE + 1e-12, false) THEN 3 ELSE 5 END) AS cap FROM gr0),
 gr AS (SELECT *, CASE WHEN coalesce(round(estimate, 2) > 0, false) THEN least(cap, 1 + (lf >= 25)::INT + (lf >= 45)::INT + (lf >= 65)::INT + (lf >= 85)::INT) ELSE 1 END::INTEGER AS score,
  CASE WHEN coalesce(round(estimate, 2) > 0, false) THEN printf('%.1f', lf)::DOUBLE ELSE 0 END AS points FROM gr1)"""


@query("confidence_grade", f"WITH {ITEMS}, {GRADE} SELECT product_code, score, points FROM gr")
def confidence_grade(spark, folder):
    return review.graded(items(spark, folder)).select("product_code", "score", "points")


@query("review_notes", f"""WITH {ITEMS} SELECT product_code, concat_ws(' ', 'Based on ' || n || ' comparable listings from ' || store_count || ' stores.',
 CASE WHEN NOT coalesce(round(estimate, 2) > 0, false) THEN 'No usable estimate was found. A price can be entered manually.' END,
 CASE WHEN NOT coalesce(round(current_price, 2) > 0, false) THEN 'No positive current price is available for comparison.'
  WHEN abs(estimate - current_price) / current_price > 0.2::DOUBLE + 1e-12 THEN 'The estimate differs from the current price by more than 20%. Check the product and package size.' END,
 CASE WHEN size_warning <> '' THEN 'The product name and spreadsheet list different package sizes.' END,
 CASE WHEN confidence = 'LOW' THEN 'The search terms are broad; check whether the store products are comparable.' END,
 CASE WHEN request_error <> '' THEN 'Some store searches failed, so the evidence may be incomplete.' END, CASE WHEN cv > 0.3::DOUBLE THEN 'Comparable store prices vary considerably.' END,
 CASE WHEN id = '' THEN 'Salesforce Id is missing. This item needs a current-price record before CSV export.' END) AS notes FROM it""")
def review_notes(spark, folder):
    notes = review.review_notes(F.col("n"), F.col("store_count"), F.col("estimate"), F.col("current_price"), F.col("quality"), F.col("confidence"),
                                F.col("request_error"), F.col("cv"), F.col("id"))
    return items(spark, folder).select("product_code", F.array_join(notes, " ").alias("notes"))


LOG = """lg AS (SELECT user_id || '/' || ts::DATE AS session_id, event_id AS seq, user_id AS product_code, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'manual'
   WHEN 'click' THEN 'undo' ELSE 'redo' END AS action, value AS price, ts FROM events),
 va AS (SELECT lg.*, CASE WHEN action IN ('undo', 'redo') THEN 'Unknown decision' WHEN action = 'manual' AND NOT coalesce(round(price, 2) > 0, false) THEN 'Enter a positive price for one selected item.'
   WHEN action = 'accepted' AND NOT coalesce(round(CASE WHEN round(estimate, 2) > 0 THEN estimate ELSE current_price END, 2) > 0, false) THEN 'No proposed or current price. Enter the price manually first.' END AS error,
   estimate, current_price FROM lg LEFT JOIN it USING (product_code)),
 la AS (SELECT product_code, arg_max({'a': action, 'p': price}, seq) AS d FROM va WHERE error IS NULL GROUP BY 1),
 ds AS (SELECT it.*, coalesce(d.a, 'pending') AS decision, printf('%.2f', CASE d.a WHEN 'manual' THEN d.p WHEN 'accepted' THEN CASE WHEN round(estimate, 2) > 0 THEN estimate ELSE current_price END END)::DOUBLE AS price
  FROM it LEFT JOIN la USING (product_code))"""


def state(spark, folder):
    return review.decision_state(fixtures.decisions(spark, folder), items(spark, folder))


@query("accept_price", f"WITH {ITEMS} SELECT product_code, round(CASE WHEN round(estimate, 2) > 0 THEN estimate ELSE current_price END + 3.7e-6, 4) AS price FROM it")
def accept_price(spark, folder):
    rows = items(spark, folder).withColumn("price", review.accept_price(F.col("estimate"), F.col("current_price")))
    return rows.select("product_code", r("price"))


@query("validate_decisions", f"WITH {ITEMS}, {LOG} SELECT seq, product_code, action, error FROM va")
def validate_decisions(spark, folder):
    return review.validate_decisions(fixtures.decisions(spark, folder), items(spark, folder)).select("seq", "product_code", "action", "error")


@query("decision_state", f"WITH {ITEMS}, {LOG} SELECT product_code, decision, price FROM ds")
def decision_state(spark, folder):
    return state(spark, folder).select("product_code", "decision", "price")


@query("decision_counts", f"WITH {ITEMS}, {LOG} SELECT decision, count(*) AS n FROM ds GROUP BY 1")
def decision_counts(spark, folder):
    return review.decision_counts(state(spark, folder))


@query("inclusion_counts", f"WITH {X1} SELECT store, count(*) FILTER (accepted <> (page = 3)) AS included, count(*) AS total FROM x GROUP BY 1")
def inclusion_counts(spark, folder):
    return review.inclusion_counts(x1(spark, folder).withColumn("included", F.col("accepted") != (F.col("page") == 3)))


STEPS = """stp AS (SELECT session_id, seq, unnest(CASE WHEN seq % 3 = 0 AND action NOT IN ('undo', 'redo') THEN [k, k + 1, k + 2] ELSE [k] END) AS product_code, action, price
  FROM (SELECT user_id || '/' || ts::DATE AS session_id, event_id AS seq, user_id AS k, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected'
   WHEN 'signup' THEN 'manual' WHEN 'click' THEN 'undo' ELSE 'redo' END AS action, value AS price FROM events))"""
REPLAY = """ o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM (SELECT session_id, seq, any_value(action) AS action FROM lg GROUP BY 1, 2)),
 w AS (SELECT DISTINCT session_id, 0::BIGINT AS rn, []::BIGINT[] AS done, []::BIGINT[] AS undone FROM o
  UNION ALL SELECT w.session_id, o.rn, CASE action WHEN 'undo' THEN done[:-2] WHEN 'redo' THEN CASE WHEN len(undone) > 0 THEN list_append(done, undone[-1]) ELSE done END ELSE list_append(done, seq) END,
   CASE action WHEN 'undo' THEN CASE WHEN len(done) > 0 THEN list_append(undone, done[-1]) ELSE undone END WHEN 'redo' THEN undone[:-2] ELSE []::BIGINT[] END
  FROM w JOIN o ON o.session_id = w.session_id AND o.rn = w.rn + 1),
 f AS (SELECT session_id, arg_max(done, rn) AS done FROM w GROUP BY 1), u AS (SELECT session_id, unnest(done) AS seq, generate_subscripts(done, 1) AS level FROM f)"""


@query("undo_redo_replay", f"""WITH RECURSIVE {STEPS}, lg AS (SELECT * FROM stp), {REPLAY} SELECT u.session_id, u.level, u.seq, product_code, action, round(price, 4) AS price FROM u JOIN lg USING (session_id, seq)""")
def undo_redo_replay(spark, folder):
    out = review.undo_redo_replay(fixtures.steps(spark, folder))
    return out.select("session_id", "level", "seq", "product_code", "action", F.round("price", 4).alias("price"))


# Changes that cannot be made are no steps: several products with one manual price, or an acceptance of which one product has no price.
VALID_STEPS = """sv AS (SELECT stp.*, count(*) OVER (PARTITION BY session_id, seq) AS keys,
   bool_or(action = 'accepted' AND NOT coalesce(round(CASE WHEN round(estimate, 2) > 0 THEN estimate ELSE current_price END, 2) > 0, false)) OVER (PARTITION BY session_id, seq) AS stopped FROM stp LEFT JOIN it USING (product_code)),
 lg AS (SELECT session_id, seq, product_code, action, price FROM sv WHERE NOT stopped AND NOT (action = 'manual' AND (keys > 1 OR NOT coalesce(round(price, 2) > 0, false))))"""


@query("current_state", f"""WITH RECURSIVE {ITEMS}, {STEPS}, {VALID_STEPS}, {REPLAY},
 ls AS (SELECT product_code, arg_max({{'a': action, 'p': price}}, seq) AS d FROM lg JOIN u USING (session_id, seq) GROUP BY 1)
 SELECT product_code, coalesce(d.a, 'pending') AS decision, printf('%.2f', CASE d.a WHEN 'manual' THEN d.p WHEN 'accepted' THEN CASE WHEN round(estimate, 2) > 0 THEN estimate ELSE current_price END END)::DOUBLE AS price
 FROM it LEFT JOIN ls USING (product_code)""")
def current_state(spark, folder):
    rows = cut(items(spark, folder).select("product_code", "estimate", "current_price"), "items")
    return review.current_state(fixtures.steps(spark, folder), rows).select("product_code", "decision", "price")


@query("override_recalc", f"""WITH {ITEMS}, oc AS (SELECT DISTINCT product_code FROM x WHERE page = 7),
 us AS (SELECT x.*, CASE WHEN page = 7 THEN NOT accepted ELSE accepted END AS used FROM x JOIN oc USING (product_code)), tt AS (SELECT product_code, count(*) AS listings FROM us GROUP BY 1),
 s2 AS (SELECT product_code, store, quantile_cont(price_per_kg, 0.5) AS median, avg(price_per_kg) AS average, list_sort(list(price_per_kg)) AS l, (count(*) - 1) * ((product_code % 997) / 1994::DOUBLE) AS h, count(*) AS n FROM us WHERE used GROUP BY 1, 2),
 s3 AS (SELECT *, CASE product_code % 3 WHEN 0 THEN median WHEN 1 THEN average ELSE l[floor(h)::BIGINT + 1] + (l[ceil(h)::BIGINT + 1] - l[floor(h)::BIGINT + 1]) * (h - floor(h)) END AS chosen FROM s2),
 b2 AS (SELECT product_code, sum(chosen * least(n, 1 + product_code % 5)) / sum(least(n, 1 + product_code % 5)) AS market, count(*) AS store_count, sum(n)::BIGINT AS n FROM s3 GROUP BY 1),
 m2 AS (SELECT product_code, quantile_cont(price_per_kg, 0.5) AS median, CASE WHEN count(*) > 1 THEN stddev_pop(price_per_kg) / avg(price_per_kg) ELSE 0 END AS cv FROM us WHERE used GROUP BY 1),
 z AS (SELECT tt.product_code, coalesce(b2.n, 0) AS accepted_count, listings - coalesce(b2.n, 0) AS rejected_count, coalesce(b2.store_count, 0) AS store_count, b2.market * it.target_kg * (tt.product_code % 7 / 10::DOUBLE) AS estimate, b2.market, m2.median, m2.cv, it.confidence, it.quality
   FROM tt LEFT JOIN b2 USING (product_code) LEFT JOIN m2 USING (product_code) LEFT JOIN it ON it.product_code = tt.product_code)
 SELECT product_code, accepted_count, rejected_count, store_count, round(estimate + 3.7e-6, 4) AS estimate, round(market + 3.7e-6, 4) AS market, round(median + 3.7e-6, 4) AS median, round(cv + 3.7e-6, 4) AS cv,
  coalesce(nullif(concat_ws(' | ', nullif(array_to_string(list_filter(string_split(quality, ' | '), lambda f: f LIKE 'TARGET%' OR f LIKE '%REQUEST ERROR%'), ' | '), ''),
   CASE WHEN accepted_count = 0 THEN 'NO MATCHES' WHEN accepted_count <= 2 THEN 'VERY HIGH RISK: only ' || accepted_count || ' selected match(es)' WHEN accepted_count < 5 THEN 'HIGH RISK: only ' || accepted_count || ' selected match(es)' END,
   CASE WHEN store_count = 1 THEN 'ONE STORE ONLY' END, CASE WHEN confidence = 'LOW' AND (accepted_count < 5 OR store_count < 2) THEN 'LOW SEARCH CONFIDENCE' END), ''), 'OK') AS quality FROM z""")
def override_recalc(spark, folder):
    """A person turns every listing of page 7 round; the products concerned are priced again."""
    audit = x1(spark, folder)
    overrides = audit.where(F.col("page") == 7).select("product_code", "store", "sku", (~F.col("accepted")).alias("included"))
    key = F.col("product_code")
    stored = items(spark, folder).withColumns({
        "market_percent": key % 7 / 10.0, "store_weight_cap": (1 + key % 5).cast("int"), "economy_percentile": key % 997 / 1994.0,
        "price_level": F.when(key % 3 == 0, "median").when(key % 3 == 1, "average").otherwise("economy")})
    out = review.override_recalc(audit, overrides, stored)
    return out.select("product_code", "accepted_count", "rejected_count", "store_count", r("estimate"), r("market"), r("median"), r("cv"), "quality")


@query("export_check", f"""WITH {ITEMS}, {LOG} SELECT 'missing id' AS problem, product_code::VARCHAR AS key FROM ds WHERE decision IN ('accepted', 'manual') AND id = ''
 UNION ALL SELECT 'invalid price', product_code::VARCHAR FROM ds WHERE decision IN ('accepted', 'manual') AND NOT coalesce(round(price, 2) > 0, false)""")
def export_check(spark, folder):
    return review.export_check(state(spark, folder))


@query("export_check_unchanged", f"""WITH {ITEMS}, {LOG} SELECT 'missing id' AS problem, product_code::VARCHAR AS key FROM ds WHERE (decision IN ('accepted', 'manual') OR coalesce(round(current_price, 2) > 0, false)) AND id = ''
 UNION ALL SELECT 'invalid price', product_code::VARCHAR FROM ds WHERE decision IN ('accepted', 'manual') AND NOT coalesce(round(price, 2) > 0, false)""")
def export_check_unchanged(spark, folder):
    return review.export_check(state(spark, folder), include_unchanged=True)


@query("approved_prices", f"""WITH {ITEMS}, {LOG} SELECT id, price FROM ds WHERE decision IN ('accepted', 'manual')
 UNION ALL SELECT id, printf('%.2f', current_price)::DOUBLE FROM ds WHERE decision NOT IN ('accepted', 'manual') AND current_price > 0""")
def approved_prices(spark, folder):
    return review.approved_prices(state(spark, folder), include_unchanged=True)


@query("export_prices", f"""WITH {ITEMS}, {LOG} SELECT id AS "Id", printf('%.2f', price) AS "UnitPrice" FROM ds WHERE decision IN ('accepted', 'manual') AND id <> ''""")
def export_prices(spark, folder):
    """The lines that `tables.write_prices` puts into the export file, for a review of the products that have an export id."""
    ready = items(spark, folder).where(F.col("id") != "")
    return tables.export_lines(review.decision_state(fixtures.decisions(spark, folder), ready))


@query("stale_review", "SELECT event_id AS seq, event_id % 4 = 0 AS stale FROM events")
def stale_review(spark, folder):
    log = fixtures.decisions(spark, folder).withColumn("run_id", F.when(F.col("seq") % 4 == 0, "old").otherwise("current"))
    return review.stale_review(log, "current").select("seq", "stale")


@query("review_filter", f"""WITH {ITEMS}, {LOG} SELECT product_code, 'problem' AS filter FROM ds WHERE decision = 'rejected' OR (NOT coalesce(round(estimate, 2) > 0, false) AND decision NOT IN ('accepted', 'manual'))
 UNION ALL SELECT product_code, 'approved' FROM ds WHERE decision IN ('accepted', 'manual') AND type = 'ECONOMY'
 UNION ALL SELECT product_code, 'text' FROM ds WHERE decision = 'pending' AND contains({norm("product_code || ' ' || name || ' ' || type || ' ' || category")}, 'brand 17')
 UNION ALL SELECT gr.product_code, 'score' FROM (SELECT * FROM gr) gr WHERE score = 3""".replace(f"WITH {ITEMS}, {LOG}", f"WITH {ITEMS}, {LOG}, {GRADE}"))
def review_filter(spark, folder):
    rows = state(spark, folder)
    scored = review.graded(items(spark, folder)).withColumn("decision", F.lit("pending"))
    parts = {"problem": review.review_filter(rows, decision="problem"), "approved": review.review_filter(rows, decision="approved", product_type="ECONOMY"),
             "text": review.review_filter(rows, decision="pending", text="BRAND#17"), "score": review.review_filter(scored, score=3)}
    out = None
    for name, part in parts.items():
        one = part.select("product_code", F.lit(name).alias("filter"))
        out = one if out is None else out.unionByName(one)
    return out


@query("candidate_filter", f"""WITH {X1}, c AS (SELECT x.*, accepted <> (page = 3) AS included, {sql_list(REASON_SAMPLES)}[product_code % {N_REASONS} + 1] AS reason, {sql_list(REASON_ES)}[product_code % {N_REASONS} + 1] AS es FROM x)
 SELECT {KEYS} FROM c WHERE included <> accepted AND accepted AND contains({norm("'Título ' || product_code || ' ' || sku || ' ' || reason || ' q ' || es")}, 'tamano cercano')""")
def candidate_filter(spark, folder):
    rows = x1(spark, folder).withColumns({"included": F.col("accepted") != (F.col("page") == 3), "reason": fixtures.pick(F.col("product_code"), REASON_SAMPLES),
                                          "title": F.concat(F.lit("Título "), F.col("product_code").cast("string")), "query": F.lit("q")})
    return review.candidate_filter(rows, "changed", "accepted", "TAMAÑO cercano").select(*KEY)


@query("review_sort", f"WITH {ITEMS} SELECT product_code, name, round(current_price + 3.7e-6, 4) AS current_price FROM it")
def review_sort(spark, folder):
    return review.review_sort(items(spark, folder), "current_price").select("product_code", "name", r("current_price"))


@query("candidate_sort", f"WITH {X1} SELECT {KEYS} FROM x")
def candidate_sort(spark, folder):
    return review.candidate_sort(x1(spark, folder), "price_per_kg", descending=True).select(*KEY)
