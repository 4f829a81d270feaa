"""Evidence flags, notes and readable reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canasta.functions.money import fixed
from canasta.functions.text import let
from canasta.settings import PriceSettings


def joined(parts: list[Column], empty: str | None = None) -> Column:
    text = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), " | ")
    return text if empty is None else F.when(text == "", empty).otherwise(text)


def evidence_flags(n: Column, store_count: Column, confidence: Column, asked: Column | int, settings: PriceSettings, noun: str) -> list[Column]:
    """The flags that depend on how many listings and stores support a price."""
    few, count = F.lit(settings.min_good_matches), n.cast("string")
    need = f"; need {settings.min_good_matches}" if noun == "clean" else ""
    asked = F.lit(asked) if isinstance(asked, int) else asked
    return [
        F.when(n == 0, "NO MATCHES").when(n <= 2, F.concat(F.lit("VERY HIGH RISK: only "), count, F.lit(f" {noun} match(es)")))
        .when(n < few, F.concat(F.lit("HIGH RISK: only "), count, F.lit(f" {noun} match(es){need}"))),
        F.when((store_count == 1) & (asked > 1), "ONE STORE ONLY"),
        F.when((confidence == "LOW") & ((n < few) | (store_count < 2)), "LOW SEARCH CONFIDENCE")]


def quality_flags(n: Column, store_count: Column, confidence: Column, stores_asked: int, size_warning: Column,
                  request_error: Column, settings: PriceSettings = PriceSettings()) -> Column:
    """The reasons for a manual review, joined by ' | '; OK when there are none."""
    error = F.when(F.coalesce(request_error, F.lit("")) != "", F.when(store_count > 0, "PARTIAL REQUEST ERROR").otherwise("REQUEST ERROR"))
    return joined([*evidence_flags(n, store_count, confidence, stores_asked, settings, "clean"), size_warning, error], "OK")


def spread_note(spread: Column, ratio: Column, cv: Column, variety: Column, settings: PriceSettings = PriceSettings()) -> Column:
    """A wide price spread, tolerated further for assorted products; informs, but asks for no review."""
    widen = F.when(variety, settings.variety_factor).otherwise(1.0)
    wide = (spread >= widen * settings.spread_ratio_limit) | (F.coalesce(cv, F.lit(0.0)) >= widen * settings.spread_cv_limit)
    shown = F.when(ratio == float("inf"), "inf").otherwise(fixed(ratio))
    return F.when(ratio.isNotNull() & wide, F.concat(F.lit("PRICE SPREAD: ratio="), shown, F.lit(", CV="), fixed(cv * 100, 1), F.lit("%"))).otherwise("")


def price_change(estimate: Column, current: Column) -> Column:
    """Relative difference to the current price; NULL without an estimate or a (non-zero) current price."""
    return F.when(current != 0, F.try_divide(estimate - current, current))


def large_change(diff: Column, settings: PriceSettings = PriceSettings()) -> Column:
    return F.coalesce(F.abs(diff) > settings.change_limit, F.lit(False))


def compare_current(summary: DataFrame, current: DataFrame, settings: PriceSettings = PriceSettings()) -> DataFrame:
    """Each product's current price, export id, relative difference and large-change mark; where the summary has the extremes (min, max, target_kg)
    also the estimates at the lowest and highest price and their relative differences.

    A summary row's own market_percent wins over the settings. A current price of 0 is none.
    """
    rows = (summary.join(current.select("product_code", "current_price", "id"), "product_code", "left")
            .withColumn("difference", price_change(F.col("estimate"), F.col("current_price")))
            .withColumn("large_change", large_change(F.col("difference"), settings)))
    if not {"min", "max", "target_kg"} <= set(summary.columns):
        return rows
    share = F.coalesce("market_percent", F.lit(settings.market_percent)) if "market_percent" in summary.columns else F.lit(settings.market_percent)
    usable = F.col("target_kg").isNotNull() & (F.col("target_kg") != 0) & F.col("min").isNotNull() & F.col("max").isNotNull()
    at = lambda c: F.when(usable, F.col(c) * F.col("target_kg") * share)
    return rows.withColumns({"min_estimate": at("min"), "max_estimate": at("max")}).withColumns(
        {"min_change": price_change(F.col("min_estimate"), F.col("current_price")), "max_change": price_change(F.col("max_estimate"), F.col("current_price"))})


def needs_review(quality: Column, diff: Column, settings: PriceSettings = PriceSettings()) -> Column:
    """struct(needed, reason): any flag or a large price change."""
    big = large_change(diff, settings)
    change = F.when(big, F.concat(F.lit("Cambio de precio de "), F.when(diff >= 0, "+").otherwise(""), fixed(diff * 100, 0),
                                  F.lit(f"% frente al actual (límite ±{settings.change_limit:.0%})")))
    alerts = F.when(quality != "OK", alert_text(quality))
    reason = F.array_join(F.filter(F.array(alerts, change), lambda x: x.isNotNull() & (x != "")), " · ")
    return F.struct(((quality != "OK") | big).alias("needed"), reason.alias("reason"))


def flag_codes(quality: Column, request_error: Column | None = None) -> Column:
    """Sorted distinct flag names; partial errors count as request errors, OK as none."""
    names = F.transform(F.split(F.coalesce(quality, F.lit("")), r"\|"), lambda p: F.substring_index(F.trim(p), ":", 1))
    one = F.transform(F.filter(names, lambda x: ~x.isin("", "OK")), lambda x: F.when(x == "PARTIAL REQUEST ERROR", "REQUEST ERROR").otherwise(x))
    if request_error is not None:
        one = F.when(F.coalesce(request_error, F.lit("")) != "", F.concat(one, F.array(F.lit("REQUEST ERROR")))).otherwise(one)
    return F.array_sort(F.array_distinct(one))


# Flag patterns in order, with the message ($1, $2 = captured text, #1, #2 = captured numbers without trailing zeros).
ALERTS = [
    (r"^OK$", ""), (r"^NO MATCHES", "Sin productos comparables"),
    (r"^VERY HIGH RISK: only (\d+)", "Riesgo muy alto: solo $1 producto(s) comparable(s)"),
    (r"^HIGH RISK: only (\d+).*?need (\d+)", "Riesgo alto: solo $1 productos comparables (se buscan $2)"),
    (r"^HIGH RISK: only (\d+)", "Riesgo alto: solo $1 productos comparables"),
    (r"^ONE STORE ONLY", "Un solo supermercado"), (r"^LOW SEARCH CONFIDENCE", "Búsqueda poco precisa"),
    (r"^TARGET SIZE WARNING: name parses to ([\d.]+)kg but spreadsheet weight is ([\d.]+)kg",
     "Revisar el peso: el nombre indica #1 kg y la hoja #2 kg"),
    (r"^TARGET SIZE WARNING", "Revisar el peso del producto"),
    (r"^PARTIAL REQUEST ERROR", "Falló la consulta a algún supermercado"), (r"^REQUEST ERROR", "Falló la consulta a los supermercados"),
]

# Reason patterns in order, with the Spanish and English sentence (%1 = captured ratio as a percentage).
REASONS = [
    (r"^accepted; sold by weight", "Aceptado: se vende por peso", "Accepted: sold by weight"),
    (r"^accepted; size strategy=PREFERRED.*?ratio=([\d.]+)", "Aceptado: tamaño parecido (%1 del producto{owner})", "Accepted: similar size (%1 of the{owner} product)"),
    (r"^accepted; size strategy=CLOSE.*?ratio=([\d.]+)", "Aceptado: tamaño cercano (%1 del producto{owner})", "Accepted: close size (%1 of the{owner} product)"),
    (r"^accepted; size strategy=FALLBACK.*?ratio=([\d.]+)", "Aceptado: el tamaño más cercano disponible (%1 del producto{owner})", "Accepted: nearest size available (%1 of the{owner} product)"),
    (r"^accepted", "Aceptado", "Accepted"),
    (r"SIZE-DISTANT MATCH REMOVED: ratio=([\d.]+)", "Tamaño muy distinto (%1 del producto{owner})", "Size too different (%1 of the{owner} product)"),
    (r"SIZE PEER REMOVED", "Sin tamaño, mientras otros productos sí lo tienen", "No size, while other listings have one"),
    (r"cannot normalize candidate to kg", "No se pudo leer el tamaño del paquete", "The package size couldn't be read"),
    (r"cannot count units", "No se pudieron contar las unidades del paquete", "The number of units couldn't be read"),
    (r"missing usable retailer price", "El supermercado no muestra un precio válido", "The store shows no usable price"),
    (r"missing required identity word\(s\): (.+)", "Le faltan palabras clave: $1", "Missing key words: $1"),
    (r"unexpected subtype for plain '(.+?)': (.+)", "Variante distinta de «$1»: $2", "Different kind of “$1”: $2"),
    (r"PRICE OUTLIER REMOVED: \$([\d.,]+)/kg vs median \$([\d.,]+)/kg", "Precio fuera de rango: \\$$1/kg frente a la mediana \\$$2/kg", "Price out of range: \\$$1/kg vs median \\$$2/kg"),
    (r"different item size: target ([\d.]+), candidate ([\d.]+)", "Tamaño por unidad distinto: propio $1, tienda $2 (kg/L)", "Different unit size: own $1, store $2 (kg/L)"),
    (r"different dimensions: target (\S+), candidate (\S+)", "Medidas distintas: propias $1, tienda $2", "Different dimensions: own $1, store $2"),
    (r"target word only appears after '(.+?)'", "La palabra clave solo aparece después de «$1» (ingrediente o sabor, no el producto)", "The key word only appears after “$1” (ingredient or flavour, not the product)"),
    (r"different product: title leads with '(.+?)'", "Otro producto: el nombre empieza con «$1»", "Different product: the name starts with “$1”"),
    (r"speciality/premium version of the product: (.+)", "Versión especial o premium: $1", "Special or premium version: $1"),
    (r"preparation/mix, not the product itself: (.+)", "Mezcla o preparado, no el producto: $1", "Mix or preparation, not the product: $1"),
    (r"made from/with '(.+?)', not the product itself", "Hecho con «$1», no es el producto", "Made with “$1”, not the product itself"),
    (r"false[- ]positive (?:family )?term\(s\): (.+)", "Coincidencia engañosa: $1", "Misleading match: $1"),
    (r"alcoholic product: (.+)", "Producto alcohólico: $1", "Alcoholic product: $1"),
    (r"pet product: (.+)", "Producto para mascotas: $1", "Pet product: $1"),
    (r"non-food product for a food target: (.+)", "No es un alimento: $1", "Not a food product: $1"),
    (r"breaded/prepared version of the product: (.+)", "Versión empanizada o preparada: $1", "Breaded or prepared version: $1"),
    (r"processed/canned product for a fresh-produce target: (.+)", "Procesado o enlatado (se busca fresco): $1", "Processed or canned (fresh wanted): $1"),
    (r"cooked/deli/seasoned version of a raw meat product: (.+)", "Versión cocida o de charcutería: $1", "Cooked or deli version: $1"),
    (r"physical-form mismatch: (.+)", "Forma distinta (sólido frente a líquido)", "Different form (solid vs liquid)"),
    (r"different/extra flavour\(s\): (.+)", "Sabor distinto o adicional: $1", "Different or extra flavour: $1"),
    (r"NEAR-DUPLICATE REMOVED: overlaps SKU \S+ \((.+)\)", "Duplicado de «$1»", "Duplicate of “$1”"),
    (r"generic product word '(.+?)' appears too late", "«$1» aparece muy tarde en el nombre", "“$1” appears too late in the name"),
]


def _plain_number(text: Column) -> Column:
    """'2.500' -> '2.5', '3.000' -> '3'."""
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def alert_text(quality: Column) -> Column:
    """Flags as readable messages, joined by a middle dot; unknown flags stay."""
    def message(flag: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, text in reversed(ALERTS):
            made = F.lit(text) if "$" not in text and "#" not in text else F.concat(*[
                F.regexp_extract(flag, pattern, int(p[1])) if p[0] == "$" else _plain_number(F.regexp_extract(flag, pattern, int(p[1]))) if p[0] == "#" else F.lit(p)
                for p in _pieces(text)])
            out = F.when(flag.rlike(pattern), made).otherwise(out)
        return F.coalesce(out, flag)
    parts = F.transform(F.split(F.coalesce(quality, F.lit("")), r"\|"), lambda f: F.trim(f))
    return F.array_join(F.filter(F.transform(F.filter(parts, lambda f: f != ""), message), lambda m: m != ""), " · ")


def _pieces(text: str) -> list[str]:
    import re
    return [p for p in re.split(r"(\$\d|#\d)", text) if p]


def _in_short(text: str) -> str:
    """A sentence without what a table of listings shows elsewhere: that it is accepted, and whose product the size is compared with."""
    for head in ("Aceptado", "Accepted"):
        if text.startswith(f"{head}: "):
            text = text[len(head) + 2:]
    for tail in (" del producto{owner}", " of the{owner} product"):
        text = text.replace(tail, "")
    return text[:1].upper() + text[1:]


def reason_text(reason: Column, lang: str = "es", owner: str = "", short: bool = False) -> Column:
    """A technical reason as a sentence in Spanish ('es') or English ('en'); unknown reasons stay as written. `short` leaves out what the
    table of listings shows elsewhere."""
    column = 1 if lang == "es" else 2

    def sentence(r: Column) -> Column:
        out = r
        for rule in reversed(REASONS):
            pattern, text = "(?i)" + rule[0], _in_short(rule[column]) if short else rule[column]
            text = text.replace("{owner}", f" {owner}" if owner else "")
            hit = F.regexp_extract(r, pattern, 0)
            if "%1" in text:
                share = F.call_function("format_number", F.regexp_extract(r, pattern, 1).try_cast("double") * 100, F.lit("0"))
                before, after = text.split("%1")
                made = F.concat(F.lit(before), F.coalesce(F.concat(share, F.lit(" %")), F.lit("?")), F.lit(after))
            elif "$1" in text:
                made = F.regexp_replace(hit, pattern, text)
            else:
                made = F.lit(text)
            out = F.when(r.rlike(pattern), made).otherwise(out)
        return out

    return let(F.trim(F.coalesce(reason, F.lit(""))), sentence)


def reason_counts(audit: DataFrame) -> DataFrame:
    """Rejected and accepted listings by reason code (partial counts, one shuffle of the few codes)."""
    return audit.groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"))


# Display headers of the summary columns and of the audit columns.
SUMMARY_HEADERS = {
    "row": "Fila en la hoja de productos", "product_code": "Código de producto", "name": "Nombre del producto",
    "queries": "Búsquedas", "confidence": "Confianza de la búsqueda", "search_warning": "Aviso de la búsqueda",
    "modifiers": "Modificadores de contexto", "stores_used": "Supermercados usados (código)", "store_count": "N.º de supermercados",
    "average_mode": "Modo de promedio", "store_averages": "Promedio por supermercado (por kg)", "raw_accepted": "Coincidencias iniciales",
    "size_removed": "Descartados por tamaño", "duplicates": "Duplicados descartados", "outliers": "Precios atípicos descartados",
    "n": "Productos comparables", "rejected": "Productos descartados", "target_kg": "Peso del producto (kg)", "target_source": "Origen del peso",
    "average": "Precio promedio por kg", "median": "Precio mediano por kg", "economy": "Precio económico por kg",
    "price_level": "Nivel de precio de mercado", "estimate": "Precio{owner} propuesto", "min": "Precio mínimo por kg", "max": "Precio máximo por kg",
    "ratio": "Relación máximo / mínimo", "cv": "Variación de precios (CV)", "price_basis": "Base de precio", "quality": "Alertas (código)",
    "request_error": "Error de supermercado", "notes": "Notas técnicas", "market_percent": "Porcentaje{owner}",
    "store_weight_cap": "Límite de peso por supermercado", "economy_percentile": "Percentil económico", "current_price": "Precio{owner} actual",
    "difference": "Diferencia vs. actual", "large_change": "Cambio grande", "id": "Id de Salesforce",
    "needs_review": "Necesita revisión", "review_reason": "Motivo de revisión",
}
AUDIT_HEADERS = {
    "product_code": "Código de producto", "target_name": "Producto{owner}", "store": "Supermercado (código)", "store_name": "Supermercado",
    "query": "Búsqueda", "verdict": "Estado", "sku": "SKU", "title": "Producto en el supermercado", "url": "Enlace",
    "regular_price": "Precio regular", "final_price": "Precio final", "price": "Precio", "chosen_basis": "Base de precio", "discount": "Descuento",
    "currency": "Moneda", "kg": "Tamaño (kg)", "target_unit_kg": "Tamaño por unidad{owner} (kg)", "candidate_unit_kg": "Tamaño por unidad en tienda (kg)",
    "size_ratio": "Relación de tamaño", "price_per_kg": "Precio por kg", "quantity_source": "Tamaño leído de", "reason": "Motivo (técnico)",
}
# Display headers of the columns that `display_values` computes.
COMPUTED_HEADERS = {"market_per_kg": "Precio de mercado por kg", "store_names": "Supermercados", "alerts": "Alertas", "reason_shown": "Motivo"}
VALUES = {"verdict": {"ACCEPTED": "Aceptado", "REJECTED": "Rechazado"}, "large_change": {"YES": "SÍ"}, "needs_review": {"YES": "SÍ", "NO": "NO"}}


def display_columns(df: DataFrame, headers: dict[str, str], back: bool = False, owner: str = "") -> DataFrame:
    """Internal columns and values under their display names, or (`back`) the other way round; `owner` names whose prices they are."""
    out = []
    for name, shown in headers.items():
        shown = shown.replace("{owner}", f" {owner}" if owner else "")
        source, target = (shown, name) if back else (name, shown)
        if source not in df.columns:
            continue
        value = F.col(f"`{source}`")
        for internal, display in VALUES.get(name, {}).items():
            a, b = (display, internal) if back else (internal, display)
            value = F.when(F.col(f"`{source}`") == a, b).otherwise(value)
        out.append(value.alias(target))
    return df.select(*out)


def display_values(df: DataFrame, store_names: dict[str, str] | None = None, lang: str = "es", owner: str = "") -> DataFrame:
    """`df` with the columns that are only computed for display, each where its sources exist: market_per_kg behind the estimate, names of the stores
    used (a store without a name stays as it is), readable alerts and the readable reason."""
    have = set(df.columns)
    added = {}
    if {"estimate", "target_kg", "market_percent"} <= have:
        share = F.col("target_kg") * F.col("market_percent")
        added["market_per_kg"] = F.when(share != 0, F.try_divide(F.col("estimate"), share))
    if "stores_used" in have:
        def named(code: Column) -> Column:
            out = code
            for store, name in (store_names or {}).items():
                out = F.when(code == store, name).otherwise(out)
            return out
        codes = F.filter(F.transform(F.split(F.coalesce("stores_used", F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")
        added["store_names"] = F.array_join(F.transform(codes, named), ", ")
    if "quality" in have:
        added["alerts"] = alert_text(F.col("quality"))
    if "reason" in have:
        added["reason_shown"] = reason_text(F.col("reason"), lang, owner)
    return df.withColumns(added) if added else df
