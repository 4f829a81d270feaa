"""Codes, amounts and prices as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canasta.settings import PriceSettings


def fixed(value: Column, decimals: int = 2) -> Column:
    """Fixed-point text of the exact binary value, ties to even (no thousands separator)."""
    return F.call_function("format_number", value, F.lit("0." + "0" * decimals if decimals else "0"))


def finite(value: Column) -> Column:
    """The number itself, NULL for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def normalize_code(code: Column) -> Column:
    """Codes as text: a number without fraction loses its decimals ('12.0' -> '12'); other text is trimmed."""
    text = F.trim(code.cast("string"))
    number = text.try_cast("double")
    return F.when(text.rlike(r"^-?\d+\.0*$") & (number == F.floor(number)), number.cast("bigint").cast("string")).otherwise(text)


def parse_money(text: Column, decimal_comma: bool = False) -> Column:
    """'$1,234.50' -> 1234.5. With both marks the last is the decimal one; a lone comma is decimal only on request."""
    t = F.trim(F.translate(text.cast("string"), "$  ", ""))
    comma, point = t.contains(","), t.contains(".")
    last_comma = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
    european = F.when(comma & point, last_comma).otherwise(comma & F.lit(decimal_comma))
    plain = F.when(european, F.translate(F.translate(t, ".", ""), ",", ".")).otherwise(F.translate(t, ",", ""))
    return finite(plain.try_cast("double"))


def valid_price(value: Column) -> Column:
    """A price that is still positive after rounding to cents."""
    return F.coalesce(F.round(value, 2) > 0, F.lit(False))


def choose_price(regular: Column, final: Column, listed: Column, listed_basis: Column,
                 settings: PriceSettings = PriceSettings()) -> Column:
    """struct(price, basis): the configured price, else the other one, else the listed price."""
    first, second = (regular, final) if settings.price_basis == "regular" else (final, regular)
    other = "final" if settings.price_basis == "regular" else "regular"
    neither = regular.isNull() & final.isNull()
    basis = (F.when(neither, F.coalesce(listed_basis, F.lit(settings.price_basis)))
             .when(first.isNotNull(), settings.price_basis).otherwise(f"{other} fallback"))
    return F.struct(F.coalesce(first, second, listed).alias("price"), basis.alias("basis"))


def unit_price(price: Column, kg: Column, accepted: Column) -> Column:
    """Price per kg of an identified listing with a known, positive quantity."""
    return F.when(accepted & (kg > 0), F.try_divide(price, kg))


def review_unit_price(stored: Column, price: Column, kg: Column) -> Column:
    """The stored price per kg, else recomputed; NULL unless positive."""
    return F.when(stored > 0, stored).when((price > 0) & (kg > 0), F.try_divide(price, kg))
