"""Filters over the catalogue and the price-book checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canasta.functions import text as X
from canasta.functions.money import finite, normalize_code, parse_money


def name_contains(df: DataFrame, text: str, column: str = "name") -> DataFrame:
    """Rows whose text holds `text`, whatever the accents, case and punctuation."""
    return df.where(X.norm_text(F.col(column)).contains(X.norm_text(F.lit(text))))


def type_equals(df: DataFrame, wanted: str, column: str = "product_type") -> DataFrame:
    return df.where(X.norm_text(F.col(column)) == X.norm_text(F.lit(wanted)))


def list_types(df: DataFrame, column: str = "product_type") -> DataFrame:
    """The distinct types in the order of their normalised text."""
    kept = df.select(F.trim(column).alias(column)).where(F.col(column) != "").distinct()
    return kept.orderBy(X.norm_text(F.col(column)), column)


def code_filter(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Only the products of an earlier run's problem list."""
    return df.join(codes.select("product_code"), "product_code", "left_semi")


def limit_first(df: DataFrame, n: int, order: str = "product_code") -> DataFrame:
    return df.orderBy(order).limit(n)


def strip_control(df: DataFrame) -> DataFrame:
    """Every text column without control characters."""
    return df.select(*[X.strip_control(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
                       for f in df.schema.fields])


def same_id(value: Column, wanted: str) -> Column:
    """Ids of 15 and 18 characters name the same entry (the longer one adds a checksum)."""
    v, w = F.trim(F.coalesce(value, F.lit(""))), wanted.strip()
    prefix = (F.substring(v, 1, 15) == w[:15]) & ((F.length(v) == 15) | F.lit(len(w) == 15))
    return (v != "") & F.lit(w != "") & ((v == w) | prefix)


def pricebook_filter(book: DataFrame, pricebook: str) -> DataFrame:
    return book.where(same_id(F.col("pricebook"), pricebook))


def _by_book(book: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows whose book id, if they have one, is in its 15-character form."""
    if "pricebook" not in book.columns:
        return book, []
    return book.withColumn("pricebook", F.substring(F.trim(F.coalesce("pricebook", F.lit(""))), 1, 15)), ["pricebook"]


def book_violations(book: DataFrame, decimal_comma: bool = False) -> DataFrame:
    """One row per problem: missing or repeated codes, repeated ids, unreadable or negative prices. With a column `pricebook` every book is
    checked by itself and the problem names it; a code or id may stand in several books."""
    book, own = _by_book(book)
    code, ident = normalize_code(F.col("code")), F.trim(F.coalesce(F.col("id"), F.lit("")))
    rows = book.select(*own, code.alias("code"), ident.alias("id"), F.col("price").cast("string").alias("price"))
    one = F.lit(1).cast("long").alias("n")
    missing = rows.where(F.coalesce(F.col("code"), F.lit("")) == "").select(*own, F.lit("missing code").alias("problem"), F.col("id").alias("key"), one)

    def repeated(c: str, text: str) -> DataFrame:
        return (rows.where(F.col(c) != "").groupBy(*own, c).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
                .select(*own, F.lit(text).alias("problem"), F.col(c).alias("key"), "n"))

    value = parse_money(F.col("price"), decimal_comma)
    bad = (F.trim(F.col("price")) != "") & (value.isNull() | (value < 0))
    prices = rows.where(bad).select(*own, F.lit("invalid price").alias("problem"), F.col("code").alias("key"), one)
    return missing.unionByName(repeated("code", "repeated code")).unionByName(repeated("id", "repeated id")).unionByName(prices)


def price_map(book: DataFrame, decimal_comma: bool = False) -> DataFrame:
    """Code and price of the rows that have one, with the book where there is a column `pricebook`."""
    book, own = _by_book(book)
    value = finite(parse_money(F.col("price"), decimal_comma))
    return book.select(*own, normalize_code(F.col("code")).alias("product_code"), value.alias("current_price")).where(F.col("current_price").isNotNull())
