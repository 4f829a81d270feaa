"""Reading the catalogue, the price book and delimited files; writing results and the approved-price export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canasta.functions.money import fixed, parse_money
from canasta.functions.text import ACCENTED, PLAIN
from canasta.operators.review import approved_prices, export_check

# Accepted header names per field, exact names before the shorter fallbacks.
PRICE_BOOK_HEADERS = {
    "code": ("ProductCode", "Product Code", "Código de producto", "Codigo del producto", "Código"),
    "price": ("UnitPrice", "Unit Price", "List Price", "Precio de lista", "Precio unitario", "Precio"),
    "id": ("Id", "Price Book Entry ID", "PricebookEntryId", "Pricebook Entry Id"),
    "pricebook": ("Pricebook2Id", "Pricebook2 Id", "Price Book ID", "PricebookId", "Price Book: ID"),
    "name": ("Name", "Product Name", "Nombre del producto", "Nombre"),
}
CATALOG_HEADERS = {
    "code": ("Código de producto",), "name": ("Nombre del producto",), "weight_kg": ("Unidad de Peso en KG",),
    "product_type": ("Sub-familia de Productos",), "line": ("Linea de producto",), "family": ("Familia de productos",),
    "description": ("Descripción del producto",), "grp": ("Grupo de Productos",), "category": ("Categoria RepTrim",),
    "erp": ("ERP Id (QBO)",),
}


_PLAIN_LETTERS = str.maketrans(dict(zip(ACCENTED, PLAIN)))


def header_key(text: str) -> str:
    """What two spellings of a header have in common: letters without accents, and digits."""
    letters = (text or "").lower().translate(_PLAIN_LETTERS)
    return "".join(c for c in letters if c.isascii() and c.isalnum())


def match_headers(columns: Sequence[str], aliases: dict[str, Sequence[str]]) -> dict[str, str]:
    """Field -> source column; aliases are tried in order and a column serves one field only."""
    by_key: dict[str, list[str]] = {}
    for c in columns:
        by_key.setdefault(header_key(c), []).append(c)
    found: dict[str, str] = {}
    for name, options in aliases.items():
        free = (c for option in options for c in by_key.get(header_key(option), []) if c not in found.values())
        hit = next(free, None)
        if hit is not None:
            found[name] = hit
    return found


def resolve_columns(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Only the known fields, under their field names; unmatched fields are absent."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in match_headers(df.columns, aliases).items()])


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {', '.join(missing)}")
    return df


def scan_catalog(df: DataFrame, decimal_comma: bool = False, row: str | None = None) -> DataFrame:
    """Targets of a catalogue table: named rows only, trimmed, with the context struct, the ERP id and all source columns as `original`.

    `row` names a column with the rows' numbers in their file, which becomes `row`. Weights are read as amounts. Each field of `original` carries
    the field that it serves as metadata.
    """
    found = match_headers(df.columns, CATALOG_HEADERS)
    known = require_columns(df.select(*[F.col(f"`{c}`").alias(name) for name, c in found.items()], *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(df.columns)]),
                            [n for n in CATALOG_HEADERS if n != "erp"])
    text = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("line", "family", "description", "grp", "category")}
    serves = {c: name for name, c in found.items()}
    source = [F.col(f"_{i}").alias(c, metadata={"field": serves.get(c, "")}) for i, c in enumerate(df.columns) if c != row]
    number = [F.col(f"_{df.columns.index(row)}").cast("long").alias("row")] if row else []
    erp = F.trim(F.coalesce(F.col("erp").cast("string"), F.lit(""))) if "erp" in found else F.lit("")
    return (known.where(F.trim(F.coalesce(F.col("name"), F.lit(""))) != "")
            .select(*number, F.col("code").alias("product_code"), erp.alias("erp"), F.trim("name").alias("name"),
                    parse_money(F.col("weight_kg"), decimal_comma).alias("weight_kg"),
                    F.trim(F.coalesce("product_type", F.lit(""))).alias("product_type"),
                    F.struct(*[v.alias(k) for k, v in text.items()]).alias("context"), F.struct(*source).alias("original")))


def scan_price_book(df: DataFrame) -> DataFrame:
    """The five price-book fields; everything else in the file is pruned from the scan."""
    return require_columns(resolve_columns(df, PRICE_BOOK_HEADERS), ["code", "price", "id"])


def scan_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", decimal_comma: bool | None = None,
                   amounts: Sequence[str] = ()) -> DataFrame:
    """A delimited text file with a header row, all columns as text but `amounts`, which become numbers.

    A comma in an amount is the decimal mark if `decimal_comma`; not given, it is in files separated by semicolons. Encodings are those of the CSV
    source (UTF-8, UTF-16, ISO-8859-1); spark.sql.legacy.javaCharsets admits cp1252.
    """
    comma = sep == ";" if decimal_comma is None else decimal_comma
    df = spark.read.csv(path, sep=sep, encoding=encoding, header=True, inferSchema=False)
    require_columns(df, amounts)
    return df.withColumns({c: parse_money(F.col(f"`{c}`"), comma) for c in amounts}) if amounts else df


def audit_by_product(audit: DataFrame) -> DataFrame:
    """Evidence counts per product and store; the listings themselves stay rows of the audit table."""
    return audit.groupBy("product_code", "store").agg(F.count(F.lit(1)).alias("listings"), F.count_if("accepted").alias("accepted"))


def fresh_snapshot(df: DataFrame, as_of: str, ttl_hours: int, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """The newest row of each key not older than the limit (equal times: the greater tie value)."""
    limit = F.lit(as_of).cast("timestamp")
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return (df.where((F.col(ts) > limit - F.make_dt_interval(hours=F.lit(ttl_hours))) & (F.col(ts) <= limit))
            .withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r"))


def matching_count(df: DataFrame, filters: Sequence[Column], limit: int | None = None) -> DataFrame:
    for f in filters:
        df = df.where(f)
    n = F.count(F.lit(1))
    return df.agg((F.least(n, F.lit(limit)) if limit else n).cast("long").alias("n"))


def write_results(summary: DataFrame, audit: DataFrame, path: str) -> None:
    """One row per product under `summary`, one per candidate under `audit` (a folder per store)."""
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    audit.write.mode("overwrite").partitionBy("store").parquet(f"{path}/audit")


def price_lines(approved: DataFrame) -> DataFrame:
    return approved.select(F.col("id").alias("Id"), fixed(F.col("price")).alias("UnitPrice"))


class ExportStopped(ValueError):
    """An export with problems; `problems` lists the first of them as (problem, key)."""

    def __init__(self, problems: list[tuple[str, str]]) -> None:
        super().__init__("; ".join(f"{p} {k}".strip() for p, k in problems))
        self.problems = problems


def export_lines(state: DataFrame, include_unchanged: bool = False, shown: int = 50) -> DataFrame:
    """The lines of the export, all of them or none: any problem of `export_check` stops it and is named (the first `shown`)."""
    found = export_check(state, include_unchanged).orderBy("problem", "key").limit(shown).collect()
    if found:
        raise ExportStopped([(r["problem"], r["key"]) for r in found])
    return price_lines(approved_prices(state, include_unchanged))


def write_prices(state: DataFrame, path: str, include_unchanged: bool = False) -> None:
    """`Id,UnitPrice` with two decimals, checked first; the committer publishes the files only when all are written."""
    export_lines(state, include_unchanged).write.mode("errorifexists").csv(path, header=True)
