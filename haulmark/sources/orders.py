"""Delimited-text order lines: scan, required columns, column names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Source header and the column name each one gets.
SOURCE_COLUMNS = {
    "Row ID": "row_id", "Order ID": "order_id", "Order Date": "order_date",
    "Ship Date": "ship_date", "Ship Mode": "ship_mode", "Customer ID": "customer_id",
    "Country/Region": "country", "City": "city", "State/Province": "state",
    "Postal Code": "postal_code", "Division": "division", "Region": "region",
    "Product ID": "product_id", "Product Name": "product_name", "Sales": "sales",
    "Units": "units", "Gross Profit": "gross_profit", "Cost": "cost",
}
CORRUPT = "_corrupt_record"


def text_schema(names: Iterable[str], corrupt: bool = False) -> T.StructType:
    """Every column as text; typing is a separate, audited step."""
    fields = [T.StructField(n, T.StringType()) for n in names]
    if corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType()))
    return T.StructType(fields)


def missing_columns(df: DataFrame, required: Iterable[str] = tuple(SOURCE_COLUMNS)) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str] = tuple(SOURCE_COLUMNS)) -> DataFrame:
    """The frame itself, or a ``ValueError`` naming what is missing, before anything runs."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    return df


def rename_columns(df: DataFrame) -> DataFrame:
    """Source headers as snake_case."""
    return df.withColumnsRenamed({k: v for k, v in SOURCE_COLUMNS.items() if k in df.columns})


def scan_order_lines(spark: SparkSession, path: str, columns: Iterable[str] | None = None,
                     sep: str = ",", keep_corrupt: bool = False) -> DataFrame:
    """Scan delimited order lines as text with snake_case names.

    The header of the files is read first (one line) and checked for the required columns. With
    ``keep_corrupt``, the raw text of rows with too many or too few fields is kept in
    ``_corrupt_record``.
    """
    header = spark.read.option("header", True).option("sep", sep).csv(path).columns
    names = list(columns or header)
    reader = (spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
              .option("enforceSchema", True))
    if keep_corrupt:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    frame = reader.schema(text_schema(names, keep_corrupt)).csv(path)
    return rename_columns(require_columns(frame))


def field_count_drift(raw: DataFrame) -> DataFrame:
    """One row: rows read, and rows whose field count differed from the header's.

    Needs a scan with ``keep_corrupt=True``.
    """
    # All fields are read, since a pruned scan would not notice that one is missing.
    content = F.concat_ws("", *[c for c in raw.columns if c != CORRUPT])
    drifted = F.col(CORRUPT).isNotNull() & (F.length(content) >= 0)
    return raw.agg(F.count(F.lit(1)).alias("rows"), F.count_if(drifted).alias("drifted_rows"))
