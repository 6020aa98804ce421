"""Slices of the order lines and of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_slice(order_lines: DataFrame, product: str, regions: Sequence[str],
                ship_modes: Sequence[str]) -> DataFrame:
    """Lines of one product, limited to some regions and ship modes."""
    return order_lines.where((F.col("product_name") == product)
                             & F.col("region").isin(*regions)
                             & F.col("ship_mode").isin(*ship_modes))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The frame itself, or a ``ValueError`` if it is empty. Looks at one row."""
    if df.isEmpty():
        raise ValueError(f"no order lines match {what}")
    return df


def domain(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column in order."""
    return df.select(column).distinct().orderBy(column)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("rows"), column))


def best_row(df: DataFrame, value: str, tie: str) -> DataFrame:
    """The row with the highest value; ties go to the first name."""
    return df.orderBy(F.desc_nulls_last(value), tie).limit(1)
