"""Cleaning of all-text order lines: structure, duplicates, typing, rejection, imputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions.text import (blank_to_null, lead_days, normalize_product_name, parse_date,
                                     parse_number)
from haulmark.sources.orders import CORRUPT

HEADER_ID = "Row ID"  # fixed value: first header cell of the source
FINANCE = ("sales", "units", "gross_profit", "cost")


def _content(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != CORRUPT]


def is_header(row_id: str = "row_id") -> Column:
    """A repeated header row inside the data."""
    return F.col(row_id).eqNullSafe(HEADER_ID)


def is_blank(columns: list[str]) -> Column:
    """A row without any content."""
    return F.coalesce(*[blank_to_null(F.col(c)) for c in columns]).isNull()


def data_rows(raw: DataFrame) -> DataFrame:
    """Rows that are neither repeated headers nor blank."""
    content = _content(raw)
    return raw.select(*content).where(~is_header() & ~is_blank(content))


def collapse_copies(raw: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One row per distinct content, with the least row id and the number of ``copies``.

    The row id is a line number, not identity. The survivor is deterministic and copies combine on
    the map side, so a heavily copied row costs one row per task.
    """
    content = [c for c in raw.columns if c != row_id]
    return raw.groupBy(*content).agg(F.min(F.col(row_id).try_cast("bigint")).alias(row_id),
                                     F.count(F.lit(1)).alias("copies"))


def dedup_orders(raw: DataFrame) -> DataFrame:
    return collapse_copies(data_rows(raw))


def type_orders(rows: DataFrame) -> DataFrame:
    """Typed dates and amounts, with one flag per rejection reason.

    Amounts are parsed before a missing cost is imputed; a blank cost is missing, a cost that is
    not a number is a defect.
    """
    # Each text is parsed once; the flags only look at the parsed columns.
    dates = {c: parse_date(F.col(c)) for c in ("order_date", "ship_date")}
    amounts = {c: parse_number(F.col(c)) for c in FINANCE}
    typed = (rows.withColumn("cost_missing", blank_to_null(F.col("cost")).isNull())
             .withColumns({**dates, **amounts}))
    bad_finance = (F.col("sales").isNull() | F.col("units").isNull() | F.col("gross_profit").isNull()
                   | (~F.col("cost_missing") & F.col("cost").isNull()))
    return typed.withColumns({
        "bad_order_date": F.col("order_date").isNull(),
        "bad_ship_date": F.col("ship_date").isNull(), "bad_finance": bad_finance,
    }).withColumn("valid", ~(F.col("bad_order_date") | F.col("bad_ship_date")
                             | F.col("bad_finance")))


def rejected_rows(typed: DataFrame) -> DataFrame:
    """Rows that cannot be used, with the list of reasons."""
    reasons = F.array_compact(F.array(
        F.when(F.col("bad_order_date"), F.lit("order_date")),
        F.when(F.col("bad_ship_date"), F.lit("ship_date")),
        F.when(F.col("bad_finance"), F.lit("finance"))))
    return typed.where(~F.col("valid")).withColumn("reasons", reasons)


def finish_orders(typed: DataFrame) -> DataFrame:
    """Usable rows with imputed cost, canonical product name and lead time."""
    cost = F.coalesce("cost", F.col("sales") - F.col("gross_profit"))
    return (typed.where("valid")
            .withColumns({"cost": cost, "cost_imputed": F.col("cost").isNull(),
                          "product_name": normalize_product_name(F.col("product_name")),
                          "lead_time_days": lead_days(F.col("order_date"), F.col("ship_date"))})
            .drop("bad_order_date", "bad_ship_date", "bad_finance", "cost_missing", "valid"))


def clean_orders(raw: DataFrame) -> DataFrame:
    """From all-text rows to usable order lines."""
    return finish_orders(type_orders(dedup_orders(raw)))


def strict_dates(raw: DataFrame) -> DataFrame:
    """Parse both dates, failing the job on the first value that is not ``dd-MM-yyyy``."""
    return raw.withColumns({c: parse_date(F.col(c), strict=True)
                            for c in ("order_date", "ship_date")})
