"""Text, date and number parsing expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMAT = "dd-MM-yyyy"  # fixed value: source date layout

# Provinces that make a destination Canadian.
CANADIAN_PROVINCES = (
    "Alberta", "British Columbia", "Manitoba", "New Brunswick", "Newfoundland and Labrador",
    "Nova Scotia", "Ontario", "Prince Edward Island", "Quebec", "Saskatchewan",
)


def normalize_product_name(name: Column) -> Column:
    """One spelling per product: parts around hyphens trimmed and rejoined with ``' - '``."""
    return F.array_join(F.transform(F.split(name, "-"), lambda part: F.trim(part)), " - ")


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def finite(value: Column) -> Column:
    """NaN and infinities as null, so that Spark's aggregates skip them."""
    # NaN compares greater than infinity, so one comparison rules out both.
    return F.when(F.abs(value) < float("inf"), value)


def parse_date(text: Column, strict: bool = False) -> Column:
    """``dd-MM-yyyy`` text as a date. A bad value raises if ``strict``, else becomes null."""
    if strict:
        return F.to_date(text, DATE_FORMAT)
    return F.try_to_date(text, DATE_FORMAT)


def parse_number(text: Column) -> Column:
    """Text as a double; a value that is not a finite number becomes null."""
    return finite(text.try_cast("double"))


def lead_days(order_date: Column, ship_date: Column) -> Column:
    """Whole days from order to shipment."""
    return F.datediff(ship_date, order_date)


def calendar_days(start: Column, end: Column) -> Column:
    """Whole days between the UTC calendar dates of two instants, whatever the session zone."""
    def utc_date(instant: Column) -> Column:
        return F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"),
                                            instant.cast("timestamp_ntz")))
    return F.datediff(utc_date(end), utc_date(start))


def is_canadian(province: Column, provinces: Sequence[str] = CANADIAN_PROVINCES) -> Column:
    return F.coalesce(province.isin(*provinces), F.lit(False))


def calendar_features(date: Column) -> dict[str, Column]:
    """Month, quarter, weekday (Monday = 0) and weekend flag of a date."""
    return {"month": F.month(date), "quarter": F.quarter(date), "weekday": F.weekday(date),
            "weekend": F.weekday(date) >= 5}
