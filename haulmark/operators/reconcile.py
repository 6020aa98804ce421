"""Comparison of two result tables: changed picks, label matches, tolerances, one-row verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-10  # fixed value: numeric agreement of stored and computed rows


def scenario_flips(left: DataFrame, right: DataFrame, key: str = "product_name",
                   pick: str = "candidate_factory") -> DataFrame:
    """Keys whose pick differs between two scenarios, including keys only one of them has."""
    a = left.select(key, F.col(pick).alias("left_pick"))
    b = right.select(key, F.col(pick).alias("right_pick"))
    return a.join(b, key, "full").where(~F.col("left_pick").eqNullSafe(F.col("right_pick")))


def set_difference(left: DataFrame, right: DataFrame, key: str = "product_name") -> DataFrame:
    """Distinct keys of the left table that the right one lacks."""
    return left.select(key).subtract(right.select(key))


def reconcile(computed: DataFrame, stored: DataFrame, keys: Sequence[str], labels: Sequence[str],
              measures: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Per key, whether labels are equal and measures agree within the tolerance.

    A key that only one side has appears with ``present`` false and never matches.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*keys, F.lit(True).alias(f"_{tag}"),
                         *[F.col(c).alias(f"{tag}_{c}") for c in (*labels, *measures)])

    both = side(computed, "computed").join(side(stored, "stored"), list(keys), "full")
    present = F.coalesce(F.col("_computed") & F.col("_stored"), F.lit(False))
    same = F.lit(True)
    for c in labels:
        same = same & F.col(f"computed_{c}").eqNullSafe(F.col(f"stored_{c}"))
    close = F.lit(True)
    for c in measures:
        x, y = F.col(f"computed_{c}"), F.col(f"stored_{c}")
        close = close & F.coalesce(F.abs(x - y) < tolerance, x.isNull() & y.isNull())
    return (both.withColumn("present", present)
            .withColumn("labels_match", present & same)
            .withColumn("within_tolerance", present & close)
            .drop("_computed", "_stored"))


def verdict(reconciled: DataFrame) -> DataFrame:
    """One row: keys compared, matches, and whether everything agrees."""
    ok = F.col("present") & F.col("labels_match") & F.col("within_tolerance")
    return reconciled.agg(
        F.count(F.lit(1)).alias("keys"), F.count_if("present").alias("present"),
        F.count_if("labels_match").alias("labels_match"),
        F.count_if("within_tolerance").alias("within_tolerance"),
        F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_match"))
