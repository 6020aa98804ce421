"""Factory load, capacity and assignment audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.params import Network
from haulmark.sources.dims import factories


def _current(cells: DataFrame, network: Network) -> DataFrame:
    """Units made per factory today, one row per site of the network."""
    made = cells.groupBy(F.col("current_factory").alias("factory")).agg(
        F.sum("units").alias("current_units"))
    sites = factories(cells.sparkSession, network).select("factory")
    return sites.join(made, "factory", "left").select(
        "factory", F.coalesce("current_units", F.lit(0.0)).alias("current_units"))


def factory_load(cells: DataFrame, picks: DataFrame, network: Network, multiplier: float
                 ) -> DataFrame:
    """Units in and out of each factory under the picks, against a multiple of today's units."""
    moved = picks.where(F.col("candidate_factory") != F.col("current_factory"))
    both = F.explode(F.array(
        F.struct(F.col("current_factory").alias("factory"), F.col("units").alias("out"),
                 F.lit(0.0).alias("in")),
        F.struct(F.col("candidate_factory").alias("factory"), F.lit(0.0).alias("out"),
                 F.col("units").alias("in"))))
    flows = (moved.select(both.alias("f")).groupBy("f.factory")
             .agg(F.sum("f.out").alias("units_out"), F.sum("f.in").alias("units_in")))
    zero = F.lit(0.0)
    return (_current(cells, network).join(flows, "factory", "left")
            .select("factory", "current_units",
                    (F.col("current_units") * multiplier).alias("capacity"),
                    F.coalesce("units_in", zero).alias("units_in"),
                    F.coalesce("units_out", zero).alias("units_out"))
            .withColumn("new_units", F.col("current_units") + F.col("units_in")
                        - F.col("units_out"))
            .withColumn("headroom", F.col("capacity") - F.col("new_units")))


def assignment_audit(plan: DataFrame, cells: DataFrame, network: Network, multiplier: float
                     ) -> DataFrame:
    """Load of a plan ``(product_name, factory, units)`` per factory, against capacity and today."""
    today = cells.select("product_name", "current_factory").distinct()
    load = (plan.join(today, "product_name", "left").groupBy("factory")
            .agg(F.sum("units").alias("assigned_units"),
                 F.count("product_name").alias("products"),
                 F.count_if(F.col("factory") != F.col("current_factory")).alias("moved_products")))
    zero = F.lit(0)
    return (_current(cells, network).join(load, "factory", "left")
            .select("factory", "current_units",
                    (F.col("current_units") * multiplier).alias("capacity"),
                    F.coalesce("assigned_units", F.lit(0.0)).alias("assigned_units"),
                    F.coalesce("products", zero).alias("products"),
                    F.coalesce("moved_products", zero).alias("moved_products"))
            .withColumn("over_capacity", F.col("assigned_units") > F.col("capacity")))
