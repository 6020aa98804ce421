"""Lane and region-product profiles, slow-lane flags, exposure and congestion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.functions.quantiles import exact_quantiles
from haulmark.params import LANE_MIN_ORDERS
from haulmark.session import staged

LANE_KEYS = ("current_factory", "region", "ship_mode")
PAIR_KEYS = ("region", "product_name")


def first_of_order(keys: Sequence[str]) -> Column:
    """1 for one line of every order in a group, else 0: its sum counts the group's distinct orders.

    The window is cut by order, so a hot group is spread over all tasks, and lines that were joined
    to their orders are already dealt that way.
    """
    one = Window.partitionBy("order_id", *keys).orderBy(F.lit(1))
    return (F.col("order_id").isNotNull() & (F.row_number().over(one) == 1)).cast("int")


def _measured(order_lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order count and lead, distance, unit and profit measures per group; null keys are kept.

    The lines are read once. They are first reduced to one row per (group, lead day), which
    combines on the map side whatever the skew. Means, sample deviation, the interpolated 90th
    percentile and the number of orders are then taken over at most one row per distinct day.
    """
    measures = {"distance": "distance_km", "units": "units", "profit": "gross_profit"}
    flagged = order_lines.select(*keys, "lead_time_days", *measures.values(),
                                 first_of_order(keys).alias("_first"))
    days = flagged.groupBy(*keys, "lead_time_days").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_first").alias("orders"),
        *[F.sum(c).alias(f"{m}_sum") for m, c in measures.items()],
        *[F.count(c).alias(f"{m}_n") for m, c in measures.items()])
    lead = F.col("lead_time_days").cast("double")
    n = F.when(lead.isNotNull(), F.col("n"))
    profile = days.groupBy(*keys).agg(
        F.sum("orders").alias("order_count"), F.sum(n).alias("lead_n"), F.sum(lead * n).alias("lead_sum"),
        F.sum(lead * lead * n).alias("lead_sq"),
        F.percentile(lead, F.lit(0.9), F.coalesce(n, F.lit(0))).alias("p90_lead"),
        *[(F.sum(f"{m}_sum") / F.nullif(F.sum(f"{m}_n"), F.lit(0))).alias(f"mean_{m}")
          for m in measures])
    mean = F.col("lead_sum") / F.nullif(F.col("lead_n"), F.lit(0))
    spread = F.greatest(F.col("lead_sq") - F.col("lead_sum") * mean, F.lit(0.0))
    std = F.when(F.col("lead_n") > 1, F.sqrt(spread / (F.col("lead_n") - 1)))
    return profile.select(
        *keys, "order_count", mean.alias("mean_lead"), "p90_lead",
        F.coalesce(std, F.lit(0.0)).alias("lead_std"), "mean_distance", "mean_units", "mean_profit",
        "lead_n", "lead_sum")


def group_profile(order_lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order count and mean measures per group."""
    return _measured(order_lines, keys).drop("lead_n", "lead_sum")


def lane_profile(order_lines: DataFrame) -> DataFrame:
    return group_profile(order_lines, LANE_KEYS)


def slow_routes(lanes: DataFrame, min_orders: int = LANE_MIN_ORDERS) -> DataFrame:
    """Flag slow lanes and size their exposure against the mean of lane means.

    ``slow_by_mean`` is the stricter flag that ignores the 90th percentile.
    """
    average = lanes.agg(F.avg("mean_lead").alias("a")).scalar()
    worst = F.greatest("mean_lead", "p90_lead")
    eligible = F.col("order_count") >= min_orders
    measured = lanes.withColumn("avg_lead", average)
    average = F.col("avg_lead")
    return measured.withColumns({
        "slow_route": F.coalesce(eligible & (worst > average), F.lit(False)),
        "slow_by_mean": F.coalesce(eligible & (F.col("mean_lead") > average), F.lit(False)),
        "exposure": F.greatest(worst - average, F.lit(0.0)) * F.col("order_count"),
        "min_orders_threshold": F.lit(min_orders)})


def by_exposure(lanes: DataFrame) -> DataFrame:
    return lanes.orderBy(F.desc("exposure"), *LANE_KEYS)


def top_exposure(lanes: DataFrame, k: int = 5) -> DataFrame:
    """The k slow lanes with the highest exposure."""
    return by_exposure(lanes.where("slow_route")).limit(k)


PAIR_MEASURES = ("order_count", "mean_lead", "p90_lead", "mean_units", "mean_profit")


def region_product_profile(order_lines: DataFrame) -> DataFrame:
    return _measured(order_lines, PAIR_KEYS).select(*PAIR_KEYS, *PAIR_MEASURES)


def congested_pairs(order_lines: DataFrame) -> DataFrame:
    """Flag pairs above the 75th percentile of volume and above the row-level mean lead.

    The profile is stored, so that the threshold, the overall mean and the flags share one scan.
    """
    profile = staged(_measured(order_lines, PAIR_KEYS), "pairs")
    pairs = profile.select(*PAIR_KEYS, *PAIR_MEASURES)
    volume = exact_quantiles(pairs, ["order_count"], [0.75]).select("quantile").scalar()
    overall = profile.agg(F.sum("lead_sum") / F.nullif(F.sum("lead_n"), F.lit(0))).scalar()
    limits = pairs.withColumns({"volume_threshold": volume, "overall_mean_lead": overall})
    return limits.withColumn("congested", F.coalesce(
        (F.col("order_count") > F.col("volume_threshold"))
        & (F.col("mean_lead") > F.col("overall_mean_lead")), F.lit(False)))


def by_congestion(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.desc("congested"), F.desc("order_count"), F.desc("mean_lead"), *PAIR_KEYS)
