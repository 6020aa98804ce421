"""Counterfactual moves: what making a product at another factory does to distance, days and money.

Everything here starts from ``order_cells``, one aggregation of the order lines. Distance depends on
(product, destination, factory) only, so the factory expansion happens on the cells and never on
the lines.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions.portable import is_holdout
from haulmark.operators.derive import each_factory, with_distance
from haulmark.operators.lanes import first_of_order
from haulmark.params import Network
from haulmark.sources.dims import factories

CELL_KEYS = ("product_name", "division", "current_factory", "region", "state", "lat", "lon",
             "ship_mode", "is_holdout")


def order_cells(order_lines: DataFrame) -> DataFrame:
    """Sums per product, destination, ship mode and hold-out side, in one scan of the lines.

    ``weight`` counts a line's units, at least 1. ``orders`` counts an order in the cell of one of
    its product's lines, so that the sum over a product's cells is its number of distinct orders. The
    hold-out side is the lines' own ``is_holdout``, or a hash of their numeric keys.
    """
    weight = F.greatest(F.col("units"), F.lit(1.0))
    lead = F.col("lead_time_days").cast("double")
    side = (F.col("is_holdout") if "is_holdout" in order_lines.columns
            else is_holdout(F.col("order_id"), F.col("line_key")))
    marked = order_lines.withColumns({"is_holdout": side,
                                      "_first": first_of_order(["product_name"])})
    return marked.groupBy(*CELL_KEYS).agg(
        F.count(F.lit(1)).alias("lines"), F.count("lead_time_days").alias("lead_n"),
        F.sum(lead).alias("lead_sum"), F.sum(lead * lead).alias("lead_sq"),
        F.sum(weight).alias("weight"), F.sum("units").alias("units"),
        F.sum("gross_profit").alias("gross_profit"), F.sum("_first").alias("orders"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0.0))


def sample_std(n: Column, total: Column, squares: Column) -> Column:
    """Sample deviation from a count, a sum and a sum of squares; null below two values."""
    spread = F.greatest(squares - total * total / F.nullif(n, F.lit(0)), F.lit(0.0))
    return F.when(n > 1, F.sqrt(spread / (n - 1)))


def candidate_moves(cells: DataFrame, network: Network) -> DataFrame:
    """One row per (product, other factory) with everything that is measured, nothing assumed."""
    products = with_distance(cells, network, name="current_distance_km")
    every = each_factory(products, network)
    moves = (every.where(F.col("candidate_factory") != F.col("current_factory"))
             .groupBy("product_name", "division", "current_factory", "candidate_factory",
                      "candidate_setup_cost")
             .agg(F.sum("lines").alias("lines"), F.sum("units").alias("units"),
                  F.sum("gross_profit").alias("gross_profit"),
                  weighted_mean(F.col("current_distance_km"), F.col("weight"))
                  .alias("current_distance_km"),
                  weighted_mean(F.col("candidate_distance_km"), F.col("weight"))
                  .alias("candidate_distance_km"),
                  F.sum("lead_n").alias("lead_n"), F.sum("lead_sum").alias("lead_sum"),
                  F.sum("lead_sq").alias("lead_sq")))
    own = factories(cells.sparkSession, network).select(
        F.col("factory").alias("current_factory"), F.col("setup_cost").alias("_own_setup"))
    setup = F.col("candidate_setup_cost") - F.col("_own_setup")
    moves = moves.join(own, "current_factory", "left").withColumns({
        "delta_distance_km": F.col("candidate_distance_km") - F.col("current_distance_km"),
        "setup_net": setup,
        "baseline_lead_days": F.col("lead_sum") / F.nullif(F.col("lead_n"), F.lit(0)),
        "lead_std": F.coalesce(sample_std(F.col("lead_n"), F.col("lead_sum"), F.col("lead_sq")),
                               F.lit(0.0))}).drop("lead_n", "lead_sum", "lead_sq", "_own_setup")
    return (with_capability_gap(moves, cells)
            .join(product_orders(cells), "product_name"))


def product_orders(cells: DataFrame) -> DataFrame:
    """Distinct orders per product."""
    return cells.groupBy("product_name").agg(F.sum("orders").alias("orders"))


def with_capability_gap(moves: DataFrame, cells: DataFrame) -> DataFrame:
    """Flag candidates that have never produced the product's division."""
    produced = cells.select(F.col("current_factory").alias("candidate_factory"), "division",
                            F.lit(True).alias("_made")).distinct()
    return (moves.join(produced, ["candidate_factory", "division"], "left")
            .withColumn("capability_gap", F.col("_made").isNull()).drop("_made"))


def price_moves(moves: DataFrame, a: Mapping[str, Column]) -> DataFrame:
    """Days and money under the assumptions ``a`` (literals, or columns of a sweep)."""
    delta = F.col("delta_distance_km")
    freight = (F.col("units") * delta / 1000) * a["freight_cost_per_unit_per_1000km"]
    lead_change = delta / a["freight_speed_km_day"]
    cost = freight + F.col("setup_net")
    return moves.withColumns({
        "delta_lead_days": lead_change, "lead_gain_days": -lead_change,
        "new_lead_days": F.col("baseline_lead_days") + lead_change,
        "freight_delta": freight, "delta_cost": cost, "profit_impact": -cost,
        "new_profit": F.col("gross_profit") - cost})


def gate_moves(priced: DataFrame, a: Mapping[str, Column]) -> DataFrame:
    """Evidence and materiality gates, their label, the gap to material and the break-even speed."""
    evidence = F.coalesce(F.col("orders") >= a["min_orders_for_recommendation"], F.lit(False))
    material = F.coalesce(F.col("lead_gain_days") >= a["min_material_days"], F.lit(False))
    gate = (F.when(evidence & material, "actionable").when(evidence, "materiality_only")
            .when(material, "evidence_only").otherwise("both"))
    return priced.withColumns({
        "sufficient_evidence": evidence, "materially_better": material, "gate_result": gate,
        "material_gap_days": F.col("lead_gain_days") - a["min_material_days"],
        "breakeven_speed_km_day": -F.col("delta_distance_km")
        / F.nullif(a["min_material_days"], F.lit(0.0))})


def reducing(moves: DataFrame) -> DataFrame:
    """Moves that shorten the weighted distance."""
    return moves.where(F.col("delta_distance_km") < 0)


def negative_impact(priced: DataFrame) -> DataFrame:
    return priced.where(F.col("profit_impact") < 0)


def breakeven_shortlist(gated: DataFrame) -> DataFrame:
    """Well evidenced gains that are not yet material, the easiest speed first."""
    return (gated.where((F.col("gate_result") == "materiality_only")
                        & (F.col("lead_gain_days") > 0))
            .orderBy(F.desc("breakeven_speed_km_day"), "product_name", "candidate_factory"))


def priority_ranking(priced: DataFrame, priority: float) -> DataFrame:
    """Raw score: ``priority`` x days gained + (1 - ``priority``) x money gained."""
    score = F.col("lead_gain_days") * priority + F.col("profit_impact") * (1 - priority)
    return priced.withColumn("priority_score", score).orderBy(
        F.desc("priority_score"), "product_name", "candidate_factory")


def factory_days(cells: DataFrame, network: Network, predictor, weighted: bool = True) -> DataFrame:
    """Mean predicted days per product and factory, the incumbent included.

    ``predictor`` maps a frame with ``factory`` and ``distance_km`` to one with ``predicted_days``;
    it runs on the distinct cells, not on order lines. The mean is weighted by units or, with
    ``weighted=False``, by lines.
    """
    grid = (each_factory(cells, network, "factory")
            .withColumnRenamed("candidate_distance_km", "distance_km"))
    weight = F.col("weight") if weighted else F.col("lines").cast("double")
    return (predictor(grid).groupBy("product_name", "current_factory", "factory")
            .agg(weighted_mean(F.col("predicted_days"), weight).alias("days"),
                 weighted_mean(F.col("distance_km"), weight).alias("distance_km"),
                 F.sum("units").alias("units"), F.sum("gross_profit").alias("gross_profit"))
            .withColumn("is_incumbent", F.col("factory") == F.col("current_factory")))


def simulate_reallocation(days: DataFrame, rate: float) -> DataFrame:
    """Each alternative against its incumbent: days reduced, profit impact, what-if profit."""
    base = days.where("is_incumbent").select(
        "product_name", F.col("days").alias("baseline_days"),
        F.col("distance_km").alias("current_distance_km"))
    penalty = F.col("units") * F.col("distance_delta") / 1000 * rate
    return (days.where(~F.col("is_incumbent")).join(base, "product_name")
            .withColumn("distance_delta", F.col("distance_km") - F.col("current_distance_km"))
            .select("product_name", "current_factory", F.col("factory").alias("candidate_factory"),
                    "current_distance_km", F.col("distance_km").alias("candidate_distance_km"),
                    "baseline_days", F.col("days").alias("new_days"),
                    (F.col("baseline_days") - F.col("days")).alias("days_reduced"), "gross_profit",
                    (-penalty).alias("profit_impact"),
                    (F.col("gross_profit") - penalty).alias("whatif_profit")))
