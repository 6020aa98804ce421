"""Move risk: four components, their weighted total and a level."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions.portable import uniform
from haulmark.operators.moves import sample_std
from haulmark.params import MONTE_CARLO_ITERATIONS, RATE_RANGE, Assumptions, RiskWeights

RATE_STREAM = 7  # fixed value: second key of the freight-rate draws
COMPONENTS = ("negProfit", "predVariance", "lowSupport", "distanceShift")  # fixed values
COMPONENT_SCHEMA = "struct<" + ",".join(f"{c}:double" for c in COMPONENTS) + ">"


def rate_draw(draw: Column) -> Column:
    """The freight rate of a numbered draw, uniform over the rate range."""
    low, high = RATE_RANGE
    return uniform(draw, RATE_STREAM) * (high - low) + low


def baseline_residuals(cells: DataFrame) -> DataFrame:
    """Held-out residual moments per product, the prediction being its ship mode's training mean.

    Count, sum and sum of squares of the residuals follow from the cells' sums, so no line is read
    again.
    """
    train = (cells.where(~F.col("is_holdout")).groupBy("ship_mode")
             .agg((F.sum("lead_sum") / F.nullif(F.sum("lead_n"), F.lit(0))).alias("mode_mean")))
    test = (cells.where("is_holdout").groupBy("product_name", "ship_mode")
            .agg(F.sum("lead_n").alias("n"), F.sum("lead_sum").alias("s"),
                 F.sum("lead_sq").alias("q")).join(train, "ship_mode"))
    mean = F.col("mode_mean")
    return test.groupBy("product_name").agg(
        F.sum("n").alias("n"), F.sum(F.col("s") - mean * F.col("n")).alias("r"),
        F.sum(F.col("q") - mean * 2 * F.col("s") + mean * mean * F.col("n")).alias("rr"),
        F.sum("s").alias("s"), F.sum("q").alias("q"))


def overall_std(moments: DataFrame) -> Column:
    """Deviation of all held-out residuals, as a scalar."""
    return moments.agg(sample_std(F.sum("n"), F.sum("r"), F.sum("rr")).alias("g")).scalar()


def residual_std(moments: DataFrame) -> DataFrame:
    """Residual deviation and hold-out count per product; below two rows the global deviation."""
    own = sample_std(F.col("n"), F.col("r"), F.col("rr"))
    return moments.select("product_name",
                          F.coalesce(own, overall_std(moments)).alias("residual_std"),
                          F.col("n").alias("holdout_count"))


def holdout_score(moments: DataFrame) -> DataFrame:
    """One row: R2 and RMSE of the predictor behind the moments."""
    t = moments.agg(F.sum("n").alias("n"), F.sum("rr").alias("rr"), F.sum("s").alias("s"),
                    F.sum("q").alias("q"))
    spread = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return t.select((F.lit(1.0) - F.col("rr") / F.nullif(spread, F.lit(0.0))).alias("r2"),
                    F.sqrt(F.col("rr") / F.nullif(F.col("n"), F.lit(0))).alias("rmse"))


def with_residuals(moves: DataFrame, residuals: DataFrame, default: Column) -> DataFrame:
    """Attach residual deviations; a product without any gets the default."""
    return (moves.join(residuals.select("product_name", "residual_std"), "product_name", "left")
            .withColumn("residual_std", F.coalesce("residual_std", default)))


def risk_inputs(moves: DataFrame, a: Assumptions, draws: int = MONTE_CARLO_ITERATIONS) -> DataFrame:
    """Risk components that do not depend on a sweep: negProfit, predVariance, distanceShift.

    The rate draws are an array inside the row, so Monte Carlo adds neither rows nor a shuffle.
    """
    penalty = F.when(F.col("capability_gap"), F.greatest(F.col("candidate_setup_cost"), F.lit(0.0))
                     * (a.capability_transition_multiple - 1)).otherwise(0.0)
    haul = F.col("units") * F.col("delta_distance_km") / 1000
    fixed = F.col("setup_net") + penalty
    rates = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), rate_draw)
    losing = F.size(F.filter(rates, lambda r: haul * r + fixed > 0))
    top = moves.agg(F.struct(F.max("residual_std").alias("std"),
                             F.max(F.abs("delta_distance_km")).alias("shift"))).scalar()
    std, shift = F.nullif(F.col("_top.std"), F.lit(0.0)), F.nullif(F.col("_top.shift"), F.lit(0.0))
    return moves.withColumn("_top", top).withColumns({
        "neg_profit": losing.cast("double") / draws,
        "pred_variance": F.coalesce(F.col("residual_std") / std, F.lit(0.0)),
        "distance_shift": F.coalesce(F.abs("delta_distance_km") / shift, F.lit(0.0))}).drop("_top")


def with_risk(moves: DataFrame, a: Mapping[str, Column], w: RiskWeights = RiskWeights()
              ) -> DataFrame:
    """Support shortfall, weighted total and level."""
    needed = F.nullif(a["min_orders_for_recommendation"], F.lit(0.0))
    support = F.greatest(F.lit(0.0), F.coalesce(F.lit(1.0) - F.col("orders") / needed, F.lit(0.0)))
    scored = moves.withColumn("low_support", support).withColumn(
        "risk_score", F.col("neg_profit") * w.neg_profit + F.col("pred_variance") * w.pred_variance
        + F.col("low_support") * w.low_support + F.col("distance_shift") * w.distance_shift)
    level = (F.when(F.col("risk_score") > w.high, "High")
             .when(F.col("risk_score") > w.medium, "Medium").otherwise("Low"))
    return scored.withColumn("risk_level", level)


def components() -> Column:
    """The four components as a struct under their published names."""
    columns = ("neg_profit", "pred_variance", "low_support", "distance_shift")
    return F.struct(*[F.col(c).alias(n) for c, n in zip(columns, COMPONENTS, strict=True)])


def encode_components(scored: DataFrame) -> DataFrame:
    return scored.withColumn("risk_components", F.to_json(components()))


def decode_components(df: DataFrame, cell: str = "risk_components") -> DataFrame:
    """Components read back from JSON text, and whether all four are present."""
    keys = F.json_object_keys(cell)
    have = F.size(F.array_intersect(keys, F.array(*[F.lit(c) for c in COMPONENTS])))
    return df.withColumns({"components": F.from_json(cell, COMPONENT_SCHEMA),
                           "complete": F.coalesce(have == len(COMPONENTS), F.lit(False))})
