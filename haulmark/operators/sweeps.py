"""Parameter sweeps: every setting is a row, so a whole sweep is one job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.operators.ranking import flag_top_pick, score_moves, top_picks
from haulmark.params import Assumptions, scenario_columns

# Swept assumptions, their settings and category, in sweep order.
SWEEPS = (
    ("freight_speed_km_day", tuple(range(400, 1601, 50)), "dashboard_slider"),
    ("freight_cost_per_unit_per_1000km", tuple(i / 100 for i in range(5, 31)), "dashboard_slider"),
    ("min_orders_for_recommendation", tuple(range(1, 21)), "config_gate_assumption"),
    ("min_material_days", tuple(i / 20 for i in range(0, 31)), "config_gate_assumption"),
    ("capability_gap_penalty", tuple(i / 20 for i in range(0, 21)), "config_scoring_assumption"),
)
WEIGHTS = tuple(i / 20 for i in range(21))
SPEEDS = tuple(range(400, 1601, 50))


def _settings(a: Assumptions, sweeps: Iterable[tuple[str, Sequence[float], str]]) -> Column:
    """The whole grid as one literal array of (trial, assumption, value, category, assumptions)."""
    rows = [(name, float(v), kind) for name, values, kind in sweeps for v in values]
    return F.array(*[a.replace(**{name: v}).struct(
        trial=F.lit(i), assumption=F.lit(name), value=F.lit(v), category=F.lit(kind))
        for i, (name, v, kind) in enumerate(rows)])


def sweep_picks(moves: DataFrame, a: Assumptions,
                sweeps: Iterable[tuple[str, Sequence[float], str]]) -> DataFrame:
    """The top pick per trial and product."""
    each = moves.withColumn("scenario", F.explode(_settings(a, sweeps)))
    each = each.withColumns({n: F.col("scenario")[n]
                             for n in ("trial", "assumption", "value", "category")})
    scored = score_moves(each, scenario_columns("scenario"),
                         ["trial", "assumption", "value", "category"])
    return top_picks(scored, ["trial", "assumption", "value", "category", "product_name"])


TRIAL = ("trial", "assumption", "value", "category")


def actionable_rows(picks: DataFrame, by: Sequence[str] = TRIAL) -> DataFrame:
    """The actionable picks, a row per trial and product, in the order of their keys."""
    return (picks.where(F.col("gate_result") == "actionable")
            .select(*by, "product_name", "candidate_factory", "orders", "lead_gain_days",
                    "profit_impact").orderBy(*by[:1], "product_name"))


def trial_summary(picks: DataFrame, target: int) -> DataFrame:
    """Number of actionable products per trial and whether it equals the target."""
    go = F.col("gate_result") == "actionable"
    return (picks.groupBy(*TRIAL).agg(F.count_if(go).alias("actionable_count"))
            .withColumn("matches_target", F.col("actionable_count") == target))


def weight_changes(moves: DataFrame, a: Assumptions, weights: Sequence[float] = WEIGHTS
                   ) -> DataFrame:
    """(speed_weight, product, pick, change) for every way a product differs from the default weight:
    actionable now, flipped to another factory, entering or leaving the actionable set.

    The default is one more scenario of the same job; each product's picks under all weights meet
    their default pick on the product. A product without a change has a row with a null change.
    """
    picks = sweep_picks(moves, a, [("speed_weight", [a.speed_weight, *weights], "weight")])
    default = picks.where("trial = 0").select(
        "product_name", F.col("candidate_factory").alias("default_factory"),
        (F.col("gate_result") == "actionable").alias("was"))
    swept = picks.where("trial > 0").select(
        F.col("value").alias("speed_weight"), "product_name", "candidate_factory",
        (F.col("gate_result") == "actionable").alias("now"))
    both = swept.join(default, "product_name", "left")
    flip = ~F.col("candidate_factory").eqNullSafe(F.col("default_factory"))
    was = F.coalesce("was", F.lit(False))
    changes = F.array_compact(F.array(
        F.when(F.col("now"), "actionable"), F.when(flip, "flipped"),
        F.when(F.col("now") & ~was, "entering"), F.when(~F.col("now") & was, "leaving")))
    return both.select("speed_weight", "product_name", "candidate_factory",
                       F.explode_outer(changes).alias("change"))


def weight_sweep(moves: DataFrame, a: Assumptions, target: int, weights: Sequence[float] = WEIGHTS
                 ) -> DataFrame:
    """Numbers of actionable, flipped, entering and leaving products per speed weight."""
    def count(change: str) -> Column:
        return F.count_if(F.col("change") == change)

    return (weight_changes(moves, a, weights).groupBy("speed_weight")
            .agg(count("actionable").alias("actionable_count"), count("flipped").alias("flip_count"),
                 count("entering").alias("entering_count"), count("leaving").alias("leaving_count"))
            .withColumn("matches_target", F.col("actionable_count") == target))


def speed_sweep(moves: DataFrame, a: Assumptions, target: int, speeds: Sequence[float] = SPEEDS
                ) -> DataFrame:
    picks = sweep_picks(moves, a, [("freight_speed_km_day", speeds, "dashboard_slider")])
    return (trial_summary(picks, target).withColumnRenamed("value", "freight_speed_km_day")
            .drop("trial", "assumption", "category"))


def assumption_sweep(moves: DataFrame, a: Assumptions, target: int, sweeps=SWEEPS) -> DataFrame:
    """One assumption at a time over its grid; ``first_hit`` marks the first trial at the target.

    The whole grid is evaluated; the order of trials replaces stopping early. The first hit is a
    window over the few trials.
    """
    trials = trial_summary(sweep_picks(moves, a, sweeps), target)
    first = F.min(F.when(F.col("matches_target"), F.col("trial"))).over(Window.partitionBy())
    return trials.withColumn("first_hit", F.coalesce(F.col("trial") == first, F.lit(False)))


def names_by_factory(picks: DataFrame) -> DataFrame:
    """Per recommended factory and gate, the number of picks and their names in order, joined by '; '.

    A factory's list is as long as the products picked for it under one gate; as rows they are
    :func:`actionable_rows`.
    """
    return picks.groupBy("candidate_factory", "gate_result").agg(
        F.count(F.lit(1)).alias("products"),
        F.array_join(F.array_sort(F.collect_list("product_name")), "; ").alias("product_names"))


def compare_bases(first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    """The same candidates scored on two distance bases: deltas, gates, top-pick flags, change."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return flag_top_pick(df).select(
            "product_name", "candidate_factory",
            F.col("delta_distance_km").alias(f"delta_km_{name}"),
            F.col("gate_result").alias(f"gate_{name}"), F.col("score").alias(f"score_{name}"),
            F.col("is_top_scored_pick").alias(f"top_{name}"))

    a, b = names
    return (side(first, a).join(side(second, b), ["product_name", "candidate_factory"], "full")
            .withColumn("gate_changed", ~F.col(f"gate_{a}").eqNullSafe(F.col(f"gate_{b}"))))
