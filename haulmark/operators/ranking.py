"""Scores, picks and recommendations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.operators.moves import gate_moves, price_moves
from haulmark.operators.risk import with_risk
from haulmark.params import TOP_N, RiskWeights

# Evidence saturates at 100 orders; confidence mixes evidence and stability.
EVIDENCE_FULL = 100
EVIDENCE_SHARE, STABILITY_SHARE, GAP_POINTS = 0.65, 0.35, 20.0


def evidence_score(orders: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(orders) / F.log(F.lit(EVIDENCE_FULL + 1.0)))


def stability_score(mean: Column, std: Column) -> Column:
    """``1 / (1 + cv)``; 0 for a zero mean."""
    cv = std / F.nullif(F.abs(mean), F.lit(0.0))
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + cv), F.lit(0.0))


def confidence(evidence: Column, stability: Column, gap: Column) -> Column:
    return ((evidence * EVIDENCE_SHARE + stability * STABILITY_SHARE) * 100
            - F.when(gap, GAP_POINTS).otherwise(0.0))


def min_max(value: Column, group: Window) -> Column:
    """Value scaled over its group and the incumbent's zero; 0 if all are equal."""
    low = F.least(F.min(value).over(group), F.lit(0.0))
    high = F.greatest(F.max(value).over(group), F.lit(0.0))
    return F.coalesce((value - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))


def with_score(moves: DataFrame, a: Mapping[str, Column], by: Sequence[str] = ("product_name",)
               ) -> DataFrame:
    """Objective, confidence and score. A group holds at most one row per factory."""
    group = Window.partitionBy(*by)
    days, money = min_max(F.col("lead_gain_days"), group), min_max(F.col("profit_impact"), group)
    calm = min_max(-F.col("risk_score"), group)
    w, rw = a["speed_weight"], a["risk_weight"]
    one = F.lit(1.0)
    scored = moves.withColumns({
        "objective": (one - rw) * (w * days + (one - w) * money) + rw * calm,
        "evidence_score": evidence_score(F.col("orders")),
        "stability_score": stability_score(F.col("baseline_lead_days"), F.col("lead_std"))})
    sure = confidence(F.col("evidence_score"), F.col("stability_score"), F.col("capability_gap"))
    discount = F.when(F.col("capability_gap"), one - a["capability_gap_penalty"]).otherwise(one)
    return scored.withColumn("confidence", sure).withColumn(
        "score", F.col("objective") * F.col("confidence") / 100 * discount)


def score_moves(moves: DataFrame, a: Mapping[str, Column], scenario: Sequence[str] = (),
                weights: RiskWeights = RiskWeights()) -> DataFrame:
    """Price, gate, assess and score every candidate under literal or per-scenario assumptions.

    ``moves`` carries the risk inputs; ``scenario`` names the columns that tell scenarios apart.
    """
    gated = gate_moves(price_moves(moves, a), a)
    return with_score(with_risk(gated, a, weights), a, [*scenario, "product_name"])


def rank_within(df: DataFrame, by: Sequence[str], name: str = "pick_rank") -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "candidate_factory")
    return df.withColumn(name, F.row_number().over(order))


def top_picks(scored: DataFrame, by: Sequence[str] = ("product_name",)) -> DataFrame:
    """The best-scored candidate per group."""
    return rank_within(scored, by).where("pick_rank = 1").drop("pick_rank")


def flag_top_pick(scored: DataFrame, by: Sequence[str] = ("product_name",)) -> DataFrame:
    return (rank_within(scored, by).withColumn("is_top_scored_pick", F.col("pick_rank") == 1)
            .drop("pick_rank"))


def recommend(scored: DataFrame, by: Sequence[str] = ("product_name",)) -> DataFrame:
    """One row per product: its best distance-reducing move, or an explicit retain row.

    The retain row is the product's first row turned into its incumbent, so every product is
    counted and no second pass over the candidates is needed.
    """
    better = F.col("delta_distance_km") < 0
    order = Window.partitionBy(*by).orderBy(F.desc(better), F.desc("score"), "candidate_factory")
    first = (scored.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
             .withColumn("is_retain", ~better))
    zero = ["delta_distance_km", "delta_lead_days", "lead_gain_days", "freight_delta", "delta_cost",
            "profit_impact", "risk_score", "objective", "score"]
    kept = {c: F.when(F.col("is_retain"), 0.0).otherwise(F.col(c)) for c in zero}
    kept["candidate_factory"] = F.when(F.col("is_retain"), F.col("current_factory")).otherwise(
        F.col("candidate_factory"))
    kept["new_lead_days"] = F.when(F.col("is_retain"), F.col("baseline_lead_days")).otherwise(
        F.col("new_lead_days"))
    kept["risk_level"] = F.when(F.col("is_retain"), "Low").otherwise(F.col("risk_level"))
    kept["capability_gap"] = F.col("capability_gap") & ~F.col("is_retain")
    return first.withColumns(kept)


def retained_products(moves: DataFrame) -> DataFrame:
    """Products without any distance-reducing alternative."""
    every = moves.select("product_name", "current_factory").distinct()
    return every.join(moves.where(F.col("delta_distance_km") < 0), "product_name", "left_anti")


def movable_products(moves: DataFrame) -> DataFrame:
    """Products with at least one distance-reducing alternative."""
    every = moves.select("product_name", "current_factory").distinct()
    return every.join(moves.where(F.col("delta_distance_km") < 0), "product_name", "left_semi")


def with_incumbents(scored: DataFrame) -> DataFrame:
    """All candidates plus one zero-gain row per product for its incumbent factory."""
    rows = scored.select("product_name", "current_factory", "candidate_factory", "lead_gain_days",
                         "profit_impact", "risk_score", F.lit(False).alias("is_incumbent"))
    zero = F.lit(0.0)
    own = scored.select("product_name", "current_factory").distinct().select(
        "product_name", "current_factory", F.col("current_factory").alias("candidate_factory"),
        zero.alias("lead_gain_days"), zero.alias("profit_impact"), zero.alias("risk_score"),
        F.lit(True).alias("is_incumbent"))
    return rows.unionByName(own)


def top_recommendations(recommended: DataFrame, n: int = TOP_N) -> DataFrame:
    """The n best-scored moves with a positive gain, one per product."""
    return (recommended.where(~F.col("is_retain") & (F.col("lead_gain_days") > 0))
            .orderBy(F.desc("score"), "product_name").limit(n))


def qualifying(scored: DataFrame) -> DataFrame:
    """Candidates that pass both gates, flagged if they are their product's top pick."""
    return flag_top_pick(scored).where(F.col("sufficient_evidence") & F.col("materially_better"))


def gate_counts(picks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Products per gate result among the picks (one row per product and scenario)."""
    def count(label: str) -> Column:
        return F.count_if(F.col("gate_result") == label)

    return picks.groupBy(*by).agg(
        F.count("product_name").alias("product_count"),
        count("actionable").alias("actionable_count"),
        count("materiality_only").alias("materiality_only_count"),
        count("evidence_only").alias("evidence_only_count"),
        count("both").alias("both_gates_fail_count"))
