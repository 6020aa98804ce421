"""Key figures, their bootstrap intervals and their sensitivity to the assumptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions.portable import hashed_uniform, uniform, with_hash_index
from haulmark.operators.ranking import recommend, score_moves
from haulmark.params import (BOOTSTRAP_ITERATIONS, MONTE_CARLO_ITERATIONS, RATE_RANGE, SPEED_RANGE,
                             Assumptions, scenario_columns)

BOOTSTRAP_STREAM, SPEED_STREAM, COST_STREAM = 11, 13, 17  # fixed values: keys of the draws
KPIS = ("lead_time_reduction_pct", "profit_stability_pct", "scenario_confidence", "coverage_pct")


def covered(gated: bool = False) -> Column:
    """Whether a pick counts towards coverage: always, or only if it passes both gates."""
    if gated:
        return F.col("gate_result") == "actionable"
    return F.lit(True)


def kpi_terms(picks: DataFrame, gated: bool = False) -> DataFrame:
    """Per product, the summands every key figure is a ratio of."""
    return picks.select(
        *[c for c in ("scenario_id", "product_name") if c in picks.columns],
        (F.col("lead_gain_days") * F.col("orders")).alias("gain"),
        (F.col("baseline_lead_days") * F.col("orders")).alias("baseline"),
        (F.col("profit_impact") >= 0).cast("int").alias("stable"),
        covered(gated).cast("int").alias("covered"))


def kpi_ratios(terms: DataFrame, catalogue: Column, confidence: Column, by: Sequence[str] = ()
               ) -> DataFrame:
    """The key figures per group of terms."""
    return terms.groupBy(*by).agg(
        (F.sum("gain") * 100 / F.nullif(F.sum("baseline"), F.lit(0.0)))
        .alias("lead_time_reduction_pct"),
        (F.sum("stable") * 100.0 / F.count(F.lit(1))).alias("profit_stability_pct"),
        F.max(confidence).alias("scenario_confidence"),
        (F.sum("covered") * 100.0 / F.max(catalogue)).alias("coverage_pct"))


def kpi_long(wide: DataFrame) -> DataFrame:
    return wide.unpivot([], list(KPIS), "kpi", "point")


def compute_kpis(picks: DataFrame, catalogue: Column, confidence: Column, gated: bool = False
                 ) -> DataFrame:
    """``(kpi, point)`` over one recommendation per product."""
    return kpi_long(kpi_ratios(kpi_terms(picks, gated), catalogue, confidence))


def bootstrap_kpis(picks: DataFrame, catalogue: Column, confidence: Column,
                   replicates: int = BOOTSTRAP_ITERATIONS, gated: bool = False) -> DataFrame:
    """``(kpi, point, lo, hi)``: 5th and 95th percentile over resamples of the products.

    Products are numbered by the hash of their name. Each product stands for one slot of every
    replicate, and the slot's draw names the product to take, so a resample is an equi join on the
    product number and only sums per replicate are shuffled. Coverage counts the distinct products of a
    resample against the catalogue; a resample can only miss products, so the upper end of its
    interval is the point itself.
    """
    terms = kpi_terms(picks, gated)
    numbered = with_hash_index(terms, F.col("product_name"), "slot")
    size = terms.agg(F.count(F.lit(1)).alias("n")).scalar()
    draws = (numbered.select("slot", size.alias("n"),
                             F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
             .select("replicate", "n", F.floor(
                 hashed_uniform(F.lit(BOOTSTRAP_STREAM), F.col("replicate"), F.col("slot"))
                 * F.col("n"))
                 .cast("bigint").alias("slot")))
    taken = draws.groupBy("replicate", "slot").agg(F.count(F.lit(1)).alias("times"))
    resampled = taken.join(numbered.drop("product_name"), "slot")
    times = F.col("times")
    per_replicate = resampled.groupBy("replicate").agg(
        (F.sum(F.col("gain") * times) * 100 / F.nullif(F.sum(F.col("baseline") * times), F.lit(0.0)))
        .alias("lead_time_reduction_pct"),
        (F.sum(F.col("stable") * times) * 100.0 / F.sum(times)).alias("profit_stability_pct"),
        F.max(confidence).alias("scenario_confidence"),
        (F.sum("covered") * 100.0 / F.max(catalogue)).alias("coverage_pct"))
    ends = per_replicate.unpivot(["replicate"], list(KPIS), "kpi", "value").groupBy("kpi").agg(
        F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("ci"))
    point = kpi_long(kpi_ratios(terms, catalogue, confidence))
    hi = F.when(F.col("kpi") == "coverage_pct", F.col("point")).otherwise(F.col("ci")[1])
    return point.join(ends, "kpi").select("kpi", "point", F.col("ci")[0].alias("lo"),
                                          hi.alias("hi"))


def drawn(draw: Column) -> tuple[Column, Column]:
    """Freight speed and rate of a numbered draw, uniform over their ranges."""
    def between(limits: tuple[float, float], u: Column) -> Column:
        return u * (limits[1] - limits[0]) + limits[0]

    return (between(SPEED_RANGE, uniform(draw, SPEED_STREAM)),
            between(RATE_RANGE, uniform(draw, COST_STREAM)))


def draw_scenarios(moves: DataFrame, a: Assumptions, draws: int = MONTE_CARLO_ITERATIONS
                   ) -> DataFrame:
    """Every candidate under every draw of freight speed and rate, as ``scenario_id``/``scenario``."""
    numbered = moves.withColumn("scenario_id",
                                F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    fields = a.columns()
    (fields["freight_speed_km_day"],
     fields["freight_cost_per_unit_per_1000km"]) = drawn(F.col("scenario_id"))
    return numbered.withColumn("scenario", F.struct(*[c.alias(n) for n, c in fields.items()]))


def scenario_picks(moves: DataFrame, a: Assumptions, draws: int = MONTE_CARLO_ITERATIONS
                   ) -> DataFrame:
    """The recommendation per product and draw."""
    scored = score_moves(draw_scenarios(moves, a, draws), scenario_columns("scenario"),
                         ["scenario_id"])
    return recommend(scored, ["scenario_id", "product_name"])


def sensitivity(picks: DataFrame, catalogue: Column, confidence: Column, gated: bool = False
                ) -> DataFrame:
    """Key figures per draw, with the freight speed and rate drawn."""
    speed, rate = drawn(F.col("iteration"))
    return (kpi_ratios(kpi_terms(picks, gated), catalogue, confidence, ["scenario_id"])
            .withColumnRenamed("scenario_id", "iteration")
            .withColumns({"speed_km_day": speed, "freight_rate": rate}))


def choice_stability(picks: DataFrame, default: DataFrame) -> DataFrame:
    """Per product, the share of draws that agree with the default pick and the picks seen."""
    base = default.select("product_name", F.col("candidate_factory").alias("default_factory"))
    per = picks.groupBy("product_name", "candidate_factory").agg(F.count(F.lit(1)).alias("draws"))
    same = F.col("candidate_factory") == F.col("default_factory")
    return (per.join(base, "product_name").groupBy("product_name", "default_factory")
            .agg((F.sum(F.when(same, F.col("draws")).otherwise(0)) * 100.0 / F.sum("draws"))
                 .alias("choice_agreement_pct"),
                 F.count(F.lit(1)).alias("distinct_factories")))


def stability_summary(stability: DataFrame) -> DataFrame:
    return stability.agg(F.avg("choice_agreement_pct").alias("mean_choice_agreement_pct"),
                         F.count(F.lit(1)).alias("products"))
