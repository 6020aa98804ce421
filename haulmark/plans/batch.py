"""The batch run: from raw order lines to every result table.

The prepared lines are written once and read back, so that each later stage scans only its own
columns. Every stage after that works on aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.functions.portable import fold, is_holdout, text_number
from haulmark.operators import (audit, clean, clusters, derive, kpi, lanes, models, moves, ranking,
                                risk)
from haulmark.params import LANE_MIN_ORDERS, MONTE_CARLO_ITERATIONS, Assumptions, Network
from haulmark.sources import dims, results


@dataclass(frozen=True)
class Dimensions:
    """The lookup tables of a run. ``product_factory`` and ``product_division`` are the caller's."""

    product_factory: DataFrame
    product_division: DataFrame
    ship_modes: DataFrame
    regions: DataFrame
    places: DataFrame

    @classmethod
    def default(cls, spark: SparkSession, product_factory: DataFrame, product_division: DataFrame
                ) -> "Dimensions":
        return cls(product_factory, product_division, dims.ship_modes(spark), dims.regions(spark),
                   dims.state_centroids(spark))


LINE_CONTENT = ("order_id", "customer_id", "product_id", "product_name", "order_date", "ship_date",
                "ship_mode", "state", "sales", "units", "gross_profit", "cost")


def prepare(clean_rows: DataFrame, d: Dimensions, network: Network) -> DataFrame:
    """Cleaned rows with factory, ranks, destination, distance, folds and proxy transit days."""
    division_factory = derive.modal_factory(d.product_factory, d.product_division)
    rows = derive.resolve_factory(clean_rows, d.product_factory, division_factory)
    rows = rows.join(d.ship_modes.select("ship_mode", "ship_mode_rank", "multiplier"), "ship_mode",
                     "left")
    rows = derive.with_rank(rows, d.regions, "region", "region_rank")
    rows = derive.with_distance(derive.geocode(rows, d.places), network)
    # Ids are opaque text and row ids may be missing: a line's content, which cleaning has made
    # unique, keys the seeded draws.
    key = text_number(F.concat_ws("|", *[F.col(c).cast("string") for c in LINE_CONTENT]))
    return rows.withColumns({
        "line_key": key, "is_holdout": is_holdout(key), "fold": fold(key * 5, 1),
        "transit_days": derive.transit_days(F.col("distance_km"), F.col("multiplier"), key)})


def train(lines: DataFrame, out: str, trees: int = 100, rounds: int = 100, depth: int = 30
          ) -> tuple[DataFrame, models.PipelineModel]:
    """Fit all models, compare them by cross-validation and hold-out, pick one and save it."""
    rows = models.numbers_as_double(lines, models.LEAD_FEATURES).withColumn(
        "label", F.col("lead_time_days").cast("double"))
    regressors = models.estimators(trees, rounds, depth=depth)
    hold, fitted = models.holdout_report(rows.where(~F.col("is_holdout")), rows.where("is_holdout"),
                                         models.LEAD_FEATURES, regressors)
    folds = models.cross_validate(rows, models.LEAD_FEATURES, regressors)
    report = hold.join(models.cv_summary(folds), "model")
    spark = lines.sparkSession
    path = results.write_table(report, f"{out}/model_metrics", "parquet")
    report = results.read_table(spark, path)
    best = fitted[models.select_best(report).first()["model"]]
    models.save_model(best, f"{out}/best_model")
    return report, best


def run(raw: DataFrame, d: Dimensions, network: Network, out: str, a: Assumptions = Assumptions(),
        lane_min_orders: int = LANE_MIN_ORDERS, draws: int = MONTE_CARLO_ITERATIONS,
        trees: int = 100, rounds: int = 100, depth: int = 30, fmt: str = "parquet"
        ) -> dict[str, str]:
    """Write all result tables below ``out`` and return their paths."""
    spark = raw.sparkSession
    division_factory = derive.modal_factory(d.product_factory, d.product_division)
    summary = audit.audit_summary(raw, d.ship_modes, d.regions, d.places, d.product_factory,
                                  division_factory)
    paths = {"audit": results.write_table(summary, f"{out}/audit", fmt)}

    cleaned = clean.clean_orders(raw)
    prepared = derive.require_mapped(prepare(cleaned, d, network))
    stored = results.write_table(prepared, f"{out}/cleaned_orders")
    cleaned = results.read_table(spark, stored)
    bounds = audit.fence_bounds(cleaned, clean.FINANCE)
    paths["prepared_orders"] = results.write_table(audit.apply_fence(cleaned, bounds),
                                                   f"{out}/prepared_orders")
    lines = results.read_table(spark, paths["prepared_orders"])

    report, best = train(lines, out, trees, rounds, depth)
    paths["model_metrics"] = f"{out}/model_metrics"
    held = models.numbers_as_double(lines.where("is_holdout"), models.LEAD_FEATURES).withColumn(
        "label", F.col("lead_time_days").cast("double"))
    tested = best.transform(held)
    residuals = models.residual_std(tested)
    # A product without held-out rows gets the deviation of all of them.
    spread = F.lit(tested.agg(F.stddev_samp(F.col("label") - F.col("prediction"))).first()[0])
    importance = models.permutation_importance(best, held, models.LEAD_FEATURES, F.col("line_key"))

    profile = clusters.cluster_lanes(lanes.lane_profile(lines), lane_min_orders)
    routes = lanes.slow_routes(clusters.label_clusters(profile, lane_min_orders), lane_min_orders)

    paths["cells"] = results.write_table(moves.order_cells(lines), f"{out}/cells")
    cells = results.read_table(spark, paths["cells"])
    paths["per_product_residual_std"] = results.write_table(residuals,
                                                            f"{out}/per_product_residual_std")
    residuals = results.read_table(spark, paths["per_product_residual_std"])
    found = moves.candidate_moves(cells, network)
    paths["moves"] = results.write_table(risk.with_residuals(found, residuals, spread),
                                         f"{out}/moves")
    base = risk.risk_inputs(results.read_table(spark, paths["moves"]), a, draws)
    scored = risk.encode_components(ranking.score_moves(base, a.columns())).withColumn(
        "assumption_version", a.version(network))
    picks = ranking.recommend(scored)
    catalogue = cells.agg(F.count_distinct("product_name").alias("n")).scalar()
    chosen = models.select_best(report).select("r2").scalar()

    tables = {
        "routes": routes, "congested_region_products": lanes.congested_pairs(lines),
        "feature_importance": importance, "scored_moves": scored, "recommendations": picks,
        "sensitivity": kpi.sensitivity(kpi.scenario_picks(base, a, draws), catalogue, chosen),
        "kpi_points": kpi.compute_kpis(picks, catalogue, chosen)}
    paths |= results.write_tables(tables, out, fmt)
    paths["kpis"] = results.write_kpis(kpi.bootstrap_kpis(picks, catalogue, chosen), f"{out}/kpis")
    return paths
