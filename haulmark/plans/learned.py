"""Registered queries that fit models or group lanes.

Linear models are solved from sums in ``normal_equations`` and have oracles. Fitted forests, boosted trees
and k-means have no SQL equivalent; tests check their invariants. Every
operator around them (splits, metrics, cross-validation, selection, residuals, standardisation,
assignment, labels, silhouette) is also registered over a predictor or centres that SQL can follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulmark.functions.portable import fold, is_holdout
from haulmark.functions.text import calendar_features
from haulmark.operators import clusters, derive, lanes, lloyd, models, moves
from haulmark.operators import normal_equations as lsq
from haulmark.plans.queries import BASE, NETWORK, cells, lines, query, tidy
from haulmark.session import staged
from haulmark.sources import warehouse as W

FOLD_STREAM = 5  # fixed value: key of the fold draw
# Depth of the forests in these queries. Depth 30, the operator's default, takes over 170 s for one
# forest of 100 trees on 6,000 lines.
DEPTH = 8


def _training_lines(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    """Order lines with hold-out side, fold and proxy transit days, staged for repeated scans; with
    ``columns`` these alone."""
    a, b = F.col("order_id"), F.col("line_key")
    modes = W.mode_table(spark).select("ship_mode", "multiplier")
    marked = lines(spark, d).join(modes, "ship_mode").withColumns({
        "is_holdout": is_holdout(a, b), "fold": fold(a * FOLD_STREAM, b),
        "transit_days": derive.transit_days(F.col("distance_km"), F.col("multiplier"), a, b)})
    kept = marked.drop("lat", "lon", "ship_date", "cost", "gross_profit")
    return staged(kept.select(*columns) if columns else kept, "training")


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(~F.col("is_holdout")), rows.where("is_holdout")


def _proxy(spark: SparkSession, d: str, target: str = "transit_days"):
    """Report and models of the proxy feature set, trained on cells, tested on lines."""
    train, test = _split(_training_lines(spark, d))
    grid = staged(models.training_cells(train, target), "grid")
    return models.holdout_report(grid, test.withColumn("label", F.col(target).cast("double")),
                                 models.PROXY_FEATURES, models.estimators(weight="n", depth=DEPTH))


@query
def proxy_model_metrics(spark, d):
    return tidy(_proxy(spark, d)[0])


@query
def observed_model_metrics(spark, d):
    return tidy(_proxy(spark, d, "lead_time_days")[0])


def _lead_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _training_lines(spark, d, ["order_id", "line_key", "is_holdout", "lead_time_days",
                                      *models.LEAD_FEATURES.all()])
    return models.numbers_as_double(rows.withColumn("label", F.col("lead_time_days").cast("double")),
                                    models.LEAD_FEATURES)


@query
def model_metrics(spark, d):
    """The full feature set: least squares line by line, trees on the lines' weighted cells of bins."""
    train, test = _split(_lead_rows(spark, d))
    return tidy(models.holdout_report(train, test, models.LEAD_FEATURES,
                                          models.estimators(depth=DEPTH))[0])


def _cv(spark: SparkSession, d: str) -> DataFrame:
    """Fits on cells, scored on the lines of the fold left out; a row per model and fold, stored."""
    lines = _training_lines(spark, d, [*models.CELL_KEYS, "fold", "lead_time_days"]).withColumn(
        "label", F.col("lead_time_days").cast("double"))
    grid = staged(models.training_cells(lines, "lead_time_days", extra=["fold"]), "grid")
    return staged(models.cross_validate(grid, models.PROXY_FEATURES, models.estimators(
        weight="n", depth=DEPTH), lines=lines), "folds")


@query
def cv_metrics(spark, d):
    return tidy(models.cv_summary(_cv(spark, d)))


@query
def model_selection(spark, d):
    tier = F.create_map(*[F.lit(x) for kv in models.TIERS.items() for x in kv])
    report = models.cv_summary(_cv(spark, d)).withColumn("interpretability_tier",
                                                         tier[F.col("model")])
    return tidy(models.select_best(report))


def _selected(spark: SparkSession, d: str):
    """The selected model on the full feature set and the held-out rows: the simplest model whose
    hold-out R2 is within the tolerance of the best."""
    train, test = _split(_lead_rows(spark, d))
    report, fitted = models.holdout_report(train, test, models.LEAD_FEATURES,
                                          models.estimators(depth=DEPTH))
    return fitted[models.select_best(report, score="r2").first()["model"]], test


@query
def residual_std(spark, d):
    best, test = _selected(spark, d)
    return tidy(models.residual_std(best.transform(test)))


@query
def permutation_importance(spark, d):
    best, test = _selected(spark, d)
    key = F.concat_ws("-", "order_id", "line_key")
    return tidy(models.permutation_importance(best, test, models.LEAD_FEATURES, key), 9)


@query
def temporal_holdout(spark, d):
    rows = models.temporal_split(_training_lines(spark, d))
    early = staged(models.training_cells(rows.where(~F.col("is_late")), "lead_time_days"), "early")
    late = rows.where("is_late").withColumn("label", F.col("lead_time_days").cast("double"))
    return tidy(models.holdout_report(early, late, models.PROXY_FEATURES, models.estimators(
        weight="n", ridge=True, depth=DEPTH))[0])


# Nested feature sets, (numeric, categorical) by name.
_SIZE = ["month", "weekday", "units"]
ABLATION = {
    "Ship mode": ([], ["ship_mode"]),
    "+ calendar": (["month", "weekday"], ["ship_mode"]),
    "+ order size": (_SIZE, ["ship_mode"]),
    "+ distance": ([*_SIZE, "distance_km"], ["ship_mode"]),
    "+ region & factory": ([*_SIZE, "distance_km"], ["ship_mode", "region", "current_factory"]),
}
BASES = {"state": "distance_km", "region": "region_km"}
STATE_OR_DISTANCE = {
    "Ship mode + state dummies": ([], ["ship_mode", "state"]),
    "Ship mode + distance": (["distance_km"], ["ship_mode"]),
    "Ship mode + state + distance": (["distance_km"], ["ship_mode", "state"]),
}


def ablation_sets() -> dict[str, lsq.FeatureSet]:
    """Every feature set on either distance basis, named ``basis|set``."""
    return {f"{basis}|{name}": lsq.FeatureSet(
        [column if c == "distance_km" else c for c in numeric], categorical)
        for basis, column in BASES.items() for name, (numeric, categorical) in ABLATION.items()}


@query
def feature_ablation(spark, d):
    """Cross-validated R2 of growing feature sets, on state and on region distances, from one table of
    sums per fold."""
    rows = _marked(spark, d).withColumns(calendar_features(F.col("order_date")))
    # A bounded table, stored so that Spark knows its size before it plans the join of the lines.
    by_region = staged(rows.groupBy("region", "current_factory").agg(
        F.avg("distance_km").alias("region_km")), "region-km")
    rows = rows.join(by_region, ["region", "current_factory"])
    out = lsq.cross_validated(rows, ablation_sets(), "label", "fold", models.FOLDS)
    return tidy(out.select(
        F.substring_index("set", "|", 1).alias("distance_basis"),
        F.substring_index("set", "|", -1).alias("feature_set"), "cv_r2_mean", "cv_r2_std"))


@query
def state_vs_distance(spark, d):
    sets = {name: lsq.FeatureSet(*s) for name, s in STATE_OR_DISTANCE.items()}
    out = lsq.cross_validated(_marked(spark, d), sets, "label", "fold", models.FOLDS)
    return tidy(out.select(F.col("set").alias("comparison"), "cv_r2_mean"))


LINEAR_SETS = {"proxy features": lsq.FeatureSet(models.PROXY_NUMERIC, models.PROXY_CATEGORICAL),
               "all features": lsq.FeatureSet(models.LEAD_NUMERIC, models.LEAD_CATEGORICAL)}


@query
def linear_cv(spark, d):
    """Cross-validated metrics of the linear model on both feature sets."""
    out = lsq.cross_validated(_marked(spark, d), LINEAR_SETS, "label", "fold", models.FOLDS)
    return tidy(out.withColumnRenamed("set", "features"))


def _linear(rows: DataFrame, sets: dict[str, lsq.FeatureSet], test: str, penalty: float = 0.0
            ) -> DataFrame:
    """Least squares on the rows where ``test`` is false, with the sums of those where it is true."""
    whole = lsq.FeatureSet(sorted({c for s in sets.values() for c in s.numeric}),
                           sorted({c for s in sets.values() for c in s.categorical}))
    sums = lsq.moments(rows, whole, "label", test)
    return lsq.solved(lsq.one_against(sums, sets), penalty)


@query
def linear_holdout(spark, d):
    """Hold-out metrics of the linear model on both feature sets."""
    out = lsq.scores(_linear(_marked(spark, d), LINEAR_SETS, "is_holdout"))
    return tidy(out.select(F.col("set").alias("features"), "n", "r2", "rmse"))


@query
def fill_values(spark, d):
    """What missing values are filled with, learned on weighted cells of lines with planted gaps."""
    def gap(column: str, every: int) -> F.Column:
        return F.when(F.col("order_id") % every != 0, F.col(column)).alias(column)

    rows = _marked(spark, d).select(gap("distance_km", 7), gap("units", 5), gap("ship_mode", 11),
                                    gap("region", 13), "label")
    grid = staged(models.training_cells(
        rows, "label", ["distance_km", "units", "ship_mode", "region"]), "grid")
    filled = (models.weighted_medians(grid, ["distance_km", "units"], "n")
              | models.weighted_modes(grid, ["ship_mode", "region"], "n"))
    return tidy(spark.createDataFrame(
        [(k, v if isinstance(v, float) else None, v if isinstance(v, str) else None)
         for k, v in filled.items()], "feature string, median double, mode string"))


@query
def linear_importance(spark, d):
    """R2 of the linear model lost when one feature is shuffled among the held-out lines."""
    features = LINEAR_SETS["all features"]
    key = F.concat_ws("-", "order_id", "line_key", F.col("units").cast("bigint"), "lead_time_days")
    rows = staged(_marked(spark, d).select(*features.all(), "label", "is_holdout", key.alias("key")),
                  "marked")
    fitted = staged(_linear(rows, {"all": features}, "is_holdout"), "coefficients")
    return tidy(models.permutation_importance(
        lsq.LinearModel(fitted, features), rows.where("is_holdout"), features, F.col("key")), 9)


@query
def ridge_temporal(spark, d):
    """Ridge and plain least squares of the early lines, scored on the late ones."""
    rows = models.temporal_split(_marked(spark, d))
    sets = {"proxy": LINEAR_SETS["proxy features"]}
    out = [lsq.scores(_linear(rows, sets, "is_late", penalty)).withColumn("model", F.lit(name))
           for name, penalty in (("Linear Regression", 0.0), ("Ridge", 1.0))]
    return tidy(models.union(out).select("model", "n", "r2", "rmse"))


@query
def linear_reallocation(spark, d):
    """Every product at every factory, days predicted by least squares on the proxy features."""
    proxy = LINEAR_SETS["proxy features"]
    fitted = staged(_linear(_marked(spark, d), {"proxy": proxy}, "is_holdout"), "coefficients")
    days = moves.factory_days(cells(spark, d), NETWORK, lsq.predictor(fitted, proxy))
    return tidy(moves.simulate_reallocation(days, BASE.freight_cost_per_unit_per_1000km), 4,
                whatif_profit=2)


@query
def model_reallocation(spark, d):
    """Every product at every factory, days predicted by the best proxy model."""
    report, fitted = _proxy(spark, d)
    best = fitted[report.first()["model"]]
    days = moves.factory_days(cells(spark, d), NETWORK, models.predictor(best))
    return tidy(moves.simulate_reallocation(days, BASE.freight_cost_per_unit_per_1000km), 4)


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    profile = staged(lanes.lane_profile(lines(spark, d)), "lanes")
    return clusters.cluster_lanes(profile, W.LANE_MIN_ORDERS)


@query
def lane_clusters(spark, d):
    return tidy(_clustered(spark, d).select(*lanes.LANE_KEYS, "order_count", "cluster",
                                            "selected_k", "silhouette_score", "euclidean_silhouette"))


@query
def cluster_labels(spark, d):
    labelled = clusters.label_clusters(_clustered(spark, d), W.LANE_MIN_ORDERS)
    return labelled.select(*lanes.LANE_KEYS, "cluster", "cluster_label")


# ---- the same operators over predictors and centres that SQL can follow ---------------------------

def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Lines with hold-out side, fold and the lead time as label."""
    a, b = F.col("order_id"), F.col("line_key")
    return lines(spark, d).withColumns({
        "is_holdout": is_holdout(a, b), "fold": fold(a * FOLD_STREAM, b),
        "label": F.col("lead_time_days").cast("double")})


@query
def mode_mean_holdout(spark, d):
    """Hold-out metrics of the ship mode's training mean."""
    train, test = _split(_marked(spark, d))
    return tidy(models.metrics(models.mode_means(train, test, "label")))


def _mean_cv(spark: SparkSession, d: str) -> DataFrame:
    """Per fold, the mean of the ship mode and of (ship mode, product) as models."""
    rows = staged(_marked(spark, d).select("ship_mode", "product_name", "fold", "label"), "folds")
    return models.union([
        models.metrics(models.cross_validated_means(rows, "label", by), ["fold"]).withColumn(
            "model", F.lit(name))
        for name, by in (("Mode mean", ["ship_mode"]),
                         ("Mode and product mean", ["ship_mode", "product_name"]))])


@query
def mode_mean_cv(spark, d):
    return tidy(models.cv_summary(_mean_cv(spark, d)))


@query
def mean_model_selection(spark, d):
    tier = F.when(F.col("model") == "Mode mean", 0).otherwise(1)
    report = models.cv_summary(_mean_cv(spark, d)).withColumn("interpretability_tier", tier)
    return tidy(models.select_best(report).select("model", "interpretability_tier", "cv_r2_mean",
                                                  "best_score"))


@query
def mode_mean_temporal(spark, d):
    """Metrics on the late lines of the means of the early ones."""
    rows = models.temporal_split(_marked(spark, d))
    return tidy(models.metrics(models.mode_means(rows.where(~F.col("is_late")),
                                                 rows.where("is_late"), "label")))


@query
def mode_mean_residuals(spark, d):
    train, test = _split(_marked(spark, d))
    return tidy(models.residual_std(models.mode_means(train, test, "label")))


@query
def training_cells(spark, d):
    """The weighted cells on which the proxy models are trained, for the observed target."""
    train, _ = _split(_marked(spark, d))
    return tidy(models.training_cells(train, "lead_time_days"), label_sq=0)


@query
def linear_distance_fit(spark, d):
    """Least squares of lead time on distance, fitted on cells, at every lane's distance."""
    train, _ = _split(_marked(spark, d))
    grid = staged(models.training_cells(train, "lead_time_days", ["distance_km"]), "grid")
    model = models.fit(grid, models.Features(["distance_km"], []),
                       models.estimators(weight="n")["Linear Regression"])
    return tidy(model.transform(grid.select("distance_km")).select("distance_km", "prediction"))


ELIGIBLE = 30  # fixed value: least orders of a lane here, met at every scale of the tables


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    """Standardised lanes assigned to the first three eligible lanes as centres."""
    profile = staged(lanes.lane_profile(lines(spark, d)), "lanes")
    scaled = staged(clusters.standardised(profile, ELIGIBLE), "scaled")
    first = scaled.where(F.col("order_count") >= ELIGIBLE).orderBy(*lanes.LANE_KEYS).limit(3)
    number = F.row_number().over(Window.orderBy(*lanes.LANE_KEYS)) - 1
    return clusters.assign_clusters(scaled, first.withColumn("cluster", number))


@query
def standardised_lanes(spark, d):
    profile = staged(lanes.lane_profile(lines(spark, d)), "lanes")
    scaled = clusters.standardised(profile, ELIGIBLE)
    return tidy(scaled.select(*lanes.LANE_KEYS, *[f"z_{c}" for c in clusters.CLUSTER_FEATURES]))


@query
def assigned_lanes(spark, d):
    assigned = _assigned(spark, d).withColumn("selected_k", F.lit(3))
    labelled = clusters.label_clusters(assigned, ELIGIBLE)
    return tidy(labelled.select(*lanes.LANE_KEYS, "cluster", "cluster_label", "distance"))


@query
def assigned_summary(spark, d):
    return tidy(clusters.cluster_summary(_assigned(spark, d), ELIGIBLE))


@query
def assigned_silhouette(spark, d):
    eligible = _assigned(spark, d).where(F.col("order_count") >= ELIGIBLE)
    return tidy(clusters.silhouette(staged(eligible, "assigned")))


@query
def assigned_euclidean(spark, d):
    """Both silhouettes of the assigned lanes, each computed from its own distance."""
    eligible = staged(_assigned(spark, d).where(F.col("order_count") >= ELIGIBLE)
                      .withColumn("centres", F.lit("first three lanes")), "assigned")
    return tidy(clusters.silhouettes(eligible, lanes.LANE_KEYS, LANE_MEASURES, ["centres"]))


LANE_MEASURES = [f"z_{c}" for c in clusters.CLUSTER_FEATURES]


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    """Standardised lanes, rounded so that every engine clusters the same numbers."""
    profile = staged(lanes.lane_profile(lines(spark, d)), "lanes")
    return staged(tidy(clusters.standardised(profile, ELIGIBLE).select(
        *lanes.LANE_KEYS, "order_count", *LANE_MEASURES), 9), "scaled")


@query
def lloyd_scores(spark, d):
    """The cheapest of ten starts for every k, with its cost and both silhouettes."""
    report, _ = lloyd.fits(_scaled(spark, d), lanes.LANE_KEYS, LANE_MEASURES,
                           F.col("order_count") >= ELIGIBLE)
    return tidy(report)


@query
def lloyd_lanes(spark, d):
    """Every lane with its cluster under the k of the best Euclidean silhouette."""
    out = lloyd.lloyd_clusters(_scaled(spark, d), lanes.LANE_KEYS, LANE_MEASURES,
                               F.col("order_count") >= ELIGIBLE)
    return tidy(out.select(*lanes.LANE_KEYS, "order_count", "cluster", "selected_k",
                           "silhouette_score", "euclidean_silhouette"))
