import math

import pytest
from pyspark.sql import functions as F

from haulmark.operators import clusters, lanes, models, moves
from haulmark.operators import normal_equations as lsq
from haulmark.plans import batch, learned
from haulmark.plans import queries as Q
from haulmark.session import staged
from haulmark.sources import dims, results
from haulmark.sources import warehouse as W


@pytest.fixture(scope="module")
def rows(spark, small):
    return learned._training_lines(spark, small)


@pytest.fixture(scope="module")
def proxy(rows):
    train, test = learned._split(rows)
    test = test.withColumn("label", F.col("transit_days").cast("double"))
    report, fitted = models.holdout_report(
        models.training_cells(train, "transit_days"), test, models.PROXY_FEATURES,
        models.estimators(trees=10, rounds=10, weight="n", depth=8))
    return report.collect(), fitted, test


def test_proxy_is_learnable(proxy):
    report = proxy[0]
    assert [r.model for r in report] == sorted((r.model for r in report),
                                               key=lambda n: -{r.model: r.r2 for r in report}[n])
    assert all(math.isfinite(r.rmse) and r.mae <= r.rmse for r in report)
    assert report[0].r2 > 0.8


def test_cell_fit_equals_line_fit(rows):
    """Least squares on weighted cells gives the predictions of least squares on lines."""
    train, test = learned._split(rows)
    linear = {k: models.estimators(weight=w)["Linear Regression"] for k, w in
              (("cells", "n"), ("lines", None))}
    # Plain least squares: the same numbers enter, whatever their grouping.
    features = models.Features(["distance_km"], [])
    lines = train.withColumn("label", F.col("transit_days").cast("double"))
    a = models.fit(models.training_cells(train, "transit_days", ["distance_km"]),
                   features, linear["cells"])
    b = models.fit(lines, features, linear["lines"])
    pa = [r.prediction for r in a.transform(test).orderBy("order_id", "line_key").collect()]
    pb = [r.prediction for r in b.transform(test).orderBy("order_id", "line_key").collect()]
    assert max(abs(x - y) for x, y in zip(pa, pb)) < 1e-6


def test_cell_metrics_equal_line_metrics(proxy, rows):
    _, fitted, test = proxy
    model = fitted["Linear Regression"]
    by_line = models.metrics(model.transform(test)).first()
    by_cell = models.cell_metrics(model.transform(models.training_cells(test, "transit_days"))).first()
    assert by_cell.rmse == pytest.approx(by_line.rmse) and by_cell.r2 == pytest.approx(by_line.r2)


def test_model_survives_storage_and_unknown_values(proxy, tmp_path):
    _, fitted, test = proxy
    path = models.save_model(fitted["Gradient Boosting"], str(tmp_path / "model"))
    odd = test.limit(20).withColumn("product_name", F.lit("never seen")).withColumn(
        "region", F.lit(None).cast("string"))
    a = [r.prediction for r in fitted["Gradient Boosting"].transform(odd).collect()]
    b = [r.prediction for r in models.load_model(path).transform(odd).collect()]
    assert a == b and all(math.isfinite(x) for x in a)


def test_missing_feature_is_named(rows):
    with pytest.raises(ValueError, match="region"):
        models.holdout_report(rows.drop("region"), rows, models.PROXY_FEATURES, {}, "transit_days")


def test_selection_prefers_simple_models(spark):
    df = spark.createDataFrame([("Linear Regression", 0, 0.50), ("Random Forest", 1, 0.49),
                                ("Gradient Boosting", 2, 0.515)],
                               "model string, interpretability_tier int, cv_r2_mean double")
    assert models.select_best(df).first().model == "Linear Regression"
    assert models.select_best(df, 0.001).first().model == "Gradient Boosting"


def test_cv_deviation_is_positive(spark):
    df = spark.createDataFrame([("a", k, 0.1 * k, 5.0 - k, 1.0) for k in range(5)],
                               "model string, fold int, r2 double, rmse double, mae double")
    row = models.cv_summary(df).first()
    assert row.cv_rmse_std > 0 and row.cv_r2_mean == pytest.approx(0.2) and row.cv_mae_std == 0


def test_residuals_fall_back_to_overall(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 3.0, 0.0), ("b", 9.0, 1.0)],
                               "product_name string, label double, prediction double")
    rows = {r.product_name: r for r in models.residual_std(df).collect()}
    assert rows["a"].residual_std == pytest.approx(math.sqrt(2)) and rows["a"].holdout_count == 2
    assert rows["b"].residual_std == pytest.approx(math.sqrt(((1 - 4) ** 2 + 1 + 16) / 2))


def test_permutation_importance_ranks_what_matters(spark):
    df = spark.range(3000).select(
        "id", (F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z"),
        F.lit("c").alias("k"))
    df = df.withColumn("label", F.col("x") * 2)
    features = models.Features(["x", "z"], ["k"])
    model = models.fit(df, features, models.estimators()["Linear Regression"])
    rows = {r.feature: r for r in models.permutation_importance(model, df, features, F.col("id"), 3)
            .collect()}
    assert rows["x"].importance_mean > 1 and abs(rows["z"].importance_mean) < 1e-6
    assert rows["k"].importance_mean == pytest.approx(0, abs=1e-9)


def test_temporal_split_keeps_time_order(rows):
    split = models.temporal_split(rows)
    late = split.where("is_late").agg(F.min("order_date"), F.count("order_id")).first()
    early = split.where("not is_late").agg(F.max("order_date"), F.count("order_id")).first()
    assert early[0] < late[0] and 0.15 < late[1] / (late[1] + early[1]) < 0.25


def test_model_reallocation_has_every_alternative(proxy, moves_fixture):
    days = moves.factory_days(moves_fixture[0], Q.NETWORK,
                              models.predictor(proxy[1]["Linear Regression"]))
    rows = moves.simulate_reallocation(days, 0.15).collect()
    assert len(rows) == 100 and all(r.candidate_factory != r.current_factory for r in rows)
    assert all(r.days_reduced == pytest.approx(r.baseline_days - r.new_days) for r in rows)


def test_clusters(spark, small):
    profile = lanes.lane_profile(Q.lines(spark, small))
    out = clusters.cluster_lanes(profile, 20, k_max=4, starts=2)
    labelled = clusters.label_clusters(out, 20).collect()
    assert len(labelled) == profile.count()
    assert 2 <= labelled[0].selected_k <= 4 and -1 <= labelled[0].silhouette_score <= 1
    assert {r.cluster_label.split(" / ")[0] for r in labelled} <= {"Slow", "Fast",
                                                                   clusters.UNCLUSTERED}
    single = clusters.label_clusters(clusters.cluster_lanes(profile, 10 ** 6), 10 ** 6).first()
    assert single.cluster_label == clusters.SINGLE and single.selected_k == 1


def test_batch_run_writes_every_table(spark, small, tmp_path):
    raw = W.raw_order_lines(spark, small)
    d = batch.Dimensions(W.explicit_map(spark, Q.NETWORK), W.product_divisions(spark, small),
                         W.mode_table(spark), W.region_table(spark, small),
                         W.state_table(spark, small).select("state", "lat", "lon"))
    paths = batch.run(raw, d, Q.NETWORK, str(tmp_path), W.ASSUMPTIONS, lane_min_orders=20, draws=5,
                      trees=3, rounds=3, depth=4)
    for name, path in paths.items():
        if name != "kpis":
            assert results.read_table(spark, path).count() > 0, name
    assert results.read_kpis(spark, paths["kpis"]).count() == 4
    rec = results.read_table(spark, paths["recommendations"])
    assert rec.count() == 25 and rec.where("assumption_version is null").count() == 0
    assert models.load_model(f"{tmp_path}/best_model").stages
    assert dims.state_centroids(spark).count() == 61


def test_batch_run_on_text_ids(spark, small, tmp_path):
    """Order and row ids are opaque text: every line still falls on one side of the hold-out."""
    raw = W.raw_order_lines(spark, small).where("order_id <> '' and order_id <> 'Order ID'")
    raw = raw.withColumns({"order_id": F.concat(F.lit("US-2021-"), "order_id"),
                           "row_id": F.concat(F.lit("R"), "row_id")})
    d = batch.Dimensions(W.explicit_map(spark, Q.NETWORK), W.product_divisions(spark, small),
                         W.mode_table(spark), W.region_table(spark, small),
                         W.state_table(spark, small).select("state", "lat", "lon"))
    paths = batch.run(raw, d, Q.NETWORK, str(tmp_path), W.ASSUMPTIONS, lane_min_orders=20, draws=5,
                      trees=2, rounds=2, depth=4)
    prepared = results.read_table(spark, paths["prepared_orders"])
    assert prepared.where("is_holdout is null or fold is null").count() == 0
    share = prepared.where("is_holdout").count() / prepared.count()
    assert 0.15 < share < 0.25
    cells = results.read_table(spark, paths["cells"])
    assert cells.where("is_holdout").agg(F.sum("lines")).first()[0] == prepared.where(
        "is_holdout").count()
    assert results.read_table(spark, paths["recommendations"]).count() == 25


def test_cells_and_lines_are_filled_alike(spark, tmp_path):
    """Medians and modes of weighted cells are those of the lines; the saved pipeline keeps them."""
    lines = [(float(k), c, 1.0 + k) for k, c, n in (
        (1, "x", 7), (2, "y", 1), (3, "y", 1), (9, "y", 2), (None, "z", 5), (4, None, 3))
        for _ in range(n) for k in [k if k is not None else float("nan")]]
    lines = [(None if a != a else a, c, 5.0 if y != y else y) for a, c, y in lines]
    frame = spark.createDataFrame(lines, "a double, c string, label double")
    features = models.Features(["a"], ["c"])
    grid = models.training_cells(frame, "label", ["a", "c"])
    values = sorted(a for a, _, _ in lines if a is not None)
    middle = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
    assert models.weighted_medians(grid, ["a"], "n") == {"a": middle}
    assert models.weighted_modes(grid, ["c"], "n") == models.weighted_modes(frame, ["c"]) == {"c": "x"}
    assert models.weighted_modes(grid.limit(0), ["c"], "n") == {"c": None}
    fitted = models.fit(grid, features, models.estimators(weight="n")["Linear Regression"])
    path = models.save_model(fitted, str(tmp_path / "model"))
    gaps = spark.createDataFrame([(None, None)], "a double, c string")
    whole = spark.createDataFrame([(middle, "x")], "a double, c string")
    one = [m.transform(f).first()["prediction"] for m in (fitted, models.load_model(path))
           for f in (gaps, whole)]
    assert max(one) - min(one) < 1e-9


@pytest.fixture(scope="module")
def mixed(spark):
    """Lines with a number of its own each, categories and gaps, in five folds."""
    x, k = (F.col("id") * 7919 % 3001).cast("double"), F.col("id") % 3
    rows = spark.range(3000).select("id", x.alias("x"), F.when(F.col("id") % 50 != 0, F.concat(
        F.lit("k"), k)).alias("k"), (F.col("id") % 5).cast("int").alias("fold"),
        (F.when(x < 900, 1.0).otherwise(5.0) + 2 * k + (F.col("id") % 11) / 10).alias("label"))
    return rows, models.Features(["x"], ["k"])


def test_trees_learn_from_cells_of_bins(mixed, monkeypatch):
    """Trees are fitted on at most levels times bins cells, whose errors are those of the lines."""
    rows, features = mixed
    chosen = models.estimators(trees=5, rounds=10, depth=5)
    prepared = models.Pipeline(stages=models.preprocessor(rows, features)).fit(rows)
    stages = models.binned_stages(prepared, rows, features)
    cells = models.binned_cells(stages, rows, features, "label")
    assert cells.select("features").distinct().count() <= 3 * (models.BINS + 1)
    assert cells.agg(F.sum("n")).first()[0] == 3000
    monkeypatch.setattr(models, "BAGGED", 1)
    assert models.binned_cells(stages, rows, features, "label").count() <= 3 * (models.BINS + 1)
    monkeypatch.undo()
    report, fitted = models.holdout_report(rows, rows, features, chosen)
    r2 = {r.model: r.r2 for r in report.collect()}
    assert r2["Gradient Boosting"] > 0.9 and r2["Random Forest"] > 0.9 and r2["Linear Regression"] < 0.9
    on_lines = models.Pipeline(stages=[models.PipelineModel(stages), chosen["Gradient Boosting"]]).fit(rows)
    a, b = [[r.prediction for r in m.transform(rows).orderBy("id").collect()]
            for m in (fitted["Gradient Boosting"], on_lines)]
    assert max(abs(x - y) for x, y in zip(a, b)) < 1e-6


class Opaque:
    """A model that hides how it adds up."""
    def __init__(self, model):
        self.transform = model.transform


def test_linear_importance_scores_each_row_once(mixed):
    """What features add is exchanged as if each changed row were scored; unknown values included."""
    rows, features = mixed
    model = models.fit(rows.where("k is null or k <> 'k2'"), features, models.estimators()["Linear Regression"])
    a, b = [sorted(models.permutation_importance(m, rows, features, F.col("id"), 2).collect())
            for m in (model, Opaque(model))]
    assert [r.feature for r in a] == [r.feature for r in b] == ["k", "x"]
    assert all(x[1:] == pytest.approx(y[1:], abs=1e-9) for x, y in zip(a, b))
    once = models._with_parts(model, rows, features)
    assert all(r.prediction == pytest.approx(r.intercept + sum(r.own)) for r in once.limit(50).collect())


def test_linear_importance_with_gaps(spark, mixed):
    """A row without a number counts where the number of its partner takes the place."""
    rows = mixed[0].withColumn("z", (F.col("id") % 7).cast("double"))
    features = lsq.FeatureSet(["x", "z"], ["k"])
    fitted = lsq.solved(lsq.one_against(lsq.moments(
        rows.withColumn("late", F.col("fold") == 0), features, "label", "late"), {"s": features}))
    model = lsq.LinearModel(staged(fitted, "fitted"), features)
    gaps = rows.withColumn("x", F.when(F.col("id") % 6 != 0, F.col("x")))
    a, b = [sorted(models.permutation_importance(m, gaps, features, F.col("id"), 2).collect())
            for m in (model, Opaque(model))]
    assert len(a) == 3 and all(x[1:] == pytest.approx(y[1:], abs=1e-9) for x, y in zip(a, b))


def test_folds_are_scored_by_cell(spark):
    """Lines take the prediction of their cell: the metrics of scoring each line, nulls included."""
    lines = spark.range(600).select(
        F.when(F.col("id") % 4 != 0, F.col("id") % 4 * 1.0).alias("x"),
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("k"),
        (F.col("id") % 5).cast("int").alias("fold"),
        F.when(F.col("id") % 97 != 0, F.col("id") % 13 * 1.0).alias("label"))
    features = models.Features(["x"], ["k"])
    grid = models.training_cells(lines, "label", ["x", "k"], extra=["fold"])
    linear = {"Linear Regression": models.estimators(weight="n")["Linear Regression"]}
    out = models.cross_validate(grid, features, linear, folds=2, lines=lines)
    assert "predictions" in "".join(out.inputFiles())
    got = {r.fold: r for r in out.collect()}
    for k in (0, 1):
        model = models.fit(grid.where(F.col("fold") != k), features, linear["Linear Regression"])
        want = models.metrics(model.transform(lines.where(F.col("fold") == k))).first()
        assert [got[k][m] for m in ("r2", "rmse", "mae")] == pytest.approx(
            [want[m] for m in ("r2", "rmse", "mae")], rel=1e-9, abs=1e-9)


def test_moment_rows_fit_as_lines(spark, mixed):
    """A few weighted rows per combination of categories give the least squares of the lines, gaps included."""
    lines = mixed[0].select("id", "k", "label", (F.col("id") % 7).cast("double").alias("z"),
                            F.when(F.col("id") % 40 != 0, F.col("x")).alias("x"), F.lit(2.0).alias("same"))
    features = models.Features(["x", "z", "same"], ["k"])
    m = models.estimators()["Linear Regression"]
    prepared = models.Pipeline(stages=models.preprocessor(lines, features)).fit(lines)
    rows = models.moment_rows(prepared, lines, features, "label")
    assert rows.count() <= 3 * 2 * 4 and rows.agg(F.sum("n")).first()[0] == pytest.approx(3000)
    on_lines = models.PipelineModel([*prepared.stages, m.fit(prepared.transform(lines))])
    fitted = models.fit(lines, features, m)
    a, b = [[r.prediction for r in f.transform(lines).orderBy("id").collect()] for f in (on_lines, fitted)]
    assert max(abs(x - y) for x, y in zip(a, b)) < 1e-9
    assert fitted.stages[-1].getWeightCol() == "n"
    few = lines.where("id < 3")
    assert models.moment_rows(prepared, few, features, "label").count() == 3
    unknown = lines.withColumn("label", F.when(F.col("id") != 7, F.col("label")))
    with pytest.raises(Exception, match="Labels MUST NOT be"):
        models.fit(unknown, features, m)


def test_tree_metrics_score_each_cell_once(mixed):
    """Lines take their cell's prediction: the metrics of scoring each line, unknown values and gaps included."""
    rows, features = mixed
    train = rows.where("k is null or k <> 'k2'")
    test = rows.withColumn("x", F.when(F.col("id") % 30 != 0, F.col("x") * 1.5))
    chosen = models.estimators(trees=3, rounds=3, depth=4)
    report, fitted = models.holdout_report(train, test, features, chosen)
    got = {r.model: r for r in report.collect()}
    for name, model in fitted.items():
        want = models.metrics(model.transform(test)).first()
        assert [got[name][c] for c in ("r2", "rmse", "mae")] == pytest.approx(
            [want[c] for c in ("r2", "rmse", "mae")], rel=1e-9)
    assert {n: r.interpretability_tier for n, r in got.items()} == {n: models.TIERS[n] for n in chosen}
    scored = models._binned_metrics({"Random Forest": fitted["Random Forest"]}, test, features, "label")
    assert "predictions" in "".join(scored.inputFiles())
    assert fitted["Random Forest"].stages[-1].getCacheNodeIds()
    assert fitted["Random Forest"].stages[-1].getMaxMemoryInMB() == models.GROUP_MB
