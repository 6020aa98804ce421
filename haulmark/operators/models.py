"""Regression models of lead and transit time, fitted, compared and explained with Spark ML.

When all features are categories plus a distance between known places, the lines collapse into
weighted cells (mean target, number of lines), so training cost follows the number of cells, not the
number of lines. Least squares on the cells equals least squares on the lines, and missing values are filled
with the lines' medians and modes. Trees weigh their splits by the lines, too, but a forest bags cells.

With other numbers among the features, the linear model is fitted on a few weighted rows per combination of
categories that have the lines' sums, squares and products. Trees see a number only through its bins, so they, too,
are fitted on weighted cells, of lines that agree in categories and bins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (Imputer, OneHotEncoder, QuantileDiscretizer, SQLTransformer,
                                StandardScaler, StringIndexer, VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (GBTRegressor, LinearRegression, LinearRegressionModel,
                                   RandomForestRegressor)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.functions.portable import with_hash_index
from haulmark.operators.moves import sample_std
from haulmark.operators.normal_equations import LinearModel
from haulmark.params import SELECTION_TOLERANCE
from haulmark.session import staged

# Feature sets, seed and the order of models from simple to complex.
PROXY_CATEGORICAL = ("ship_mode", "region", "product_name", "current_factory")
PROXY_NUMERIC = ("distance_km",)
LEAD_CATEGORICAL = ("product_name", "current_factory", "region", "ship_mode", "division")
LEAD_NUMERIC = ("ship_mode_rank", "region_rank", "units", "distance_km", "sales")
SEED = 42
FOLDS = 5
TIERS = {"Linear Regression": 0, "Ridge": 0, "Random Forest": 1, "Gradient Boosting": 2}
CELL_KEYS = (*PROXY_CATEGORICAL, *PROXY_NUMERIC)
BINS = 32  # fixed value: bins of a number in Spark's trees, their default
BIN_ERROR = 0.001  # fixed value: accuracy of the ranks between bins
BAGGED = 1 << 20  # fixed values: cells are dealt into parts up to so many rows in all,
PARTS = 64  # and so many a cell, for forests to bag
# Up to this depth a forest's nodes are summed in groups of so many MB, which stay in the
# processors' caches; the groups of deeper forests are Spark's, as every group is a pass over the cells.
SHALLOW, GROUP_MB = 10, 8
SKETCH = 12  # fixed value: size of a sketch of distinct values, exact up to far more than ``BINS`` of them
ALIASED = 1e-12  # fixed value: share of a number's variance below which others explain it


@dataclass(frozen=True)
class Features:
    numeric: Sequence[str]
    categorical: Sequence[str]

    def all(self) -> list[str]:
        return [*self.numeric, *self.categorical]


PROXY_FEATURES = Features(PROXY_NUMERIC, PROXY_CATEGORICAL)
LEAD_FEATURES = Features(LEAD_NUMERIC, LEAD_CATEGORICAL)


def estimators(trees: int = 100, rounds: int = 100, label: str = "label",
               weight: str | None = None, ridge: bool = False, depth: int = 30
               ) -> dict[str, object]:
    """The compared regressors, by name.

    ``depth`` limits the forest's trees; the default is the deepest that Spark grows. A leaf holds at
    least three rows, or one weighted cell.
    """
    common = {"featuresCol": "features", "labelCol": label}
    if weight:
        common["weightCol"] = weight
    models = {
        "Linear Regression": LinearRegression(**common),
        "Random Forest": RandomForestRegressor(
            numTrees=trees, featureSubsetStrategy="all", minInstancesPerNode=1 if weight else 3,
            maxDepth=depth, seed=SEED, **common),
        "Gradient Boosting": GBTRegressor(maxIter=rounds, stepSize=0.1, maxDepth=3, seed=SEED,
                                          **common),
    }
    if ridge:
        models["Ridge"] = LinearRegression(regParam=1.0, elasticNetParam=0.0, **common)
    return models


def weighted_modes(rows: DataFrame, columns: Sequence[str], weight: str | None = None) -> dict:
    """The value with the largest total weight of each column, the smaller of equal ones, as text; None
    where a column has no value. Combined by value in the tasks, a row per column reaches the driver."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    values = rows.select(w.alias("w"), F.explode(F.array(*[F.struct(
        F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x"))
    sums = values.where("x.v is not null").groupBy("x.c", "x.v").agg(F.sum("w").alias("w"))
    best = sums.groupBy("c").agg(F.min_by("v", F.struct(-F.col("w"), "v")).alias("v")).collect()
    return {c: None for c in columns} | {r["c"]: r["v"] for r in best}


def weighted_medians(rows: DataFrame, columns: Sequence[str], weight: str) -> dict:
    """The exact median of each number, every row counted ``weight`` times; None without a value.

    Meant for cells, whose numbers have few distinct values.
    """
    n = F.col(weight).cast("bigint")
    found = rows.where(n > 0).agg(*[F.percentile(F.col(c).cast("double"), F.lit(0.5), n).alias(c)
                                    for c in columns]).first()
    return found.asDict()


def preprocessor(train: DataFrame, features: Features, weight: str | None = None) -> list[object]:
    """Stages that impute, scale and encode; everything learned comes from ``train`` alone.

    Numbers: median, then standardised. Categories: most frequent value, then one-hot with unknown
    values ignored. With ``weight``, rows are cells of that many lines and fill values are those of the
    lines. Fill values are part of a SQL stage, so they are saved with the pipeline.
    """
    cats, nums = list(features.categorical), list(features.numeric)
    stages: list[object] = []
    if cats:
        modes = weighted_modes(train, cats, weight)

        def quoted(value: object) -> str:
            return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

        filled = ", ".join(f"coalesce({c}, {quoted(modes[c])}) AS {c}_f" for c in cats)
        stages += [
            SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
            StringIndexer(inputCols=[f"{c}_f" for c in cats], outputCols=[f"{c}_i" for c in cats],
                          handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}_i" for c in cats], outputCols=[f"{c}_v" for c in cats],
                          dropLast=True)]
    if nums:
        if weight:
            medians = weighted_medians(train, nums, weight)
            filled = ", ".join(f"coalesce(CAST({c} AS DOUBLE), {medians[c] or 0.0!r}D) AS {c}_n"
                               for c in nums)
            stages.append(SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"))
        else:
            stages.append(Imputer(strategy="median", relativeError=0.001, inputCols=nums,
                                  outputCols=[f"{c}_n" for c in nums]))
        stages += [
            VectorAssembler(inputCols=[f"{c}_n" for c in nums], outputCol="numbers"),
            StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True)]
    parts = [f"{c}_v" for c in cats] + (["scaled"] if nums else [])
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def require_features(df: DataFrame, features: Features, label: str) -> None:
    missing = sorted({*features.all(), label} - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing for training: {', '.join(missing)}")


def numbers_as_double(df: DataFrame, features: Features) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in features.numeric})


def _weight(estimator: object) -> str | None:
    return estimator.getWeightCol() if estimator.isDefined("weightCol") else None


def _is_tree(estimator: object) -> bool:
    return isinstance(estimator, (RandomForestRegressor, GBTRegressor))


def binned_stages(prepared: PipelineModel, train: DataFrame, features: Features) -> list[object]:
    """``prepared``, which imputes, scales and encodes, for trees: numbers of more than ``BINS`` values are cut
    at their quantiles instead of scaled, which leaves the order that trees go by."""
    cats, nums = list(features.categorical), list(features.numeric)
    kept, bins = list(prepared.stages[:3 if cats else 0]), {c: f"{c}_n" for c in nums}
    if nums:
        imputer = prepared.stages[len(kept)]
        filled = imputer.transform(train)
        values = filled.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(
            F.col(f"{c}_n") + 0.0), F.lit(SKETCH))).alias(c) for c in nums]).first()
        wide = [c for c in nums if values[c] > BINS]
        kept.append(imputer)
        if wide:
            bins |= {c: f"{c}_bin" for c in wide}
            kept.append(QuantileDiscretizer(
                numBucketsArray=[BINS] * len(wide), inputCols=[f"{c}_n" for c in wide],
                outputCols=[f"{c}_bin" for c in wide], relativeError=BIN_ERROR, handleInvalid="keep"
            ).fit(filled))
    return [*kept, VectorAssembler(inputCols=[*[f"{c}_v" for c in cats], *bins.values()],
                                   outputCol="features")]


def _placed(stages: Sequence[object], rows: DataFrame, features: Features
            ) -> tuple[list[str], DataFrame, PipelineModel]:
    """The inputs of ``stages[-1]`` before categories are encoded, ``rows`` with them, and what encodes them."""
    at = 3 if features.categorical else 0
    keys = [f"{c}_f" for c in features.categorical] + list(
        stages[-1].getInputCols()[len(features.categorical):])
    return (keys, PipelineModel([*stages[:min(at, 1)], *stages[at:-1]]).transform(rows),
            PipelineModel([*stages[min(at, 1):at], stages[-1]]))


def binned_cells(stages: Sequence[object], train: DataFrame, features: Features, label: str) -> DataFrame:
    """Lines reduced to cells of equal ``stages[-1]`` inputs: the mean label, ``n`` lines and the features.

    At most the product of the levels and bins, however many lines there are. Where cells are few, the lines
    of each are dealt into parts by their hash, so that a forest has enough rows to bag.
    """
    keys, placed, encoder = _placed(stages, train, features)
    y = F.col(label).cast("double")
    known = placed.where(y.isNotNull())

    def dealt(parts: int) -> DataFrame:
        part = F.pmod(F.xxhash64(*features.all(), y), F.lit(parts)).alias("part")
        return staged(known.groupBy(*keys, part).agg(
            F.avg(y).alias(label), F.count(F.lit(1)).cast("double").alias("n")), "binned")

    cells = dealt(1)
    count = cells.agg(F.approx_count_distinct(F.struct(*keys))).first()[0]
    parts = min(PARTS, max(1, BAGGED // max(1, count)))
    if parts > 1:
        cells = dealt(parts)
    # A small table comes back in few partitions, but training a forest on it needs every core.
    cells = cells.repartition(train.sparkSession.sparkContext.defaultParallelism, *keys, "part")
    return encoder.transform(cells).select("features", label, "n")


def moment_rows(prepared: PipelineModel, train: DataFrame, features: Features, label: str) -> DataFrame:
    """A few rows of weight ``n`` per combination of categories, with the lines' sums, squares and products of
    numbers and label, and with the features of ``prepared``; least squares on them is that on the lines.

    The lines' covariance in a combination is L L' (Cholesky); its rows are the mean plus and minus each column of
    L, scaled by the root of the number of columns that are not 0. That is two rows a number at most, and never
    twice the lines. A combination with a label that is no number keeps that as its label, for the fit to refuse.
    """
    encoder = 3 if features.categorical else 0
    cats, nums = [f"{c}_f" for c in features.categorical], [f"{c}_n" for c in features.numeric]
    filled = PipelineModel([*prepared.stages[:min(encoder, 1)],
                            *prepared.stages[encoder:encoder + (1 if nums else 0)]]).transform(train)
    y = F.col(label).cast("double")
    names = [*nums, label]
    values = [*[F.col(c) for c in nums], y]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    rows = filled.groupBy(*cats).agg(
        F.count(F.lit(1)).cast("double").alias("lines"),
        F.max(F.when(y.isNull() | F.isnan(y), F.lit(1))).alias("unknown"),
        *[F.avg(v).alias(f"mean_{i}") for i, v in enumerate(values)],
        *[F.covar_pop(values[i], values[j]).alias(f"c_{i}_{j}") for i, j in pairs])
    for j in range(len(names)):  # column by column: what the earlier ones explain is taken away
        left = {i: reduce(lambda a, k, i=i: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j),
                          F.col(f"c_{i}_{j}")) for i in range(j, len(names))}
        kept = left[j] > F.col(f"c_{j}_{j}") * ALIASED
        rows = rows.withColumn(f"l_{j}_{j}", F.when(kept, F.sqrt(left[j])).otherwise(0.0))
        rows = rows.withColumns({f"l_{i}_{j}": F.when(F.col(f"l_{j}_{j}") > 0, v / F.col(f"l_{j}_{j}"))
                                 .otherwise(0.0) for i, v in left.items() if i > j})
    columns = [F.struct(*[(F.col(f"l_{i}_{j}") if i >= j else F.lit(0.0)).alias(f"v{i}")
                          for i in range(len(names))]) for j in range(len(names))]
    some = F.array_compact(F.array(*[F.when(F.col(f"l_{j}_{j}") > 0, x) for j, x in enumerate(columns)]))
    none = F.array(F.struct(*[F.lit(0.0).alias(f"v{i}") for i in range(len(names))]))
    rows = rows.withColumn("some", some).withColumn("rank", F.size("some"))
    signs = F.when(F.col("rank") > 0, F.array(F.lit(1.0), F.lit(-1.0))).otherwise(F.array(F.lit(1.0)))
    rows = rows.withColumn("sign", F.explode(signs)).withColumn(
        "l", F.explode(F.when(F.col("rank") > 0, F.col("some")).otherwise(none)))
    scale = F.col("sign") * F.sqrt(F.greatest(F.col("rank"), F.lit(1)).cast("double"))
    at = [F.col(f"mean_{i}") + scale * F.col(f"l.v{i}") for i in range(len(names))]
    points = staged(rows.select(
        *cats, *[x.alias(c) for c, x in zip(nums, at)], F.when(F.col("unknown").isNull(), at[-1]).alias(label),
        (F.col("lines") / F.greatest(F.lit(1), F.col("rank") * 2)).alias("n")), "moments")
    return PipelineModel([*prepared.stages[min(encoder, 1):encoder],
                          *prepared.stages[encoder + (1 if nums else 0):]]).transform(points).select(
                              "features", label, "n")


def fit_all(train: DataFrame, features: Features, models: Mapping[str, object], label: str = "label"
            ) -> dict[str, PipelineModel]:
    """Every estimator fitted on ``train``. Those without a weight share what is learned of the lines.

    Boosted trees on cells are those of the lines in the same bins: their predictions are constant in a cell. A
    forest bags cells or their parts, a million or more where there are as many lines. Its least number of lines in
    a leaf is kept as a least weight.
    """
    on_lines = [n for n, m in models.items() if _weight(m) is None]
    trees = [n for n in on_lines if _is_tree(models[n])]
    if on_lines:
        prepared = Pipeline(stages=preprocessor(train, features)).fit(train)
        encoded = prepared.transform(train)
    if trees:
        stages = binned_stages(prepared, train, features)
        cells = binned_cells(stages, train, features, label)
        lines = cells.agg(F.sum("n")).first()[0] or 0.0

    def one(name: str) -> PipelineModel:
        m = models[name]
        if name in trees:
            least = m.getMinInstancesPerNode()
            more = {m.weightCol: "n", m.minInstancesPerNode: 1}
            if isinstance(m, RandomForestRegressor) and m.getMaxDepth() <= SHALLOW:
                # Each row's node is kept, so that a pass looks at one split of a tree; a copy on disk for every
                # few passes would be many times the input.
                more |= {m.maxMemoryInMB: GROUP_MB, m.cacheNodeIds: True, m.checkpointInterval: -1}
            if least > 1:  # below half a line less, so that rounding refuses no leaf of just as many
                more[m.minWeightFractionPerNode] = min(0.49, (least - 0.5) / max(lines, 1.0))
            return PipelineModel([*stages, m.copy(more).fit(cells)])
        if name in on_lines and isinstance(m, LinearRegression) and m.getLoss() == "squaredError":
            rows = moment_rows(prepared, train, features, label)
            return PipelineModel([*prepared.stages, m.copy({m.weightCol: "n"}).fit(rows)])
        if name in on_lines:
            return PipelineModel([*prepared.stages, m.fit(encoded)])
        return Pipeline(stages=[*preprocessor(train, features, _weight(m)), m]).fit(train)

    return dict(zip(models, in_parallel([lambda n=n: one(n) for n in models]), strict=True))


def fit(train: DataFrame, features: Features, estimator: object) -> PipelineModel:
    return fit_all(train, features, {"": estimator}, estimator.getLabelCol())[""]


def training_cells(lines: DataFrame, target: str, keys: Sequence[str] = CELL_KEYS,
                   extra: Sequence[str] = ()) -> DataFrame:
    """Lines reduced to (features, ``extra``) cells: ``label`` is the mean target, ``n`` the lines.

    ``label_sq`` keeps the sum of squares, so that errors over lines follow from the cells.
    """
    y = F.col(target).cast("double")
    return (lines.where(y.isNotNull()).groupBy(*keys, *extra)
            .agg(F.avg(y).alias("label"), F.count(F.lit(1)).cast("double").alias("n"),
                 F.sum(y * y).alias("label_sq")))


def metrics(scored: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """R2, RMSE and MAE of ``prediction`` against ``label``, per group."""
    y, e = F.col(label).cast("double"), F.col(label) - F.col("prediction")
    sums = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("sst"))
    return sums.select(*by, (F.lit(1.0) - F.col("sse") / F.nullif(F.col("sst"), F.lit(0.0)))
                       .alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae")


def cell_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """R2 and RMSE over the lines behind weighted cells."""
    s, n, p = F.col("label") * F.col("n"), F.col("n"), F.col("prediction")
    sums = scored.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(s).alias("s"), F.sum("label_sq").alias("q"),
        F.sum(F.col("label_sq") - p * 2 * s + p * p * n).alias("sse"))
    sst = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return sums.select(*by, (F.lit(1.0) - F.col("sse") / F.nullif(sst, F.lit(0.0))).alias("r2"),
                       F.sqrt(F.greatest(F.col("sse"), F.lit(0.0)) / F.col("n")).alias("rmse"))


def in_parallel(tasks: Sequence[Callable[[], object]], width: int = 4) -> list:
    """Run independent fits side by side; Spark interleaves their jobs."""
    with ThreadPoolExecutor(max_workers=width) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def holdout_report(train: DataFrame, test: DataFrame, features: Features,
                   models: Mapping[str, object], label: str = "label"
                   ) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """``(model, r2, rmse, mae, tier)`` on the held-out lines, best R2 first, and the models."""
    require_features(train, features, label)
    fitted = fit_all(train, features, models, label)
    trees = {n: m for n, m in fitted.items() if _is_tree(models[n]) and _weight(models[n]) is None}
    rows = [metrics(m.transform(test), label=label).withColumn("model", F.lit(n))
            for n, m in fitted.items() if n not in trees]
    if trees:
        rows.append(_binned_metrics(trees, test, features, label))
    tier = F.create_map(*[F.lit(x) for n in fitted for x in (n, TIERS[n])])
    rows = [r.withColumn("interpretability_tier", tier[F.col("model")]) for r in rows]
    # A row per model, stored so that sorting and choosing score the lines once.
    return staged(union(rows), "report").orderBy(F.desc("r2"), "model"), fitted


def _metrics_of(scored: DataFrame, columns: Mapping[str, str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """(model, r2, rmse, mae) of several models' predictions in the same rows, by their ``columns``, per group."""
    y, n = F.col(label).cast("double"), F.count(F.lit(1))
    errors = {c: y - F.col(c) for c in columns.values()}
    sums = scored.groupBy(*by).agg(
        n.alias("n"), (F.var_pop(y) * n).alias("sst"),
        *[F.sum(e * e).alias(f"sse_{c}") for c, e in errors.items()],
        *[F.avg(F.abs(e)).alias(f"mae_{c}") for c, e in errors.items()])
    each = sums.select(*by, F.explode(F.array(*[F.struct(
        F.lit(name).alias("model"),
        (F.lit(1.0) - F.col(f"sse_{c}") / F.nullif(F.col("sst"), F.lit(0.0))).alias("r2"),
        F.sqrt(F.col(f"sse_{c}") / F.col("n")).alias("rmse"), F.col(f"mae_{c}").alias("mae"))
        for name, c in columns.items()])).alias("m"))
    return each.select("m.*", *by)


def _binned_metrics(fitted: Mapping[str, PipelineModel], test: DataFrame, features: Features, label: str
                    ) -> DataFrame:
    """(r2, rmse, mae, model) of trees on bins over ``test``: the distinct cells are scored, in dense vectors as a
    tree looks into them at every node, and the lines meet all predictions of their cell."""
    stages = next(iter(fitted.values())).stages[:-1]
    keys, placed, encoder = _placed(stages, test, features)
    columns = {n: f"p_{i}" for i, n in enumerate(fitted)}
    # Cells take few bytes, but scoring them needs every core; neighbours in order go the same ways in the trees.
    scored = encoder.transform(placed.select(*keys).distinct().repartition(
        test.sparkSession.sparkContext.defaultParallelism, *keys).sortWithinPartitions(*keys))
    scored = scored.select(*keys, array_to_vector(vector_to_array("features")).alias("features"))
    for name, column in columns.items():
        kept = scored.columns
        scored = fitted[name].stages[-1].transform(scored).select(*kept, F.col("prediction").alias(column))
    by_cell = staged(scored.drop("features"), "predictions")
    # Filled values are never null.
    return _metrics_of(placed.select(*keys, label).join(by_cell, keys, "left"), columns, label).select(
        "r2", "rmse", "mae", "model")


def _scored_lines(fitted: Mapping[tuple[str, int], PipelineModel], cells: DataFrame, lines: DataFrame,
                  features: Features, label: str) -> DataFrame:
    """(model, fold, r2, rmse, mae) of models by (name, fold) over ``lines``: the distinct cells of features are
    scored, and the lines meet all predictions of their cell in one scan."""
    keys, names = features.all(), list(dict.fromkeys(n for n, _ in fitted))
    columns = [f"p_{i}" for i in range(len(names))]

    def of_fold(k: int) -> DataFrame:
        scored = cells.where(F.col("fold") == k).select(*keys, "fold").distinct()
        for column, name in zip(columns, names, strict=True):
            kept = scored.columns
            scored = fitted[name, k].transform(scored).select(*kept, F.col("prediction").alias(column))
        return scored

    # Stored so that Spark knows the size of a table that follows the cells, not the lines.
    by_cell = staged(union([of_fold(k) for k in dict.fromkeys(k for _, k in fitted)]), "predictions")
    right = by_cell.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate([*keys, "fold"])], *columns)
    same = reduce(lambda x, z: x & z, [lines[c].eqNullSafe(right[f"_{i}"])
                                       for i, c in enumerate([*keys, "fold"])])
    return _metrics_of(lines.join(right, same, "left"), dict(zip(names, columns, strict=True)), label, ["fold"])


def cross_validate(rows: DataFrame, features: Features, models: Mapping[str, object],
                   folds: int = FOLDS, label: str = "label", cells: bool = False,
                   lines: DataFrame | None = None) -> DataFrame:
    """``(model, fold, r2, rmse[, mae])``: each fold scored by a fit on the others.

    ``rows`` carries a ``fold`` column. With ``cells``, rows are weighted cells and give R2 and RMSE
    only; with ``lines``, fits use ``rows``, their cells, and the folds of the lines are scored.
    """
    def one(name: str, k: int) -> tuple[PipelineModel, DataFrame | None]:
        model = fit(rows.where(F.col("fold") != k), features, models[name])
        if lines is not None:
            return model, None
        scored = model.transform(rows.where(F.col("fold") == k))
        out = cell_metrics(scored) if cells else metrics(scored, label=label)
        return model, out.withColumns({"model": F.lit(name), "fold": F.lit(k)})

    pairs = [(n, k) for n in models for k in range(folds)]
    done = in_parallel([lambda n=n, k=k: one(n, k) for n, k in pairs])
    if lines is not None:
        fitted = {pair: model for pair, (model, _) in zip(pairs, done, strict=True)}
        return _scored_lines(fitted, rows, lines.where(F.col("fold").between(0, folds - 1)), features, label)
    return union([scored for _, scored in done])


def cv_summary(per_fold: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and (positive) deviation of every metric over the folds."""
    measures = [c for c in ("r2", "rmse", "mae") if c in per_fold.columns]
    return per_fold.groupBy(*by).agg(*[x for m in measures for x in (
        F.avg(m).alias(f"cv_{m}_mean"), F.stddev_samp(m).alias(f"cv_{m}_std"))])


def mode_means(train: DataFrame, test: DataFrame, label: str, by: Sequence[str] = ("ship_mode",)
               ) -> DataFrame:
    """``test`` with the mean label of its group in ``train`` as prediction: the simplest model."""
    means = train.groupBy(*by).agg(F.avg(label).alias("prediction"))
    return test.join(means, list(by))


def cross_validated_means(rows: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    """``rows`` with the mean label of their group over the other folds as prediction.

    Sums per (group, fold) give every fold's prediction by subtraction, in one scan.
    """
    sums = rows.groupBy(*by, "fold").agg(F.sum(label).alias("s"), F.count(label).alias("n"))
    group = Window.partitionBy(*by)
    others = ((F.sum("s").over(group) - F.col("s"))
              / F.nullif(F.sum("n").over(group) - F.col("n"), F.lit(0)))
    return rows.join(sums.select(*by, "fold", others.alias("prediction")), [*by, "fold"])


def select_best(report: DataFrame, tolerance: float = SELECTION_TOLERANCE,
                score: str = "cv_r2_mean") -> DataFrame:
    """The simplest model within ``tolerance`` of the best score."""
    best = report.agg(F.max(score).alias("b")).scalar()
    return (report.withColumn("best_score", best).where(F.col(score) >= F.col("best_score")
                                                        - tolerance)
            .orderBy("interpretability_tier", F.desc(score), "model").limit(1))


def residual_std(scored: DataFrame, key: str = "product_name", label: str = "label") -> DataFrame:
    """Held-out residual deviation and count per product; below two rows the overall deviation."""
    residuals = scored.select(key, (F.col(label) - F.col("prediction")).alias("r"))
    sums = residuals.groupBy(key).agg(F.count("r").alias("n"), F.sum("r").alias("s"),
                                      F.sum(F.col("r") * F.col("r")).alias("q"))
    overall = sums.agg(sample_std(F.sum("n"), F.sum("s"), F.sum("q")).alias("g")).scalar()
    return sums.select(key, F.coalesce(sample_std(F.col("n"), F.col("s"), F.col("q")), overall)
                       .alias("residual_std"), F.col("n").alias("holdout_count"))


def _with_parts(model: object, rows: DataFrame, features: Features) -> DataFrame | None:
    """``rows`` with ``own``, what each feature adds to the prediction, and ``prediction``; None for a
    model that does not add up by feature."""
    if isinstance(model, LinearModel):
        parts, intercept = model.parts()
        encoded = rows
    elif isinstance(model, PipelineModel) and isinstance(model.stages[-1], LinearRegressionModel):
        fitted, cats, nums = model.stages[-1], list(features.categorical), list(features.numeric)
        weights, at, parts = fitted.coefficients.toArray().tolist(), 0, {}
        for c, levels in zip(cats, model.stages[1].labelsArray if cats else [], strict=True):
            known = F.array(*[F.lit(w) for w in weights[at:at + len(levels)]], F.lit(0.0))
            parts[c] = F.coalesce(F.get(known, F.col(f"{c}_i").cast("int")), F.lit(0.0))
            at += len(levels)
        scaled = vector_to_array("scaled") if nums else None
        parts |= {c: scaled[k] * weights[at + k] for k, c in enumerate(nums)}
        intercept = F.lit(fitted.intercept)
        encoded = PipelineModel(model.stages[:-1]).transform(rows)
    else:
        return None
    own = F.array(*[parts[c] for c in features.all()])
    return (encoded.withColumn("own", own).withColumn("intercept", intercept)
            .withColumn("prediction", F.aggregate("own", F.col("intercept"), lambda a, x: a + x)))


def permutation_importance(model: PipelineModel, test: DataFrame, features: Features, key: Column,
                           repeats: int = 5, label: str = "label") -> DataFrame:
    """Mean and deviation of the R2 lost when one feature is shuffled among the held-out rows.

    Rows are numbered by the hash of their key, and once per repeat by the hash of key and repeat;
    a row's partner is the row with its number in the other order. Only numbers are sorted: the features
    cross the shuffle once to meet them and once per repeat to reach their partner. There every feature's
    prediction is added to the row in place and errors are summed per repeat, so nothing is expanded by
    feature. ``model`` is anything whose ``transform`` adds a ``prediction``; of a linear one, each row is
    scored once, and what a feature adds to the prediction is exchanged in its place.
    """
    names = features.all()
    y = F.col(label).cast("double")
    named = test.withColumn("_key", key.cast("string"))
    added = _with_parts(model, named, features)
    linear = added is not None
    if not linear:
        added = model.transform(named.withColumn("own", F.struct(*names)))
    rows = added.select("own", y.alias("y"), "_key", F.col("prediction").alias("p_whole"),
                        *(["intercept"] if linear else []))
    base = staged(with_hash_index(rows, F.col("_key"), "_at"), "numbered")
    orders = base.select("_key", "_at", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    numbers = with_hash_index(orders, F.concat_ws("#", "_key", "repeat"), "_to", by=["repeat"]).select(
        "repeat", "_at", "_to")
    moved = base.select("_at", F.col("own").alias("other")).join(numbers, "_at").select(
        "repeat", "other", F.col("_to").alias("_at"))
    scored = base.drop("_key").join(moved, "_at").drop("_at")

    variants = {"p_whole": None} | {f"p_{i}": n for i, n in enumerate(names)}
    for i, n in enumerate(names):
        if linear:
            # Added up anew: a value that lacks makes the whole prediction null, not the one without it.
            scored = scored.withColumn(f"p_{i}", reduce(lambda a, x: a + x, [
                F.col("other" if j == i else "own")[j] for j in range(len(names))], F.col("intercept")))
            continue
        placed = scored.select("*", *[F.col("other" if n == c else "own")[c].alias(c) for c in names])
        scored = model.transform(placed).select(*scored.columns, F.col("prediction").alias(f"p_{i}"))

    y = F.col("y")
    sums = scored.groupBy("repeat").agg((F.var_pop(y) * F.count(F.lit(1))).alias("sst"), *[
        F.sum((y - F.col(c)) * (y - F.col(c))).alias(c) for c in variants])
    sst = F.nullif(F.col("sst"), F.lit(0.0))
    lost = sums.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("feature"), ((F.col(c) - F.col("p_whole")) / sst).alias("r2_lost"))
        for c, n in variants.items() if n is not None])).alias("v")).select("v.*")
    return lost.groupBy("feature").agg(
        F.avg("r2_lost").alias("importance_mean"),
        F.coalesce(F.stddev_pop("r2_lost"), F.lit(0.0)).alias("importance_std"))


def temporal_split(rows: DataFrame, date: str = "order_date", share: float = 0.8) -> DataFrame:
    """Add ``is_late``: dated after the ``share`` quantile of the dates.

    Rows are counted per day first, so the quantile reads one row per calendar day.
    """
    day = F.unix_date(F.col(date))
    per_day = rows.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    cut = per_day.agg(F.percentile("day", F.lit(share), F.col("n")).alias("c")).scalar()
    return rows.withColumn("is_late", F.unix_date(F.col(date)) > cut)


def predictor(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    """The model as a function from a factory grid to ``predicted_days``."""
    def predict(grid: DataFrame) -> DataFrame:
        named = grid.withColumns({"_incumbent": F.col("current_factory"),
                                  "current_factory": F.col("factory")})
        scored = model.transform(named)
        return scored.withColumns({"predicted_days": F.col("prediction"),
                                   "current_factory": F.col("_incumbent")}).drop("_incumbent")
    return predict


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
