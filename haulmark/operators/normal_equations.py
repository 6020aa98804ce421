"""Least squares from sufficient statistics: one scan for any number of folds and feature sets.

A row's features are an intercept, numbers, and one indicator per level of a category. The sums of the
products of all pairs of features, and of features with the target, are collected per part (a fold, a
hold-out side) in one grouped sum; only pairs that occur have a row, at most the square of the number of
levels. Whatever is fitted afterwards reads that table: training on all folds but one is the total less
the fold, a smaller feature set is a sub-matrix, and the error on the part left out is a quadratic form in
that part's own sums. Neither fits nor scores touch the lines again.

Each system is solved in place by Gauss-Jordan elimination in array functions. A feature that the earlier
ones explain (the last level of a category beside an intercept, a level absent in training) gets the
coefficient 0, which leaves the predictions of least squares as they are. With a penalty the solution is
ridge regression on standardised features with a free intercept.

Defined results: rows with a null target or a null number are left out; a null category sets no level. Without
rows there are no scores; a part without variation of the target has no R2.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE, TARGET = "(one)", "(target)"  # sort before the features' names
ALIASED = 1e-10


@dataclass(frozen=True)
class FeatureSet:
    numeric: Sequence[str] = ()
    categorical: Sequence[str] = ()

    def all(self) -> list[str]:
        return [*self.numeric, *self.categorical]


def moments(rows: DataFrame, features: FeatureSet, target: str, part: str) -> DataFrame:
    """(part, i, j, v): sums over rows of the product of features ``i`` and ``j``, ``i`` named before
    ``j`` in the row, and of features with the target.

    Rows are summed per combination of categories first, with the sums of the products of all numbers in
    the same row; a number of any precision makes no cell of its own. Only these cells are expanded.
    """
    y = F.col(target).cast("double")
    nums = {c: F.col(c).cast("double") for c in features.numeric}
    known = y.isNotNull()
    for x in nums.values():
        known = known & x.isNotNull()
    sums = {(ONE, ONE): F.count(F.lit(1)).cast("double"), (ONE, TARGET): F.sum(y),
            (TARGET, TARGET): F.sum(y * y)}
    names = list(nums)
    for at, a in enumerate(names):
        sums |= {(ONE, a): F.sum(nums[a]), (a, TARGET): F.sum(nums[a] * y)}
        sums |= {(a, b): F.sum(nums[a] * nums[b]) for b in names[at:]}
    cells = rows.where(known).groupBy(F.col(part).alias("part"), *features.categorical).agg(
        F.struct(*[v.alias(f"v{k}") for k, v in enumerate(sums.values())]).alias("sums"))
    at_pair = {pair: F.col("sums")[f"v{k}"] for k, pair in enumerate(sums)}

    def product(i: Column, j: Column, v: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), v.alias("v"))

    levels = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
        for c in features.categorical]).cast("array<string>"))
    held = cells.select("part", "sums", levels.alias("levels"))
    one = at_pair[ONE, ONE]

    def of(level: Column, at: Column) -> Column:
        later = F.slice("levels", at + 1, F.size("levels"))
        return F.concat(
            F.array(product(F.lit(ONE), level, one)),
            F.array(*[product(F.lit(a), level, at_pair[ONE, a]) for a in names])
            if names else F.array().cast("array<struct<i:string,j:string,v:double>>"),
            F.transform(later, lambda other: product(level, other, one)),
            F.array(product(level, F.lit(TARGET), at_pair[ONE, TARGET])))

    products = F.concat(
        F.array(*[product(F.lit(a), F.lit(b), v) for (a, b), v in at_pair.items()]),
        F.flatten(F.transform("levels", of)))
    return (held.select("part", F.explode(products).alias("p"))
            .groupBy("part", F.col("p.i").alias("i"), F.col("p.j").alias("j"))
            .agg(F.sum("p.v").alias("v")))


def _of_sets(sums: DataFrame, sets: Mapping[str, FeatureSet]) -> DataFrame:
    """``sums`` once for each set that has both features, with the set's name."""
    def held(name: Column, terms: Sequence[str]) -> Column:
        return F.substring_index(name, "=", 1).isin([ONE, TARGET, *terms])

    names = F.array(*[F.when(held(F.col("i"), s.all()) & held(F.col("j"), s.all()), F.lit(name))
                      for name, s in sets.items()])
    return sums.withColumn("set", F.explode(F.array_compact(names)))


def leave_one_out(sums: DataFrame, sets: Mapping[str, FeatureSet], parts: int) -> DataFrame:
    """(set, case, i, j, train, test): each part 0..parts-1 against all others, by subtraction."""
    of_pair = _of_sets(sums, sets).groupBy("set", "i", "j").agg(
        F.sum("v").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("part", "v"))).alias("own"))  # one per part
    test = F.coalesce(F.try_element_at("own", F.col("case")), F.lit(0.0))
    return (of_pair.withColumn("case", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            .select("set", "case", "i", "j", (F.col("total") - test).alias("train"),
                    test.alias("test")))


def one_against(sums: DataFrame, sets: Mapping[str, FeatureSet]) -> DataFrame:
    """(set, case, i, j, train, test): trained where the part is false, tested where it is true."""
    def side(wanted: bool) -> Column:
        return F.coalesce(F.sum(F.when(F.col("part") == wanted, F.col("v"))), F.lit(0.0))

    return _of_sets(sums, sets).groupBy("set", F.lit(0).alias("case"), "i", "j").agg(
        side(False).alias("train"), side(True).alias("test"))


def _dense(held: str, names: str = "names") -> Column:
    """The matrix of a map of pairs, a row per feature, the products with the target last."""
    def at(i: Column, j: Column) -> Column:
        return F.coalesce(F.try_element_at(held, F.concat_ws("\t", i, j)),
                          F.try_element_at(held, F.concat_ws("\t", j, i)), F.lit(0.0))

    return F.transform(names, lambda i: F.concat(
        F.transform(names, lambda j: at(i, j)), F.array(at(i, F.lit(TARGET)))))


def _penalised(penalty: float) -> Column:
    """Ridge: the penalty times rows and variance on the diagonal, the intercept's aside."""
    n = F.get(F.get("raw", F.lit(0)), F.lit(0))

    def row(values: Column, i: Column) -> Column:
        spread = F.get(values, i) - F.get(values, F.lit(0)) * F.get(values, F.lit(0)) / n
        return F.transform(values, lambda v, j: F.when((i == j) & (i > 0), v + spread * penalty)
                           .otherwise(v))

    return F.transform("raw", row) if penalty else F.col("raw")


def _solution() -> Column:
    """The coefficients of the system in ``train``, 0 for features that earlier ones explain."""
    diagonal = F.transform("train", lambda row, i: F.get(row, i))

    def eliminate(state: Column, k: Column) -> Column:
        m, pivot_row = state["m"], F.get(state["m"], k)
        pivot = F.get(pivot_row, k)
        fine = pivot > F.get(diagonal, k) * ALIASED
        cleared = F.transform(m, lambda row, i: F.when(
            i == k, F.transform(row, lambda x: x / pivot)).otherwise(
            F.zip_with(row, pivot_row, lambda x, p: x - F.get(row, k) / pivot * p)))
        return F.struct(F.when(fine, cleared).otherwise(m).alias("m"),
                        F.concat(state["used"], F.array(fine)).alias("used"))

    start = F.struct(F.col("train").alias("m"), F.array().cast("array<boolean>").alias("used"))
    last = F.size("names")
    return F.aggregate(
        F.sequence(F.lit(0), last - 1), start, eliminate,
        lambda state: F.zip_with(state["m"], state["used"], lambda row, used: F.when(
            used, F.get(row, last)).otherwise(0.0)))


def solved(pairs: DataFrame, penalty: float = 0.0) -> DataFrame:
    """(set, case, names, beta, test, yy): the coefficients of each case, and the sums it is tested on.

    ``pairs`` as :func:`leave_one_out` makes them. A case is one row, as large as its matrix.
    """
    key = F.concat_ws("\t", "i", "j")
    held = pairs.groupBy("set", "case").agg(
        F.array_sort(F.collect_set(F.when(F.col("i") != TARGET, F.col("i")))).alias("names"),
        F.map_from_entries(F.collect_list(F.struct(key, "train"))).alias("train_map"),
        F.map_from_entries(F.collect_list(F.struct(key, "test"))).alias("test_map"))
    dense = held.select("set", "case", "names", _dense("train_map").alias("raw"),
                        _dense("test_map").alias("test"), F.element_at(
                            "test_map", F.lit(f"{TARGET}\t{TARGET}")).alias("yy"))
    systems = dense.withColumn("train", _penalised(penalty))
    return systems.withColumn("beta", _solution()).select("set", "case", "names", "beta", "test", "yy")


def scores(fitted: DataFrame) -> DataFrame:
    """(set, case, n, r2, rmse) on the part left out, from its sums alone."""
    last = F.size("names")
    fits = F.zip_with("test", "beta", lambda row, b: F.struct(row.alias("row"), b.alias("b")))
    # sum over i of b_i (sum over j of b_j t_ij - 2 t_iy)
    change = F.aggregate(fits, F.lit(0.0), lambda total, f: total + f["b"] * (
        F.aggregate(F.zip_with(f["row"], "beta", lambda t, b: F.coalesce(t * b, F.lit(0.0))),
                    F.lit(0.0), lambda a, x: a + x) - 2 * F.get(f["row"], last)))
    ones = F.get("test", F.lit(0))
    n, s = F.get(ones, F.lit(0)), F.get(ones, last)
    sse = F.greatest(F.col("yy") + change, F.lit(0.0))
    sst = F.col("yy") - s * s / F.nullif(n, F.lit(0.0))
    return fitted.select("set", "case", n.alias("n"), (1 - sse / F.when(sst > 0, sst)).alias("r2"),
                         F.sqrt(sse / F.nullif(n, F.lit(0.0))).alias("rmse"))


def cross_validated(rows: DataFrame, sets: Mapping[str, FeatureSet], target: str, fold: str,
                    folds: int, penalty: float = 0.0) -> DataFrame:
    """(set, cv_r2_mean, cv_r2_std, cv_rmse_mean, cv_rmse_std) over the folds."""
    whole = FeatureSet(list(dict.fromkeys(c for s in sets.values() for c in s.numeric)),
                       list(dict.fromkeys(c for s in sets.values() for c in s.categorical)))
    each = scores(solved(leave_one_out(moments(rows, whole, target, fold), sets, folds), penalty))
    return each.groupBy("set").agg(*[x for m in ("r2", "rmse") for x in (
        F.avg(m).alias(f"cv_{m}_mean"), F.stddev_samp(m).alias(f"cv_{m}_std"))])


def coefficients(fitted: DataFrame) -> DataFrame:
    """(set, case, name, beta), a row per feature."""
    return fitted.select("set", "case", F.explode(F.arrays_zip("names", "beta")).alias("c")).select(
        "set", "case", F.col("c.names").alias("name"), F.col("c.beta").alias("beta"))


def _parts(fitted: DataFrame, features: FeatureSet) -> tuple[dict[str, Column], Column]:
    held = fitted.agg(F.first(F.map_from_arrays("names", "beta")).alias("m")).scalar()

    def weight(name: Column) -> Column:
        return F.coalesce(F.try_element_at(held, name), F.lit(0.0))

    parts = {c: weight(F.lit(c)) * F.col(c).cast("double") for c in features.numeric}
    parts |= {c: weight(F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in features.categorical}
    return parts, weight(F.lit(ONE))


def prediction(fitted: DataFrame, features: FeatureSet) -> Column:
    """The prediction for any row with the features, from a fit of one set and case.

    The coefficients are one map in a scalar subquery, so rows are scored where they are. A level
    without a coefficient adds nothing.
    """
    parts, intercept = _parts(fitted, features)
    return sum(parts.values(), intercept)


@dataclass(frozen=True)
class LinearModel:
    """A fit whose ``transform`` adds ``prediction``, like a fitted pipeline's."""
    fitted: DataFrame
    features: FeatureSet

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", prediction(self.fitted, self.features))

    def parts(self) -> tuple[dict[str, Column], Column]:
        """What each feature adds to a row's prediction, and the intercept."""
        return _parts(self.fitted, self.features)


def predictor(fitted: DataFrame, features: FeatureSet) -> Callable[[DataFrame], DataFrame]:
    """The fit as a function from a factory grid to ``predicted_days``."""
    def predict(grid: DataFrame) -> DataFrame:
        moved = grid.withColumns({"incumbent_factory": F.col("current_factory"),
                                  "current_factory": F.col("factory")})
        return (moved.withColumn("predicted_days", prediction(fitted, features))
                .withColumn("current_factory", F.col("incumbent_factory")).drop("incumbent_factory"))
    return predict
