"""Least squares from sums against numpy and Spark ML."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from haulmark.operators import normal_equations as lsq

SETS = {"numbers": lsq.FeatureSet(["a", "b"]), "levels": lsq.FeatureSet([], ["c", "d"]),
        "all": lsq.FeatureSet(["a", "b"], ["c", "d"])}


def sample(n=600, seed=3):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"a": rng.normal(900, 300, n).round(3), "b": rng.integers(1, 50, n) * 1.0,
                          "c": rng.choice(list("xyz"), n), "d": rng.choice(["p", "q", "r", "s"], n),
                          "fold": rng.integers(0, 5, n).astype("int32")})
    frame["y"] = (2 + 0.01 * frame.a - 0.3 * frame.b + frame.c.map({"x": 0, "y": 4, "z": -1})
                  + rng.normal(0, 3, n))
    return frame


def design(frame, s):
    columns = [np.ones(len(frame)), *[frame[c].to_numpy() for c in s.numeric]]
    columns += [(frame[c] == v).to_numpy(float) for c in s.categorical for v in "xyzpqrs"]
    return np.stack(columns, 1)


def numpy_scores(train, test, s):
    beta = np.linalg.lstsq(design(train, s), train.y.to_numpy(), rcond=None)[0]
    e = test.y.to_numpy() - design(test, s) @ beta
    sst = ((test.y - test.y.mean()) ** 2).sum()
    return 1 - (e @ e) / sst, np.sqrt((e @ e) / len(e))


def test_every_fold_and_set_equals_refits(spark):
    frame = sample()
    sums = lsq.moments(spark.createDataFrame(frame), SETS["all"], "y", "fold")
    got = {(r["set"], r["case"]): r for r in lsq.scores(lsq.solved(
        lsq.leave_one_out(sums, SETS, 5))).collect()}
    assert len(got) == 15
    for (name, k), r in got.items():
        r2, rmse = numpy_scores(frame[frame.fold != k], frame[frame.fold == k], SETS[name])
        assert r["r2"] == pytest.approx(r2, abs=1e-9) and r["rmse"] == pytest.approx(rmse, rel=1e-9)
        assert r["n"] == (frame.fold == k).sum()
    summary = {r["set"]: r for r in lsq.cross_validated(
        spark.createDataFrame(frame), SETS, "y", "fold", 5).collect()}
    for name in SETS:
        each = [got[name, k]["r2"] for k in range(5)]
        assert summary[name]["cv_r2_mean"] == pytest.approx(np.mean(each))
        assert summary[name]["cv_r2_std"] == pytest.approx(np.std(each, ddof=1))


@pytest.mark.parametrize("penalty", [0.0, 1.0])
def test_equals_spark_ml_within_1e_6(spark, penalty):
    """The same predictions as Spark's normal solver, which scales its penalty by the target's deviation."""
    pandas = sample()
    frame = spark.createDataFrame(pandas).withColumn("late", F.col("fold") == 0)
    for v in "xy":  # a reference level keeps Spark's system regular
        frame = frame.withColumn(f"is_{v}", (F.col("c") == v).cast("double"))
    s = lsq.FeatureSet(["a", "b", "is_x", "is_y"])
    own = penalty / pandas[pandas.fold != 0].y.std(ddof=0)
    fitted = lsq.solved(lsq.one_against(lsq.moments(frame, s, "y", "late"), {"s": s}), own)
    built = VectorAssembler(inputCols=list(s.numeric), outputCol="features").transform(frame)
    model = LinearRegression(labelCol="y", solver="normal", regParam=penalty, elasticNetParam=0.0
                             ).fit(built.where(~F.col("late")))
    both = model.transform(built).select("prediction", lsq.prediction(fitted, s).alias("own")).collect()
    assert max(abs(r["prediction"] - r["own"]) for r in both) < 1e-6
    beta = {r["name"]: r["beta"] for r in lsq.coefficients(fitted).collect()}
    assert beta["(one)"] == pytest.approx(model.intercept, abs=1e-6)


def test_ridge_equals_the_penalised_equations(spark):
    frame = sample()
    train = frame[frame.fold != 0]
    s = SETS["all"]
    rows = spark.createDataFrame(frame).withColumn("late", F.col("fold") == 0)
    fitted = lsq.solved(lsq.one_against(lsq.moments(rows, s, "y", "late"), {"s": s}), 0.5)
    beta = {r["name"]: r["beta"] for r in lsq.coefficients(fitted).collect()}
    names = sorted(beta)
    x = np.stack([np.ones(len(train)) if n == "(one)" else train[n] if "=" not in n else
                  train[n[0]] == n[2:] for n in names], 1).astype(float)
    spread = x.var(0) * len(train) * 0.5
    spread[0] = 0
    want = np.linalg.solve(x.T @ x + np.diag(spread), x.T @ train.y.to_numpy())
    assert [beta[n] for n in names] == pytest.approx(want, rel=1e-6, abs=1e-8)


def test_aliased_and_absent_levels(spark):
    """A repeated column and a level that training lacks get 0 and change no prediction."""
    rows = [(float(i), float(i), "old" if i < 40 else "new", i >= 40, 3.0 * i + 1) for i in range(50)]
    frame = spark.createDataFrame(rows, "a double, twin double, c string, late boolean, y double")
    s = lsq.FeatureSet(["a", "twin"], ["c"])
    fitted = lsq.solved(lsq.one_against(lsq.moments(frame, s, "y", "late"), {"s": s}))
    beta = {r["name"]: r["beta"] for r in lsq.coefficients(fitted).collect()}
    assert beta["twin"] == beta["c=new"] == beta["c=old"] == 0 and beta["a"] == pytest.approx(3)
    score = lsq.scores(fitted).first()
    assert score["n"] == 10 and score["r2"] == pytest.approx(1) and score["rmse"] < 1e-6


def test_nulls_and_empty(spark):
    rows = [(1.0, "x", 0, 2.0), (2.0, None, 0, 3.0), (None, "x", 0, 9.0), (3.0, "x", 1, None),
            (4.0, "y", 1, 5.0), (5.0, None, 1, 6.0), (6.0, None, 1, 7.0)]
    frame = spark.createDataFrame(rows, "a double, c string, fold int, y double")
    s = {"s": lsq.FeatureSet(["a"], ["c"])}
    sums = lsq.moments(frame, s["s"], "y", "fold")
    ones = {r["part"]: r["v"] for r in sums.where("i = '(one)' and j = '(one)'").collect()}
    assert ones == {0: 2, 1: 3}
    each = {r["case"]: r for r in lsq.scores(lsq.solved(lsq.leave_one_out(sums, s, 3))).collect()}
    assert each[1]["n"] == 3 and each[2]["n"] == 0 and each[2]["r2"] is None
    empty = lsq.cross_validated(frame.limit(0), s, "y", "fold", 3)
    assert empty.count() == 0


def test_numbers_make_no_cells(spark):
    """Lines meet one grouped sum by part and categories; numbers are summed there, whatever their values."""
    frame = spark.createDataFrame(sample())
    plan = lsq.moments(frame, SETS["all"], "y", "fold")._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("Aggregate [")[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert [k.split("#")[0] for k in keys[-1].split(", ")] == ["fold", "c", "d"]
