"""Euclidean silhouette and deterministic k-means against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulmark.operators import clusters, lloyd


def frame(spark, points, labels=None):
    labels = labels if labels is not None else [0] * len(points)
    return spark.createDataFrame([(i, float(x), float(y), int(c)) for i, ((x, y), c) in
                                  enumerate(zip(points, labels))],
                                 "id int, x double, y double, cluster int")


def brute_silhouette(points, labels):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    out = []
    for i in range(len(points)):
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("block", [4, 1000])
def test_euclidean_silhouette(spark, block):
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(c, 1, (20, 2)) for c in (0, 4, 9)] + [[[40, 40]], [[0, 0]], [[0, 0]]])
    labels = np.array([0] * 20 + [1] * 20 + [2] * 20 + [3, 0, 1])  # one lone point, one point twice
    got = clusters.euclidean_silhouette(frame(spark, points, labels), ["id"], ["x", "y"], block=block)
    assert got.first()[0] == pytest.approx(brute_silhouette(points, labels), abs=1e-12)


def test_silhouette_of_one_cluster_and_of_no_rows(spark):
    one = frame(spark, [(0, 0), (1, 1)])
    assert clusters.euclidean_silhouette(one, ["id"], ["x", "y"]).first()[0] == 0
    assert clusters.silhouettes(one.limit(0).withColumn("k", F.lit(1)), ["id"], ["x", "y"],
                                ["k"]).count() == 0


def brute_lloyd(points, first, steps):
    centres = np.array(first, dtype=float)
    for _ in range(steps):
        at = ((points[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        for c in range(len(centres)):
            if (at == c).any():
                centres[c] = points[at == c].mean(0)
    return centres


def test_lloyd_steps(spark):
    rng = np.random.default_rng(5)
    points = rng.uniform(0, 10, (60, 2)).round(3)
    df = frame(spark, points).withColumn("at", F.array("x", "y"))
    firsts = lloyd.farthest_points(df, ["id"], "at", 2, 4, 5)
    assert [f[0] for f in firsts] == [list(points[i]) for i in (
        points[:, 0].argmax(), points[:, 0].argmin(), points[:, 1].argmax(), points[:, 1].argmin())]
    for centres in firsts:
        for n in range(1, 5):
            apart = ((points[:, None] - np.array(centres[:n])[None]) ** 2).sum(-1).min(1)
            assert centres[n] == list(points[apart.argmax()])
    trials = lloyd.trials_of(df, ["id"], "at", 2, [2, 5], starts=4, steps=6)
    for (k, s), centres in trials.items():
        np.testing.assert_allclose(centres, brute_lloyd(points, firsts[s][:k], 6), atol=1e-9)


def test_lloyd_finds_separated_groups(spark):
    points = [(x + i % 3 * 0.01, 0) for x in (0, 10, 20, 30) for i in range(6)]
    df = frame(spark, points).drop("cluster")
    out = lloyd.lloyd_clusters(df, ["id"], ["x", "y"], F.col("id") != 5, k_max=6, starts=2, steps=5)
    rows = sorted(out.collect())
    assert {r.selected_k for r in rows} == {4} and len(rows) == len(points)
    assert len({r.cluster for r in rows}) == 4
    assert all(len({r.cluster for r in rows[i:i + 6]}) == 1 for i in range(0, 24, 6))


def test_lloyd_of_equal_and_of_few_points(spark):
    same = frame(spark, [(1, 1)] * 5).drop("cluster")
    out = lloyd.lloyd_clusters(same, ["id"], ["x", "y"], F.lit(True), starts=1, steps=2)
    assert {(r.cluster, r.selected_k) for r in out.collect()} == {(0, 2)}
    few = lloyd.lloyd_clusters(same, ["id"], ["x", "y"], F.col("id") < 2).collect()
    assert {(r.cluster, r.selected_k, r.euclidean_silhouette) for r in few} == {(0, 1, None)}
    with pytest.raises(ValueError):
        lloyd.trials_of(same, ["id"], "at", 2, [2], starts=5)
