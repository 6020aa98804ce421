"""Deterministic k-means: stated starts and Lloyd steps as aggregations over the points.

A trial is a pair (k, start). All trials advance together, one scan and one map-side combined
aggregation a step; the driver sees the centres alone, whose number the parameters bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.operators.clusters import silhouettes
from haulmark.session import staged

# Largest k, starts of each k, Lloyd steps, digits within which costs and scores tie.
K_MAX, STARTS, STEPS, TIE = 8, 10, 20, 9
TRIALS = "trials array<struct<k int, start int, centres array<array<double>>>>"
Centres = list[list[float]]


def squared(p: Column, q: Column, size: int) -> Column:
    """Squared Euclidean distance of two arrays of ``size`` numbers."""
    return sum(((p[i] - q[i]) ** 2 for i in range(1, size)), (p[0] - q[0]) ** 2)


def farthest_points(points: DataFrame, keys: Sequence[str], point: str, size: int, starts: int,
                    count: int) -> list[Centres]:
    """Per start, ``count`` points far from each other: the first of k of them begin a trial of k.

    Start 2i begins at the point with the largest i-th measure, start 2i + 1 at that with the
    smallest; then follows the point farthest from all chosen ones. Ties go to the smaller keys.
    """
    p = F.col(point)

    def first(order: Column, name: str) -> Column:
        return F.min(F.struct(order.alias("order"), *keys, p.alias("at"))).alias(name)

    def chosen(orders: list[Column]) -> list[list[float]]:
        row = points.agg(*[first(o, f"s{s}") for s, o in enumerate(orders)]).first()
        return [list(r["at"]) for r in row]

    found = [[c] for c in chosen([p[s // 2] * (1 if s % 2 else -1) for s in range(starts)])]
    while len(found[0]) < count:
        nearest = [F.array_min(F.transform(
            F.lit(centres), lambda c: squared(p, c, size))) for centres in found]
        for centres, new in zip(found, chosen([-d for d in nearest])):
            centres.append(new)
    return found


def assigned(points: DataFrame, point: str, size: int,
             trials: dict[tuple[int, int], Centres]) -> DataFrame:
    """A row per point and trial: ``k``, ``start``, ``cluster`` and the squared ``distance``; the
    smaller cluster number wins a tie."""
    table = points.sparkSession.createDataFrame(
        [([(k, s, centres) for (k, s), centres in trials.items()],)], TRIALS)
    p = F.col(point)
    nearest = F.array_min(F.transform("_t.centres", lambda c, i: F.struct(
        squared(p, c, size).alias("distance"), i.alias("cluster"))))
    rows = points.withColumn("_ts", table.scalar()).withColumn("_t", F.explode("_ts"))
    return (rows.withColumn("_n", nearest)
            .withColumns({"k": F.col("_t.k"), "start": F.col("_t.start"),
                          "cluster": F.col("_n.cluster"), "distance": F.col("_n.distance")})
            .drop("_ts", "_t", "_n"))


def stepped(points: DataFrame, point: str, size: int,
            trials: dict[tuple[int, int], Centres]) -> dict[tuple[int, int], Centres]:
    """The centres after one Lloyd step; an empty cluster keeps its centre."""
    means = (assigned(points, point, size, trials).groupBy("k", "start", "cluster")
             .agg(F.array(*[F.avg(F.col(point)[i]) for i in range(size)]).alias("mean")).collect())
    out = {trial: list(centres) for trial, centres in trials.items()}
    for r in means:
        out[r.k, r.start][r.cluster] = list(r["mean"])
    return out


def trials_of(points: DataFrame, keys: Sequence[str], point: str, size: int, sizes: Sequence[int],
              starts: int = STARTS, steps: int = STEPS) -> dict[tuple[int, int], Centres]:
    """The centres of every (k, start) after ``steps`` Lloyd steps; converged trials rest."""
    if not 1 <= starts <= 2 * size:
        raise ValueError(f"between 1 and {2 * size} starts")
    firsts = farthest_points(points, keys, point, size, starts, max(sizes))
    done, moving = {}, {(k, s): firsts[s][:k] for k in sizes for s in range(starts)}
    for _ in range(steps):
        new = stepped(points, point, size, moving)
        done |= {t: c for t, c in new.items() if c == moving[t]}
        moving = {t: c for t, c in new.items() if c != moving[t]}
        if not moving:
            break
    return done | moving


def fits(scaled: DataFrame, keys: Sequence[str], measures: Sequence[str], eligible: Column,
         k_max: int = K_MAX, starts: int = STARTS, steps: int = STEPS
         ) -> tuple[DataFrame, dict[tuple[int, int], Centres]]:
    """``(k, start, cost, points, silhouette_score, euclidean_silhouette)``, the cheapest start of each k,
    and the centres of all trials.

    ``keys`` name a point, ``measures`` are its coordinates. Costs within ``TIE`` digits count as equal
    and the smaller start wins. With fewer than three eligible points there is no fit and no row.
    """
    size = len(measures)
    points = staged(scaled.where(eligible).select(*keys, *measures, F.array(*measures).alias("_at")),
                    "points")
    count = points.count()
    sizes = range(2, min(k_max + 1, count))
    if not sizes:
        return scaled.sparkSession.createDataFrame([], (
            "k int, start int, cost double, points bigint, silhouette_score double, "
            "euclidean_silhouette double")), {}
    trials = trials_of(points, keys, "_at", size, sizes, starts, steps)
    costs = (assigned(points, "_at", size, trials).groupBy("k", "start")
             .agg(F.sum("distance").alias("cost")).collect())
    best = {}
    for r in sorted(costs, key=lambda r: (r.k, round(r.cost, TIE), r.start)):
        best.setdefault(r.k, (r.start, r.cost))
    kept = {(k, s): trials[k, s] for k, (s, _) in best.items()}
    grouped = staged(assigned(points, "_at", size, kept).drop("_at"), "grouped")
    scores = silhouettes(grouped, keys, measures, ["k"])
    cheapest = scaled.sparkSession.createDataFrame(
        [(k, s, float(c)) for k, (s, c) in best.items()], "k int, start int, cost double")
    return cheapest.join(scores, "k"), trials


def lloyd_clusters(scaled: DataFrame, keys: Sequence[str], measures: Sequence[str], eligible: Column,
                   k_max: int = K_MAX, starts: int = STARTS, steps: int = STEPS) -> DataFrame:
    """``scaled`` with ``cluster``, ``selected_k``, ``silhouette_score`` and ``euclidean_silhouette``.

    The k with the best Euclidean silhouette over the eligible points is applied to all points; ties
    within ``TIE`` digits go to the smaller k. Fewer than three eligible points form one cluster.
    """
    report, trials = fits(scaled, keys, measures, eligible, k_max, starts, steps)
    rows = report.collect()
    if not rows:
        return scaled.withColumns({
            "cluster": F.lit(0), "selected_k": F.lit(1),
            "silhouette_score": F.lit(None).cast("double"),
            "euclidean_silhouette": F.lit(None).cast("double")})
    top = min(rows, key=lambda r: (-round(r.euclidean_silhouette, TIE), r.k))
    held = scaled.withColumn("_at", F.array(*measures))
    out = assigned(held, "_at", len(measures), {(top.k, top.start): trials[top.k, top.start]})
    return out.drop("_at", "start", "distance").withColumnRenamed("k", "selected_k").withColumns({
        "silhouette_score": F.lit(top.silhouette_score),
        "euclidean_silhouette": F.lit(top.euclidean_silhouette)})
