"""k-means clusters of lanes and their labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.functions.text import finite
from haulmark.operators.lanes import LANE_KEYS
from haulmark.operators.models import in_parallel, union
from haulmark.params import LANE_MIN_ORDERS
from haulmark.session import staged

# Clustered measures, largest k, seed.
CLUSTER_FEATURES = ("order_count", "mean_lead", "p90_lead", "lead_std", "mean_distance",
                    "mean_units")
K_MAX = 8
SEED = 42
BLOCK = 512  # points of one cluster that a row of the Euclidean silhouette holds, on average
SINGLE, UNCLUSTERED = "Single route cluster", "Unclustered lane"


def cluster_lanes(lanes: DataFrame, min_orders: int = LANE_MIN_ORDERS, k_max: int = K_MAX,
                  starts: int = 10) -> DataFrame:
    """Add ``cluster``, ``selected_k`` and two silhouettes, squared and Euclidean, to every lane.

    Lanes with enough orders are standardised and clustered for each k; each k keeps the cheapest of
    several seeded starts, and the k with the best Euclidean silhouette is applied to all lanes. The
    scaled lanes are stored for the repeated fits.
    """
    numbers = lanes.withColumns({f"_{c}": F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0))
                                 for c in CLUSTER_FEATURES})
    packed = VectorAssembler(inputCols=[f"_{c}" for c in CLUSTER_FEATURES],
                             outputCol="_raw").transform(numbers)
    eligible = packed.where(F.col("order_count") >= min_orders)
    count = eligible.count()
    if count < 3:
        return lanes.withColumns({"cluster": F.lit(0), "selected_k": F.lit(1),
                                  "silhouette_score": F.lit(None).cast("double"),
                                  "euclidean_silhouette": F.lit(None).cast("double")})
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True,
                            withStd=True).fit(eligible)
    ready = staged(scaler.transform(packed), "scaled-lanes")
    points = ready.where(F.col("order_count") >= min_orders)

    def best_of(k: int):
        fits = [KMeans(k=k, seed=SEED + s, featuresCol="features", predictionCol="cluster").fit(points)
                for s in range(starts)]
        return min(fits, key=lambda m: m.summary.trainingCost)

    sizes = list(range(2, min(k_max + 1, count)))
    models = in_parallel([lambda k=k: best_of(k) for k in sizes])
    z = vector_to_array("features")
    names = [f"z_{c}" for c in CLUSTER_FEATURES]
    grouped = staged(union([
        m.transform(points).select(F.lit(k).alias("k"), *LANE_KEYS, "cluster",
                                   *[z[i].alias(n) for i, n in enumerate(names)])
        for k, m in zip(sizes, models)]), "grouped-lanes")
    scores = {r.k: r for r in silhouettes(grouped, LANE_KEYS, names, ["k"]).collect()}
    k = max(sizes, key=lambda k: scores[k].euclidean_silhouette)
    out = models[sizes.index(k)].transform(ready).select(*lanes.columns, "cluster")
    return out.withColumns({"selected_k": F.lit(k),
                            "silhouette_score": F.lit(scores[k].silhouette_score),
                            "euclidean_silhouette": F.lit(scores[k].euclidean_silhouette)})


def cluster_summary(clustered: DataFrame, min_orders: int = LANE_MIN_ORDERS) -> DataFrame:
    """Per cluster, over its eligible lanes: their number, mean order count and mean lead."""
    return clustered.where(F.col("order_count") >= min_orders).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("lanes"), F.avg("order_count").alias("mean_orders"),
        F.avg("mean_lead").alias("mean_days"))


def label_clusters(clustered: DataFrame, min_orders: int = LANE_MIN_ORDERS) -> DataFrame:
    """Label clusters slow or fast and high or low volume against the median cluster.

    The medians run over one row per cluster.
    """
    every = Window.partitionBy()

    def above(measure: str) -> Column:
        return F.col(measure) >= F.median(measure).over(every)

    speed = F.when(above("mean_days"), "Slow").otherwise("Fast")
    volume = F.when(above("mean_orders"), "high volume").otherwise("low volume")
    named = cluster_summary(clustered, min_orders).select(
        "cluster", F.concat_ws(" / ", speed, volume).alias("_label"))
    label = (F.when(F.col("selected_k") == 1, SINGLE)
             .otherwise(F.coalesce("_label", F.lit(UNCLUSTERED))))
    return (clustered.join(named, "cluster", "left").withColumn("cluster_label", label)
            .drop("_label"))


def standardised(lanes: DataFrame, min_orders: int = LANE_MIN_ORDERS) -> DataFrame:
    """``lanes`` with ``z_<measure>``: measures in deviations from the mean of the eligible lanes."""
    numbers = {c: F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) for c in CLUSTER_FEATURES}
    eligible = F.col("order_count") >= min_orders
    spread = lanes.agg(F.struct(*[F.struct(
        F.avg(F.when(eligible, v)).alias("mean"), F.stddev_samp(F.when(eligible, v)).alias("std"))
        .alias(c) for c, v in numbers.items()]).alias("s")).scalar()
    held = lanes.withColumn("_s", spread)
    return held.withColumns({
        f"z_{c}": F.coalesce((v - F.col(f"_s.{c}.mean")) / F.nullif(F.col(f"_s.{c}.std"), F.lit(0.0)),
                             F.lit(0.0)) for c, v in numbers.items()}).drop("_s")


def assign_clusters(scaled: DataFrame, centres: DataFrame) -> DataFrame:
    """``scaled`` with ``cluster``, the number of the nearest centre (cluster, z_<measure>...), and its
    squared ``distance``; ties go to the smaller number. The few centres are read as one array."""
    names = [f"z_{c}" for c in CLUSTER_FEATURES]
    every = centres.agg(F.collect_list(F.struct("cluster", *names)).alias("c")).scalar()

    def apart(centre: Column) -> Column:
        return sum(((F.col(n) - centre[n]) ** 2 for n in names[1:]), (F.col(names[0])
                                                                      - centre[names[0]]) ** 2)

    nearest = F.array_min(F.transform("_c", lambda c: F.struct(
        apart(c).alias("distance"), c["cluster"].alias("cluster"))))
    return (scaled.withColumn("_c", every).withColumn("_n", nearest)
            .withColumns({"cluster": F.col("_n.cluster"), "distance": F.col("_n.distance")})
            .drop("_c", "_n"))


def silhouette(clustered: DataFrame, measures: Sequence[str] | None = None,
               by: Sequence[str] = ()) -> DataFrame:
    """One row per ``by``: the mean silhouette with squared Euclidean distance, and the points.

    The mean squared distance of a point to a cluster follows from the cluster's size, sums and sum
    of squares, so one row per cluster meets each point instead of all other points.
    """
    names = list(measures or [f"z_{c}" for c in CLUSTER_FEATURES])
    norm = sum((F.col(n) ** 2 for n in names[1:]), F.col(names[0]) ** 2)
    sums = clustered.groupBy(*by, "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(norm).alias("q"),
        F.array(*[F.sum(n) for n in names]).alias("s"))
    every = F.collect_list(F.struct("cluster", "n", "q", "s"))
    point = F.array(*names)

    def total(c: Column) -> Column:
        dot = F.aggregate(F.zip_with(point, c["s"], lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
        return c["n"] * F.col("_norm") - dot * 2 + c["q"]

    own = F.col("cluster")
    inside = F.get(F.filter("_c", lambda c: c["cluster"] == own), F.lit(0))
    a = total(inside) / F.nullif(inside["n"] - 1, F.lit(0))
    b = F.array_min(F.transform(F.filter("_c", lambda c: c["cluster"] != own),
                                lambda c: total(c) / c["n"]))
    held = (clustered.join(sums.groupBy(*by).agg(every.alias("_c")), list(by)) if by else
            clustered.withColumn("_c", sums.agg(every.alias("c")).scalar()))
    return held.withColumn("_norm", norm).groupBy(*by).agg(
        F.avg(width_score(a, b)).alias("silhouette_score"), F.count(F.lit(1)).alias("points"))


def width_score(a: Column, b: Column) -> Column:
    """Silhouette from the mean distances to the own and to the next cluster; 0 for a lone point."""
    return F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0))


def euclidean_silhouette(clustered: DataFrame, keys: Sequence[str], measures: Sequence[str],
                         by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """One row per ``by``: the mean silhouette with Euclidean distance, exact.

    Every distance counts, so the work is quadratic in the points, which are a table of aggregates.
    Points are dealt by a hash of ``keys``, which name a point within ``by``, into blocks of about
    ``block``; each point meets the clusters of one block at a time, and sums of distances combine
    before they are shuffled. No row or task grows with the table.
    """
    names = list(measures)
    most = clustered.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // block))
    place = F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int")
    groups = clustered.groupBy(*by, place.alias("_block"), F.col("cluster").alias("_other")).agg(
        F.collect_list(F.array(*names)).alias("_others"))
    point = F.col("_at")

    def apart(q: Column) -> Column:
        return F.sqrt(sum(((point[i] - q[i]) ** 2 for i in range(1, len(names))),
                          (point[0] - q[0]) ** 2))

    met = clustered.select(*by, *keys, "cluster", F.array(*names).alias("_at"), F.explode(
        F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")).join(groups, [*by, "_block"])
    pairs = met.select(*by, *keys, "cluster", "_other", F.size("_others").alias("_n"), F.aggregate(
        "_others", F.lit(0.0), lambda t, q: t + apart(q)).alias("_sum"))
    per = pairs.groupBy(*by, *keys, "cluster", "_other").agg(F.sum("_n").alias("_n"),
                                                             F.sum("_sum").alias("_sum"))
    same = F.col("cluster") == F.col("_other")
    near = per.groupBy(*by, *keys, "cluster").agg(
        F.max(F.when(same, F.col("_sum") / F.nullif(F.col("_n") - 1, F.lit(0)))).alias("_a"),
        F.min(F.when(~same, F.col("_sum") / F.col("_n"))).alias("_b"))
    return near.groupBy(*by).agg(
        F.avg(width_score(F.col("_a"), F.col("_b"))).alias("euclidean_silhouette"))


def silhouettes(clustered: DataFrame, keys: Sequence[str], measures: Sequence[str], by: Sequence[str]
                ) -> DataFrame:
    """Per ``by``: points, ``silhouette_score`` (squared distance) and ``euclidean_silhouette``."""
    return silhouette(clustered, measures, by).join(
        euclidean_silhouette(clustered, keys, measures, by), list(by))
