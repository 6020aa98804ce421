"""Descriptive statistics: slopes, distance bins, histograms, quartiles, collinearity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions.quantiles import histogram_quantiles

# Polynomial of the normal tail (Abramowitz and Stegun 26.2.17).
NORMAL_TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
NORMAL_TAIL_P = 0.2316419


def normal_two_sided(t: Column) -> Column:
    """Two-sided tail probability of a standard normal, accurate to about 1e-7."""
    z = F.abs(t)
    k = F.lit(1.0) / (F.lit(1.0) + z * NORMAL_TAIL_P)
    poly = F.lit(0.0)
    for c in reversed(NORMAL_TAIL):
        poly = (poly + c) * k
    return F.exp(-z * z / 2) / 2.5066282746310002 * poly * 2


def group_slopes(df: DataFrame, key: str, y: str = "lead_time_days", x: str = "distance_km"
                 ) -> DataFrame:
    """Least-squares slope per group with count, R2, t statistic and a large-sample p-value."""
    fit = df.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"),
                              F.regr_count(y, x).alias("n"))
    freedom = F.when(F.col("n") > 2, F.col("n") - 2)
    t = F.signum("slope") * F.sqrt(F.col("r2") * freedom / F.nullif(1 - F.col("r2"), F.lit(0.0)))
    return fit.select(key, "slope", "r2", "n", t.alias("t_stat"),
                      normal_two_sided(t).alias("p_value"))


def residual_bins(order_lines: DataFrame, bins: int = 10) -> DataFrame:
    """Mean residual lead per distance decile, the residual being lead minus its mode's mean.

    A distance is a property of a (factory, destination) pair, so it takes a bounded number of
    values. Lines are reduced to (distance, mode) sums once; edges, mode means and bins all come
    from that table. A bin is ``(lo, hi]``, the first one closed at both ends.
    """
    cells = (order_lines.where(F.col("distance_km").isNotNull()
                               & F.col("lead_time_days").isNotNull())
             .groupBy(F.round("distance_km", 6).alias("distance"), "ship_mode")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("lead_time_days").alias("lead_sum")))
    probs = [i / bins for i in range(bins + 1)]
    means = cells.groupBy("ship_mode").agg(
        (F.sum("lead_sum") / F.sum("n")).alias("mode_mean"))
    edges = cells.agg(F.percentile("distance", F.array(*[F.lit(p) for p in probs]), F.col("n"))
                      .alias("e")).scalar()
    placed = cells.join(means, "ship_mode").withColumn("e", edges)
    at = F.lit(bins - 1)
    for i in reversed(range(1, bins)):
        at = F.when(F.col("distance") <= F.col("e")[i], i - 1).otherwise(at)
    binned = placed.withColumn("bin", at)
    return (binned.groupBy("bin")
            .agg(F.min(F.col("e")[F.col("bin")]).alias("lo"),
                 F.min(F.col("e")[F.col("bin") + 1]).alias("hi"),
                 F.sum("n").alias("n"),
                 (F.sum(F.col("lead_sum") - F.col("n") * F.col("mode_mean")) / F.sum("n"))
                 .alias("mean_residual_days")))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts over equal-width bins between the least and the greatest value, empty bins included."""
    span = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    value = df.where(F.col(column).isNotNull()).select(
        F.col(column).cast("double").alias("v"), span["lo"].cast("double").alias("lo"),
        span["hi"].cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bucket = F.least(F.lit(bins - 1), F.when(width > 0, F.floor((F.col("v") - F.col("lo")) / width))
                     .otherwise(0)).cast("int")
    counts = value.groupBy(bucket.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    # At most one row per bin is left: their map fills the gaps.
    filled = counts.groupBy("lo", "hi").agg(F.map_from_entries(F.collect_list(
        F.struct("bin", "n"))).alias("m")).select("lo", "hi", "m", F.explode(
            F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return filled.select(
        "bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("from_value"),
        F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).cast("bigint").alias("n"))


def box_quartiles(df: DataFrame, key: str, value: str = "lead_time_days") -> DataFrame:
    """Minimum, quartiles and maximum per group of a value from a bounded domain."""
    q = histogram_quantiles(df, [key], value, [0, 0.25, 0.5, 0.75, 1], "q")
    names = ["least", "q1", "median", "q3", "greatest"]
    return q.select(key, *[F.col("q")[i].cast("double").alias(n) for i, n in enumerate(names)])


def measures_long(profile: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Wide measures as (measure, value) rows."""
    typed = profile.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures])
    return typed.unpivot(list(keys), list(measures), "measure", "value")


def collinearity(moves: DataFrame, key: str = "product_name", x: str = "lead_gain_days",
                 y: str = "profit_impact") -> DataFrame:
    """Correlation of two measures per group and the number of distinct ratios between them."""
    ratio = F.round(F.col(y) / F.nullif(F.col(x), F.lit(0.0)), 6)
    ratios = moves.select(key, x, y, ratio.alias("ratio"))
    return ratios.groupBy(key).agg(
        F.corr(x, y).alias("correlation"), F.count_distinct("ratio").alias("distinct_ratios"),
        (F.count_distinct("ratio") <= 1).alias("collinear"))
