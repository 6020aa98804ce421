"""Exact quantiles that never bring a whole column to one task.

Spark's exact ``percentile`` keeps a value -> count map of the whole group in one task. That is fine
for values from a bounded domain (days, dates, distances between known places), where
:func:`histogram_quantiles` is used, but not for money or measurements. :func:`exact_quantiles`
finds the same interpolated values in three scans of the column with bounded state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A sketch of this accuracy misses a rank by at most n / ACCURACY.
ACCURACY = 10000
GRID = 1000


def histogram_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                        name: str = "quantiles") -> DataFrame:
    """Interpolated quantiles per group for values from a bounded domain.

    Rows are first counted per (group, value) with map-side combination, so a hot group costs one
    row per distinct value.
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
              .agg(F.count(F.lit(1)).alias("_n")))
    return counts.groupBy(*keys).agg(
        F.percentile(F.col(value), F.array(*[F.lit(float(p)) for p in probs]), F.col("_n"))
        .alias(name))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row ``(column, prob, n, quantile)`` per column and probability, linearly interpolated.

    1. A sketch brackets every quantile between two of its ranks, a few parts in a thousand and at
       least two ranks away.
    2. A second sketch of the bracketed rows alone narrows the bracket by another factor of about
       a thousand, and the rows below the first bracket are counted.
    3. The rows left are counted per value and the two neighbours of the wanted rank are read off
       their running count.

    The exact counts tell whether a bracket held. If one did not, all are widened and counted again, up
    to the whole range, which always holds. The result, one row per target, is read to decide that.
    """
    spark = df.sparkSession
    for slack in (2.0 / ACCURACY, 100.0 / ACCURACY, 1.0):
        rows = _bracketed_quantiles(df, columns, probs, slack).collect()
        if all(r["held"] for r in rows):
            break
    return spark.createDataFrame(
        [(r["column"], r["prob"], r["n"], r["quantile"]) for r in rows],
        "column string, prob double, n bigint, quantile double")


def _bracketed_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                         slack: float) -> DataFrame:
    """The quantiles with ``held``: whether the bracket of this width has the wanted ranks."""
    targets = [(c, p, f"{i}_{j}") for i, c in enumerate(columns) for j, p in enumerate(probs)]
    values = df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys(columns)])
    grid = [g / GRID for g in range(GRID + 1)]

    def around(c: str, p: float) -> Column:
        """Two values around the quantile, at steps of the column's sketch."""
        ranks = F.percentile_approx(c, grid, ACCURACY)
        pad = F.lit(slack) + F.lit(3.0) / F.greatest(F.count(c), F.lit(1))
        low = F.floor((F.lit(p) - pad) * GRID).cast("int") - 1
        high = F.ceil((F.lit(p) + pad) * GRID).cast("int") + 1
        return F.array(F.when(low <= 0, F.min(c)).otherwise(F.get(ranks, low)),
                       F.when(high >= GRID, F.max(c)).otherwise(F.get(ranks, high)))

    first = values.agg(F.struct(
        *[F.count(c).alias(f"n_{c}") for c in dict.fromkeys(columns)],
        *[around(c, p).alias(f"b_{t}") for c, p, t in targets]).alias("s")).scalar()

    # The subquery enters the plan as one column; naming it in every expression would copy it.
    outer = F.col("_first")
    bracketed = values.withColumn("_first", first)

    def in_first(c: str, t: str) -> Column:
        return (F.col(c) >= outer[f"b_{t}"][0]) & (F.col(c) <= outer[f"b_{t}"][1])

    narrowed = bracketed.agg(
        F.max(outer).alias("_first"),
        *[F.count_if(F.col(c) < outer[f"b_{t}"][0]).alias(f"below_{t}") for c, p, t in targets],
        *[F.count_if(in_first(c, t)).alias(f"m_{t}") for c, p, t in targets],
        *[F.percentile_approx(F.when(in_first(c, t), F.col(c)), grid, ACCURACY).alias(f"g_{t}")
          for c, p, t in targets])

    def bracket(c: str, p: float, t: str) -> Column:
        """The narrowed bracket: two ranks and two grid steps or more around the wanted rank."""
        wanted = F.lit(p) * (outer[f"n_{c}"] - 1) - F.col(f"below_{t}")
        step = F.greatest(F.col(f"m_{t}"), F.lit(1)) / GRID
        more = max(2.0, slack * GRID)
        low = (F.floor((wanted - 2) / step) - more).cast("int")
        high = (F.ceil((wanted + 2) / step) + more).cast("int")
        return F.struct(
            F.lit(t).alias("t"), F.lit(c).alias("column"), F.lit(float(p)).alias("prob"),
            outer[f"n_{c}"].alias("n"), F.col(f"below_{t}").alias("below"),
            F.when(low <= 0, outer[f"b_{t}"][0]).otherwise(F.get(F.col(f"g_{t}"), low)).alias("lo"),
            F.when(high >= GRID, outer[f"b_{t}"][1])
            .otherwise(F.get(F.col(f"g_{t}"), high)).alias("hi"),
            outer[f"b_{t}"][0].alias("outer"))

    brackets = narrowed.select(F.array(*[bracket(*t) for t in targets]).alias("b")).scalar()
    # Each row yields only the few brackets it falls into; all others drop out inside the scan.
    def tested(i: int, c: str, p: float, t: str) -> Column:
        b = F.col("_brackets")[i]
        return F.when((F.col(c) >= b["outer"]) & (F.col(c) <= b["hi"]), F.struct(
            b["t"].alias("t"), b["column"].alias("column"), b["prob"].alias("prob"),
            b["n"].alias("n"), b["below"].alias("below"),
            F.when(F.col(c) >= b["lo"], F.col(c)).alias("v")))

    hits = (values.withColumn("_brackets", brackets)
            .select(F.explode(F.array_compact(F.array(
                *[tested(i, *target) for i, target in enumerate(targets)]))).alias("h"))
            .select("h.*"))
    counted = (hits.groupBy("t", "column", "prob", "n", "below", "v")
               .agg(F.count(F.lit(1)).alias("cnt")))
    # The null value stands for bracketed rows below the narrowed bracket and sorts first.
    running = Window.partitionBy("t").orderBy(F.col("v").asc_nulls_first())
    ranked = counted.withColumn(
        "upto", F.col("below") + F.sum("cnt").over(
            running.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.col("prob") * (F.col("n") - 1)
    low = F.min(F.when(F.col("upto") > F.floor(rank), F.struct("upto", "v", "cnt")))
    high = F.min(F.when(F.col("upto") > F.ceil(rank), F.struct("upto", "v", "cnt")))
    found = ranked.groupBy("t", "column", "prob", "n").agg(low.alias("a"), high.alias("b"))
    fraction = F.col("prob") * (F.col("n") - 1) - F.floor(F.col("prob") * (F.col("n") - 1))
    # The neighbour must be a real value, and ranks before it must be covered by the count.
    held = (F.col("a.v").isNotNull() & F.col("b.v").isNotNull()
            & (F.col("a.upto") - F.col("a.cnt") <= F.floor(F.col("prob") * (F.col("n") - 1))))
    return found.select(
        "column", "prob", F.col("n").cast("bigint").alias("n"),
        (F.col("a.v") + (F.col("b.v") - F.col("a.v")) * fraction).alias("quantile"),
        F.coalesce(held | (F.col("n") == 0), F.lit(False)).alias("held"))
