"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share a budget by weight; no source gives more than ``max_epochs`` times its size, and the
excess is reshared by weight until none is above. A source's target is filled by whole epochs, then by
a weighted sample without replacement: each document draws an exponential key, divided by its quality
weight, and documents are taken in key order until the prefix sum of their sizes meets what is left.
The document at the boundary gives the words that are missing.

Draws are hashes of (seed, id), so reruns and any partitioning agree. A source may hold a third of
all rows, so its order is cut into key ranges: the prefix sum of a range's total, over the small table of
(source, range), plus the prefix sum inside the range. Ranges are steps of the key's logarithm, which
cut an exponential distribution of any scale into slices of at most ``1 / (2.7 * steps)`` of it.

Defined results: a null source is a source of its own, ordered last; a null id draws as the text
``null``. Documents of size 0 take 0. Rows that repeat an id share a key and are ordered by size, then
by weight. A weight that is null or not positive counts as the smallest weight. No documents: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOURCE_WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2
SEED = 7
STEPS_PER_OCTAVE = 64
LEAST_WEIGHT = 1e-3


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = SOURCE_WEIGHTS,
                   share: float = BUDGET_SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Water filling in closed form: with sources in the order of cap per weight, the level at which a
    source would be the first uncapped one decides which are capped. The windows run over the table
    of sources, which is small beside the documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                         (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("w", cycle).withColumn("cap", F.lit(float(max_epochs))
                                                     * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.lit(float(share)) * F.sum("source_size").over(whole)
              - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # Over this order the level rises while sources are capped and falls after, so its largest value
    # is the one that holds.
    return (ranked.withColumn("level", level)
            .withColumn("level", F.max("level").over(whole))
            .select("source", "source_size",
                    F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target")))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the MD5 of seed and key."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def mix(items: DataFrame, targets: DataFrame, seed: int = SEED,
        steps: int = STEPS_PER_OCTAVE) -> DataFrame:
    """``items`` (doc_id, source, size, weight) with source_size, target and ``taken``.

    ``items`` is read three times, so pass a narrow stored table.
    """
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(LEAST_WEIGHT))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    keyed = items.withColumn("weight", weight).withColumn(
        "key", -F.log(uniform(name, seed)) / F.col("weight"))
    keyed = keyed.withColumn("range", F.floor(F.log2("key") * steps))
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("n"))
    earlier = (Window.partitionBy("source").orderBy("range")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col("source").alias("s"), F.col("range").alias("r"),
                          F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = (Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "weight")
              .rowsBetween(Window.unboundedPreceding, 0))
    placed = keyed.withColumn("until", F.sum("size").over(inside))
    t = targets.withColumnRenamed("source", "s")
    joined = (placed.join(offsets, F.col("source").eqNullSafe(F.col("s"))
                          & (F.col("range") == F.col("r"))).drop("s", "r")
              .join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    goal = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    left = goal - epochs * F.col("source_size")
    start = F.col("offset") + F.col("until") - F.col("size")
    part = F.least(F.greatest(left - start, F.lit(0)), F.col("size"))
    return (joined.withColumn("taken", (epochs * F.col("size") + part).cast("bigint"))
            .drop("range", "until", "offset"))


def copies(taken: Column, size: Column) -> Column:
    """How often a document appears in the mix; a document taken in part appears whole."""
    return F.when(size > 0, F.ceil(taken / size)).otherwise(0).cast("int")
