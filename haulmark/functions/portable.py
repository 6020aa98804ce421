"""Deterministic randomness that depends on row keys only, never on partitioning.

``rand(seed)`` changes with the partition layout. These expressions use integer arithmetic on keys
instead, so a result is the same on one core and on a thousand executors, and can be reproduced by
any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Modulus, multipliers and seed of the generator.
MODULUS = 2147483647
MULTIPLIER = 48271
SECOND_MULTIPLIER = 69621
SEED = 42


def uniform(a: Column, b: Column | int = 0) -> Column:
    """A uniform number in [0, 1) from two integer keys."""
    b = F.lit(b) if isinstance(b, int) else b
    m = F.lit(MODULUS).cast("bigint")
    x = (F.pmod(a.cast("bigint"), m) * MULTIPLIER + F.pmod(b.cast("bigint"), m) * SECOND_MULTIPLIER
         + SEED) % m
    x = (x * MULTIPLIER) % m
    x = (x * MULTIPLIER) % m
    return x.cast("double") / F.lit(float(MODULUS))


def text_number(text: Column) -> Column:
    """48 bits of a text's MD5 as a number, a key for the draws of rows whose ids are text."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 12), 16, 10).cast("bigint")


def hashed_uniform(*keys: Column) -> Column:
    """A uniform number in (0, 1) from the MD5 of the keys.

    :func:`uniform` is linear in its keys: along one of them it covers the range evenly, which suits
    single draws but not resampling, where draws have to be independent.
    """
    text = F.concat_ws(":", *[k.cast("string") for k in keys])
    return (text_number(text) + 0.5) / float(1 << 48)


def is_holdout(a: Column, b: Column | int = 0, share: float = 0.2) -> Column:
    """True for a seeded ``share`` of the rows."""
    return uniform(a, b) >= F.lit(1.0 - share)


def fold(a: Column, b: Column | int = 0, folds: int = 5) -> Column:
    """A cross-validation fold number in [0, folds)."""
    return F.floor(uniform(a, b) * folds).cast("int")


def with_hash_index(df: DataFrame, key: Column, index: str, tie: list[Column] | None = None,
                    by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Number the rows 0..n-1 in the order of ``md5(key)``, without a single-partition sort.

    The first ``digits`` hex digits of the hash cut the order into even ranges, 65,536 by default:
    enough for a million rows each at 6e10 rows. Rows are numbered inside their range by a partitioned
    window; the range's offset is the running total of the range counts, computed on that bounded
    table. A key that repeats stays within one range, so keys should be unique or nearly so. ``by`` numbers each group of the given columns on its own.
    """
    by = by or []
    digest = F.md5(key.cast("string"))
    marked = df.withColumns({"_h": F.unhex(digest), "_r": F.substring(digest, 1, digits)})
    counts = marked.groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_r", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*by, "_r").orderBy("_h", *(tie or []))
    return (marked.withColumn("_k", F.row_number().over(inside) - 1)
            .join(offsets, by + ["_r"])
            .withColumn(index, (F.col("_o") + F.col("_k")).cast("bigint"))
            .drop("_h", "_r", "_k", "_o"))
