"""Audit counts, pinned assertions, outlier fences and membership checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.functions.quantiles import exact_quantiles
from haulmark.functions.text import lead_days, normalize_product_name
from haulmark.operators.clean import (FINANCE, clean_orders, collapse_copies, finish_orders, is_blank,
                                      is_header, type_orders)
from haulmark.operators.derive import resolve_factory
from haulmark.params import IQR_FACTOR
from haulmark.sources.orders import CORRUPT, SOURCE_COLUMNS, missing_columns

LONG_LEAD_DAYS = 365  # fixed value: threshold of the long-lead share
SYNTHETIC_PRODUCT = "^Product_"  # fixed value: pattern of a made-up product name
# What the audit and the fences read of typed rows.
TYPED = ("_header", "_blank", "copies", "product_name", "division", "ship_mode", "region", "state",
         "order_date", "ship_date", "bad_order_date", "bad_ship_date", "bad_finance", "cost_missing", "valid",
         *FINANCE)


def lead_summary(order_lines: DataFrame) -> DataFrame:
    """Lead-time range, mean, negative count and share of a year or more, on untrimmed rows."""
    lead = F.col("lead_time_days")
    return order_lines.agg(
        F.min(lead).alias("lead_min"), F.avg(lead).alias("lead_mean"), F.max(lead).alias("lead_max"),
        F.count_if(lead < 0).alias("lead_negative"),
        (F.count_if(lead >= LONG_LEAD_DAYS) * 100.0 / F.nullif(F.count(lead), F.lit(0)))
        .alias("long_lead_pct"))


def typed_rows(raw: DataFrame) -> DataFrame:
    """All rows without their copies, typed, with the flags ``_header`` and ``_blank``: what the audit counts
    and, of neither flag, what cleaning finishes.

    The raw rows are shuffled once, to collapse copies. Headers and blank rows are flagged before
    that and collapse to one row each.
    """
    raw = raw.drop(CORRUPT)
    flagged = raw.withColumns({"_header": is_header(), "_blank": is_blank(list(raw.columns))})
    return type_orders(collapse_copies(flagged))


def finished_rows(rows: DataFrame) -> DataFrame:
    """The cleaned order lines among :func:`typed_rows`."""
    return finish_orders(rows.where(~F.col("_header") & ~F.col("_blank")).drop("_header", "_blank"))


def audit_summary(raw: DataFrame, ship_modes: DataFrame, regions: DataFrame, places: DataFrame,
                  product_factory: DataFrame, division_factory: DataFrame) -> DataFrame:
    """One row with every cleaning count."""
    return summary_of(typed_rows(raw), ship_modes, regions, places, product_factory, division_factory)


def summary_of(rows: DataFrame, ship_modes: DataFrame, regions: DataFrame, places: DataFrame,
               product_factory: DataFrame, division_factory: DataFrame) -> DataFrame:
    """The audit of :func:`typed_rows`.

    Rows are counted per combination of categories, then per product, then in total, which also yields
    the number of products in the same pass.
    """
    data = ~F.col("_header") & ~F.col("_blank")
    valid = data & F.col("valid")
    lead = F.when(valid, lead_days(F.col("order_date"), F.col("ship_date")))

    def n(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0))

    # Sums per combination of categories come first, so the lookups meet a small table and a
    # frequent category is no hot join key.
    keys = ["product_name", "division", "ship_mode", "region", "state"]
    cells = (rows.withColumn("product_name", normalize_product_name(F.col("product_name")))
             .groupBy(*keys).agg(
        F.sum("copies").alias("input_rows"),
        F.sum(F.when(F.col("_header"), F.col("copies")).otherwise(0)).alias("stray_header_rows"),
        F.sum(F.when(F.col("_blank"), F.col("copies")).otherwise(0)).alias("blank_rows"),
        F.sum(F.when(data, F.col("copies") - 1).otherwise(0)).alias("duplicate_rows"),
        n(data).alias("rows_after_dedup"),
        n(data & F.col("bad_order_date")).alias("unparseable_order_dates"),
        n(data & F.col("bad_ship_date")).alias("unparseable_ship_dates"),
        n(data & F.col("bad_finance")).alias("unparseable_financial_rows"),
        n(valid).alias("rows_after_valid"),
        n(data & ~F.col("valid")).alias("dropped_parse_errors"),
        n(valid & F.col("cost_missing")).alias("cost_imputed"),
        F.min(lead).alias("lead_min"), F.max(lead).alias("lead_max"),
        F.sum(lead.cast("bigint")).alias("lead_sum"), n(lead < 0).alias("lead_negative"),
        n(lead >= LONG_LEAD_DAYS).alias("lead_long")))
    known = (resolve_factory(cells, product_factory, division_factory)
             .join(ship_modes.select("ship_mode", F.lit(True).alias("_mode")), "ship_mode", "left")
             .join(regions.select("region", F.lit(True).alias("_region")), "region", "left")
             .join(places.select("state", F.lit(True).alias("_place")), "state", "left"))

    def valid_where(condition: Column) -> Column:
        return F.when(condition, F.col("rows_after_valid")).otherwise(0)

    known = known.withColumns({
        "unmapped_ship_modes": valid_where(F.col("_mode").isNull()),
        "unmapped_regions": valid_where(F.col("_region").isNull()),
        "unresolved_centroids": valid_where(F.col("_place").isNull()),
        "unmapped_products": valid_where(F.col("factory_provenance") == "unmapped"),
        "fallback_products": valid_where(F.col("factory_provenance") == "division-fallback")})
    counts = ["input_rows", "stray_header_rows", "blank_rows", "duplicate_rows", "rows_after_dedup",
              "unparseable_order_dates", "unparseable_ship_dates", "unparseable_financial_rows",
              "rows_after_valid", "dropped_parse_errors", "cost_imputed", "unmapped_ship_modes",
              "unmapped_regions", "unmapped_products", "fallback_products", "unresolved_centroids",
              "lead_negative"]
    parts = known.groupBy("product_name").agg(
        *[F.sum(c).alias(c) for c in (*counts, "lead_sum", "lead_long")],
        F.min("lead_min").alias("lead_min"), F.max("lead_max").alias("lead_max"))
    used = F.col("rows_after_valid") > 0
    total = parts.agg(
        *[F.sum(c).cast("bigint").alias(c) for c in counts],
        F.min("lead_min").alias("lead_min"), F.max("lead_max").alias("lead_max"),
        F.sum("lead_sum").alias("lead_sum"), F.sum("lead_long").alias("lead_long"),
        F.count_if(used).alias("product_count"),
        F.coalesce(F.max(used & F.col("product_name").rlike(SYNTHETIC_PRODUCT)), F.lit(False))
        .alias("synthetic_products_present"))
    rows_valid = F.nullif(F.col("rows_after_valid"), F.lit(0))
    return total.select(
        *counts, "product_count", "synthetic_products_present", "lead_min", "lead_max",
        (F.col("lead_sum") / rows_valid).alias("lead_mean"),
        (F.col("lead_long") * 100.0 / rows_valid).alias("long_lead_pct"),
        (F.col("rows_after_valid") / F.nullif(F.col("rows_after_dedup"), F.lit(0)))
        .alias("valid_fraction"))


def require_valid(audit: DataFrame, minimum: float) -> DataFrame:
    """The audit itself, or a ``ValueError`` if too few rows were usable. Reads one row."""
    fraction = audit.select("valid_fraction").first()[0]
    if fraction is None or fraction < minimum:
        raise ValueError(f"only {fraction} of the rows are valid, {minimum} are needed")
    return audit


def pinned_assertions(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected and observed value per pinned key; a key that is gone fails."""
    return (expected.join(observed, list(keys), "left")
            .select(*keys, "expected", "observed",
                    F.col("expected").eqNullSafe(F.col("observed")).alias("pass")))


def fence_bounds(df: DataFrame, columns: Sequence[str], factor: float = IQR_FACTOR) -> DataFrame:
    """Lower and upper fence per column: quartiles widened by ``factor`` interquartile ranges."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.75])
    q = quartiles.groupBy("column", "n").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("q3"))
    spread = (F.col("q3") - F.col("q1")) * factor
    return q.select("column", "n", "q1", "q3", (F.col("q1") - spread).alias("lo"),
                    (F.col("q3") + spread).alias("hi"))


def _flagged(df: DataFrame, bounds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``_out_<column>``: whether the value lies outside its fence. Nulls lie inside."""
    fences = bounds.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("lo", "hi"))))
                        .alias("m")).scalar()

    def outside(c: str) -> Column:
        fence = F.try_element_at(F.col("_fences"), F.lit(c))
        return F.coalesce((F.col(c) < fence["lo"]) | (F.col(c) > fence["hi"]), F.lit(False))

    return (df.withColumn("_fences", fences)
            .withColumns({f"_out_{c}": outside(c) for c in columns}).drop("_fences"))


def _any_out(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"_out_{c}") for c in columns])


def fence_counts(df: DataFrame, bounds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, removals per column (each against the same rows) and in total."""
    counts = _flagged(df.select(*columns), bounds, columns).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(f"_out_{c}")).alias(f"removed_{c}") for c in columns],
        F.count_if(_any_out(columns)).alias("removed_total"))
    return counts.withColumns({
        "removed_pct": F.col("removed_total") * 100.0 / F.nullif(F.col("rows"), F.lit(0)),
        "rows_after": F.col("rows") - F.col("removed_total")})


def apply_fence(df: DataFrame, bounds: DataFrame, columns: Sequence[str] = FINANCE) -> DataFrame:
    """Rows with every value inside its fence. Lead time is never among the columns."""
    return (_flagged(df, bounds, columns).where(~_any_out(columns))
            .drop(*[f"_out_{c}" for c in columns]))


def unexpected_members(products: DataFrame, known: DataFrame, key: str = "product_name"
                       ) -> DataFrame:
    """Distinct members, sorted, flagged as made-up by name and as missing from the known list."""
    members = products.select(key).distinct()
    marked = members.join(known.select(key, F.lit(True).alias("_known")).distinct(), key, "left")
    return marked.select(key, F.coalesce(F.col(key).rlike(SYNTHETIC_PRODUCT), F.lit(False))
                         .alias("synthetic"), F.col("_known").isNull().alias("unexpected")
                         ).orderBy(key)


def audit_record(raw: DataFrame, summary: DataFrame, pinned: DataFrame, fences: DataFrame
                 ) -> DataFrame:
    """All audit results as one nested row.

    ``pinned`` is a short list of assertions ``(key, expected, observed, pass)``.
    """
    checks = pinned.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        F.col("key").cast("string").alias("key"),
        F.struct("expected", "observed", "pass").alias("check"))))).alias("m")).scalar()
    removed = fences.select(F.struct(*fences.columns).alias("f")).scalar()
    return summary.withColumns({
        "input_columns": F.array(*[F.lit(c) for c in raw.columns]),
        "missing_columns": F.array(*[
            F.lit(c) for c in missing_columns(raw, SOURCE_COLUMNS.values())])
        .cast("array<string>"),
        "assertions": checks, "iqr": removed})


def load_safely(load: Callable[[], tuple[DataFrame, DataFrame]]
                ) -> tuple[DataFrame | None, DataFrame | None, str | None]:
    """``(frame, audit, error)``: a source that cannot be loaded becomes a message."""
    try:
        frame, audit = load()
        return frame, audit, None
    except (ValueError, PySparkException) as error:
        return None, None, str(error)


def load_and_audit(raw: DataFrame, ship_modes: DataFrame, regions: DataFrame, places: DataFrame,
                   product_factory: DataFrame, division_factory: DataFrame,
                   columns: Sequence[str] = FINANCE, factor: float = IQR_FACTOR
                   ) -> tuple[DataFrame, DataFrame]:
    """Cleaned, fenced rows and the one-row audit."""
    summary = audit_summary(raw, ship_modes, regions, places, product_factory, division_factory)
    clean = clean_orders(raw)
    bounds = fence_bounds(clean, columns, factor)
    removed = fence_counts(clean, bounds, columns)
    audit = summary.withColumn("iqr", removed.select(F.struct(*removed.columns).alias("f")).scalar())
    return apply_fence(clean, bounds, columns), audit
