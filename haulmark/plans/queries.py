"""The registered queries: each takes a session and a folder of tables and returns a DataFrame.

Doubles are rounded and dates written as text at this edge only, so that results compare exactly
across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulmark.functions.text import calendar_days, calendar_features, is_canadian
from haulmark.functions.text import normalize_product_name, parse_date
from haulmark.operators import (audit, capacity, clean, derive, kpi, lanes, moves, ranking,
                                reconcile, risk, slices, stats, sweeps)
from haulmark.params import Assumptions, Network, scenario_columns
from haulmark.session import staged
from haulmark.sources import warehouse as W
from haulmark.sources.orders import CORRUPT, text_schema
from haulmark.sources.orders import field_count_drift as drift

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NETWORK = Network()
BASE = W.ASSUMPTIONS
TARGET = 5
SLICE = ("Brand - 7", ("ASIA", "EUROPE"), ("1-URGENT", "2-HIGH", "5-LOW"))
PROVINCES = ("NATION_3", "NATION_12", "NATION_20")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def tidy(df: DataFrame, places: int = 6, **by_column: int) -> DataFrame:
    """Round doubles (never to a negative zero) and write dates as text."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            r = F.round(F.col(f.name).cast("double"), by_column.get(f.name, places))
            out[f.name] = F.when(r == 0, 0.0).otherwise(r)
        elif isinstance(f.dataType, T.DateType):
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd")
    return df.withColumns(out) if out else df


def lines(spark: SparkSession, d: str) -> DataFrame:
    return W.order_lines(spark, d, NETWORK)


def cells(spark: SparkSession, d: str) -> DataFrame:
    """The order cells, staged: one scan of the order lines, however often a query reads them."""
    return staged(moves.order_cells(lines(spark, d)), "cells")


def measured(c: DataFrame) -> DataFrame:
    """Moves with order counts and residual deviations, before anything is assumed."""
    found = moves.candidate_moves(c, NETWORK)
    moments = risk.baseline_residuals(c)
    return risk.with_residuals(found, risk.residual_std(moments), risk.overall_std(moments))


def candidates_of(c: DataFrame) -> DataFrame:
    """Measured moves, staged (a row per product and other factory), with fixed risk inputs."""
    return risk.risk_inputs(staged(measured(c), "moves"), BASE)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return candidates_of(cells(spark, d))


def scored_with_cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = cells(spark, d)
    return ranking.score_moves(candidates_of(c), BASE.columns()), c


def scored(spark: SparkSession, d: str) -> DataFrame:
    return scored_with_cells(spark, d)[0]


def priced(spark: SparkSession, d: str) -> DataFrame:
    a = BASE.columns()
    return moves.gate_moves(moves.price_moves(candidates(spark, d), a), a)


def baseline_r2(c: DataFrame):
    """Hold-out R2 of the baseline predictor, the scenario confidence of the oracle queries."""
    return risk.holdout_score(risk.baseline_residuals(c)).select("r2").scalar()


def catalogue(spark: SparkSession, d: str):
    """Number of products in the part table."""
    return W.product_divisions(spark, d).agg(
        F.count_distinct("product_name").alias("n")).scalar()


# ---- sources, cleaning, audit -------------------------------------------------------------------

@query
def order_lines(spark, d):
    return tidy(lines(spark, d).drop("lat", "lon"), sales=4, cost=4, gross_profit=4)


@query
def dedup_orders(spark, d):
    return clean.dedup_orders(W.raw_order_lines(spark, d))


@query
def clean_orders(spark, d):
    return tidy(clean.clean_orders(W.raw_order_lines(spark, d)), 4)


@query
def rejected_rows(spark, d):
    bad = clean.rejected_rows(clean.type_orders(clean.dedup_orders(W.raw_order_lines(spark, d))))
    return bad.select("row_id", "order_id", F.array_join("reasons", "+").alias("reasons"))


@query
def audit_summary(spark, d):
    divisions = W.product_divisions(spark, d)
    explicit = W.explicit_map(spark, NETWORK)
    return tidy(audit.audit_summary(
        W.raw_order_lines(spark, d), W.mode_table(spark), W.region_table(spark, d),
        W.state_table(spark, d), explicit, derive.modal_factory(explicit, divisions)))


@query
def lead_summary(spark, d):
    return tidy(audit.lead_summary(lines(spark, d)))


@query
def repaired_lead(spark, d):
    """The offsets need dates alone, so they come from the two fact tables only."""
    return derive.repaired_lead(lines(spark, d), W.order_dates(spark, d)).select(
        "order_id", "line_key", "year_gap", "lead_time_days", "repaired_lead_days")


@query
def iqr_fence_events(spark, d):
    events = W.table(spark, d, "events").select("event_id", "event_type", "value")
    return audit.apply_fence(events, audit.fence_bounds(events, ["value"]), ["value"])


@query
def iqr_fence_counts(spark, d):
    events = W.table(spark, d, "events")
    bounds = audit.fence_bounds(events, ["value"])
    return tidy(audit.fence_counts(events, bounds, ["value"]))


@query
def iqr_bounds_lines(spark, d):
    return tidy(audit.fence_bounds(staged(lines(spark, d).select(*clean.FINANCE), "finance"), clean.FINANCE))


FENCE_FACTOR = 0.5  # fixed value: a narrow fence, so that all four columns have outliers here


@query
def iqr_fence_finance(spark, d):
    """Removals per money column, each against the same rows, and in total."""
    rows = staged(lines(spark, d).select(*clean.FINANCE), "finance")
    bounds = audit.fence_bounds(rows, clean.FINANCE, FENCE_FACTOR)
    return tidy(audit.fence_counts(rows, bounds, clean.FINANCE))


@query
def audit_record(spark, d):
    """Summary, missing columns, assertions and fence in one nested row, read back as columns."""
    raw = W.raw_order_lines(spark, d).drop("city")
    typed = staged(audit.typed_rows(raw).select(*audit.TYPED), "typed")  # copies collapse once, for both
    rows = audit.finished_rows(typed).select("state", "lead_time_days", *clean.FINANCE)
    seen = rows.groupBy("state").agg(F.count(F.lit(1)).alias("observed"))
    expected = W.state_table(spark, d).select(F.col("state"), F.lit(0).cast("bigint")
                                              .alias("expected"))
    pinned = audit.pinned_assertions(expected, seen, ["state"]).withColumnRenamed("state", "key")
    divisions, explicit = W.product_divisions(spark, d), W.explicit_map(spark, NETWORK)
    summary = audit.summary_of(typed, W.mode_table(spark), W.region_table(spark, d),
                               W.state_table(spark, d), explicit,
                               derive.modal_factory(explicit, divisions))
    bounds = audit.fence_bounds(rows, clean.FINANCE, FENCE_FACTOR)
    record = audit.audit_record(raw, summary, pinned,
                                audit.fence_counts(rows, bounds, clean.FINANCE))
    return tidy(record.select(
        "input_rows", "rows_after_valid", "lead_mean", F.size("input_columns").alias("columns"),
        F.array_join("missing_columns", ",").alias("missing"), F.explode("assertions").alias(
            "state", "check"), "iqr").select(
        "input_rows", "rows_after_valid", "lead_mean", "columns", "missing", "state",
        "check.observed", "check.pass", "iqr.removed_sales", "iqr.removed_total"))


def _source_text(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as delimited text; some lines have a field too many, some one too few."""
    raw = W.raw_order_lines(spark, d)
    order = F.col("order_id").try_cast("bigint")
    line = F.concat_ws(",", *raw.columns)
    return raw.select(F.when(order % 211 == 0, F.concat(line, F.lit(",more")))
                      .when(order % 223 == 0, F.concat_ws(",", *raw.columns[:-1]))
                      .otherwise(line).alias("line"))


@query
def field_count_drift(spark, d):
    text = _source_text(spark, d)
    schema = text_schema(W.RAW_COLUMNS, corrupt=True)
    parsed = text.select(F.from_csv("line", schema.toDDL(), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r")).select("r.*")
    return drift(parsed)


@query
def strict_dates(spark, d):
    """Rows per order date after strict parsing, which fails the job on any bad date left."""
    rows = clean.data_rows(W.raw_order_lines(spark, d))
    good = rows.where(parse_date(F.col("order_date")).isNotNull()
                      & parse_date(F.col("ship_date")).isNotNull())
    days = staged(good.groupBy("order_date", "ship_date").agg(F.count(F.lit(1)).alias("n")), "days")
    return tidy(clean.strict_dates(days).groupBy("order_date").agg(
        F.sum("n").alias("rows"), F.max("ship_date").alias("last_shipped")))


@query
def pinned_assertions(spark, d):
    """The first lead time of every order, from the raw tables, against the cleaned rows."""
    orders = W.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"), "o_orderdate", "o_orderkey")
    first = W.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("first_ship"))
    expected = (first.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
                .select("order_id", F.datediff("first_ship", "o_orderdate").alias("expected")))
    observed = clean.clean_orders(W.raw_order_lines(spark, d)).groupBy("order_id").agg(
        F.min("lead_time_days").alias("observed"))
    return audit.pinned_assertions(expected, observed, ["order_id"])


@query
def unexpected_members(spark, d):
    seen = W.raw_order_lines(spark, d).select(
        normalize_product_name(F.col("product_name")).alias("product_name"))
    return audit.unexpected_members(seen, W.explicit_map(spark, NETWORK))


# ---- derivation ---------------------------------------------------------------------------------

@query
def normalized_products(spark, d):
    raw = clean.data_rows(W.raw_order_lines(spark, d))
    return raw.groupBy("product_name", normalize_product_name(F.col("product_name"))
                       .alias("canonical_name")).agg(F.count(F.lit(1)).alias("rows"))


@query
def factory_resolution(spark, d):
    return lines(spark, d).groupBy("product_name", "division", "current_factory",
                                   "factory_provenance").agg(F.count(F.lit(1)).alias("rows"))


@query
def modal_factory(spark, d):
    return derive.modal_factory(W.explicit_map(spark, NETWORK), W.product_divisions(spark, d))


@query
def geocoded_orders(spark, d):
    orders = W.placed_orders(spark, d).drop("lat", "lon").withColumn(
        "postal_code", F.lpad((F.col("customer_id") % 1000).cast("string"), 5, "0"))
    placed = derive.geocode_chain(orders, W.postal_centroids(spark, d), W.state_table(spark, d))
    return tidy(placed.select("order_id", "postal_code", "state", "lat", "lon", "geo_source"))


@query
def geocode_coverage(spark, d):
    return tidy(derive.share_by(geocoded_orders(spark, d), "geo_source"))


@query
def unresolved_places(spark, d):
    return derive.unresolved_places(clean.data_rows(W.raw_order_lines(spark, d)),
                                    W.state_table(spark, d))


@query
def order_distance(spark, d):
    return tidy(lines(spark, d).select("order_id", "line_key", "state", "current_factory",
                                       "distance_km"))


def ordered_places(spark: SparkSession, d: str) -> DataFrame:
    """Destinations with an order line: keys meet before anything else is joined."""
    keys = W.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"))
    return W.placed_orders(spark, d).join(keys, "order_id", "left_semi").select(
        "state", "lat", "lon")


@query
def factory_distance_matrix(spark, d):
    return tidy(derive.distance_matrix(ordered_places(spark, d), NETWORK))


@query
def factory_distance_wide(spark, d):
    wide = derive.distance_matrix_wide(derive.distance_matrix(ordered_places(spark, d), NETWORK),
                                       NETWORK)
    return tidy(wide.toDF("state", *[f"site_{i}_km" for i in range(len(NETWORK.sites))]))


@query
def transit_proxy(spark, d):
    modes = W.mode_table(spark).select("ship_mode", "multiplier")
    days = derive.transit_days(F.col("distance_km"), F.col("multiplier"), F.col("order_id"),
                               F.col("line_key"))
    return lines(spark, d).join(modes, "ship_mode").select(
        "order_id", "line_key", "ship_mode", days.alias("transit_days"))


@query
def calendar_profile(spark, d):
    features = calendar_features(F.col("order_date"))
    return tidy(lines(spark, d).withColumns(features).groupBy(*features).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("lead_time_days").alias("mean_lead")))


@query
def ordinal_ranks(spark, d):
    raw = clean.data_rows(W.raw_order_lines(spark, d)).select("ship_mode", "region")
    ranked = derive.with_rank(raw, W.mode_table(spark), "ship_mode", "ship_mode_rank")
    ranked = derive.with_rank(ranked, W.region_table(spark, d), "region", "region_rank")
    return ranked.groupBy("ship_mode", "ship_mode_rank", "region", "region_rank").agg(
        F.count(F.lit(1)).alias("rows"))


@query
def country_flag(spark, d):
    return lines(spark, d).groupBy("state", is_canadian(F.col("state"), PROVINCES).alias("canadian")
                                   ).agg(F.count(F.lit(1)).alias("rows"))


@query
def utc_calendar_days(spark, d):
    """Days between a user's first and last event; the stored wall-clock times are UTC."""
    def instant(c: str):
        local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(c))
        return local.cast("timestamp")

    span = W.table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first"),
                                                              F.max("ts").alias("last"))
    return span.select("user_id", calendar_days(instant("first"), instant("last")).alias("days"))


# ---- slices, lanes, statistics ------------------------------------------------------------------

@query
def sliced_orders(spark, d):
    return tidy(slices.order_slice(lines(spark, d), *SLICE).select(
        "order_id", "line_key", "product_name", "region", "ship_mode", "units", "lead_time_days"))


@query
def product_domain(spark, d):
    """Products with an order line: the part table is reduced to the keys that occur."""
    keys = W.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return slices.domain(W.products(spark, d).join(keys, "p_partkey", "left_semi"), "product_name")


@query
def unmapped_products(spark, d):
    """Products that no map resolves, if only the first half of the brands is mapped."""
    explicit = W.explicit_map(spark, NETWORK).where(
        F.regexp_extract("product_name", r"(\d+)$", 1).cast("int") < 12)
    parts = derive.resolve_factory(W.products(spark, d), explicit, derive.modal_factory(
        explicit, W.product_divisions(spark, d)).where("division <> 'div_1'"))
    return derive.unmapped_products(parts)


@query
def value_counts(spark, d):
    return slices.value_counts(lines(spark, d), "current_factory")


@query
def lane_profile(spark, d):
    return tidy(lanes.lane_profile(lines(spark, d)), mean_profit=2)


@query
def slow_routes(spark, d):
    profile = lanes.lane_profile(lines(spark, d))
    found = lanes.slow_routes(profile, W.LANE_MIN_ORDERS)
    return tidy(lanes.by_exposure(found).select(
        *lanes.LANE_KEYS, "order_count", "mean_lead", "p90_lead", "avg_lead", "slow_route",
        "slow_by_mean", "exposure", "min_orders_threshold"), exposure=4)


@query
def top_exposure(spark, d):
    profile = lanes.lane_profile(lines(spark, d))
    found = lanes.slow_routes(profile, W.LANE_MIN_ORDERS)
    return tidy(lanes.top_exposure(found).select(*lanes.LANE_KEYS, "order_count", "mean_lead",
                                                 "exposure"), exposure=4)


@query
def region_product_profile(spark, d):
    return tidy(lanes.region_product_profile(lines(spark, d)), mean_profit=2)


@query
def congested_pairs(spark, d):
    pairs = lanes.congested_pairs(lines(spark, d))
    return tidy(lanes.by_congestion(pairs), mean_profit=2)


@query
def mode_slopes(spark, d):
    return tidy(stats.group_slopes(lines(spark, d), "ship_mode"), 6, slope=9, r2=9)


@query
def distance_bins(spark, d):
    return tidy(stats.residual_bins(lines(spark, d)))


@query
def value_histogram(spark, d):
    return tidy(stats.histogram(W.table(spark, d, "events"), "value"))


@query
def lead_box_quartiles(spark, d):
    return tidy(stats.box_quartiles(lines(spark, d), "ship_mode"))


@query
def lane_measures_long(spark, d):
    return tidy(stats.measures_long(
        lanes.lane_profile(lines(spark, d)), lanes.LANE_KEYS,
        ["order_count", "mean_lead", "p90_lead", "lead_std", "mean_distance", "mean_units"]))


@query
def collinearity_check(spark, d):
    return tidy(stats.collinearity(priced(spark, d)))


# ---- moves --------------------------------------------------------------------------------------

@query
def candidate_moves(spark, d):
    return tidy(moves.candidate_moves(cells(spark, d), NETWORK).select(
        "product_name", "division", "current_factory", "candidate_factory", "orders", "lines",
        "units", "gross_profit", "current_distance_km", "candidate_distance_km",
        "delta_distance_km", "baseline_lead_days"), gross_profit=4)


@query
def move_costs(spark, d):
    return tidy(priced(spark, d).select(
        "product_name", "candidate_factory", "delta_lead_days", "lead_gain_days", "new_lead_days",
        "freight_delta", "setup_net", "delta_cost", "profit_impact", "new_profit"),
        freight_delta=4, delta_cost=4, profit_impact=4, new_profit=2)


@query
def capability_gap(spark, d):
    return candidates(spark, d).select("product_name", "division", "candidate_factory",
                                       "capability_gap")


@query
def move_gates(spark, d):
    return tidy(priced(spark, d).select(
        "product_name", "candidate_factory", "orders", "lead_gain_days", "sufficient_evidence",
        "materially_better", "gate_result", "material_gap_days"))


@query
def reducing_moves(spark, d):
    return tidy(moves.reducing(priced(spark, d)).select(
        "product_name", "candidate_factory", "delta_distance_km", "lead_gain_days"))


@query
def breakeven_shortlist(spark, d):
    return tidy(moves.breakeven_shortlist(priced(spark, d)).select(
        "product_name", "current_factory", "candidate_factory", "orders", "lead_gain_days",
        "breakeven_speed_km_day"))


@query
def qualifying_moves(spark, d):
    return tidy(ranking.qualifying(scored(spark, d)).select(
        "product_name", "candidate_factory", "lead_gain_days", "profit_impact", "capability_gap",
        "score", "is_top_scored_pick"), profit_impact=4)


@query
def negative_impact(spark, d):
    return tidy(moves.negative_impact(priced(spark, d)).select(
        "product_name", "candidate_factory", "profit_impact"), 4)


@query
def priority_ranking(spark, d):
    return tidy(moves.priority_ranking(priced(spark, d), 0.5).select(
        "product_name", "candidate_factory", "priority_score"), 4)


@query
def best_priority_move(spark, d):
    ranked = moves.priority_ranking(priced(spark, d), 0.5).withColumn(
        "move", F.concat_ws(" > ", "product_name", "candidate_factory"))
    return tidy(slices.best_row(ranked, "priority_score", "move").select("move", "priority_score"),
                4)


def closed_form(spark: SparkSession):
    """Days by scaled distance and mode multiplier, the proxy without its jitter."""
    modes = W.mode_table(spark).select("ship_mode", "multiplier")

    def predict(grid: DataFrame) -> DataFrame:
        days = F.col("distance_km") / derive.KM_PER_DAY * F.col("multiplier")
        return grid.join(modes, "ship_mode").withColumn("predicted_days", days)
    return predict


@query
def all_factory_days(spark, d):
    days = moves.factory_days(cells(spark, d), NETWORK, closed_form(spark))
    return tidy(days.select("product_name", "current_factory", "factory", "is_incumbent", "days",
                            "distance_km"))


@query
def all_factory_days_by_line(spark, d):
    days = moves.factory_days(cells(spark, d), NETWORK, closed_form(spark), weighted=False)
    return tidy(days.select("product_name", "factory", "is_incumbent", "days"))


@query
def whatif_profit(spark, d):
    days = moves.factory_days(cells(spark, d), NETWORK, closed_form(spark))
    return tidy(moves.simulate_reallocation(days, BASE.freight_cost_per_unit_per_1000km).select(
        "product_name", "candidate_factory", "baseline_days", "new_days", "days_reduced",
        "gross_profit", "profit_impact", "whatif_profit"), gross_profit=4, profit_impact=4,
        whatif_profit=2)


@query
def assumption_version(spark, d):
    """Fingerprint of the assumptions behind each row, for the base and for a slower network."""
    versions = F.array(*[F.struct(F.lit(name).alias("scenario"), a.version(NETWORK).alias("version"),
                                  *[c.alias(n) for n, c in a.columns().items()])
                         for name, a in (("base", BASE),
                                         ("slow", BASE.replace(freight_speed_km_day=450.0)))])
    each = candidates(spark, d).withColumn("s", F.explode(versions))
    priced = moves.price_moves(each, scenario_columns("s"))
    return tidy(priced.select("product_name", "candidate_factory", "s.scenario", "lead_gain_days",
                              F.col("s.version").alias("assumption_version")))


# ---- risk, ranking, capacity --------------------------------------------------------------------

@query
def residual_std_baseline(spark, d):
    return tidy(risk.residual_std(risk.baseline_residuals(cells(spark, d))))


@query
def risk_components(spark, d):
    return tidy(scored(spark, d).select(
        "product_name", "candidate_factory", "neg_profit", "pred_variance", "low_support",
        "distance_shift", "risk_score"))


@query
def risk_levels(spark, d):
    return slices.value_counts(scored(spark, d), "risk_level")


@query
def risk_json(spark, d):
    decoded = risk.decode_components(risk.encode_components(scored(spark, d)))
    return tidy(decoded.select("product_name", "candidate_factory", "components.*", "complete"))


@query
def scored_moves(spark, d):
    return tidy(scored(spark, d).select(
        "product_name", "current_factory", "candidate_factory", "orders", "lead_gain_days",
        "profit_impact", "capability_gap", "risk_score", "risk_level", "objective",
        "evidence_score", "stability_score", "confidence", "score", "gate_result"),
        profit_impact=4)


@query
def moves_with_incumbents(spark, d):
    return tidy(ranking.with_incumbents(scored(spark, d)), profit_impact=4)


@query
def retain_products(spark, d):
    return ranking.retained_products(candidates(spark, d))


@query
def movable_products(spark, d):
    return ranking.movable_products(candidates(spark, d))


@query
def recommendations(spark, d):
    return tidy(ranking.recommend(scored(spark, d)).select(
        "product_name", "current_factory", "candidate_factory", "is_retain", "lead_gain_days",
        "profit_impact", "risk_level", "score"), profit_impact=4)


@query
def top_recommendations(spark, d):
    top = ranking.top_recommendations(ranking.recommend(scored(spark, d)))
    return tidy(top.select("product_name", "current_factory", "candidate_factory", "orders",
                           "lead_gain_days", "delta_distance_km", "risk_score", "risk_level",
                           "capability_gap", "score"))


@query
def recommended_factories(spark, d):
    top = ranking.top_recommendations(ranking.recommend(scored(spark, d)))
    return top.agg(F.count_distinct("candidate_factory").alias("factories"),
                   F.count(F.lit(1)).alias("rows"))


@query
def top_pick_flag(spark, d):
    return tidy(ranking.flag_top_pick(scored(spark, d)).select(
        "product_name", "candidate_factory", "score", "is_top_scored_pick"))


@query
def gate_summary(spark, d):
    return ranking.gate_counts(ranking.top_picks(scored(spark, d)))


@query
def gate_products(spark, d):
    """The top factory and gate of every product."""
    return ranking.top_picks(scored(spark, d)).select("product_name", "candidate_factory",
                                                      "gate_result")


@query
def actionable_products(spark, d):
    return tidy(sweeps.actionable_rows(ranking.top_picks(scored(spark, d)), []), profit_impact=4)


@query
def picks_by_factory(spark, d):
    return sweeps.names_by_factory(ranking.top_picks(scored(spark, d)))


@query
def factory_load(spark, d):
    moved, c = scored_with_cells(spark, d)
    picks = ranking.recommend(moved)
    return tidy(capacity.factory_load(c, picks, NETWORK, BASE.capacity_multiplier))


@query
def assignment_audit(spark, d):
    """The plan that makes every product at its nearest factory."""
    c = cells(spark, d)
    days = moves.factory_days(c, NETWORK, closed_form(spark))
    nearest = days.groupBy("product_name").agg(
        F.min(F.struct("distance_km", "factory", "units")).alias("m"))
    plan = nearest.select("product_name", "m.factory", "m.units")
    return tidy(capacity.assignment_audit(plan, c, NETWORK, BASE.capacity_multiplier))


# ---- key figures and sweeps ---------------------------------------------------------------------

@query
def kpi_point(spark, d):
    moved, c = scored_with_cells(spark, d)
    picks = ranking.recommend(moved)
    return tidy(kpi.compute_kpis(picks, catalogue(spark, d), baseline_r2(c)))


@query
def kpi_point_gated(spark, d):
    moved, c = scored_with_cells(spark, d)
    picks = ranking.recommend(moved)
    return tidy(kpi.compute_kpis(picks, catalogue(spark, d), baseline_r2(c), gated=True))


@query
def kpi_bootstrap(spark, d):
    moved, c = scored_with_cells(spark, d)
    picks = ranking.recommend(moved)
    return tidy(kpi.bootstrap_kpis(picks, catalogue(spark, d), baseline_r2(c)), 5)


@query
def sensitivity_draws(spark, d):
    c = cells(spark, d)
    picks = kpi.scenario_picks(candidates_of(c), BASE)
    return tidy(kpi.sensitivity(picks, catalogue(spark, d), baseline_r2(c)), 5)


@query
def sensitivity_gated(spark, d):
    c = cells(spark, d)
    picks = kpi.scenario_picks(candidates_of(c), BASE)
    return tidy(kpi.sensitivity(picks, catalogue(spark, d), baseline_r2(c), gated=True), 5)


def _stability(spark, d):
    moved = candidates(spark, d)
    default = ranking.recommend(ranking.score_moves(moved, BASE.columns()))
    return kpi.choice_stability(kpi.scenario_picks(moved, BASE), default)


@query
def choice_stability(spark, d):
    return tidy(_stability(spark, d))


@query
def stability_summary(spark, d):
    return tidy(kpi.stability_summary(_stability(spark, d)))


@query
def weight_sweep(spark, d):
    return sweeps.weight_sweep(candidates(spark, d), BASE, TARGET)


@query
def speed_sweep(spark, d):
    return sweeps.speed_sweep(candidates(spark, d), BASE, TARGET)


@query
def assumption_sweep(spark, d):
    return sweeps.assumption_sweep(candidates(spark, d), BASE, TARGET)


@query
def weight_sweep_products(spark, d):
    """Each product's changes against the default weight, under every weight."""
    return sweeps.weight_changes(candidates(spark, d), BASE).where("change is not null")


@query
def assumption_sweep_products(spark, d):
    """The actionable products of every trial."""
    return tidy(sweeps.actionable_rows(sweeps.sweep_picks(candidates(spark, d), BASE, sweeps.SWEEPS)),
                profit_impact=4)


def regional_cells(spark: SparkSession, d: str, c: DataFrame) -> DataFrame:
    """Cells placed at the mean centroid of their region instead of their state's."""
    states, regions = W.state_table(spark, d), W.region_table(spark, d)
    centres = (states.join(regions, F.col("n_regionkey") == F.col("region_rank")).groupBy("region")
               .agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")))
    return c.drop("lat", "lon").join(centres, "region")


@query
def alt_distance_gates(spark, d):
    c = cells(spark, d)
    both = [ranking.score_moves(candidates_of(basis), BASE.columns())
            for basis in (c, regional_cells(spark, d, c))]
    return tidy(sweeps.compare_bases(*both, ("state", "region")))


@query
def scenario_flips(spark, d):
    moved = candidates(spark, d)
    fast = BASE.replace(speed_weight=1.0, risk_weight=0.0)
    safe = BASE.replace(speed_weight=0.0, risk_weight=1.0)
    picks = [ranking.top_picks(ranking.score_moves(moved, a.columns())) for a in (fast, safe)]
    return reconcile.scenario_flips(*picks)


def _stored_and_computed(spark, d):
    moved = candidates(spark, d)
    computed = ranking.top_picks(ranking.score_moves(moved, BASE.columns()))
    stored = ranking.top_picks(ranking.score_moves(
        moved, BASE.replace(freight_cost_per_unit_per_1000km=0.30, speed_weight=0.25).columns()))
    return computed, stored


@query
def reconcile_picks(spark, d):
    computed, stored = _stored_and_computed(spark, d)
    return tidy(reconcile.reconcile(computed, stored, ["product_name"], ["candidate_factory"],
                                    ["lead_gain_days", "profit_impact"], 1e-6), 4)


@query
def reconcile_verdict(spark, d):
    computed, stored = _stored_and_computed(spark, d)
    return reconcile.verdict(reconcile.reconcile(
        computed, stored, ["product_name"], ["candidate_factory"], ["lead_gain_days"], 1e-6))


@query
def actionable_set_change(spark, d):
    """Products entering and leaving the actionable set when the speed assumption halves."""
    moved = candidates(spark, d)
    go = F.col("gate_result") == "actionable"
    now = ranking.top_picks(ranking.score_moves(moved, BASE.columns())).where(go)
    slow = ranking.top_picks(ranking.score_moves(
        moved, BASE.replace(freight_speed_km_day=450.0).columns())).where(go)
    enter = reconcile.set_difference(slow, now).withColumn("change", F.lit("entering"))
    leave = reconcile.set_difference(now, slow).withColumn("change", F.lit("leaving"))
    return enter.unionByName(leave)


@lru_cache(maxsize=1)
def all_queries() -> dict[str, Query]:
    from haulmark.plans import learned  # noqa: F401  registers the model queries
    return dict(QUERIES)
