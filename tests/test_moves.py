import json
import math

import pytest
from pyspark.sql import functions as F

from haulmark.operators import (capacity, kpi, lanes, moves, ranking, reconcile, risk, slices,
                                sweeps)
from haulmark.params import Assumptions, Network, Site
from haulmark.plans import queries as Q
from haulmark.sources import results
from haulmark.sources import warehouse as W

# Assumptions that leave moves on both sides of every gate in the smallest tables.
A = W.ASSUMPTIONS.replace(min_orders_for_recommendation=225.0)


@pytest.fixture(scope="module")
def candidates(moves_fixture):
    return moves_fixture[1]


@pytest.fixture(scope="module")
def scored(candidates):
    return ranking.score_moves(candidates, A.columns()).cache()


def test_published_score_rows(spark):
    """Confidence and score formulas on published rows (orders, stability, objective -> score)."""
    rows = [(10, 0.69685790960631, 0.838421896626889, False, 58.162317757579494,
             0.4876456076652559),
            (1524, 0.7110406015021462, 0.8, False, None, None)]
    df = spark.createDataFrame(rows, "orders int, s double, o double, gap boolean, c double, "
                                     "score double")
    df = df.withColumn("got", ranking.confidence(ranking.evidence_score(F.col("orders")),
                                                 F.col("s"), F.col("gap")))
    first, second = df.collect()
    assert first.got == pytest.approx(first.c, abs=1e-9)
    assert first.o * first.got / 100 == pytest.approx(first.score, abs=1e-12)
    assert ranking_evidence(spark, 10) == pytest.approx(0.5195737064824407)
    assert second.got == pytest.approx(89.88642105, abs=1e-6)


def ranking_evidence(spark, n):
    return spark.range(1).select(ranking.evidence_score(F.lit(n))).first()[0]


def test_every_alternative_once(candidates, moves_fixture):
    assert candidates.count() == 25 * 4
    assert candidates.where("candidate_factory = current_factory").count() == 0
    assert candidates.groupBy("product_name").count().where("count <> 4").count() == 0


def test_speed_halves_gain(candidates):
    def gains(speed):
        priced = moves.price_moves(candidates, A.replace(freight_speed_km_day=speed).columns())
        return {(r.product_name, r.candidate_factory): r.lead_gain_days for r in priced.collect()}
    slow, fast = gains(900.0), gains(1800.0)
    assert all(fast[k] == pytest.approx(slow[k] / 2) for k in slow)


def test_setup_cost_breaks_collinearity(candidates):
    from haulmark.operators.stats import collinearity
    rows = collinearity(moves.price_moves(candidates, A.columns())).collect()
    assert len(rows) == 25 and all(r.distinct_ratios > 1 and not r.collinear for r in rows)


def test_slider_changes_a_pick(candidates):
    # With few units the setup cost weighs, so days and money disagree on some product.
    small = candidates.withColumn("units", F.col("units") / 1000)
    picks = [ranking.top_picks(ranking.score_moves(
        small, A.replace(speed_weight=w, risk_weight=0.0).columns())) for w in (0.0, 1.0)]
    assert reconcile.scenario_flips(*picks).count() > 0


def test_scores_do_not_depend_on_layout(candidates):
    def scores(df):
        return {(r.product_name, r.candidate_factory): r.score
                for r in ranking.score_moves(df, A.columns()).collect()}
    assert scores(candidates.repartition(1)) == scores(candidates.repartition(16))


def test_cells_do_not_depend_on_layout(spark, small):
    lines = Q.lines(spark, small)
    def cells(df):
        return {tuple(r[k] for k in moves.CELL_KEYS): (r.lines, r.lead_sum, r.weight)
                for r in moves.order_cells(df).collect()}
    assert cells(lines.coalesce(1)) == cells(lines.repartition(16, "line_key"))


def test_hot_product_changes_nothing_for_others(spark, small):
    """A third of all rows in one product and order: counts stay exact."""
    lines = Q.lines(spark, small)
    hot = (lines.where("product_name = 'Brand - 1'")
           .withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(12)))).drop("c"))
    both = lines.unionByName(hot)
    before = {r[0]: r[1] for r in moves.product_orders(moves.order_cells(lines)).collect()}
    after = {r[0]: r[1] for r in moves.product_orders(moves.order_cells(both)).collect()}
    assert before == after


def test_risk_rows_are_complete(scored):
    rows = risk.encode_components(scored).collect()
    for r in rows:
        parts = json.loads(r.risk_components)
        assert set(parts) == set(risk.COMPONENTS)
        total = (0.4 * parts["negProfit"] + 0.3 * parts["predVariance"]
                 + 0.2 * parts["lowSupport"] + 0.1 * parts["distanceShift"])
        assert r.risk_score == pytest.approx(total) and 0 <= r.risk_score <= 1
        assert r.risk_level == ("High" if r.risk_score > .5 else
                                "Medium" if r.risk_score > .25 else "Low")


def test_broken_risk_cells_are_not_complete(spark):
    df = spark.createDataFrame([('{"negProfit": 1.0}',), ("not json",), (None,)],
                               "risk_components string")
    assert [r.complete for r in risk.decode_components(df).collect()] == [False] * 3


def test_recommendations_cover_every_product(scored):
    rec = ranking.recommend(scored).collect()
    assert len(rec) == 25
    kept = {r.product_name for r in rec if r.is_retain}
    assert kept == {r.product_name for r in ranking.retained_products(scored).collect()}
    assert all(r.candidate_factory == r.current_factory and r.lead_gain_days == 0
               for r in rec if r.is_retain)
    top = ranking.top_recommendations(ranking.recommend(scored)).collect()
    assert len(top) == 10 and all(r.lead_gain_days > 0 for r in top)
    assert len({r.candidate_factory for r in top}) >= 3


def test_objective_uses_incumbent_as_zero(scored):
    for r in scored.collect():
        assert -1e-12 <= r.objective <= 1 + 1e-12
    one = scored.where("delta_distance_km > 0 and profit_impact < 0").agg(F.max("objective")).first()
    assert one[0] < 1


def test_load_is_conserved(moves_fixture, scored):
    cells = moves_fixture[0]
    rows = capacity.factory_load(cells, ranking.recommend(scored), Q.NETWORK, 1.5).collect()
    assert sum(r.units_in for r in rows) == pytest.approx(sum(r.units_out for r in rows))
    assert all(r.capacity == 1.5 * r.current_units for r in rows)


def test_kpis_and_bootstrap(scored):
    picks = ranking.recommend(scored).cache()
    one = F.lit(0.25)
    point = {r.kpi: r.point for r in kpi.compute_kpis(picks, F.lit(25), one).collect()}
    boot = {r.kpi: r for r in kpi.bootstrap_kpis(picks, F.lit(25), one, 200).collect()}
    assert set(point) == set(kpi.KPIS) == set(boot)
    assert point["coverage_pct"] == 100 and boot["scenario_confidence"].lo == 0.25
    for name in kpi.KPIS:
        assert boot[name].lo <= boot[name].hi and boot[name].point == pytest.approx(point[name])
    again = {r.kpi: (r.lo, r.hi) for r in kpi.bootstrap_kpis(picks.repartition(7), F.lit(25), one, 200)
             .collect()}
    assert all(again[k] == pytest.approx((boot[k].lo, boot[k].hi)) for k in boot)


def test_stability_counts_every_draw(candidates):
    default = ranking.recommend(ranking.score_moves(candidates, A.columns()))
    rows = kpi.choice_stability(kpi.scenario_picks(candidates, A, 20), default).collect()
    assert len(rows) == 25 and all(0 <= r.choice_agreement_pct <= 100 for r in rows)


def test_assumption_sweep_marks_first_hit(candidates):
    rows = sweeps.assumption_sweep(candidates, A, 3, (("min_material_days", (0.0, 0.2, 9.0), "x"),)
                                   ).orderBy("trial").collect()
    assert len(rows) == 3 and rows[2].actionable_count == 0
    hits = [r.trial for r in rows if r.matches_target]
    assert [r.trial for r in rows if r.first_hit] == hits[:1]
    each = sweeps.actionable_rows(sweeps.sweep_picks(
        candidates, A, (("min_material_days", (0.0, 0.2, 9.0), "x"),)))
    counts = {r.trial: r["count"] for r in each.groupBy("trial").count().collect()}
    assert {r.trial: counts.get(r.trial, 0) for r in rows} == {
        r.trial: r.actionable_count for r in rows}


def test_weight_sweep_at_default_has_no_flip(candidates):
    rows = {r.speed_weight: r for r in sweeps.weight_sweep(candidates, A, 5).collect()}
    assert len(rows) == 21 and rows[0.5].flip_count == 0 and rows[0.5].entering_count == 0


def test_assumptions(spark):
    assert Assumptions().replace(speed_weight=0.1).speed_weight == 0.1
    with pytest.raises(TypeError):
        Assumptions().replace(speed=1)
    versions = spark.range(1).select(Assumptions().version(Network()).alias("a"),
                                     Assumptions(freight_speed_km_day=1.0).version(Network())
                                     .alias("b"), Assumptions(speed_weight=0.9).version(Network())
                                     .alias("c")).first()
    assert versions.a != versions.b and versions.a == versions.c and len(versions.a) == 64


def test_bootstrap_coverage_counts_distinct_products(spark):
    """15 products, all covered: the published interval starts at 8 of 15 and ends at the point."""
    picks = spark.createDataFrame(
        [(f"p{i}", 1.0, 10, 5.0, 1.0, "actionable") for i in range(15)],
        "product_name string, lead_gain_days double, orders long, baseline_lead_days double, "
        "profit_impact double, gate_result string")
    rows = {r.kpi: r for r in kpi.bootstrap_kpis(picks, F.lit(15), F.lit(0.5)).collect()}
    coverage = rows["coverage_pct"]
    assert coverage.point == coverage.hi == 100 and round(coverage.lo, 1) == 53.3


def test_networks_of_any_size(spark, moves_fixture):
    with pytest.raises(ValueError):
        Network(())
    with pytest.raises(ValueError):
        Network((Site("x", 0, 0, 0), Site("x", 1, 1, 0)))
    many = Network((*Q.NETWORK.sites, *[Site(f"site {i}", i % 80, i % 170, 1.0)
                                        for i in range(1200)]))
    few = moves_fixture[0].where("product_name in ('Brand - 1', 'Brand - 2')")
    found = moves.candidate_moves(few, many)
    assert found.count() == 2 * (len(many.sites) - 1)
    assert found.where("setup_net is null or delta_distance_km is null").count() == 0


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame(
        [(None, "r", "m", 1, 10, 1.0, 1.0, 1.0), (None, "r", "m", 1, 20, 1.0, 1.0, 1.0),
         ("f", "r", "m", 2, None, 2.0, 2.0, 2.0)],
        "current_factory string, region string, ship_mode string, order_id long, "
        "lead_time_days int, distance_km double, units double, gross_profit double")
    rows = {r.current_factory: r for r in lanes.lane_profile(df).collect()}
    assert rows[None].order_count == 1 and rows[None].mean_lead == 15
    assert rows[None].p90_lead == pytest.approx(19.0)
    assert rows[None].lead_std == pytest.approx(math.sqrt(50))
    assert rows["f"].mean_lead is None and rows["f"].lead_std == 0 and rows["f"].mean_units == 2


def test_slices(spark, small):
    lines = Q.lines(spark, small)
    with pytest.raises(ValueError, match="no order lines"):
        slices.require_rows(slices.order_slice(lines, "none", ["ASIA"], ["5-LOW"]), "the slice")
    names = [r[0] for r in slices.domain(lines, "region").collect()]
    assert names == sorted(names) and len(names) == 5


def test_reconcile_with_a_stored_table(spark, scored, tmp_path):
    computed = ranking.top_picks(scored).select("product_name", "candidate_factory",
                                                "lead_gain_days")
    path = results.write_table(computed, str(tmp_path / "picks"), "csv")
    stored = results.read_table(spark, path, computed.schema, "csv")
    args = (["product_name"], ["candidate_factory"], ["lead_gain_days"])
    assert reconcile.verdict(reconcile.reconcile(computed, stored, *args)).first().all_match
    changed = stored.withColumn("lead_gain_days", F.col("lead_gain_days") + F.when(
        F.col("product_name") == "Brand - 3", 1e-6).otherwise(0.0)).where(
            "product_name <> 'Brand - 4'")
    row = reconcile.verdict(reconcile.reconcile(computed, changed, *args)).first()
    assert (row.keys, row.present, row.labels_match, row.within_tolerance) == (25, 24, 24, 23)
    assert not row.all_match
