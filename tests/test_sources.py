import json

import pytest
from pyspark.sql import functions as F

from haulmark.operators import audit, clean, derive
from haulmark.sources import dims, results
from haulmark.sources import orders as O
from haulmark.sources import warehouse as W

HEADER = ",".join(O.SOURCE_COLUMNS)
GOOD = "{i},O{o},01-03-2024,11-03-2024,First Class,C1,United States,Austin,Texas,78701,Div A," \
       "Interior,P1,Thing -One,10.5,3,4.5,{cost}"


@pytest.fixture
def csv(tmp_path):
    rows = [HEADER, GOOD.format(i=1, o=1, cost="6.0"), GOOD.format(i=2, o=1, cost="6.0"),
            GOOD.format(i=3, o=2, cost=""), HEADER, "," * 17,
            GOOD.format(i=4, o=3, cost="6.0").replace("01-03-2024", "31-02-2024"),
            GOOD.format(i=5, o=4, cost="6.0").replace("10.5", "ten"),
            GOOD.format(i=6, o=5, cost="n/a"),
            GOOD.format(i=7, o=6, cost="6.0").replace("Texas", "Nowhere")]
    path = tmp_path / "orders.csv"
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def dimensions(spark):
    explicit = dims.product_factory(spark, {"Thing - Two": "Sugar Shack"})
    divisions = dims.local_table(spark, ["product_name", "division"], [("Thing - Two", "Div A")])
    return (dims.ship_modes(spark), dims.regions(spark), dims.state_centroids(spark), explicit,
            derive.modal_factory(explicit, divisions))


def test_scan_and_audit(spark, csv):
    raw = O.scan_order_lines(spark, csv)
    assert raw.columns == list(O.SOURCE_COLUMNS.values())
    assert all(t == "string" for _, t in raw.dtypes)
    a = audit.audit_summary(raw, *dimensions(spark)).first()
    assert (a.input_rows, a.stray_header_rows, a.blank_rows, a.duplicate_rows) == (9, 1, 1, 1)
    assert (a.rows_after_dedup, a.rows_after_valid, a.dropped_parse_errors) == (6, 3, 3)
    assert (a.unparseable_order_dates, a.unparseable_financial_rows) == (1, 2)
    assert (a.cost_imputed, a.unresolved_centroids, a.fallback_products) == (1, 1, 3)
    assert (a.product_count, a.lead_min, a.lead_max, a.valid_fraction) == (1, 10, 10, 0.5)
    assert a.unmapped_ship_modes == 0 and not a.synthetic_products_present
    with pytest.raises(ValueError, match="valid"):
        audit.require_valid(audit.audit_summary(raw, *dimensions(spark)), 0.9)


def test_cleaned_rows(spark, csv):
    rows = {r.order_id: r for r in clean.clean_orders(O.scan_order_lines(spark, csv)).collect()}
    assert set(rows) == {"O1", "O2", "O6"}
    assert rows["O1"].row_id == 1 and rows["O1"].copies == 2
    assert rows["O2"].cost == 6.0 and rows["O2"].cost_imputed
    assert rows["O1"].product_name == "Thing - One" and rows["O1"].postal_code == "78701"
    with pytest.raises(ValueError, match="no centroid for 1 values of state, listed in (.*)") as e:
        derive.require_resolved(clean.clean_orders(O.scan_order_lines(spark, csv)),
                                dims.state_centroids(spark))
    listed = spark.read.parquet(str(e.value).rpartition(" in ")[2]).collect()
    assert [r.state for r in listed] == ["Nowhere"]
    resolved = derive.resolve_factory(clean.clean_orders(O.scan_order_lines(spark, csv)),
                                      *[t.limit(0) for t in dimensions(spark)[3:]])
    with pytest.raises(ValueError, match="no factory mapping for 1 products"):
        derive.require_mapped(resolved)


def test_missing_columns_fail_before_any_action(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text("Row ID,Order ID\n1,2\n")
    with pytest.raises(ValueError, match="Ship Date"):
        O.scan_order_lines(spark, str(path))


def test_safe_load_reports_errors(spark, tmp_path, csv):
    frame, record, error = audit.load_safely(lambda: audit.load_and_audit(
        O.scan_order_lines(spark, str(tmp_path / "none.csv")), *dimensions(spark)))
    assert frame is None and record is None and "none.csv" in error
    frame, record, error = audit.load_safely(lambda: audit.load_and_audit(
        O.scan_order_lines(spark, csv), *dimensions(spark)))
    assert error is None and frame.count() == 3 and record.first().iqr.removed_total == 0


def test_field_count_drift(spark, tmp_path):
    path = tmp_path / "drift.csv"
    good = GOOD.format(i=1, o=1, cost="6.0")
    path.write_text("\n".join([HEADER, good, good + ",extra", good.rsplit(",", 2)[0], good]) + "\n")
    raw = O.scan_order_lines(spark, str(path), keep_corrupt=True)
    row = O.field_count_drift(raw).first()
    assert (row.rows, row.drifted_rows) == (4, 2)


def test_fuzzed_rows_never_raise(spark, tmp_path):
    import random
    rng = random.Random(3)
    junk = ["", "abc", "31-02-2020", "99999999999999999999", "NaN", "-", "1e400", "é", " "]
    lines = [HEADER]
    for i in range(200):
        cells = GOOD.format(i=i, o=i, cost="6.0").split(",")
        for _ in range(rng.randint(1, 6)):
            cells[rng.randrange(18)] = rng.choice(junk)
        lines.append(",".join(cells))
    path = tmp_path / "fuzz.csv"
    path.write_text("\n".join(lines) + "\n")
    a = audit.audit_summary(O.scan_order_lines(spark, str(path)), *dimensions(spark)).first()
    assert a.input_rows == 200
    assert a.rows_after_valid + a.dropped_parse_errors == a.rows_after_dedup


@pytest.mark.parametrize("fmt", results.FORMATS)
def test_result_tables_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", 1, 0.1), ("b", None, -2.5)], "k string, n int, v double")
    path = results.write_table(df, str(tmp_path / fmt), fmt)
    back = results.read_table(spark, path, df.schema, fmt)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        results.write_table(df, path, "xml")


def test_kpi_object_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x", 1.0, 0.5, 1.5), ("y", -2.0, -3.0, 0.0)],
                               "kpi string, point double, lo double, hi double")
    path = results.write_kpis(df, str(tmp_path / "kpis"))
    assert sorted(map(tuple, results.read_kpis(spark, path).collect())) == sorted(
        map(tuple, df.collect()))
    text = [p for p in (tmp_path / "kpis").iterdir() if p.suffix == ".json"][0].read_text()
    assert json.loads(text)["ci"]["x"] == [0.5, 1.5]


def test_audit_record_is_nested(spark, csv):
    raw = O.scan_order_lines(spark, csv)
    rows = clean.clean_orders(raw)
    pinned = audit.pinned_assertions(
        spark.createDataFrame([(1, 10), (3, 11), (99, 1)], "key long, expected int"),
        rows.select(F.col("row_id").alias("key"), F.col("lead_time_days").alias("observed")), ["key"])
    bounds = audit.fence_bounds(rows, clean.FINANCE)
    record = audit.audit_record(raw, audit.audit_summary(raw, *dimensions(spark)), pinned,
                                audit.fence_counts(rows, bounds, clean.FINANCE)).first()
    assert len(record.input_columns) == 18 and record.missing_columns == []
    short = raw.drop("city", "country")
    record_short = audit.audit_record(short, audit.audit_summary(short, *dimensions(spark)), pinned,
                                      audit.fence_counts(rows, bounds, clean.FINANCE)).first()
    assert record_short.missing_columns == ["city", "country"]
    assert record.assertions["1"]["pass"] and not record.assertions["3"]["pass"]
    assert not record.assertions["99"]["pass"] and record.iqr.rows_after == 3


def test_fence_counts_each_column_against_the_same_rows(spark):
    df = spark.range(100).select((F.col("id") % 10).cast("double").alias("a"),
                                 (F.col("id") % 10).cast("double").alias("b"))
    df = df.unionByName(spark.createDataFrame([(1e6, 1e6), (1e6, 1.0), (None, 2.0)],
                                              "a double, b double"))
    bounds = audit.fence_bounds(df, ["a", "b"])
    row = audit.fence_counts(df, bounds, ["a", "b"]).first()
    assert (row.removed_a, row.removed_b, row.removed_total, row.rows_after) == (2, 1, 2, 101)
    assert audit.apply_fence(df, bounds, ["a", "b"]).count() == 101


def test_dimension_tables_have_a_known_size(spark):
    plan = dims.state_centroids(spark)._jdf.queryExecution().optimizedPlan()
    assert int(str(plan.stats().sizeInBytes())) < 100_000
    assert dims.state_centroids(spark).count() == 61


def test_raw_defects_match_their_rules(spark, small):
    raw = W.raw_order_lines(spark, small)
    orders = W.table(spark, small, "orders").count()
    assert raw.where(clean.is_header()).count() == len(range(0, orders, 1000))
    assert clean.rejected_rows(clean.type_orders(clean.dedup_orders(raw))).count() > 0


def test_audit_and_cleaning_share_collapsed_rows(spark, small):
    """Copies collapse once: the typed rows give the cleaned lines and, by their columns in TYPED, the audit."""
    from haulmark.operators import audit, clean
    raw = W.raw_order_lines(spark, small)
    typed = audit.typed_rows(raw)
    a, b = [sorted(map(str, f.select("row_id", "state", "lead_time_days", "cost_imputed", "product_name",
                                     *clean.FINANCE).collect()))
            for f in (audit.finished_rows(typed), clean.clean_orders(raw))]
    assert a == b and len(a) > 5000
    assert not {*audit.TYPED} - {*typed.columns}
