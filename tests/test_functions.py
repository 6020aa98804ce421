import datetime as dt
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from haulmark.functions import text
from haulmark.functions.geo import haversine_km
from haulmark.functions.portable import fold, is_holdout, uniform, with_hash_index
from haulmark.functions.quantiles import exact_quantiles, histogram_quantiles
from haulmark.operators.stats import normal_two_sided

# Published distances in kilometres.
PINNED = [((32.076176, -81.088371), (31.054487, -97.563461), 1563.507495),
          ((48.119140, -96.181115), (40.349457, -88.986137), 1035.785914),
          ((35.117500, -89.971107), (33.729759, -111.431221), 1970.602898)]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("a,b,km", PINNED)
def test_pinned_distances(spark, a, b, km):
    got = one(spark, haversine_km(F.lit(a[0]), F.lit(a[1]), F.lit(b[0]), F.lit(b[1])))[0]
    assert abs(got - km) < 1e-6


def test_distance_edges(spark):
    same = haversine_km(F.lit(10.0), F.lit(20.0), F.lit(10.0), F.lit(20.0))
    far = haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))
    none = haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    row = one(spark, same, far, none)
    assert row[0] == 0.0 and abs(row[1] - np.pi * 6371.0088) < 1e-6 and row[2] is None


def test_product_names(spark):
    names = ["Brand -7", "Brand - 7", "Brand-7", "  Plain  ", "A -B- C"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(text.normalize_product_name(F.col("n"))).collect()]
    assert got == ["Brand - 7"] * 3 + ["Plain", "A - B - C"]


def test_parsing(spark):
    df = spark.createDataFrame([("31-02-1998", "abc"), ("28-02-1998", " 1.5 "), (None, "NaN"),
                                ("1998-02-28", "Infinity")], "d string, n string")
    rows = df.select(text.parse_date(F.col("d")), text.parse_number(F.col("n"))).collect()
    assert [r[0] for r in rows] == [None, dt.date(1998, 2, 28), None, None]
    assert [r[1] for r in rows] == [None, 1.5, None, None]
    with pytest.raises(PySparkException):
        df.select(text.parse_date(F.col("d"), strict=True)).collect()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Australia/Sydney", "Asia/Kolkata"])
def test_calendar_days_in_four_zones(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # Instants given with an offset; the span crosses daylight-saving changes.
        df = spark.sql("SELECT timestamp'2024-01-15 00:00:00Z' AS a, "
                       "timestamp'2027-07-07 00:00:00Z' AS b")
        assert df.select(text.calendar_days(F.col("a"), F.col("b"))).first()[0] == 1269
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_canadian(spark):
    row = one(spark, text.is_canadian(F.lit("Ontario")), text.is_canadian(F.lit("Ohio")),
              text.is_canadian(F.lit(None).cast("string")))
    assert list(row) == [True, False, False]


def test_uniform_is_portable_and_even(spark):
    def python(a, b):
        m = 2147483647
        x = ((a % m) * 48271 + (b % m) * 69621 + 42) % m
        return x * 48271 % m * 48271 % m / m

    df = spark.range(2000).withColumn("u", uniform(F.col("id"), F.col("id") * 3))
    rows = df.collect()
    assert all(r.u == python(r.id, r.id * 3) for r in rows)
    shares = df.select(F.avg(is_holdout(F.col("id")).cast("int")),
                       F.count_distinct(fold(F.col("id")))).first()
    assert 0.15 < shares[0] < 0.25 and shares[1] == 5


def test_hash_index_is_a_permutation_whatever_the_layout(spark):
    df = spark.range(5000).withColumn("k", F.concat(F.lit("p"), F.col("id")))
    a = {r.k: r.i for r in with_hash_index(df.repartition(1), F.col("k"), "i").collect()}
    b = {r.k: r.i for r in with_hash_index(df.repartition(16), F.col("k"), "i").collect()}
    assert a == b and sorted(a.values()) == list(range(5000))
    import hashlib
    order = sorted(a, key=lambda k: hashlib.md5(k.encode()).hexdigest())
    assert [a[k] for k in order] == list(range(5000))


@pytest.mark.parametrize("kind", ["smooth", "hot", "tied", "tails", "tiny"])
def test_exact_quantiles(spark, kind):
    rng = random.Random(1)
    n = 7 if kind == "tiny" else 30000
    values = {"smooth": lambda i: rng.random(), "hot": lambda i: 5.0 if i % 3 else rng.random() * 10,
              "tied": lambda i: float(i % 4), "tails": lambda i: rng.lognormvariate(0, 6),
              "tiny": lambda i: float(i * i)}[kind]
    data = [values(i) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in data] + [(None,)], "v double").repartition(4)
    probs = [0, 0.01, 0.25, 0.5, 0.75, 0.999, 1]
    got = {r.prob: r.quantile for r in exact_quantiles(df, ["v"], probs).collect()}
    want = np.quantile(data, probs)
    for p, w in zip(probs, want):
        assert got[p] == pytest.approx(w, rel=1e-12, abs=1e-12)


def test_histogram_quantiles(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 10), ("b", None), ("b", 4)],
                               "k string, v int")
    got = {r.k: r.quantiles for r in histogram_quantiles(df, ["k"], "v", [0.5, 0.9]).collect()}
    assert got["a"] == pytest.approx([2.0, 8.4]) and got["b"] == [4.0, 4.0]


def test_normal_tail(spark):
    row = one(spark, normal_two_sided(F.lit(1.959963985)), normal_two_sided(F.lit(0.0)))
    assert row[0] == pytest.approx(0.05, abs=1e-6) and row[1] == pytest.approx(1.0, abs=1e-6)
