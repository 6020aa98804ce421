from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from haulmark.llm import mixing
from haulmark.llm.queries import QUERIES, mix_items, mixed


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Water filling by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, budget, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        unit = budget / sum(w[s] for s in open_)
        full = {s for s in open_ if unit * w[s] > cap * sizes[s]}
        if not full:
            out |= {s: unit * w[s] for s in open_}
            break
        for s in full:
            out[s] = cap * sizes[s]
            budget -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5, None: 70}, {"a": 0, "b": 3}, {"a": 7}, {"a": 0},
    {f"s{i}": (i * 37) % 211 + 1 for i in range(40)}])
def test_targets_equal_resharing(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    assert got == pytest.approx(targets(sizes))


def test_query_meets_targets(spark, small, documents):
    rows = QUERIES["op1_source_mix"](spark, small).collect()
    assert len(rows) == len(documents)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        source = documents[r["doc_id"]]["source"]
        taken[source] += r["taken"]
        size[source] += r["size"]
        target[source] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert target == pytest.approx(targets(size), abs=1e-5)
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = QUERIES["op1_source_mix"](spark, small).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_order_is_that_of_the_keys_across_ranges(spark):
    """The prefix sums over ranges equal one ordered by key."""
    items = spark.range(500).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 7 + 1).alias("size"),
        ((F.col("id") % 5 + 1) / 5).alias("weight"))
    goal = spark.createDataFrame([("s", 1990, 700.0)], "source string, source_size bigint, "
                                                       "target double")
    rows = sorted(mixing.mix(items, goal).collect(), key=lambda r: r["key"])
    left = 700
    for r in rows:
        assert r["taken"] == min(left, r["size"])
        left -= r["taken"]


def test_heavier_documents_come_first(spark):
    items = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("size"),
        F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.1).alias("weight"))
    goal = spark.createDataFrame([("s", 4000, 1000.0)],
                                 "source string, source_size bigint, target double")
    taken = mixing.mix(items, goal).where("taken > 0")
    heavy = taken.where("doc_id % 2 = 0").count()
    assert taken.count() == 1000 and heavy > 800


def test_odd_rows(spark, odd_rows):
    rows = mixed(mix_items(odd_rows)).collect()
    assert len(rows) == odd_rows.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixed(mix_items(odd_rows.limit(0))).count() == 0
