from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from haulmark.llm import filter_audit


def brute(rows, letters):
    """rows: (part, set of failed letters, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in permutations(letters):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before = set(order[:step - 1])
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[1] and bool(before & r[1]) for r in mine),
                    sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[f] += len(gone)
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("letters", ["A", "PQR", "ABCDE"])
def test_audit_equals_walking_every_order(spark, letters):
    rows = [(f"s{i % 3}", {x for k, x in enumerate(letters) if (i * 7 + i // 5) >> k & 1 and i % 4},
             i % 5 == 0, i % 7 == 0) for i in range(200)]
    frame = spark.createDataFrame(
        [(p, sum(1 << letters.index(x) for x in fails), good, toxic) for p, fails, good, toxic in rows],
        "part string, mask int, good boolean, toxic boolean")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:]
           for r in filter_audit.audit(filter_audit.cells(frame), letters).collect()}
    assert got == brute(rows, letters)


def test_shapley_shares_sum_to_all_removed(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    out = filter_audit.audit_documents(docs, labels)
    rows = out.groupBy("part", "filter_order").agg(
        F.sum("removed").alias("removed"), F.min("kept").alias("kept"),
        F.sum("shapley").alias("shapley")).collect()
    sizes = {r["source"] or "": r["count"] for r in docs.groupBy("source").count().collect()}
    assert len(rows) == 120 * len(sizes)
    for r in rows:
        assert r["removed"] + r["kept"] == sizes[r["part"]]
        assert r["shapley"] == 120 * r["removed"]


def test_text_failures(spark):
    texts = ["", None, "a " * 200, " ".join(f"w{i}" for i in range(200)), "AB" + "c" * 98,
             "ABC" + "c" * 97, "a # b", "x\x0by\x1cz", "é" * 50 + "A"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r for r in frame.select(
        "id", *[c.alias(k) for k, c in filter_audit.text_failures().items()]).collect()}
    fails = ["".join(k for k in "ABCD" if got[i][k]) for i in range(len(texts))]
    assert fails == ["A", "A", "B", "", "A", "AC", "AD", "A", "A"]


def test_odd_rows(spark, odd_rows):
    docs = odd_rows
    for name in ("part", "mask", "digest", "fails", "good", "_first_id", "repeated", "labelled"):
        docs = docs.withColumn(name, F.lit("x"))
    labels = spark.createDataFrame(
        [(4, 1, None), (4, None, 1), (None, 1, 1), (6, 0, 0), (99, 1, 1)],
        "doc_id bigint, quality int, toxic int")
    out = filter_audit.audit_documents(docs, labels)
    parts = Counter(r["source"] or "" for r in odd_rows.collect())
    assert out.count() == 600 * len(parts)
    last = out.where("filter_order = 'EDCBA'")
    assert {r["part"]: r["kept"] + r["removed"] for r in last.where("step = 1").collect()} == parts
    # ids 2 and 7 repeat a text (null is the empty text), the two rows without id do not
    removed = {r["part"]: r["removed"] for r in last.where("step = 1").collect()}
    assert {p: n for p, n in removed.items() if n} == {"a": 1, "": 1}
    b = last.where("part = 'b' and step = 5").first()
    assert b["good_lost"] + b["toxic_lost"] == 2
    assert filter_audit.audit_documents(docs.limit(0), labels).count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit(filter_audit.cells(spark.createDataFrame(
            [], "part string, mask int, good boolean, toxic boolean")), "AA")
