import hashlib

import pytest
from pyspark.sql import functions as F

from haulmark.llm import order_minhash as om
from haulmark.llm.queries import QUERIES


def signatures(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string")
    found = om.signed(frame).collect()
    return [r["sig"] for r in sorted(found, key=lambda r: r["i"])]


def likeness(spark, a, b):
    frame = om.signed(spark.createDataFrame([(a, b)], "text string, other string"))
    frame = frame.withColumn("o", om.signature(F.col("other")))
    return frame.select(om.likeness(F.col("sig"), F.col("o")).alias("x")).first()["x"]


def test_query(spark, small, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op6_order_minhash"](spark, small).collect()}
    ids = sorted(documents, reverse=True)
    assert sorted(rows, reverse=True) == ids
    by_text = {}
    for i, doc_id in enumerate(ids):
        text = documents[doc_id]["text"]
        other = documents[ids[(i + 1) % len(ids)]]["text"]
        third = len(text) // 3
        edited = text[:len(text) - third] + other[:third]
        r = rows[doc_id]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len(set(by_text.values())) == len(by_text)
    mean = sum(r["near_edited"] for r in rows.values()) / len(rows)
    assert mean > 0.3 + sum(r["near_next"] for r in rows.values()) / len(rows)


def brute_tuples(spark, text):
    """The tuples' positions by a plain reading of the definition, from Spark's hashes alone."""
    words = text.split()
    grams = [tuple(words[i:i + om.K]) for i in range(max(1, len(words) - om.K + 1))]
    first = spark.createDataFrame([(list(g),) for g in grams], "g array<string>").select(
        F.xxhash64("g").alias("h")).collect()
    mask = (1 << om._HASH) - 1
    hashes = [r["h"] & mask for r in first]
    seen, numbered = {}, []
    for place, h in enumerate(hashes):
        n = seen[h] = seen.get(h, -1) + 1
        if n:
            h = spark.range(1).select(F.xxhash64(F.lit(h), F.lit(n)).alias("h")).first()["h"] & mask
        numbered.append((h, place))
    bins = {}
    for h, place in sorted(numbered):
        bins.setdefault(h * om.BINS >> om._HASH, []).append((place, h))
    return {b: [h for _, h in sorted(held[:om.L])] for b, held in bins.items()}


@pytest.mark.parametrize("text", ["one two", "a b c a b c a b c a b c d e f", " ".join(
    f"w{i * i % 31}" for i in range(60))])
def test_signature_follows_the_definition(spark, text):
    got = signatures(spark, [text])[0]
    want = brute_tuples(spark, text)
    assert [x >> 32 for x in got] == sorted(want)
    for x in got:
        digest = spark.range(1).select(F.xxhash64(F.array(*[
            F.lit(h).cast("bigint") for h in want[x >> 32]])).alias("h")).first()["h"]
        assert x & 0xFFFFFFFF == digest & 0xFFFFFFFF


def test_order_and_number_of_kmers_count(spark):
    words = [f"w{i}" for i in range(400)]
    blocks = [words[i:i + 40] for i in range(0, 400, 40)]
    moved = " ".join(w for b in reversed(blocks) for w in b)
    same = " ".join(words)
    # nearly the same k-mers, in another order
    assert likeness(spark, same, moved) < 0.85
    assert likeness(spark, same, same) == 1.0
    few = " ".join(["x y z"] * 5 + words[:50])
    many = " ".join(["x y z"] * 200 + words[:50])
    assert likeness(spark, few, many) < 0.6


def test_likeness_falls_with_edits(spark):
    words = [f"w{i}" for i in range(1500)]
    values = []
    for every in (300, 60, 20, 6):
        edited = [("e" if i % every == 0 else "") + w for i, w in enumerate(words)]
        values.append(likeness(spark, " ".join(words), " ".join(edited)))
    assert values == sorted(values, reverse=True) and values[0] > 0.9 and values[-1] < 0.6


@pytest.mark.parametrize("ids", [[5], [3, 1], list(range(0, 9000, 1000)) + [10**15],
                                 [-(1 << 62), -4, -3, 0, 2, 1 << 62], [None, 4, 9]])
def test_neighbours_follow_descending_ids(spark, ids):
    frame = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id bigint, text string")
    for width in (1, 1000, om.range_width(frame)):
        rows = om.with_next(frame, width).collect()
        order = sorted(ids, key=lambda i: (i is None, -(i or 0)))
        following = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
        assert {r["doc_id"]: r["next"]["text"] for r in rows} == {
            i: f"text of {following[i]}" for i in ids}


def test_odd_rows(spark, odd_rows):
    docs = odd_rows.select("doc_id", om.text_of("text").alias("text"))
    rows = om.with_edit(om.with_next(docs, om.range_width(docs))).collect()
    assert len(rows) == odd_rows.count()
    assert all(r["sig"] == [] for r in rows if r["doc_id"] in (1, 2, 3))
    assert likeness(spark, "", " ") == 1.0
    assert om.with_next(docs.limit(0), om.range_width(docs.limit(0))).count() == 0
