import hashlib
import re

import pytest
from pyspark.sql import functions as F

from haulmark.llm import decontamination as dec
from haulmark.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def windows_of(words, n=10):
    return [tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def brute(texts, items, n=10):
    """Per text (n_words, n_hit, sorted items)."""
    of = {}
    for item, text in items:
        for w in windows_of(words_of(text), n):
            of.setdefault(w, set()).add(item)
    out = []
    for text in texts:
        words, hit, found = words_of(text), set(), set()
        for size in {len(w) for w in of}:
            for i in range(len(words) - size + 1):
                if (w := tuple(words[i:i + size])) in of:
                    hit |= set(range(i, i + size))
                    found |= of[w]
        out.append((len(words), len(hit), sorted(found)))
    return out


def test_query_equals_brute_force(spark, small, documents):
    items = [(str(r["item_id"]), r["text"])
             for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in QUERIES["op13_decontamination"](spark, small).collect()}
    ids = sorted(documents)
    wanted = brute([documents[i]["text"] for i in ids], items)
    assert len(rows) == len(ids) and sum(n > 0 for _, n, _ in wanted) > 0
    for i, (n_words, n_hit, found) in zip(ids, wanted):
        r = rows[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n_words, n_hit, len(found))
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert r["contaminated"] == (n_hit > 0)


def frames(spark, texts, items):
    return (spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"),
            spark.createDataFrame(items, "item_id string, text string"))


PASSAGE = "the quick brown fox jumps over one lazy dog while seven grey cats watch it from a wall"


@pytest.mark.parametrize("window", [1, 4, 10])
def test_random_texts_of_few_words(spark, window):
    """Few distinct words: windows overlap themselves, anchors repeat, items share windows."""
    import random
    rng = random.Random(window)
    draw = lambda n: " ".join(rng.choice(["a", "B", "c,", "Å", "d-e"]) for _ in range(n))
    texts = [draw(rng.choice([0, 3, 9, 10, 11, 60])) for _ in range(60)] + [PASSAGE, PASSAGE.upper()]
    items = [(f"i{k % 15}", draw(rng.choice([0, 1, 5, 9, 10, 12, 14]))) for k in range(30)]
    items += [("p", "Seven grey CATS watch it; from a wall"), ("q", PASSAGE)]
    docs, bench = frames(spark, texts, items)
    got = {r["doc_id"]: r for r in dec.scan(docs, bench, window).collect()}
    for i, (n_words, n_hit, found) in enumerate(brute(texts, items, window)):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (n_words, n_hit, found)
        assert not set(got[i]["items"]) & set(got[i]["near_items"])


def test_proximity_matches(spark):
    words = PASSAGE.split()
    changed = words[:5] + ["under"] + words[6:]
    inserted = words[:8] + ["very", "old"] + words[8:]
    apart = words[:4] + ["x"] * 9 + words[4:8] + ["y"] * 9 + words[8:12]
    noise = [f"noise {i} {w}" for i, w in enumerate(words)]
    texts = [" ".join(x) for x in (words, changed[:10], inserted[:12], apart, words[::-1])] + noise
    docs, bench = frames(spark, texts, [("p", " ".join(words[:10]))])
    got = {r["doc_id"]: r for r in dec.scan(docs, bench).collect()}
    assert got[0]["items"] == ["p"] and got[0]["near_items"] == []
    assert got[2]["near_items"] == ["p"] and got[2]["n_hit"] == 0
    assert all(got[i]["items"] == [] for i in range(1, len(texts)))
    assert all(got[i]["near_items"] == [] for i in range(3, len(texts)))
    plain = {r["doc_id"]: r for r in dec.scan(docs, bench, slack=0).collect()}
    assert plain[0]["items"] == ["p"] and not any(r["near_items"] for r in plain.values())


def test_spans_of_matches(spark):
    docs, bench = frames(spark, ["x y " + PASSAGE + " z"] * 3, [("p", PASSAGE)])
    found, _ = dec.matches(docs, bench)
    starts = sorted(r["start"] for r in found.where("exact").collect())
    assert starts == list(range(2, 2 + len(PASSAGE.split()) - 9))  # equal texts are one


def test_no_python_in_the_plan(spark, small):
    plan = QUERIES["op13_decontamination"](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_odd_rows(spark, odd_rows):
    docs = odd_rows
    for name in ("win", "term", "text_key", "start", "items", "pos", "off"):
        docs = docs.withColumn(name, F.lit("x"))
    bench = spark.createDataFrame(
        [(None, "Same text here for two rows"), (None, "x"), (1, None), (2, ""), (3, "..."),
         (4, "word0x0"), (4, "word0x0"), (5, "漢字 и")], "item_id bigint, text string")
    bench = bench.withColumn("words", F.lit(1)).withColumn("n", F.lit(1))
    rows = dec.scan(docs, bench).collect()
    assert len(rows) == odd_rows.count()
    got = sorted((str(r["doc_id"]), r["n_hit"], ",".join(r["items"])) for r in rows if r["n_hit"])
    assert got == [("4", 1, "null"), ("5", 1, "4"), ("6", 6, "null"), ("6", 6, "null"),
                   ("7", 6, "null"), ("8", 2, "5")]
    assert dec.scan(docs.limit(0), bench).count() == 0
    assert dec.scan(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    with pytest.raises(ValueError):
        dec.matches(docs, bench, window=63)
