import re
from collections import Counter

from pyspark.sql import functions as F

from haulmark.llm import quality
from haulmark.llm.queries import QUERIES


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup,
            len(covered))


def test_measures_equal_brute_force(documents):
    texts = [r["text"] for r in documents.values()]
    texts += ["", None, "a", "a b c d e " * 40, "x\n\nx\n \nx\r\n", "1 2 3 4 5 6 1 2 3 4 5",
              "a a a a a", "a a a a a a", "\x0b\x0c\x1c\x85 　 #*"]
    for text in texts:
        assert quality.measure(text) == brute(text)


def test_query(spark, small, documents):
    rows = QUERIES["op4_quality_rules"](spark, small).collect()
    assert len(rows) == len(documents)
    for r in rows:
        n, chars, symbols, dup, repeat = brute(documents[r["doc_id"]]["text"])
        assert tuple(r)[1:6] == (n, chars, symbols, dup, repeat)
        failed = n < 10 or 100 * repeat > 20 * n
        assert r["base_failed"] == failed and r["kept"] == (not failed)


def test_host_verdicts_shrink_small_hosts(spark):
    """A host that mostly fails is rejected, one with the same rate but few documents not."""
    hosts = ([("bad", i % 7 != 0) for i in range(2000)] + [("tiny", True)] * 2
             + [("few", True)] * 8 + [("half", i % 2 == 0) for i in range(500)]
             + [(f"h{k}", i % (9 + k % 3) == 0) for k in range(19) for i in range(2000)]
             + [(None, i % 9 == 0) for i in range(90)])
    frame = spark.createDataFrame(hosts, "source string, failed boolean")
    rejected = {r["host"] for r in quality.rejected_hosts(frame, "source", "failed").collect()}
    assert rejected == {"bad"}
    judged = quality.verdicts(frame, "source", "failed")
    assert judged.count() == len(hosts)
    assert judged.where("source = 'bad' and kept").count() == 0
    assert judged.where("source is null and kept").count() == 80
    assert judged.where("source = 'half' and kept").count() == 250
    assert judged.where((F.col("source") == "tiny") & F.col("kept")).count() == 0  # failed itself


def test_alike_hosts_do_not_drown_a_bad_one(spark):
    """With thousands of alike hosts the prior stays weak enough for 300 documents to speak."""
    counts = [(f"h{k}", 1000, 88 + k % 5) for k in range(3000)] + [("bad", 300, 285), ("odd", 8, 8)]
    frame = spark.createDataFrame(counts, "source string, n int, k int").selectExpr(
        "source", "explode(transform(sequence(1, n), i -> i <= k)) as failed")
    rejected = [r["host"] for r in quality.rejected_hosts(frame, "source", "failed").collect()]
    assert rejected == ["bad"]


def test_a_planted_bad_host_loses_all_documents_in_the_query(spark, small, documents, tmp_path):
    """The query and the pipeline stage over the table with one more host, whose texts mostly repeat."""
    import corpus_pipeline
    docs = spark.read.parquet(f"{small}/documents.parquet")
    good = "every word of this other text stands here once and so nothing repeats at all today"
    bad = spark.range(300).select(
        (F.col("id") + 10_000_000).alias("doc_id"),
        F.when(F.col("id") % 8 == 0, F.lit(good)).otherwise("spam and eggs again now " * 9).alias("text"),
        F.lit("en").alias("lang"), F.lit("bad.example").alias("source"), F.lit(0).alias("n_chars"))
    docs.unionByName(bad).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op4_quality_rules"](spark, str(tmp_path)).collect()
    planted = [r for r in rows if r["doc_id"] >= 10_000_000]
    assert len(planted) == 300 and not any(r["kept"] for r in planted)
    assert sum(not r["base_failed"] for r in planted) == 38
    assert all(r["kept"] == (not r["base_failed"]) for r in rows if r["doc_id"] < 10_000_000)
    left = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "")
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in rows if r["kept"]}


def test_rate_is_the_beta_posterior_mean(spark):
    hosts = {"a": (50, 5), "b": (20, 19), "c": (400, 100), "d": (1, 1)}
    rows = [(h, i < k) for h, (n, k) in hosts.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "source string, failed boolean")
    for below in (0.5, 1.0):
        got = {r["host"]: (r["shrunk_rate"], r["lower_rate"]) for r in quality.rejected_hosts(
            frame, "source", "failed", -9.0, below).collect()}
        rates = [k / n for n, k in hosts.values() if k / n <= below]
        mean = sum(rates) / len(rates)
        spread = sum((r - mean) ** 2 for r in rates) / (len(rates) - 1)
        strength = max(mean * (1 - mean) / spread - 1, 1.0) if spread < mean * (1 - mean) else 1.0
        strength = min(strength, 100.0)
        for h, (n, k) in hosts.items():
            rate = (k + mean * strength) / (n + strength)
            assert abs(got[h][0] - rate) < 1e-9
            low = rate - 3 * (rate * (1 - rate) / (n + strength + 1)) ** 0.5
            assert abs(got[h][1] - low) < 1e-9


def test_odd_rows(spark, odd_rows):
    judged = quality.measured(odd_rows).withColumn(
        "failed", quality.base_failed(F.col("_m")))
    out = quality.verdicts(judged, "source", "failed")
    assert out.count() == odd_rows.count()
    assert out.where("doc_id = 1 and kept").count() == 0
    empty = quality.verdicts(judged.limit(0), "source", "failed")
    assert empty.count() == 0
