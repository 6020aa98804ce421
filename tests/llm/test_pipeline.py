from collections import Counter

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from haulmark.llm import line_dedup, mixing, packing, quality, simhash
from haulmark.llm.queries import mix_items, mixed
from haulmark.session import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small):
    """Input and output rows of every stage over the smallest table."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], small), "stage"))
    return out


def test_columns(stages):
    assert all(f.columns == COLUMNS for f in stages[:-1])


def test_quality_keeps_what_passes(stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    for r in stages[0].collect():
        m = quality.measure(r["text"])
        assert (r["doc_id"] in kept) == (m[0] >= 10 and 100 * m[4] <= 20 * m[0])


def test_lines_are_gone(stages):
    before = {r["doc_id"]: r for r in stages[1].collect()}
    want = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(stages[1]).collect()}
    after = stages[2].collect()
    assert {r["doc_id"]: r["text"] for r in after} == want
    for r in after:
        held = before[r["doc_id"]]
        assert r["n_chars"] == (len(r["text"]) if r["text"] != held["text"] else held["n_chars"])


def test_one_document_of_each_component_stays(stages):
    groups = {r["doc_id"]: r["component_id"]
              for r in simhash.deduplicated(stages[2]).collect()}
    kept = Counter(r["doc_id"] for r in stages[3].collect())
    assert kept == Counter(set(groups.values()))


def test_mix_repeats_and_drops(stages):
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixed(mix_items(stages[3])).collect()}
    copies = Counter(r["doc_id"] for r in stages[4].collect())
    for doc_id, (n, size) in taken.items():
        assert copies[doc_id] == (-(-n // size) if size else 0)


def test_packing_covers_every_copy(stages):
    rows = stages[4].groupBy("doc_id").count().collect()
    copies = {r["doc_id"]: r["count"] for r in rows}
    pieces = stages[5].groupBy("doc_id").agg(
        F.sum("length").alias("n"), F.max("doc_tokens").alias("one")).collect()
    assert {r["doc_id"]: r["n"] / r["one"] for r in pieces} == copies
    full = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.agg(F.max("n")).first()[0] <= packing.LENGTH


def test_run_equals_the_stages(spark, small, stages):
    got = Counter(map(tuple, pipeline.run(spark, small).drop("sequence_id", "offset").collect()))
    assert got == Counter(map(tuple, stages[5].drop("sequence_id", "offset").collect()))


CLASHING = ("_key", "_measures", "_host", "_copies", "_copy", "_gone", "_k", "_m", "_bad_host", "row",
            "doc_key", "copy", "gone", "check", "host", "failed", "group", "offset", "until", "range")


@pytest.mark.parametrize("k", range(4))
def test_clashing_columns_pass_through(spark, odd_rows, small, k):
    """Columns named like internal ones come out of each stage as they went in."""
    docs = odd_rows.where("length(text) < 1000 or text is null")
    for name in CLASHING:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} "), F.coalesce("doc_id", F.lit(0))))
    out = pipeline.STAGES[k][1](spark, docs, small)
    assert out.columns == docs.columns
    for r in out.collect():
        assert all(r[name] == f"{name} {r['doc_id'] or 0}" for name in CLASHING)


def test_odd_rows_pass_every_stage(spark, odd_rows, small):
    docs = odd_rows
    for name, stage in pipeline.STAGES[1:]:  # the first drops most of them
        docs = staged(stage(spark, docs, small), "odd")
    assert docs.count() > 0
    assert staged(pipeline.quality_rules(spark, odd_rows, small), "odd").columns == odd_rows.columns
    docs = odd_rows.limit(0)
    for name, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, small), "none")
        assert docs.count() == 0


def test_equal_rows_are_one_document(spark, odd_rows, small):
    kept = pipeline.near_duplicates(spark, odd_rows, small).collect()
    assert sum(r["doc_id"] is None for r in kept) == 1
    assert sum(r["doc_id"] == 6 for r in kept) == 1
    mix = pipeline.source_mix(spark, odd_rows, small)
    want = mixed(mix_items(odd_rows)).agg(F.sum(mixing.copies(F.col("taken"), F.col("size"))))
    assert mix.count() == want.first()[0]


def test_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert names["pipeline"] is pipeline.run


def test_near_copies_equal_brute_force(spark, small):
    """One document stays of each component of pairs at a five-word Jaccard similarity of 0.8."""
    import random

    import numpy as np

    from haulmark.llm import components
    rnd = random.Random(6)
    texts = []
    for _ in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(3, 400))]
        for _ in range(4):
            copy = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 60))):
                copy[rnd.randrange(len(copy))] = rnd.choice(["other", "word"])
            texts.append(" ".join(copy))
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    labels = components.Labels(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                labels.merge(np.array([i]), np.array([j]))
    want = {i for i in range(len(sets)) if labels.root[i] == i}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r["doc_id"] for r in pipeline.near_duplicates(spark, frame, small).collect()]
    assert sorted(got) == sorted(want) and 60 <= len(want) < len(texts)
    keyed = frame.withColumn("k", F.xxhash64("doc_id", "text"))
    assert simhash.keepers(keyed, "k").count() > len(want)  # op3's rule keeps more


def test_near_dedup_takes_candidates_from_simhash(spark, small, monkeypatch):
    """Without bands, near copies within 4 bits go; of one group of all, those at Jaccard 0.8 alone."""
    import random

    from haulmark.llm import near_docs
    rnd = random.Random(8)
    texts = []
    for _ in range(40):
        words = [f"w{rnd.randrange(5000)}" for _ in range(400)]
        copy = list(words)
        copy[rnd.randrange(400)] = "other"
        texts += [" ".join(words), " ".join(copy)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

    def dropped():
        kept = pipeline.near_duplicates(spark, frame, small).collect()
        return set(range(len(texts))) - {r["doc_id"] for r in kept}

    prints = [simhash.majority(near_docs.shingle_hashes(t)) & (1 << 64) - 1 for t in texts]
    near = {i for i in range(1, len(texts), 2) if (prints[i] ^ prints[i - 1]).bit_count() <= 4}
    assert 10 < len(near) < 40
    original = near_docs.band_buckets
    monkeypatch.setattr(near_docs, "band_buckets", lambda nodes: original(nodes).limit(0))
    assert dropped() == near
    monkeypatch.setattr(near_docs, "simhash_groups",
                        lambda nodes: nodes.select(F.lit(1).cast("bigint").alias("bucket"), "node"))
    assert dropped() == set(range(1, len(texts), 2))


def test_texts_are_fetched_for_candidates_alone(spark):
    from haulmark.llm import near_docs
    from haulmark.llm.text import row_key
    docs = spark.range(5000).select(row_key("id", F.lit("x")).alias("key"), "id")
    wanted = docs.where("id % 500 = 7")
    found = {r["id"] for r in near_docs._among(docs, wanted).collect()}
    assert {r["id"] for r in wanted.collect()} <= found and len(found) < 50
    assert near_docs._among(docs, wanted.limit(0)).count() == 0


def test_texts_reach_python_in_small_batches(spark):
    from haulmark.session import TEXT_ROWS, staged_texts
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    frame = spark.range(2500, numPartitions=1).mapInArrow(sizes, "n bigint")
    found = [r["n"] for r in staged_texts(frame, "sizes").collect()]
    assert sum(found) == 2500 and max(found) <= TEXT_ROWS and spark.conf.get(key) == before
