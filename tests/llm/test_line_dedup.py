import random
from collections import defaultdict

import numpy as np
import pytest

from haulmark.llm import components, line_dedup
from haulmark.llm.queries import QUERIES


def jaccard(a, b):
    x, y = line_dedup.shingles(a), line_dedup.shingles(b)
    return len(x & y) / len(x | y)


def brute(docs):
    """{(doc_id, line number)} dropped, from all pairs of distinct lines that share a shingle."""
    places = defaultdict(list)
    for doc_id, text in docs.items():
        for number, line in enumerate((text or "").split("\n")):
            if line.strip():
                places[line.strip()].append((doc_id, number))
    lines = list(places)
    by_shingle = defaultdict(list)
    sets = [line_dedup.shingles(line) for line in lines]
    for i, s in enumerate(sets):
        for x in s:
            by_shingle[x].append(i)
    labels = components.Labels(len(lines))
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in by_shingle[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                labels.merge(np.array([i]), np.array([j]))
    groups = defaultdict(list)
    for i, line in enumerate(lines):
        groups[labels.root[i]] += places[line]
    return {p for g in groups.values() for p in sorted(g)[1:]}


def cleaned(docs, dropped):
    return {i: t if t is None else "\n".join(
        line for n, line in enumerate(t.split("\n")) if (i, n) not in dropped)
        for i, t in docs.items()}


def test_query_equals_brute_force(spark, small, documents):
    texts = {i: r["text"] for i, r in documents.items()}
    dropped = brute(texts)
    rows = {r["doc_id"]: r for r in QUERIES["op7_line_dedup"](spark, small).collect()}
    want = cleaned(texts, dropped)
    assert {i: r["text"] for i, r in rows.items()} == want
    assert sum(r["n_dropped_lines"] for r in rows.values()) == len(dropped) > 0


def near_lines(seed, groups=60, size=8):
    rnd = random.Random(seed)
    out = []
    for _ in range(groups):
        words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9)))
                 for _ in range(rnd.randint(8, 60))]
        for _ in range(size):
            copy = list(words)
            for _ in range(rnd.choice([0, 1, 1, 2])):
                copy[rnd.randrange(len(copy))] = rnd.choice(["other", "word", "zz"])
            out.append(" ".join(copy))
    return out


def test_banding_recall():
    """Nearly all pairs with a similarity of 0.8 or more share a band."""
    lines = near_lines(1, 200, 2)
    keys = line_dedup.bands(lines)
    pairs = [(i, i + 1) for i in range(0, len(lines), 2)
             if 0.8 <= jaccard(lines[i], lines[i + 1]) < 1]
    found = sum(bool((keys[i] == keys[j]).any()) for i, j in pairs)
    assert len(pairs) > 50 and found >= 0.97 * len(pairs)


@pytest.mark.parametrize("block", [4096, 8])
def test_near_lines_in_cells_of_any_size(spark, block, monkeypatch):
    """Components from one cell or many hold every brute-force link that banding finds."""
    original = components.cells
    monkeypatch.setattr(line_dedup, "cells", lambda m, s: original(m, s, block))
    lines = near_lines(2)
    docs = {i: line for i, line in enumerate(lines)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {(r["doc_id"], r["line"]) for r in line_dedup.dropped_lines(frame).collect()}
    want = brute(docs)
    assert got <= want and len(got) >= 0.98 * len(want)


def test_chain_across_a_bucket_is_linked_in_the_second_round():
    """Lines of a cell that are no neighbours of its first line still find each other."""
    import pyarrow as pa
    base = [f"{w}word{i}" for i, w in enumerate("abcdefghijklmnop")]
    a, b = " ".join(base), " ".join(base[:-1] + ["changed"])
    far = "nothing in common with the other two lines at all"
    batch = pa.record_batch({"cell": pa.array([1, 1, 1]), "node": pa.array([1, 2, 3]),
                             "root": pa.array([1, 2, 3]), "line": pa.array([far, a, b])})
    out = [p for r in line_dedup._verify_cells(iter([batch])) for p in zip(*r.to_pydict().values())]
    assert [tuple(sorted(p)) for p in out] == [(2, 3)]


def test_odd_rows(spark, odd_rows):
    out = line_dedup.deduplicated(odd_rows)
    rows = out.collect()
    assert len(rows) == odd_rows.count() and set(odd_rows.columns) < set(out.columns)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert by_id[1][0]["text"] is None and by_id[2][0]["text"] == ""
    assert by_id[7][0]["text"] == "" and by_id[7][0]["n_dropped_lines"] == 2
    assert all("\n" in r["text"] and not r["n_dropped_lines"] for r in by_id[6])
    assert line_dedup.deduplicated(odd_rows.limit(0)).count() == 0


def test_short_lines_take_part(spark):
    """Lines of few words, and of scripts without spaces, are dropped when they repeat."""
    near = "one-long-word-of-many-characters-that-only-ends-"
    texts = ["}", "Home\nAbout us", "About us\n\n}", "漢字のみの行で空白がありません", "x\n漢字のみの行で空白がありません",
             near + "so", near + "as", "Homes"]
    rows = line_dedup.deduplicated(spark.createDataFrame(
        list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == dict(enumerate(
        ["}", "Home\nAbout us", "", "漢字のみの行で空白がありません", "x", near + "so", "", "Homes"]))
    assert sum(r["n_dropped_lines"] for r in rows) == 4


@pytest.mark.parametrize("shingles", [9, 18, 45, 900])
def test_no_similar_pair_fails_the_bound(shingles):
    """All pairs at 0.8 that share a band are linked, on lines of few shingles too."""
    import pyarrow as pa
    rnd = random.Random(3)
    changed = shingles // 9
    lines = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=shingles + 7))
             for _ in range(2000)]
    others = [a[:-changed] + "".join(rnd.choices("0123456789", k=changed)) for a in lines]
    assert all(line_dedup.similar(line_dedup.shingles(a), line_dedup.shingles(b))
               for a, b in zip(lines, others))
    n = list(range(len(lines)))
    batch = pa.record_batch({"a": n, "b": [i + len(n) for i in n], "x": lines, "y": others})
    assert sum(r.num_rows for r in line_dedup._verify(iter([batch]))) == len(n)
    cells = pa.record_batch({"cell": sorted(n + n), "node": [x for i in n for x in (i, i + len(n))],
                             "root": [x for i in n for x in (i, i + len(n))],
                             "line": [x for p in zip(lines, others) for x in p]})
    assert sum(r.num_rows for r in line_dedup._verify_cells(iter([cells]))) == len(n)


def test_large_bucket_of_one_document_is_cut(spark, monkeypatch):
    """A bucket that a single document feeds is seen and dealt into cells of bounded size."""
    from pyspark.sql import functions as F
    original, largest = components.cells, []

    def cut(members, sample):
        out = original(members, sample, 64)
        largest.append(out.groupBy("cell").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(line_dedup, "cells", cut)
    rnd = random.Random(4)
    docs = []
    for i in range(3):
        start = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=400))
        docs.append((i, "\n".join(f"{start} {n}" for n in range(1000))))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert line_dedup.dropped_lines(frame).count() == 3 * 999
    assert largest[0] < 400


def test_sketches_do_not_depend_on_the_batch():
    """Contents of different slices are compared by their sketches."""
    lines = near_lines(9, 30, 3)
    whole = line_dedup.sketched(*line_dedup._line_hashes(lines))
    one_by_one = np.concatenate([line_dedup.sketched(*line_dedup._line_hashes([x])) for x in lines])
    assert (whole == one_by_one).all()
    sets = [line_dedup.shingles(x) for x in lines]
    assert whole[:, -1].tolist() == [len(s) for s in sets]


@pytest.mark.parametrize("shingles", [9, 18, 45])
def test_banding_recall_of_short_lines(shingles):
    """Pairs exactly at 0.8, of few shingles, share a band but for a fraction of a percent."""
    rnd = random.Random(shingles)
    a = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=shingles + 7)) for _ in range(4000)]
    b = [x[:-(shingles // 9)] + "".join(rnd.choices("0123456789", k=shingles // 9)) for x in a]
    found = (line_dedup.bands(a) == line_dedup.bands(b)).any(1)
    assert found.mean() >= 0.995


def test_colliding_ids_drop_nothing_that_does_not_repeat(spark, monkeypatch):
    """Lines that share 64 bits of their name but not 128 are copies of their own kind only."""
    original = line_dedup.xxhash.xxh3_128_digest

    class Colliding:
        xxh3_128_digest = staticmethod(lambda x: original(x)[:8] + bytes(8))

    texts = ["first line of its own kind here", "another line that is quite different",
             "first line of its own kind here", "a third one, again with other words"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    keyed = frame.selectExpr("doc_id", "named_struct('hi', doc_id, 'lo', doc_id) as key", "text")
    monkeypatch.setattr(line_dedup, "xxhash", Colliding)
    batch = next(line_dedup._occurrences(iter(keyed.toArrow().to_batches())))
    assert set(batch.column(3).to_pylist()) == {0}
    assert len(set(batch.column(4).to_pylist())) == 3
    found = spark.createDataFrame([(0, c) for c in set(batch.column(4).to_pylist())],
                                  "node bigint, check bigint")
    links = spark.createDataFrame([(0, 5)], "a bigint, b bigint")
    compared = found.limit(1).unionByName(spark.createDataFrame([(5, 9)], found.schema))
    members = line_dedup.members_of(links, compared)
    assert found.join(members, ["node", "check"], "left_semi").count() == 1


def test_sketches_reject_most_pairs_below_the_bound():
    """Of long lines at 0.74 nearly all pairs fail by their sketches, at 0.81 none."""
    rnd = random.Random(12)
    for changed, passing in ((52, 0.1), (70, 0.01)):
        a = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=357)) for _ in range(300)]
        b = [x[:-changed] + "".join(rnd.choices("0123456789", k=changed)) for x in a]
        drawn = [line_dedup.sketched(*line_dedup._line_hashes(x)) for x in (a, b)]
        assert line_dedup.possible(*drawn).mean() <= passing
    b = [x[:-36] + "".join(rnd.choices("0123456789", k=36)) for x in a]
    assert min(map(jaccard, a, b)) >= 0.8
    drawn = [line_dedup.sketched(*line_dedup._line_hashes(x)) for x in (a, b)]
    assert line_dedup.possible(*drawn).all()


def test_occurrences_hold_the_bands_of_a_sample():
    """One line in 16 by name has its band keys in one of its rows, read in the same pass."""
    import pyarrow as pa
    lines = near_lines(11)
    texts = ["\n".join(lines[i:i + 7]) for i in range(0, len(lines), 7)] + [None, "", " \n"]
    batch = pa.record_batch({"doc_id": range(len(texts)), "key": range(len(texts)),
                             "text": texts})
    rows = [r for b in line_dedup._occurrences(iter([batch, batch])) for r in b.to_pylist()]
    assert len(rows) == 2 * len(lines)
    want = {}
    for line in lines:
        _, _, name = next(line_dedup.lines_of(line))
        if name[-1] % components.SAMPLE == 0:
            want[line_dedup.halves([name])[0][0]] = line_dedup.bands([line])[0].tolist()
    held = [(r["node"], r["buckets"]) for r in rows if r["buckets"]]
    assert len(held) == len(want) > 10 and dict(held) == want
    none = pa.record_batch({"doc_id": [1], "key": [1], "text": pa.array([None], pa.string())})
    assert [b.num_rows for b in line_dedup._occurrences(iter([none]))] == [0]


def test_rows_alone_in_their_cell_are_left_out():
    import pyarrow as pa
    for cell, node in (([], []), ([5], [1]), ([7, 5, 7, 9, 5, 5], [1, 2, 3, 4, 6, 2]), ([1, 2], [3, 3])):
        batch = pa.record_batch([pa.array(cell, pa.int64()), pa.array(node, pa.int64())],
                                names=["cell", "node"])
        got = [tuple(r.values()) for b in line_dedup.candidates(iter([batch])) for r in b.to_pylist()]
        assert got == ([(5, 2, 2), (5, 6, 2), (7, 1, 1), (7, 3, 1)] if len(cell) == 6 else [])
        values = components.sorted_cells(iter([batch]))[0].tolist()
        assert values == ([1, 2, 3, 6] if len(cell) == 6 else [])
