import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from haulmark.llm import components, simhash
from haulmark.llm.queries import QUERIES


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def brute_components(ids, prints):
    values, at = np.unique(np.array(prints, np.uint64), return_inverse=True)
    labels = components.Labels(len(values))
    for i in range(len(values)):
        near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4)
        labels.merge(np.full(len(near), i), near)
    least = {}
    for i, a in zip(ids, at):
        root = labels.root[a]
        least[root] = min(least.get(root, i), i)
    return [least[labels.root[a]] for a in at]


def test_golay_code_is_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    index = simhash.decode(words)
    assert index.max() < 4096
    # a codeword is the word that decodes without an error; every word is within 3 bits of one
    codewords = words ^ simhash._leaders()[simhash._syndrome(words)]
    assert (simhash._syndrome(codewords) == 0).all()
    assert (np.bitwise_count(codewords ^ words) <= 3).all()


def test_no_link_is_missed_by_the_buckets():
    rng = np.random.default_rng(2)
    base = rng.integers(-2**63, 2**63 - 1, 4000, dtype=np.int64)
    other = base.view(np.uint64).copy()
    for i in range(len(other)):
        for bit in rng.choice(64, i % 5, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(bit)
    sets = []
    for prints in (base, other.view(np.int64)):
        at, bucket = simhash.buckets(prints)
        sets.append([set() for _ in prints])
        for i, b in zip(at, bucket):
            sets[-1][i].add(b)
    assert all(a & b for a, b in zip(*sets))


def test_query_equals_brute_force(spark, small, documents):
    rows = QUERIES["op3_simhash"](spark, small).collect()
    assert len(rows) == len(documents)
    prints = [brute_fingerprint(documents[r["doc_id"]]["text"]) for r in rows]
    assert [int(r["fingerprint"], 16) for r in rows] == prints
    assert [r["component_id"] for r in rows] == brute_components(
        [r["doc_id"] for r in rows], prints)


@pytest.mark.parametrize("block", [4096, 16])
def test_dense_groups_in_cells_of_any_size(spark, block):
    """A dense ball of fingerprints, compared in one cell or in many, gives the same components."""
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 12).astype(np.uint64)
    prints = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))
              for c in centre for _ in range(60)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "node bigint").distinct()
    schema = "bucket bigint, node bigint"
    members = frame.mapInArrow(simhash._members, schema)
    sample = frame.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(components.SAMPLE)) == 0
                         ).mapInArrow(simhash._members, schema)
    links = components.linked_in_cells(components.cells(members, sample, block), simhash.near)
    root = {r["node"]: r["root"] for r in components.connected(links).collect()}
    groups = {}
    for i, c in enumerate(brute_components(range(len(prints)), prints)):
        groups.setdefault(c, set()).add(root.get(signed[i], signed[i]))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 90)] + [(500, 500)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in components.connected(frame).collect()}
    assert {found[i] for i in range(100, 161)} == {100}
    assert {found[i] for i in range(7, 90)} == {7}
    assert components.connected(frame.limit(0)).count() == 0


def test_odd_rows(spark, odd_rows):
    rows = simhash.deduplicated(odd_rows).collect()
    assert len(rows) == odd_rows.count()
    empty = [r for r in rows if r["doc_id"] in (1, 2, 3)]
    assert {r["fingerprint"] for r in empty} == {"0" * 16}
    assert len({r["component_id"] for r in empty}) == 1
    assert {r["component_id"] for r in rows if r["doc_id"] in (6, 7)} == {6}
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    assert simhash.deduplicated(odd_rows.limit(0)).count() == 0
