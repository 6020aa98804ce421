"""SimHash near-duplicates by fuzzy hashing with a Golay code.

A fingerprint has 64 bits; texts link at ``MAX_DISTANCE`` (4) or fewer differing bits. The bits are cut
into three segments of 21, 21 and 22 bits, words of the binary Golay code of length 23 when padded.
That code is perfect: every word is within 3 bits of exactly one of 4096 codewords. A segment's keys
are the indices of the codewords to which it or a word one bit away decodes, one or six of them. Two
segments share a key if they differ in at most 2 bits, and if they differ in at most 1 bit, each
one's own index is among the other's keys.

Pigeonhole: with at most 4 differing bits over three segments, the two with the fewest hold at most 2.
So they differ in (0, 0..2) bits or in (1, 1). Buckets therefore join the exact bits of one segment with
a key of another, for every ordered pair, or one segment's own index with a key of the other, for every
unordered pair. No link is lost, and every candidate is verified on all 64 bits.

Copies share a fingerprint and are reduced before anything is compared; buckets of any size are compared
in cells of bounded size; components are found by distributed star steps.

Defined results: a null or empty text, or one without words, has fingerprint 0 and links like any
other. Rows that repeat an id each get a row. A component is named by its smallest id; one with no id
but null has a null name. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.components import SAMPLE, cells, connected, linked_in_cells
from haulmark.session import staged

SHINGLE = 4
SEED = 42
MAX_DISTANCE = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit and bits
MEMBERS = 2048  # fingerprints whose buckets, about 64 each, are one batch
GENERATOR = 0b101011100011  # fixed value: generator polynomial of the binary Golay code


def fingerprint(text: str | None) -> int:
    """SimHash of the word shingles, each as often as it occurs."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()][:max(1, len(words) - SHINGLE + 1)]
    stops = (ends[min(SHINGLE, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


@lru_cache(maxsize=1)
def _leaders() -> np.ndarray:
    """The error pattern of at most 3 bits for each of the 2048 syndromes."""
    patterns = [0] + [sum(1 << i for i in c) for n in (1, 2, 3) for c in combinations(range(23), n)]
    patterns = np.array(patterns, np.int64)
    table = np.zeros(2048, np.int64)
    table[_syndrome(patterns)] = patterns
    return table


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator polynomial."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where((rest >> bit) & 1, GENERATOR << (bit - 11), 0)
    return rest


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word; the code is systematic."""
    return (words ^ _leaders()[_syndrome(words)]) >> 11


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key): the distinct indices to which each word or a word one bit away decodes."""
    flips = np.concatenate([[0], 1 << np.arange(23, dtype=np.int64)])
    keys = decode((words[:, None] ^ flips[None, :]).ravel()).reshape(len(words), -1)
    keys.sort(axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(new)[0], keys[new]


def buckets(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket): every bucket of each 64-bit fingerprint."""
    bits = fingerprints.view(np.uint64)
    parts = [((bits >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64)
             for a, n in SEGMENTS]
    own = [decode(p) for p in parts]
    keys = [nearby(p) for p in parts]
    at, out = [], []
    family = 0
    for a, b in permutations(range(3), 2):  # exact bits of a, a key of b
        where, key = keys[b]
        at.append(where)
        out.append((family << 40) | (parts[a][where] << 12) | key)
        family += 1
    for a, b in combinations(range(3), 2):  # one's own index, a key of the other
        for x, y, shift_x, shift_y in ((a, b, 0, 12), (b, a, 12, 0)):
            where, key = keys[y]
            at.append(where)
            out.append((family << 40) | (own[x][where] << shift_x) | (key << shift_y))
        family += 1
    return np.concatenate(at), np.concatenate(out)


def fingerprints(docs: DataFrame, text: str = "text", into: str = "node") -> DataFrame:
    """``docs`` with the fingerprint as a signed long in place of the text."""
    @F.pandas_udf("bigint")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t) for t in batch], dtype="int64")

    return docs.withColumn(into, simhash(F.col(text)))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = batch.column(0).to_numpy()
        for start in range(0, len(node), MEMBERS):
            part = node[start:start + MEMBERS]
            at, bucket = buckets(part)
            yield pa.record_batch([pa.array(bucket), pa.array(part[at])], names=["bucket", "node"])


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_DISTANCE


def linked(nodes: DataFrame) -> DataFrame:
    """Links that join all fingerprints (``node``) within ``MAX_DISTANCE`` of each other."""
    distinct = staged(nodes.select("node").distinct(), "fingerprints")
    schema = "bucket bigint, node bigint"
    some = distinct.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SAMPLE)) == 0)
    return staged(linked_in_cells(cells(distinct.mapInArrow(_members, schema),
                                        some.mapInArrow(_members, schema)), near), "links")


def roots(rows: DataFrame) -> DataFrame:
    """(node, root): every fingerprint of ``rows`` (node) and the smallest one that it reaches."""
    nodes = rows.select("node").distinct()
    return nodes.join(connected(linked(rows)), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (doc_id, ``text``) with fingerprint and component_id, without the text."""
    rows = staged(fingerprints(docs.select("doc_id", text), text).drop(text), "simhash")
    named = staged(rows.groupBy("node").agg(F.min("doc_id").alias("id")).join(roots(rows), "node"),
                   "named")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    component = named.join(least, "root").select("node", "component_id")
    return rows.join(component, "node").select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def keepers(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The ``key`` of one row of ``docs`` (doc_id, ``text``) for each component: the smallest id, nulls
    last, then the smallest key."""
    rows = staged(fingerprints(docs.select("doc_id", key, text), text).drop(text), "simhash")
    best = F.struct(F.col("doc_id").isNull(), "doc_id", F.col(key).alias("key"))
    of_node = rows.groupBy("node").agg(F.min(best).alias("best"))
    chosen = of_node.join(roots(rows), "node").groupBy("root").agg(F.min("best").alias("best"))
    return chosen.select(F.col("best.key").alias(key))
