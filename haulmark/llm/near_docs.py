"""Near-duplicate documents: SimHash and MinHash bands over word shingles, exact Jaccard, union-find.

Documents link at a Jaccard similarity of 0.8 or more of their sets of ``SHINGLE``-word shingles; one of
fewer words is a shingle of its own. Shingles are 64-bit hashes of lower-cased words; documents with the
same set, told by 128 bits, are reduced to one before anything is compared. Candidates come from two sides:

* ``simhash``: sets whose 64-bit fingerprints link, directly or through others, at its ``MAX_DISTANCE`` of 4
  or fewer bits, found by its Golay keys.
* Bands: each set gets ``ROWS * BANDS`` independent MinHash values; sets that share one of ``BANDS`` bands
  are candidates, which a pair at 0.8 fails to be with a probability below 0.04 %. They bring the pairs
  that are farther apart: at 0.8 the fingerprints differ in about 10 bits, and keys for that radius hold
  most pairs.

Verification is that of ``line_dedup``: buckets of any size, the SimHash groups among them, are compared in
cells of bounded size, every link by the exact similarity. Fingerprints alone link nothing.

Defined results: a null or empty text, or one without words, has no shingles; all such are one component.
No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm import line_dedup, simhash
from haulmark.llm.components import SAMPLE, cells
from haulmark.session import staged, staged_texts

SHINGLE = 5
ROWS = 5
BANDS = 20
SEED = 42

_XOR, _FACTOR = np.random.default_rng(SEED).integers(0, 1 << 64, (2, ROWS * BANDS), np.uint64)
_FACTOR |= np.uint64(1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None) -> np.ndarray:
    """The distinct hashes of the word shingles, sorted."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()][:max(1, len(words) - SHINGLE + 1)]
    stops = (ends[min(SHINGLE, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The band keys of a set that is not empty."""
    least = np.full(ROWS * BANDS, _EMPTY)
    for at in range(0, len(hashes), 4096):
        part = (hashes[at:at + 4096, None] ^ _XOR) * _FACTOR
        least = np.minimum(least, part.min(0))
    table = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), i) for i, row in enumerate(table)],
                    np.uint64).view(np.int64)


def _node(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two longs."""
    bits = xxhash.xxh3_128_intdigest(hashes.tobytes(), SEED)
    return (bits & ((1 << 64) - 1)) - (1 << 63), (bits >> 64) - (1 << 63)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, keys, prints = [], [], []
        for text in batch.column(2):
            hashes = shingle_hashes(text.as_py())
            nodes.append(_node(hashes))
            keys.append(bands(hashes) if len(hashes) else [])
            prints.append(simhash.majority(hashes))
        halves = np.array(nodes, np.int64).reshape(-1, 2)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(halves[:, 0]),
                               pa.array(halves[:, 1]), pa.array(keys, pa.list_(pa.int64())),
                               pa.array(prints, pa.int64())],
                              names=["doc_id", "key", "node", "check", "buckets", "fingerprint"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(
            [shingle_hashes(t.as_py()).tobytes() for t in batch.column(2)], pa.binary())],
            names=["node", "check", "line"])


def _set_hashes(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(s) // 8 for s in sets], np.int64)
    return line_dedup.distinct(np.repeat(np.arange(len(sets), dtype=np.uint64), counts),
                               np.frombuffer(b"".join(sets), np.uint64), len(sets))


def _elements(held: bytes) -> set[int]:
    return set(np.frombuffer(held, np.uint64).tolist())


def simhash_groups(nodes: DataFrame) -> DataFrame:
    """(bucket, node): sets of ``nodes`` (node, fingerprint) in one SimHash component share a bucket."""
    groups = simhash.roots(nodes.select(F.col("fingerprint").alias("node"))).select(
        F.col("node").alias("fingerprint"), F.xxhash64(F.lit("simhash"), "root").alias("bucket"))
    return nodes.join(groups, "fingerprint").select("bucket", "node")


def band_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node): sets of ``nodes`` (node, buckets) with an equal band share a bucket."""
    return nodes.select(F.explode("buckets").alias("bucket"), "node")


def _among(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is one of ``keys``, and few others, by a filter of fixed size."""
    held = docs.sparkSession.sparkContext.broadcast(
        line_dedup.filter_of(keys.select(F.xxhash64("key").alias("node"))))

    @F.pandas_udf("boolean")
    def among(hashed: pd.Series) -> pd.Series:
        return pd.Series(line_dedup.may_hold(held.value, hashed.to_numpy()))

    return docs.where(among(F.xxhash64("key")))


def links(docs: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between the distinct sets of ``signed``, whose texts ``docs`` (key, text) holds, and
    (node, check) of the sets that were compared."""
    nodes = staged(signed.groupBy("node").agg(
        F.min_by(F.struct("check", "key", "buckets", "fingerprint"),
                 F.struct("check", "key")).alias("one"))
        .select("node", "one.*"), "nodes")
    near = staged(simhash_groups(nodes.where(F.size("buckets") > 0)), "simhash-groups")
    members = band_buckets(nodes).unionByName(near)
    found = staged(cells(members, members.where(F.pmod("node", F.lit(SAMPLE)) == 0))
                   .repartition("cell").mapInArrow(line_dedup.candidates,
                                                   "cell bigint, node bigint, first bigint"),
                   "candidates")
    wanted = nodes.select("key", "node", "check").join(found.select("node"), "node", "left_semi")
    sets = staged_texts(_among(docs, wanted).join(wanted, "key").select("node", "check", "text")
                  .mapInArrow(_sets, "node bigint, check bigint, line binary")
                  .dropDuplicates(["node"]), "sets")
    how = {"hashes": _set_hashes, "parts": _elements}
    return line_dedup.verified_links(
        found, sets.select("node", "line"), partial(line_dedup._verify, **how),
        partial(line_dedup._verify_cells, **how)), sets.select("node", "check")


def keepers(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The ``key`` of one row of ``docs`` (doc_id, ``text``) for each component: the smallest id, nulls
    last, then the smallest key."""
    keyed = docs.select("doc_id", F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = staged_texts(keyed.mapInArrow(
        _signed, f"doc_id bigint, key {kind}, node bigint, check bigint, buckets array<bigint>, "
        "fingerprint bigint"), "signed")
    roots = line_dedup.members_of(*links(keyed.select("key", "text"), rows))
    best = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    of_node = rows.groupBy("node", "check").agg(F.min(best).alias("best"))
    group = F.struct(F.coalesce("root", "node").alias("root"),
                     F.when(F.col("root").isNull(), F.col("check")).alias("own"))
    chosen = (of_node.join(roots, ["node", "check"], "left")
              .groupBy(group.alias("group")).agg(F.min("best").alias("best")))
    return chosen.select(F.col("best.key").alias(key))
