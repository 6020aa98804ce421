"""Packing into training sequences: vector bin packing with the dot-product heuristic.

Examples have three demands: tokens, one segment, and loss-bearing tokens. Each sequence has a limit
on all three. A sequence is filled by the example that fits and whose demands, relative to the limits
and weighted by their totals, have the largest dot product with what is left; it is closed when
nothing fits.

Packing needs no global order: the examples are dealt evenly into groups of about ``GROUP_ROWS``, each
packed on its own, so padding stays as small at any scale and no task grows with the corpus. Groups
are dealt by a stored row number, not by id, so repeated rows or ids spread evenly.

Documents are cut into pieces of a whole sequence and a rest. Defined results: a null or empty text
is the end id alone. Repeated rows are pieces of their own. An example above a limit is not dropped
but gets a sequence of its own. No documents: no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.tokens import chunk_ids
from haulmark.session import staged

LENGTH = 2048
MAX_SEGMENTS = 128
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
GROUP_ROWS = 4096
PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "row bigint")


def fill(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]
         ) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each example, sequences numbered from 0."""
    demand = np.stack([tokens, np.ones(len(tokens), np.int64), loss], 1).astype(np.int64)
    limit = np.array(limits, np.int64)
    sequence, offset = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
    # What fills a sequence alone needs no search.
    alone = (tokens >= limits[0]) | (demand > limit).any(1)
    count = int(alone.sum())
    sequence[alone] = np.arange(count)
    rows = np.flatnonzero(~alone)
    demand = demand[rows]
    share = demand / limit
    weight = share.mean(0) if len(rows) else np.zeros(3)
    while len(rows):
        left, at, free = limit.copy(), 0, np.ones(len(rows), bool)
        while True:
            fits = np.flatnonzero(free & (demand <= left).all(1))
            if not len(fits):
                break
            chosen = fits[np.argmax(share[fits] @ (weight * left / limit))]
            sequence[rows[chosen]], offset[rows[chosen]] = count, at
            at += int(demand[chosen, 0])
            left -= demand[chosen]
            free[chosen] = False
        count += 1
        rows, demand, share = rows[free], demand[free], share[free]
    return sequence, offset


def pack(examples: DataFrame, limits: tuple[int, int, int] = (LENGTH, MAX_SEGMENTS, LENGTH),
         group_rows: int = GROUP_ROWS) -> DataFrame:
    """``examples`` (length, loss_tokens, row, any others) with sequence_id and offset.

    ``row`` deals the examples into groups; it need not be unique. ``examples`` is counted first, so
    pass a stored table.
    """
    groups = max(1, math.ceil(examples.count() / group_rows))
    out = examples.drop("sequence_id", "offset")
    dealt = out.withColumn("_group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    order = [c for c in ("row", "doc_id", "start") if c in out.columns]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        group = int(frame["_group"].iloc[0])
        sequence, offset = fill(frame["length"].to_numpy(), frame["loss_tokens"].to_numpy(), limits)
        return frame.drop(columns="_group").assign(sequence_id=sequence * groups + group,
                                                   offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return dealt.groupBy("_group").applyInPandas(
        one, f"{schema}, sequence_id bigint, offset bigint")


def pieces(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY,
           length: int = LENGTH) -> DataFrame:
    """Pieces (columns of ``PIECES``) of each document's ids, cut every ``length`` ids."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_ids(vocabulary)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = table.encode(content.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, length):
                    piece = ids[4 * start:4 * (start + length)]
                    out.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total, row))
                    row += 1
            columns = list(zip(*out)) or [()] * 6
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns],
                                  names=["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                         "row"])

    return docs.select(F.col("doc_id").cast("bigint"), text).mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY,
                   length: int = LENGTH) -> DataFrame:
    """Pieces of all documents with their sequence and offset; every id bears loss."""
    stored = staged(pieces(docs, text, vocabulary, length), "pieces")
    packed = pack(stored.withColumn("loss_tokens", F.col("length")),
                  (length, MAX_SEGMENTS, length))
    return packed.drop("row", "loss_tokens")
