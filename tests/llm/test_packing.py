import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from haulmark.llm import packing
from haulmark.llm.queries import QUERIES
from haulmark.llm.tokens import ChunkIds

PATH = public_tokenizers.path(packing.VOCABULARY)
TOKENIZER = Tokenizer.from_file(PATH)
CHUNKS = ChunkIds(PATH, limit=50)  # a small table, so that it is emptied on the way


def ids(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(
    list("aAbéÉßſKİΣσς'’.,;! \n\t\r\x0b\x1c\x85  ́漢🎉5") +
    ["don't", "I'LL", "x.,y", "a. ", "<|endoftext|>", "word ", "Word, "])).map("".join))
def test_chunk_ids_equal_the_tokenizer(text):
    assert np.frombuffer(CHUNKS.encode(text), "<u4").tolist() == ids(text)


def check(rows, texts):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc_id, text in texts.items():
        want, at = ids(text or "") + [packing.END_ID], 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            part = want[at:at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(want)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.LENGTH
    return sum(r["length"] for r in rows) / (packing.LENGTH * len(sequences))


def test_query_round_trip(spark, small, documents):
    rows = QUERIES["op2_packing"](spark, small).collect()
    assert check(rows, {i: r["text"] for i, r in documents.items()}) > 0.97


def test_limits_hold_together():
    rng = np.random.default_rng(5)
    tokens = rng.integers(1, 900, 500)
    loss = (tokens * rng.random(500)).astype(np.int64)
    sequence, offset = packing.fill(tokens, loss, (1000, 6, 500))
    for s in np.unique(sequence):
        here = sequence == s
        alone = here.sum() == 1
        assert tokens[here].sum() <= 1000 and here.sum() <= 6
        assert loss[here].sum() <= 500 or alone
        order = np.argsort(offset[here])
        assert offset[here][order].tolist() == [0, *np.cumsum(tokens[here][order])[:-1]]


def test_oversize_examples_stand_alone():
    sequence, _ = packing.fill(np.array([5000, 10, 20]), np.array([0, 600, 5]), (1000, 4, 500))
    assert len(set(sequence.tolist())) == 3


def test_odd_rows(spark, odd_rows):
    rows = packing.pack_documents(odd_rows).collect()
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert packing.pack_documents(odd_rows.limit(0)).count() == 0
