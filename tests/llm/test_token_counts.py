import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haulmark.llm import token_counts
from haulmark.llm.queries import QUERIES
from haulmark.llm.tokens import chunk_ids

TOKENIZER = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))


def tokens(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def splice(text, start, length, replacement):
    start = min(max(0, start), len(text))
    return text[:start] + replacement + text[min(len(text), start + length):]


@pytest.mark.parametrize("seed", range(4))
def test_counts_after_edits_equal_full_counts(seed):
    rnd, table = random.Random(seed), chunk_ids(token_counts.VOCABULARY)
    words = ["the", "don't", "x.,", ".", "\n", "été", "12", "漢字", "a" * 300, "\t", " "]
    for _ in range(60):
        text = "".join(rnd.choice(words) + rnd.choice([" ", ""])
                       for _ in range(rnd.randint(0, 400)))
        tree = token_counts.CountTree.of(text, lambda part: len(table.encode(part)) // 4)
        for _ in range(6):
            edit = (rnd.randint(0, len(text) + 5), rnd.choice([0, 3, 50, 700, 10**6]),
                    "".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 4, 400]))))
            tree.edit(*edit)
            text = splice(text, *edit)
            assert tree.text == text and tree.total == tokens(text)
            assert tree.chars[1] == len(text)
            for heap in (tree.chars, tree.tokens):  # every sum in the tree holds
                assert all(heap[i] == heap[2 * i] + heap[2 * i + 1]
                           for i in range(1, len(heap) // 2))


def test_an_edit_encodes_a_region_only():
    text = "some words here " * 20_000
    table = chunk_ids(token_counts.VOCABULARY)
    tree = token_counts.CountTree.of(text, lambda part: len(table.encode(part)) // 4)
    tree.edit(160_000, 5, "other text")
    assert tree.reencoded < 4 * token_counts.LEAF


def test_query(spark, small, documents):
    rows = QUERIES["op5_token_counts"](spark, small).collect()
    assert len(rows) == len(documents)
    for r in rows:
        text = documents[r["doc_id"]]["text"]
        edited = splice(text, len(text) // 2, 40, text[:40]) + text[-20:]
        assert (r["n_tokens"], r["edited_tokens"], r["edited_chars"]) == (
            tokens(text), tokens(edited), len(edited))


def test_kept_trees_take_further_edits(spark, odd_rows):
    held = token_counts.counted(odd_rows.withColumn("edits", F.expr(
        "case when doc_id = 4 then null else array(named_struct('start', 3, 'length', 2, "
        "'replacement', cast(null as string))) end")))
    once = token_counts.edited(held, "edits")
    twice = token_counts.edited(once, F.expr(
        "array(named_struct('start', 0, 'length', 0, 'replacement', 'new '))"))
    for r in twice.collect():
        assert r["n_tokens"] == tokens(r["text"])
        assert r["text"].startswith("new ")
    assert token_counts.edited(held.limit(0), "edits").count() == 0
