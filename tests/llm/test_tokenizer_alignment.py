import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haulmark.llm import tokenizer_alignment as ta
from haulmark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def whole():
    """Encode whole texts by both vocabularies: (ids, token bytes) of A and of B."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = ta.byte_values()

    def encode(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        of_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        of_b = []
        for i in ids_b:
            piece = b.id_to_piece(i)
            of_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i)
                        else piece.replace("▁", " ").encode())
        return ids_a, of_a, ids_b, of_b

    return encode


def brute(texts, encode):
    """The contract's columns per text, from the definition."""
    rows, links = [], []
    for text in texts:
        ids_a, of_a, ids_b, of_b = encode(text) if text else ([], [], [], [])
        wanted = (" " + (text or "")).encode()
        if not text or b"".join(of_a) != wanted or b"".join(of_b) != wanted:
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in of_a]), np.cumsum([len(x) for x in of_b])
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups, i, j = [], 0, 0
        for cut in cuts:
            x, y = i, j
            while x < len(ends_a) and ends_a[x] <= cut:
                x += 1
            while y < len(ends_b) and ends_b[y] <= cut:
                y += 1
            groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            i, j = x, y
        found = []
        for k, (a, end) in enumerate(zip(ids_a, ends_a)):
            start = end - len(of_a[k])
            for m in range(int(np.searchsorted(ends_b, start, "right")), len(ids_b)):
                if ends_b[m] - len(of_b[m]) >= end:
                    break
                found.append((a, ids_b[m]))
        rows.append((len(ids_a), len(ids_b), len(cuts), len(found),
                     hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(found)
    count = Counter(p for found in links for p in found)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(*row[:4], sum(count[p] == most[p[1]] for p in found), sum(count[p] for p in found), row[4])
            for row, found in zip(rows, links)]


def as_rows(frame):
    return [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"],
             r["groups_sha256"]) for r in frame.orderBy("doc_id").collect()]


def test_query_equals_whole_texts(spark, small, documents, whole):
    ids = sorted(documents)
    assert as_rows(QUERIES["op12_tokenizer_alignment"](spark, small)) == brute(
        [documents[i]["text"] for i in ids], whole)


def test_random_texts_in_small_units(spark, whole, monkeypatch):
    """Odd characters around spaces, special tokens' strings, texts without tokens, many units."""
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "　", "\xa0", "é", "漢", "<s>", "'s", "12",
             "<|endoftext|>", "▁", ".", "\x00", "\x1c", "\x85", "​", "ﬁ", "İ",
             "\U0001f389", "᠎", "﻿", "\r\n", "Hello", "World", " the", " Stra\xdfe"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += [None, "", " ", "▁", "plain words here", "x" * 3000]
    monkeypatch.setattr(ta, "UNIT_CHARS", 900)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    wanted = brute(texts, whole)
    assert 0 < sum(r[0] == 0 for r in wanted) < 600
    assert as_rows(ta.aligned(docs).withColumnRenamed("groups", "groups_sha256")) == wanted


def test_groups_as_text(spark, whole):
    docs = spark.createDataFrame([(1, "Stra\xdfen are unbelievable"), (2, None)], "doc_id int, text string")
    got = {r["doc_id"]: r["groups"] for r in ta.aligned(docs, digest=False).collect()}
    ids_a, _, ids_b, _ = whole("Stra\xdfen are unbelievable")
    sides = [g.split("|") for g in got[1].split(";")]
    assert [int(x) for a, _ in sides for x in a.split(",")] == ids_a
    assert [int(x) for _, b in sides for x in b.split(",")] == ids_b
    assert got[2] == ""


@pytest.mark.parametrize("seed", range(20))
def test_pointer_jumping_labels_components(seed):
    """Against union-find over all overlapping pairs, with chains up to the whole length."""
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 400))
    share = rng.choice([0.05, 0.3, 0.6])
    a, b = (np.append(np.flatnonzero(rng.random(size) < share) + 1, size + 1) for _ in range(2))
    if seed == 0:  # one chain: no common end but the last
        a, b = np.append(np.arange(2, 800, 2), 801), np.append(np.arange(1, 800, 2), 801)
    label = ta.terminals(a, b)
    root = list(range(len(a) + len(b)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = list(zip(*ta.overlaps(a, b)))
    starts_a, starts_b = np.append(0, a[:-1]), np.append(0, b[:-1])
    assert pairs == [(i, j) for i in range(len(a)) for j in range(len(b))
                     if starts_a[i] < b[j] and starts_b[j] < a[i]]
    for i, j in pairs:
        root[find(i)] = find(len(a) + j)
    by_root, by_label = {}, {}
    for x in range(len(root)):
        by_root.setdefault(find(x), []).append(x)
        by_label.setdefault(int(label[x]), []).append(x)
    assert sorted(by_root.values()) == sorted(by_label.values())
    assert len(by_label) == len(set(a) & set(b))


def test_odd_rows(spark, odd_rows, whole):
    docs = odd_rows
    for name in ("unit", "groups", "chunks", "pairs", "place", "pair", "count", "best"):
        docs = docs.withColumn(name, F.lit("x"))
    rows = docs.collect()
    got = ta.aligned(docs).collect()
    keys = sorted((str(r["doc_id"]), *w) for r, w in zip(rows, brute([r["text"] for r in rows], whole)))
    assert sorted((str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"],
                   r["count_sum"], r["groups"]) for r in got) == keys
    assert ta.aligned(docs.limit(0)).count() == 0
    nothing = ta.aligned(docs.where("doc_id < 3").coalesce(1)).collect()
    assert all(r["n_a"] == r["count_sum"] == 0 for r in nothing if r["doc_id"] in (1, 2))
