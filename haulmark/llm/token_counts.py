"""Edit-aware token counts: a segment tree over runs of pre-tokens for each document.

A text is cut into leaves of at least ``LEAF`` characters that end after white space, which the vocabulary
drops and never joins across. The tree, stored with the document as two arrays in heap order, holds
the characters and tokens below every node. An edit descends the tree to the leaves it touches, extends
the region to the next white space (the boundary context), re-encodes only that region and updates
the sums on the way to the root. A count is the root's sum. A region that outgrows ``SPLIT`` leaves' worth
of text is cut again and the sums are rebuilt from the leaves, without encoding anything else.

Trees and edits travel on the document's row: nothing is shuffled, and repeated or null ids do no harm.
An edit is (start, length, replacement) in code points of the text as the edit before left it. Defined
results: a null or empty text has no tokens; null edits are no edits, a null replacement is empty; an
edit beyond the end appends, one that reaches past the end stops there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulmark.llm.tokens import chunk_ids

LEAF = 256
SPLIT = 4
VOCABULARY = "word_bpe_49k.json"
BREAKS = (" ", "\n", "\t")

_INTS = T.ArrayType(T.IntegerType())
TREE = T.StructType([T.StructField("chars", _INTS), T.StructField("tokens", _INTS)])
EDITS = "array<struct<start:int,length:int,replacement:string>>"
COUNTED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("chars", _INTS),
                        T.StructField("tokens", _INTS)])
EDITED = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("reencoded_chars", T.LongType()), T.StructField("chars", _INTS),
    T.StructField("tokens", _INTS)])


def cut(text: str) -> list[str]:
    """Parts of at least ``LEAF`` characters that end after white space, but for the last."""
    parts, start = [], 0
    while len(text) - start > LEAF:
        ends = [text.find(b, start + LEAF - 1, start + 2 * LEAF) for b in BREAKS]
        found = [e for e in ends if e >= 0] or [
            e for e in (text.find(b, start + LEAF - 1) for b in BREAKS) if e >= 0]
        end = min(found) + 1 if found else len(text)
        parts.append(text[start:end])
        start = end
    return parts + [text[start:]] if start < len(text) else parts


def _heap(leaves: list[int]) -> list[int]:
    """Sums in heap order: node i has children 2i and 2i+1, the leaves fill the second half."""
    half = 1
    while half < len(leaves):
        half *= 2
    out = [0] * half + leaves + [0] * (half - len(leaves))
    for i in range(half - 1, 0, -1):
        out[i] = out[2 * i] + out[2 * i + 1]
    return out


class CountTree:
    """Sums of a text's leaves; ``count`` gives the tokens of a piece of text."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], count: Callable[[str], int]):
        self.text, self.chars, self.tokens, self.count = text, chars, tokens, count
        self.reencoded = 0

    @classmethod
    def of(cls, text: str, count: Callable[[str], int]) -> CountTree:
        parts = cut(text)
        return cls(text, _heap([len(p) for p in parts]), _heap([count(p) for p in parts]), count)

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a place, or of the last one."""
        place = min(place, self.chars[1] - 1)
        node, before, half = 1, 0, len(self.chars) // 2
        while node < half:
            node *= 2
            if place >= before + self.chars[node]:
                before += self.chars[node]
                node += 1
        return node - half, before

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + len(self.chars) // 2
        more, worth = chars - self.chars[node], tokens - self.tokens[node]
        while node and (more or worth):
            self.chars[node] += more
            self.tokens[node] += worth
            node //= 2

    def edit(self, start: int, length: int, replacement: str) -> None:
        size, half = len(self.text), len(self.chars) // 2
        start = max(0, min(start, size))
        stop = min(size, start + max(0, length))
        first, begin = self._find(start) if size else (0, 0)
        last, at = self._find(max(start, stop - 1)) if size else (0, 0)
        end = at + self.chars[half + last]
        region = self.text[begin:start] + replacement + self.text[stop:end]
        # Every leaf before the region ends with white space; take in what follows until it does too.
        while region and end < size and region[-1] not in BREAKS:
            last, _ = self._find(end)
            region += self.text[max(end, stop):end + self.chars[half + last]]
            end += self.chars[half + last]
        self.text = self.text[:start] + replacement + self.text[stop:]
        self.reencoded += len(region)
        if len(region) > SPLIT * LEAF:
            parts = cut(region)
            for heap, new in ((self.chars, [len(p) for p in parts]),
                              (self.tokens, [self.count(p) for p in parts])):
                heap[:] = _heap(heap[half:half + first] + new + heap[half + last + 1:])
            return
        self._set(first, len(region), self.count(region))
        for leaf in range(first + 1, last + 1):
            self._set(leaf, 0, 0)


def _counter(vocabulary: str) -> Callable[[str], int]:
    table = chunk_ids(vocabulary)
    return lambda part: len(table.encode(part)) // 4


def counted(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with n_tokens and the ``tree`` to keep with each document."""
    @F.pandas_udf(COUNTED)
    def build(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = _counter(vocabulary)
        for batch in texts:
            trees = [CountTree.of(t or "", count) for t in batch]
            yield pd.DataFrame({"n_tokens": [t.total for t in trees],
                                "chars": [t.chars for t in trees],
                                "tokens": [t.tokens for t in trees]}, columns=COUNTED.names)

    return (docs.withColumn("_counted", build(F.col(text)))
            .withColumns({"n_tokens": F.col("_counted.n_tokens"),
                          "tree": F.struct("_counted.chars", "_counted.tokens")})
            .drop("_counted"))


def edited(docs: DataFrame, edits: str | Column, text: str = "text", tree: str = "tree",
           vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` after the edits of each row: new text, n_tokens and tree, and the characters that had
    to be encoded in ``reencoded_chars``."""
    @F.pandas_udf(EDITED)
    def apply(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]
              ) -> Iterator[pd.DataFrame]:
        count = _counter(vocabulary)
        for batch in batches:
            out = []
            for content, chars, tokens, changes in zip(*batch):
                held = CountTree(content or "", list(map(int, chars)), list(map(int, tokens)), count)
                for change in (changes if changes is not None else ()):
                    held.edit(change["start"], change["length"], change["replacement"] or "")
                out.append((held.text, held.total, held.reencoded, held.chars, held.tokens))
            yield pd.DataFrame(out, columns=EDITED.names)

    wanted = F.col(edits) if isinstance(edits, str) else edits
    return (docs.withColumn("_edited", apply(F.col(text), F.col(f"{tree}.chars"),
                                             F.col(f"{tree}.tokens"), wanted.cast(EDITS)))
            .withColumns({text: F.col("_edited.text"), "n_tokens": F.col("_edited.n_tokens"),
                          "reencoded_chars": F.col("_edited.reencoded_chars"),
                          tree: F.struct("_edited.chars", "_edited.tokens")})
            .drop("_edited"))
