"""Document fingerprints by Order MinHash, sensitive to edit distance.

A text's k-mers are its runs of ``K`` words, numbered by occurrence, so that the n-th copy of a k-mer
is an element of its own. Numbered k-mers are hashed once and dealt into ``BINS`` bins by their hash;
each bin selects its ``L`` smallest, puts them back into text order and hashes that tuple. Two texts agree
in a bin if they share its smallest k-mers and have them in the same order. The likeness of two
fingerprints grows with the share of bins in which they agree: 1 for equal texts, 0 for unrelated ones.

Everything is array expressions on one row. A numbered k-mer travels as one long, hash above
position, so that sorting is a primitive sort and equal k-mers lie side by side. Documents meet their
neighbour in id order without a global sort: ids are cut into ranges of about ``RANGE_ROWS`` documents, the
neighbour is found inside the range, and only each range's first document is sent to the range before.

Defined results: null counts as the empty text, whose fingerprint is empty; two empty ones have
likeness 1. A text of fewer than ``K`` words is one k-mer. Positions are kept modulo 2^24. Null ids come
last; rows of one id are ordered by a hash of their text. A single document is its own neighbour.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.llm.text import WORD, text_of

K = 3
L = 2
BINS = 32
RANGE_ROWS = 2000
_PLACE = 24
_HASH = 39
_NO_ID = -(1 << 63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with a name for an array value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def _kmer(x: Column) -> Column:
    return F.shiftright(x, _PLACE)


def _coded(digest: Column, place: Column) -> Column:
    return F.shiftleft(_low(digest, _HASH), _PLACE).bitwiseOR(
        _low(place.cast("bigint"), _PLACE))


def _numbered(codes: Column) -> Column:
    """Sorted codes with repeated k-mers hashed anew by occurrence number, sorted."""
    same = lambda i: _kmer(F.get(codes, i - 1)) == _kmer(F.get(codes, i))
    heads = F.filter(F.sequence(F.lit(0), F.size(codes) - 1), lambda i: (i == 0) | ~same(i))

    def runs(starts: Column) -> Column:
        return F.flatten(F.transform(starts, lambda start, j: F.transform(
            F.slice(codes, start + 1, F.coalesce(F.get(starts, j + 1), F.size(codes)) - start),
            lambda x, n: F.when(n == 0, x).otherwise(
                _coded(F.xxhash64(_kmer(x), n), _low(x, _PLACE))))))

    repeated = F.exists(F.sequence(F.lit(1), F.size(codes) - 1), same)
    return F.when((F.size(codes) > 1) & repeated, F.sort_array(_let(heads, runs))).otherwise(codes)


def _tuples(numbered: Column) -> Column:
    """A code of bin and tuple hash for every bin that has a k-mer."""
    bin_of = lambda x: F.shiftright(_kmer(x) * BINS, _HASH)
    least = F.filter(numbered, lambda x, i: (i < L) | (
        bin_of(F.get(numbered, i - L)) != bin_of(x)))

    def hashed(chosen: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(chosen) - 1), lambda i: (i == 0) | (
            bin_of(F.get(chosen, i - 1)) != bin_of(F.get(chosen, i))))

        def digest(run: Column) -> Column:
            in_order = F.sort_array(F.transform(run, lambda x: F.shiftleft(
                _low(x, _PLACE), _HASH).bitwiseOR(_kmer(x))))
            return _low(F.xxhash64(F.transform(in_order, lambda y: _low(y, _HASH))), 32)

        return _let(starts, lambda s: F.transform(s, lambda start, j: F.shiftleft(
            bin_of(F.get(chosen, start)), 32).bitwiseOR(digest(F.slice(
                chosen, start + 1, F.coalesce(F.get(s, j + 1), F.size(chosen)) - start)))))

    return _let(least, hashed)


def signature(text: Column) -> Column:
    """array<bigint>: bin and tuple hash of every bin that is not empty."""
    words = F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0))

    def codes(ws: Column) -> Column:
        return F.sort_array(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(ws) - K, F.lit(0))),
            lambda i: _coded(F.xxhash64(F.slice(ws, i + 1, K)), i)))

    found = _let(words, lambda ws: F.when(F.size(ws) > 0, _let(
        codes(ws), lambda c: _let(_numbered(c), _tuples))))
    return F.coalesce(found, F.array().cast("array<bigint>"))


def as_text(sig: Column) -> Column:
    """Ten hex digits for each filled bin: its number, then its tuple hash."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two signatures, 0 to 1; 1 if both are empty.

    A bin agrees if all its ``L`` k-mers do, so the L-th root of the share of agreeing bins, among
    those that either fills, estimates the share of agreeing k-mers.
    """
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    filled = F.size(F.array_union(bins(a), bins(b)))
    share = F.size(F.array_intersect(a, b)) / filled
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.pow(share, F.lit(1.0 / L)))


def range_width(ids: DataFrame, rows: int = RANGE_ROWS) -> int:
    """Width of id ranges that hold about ``rows`` ids where they are densest: one row to the driver."""
    steps = 20
    found = ids.agg(F.count("doc_id").alias("n"), F.percentile_approx(
        "doc_id", [i / steps for i in range(steps + 1)], 1000).alias("q")).first()
    if not found["n"]:
        return 1
    narrowest = min(b - a for a, b in zip(found["q"], found["q"][1:]))
    return max(1, int(rows * (narrowest + 1) * steps / found["n"]))


def signed(docs: DataFrame) -> DataFrame:
    """``docs`` (text) with the signature of the text in ``sig``."""
    return docs.withColumn("sig", signature(F.col("text")))


def with_next(docs: DataFrame, width: int) -> DataFrame:
    """``docs`` (doc_id, text) with ``sig`` and ``next``, a struct of text and sig of the next document
    by descending id; the first follows the last.

    Rows are shuffled once, by id range. Each range's first document is picked before the shuffle,
    at most one from each task and range, and only those are signed a second time.
    """
    ranged = docs.withColumn("_range", F.coalesce(F.expr(f"doc_id div {width}L"), F.lit(_NO_ID)))
    order = Window.partitionBy("_range").orderBy(F.col("doc_id").desc_nulls_last(),
                                                 F.xxhash64("text").desc())
    placed = signed(ranged).withColumn("next", F.lead(F.struct("text", "sig")).over(order))
    # One row per range; a range holds about RANGE_ROWS documents.
    whole = Window.orderBy(F.col("_range").desc())
    everything = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranged.select("_range").distinct().select(
        F.col("_range").alias("_to"),
        F.coalesce(F.lead("_range").over(whole), F.first("_range").over(everything))
        .alias("_from"))
    heads = (ranged.withColumn("_place", F.row_number().over(order)).where("_place = 1")
             .select(F.col("_range").alias("_from"), "text").join(ranges, "_from"))
    sent = signed(heads).select("_to", F.struct("text", "sig").alias("_head"))
    return (placed.join(sent, F.col("_range") == F.col("_to"), "left")
            .withColumn("next", F.coalesce("next", "_head"))
            .drop("_range", "_to", "_head"))


def with_edit(docs: DataFrame) -> DataFrame:
    """``docs`` (text, next) with n_chars and ``edited``: the last third replaced by the start of the
    next text."""
    text, other = F.col("text"), F.col("next.text")
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return docs.withColumns({"n_chars": n.cast("bigint"), "edited": F.concat(
        F.substring(text, F.lit(1), n - third), F.substring(other, F.lit(1), third))})
