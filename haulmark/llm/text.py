"""Column expressions on text that the operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ascii_lower(text: Column) -> Column:
    """Lower case for matching A-Z: no other character turns into an ASCII letter.

    ``lower`` is fast but also maps the dotted I and the Kelvin sign to ASCII letters; they are
    replaced by another non-ASCII letter first. Other non-ASCII letters change case.
    """
    kept = F.replace(text, F.lit("İ"), F.lit("ä"))
    return F.lower(F.replace(kept, F.lit("K"), F.lit("ä")))


def ascii_lower_short(text: Column) -> Column:
    """A-Z lower-cased and nothing else, for short strings."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def row_key(doc_id: str, text: str) -> Column:
    """128 bits, as a struct of two longs, that name a document by id and text."""
    return F.struct(F.xxhash64(doc_id, text).alias("hi"),
                    F.xxhash64(F.lit(1), text, doc_id).alias("lo"))


ROW_KEY = "struct<hi:bigint,lo:bigint>"
