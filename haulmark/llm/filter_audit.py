"""Filter interaction audit: what each filter removes in every order of application.

Every document gets a mask of the filters that it fails. Documents are counted by (part, mask), at most
2^k cells a part for k filters, combined in the tasks; nothing larger is shuffled for the audit. Each
cell is then folded across the array of all k! orders by ``transform`` and ``aggregate``: for each order
the fold walks the filters, carries whether the cell is still in, and adds one struct a step, weighted
with the cell's counts. The structs of a part's cells, k! * k each (600 for five filters), are merged by
elementwise sums. So the work on the orders grows with the parts, never with the documents.

Defined results: a null part is the empty string. A null text is empty: no words, no characters, and the
same text as any other empty one. A document repeats if the same text stands under a smaller id; one without
an id repeats nothing and nothing repeats it. Repeated rows count each. Labels of a document that stand
several times hold if any of them does; a null label does not. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm.text import text_of
from haulmark.session import staged

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
SYMBOLS = "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: str = "text") -> dict[str, Column]:
    """The failure conditions that depend on the text alone, by filter letter."""
    content = text_of(text)
    words = F.array_remove(F.split(content, SPACE), "")
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * MIN_DISTINCT_PERCENT,
        "C": F.regexp_count(content, F.lit("[A-Z]")) * 100 > F.length(content) * MAX_UPPER_PERCENT,
        "D": content.rlike(SYMBOLS),
    }


def repeats(rows: DataFrame, doc_id: str, digest: str) -> DataFrame:
    """``rows`` with ``repeated``: the same digest stands under a smaller id.

    The smallest id of each digest is joined back on digest and id together, so the copies of one text,
    however many, spread over the tasks. ``rows`` is read twice.
    """
    first = (rows.groupBy(F.col(digest).alias("_first_digest"))
             .agg(F.min(doc_id).alias("_first_id")).where(F.col("_first_id").isNotNull()))
    same = (F.col(digest) == F.col("_first_digest")) & (F.col(doc_id) == F.col("_first_id"))
    return (rows.join(first, same, "left")
            .withColumn("repeated", F.col("_first_id").isNull() & F.col(doc_id).isNotNull())
            .drop("_first_digest", "_first_id"))


def mask(failures: Mapping[str, Column]) -> Column:
    """The failed filters as bits, the first filter lowest; a null condition has not failed."""
    return sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(failures.values())),
               F.lit(0)).cast("int")


def cells(rows: DataFrame) -> DataFrame:
    """Rows (part, mask, good, toxic) counted by part and mask."""
    return rows.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("bigint")).alias("good"),
        F.sum(F.col("toxic").cast("bigint")).alias("toxic"))


def _fold(cell: Column, orders: Column, letters: str) -> Column:
    """A cell's structs for every step of every order: the filter's bit and the weighted counts."""
    none = F.lit(0).cast("bigint")
    steps = F.sequence(F.lit(1), F.lit(len(letters)))

    def step(order: Column, state: Column, at: Column) -> Column:
        bit = F.position(F.substring(order, at, F.lit(1)), F.lit(letters)) - 1
        own = F.call_function("shiftleft", F.lit(1), bit)
        fails = cell["mask"].bitwiseAND(own) != 0
        here, late = state["in"] & fails, ~state["in"] & fails
        counted = F.struct(
            bit.alias("bit"),
            F.when(state["in"] & ~fails, cell["n"]).otherwise(none).alias("kept"),
            F.when(here, cell["n"]).otherwise(none).alias("removed"),
            F.when(late, cell["n"]).otherwise(none).alias("redundant"),
            F.when(fails & (cell["mask"] == own), cell["n"])
            .otherwise(none).alias("unique_fails"),
            F.when(here, cell["good"]).otherwise(none).alias("good_lost"),
            F.when(here, cell["toxic"]).otherwise(none).alias("toxic_lost"))
        return F.struct((state["in"] & ~fails).alias("in"),
                        F.concat(state["steps"], F.array(counted)).alias("steps"))

    kind = "array<struct<bit:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    start = F.struct(F.lit(True).alias("in"), F.array().cast(kind).alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(
        steps, start, lambda state, at: step(order, state, at), lambda state: state["steps"])))


def _merged(a: Column, b: Column) -> Column:
    """Elementwise sums of two arrays of step structs."""
    return F.zip_with(a, b, lambda x, y: F.struct(
        x["bit"].alias("bit"), *[(x[c] + y[c]).alias(c) for c in COUNTS]))


def audit(counted: DataFrame, letters: str) -> DataFrame:
    """Of cells (part, mask, n, good, toxic) one row per part, order and step, with the counts.

    ``letters`` names the filters, the lowest bit first; their factorial is the number of orders, so it is
    meant for up to six. ``shapley`` sums what the step's filter removes over all orders.
    """
    if not 1 <= len(letters) <= 6 or len(set(letters)) < len(letters):
        raise ValueError("one to six filters, each with a letter of its own")
    orders = F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")
    size = len(letters)
    of_part = counted.groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2^k structs
    nothing = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("n", "good", "toxic")],
                       F.lit(0).alias("mask"))
    merged = F.aggregate("cells", _fold(nothing, orders, letters),
                         lambda total, cell: _merged(total, _fold(cell, orders, letters)))
    removed = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda f: F.aggregate(
        F.filter("merged", lambda x: x["bit"] == f), F.lit(0).cast("bigint"),
        lambda total, x: total + x["removed"]))
    rows = (of_part.select("part", merged.alias("merged"))
            .select("part", removed.alias("by_filter"), F.posexplode("merged").alias("at", "step")))
    place = F.floor(F.col("at") / size).cast("int")
    return rows.select(
        "part", F.get(orders, place).alias("filter_order"),
        (F.col("at") % size + 1).cast("int").alias("step"), *[f"step.{c}" for c in COUNTS],
        F.get("by_filter", F.col("step.bit")).alias("shapley"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters A to E over ``docs`` (doc_id, text, source) by source."""
    narrow = staged(docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(text_of("text"), 256)).alias("digest"),
        F.struct(*[c.alias(k) for k, c in text_failures().items()]).alias("fails")), "filters")
    held = labels.groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    failures = {k: F.col(f"fails.{k}") for k in "ABCD"} | {"E": F.col("repeated")}
    rows = (repeats(narrow, "doc_id", "digest")
            .join(held, F.col("doc_id") == F.col("labelled"), "left")
            .select("part", mask(failures).alias("mask"),
                    F.coalesce("good", F.lit(False)).alias("good"),
                    F.coalesce("toxic", F.lit(False)).alias("toxic")))
    return audit(cells(rows), "ABCDE")
