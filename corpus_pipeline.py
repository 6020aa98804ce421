"""A corpus pipeline: quality rules, line dedup, near-duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read back as the next one's
documents; all but the last return the columns of ``documents``. Rows that an operator could not tell
apart (same id and text) share their decisions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm import line_dedup, mixing, near_docs, packing, quality
from haulmark.llm.queries import mix_items, mixed
from haulmark.llm.text import row_key
from haulmark.session import staged

ORACLE_SQL = None  # Jaccard links and packing are beyond SQL; see tests/llm


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_key, row, doc_id, text, more): the key names a document by 128 bits of id and text, the columns
    of ``docs`` are in ``row``, where no name clashes."""
    return docs.select(row_key("doc_id", "text").alias("doc_key"), F.struct("*").alias("row"), "doc_id",
                       "text", *more)


def _once(keyed: DataFrame) -> DataFrame:
    """(doc_key, row): rows that repeat id and text once, dealt by the key."""
    return keyed.select("doc_key", "row").repartition("doc_key").dropDuplicates(["doc_key"])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules and those of rejected hosts.

    Texts are measured once; what fails is written as its host alone.
    """
    m = F.col("measures")
    judged = quality.measured(docs.select(F.struct("*").alias("row"), F.col("source").alias("host"),
                                          "text"), into="measures")
    judged = judged.select("host", "row", quality.base_failed(m).alias("failed"))
    judged = staged(judged.select("host", "failed", F.when(~F.col("failed"), F.col("row")).alias("row")),
                    "judged")
    bad = quality.rejected_hosts(judged, "host", "failed").select(F.col("host").alias("bad"))
    return (judged.where(~F.col("failed"))
            .join(bad, F.col("host").eqNullSafe(F.col("bad")), "left_anti").select("row.*"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one line of each group of similar lines; n_chars follows the text."""
    out = line_dedup.deduplicated(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped_lines") > 0, F.length("text"))
                             .otherwise(F.col("n_chars")).cast("bigint"))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, similarity 0.8.

    Candidates come from SimHash fingerprints and, beyond their radius, from MinHash bands.
    """
    keyed = _keyed(docs)
    kept = near_docs.keepers(keyed, "doc_key")
    return _once(keyed).join(kept, "doc_key", "left_semi").select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample documents to the target weights; one taken in part appears whole."""
    keyed = _keyed(docs, "source")
    mix = mixed(staged(mix_items(keyed, "doc_key"), "mix"))
    copies = mix.groupBy("doc_key").agg(
        F.sum(mixing.copies(F.col("taken"), F.col("size"))).cast("int").alias("copies"))
    return (_once(keyed).join(copies.where("copies > 0"), "doc_key")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("near-dedup", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
