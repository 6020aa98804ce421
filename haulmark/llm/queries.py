"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm import (decontamination, filter_audit, licenses, line_dedup, mixing, order_minhash,
                          packing, quality, secrets, simhash, token_counts, tokenizer_alignment,
                          url_rules)
from haulmark.llm.text import n_words, text_of
from haulmark.session import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The rules of the url query, as (verdict, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"),
             ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
             ("block", "net", "/fr/")]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def symbol_free(text) -> "F.Column":
    """A quality weight in (0, 1]: words among words and symbols."""
    words, chars = n_words(text), text_of(text)
    symbols = F.regexp_count(chars, F.lit(r"[#*$%&|<>]"))
    return (words + 1.0) / (words + 1.0 + symbols)


def mix_items(docs: DataFrame, *more: str) -> DataFrame:
    """The narrow table that mixing works on."""
    return docs.select("doc_id", "source", *more, n_words(F.col("text")).alias("size"),
                       symbol_free(F.col("text")).alias("weight"))


def mixed(items: DataFrame) -> DataFrame:
    sizes = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    return mixing.mix(items, mixing.source_targets(sizes))


@query
def op1_source_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    out = mixed(staged(mix_items(documents(spark, d)), "mix"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"),
                      "taken")


@query
def op2_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack_documents(documents(spark, d).select("doc_id", "text"))


@query
def op3_simhash(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    return simhash.deduplicated(documents(spark, d))


@query
def op4_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its measures, base verdict and final verdict."""
    m = F.col("_m")
    rows = staged(quality.measured(documents(spark, d).select("doc_id", "source", "text"))
                  .select("doc_id", "source", "_m.*", quality.base_failed(m).alias("base_failed")),
                  "quality")
    return quality.verdicts(rows, "source", "base_failed").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@query
def op5_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every document's tokens, and its tokens after two edits: its first 40 characters replace those
    from the middle on, then its last 20 are appended."""
    docs = documents(spark, d).select("doc_id", text_of("text").alias("text"))
    n = F.length("text")
    docs = docs.withColumn("edits", F.array(
        F.struct(F.floor(n / 2).cast("int").alias("start"), F.lit(40).alias("length"),
                 F.substring("text", 1, 40).alias("replacement")),
        F.struct((n + 40).alias("start"), F.lit(0).alias("length"),
                 F.substring("text", -20, 20).alias("replacement"))))
    before = token_counts.counted(docs).withColumnRenamed("n_tokens", "tokens_before")
    return token_counts.edited(before, "edits").select(
        "doc_id", F.col("tokens_before").alias("n_tokens"),
        F.col("n_tokens").alias("edited_tokens"), "reencoded_chars",
        F.length("text").cast("bigint").alias("edited_chars"))


@query
def op6_order_minhash(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and likenesses."""
    docs = documents(spark, d).select("doc_id", text_of("text").alias("text"))
    width = order_minhash.range_width(docs)
    edited = order_minhash.with_edit(order_minhash.with_next(docs, width))
    out = edited.withColumn("edited_sig", order_minhash.signature(F.col("edited")))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.as_text(F.col("sig")).alias("fingerprint"),
        order_minhash.as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        order_minhash.likeness(F.col("sig"), F.col("next.sig")).alias("near_next"))


@query
def op7_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the number of lines dropped and its text without them."""
    docs = documents(spark, d).select("doc_id", "text")
    return line_dedup.deduplicated(docs).select("doc_id", "n_dropped_lines", "text")


@query
def op8_license_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its licence phrases, labels and score."""
    return licenses.scan(documents(spark, d).select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query
def op9_url_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every page's url with its rule and verdict."""
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    return url_rules.judge(pages, url_rules.rule_table(URL_RULES, spark)).select(
        "page_id", "host", "path", "rule", "verdict")


@query
def op10_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the findings of its blob, from a ledger that starts empty."""
    docs = documents(spark, d).select("doc_id", "text")
    ledger = staged(secrets.scan_unseen(docs), "ledger")
    return secrets.report(docs, ledger).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query
def op11_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    """What each of five filters removes at each step of every order, by source."""
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic")
    return filter_audit.audit_documents(documents(spark, d).select("doc_id", "text", "source"), labels)


@query
def op12_tokenizer_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its aligned groups and links of two tokenizers."""
    docs = documents(spark, d).select(F.col("doc_id").cast("bigint"), "text")
    return tokenizer_alignment.aligned(docs).withColumnRenamed("groups", "groups_sha256")


@query
def op13_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its words inside benchmark windows and the items they come from."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text")
    return decontamination.scan(documents(spark, d).select("doc_id", "text"), items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"))
