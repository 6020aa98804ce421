"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

A rule is (host, path, verdict): it fits its host and all subdomains when the url's path starts with
the rule's path. A url expands into every pair of one of its host suffixes (cut at dots) and one of
its path prefixes (cut after slashes), as deep as the deepest rule. Url and rule meet in an equi-join
on the first hex digits of the pair's SHA-256; the full digest and the exact path prefix confirm.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule, so it
gets the default verdict. The longest fitting rule (host and path together) wins; of equally long
ones the longer host, then ``block``. Repeated urls each keep their row. An empty rule table gives
every url the default verdict.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm.text import ascii_lower_short

PREFIX_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(text)), r"^[^?#]*", 0)
    return ascii_lower_short(host), path


def _directory(path: Column) -> Column:
    """The path up to and including its last slash."""
    return F.regexp_extract(path, r"^(?s:.*)/", 0)


def _keyed(df: DataFrame, expression: Column) -> DataFrame:
    return (df.withColumn("digest", F.sha2(expression, 256))
            .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS)))


def rule_index(rules: DataFrame) -> DataFrame:
    """Rules keyed by the digest of their host and directory."""
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null")
    return _keyed(rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"),
                               "verdict"), F.concat("rule_host", _directory(F.col("rule_path"))))


def depths(rules: DataFrame) -> tuple[int, int]:
    """The most host labels and the most path slashes of any rule: one row to the driver."""
    row = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"),
                    F.max(F.length(F.regexp_replace("path", "[^/]", ""))).alias("slashes")).first()
    return row["labels"] or 0, row["slashes"] or 0


def expressions(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """All host suffixes of up to ``labels`` labels, each with all prefixes of up to ``slashes``."""
    dots = F.split(host, r"\.")
    hosts = [F.when(F.size(dots) >= n, F.array_join(F.slice(dots, F.size(dots) - n + 1, n), "."))
             for n in range(1, labels + 1)]
    paths = [F.lit("")] + [F.regexp_extract(path, rf"^(?:[^/]*/){{{n}}}", 0)
                           for n in range(1, slashes + 1)]
    pairs = [F.concat(h, p) for h in hosts for p in paths]
    return F.array_distinct(F.array_compact(F.array(*pairs))) if pairs else \
        F.array().cast("array<string>")


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``urls`` (a column ``url``, any others) with host, path, rule and verdict.

    Rules are joined to the distinct (host, path) pairs, so a url that fills a third of the table is
    judged once; the small rule table is broadcast when Spark finds it small enough, and is
    shuffled on the hash prefix otherwise.
    """
    labels, slashes = depths(rules)
    host, path = host_and_path(F.col("url"))
    urls = urls.withColumns({"host": host, "path": path})
    pairs = urls.select("host", "path").where("host <> ''").distinct()
    expanded = _keyed(pairs.select("host", "path", F.explode(
        expressions(F.col("host"), F.col("path"), labels, slashes)).alias("expression")),
        F.col("expression"))
    index = rule_index(rules)
    fits = (expanded.alias("u").join(index.alias("r"), "short")
            .where((F.col("u.digest") == F.col("r.digest"))
                   & F.startswith(F.col("u.path"), F.col("r.rule_path")))
            .select("host", "path", F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("size"),
                F.length("rule_host").alias("host_size"), "verdict",
                F.concat("rule_host", "rule_path").alias("rule")).alias("fit")))
    best = fits.groupBy("host", "path").agg(F.max("fit").alias("fit"))
    return (urls.join(best, ["host", "path"], "left")
            .withColumns({"rule": F.col("fit.rule"),
                          "verdict": F.coalesce(F.col("fit.verdict"), F.lit(default))})
            .drop("fit"))


def rule_table(rules: list[tuple[str, str, str]], spark: SparkSession) -> DataFrame:
    """A rule table from (verdict, host, path) tuples, through Arrow so that Spark knows its size."""
    columns = list(zip(*rules)) or [(), (), ()]
    return spark.createDataFrame(pa.table({
        name: pa.array(values, pa.string())
        for name, values in zip(("verdict", "host", "path"), columns)}))
