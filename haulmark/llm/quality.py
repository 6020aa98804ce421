"""Quality rules for documents and for the hosts they come from.

A document fails the base rules with too few words, or with too many words in five-word windows that
repeat. Failures are counted by host; each host's failure rate is shrunk by a beta prior whose parameters
are fitted by the method of moments to the rates of the hosts that do not stand out (at most
``MAX_HOST_RATE``), so a bad host cannot loosen the prior that judges it. The prior weighs at most
``MAX_STRENGTH`` documents, so that with many alike hosts a host's own documents still count. A host is
rejected with all its documents when its rate lies above ``MAX_HOST_RATE`` by ``MARGIN`` posterior standard
deviations, that is, when most of its documents fail beyond doubt: a host with few documents is pulled to
the others' rate, one with many that fails a little more often than the rest keeps its clean documents.

Defined results: a null or empty text has no words and fails. A null host is a host of its own. With
no documents there are no hosts and no verdicts. Equal documents get equal results, repeated rows
each count once for their host.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_HOST_RATE = 0.5
MAX_STRENGTH = 100.0
MARGIN = 3.0
MEASURES = T.StructType([T.StructField(name, T.LongType()) for name in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
# The symbols counted, and the white space that separates words.
SYMBOLS = b"#*$%&|<>"
SPACE = b"\t\n\x0b\x0c\r "

_MIX = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = codes[:n].copy()
    for i in range(1, window):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + codes[i:n + i]
    order = np.argsort(mixed, kind="stable")
    equal = mixed[order[1:]] == mixed[order[:-1]]
    if not equal.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    covered = np.zeros(len(words), bool)
    for i in range(window):
        covered[i:n + i] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The measures of one text, in the order of ``MEASURES``."""
    raw = (text or "").encode()
    words = raw.split()  # bytes split at ASCII white space only
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (len(words), len(raw.translate(None, SPACE).decode()),
            len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words))


@F.pandas_udf(MEASURES)
def _measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([measure(t) for t in batch], columns=MEASURES.names, dtype="int64")


def base_failed(m: Column) -> Column:
    return ((m["n_words"] < MIN_WORDS)
            | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT))


def measured(docs: DataFrame, text: str = "text", into: str = "_m") -> DataFrame:
    """``docs`` with a struct of the measures."""
    return docs.withColumn(into, _measures(F.col(text)))


def rejected_hosts(judged: DataFrame, host: str, failed: str, max_rate: float = MAX_HOST_RATE,
                   fit_below: float = MAX_HOST_RATE) -> DataFrame:
    """Hosts whose failure rate lies credibly above ``max_rate``, with the shrunk rate and its lower bound.

    The prior is fitted to hosts with a rate of at most ``fit_below``. One row per host reaches the
    shuffle from each task; the prior's two moments, one row, go to the driver.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("bigint")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.where(rate <= fit_below).agg(F.avg(rate).alias("mean"),
                                                 F.var_samp(rate).alias("spread"))
    # Without spread between hosts, or with more than a beta distribution can have, the prior weighs
    # one document.
    row = moments.first()
    mean, spread = row["mean"] or 0.0, row["spread"] or 0.0
    room = mean * (1 - mean)
    strength = min(max(room / spread - 1, 1.0), MAX_STRENGTH) if 0 < spread < room else 1.0
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    deviation = F.sqrt(F.col("shrunk_rate") * (1 - F.col("shrunk_rate"))
                       / (F.col("n_docs") + strength + 1))
    return (hosts.withColumn("shrunk_rate", shrunk)
            .withColumn("lower_rate", F.col("shrunk_rate") - MARGIN * deviation)
            .where(F.col("lower_rate") > max_rate))


def verdicts(judged: DataFrame, host: str, failed: str,
             max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``judged`` with ``kept``: neither failed nor of a rejected host.

    ``judged`` is read twice, so pass a stored table. Only rejected hosts are joined back.
    """
    bad = rejected_hosts(judged, host, failed, max_rate).select(
        F.col("host").alias("_bad_host"), F.lit(True).alias("_bad"))
    return (judged.join(bad, F.col(host).eqNullSafe(F.col("_bad_host")), "left")
            .withColumn("kept", ~F.col(failed) & F.col("_bad").isNull())
            .drop("_bad_host", "_bad"))
