"""Benchmark decontamination: a positional inverted index, intersected from the rarest terms.

Benchmark items are cut into windows of ``WINDOW`` words, equal ones once. The corpus is counted term by
term; each window gets its ``ANCHORS`` rarest terms, and postings (term, text, position) are stored for
these terms alone, a few words in a hundred. The lists are then intersected, the rarest first, by the
start that a posting implies (position less the term's offset in the window):

1. the rarest term's postings propose (window, text, start);
2. the next anchors' lists are met at the offset-adjusted position, or up to ``SLACK`` words beside it;
3. in the texts that are left, and only there, all terms of the window are met the same way.

A window is an exact match where all its words stand in place. It is a proximity match, where it is no
exact one, if at least ``NEAR_SHARE`` of its words stand within ``SLACK`` words of their place (inserted,
lost or changed words). Both kinds need the anchors; an exact match always has them, so none is missed.

Everything is equi-joins of narrow rows. Lists are deduplicated by text content before they meet, so
neither a text copied a million times nor a passage that a third of all texts share makes a row wide:
the first is one text, the second many (text, position) keys. The window tables are as large as the
benchmark; Spark broadcasts them where their size allows and else shuffles.

Defined results: a null or empty text, or one without words, has no hits. Rows with the same text have the
same result, repeated rows each. An item without words has no windows; items that share an id are one,
items without an id are one, written ``null``. Texts and windows are told apart by 128-bit hashes. No
documents: no rows. No items: no hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm.text import text_of
from haulmark.session import staged

WINDOW = 10
ANCHORS = 2
SLACK = 3
NEAR_SHARE = 0.8
# Fixed value: the characters that separate words once A-Z are lower-cased, all of ASCII but 0-9 and a-z.
SEPARATORS = "".join(chr(c) for c in range(128) if chr(c) not in string.ascii_letters + string.digits)


def words_of(text: str = "text") -> Column:
    """The words, A-Z lower-cased."""
    plain = F.translate(text_of(text), string.ascii_uppercase + SEPARATORS,
                        string.ascii_lowercase + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def text_key(text: str = "text") -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(text_of(text)))


def windows_of(items: DataFrame, window: int = WINDOW, text: str = "text",
               item_id: str = "item_id") -> DataFrame:
    """(item, win, words): the windows of all items, with a 128-bit name for their content."""
    words = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"),
                         words_of(text).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    cut = words.where(F.size("all") > 0).select("item", F.explode(F.transform(
        starts, lambda s: F.slice("all", s, window))).alias("words"))
    return cut.select("item", F.unhex(F.md5(F.array_join("words", " "))).alias("win"), "words")


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): how often each of the distinct ``terms`` stands in the corpus, where it does.

    The corpus is counted before it meets the terms, so any number of them costs one pass.
    """
    found = docs.select(F.explode(words_of(text)).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n"))
    return found.join(terms, "term")


def anchored(windows: DataFrame, counts: DataFrame, share: float, anchors: int = ANCHORS
             ) -> DataFrame:
    """(win, words, anchors) of the windows of which at least ``share`` of the words stand in the corpus.

    ``anchors`` are structs (n, place, term) of the rarest words, rarest first, earlier place first; a
    window of fewer words repeats its rarest.
    """
    places = windows.select("win", "words", F.posexplode("words").alias("place", "term"))
    held = (places.join(counts, "term").groupBy("win").agg(
        F.first("words").alias("words"),
        F.array_sort(F.collect_list(F.struct("n", "place", "term"))).alias("terms")))  # one window
    chosen = F.slice("terms", 1, anchors)
    return held.where(F.size("terms") >= F.ceil(F.size("words") * share)).select(
        "win", "words", F.concat(chosen, F.array_repeat(
            F.get("terms", F.lit(0)), anchors - F.size(chosen))).alias("anchors"))


def postings(docs: DataFrame, terms: DataFrame | None = None, text: str = "text") -> DataFrame:
    """(text_key, term, pos) of every place of ``terms``, or of all terms, in the distinct texts."""
    # named before they are exploded: what stands beside a generator is computed for each of its rows
    words = docs.select(text_key(text).alias("text_key"), words_of(text).alias("words"))
    places = words.select("text_key", F.posexplode("words").alias("pos", "term"))
    return (places if terms is None else places.join(terms, "term", "left_semi")).distinct()


def _met(places: DataFrame, index: DataFrame, slack: int) -> DataFrame:
    """``places`` (text_key, term, at, others) that have a posting at most ``slack`` words beside ``at``,
    with the distance in ``off``, a row for each such posting.

    Both sides are cut into stretches of positions, so a term that fills a text meets few rows.
    """
    if not slack:
        return places.join(index.withColumnRenamed("pos", "at"), ["text_key", "term", "at"]).withColumn(
            "off", F.lit(0))
    width = 4 * slack + 1
    near = [F.floor((F.col("at") + k) / width) for k in (-slack, slack)]
    wanted = places.withColumn("stretch", F.explode(F.array_distinct(F.array(*near))))
    held = index.withColumn("stretch", F.floor(F.col("pos") / width))
    return (wanted.join(held, ["text_key", "term", "stretch"])
            .withColumn("off", F.abs(F.col("pos") - F.col("at")).cast("int"))
            .where(F.col("off") <= slack))


def _beside(proposed: DataFrame, anchors: DataFrame, index: DataFrame, slack: int) -> DataFrame:
    """``proposed`` (text_key, win, start, off) whose anchor (win, term, place) stands at most ``slack``
    words beside its place; ``off`` becomes the largest distance of any anchor so far."""
    wanted = proposed.withColumnRenamed("off", "before").join(anchors, "win").withColumn(
        "at", F.col("start") + F.col("place"))
    return _met(wanted, index, slack).groupBy("text_key", "win", "start").agg(
        F.greatest(F.max("before"), F.min("off")).alias("off"))


def _placed(candidates: DataFrame, windows: DataFrame, index: DataFrame, slack: int) -> DataFrame:
    """(text_key, win, start, n, found): how many of a window's words stand in place, or at most
    ``slack`` words beside it."""
    places = candidates.join(windows.select("win", "words"), "win").select(
        "text_key", "win", "start", F.size("words").alias("n"),
        F.posexplode("words").alias("place", "term")).withColumn(
        "at", F.col("start") + F.col("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place"))
    return _met(places, index, slack).groupBy("text_key", "win", "start", "n").agg(
        F.bit_count(F.bit_or(bit)).alias("found"))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = SLACK,
            share: float = NEAR_SHARE, text: str = "text", item_id: str = "item_id"
            ) -> tuple[DataFrame, DataFrame]:
    """Matches (text_key, win, start, n, exact) of windows in the distinct texts, and the windows
    (item, win, words) of all items. ``window`` is at most 62 words; a slack of 0 finds exact matches
    alone."""
    if not 1 <= window <= 62:
        raise ValueError("a window has 1 to 62 words")
    of_items = staged(windows_of(items, window, text, item_id).distinct(), "windows")
    distinct = of_items.select("win", "words").dropDuplicates(["win"])
    terms = staged(distinct.select(F.explode("words").alias("term")).distinct(), "terms")
    counts = term_counts(docs, terms, text)
    held = staged(anchored(distinct, counts, share if slack else 1.0), "anchored")
    rare = staged(held.select(F.explode("anchors.term").alias("term")).distinct(), "rare-terms")
    index = staged(postings(docs, rare, text), "postings")

    def anchor(k: int) -> DataFrame:
        chosen = F.get("anchors", F.lit(k))
        return staged(held.select("win", chosen["term"].alias("term"), chosen["place"].alias("place")),
                      "anchor")

    proposed = anchor(0).join(index, "term").select(
        "text_key", "win", (F.col("pos") - F.col("place")).alias("start"), F.lit(0).alias("off"))
    for k in range(1, ANCHORS):
        proposed = _beside(proposed, anchor(k), index, slack)
    candidates = staged(proposed, "candidates")
    texts = staged(candidates.select("text_key").distinct(), "texts")
    full = staged(postings(docs.select(F.col(text).alias("text")).join(
        texts, text_key("text") == F.col("text_key"), "left_semi")), "full-postings")
    exact = staged(_placed(candidates.where("off = 0"), held, full, 0)
                   .where("found = n").select("text_key", "win", "start", "n"), "exact")
    found = exact.withColumn("exact", F.lit(True))
    if slack:
        rest = candidates.join(exact, ["text_key", "win", "start"], "left_anti")
        near = _placed(rest, held, full, slack).where(F.col("found") >= F.ceil(F.col("n") * share))
        found = found.unionByName(near.select("text_key", "win", "start", "n",
                                              F.lit(False).alias("exact")))
    return staged(found, "matches"), of_items


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = SLACK,
         share: float = NEAR_SHARE, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit (words inside exact matches), items (ids with exact
    matches, sorted), near_items (ids with proximity matches only)."""
    found, of_items = matches(docs, items, window, slack, share, text, item_id)
    hits = (found.where("exact").select("text_key", F.explode(F.sequence(
        F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
        .groupBy("text_key").agg(F.count(F.lit(1)).alias("n_hit")))
    named = (found.groupBy("text_key", "win").agg(F.max("exact").alias("exact"))
             .join(of_items.select("win", "item").distinct(), "win")
             .groupBy("text_key", "item").agg(F.max("exact").alias("exact")))
    lists = named.groupBy("text_key").agg(  # as long as the answer
        F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"),
        F.sort_array(F.collect_list(F.when(~F.col("exact"), F.col("item")))).alias("near_items"))
    results = staged(lists.join(hits, "text_key", "left"), "results")
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"),
                       F.size(words_of(text)).cast("bigint").alias("n_words"))
    return rows.join(results, "text_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))
