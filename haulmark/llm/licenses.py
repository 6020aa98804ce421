"""Licence scans: a positional index of the rarest words of licence templates.

Each template's highest-IDF words (over the templates) are indexed with their positions. A file's
words that are in the index meet the template postings; hits with the same relative position
(file position minus template position) belong to one placement of the template. A placement counts
when its hits carry at least ``share`` of the template's indexed IDF weight and the template's
mandatory key phrase stands at its place word by word. Every step works on the arrays of one row, so
nothing is shuffled, a licence text that a third of all files carry is no hot key, and repeated or
null ids do no harm. The index is a constant of a few dozen postings.

Defined results: a null or empty text has no words, no labels and score 0. Files with the same text
get the same result.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm.text import ascii_lower, text_of

# The phrases of the base scan, and opening words of public licence notices with the
# phrase that must be present, as (label, words, key phrase).
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"),
           ("cc-by-nc", "cc by nc"))
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files the software to deal in the software "
            "without restriction", "free of charge to any person obtaining a copy"),
    ("mit", "released under the mit license", "the mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met",
     "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or "
            "without fee is hereby granted", "with or without fee is hereby granted"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms "
            "of the gnu general public license as published by the free software foundation",
     "gnu general public license"),
    ("gpl-3", "licensed under the gnu general public license version 3",
     "gnu general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "mozilla public license v 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     "creative commons attribution 4"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "released into the public domain"),
)
INDEXED_WORDS = 6
SHARE = 0.6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BASE = 1 << 31  # relative positions are stored above this offset


@dataclass(frozen=True)
class Posting:
    ordinal: int
    template: int
    word: str
    position: int
    weight: float


def postings(templates=TEMPLATES, indexed: int = INDEXED_WORDS) -> list[Posting]:
    """The positions of each template's highest-IDF words; weights of a template sum to 1."""
    words = [t[1].split() for t in templates]
    found = Counter(w for ws in words for w in set(ws))
    out: list[Posting] = []
    for t, ws in enumerate(words):
        idf = {w: 1.0 + math.log(len(words) / found[w]) for w in ws}
        rare = sorted(set(ws), key=lambda w: (-idf[w], ws.index(w)))[:indexed]
        places = [(i, w) for i, w in enumerate(ws) if w in rare]
        total = sum(idf[w] for _, w in places)
        out += [Posting(len(out) + k, t, w, i, round(idf[w] / total, 9))
                for k, (i, w) in enumerate(places)]
    return out


def key_offset(template: tuple[str, str, str]) -> int:
    """Word position of the key phrase in its template."""
    words, key = template[1].split(), template[2].split()
    return next(i for i in range(len(words)) if words[i:i + len(key)] == key)


def normalised(text: Column) -> Column:
    """The words, A-Z lower-cased, each between single spaces; one space when there are none."""
    body = F.regexp_replace(ascii_lower(text), SEPARATORS, " ")
    body = F.when(F.startswith(body, F.lit(" ")), body).otherwise(F.concat(F.lit(" "), body))
    return F.when(F.endswith(body, F.lit(" ")), body).otherwise(F.concat(body, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _base(norm: str, n: str) -> dict[str, Column]:
    """Counts, first and last places of the base phrases in the normalised text."""
    text = F.col(norm)
    counts, firsts, lasts, labels = [], [], [], []
    for label, phrase in PHRASES:
        size, there = len(phrase.split()), F.contains(text, F.lit(f" {phrase} "))
        counts.append(F.when(there, F.regexp_count(text, F.lit(f"(?<= ){phrase}(?= )")))
                      .otherwise(0).cast("bigint"))
        before = F.substring(text, 1, F.locate(f" {phrase} ", text))
        after = F.substring_index(text, f" {phrase} ", -1)
        firsts.append(F.when(there, _spaces(before) - 1))
        lasts.append(F.when(there, F.col(n) - _spaces(after) - size))
        labels.append(F.when(there, F.lit(label)))
    return {"n_base": sum(counts[1:], counts[0]),
            "first_word": F.least(*firsts).cast("bigint"),
            "last_word": F.greatest(*lasts).cast("bigint"),
            "_base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))}


def _placements(norm: str) -> Column:
    """array<struct<label, score>>: verified placements of templates in the normalised text."""
    index = postings()
    vocabulary = sorted({p.word for p in index})
    at = {w: [p for p in index if p.word == w] for w in vocabulary}

    def hits_of(word: Column, place: Column) -> Column:
        """Postings of a word as longs: template, relative position and ordinal."""
        codes = F.create_map(*[x for w in vocabulary for x in (F.lit(w), F.array(*[
            F.lit((p.template << 48) | ((_BASE - p.position) << 12) | p.ordinal) for p in at[w]]))])
        return F.transform(codes[word], lambda c: c + F.shiftleft(place.cast("bigint"), 12))

    def rare(words: Column) -> Column:
        placed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        return F.filter(placed, lambda x: x["w"].isin(vocabulary))

    def with_hits(words: Column, codes: Column) -> Column:
        starts = F.filter(
            F.transform(codes, lambda c, i: F.when(
                (i == 0) | (F.shiftright(F.get(codes, i - 1), 12) != F.shiftright(c, 12)), i)),
            lambda i: i.isNotNull())
        weights = F.array(*[F.lit(p.weight) for p in index])

        def score(start: Column, k: Column) -> Column:
            run = F.slice(codes, start + 1, F.coalesce(F.get(starts, k + 1), F.size(codes)) - start)
            return F.aggregate(run, F.lit(0.0), lambda s, c: s + F.get(
                weights, c.bitwiseAND(F.lit(4095)).cast("int")))

        def place(start: Column, k: Column) -> Column:
            code = F.get(codes, start)
            template = F.shiftright(code, 48).cast("int")
            origin = (F.shiftright(code, 12).bitwiseAND(F.lit((1 << 36) - 1)) - _BASE).cast("int")
            checks = F.lit(False)
            for t, spec in enumerate(TEMPLATES):
                key, first = spec[2].split(), origin + key_offset(spec)
                found = (first >= 0) & F.coalesce(F.array_join(
                    F.slice(words, F.greatest(first, F.lit(0)) + 1, len(key)), " ")
                    == " ".join(key), F.lit(False))
                checks = F.when(template == t, found).otherwise(checks)
            return F.struct(
                F.get(F.array(*[F.lit(t[0]) for t in TEMPLATES]), template).alias("label"),
                score(start, k).alias("score"), checks.alias("verified"))

        return F.filter(F.transform(starts, place),
                        lambda p: (p["score"] >= SHARE - 1e-6) & p["verified"])

    words = F.split(F.substring(F.col(norm), 2, F.length(norm)), " ")
    # lambda variables name each intermediate array once
    named = F.transform(F.array(words), lambda ws: F.transform(
        F.array(F.sort_array(F.flatten(F.transform(rare(ws), lambda x: hits_of(x["w"], x["i"]))))),
        lambda codes: with_hits(ws, codes)))
    some = F.col(norm).rlike(" (" + "|".join(vocabulary) + ") ")
    return F.when(some, F.flatten(F.flatten(named))).otherwise(
        F.array().cast("array<struct<label:string,score:double,verified:boolean>>"))


def scan(files: DataFrame, text: str = "text") -> DataFrame:
    """``files`` with n_words, the base phrases' places and labels, all labels and a score.

    ``score`` is 1 where a base phrase stands, else the best verified placement's share of its
    template's IDF weight, else 0.
    """
    out = files.withColumn("_norm", normalised(text_of(text)))
    out = out.withColumn("n_words", (_spaces(F.col("_norm")) - 1).cast("bigint"))
    out = out.withColumns(_base("_norm", "n_words") | {"_found": _placements("_norm")})
    labels = F.array_sort(F.array_union("_base", F.transform("_found", lambda p: p["label"])))
    best = F.coalesce(F.array_max(F.transform("_found", lambda p: p["score"])), F.lit(0.0))
    return out.withColumns({
        "base_labels": F.array_join("_base", ","), "labels": F.array_join(labels, ","),
        "score": F.when(F.size("_base") > 0, 1.0).otherwise(F.round(F.least(best, F.lit(1.0)), 6)),
    }).drop("_norm", "_base", "_found")
