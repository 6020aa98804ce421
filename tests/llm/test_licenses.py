import re

from haulmark.llm import licenses
from haulmark.llm.queries import QUERIES

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2",
           "cc-by-nc": "cc by nc"}


def words_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(text):
    words, places, labels = words_of(text), [], set()
    for label, phrase in PHRASES.items():
        parts = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))


def placements(text):
    """The method by a plain reading: weight of indexed words on each relative position."""
    words, found = words_of(text), {}
    for p in licenses.postings():
        for i, w in enumerate(words):
            if w == p.word:
                key = (p.template, i - p.position)
                found[key] = found.get(key, 0.0) + p.weight
    labels, score = set(), 0.0
    for (t, origin), weight in found.items():
        spec = licenses.TEMPLATES[t]
        at, key = origin + licenses.key_offset(spec), spec[2].split()
        if weight >= licenses.SHARE - 1e-6 and at >= 0 and words[at:at + len(key)] == key:
            labels.add(spec[0])
            score = max(score, min(weight, 1.0))
    return labels, score


TEXTS = [
    "cc by nc cc by nc by nc cc-by-nc", "Under the MIT  License;under THE mit license",
    "apache license, version 2.0 apache license version 2", "under the mit licensee", "mit", "",
    "Kunder the mit license İ under the mıt license", " cc by nc", "cc by nc ", "é cc by nc é",
    "license " * 3000,
] + [" ".join(["before"] * k + [t[1].title()] + ["after"]) for k, t in enumerate(
    licenses.TEMPLATES)] + [t[1].replace("the", "a") for t in licenses.TEMPLATES]


def test_scan_equals_brute_force(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    for r in licenses.scan(frame).collect():
        text = TEXTS[r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"],
                r["base_labels"]) == brute(text), text
        base, (more, score) = set(filter(None, r["base_labels"].split(","))), placements(text)
        assert r["labels"] == ",".join(sorted(base | more)), text
        assert abs(r["score"] - (1.0 if base else score)) < 1e-5


def test_query(spark, small, documents):
    rows = QUERIES["op8_license_scan"](spark, small).collect()
    assert len(rows) == len(documents)
    for r in rows:
        text = documents[r["doc_id"]]["text"]
        assert tuple(r)[1:6] == brute(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_odd_rows(spark, odd_rows):
    rows = licenses.scan(odd_rows).collect()
    assert len(rows) == odd_rows.count()
    assert all(r["labels"] == "" and r["score"] == 0 and r["first_word"] is None for r in rows)
    assert licenses.scan(odd_rows.limit(0)).count() == 0
