"""Cross-tokenizer alignment: groups and links of the tokens that two vocabularies give one text.

Tokenizer A (byte-level BPE) encodes a space and the text, B (pieces with byte fallback) the text, to which
it adds the space, so both cover the same bytes. Tokens that overlap belong together; the components of
that relation are the groups. They come from pointer jumping: every token points to the farthest-right
token that it overlaps (of A and B tokens with one end the B token counts as farther), and successors are
doubled, ``next = next[next]`` on whole arrays, until nothing moves: every token then points to its
component's terminal token, which labels the group.

Both vocabularies start a new token at a space between two other characters, so a text is cut there into
chunks, and chunks repeat: each distinct one of a unit of documents (``UNIT_CHARS``) is encoded, joined
and linked once. A unit keeps its documents as lists of chunk numbers and its distinct id pairs with their
number of links. Pairs are summed over the corpus, a row per unit and pair, each B id's highest count is
taken, and the counts return to their unit the same way; then every document is summed from its chunks. No
document's links are ever rows.

Defined results: a null or empty text, or one whose joined bytes of A or of B differ from space and text,
has no tokens: zeros and an empty digest. Special tokens' strings are plain text. Rows may repeat and ids be
null; each row is a document. No documents: no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.session import staged

A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
UNIT_CHARS = 4 << 20
KNOWN_CHUNKS = 300_000  # of a worker's memory of encoded chunks
# A space between two characters that are neither white space nor look like it to either vocabulary.
CUT = re.compile(r"(?<=[^\s\u2581\u180e\u200b\ufeff]) (?=[^\s\u2581\u180e\u200b\ufeff])")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_values() -> dict[str, int]:
    """Letters of a byte-level vocabulary to bytes: printable bytes stand for themselves, the others
    follow from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(printable))
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoders:
    """The two vocabularies with the bytes of their tokens, and a bounded table of encoded chunks."""

    def __init__(self, a_file: str, b_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(_path(a_file))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=_path(b_file))
        letters = byte_values()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(
                c in letters for c in token) else token.encode()
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.sizes = [np.array([len(x) for x in held], np.int64)
                      for held in (self.a_bytes, self.b_bytes)]
        # decimal ids with what follows them, by 2 * (is B) + (is last of its side), then id
        self.names = [[f"{i}{mark}".encode() for i in range(len(held))]
                      for held, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))
                      for mark in marks]
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def encode(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of A and of B as 16-bit integers, None where their bytes are not a space and the chunk."""
        if len(self.known) > KNOWN_CHUNKS:
            self.known.clear()
        fresh = [c for c in chunks if c not in self.known]
        for at in range(0, len(fresh), 4096):
            part = fresh[at:at + 4096]
            spaced = [" " + c for c in part]
            of_a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
            of_b = self.b.encode(part, num_threads=1)
            for chunk, text, a, b in zip(part, spaced, of_a, of_b):
                wanted = text.encode()
                same = (b"".join([self.a_bytes[i] for i in a]) == wanted
                        and b"".join([self.b_bytes[i] for i in b]) == wanted)
                self.known[chunk] = (np.array(a, "<u2").tobytes(), np.array(b, "<u2").tobytes()) \
                    if same else None
        return [self.known[c] for c in chunks]


@lru_cache(maxsize=1)
def encoders(a_file: str, b_file: str) -> Encoders:
    return Encoders(a_file, b_file)


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), ends])[:-1]


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For each A token, then each B token, the number of its group's terminal B token.

    Ends are byte offsets, both sides cover the same bytes, no token is empty.
    """
    n = len(a_ends)
    a_starts, b_starts = _starts(a_ends), _starts(b_ends)
    last_b = np.searchsorted(b_starts, a_ends, side="left") - 1
    last_a = np.searchsorted(a_starts, b_ends, side="left") - 1
    own = n + np.arange(len(b_ends))
    following = np.concatenate([n + last_b, np.where(a_ends[last_a] > b_ends, last_a, own)]) \
        if n else own
    while True:
        farther = following[following]
        if np.array_equal(farther, following):
            return following - n
        following = farther


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (A token, B token) whose byte ranges overlap, by A token."""
    first = np.searchsorted(b_ends, _starts(a_ends), side="right")
    last = np.searchsorted(_starts(b_ends), a_ends, side="left") - 1
    count = last - first + 1
    a = np.repeat(np.arange(len(a_ends)), count)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _spans(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _sums(values: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Sums of the values between neighbouring ``spans``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[spans[1:]] - total[spans[:-1]]


class Chunks:
    """The distinct chunks of a unit: tokens, groups, links."""

    def __init__(self, texts: list[str], held: Encoders):
        ids = held.encode(texts)
        self.good = np.array([x is not None for x in ids], bool)
        a, b = (np.frombuffer(b"".join([x[side] for x in ids if x]), "<u2").astype(np.int64)
                for side in (0, 1))
        self.n_a, self.n_b = (np.array([len(x[side]) // 2 if x else 0 for x in ids], np.int64)
                              for side in (0, 1))
        a_ends, b_ends = np.cumsum(held.sizes[0][a]), np.cumsum(held.sizes[1][b])
        terminal = terminals(a_ends, b_ends)
        self.n_groups = _sums(terminal[len(a):] == np.arange(len(b)), _spans(self.n_b))
        # tokens in order of their groups, A before B
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(terminal * 2 + side, kind="stable")
        key = (terminal * 2 + side)[order]
        last = np.append(key[1:] != key[:-1], True)[:len(key)]
        names = [held.names[k][i] for k, i in zip((side[order] * 2 + last).tolist(),
                                                  np.concatenate([a, b])[order].tolist())]
        spans = _spans(self.n_a + self.n_b).tolist()
        self.groups = [b"".join(names[x:y]) for x, y in zip(spans, spans[1:])]
        at_a, at_b = overlaps(a_ends, b_ends)
        self.n_links = np.bincount(np.repeat(np.arange(len(texts)), self.n_a)[at_a],
                                   minlength=len(texts)).astype(np.int64)
        self.pairs, self.link_pairs = np.unique(a[at_a] << 16 | b[at_b], return_inverse=True)


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as two planes of 16 bits; the high one is nearly empty."""
    halves = numbers.astype("<u4").view("<u2").reshape(-1, 2)
    return np.ascontiguousarray(halves.T).tobytes()


def _unpacked(held: bytes) -> np.ndarray:
    halves = np.frombuffer(held, "<u2").reshape(2, -1).astype(np.int64)
    return halves[0] | halves[1] << 16


FIELDS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
          ("groups", pa.string()), ("chunks", pa.binary()), ("pairs", pa.binary()),
          ("pair_links", pa.binary()), ("link_pairs", pa.binary()), ("chunk_links", pa.binary())]


def _unit(ids: pa.Array, texts: list[str | None], unit: int, held: Encoders, digest: bool
          ) -> pa.RecordBatch:
    """A row per document, then the row of the unit."""
    local: dict[str, int] = {}
    rows = [[local.setdefault(c, len(local)) for c in CUT.split(t)] if t else [] for t in texts]
    made = Chunks(list(local), held)
    flat = np.array([c for row in rows for c in row], np.int64)
    spans = _spans(np.array([len(row) for row in rows], np.int64))
    good = (_sums(~made.good[flat], spans) == 0) & (np.diff(spans) > 0)
    counts = [np.where(good, _sums(x[flat], spans), 0)
              for x in (made.n_a, made.n_b, made.n_groups, made.n_links)]
    times = np.bincount(flat[np.repeat(good, np.diff(spans))], minlength=len(local))
    links = np.bincount(made.link_pairs, np.repeat(times, made.n_links), minlength=len(made.pairs))
    groups, chunks = [], []
    for row, fine in zip(rows, good.tolist()):
        text = b"".join([made.groups[c] for c in row])[:-1] if fine else b""
        groups.append(hashlib.sha256(text).hexdigest() if digest and fine else text.decode())
        chunks.append(_packed(np.array(row if fine else [], np.int64)))
    own = [links.astype("<i8").tobytes(), _packed(made.link_pairs), _packed(made.n_links)]
    columns = [[*x.tolist(), 0] for x in counts] + [groups + [None], chunks + [None]]
    columns += [[None] * len(rows) + [x] for x in (_packed(made.pairs), *own)]
    return pa.record_batch(
        [pa.array([unit] * (len(rows) + 1), pa.int64()), pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
         *[pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)]],
        names=["unit", "doc_id", *[n for n, _ in FIELDS]])


def _encoded(a_file: str, b_file: str, digest: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unit = encoders(a_file, b_file), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids.append(batch.column(0).slice(i, 1))
                texts.append(text)
                size += len(text or "")
                if size >= UNIT_CHARS:
                    yield _unit(pa.concat_arrays(ids), texts, unit, held, digest)
                    ids, texts, size, unit = [], [], 0, unit + 1
        if texts:
            yield _unit(pa.concat_arrays(ids), texts, unit, held, digest)

    return encode


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, place, pair, links) of each unit's pairs that have links."""
    for batch in batches:
        for unit, pairs, links in zip(*(c.to_pylist() for c in batch.columns)):
            counts = np.frombuffer(links, "<i8")
            place = np.flatnonzero(counts)
            yield pa.record_batch(
                [pa.array(np.full(len(place), unit)), pa.array(place.astype(np.int32)),
                 pa.array(_unpacked(pairs)[place]), pa.array(counts[place])],
                names=["unit", "place", "pair", "links"])


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair over the corpus, and whether no pair of its B id has
    more. A pair is A's id times 65536 plus B's; each unit has sent it once."""
    counts = staged(rows.groupBy("pair").agg(F.sum("links").alias("count")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit(65535))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.join(most, b == F.col("b")).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _summed(rows: pa.Table, counted: pa.Table) -> pa.Table:
    """A unit's documents with the sums over their links."""
    unit = rows.filter(pc.is_valid(rows["pairs"])).to_pylist()[0]
    count = np.zeros(len(_unpacked(unit["pairs"])), np.int64)
    best = np.zeros(len(count), np.int64)
    place = counted["place"].to_numpy()
    count[place], best[place] = counted["count"].to_numpy(), counted["best"].to_numpy()
    link_pairs, spans = _unpacked(unit["link_pairs"]), _spans(_unpacked(unit["chunk_links"]))
    of_chunk = [_sums(x[link_pairs], spans) for x in (count, best)]
    docs = rows.filter(pc.is_null(rows["pairs"]))
    chunks = [_unpacked(x) for x in docs["chunks"].to_pylist()]
    flat = np.concatenate([np.zeros(0, np.int64), *chunks])
    spans = _spans(np.array([len(c) for c in chunks], np.int64))
    sums = [_sums(x[flat], spans) for x in of_chunk]
    out = docs.select(["doc_id", *COUNTS])
    return (out.append_column("n_best", pa.array(sums[1])).append_column("count_sum", pa.array(sums[0]))
            .append_column("groups", docs["groups"]))


def aligned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_file: str = A_FILE,
            b_file: str = B_FILE, digest: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair's count is the
    highest of its B id), count_sum (of the pairs' counts, over links), and ``groups``, ids as
    ``a1,a2|b1;a3|b2,b3`` or with ``digest`` their SHA-256.

    ``a_file`` and ``b_file`` are paths on every executor, or names of the installed public vocabularies.
    Both have fewer than 65,536 ids.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    numbers = ", ".join(f"{c} bigint" for c in COUNTS)
    blobs = "chunks binary, pairs binary, pair_links binary, link_pairs binary, chunk_links binary"
    units = staged(docs.select(doc_id, text).mapInArrow(
        _encoded(a_file, b_file, digest),
        f"unit bigint, doc_id {kind}, {numbers}, groups string, {blobs}"), "units")
    rows = units.where("pairs is not null").select("unit", "pairs", "pair_links").mapInArrow(
        _pair_rows, "unit bigint, place int, pair bigint, links bigint")
    scored = staged(pair_counts(rows), "scored-pairs")
    back = rows.select("unit", "place", "pair").join(scored, "pair").select(
        "unit", "place", "count", "best")
    return units.groupBy("unit").cogroup(back.groupBy("unit")).applyInArrow(
        _summed, f"doc_id {kind}, {numbers}, n_best bigint, count_sum bigint, groups string")
