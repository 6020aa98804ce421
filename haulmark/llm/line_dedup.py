"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find.

Every line that is not empty takes part; one shorter than a shingle is a shingle of its own, so only its
exact copies are dropped. Lines are stripped and equal ones share an id. Each distinct line gets one MinHash
value per bin of a one-permutation hash over its ``SHINGLE``-character shingles, empty bins filled from the
next; ``ROWS`` values make a band, and lines that share one of ``BANDS`` bands are candidates: at a similarity
of 0.8 a pair is missed with a probability below 0.4 % (below 0.1 % at 0.82). Candidates are verified by the
exact Jaccard similarity of their shingle sets, ``SIMILARITY`` or more. Distributed star steps give the
components, and of each component, copies included, the first line by (doc_id, row key, line number) is kept.

Verification in two rounds loses no candidate link and never lists a bucket's pairs: first every line
against one of its bucket, then, only in buckets that still hold lines of several components, all
pairs across components, in cells of bounded size. Sets are compared as sorted hashes, many pairs at once;
where a hash collision could decide, the shingles themselves do. Texts are fetched for candidates alone,
through a filter of fixed size (``FILTER_BITS``) that passes more lines, never fewer, when the corpus outgrows
it.

Identity: links are between 64-bit line ids. A copy is dropped only where 128 bits agree, and a line whose id
is that of another line (one in 2 * 10^7 at 10^12 distinct lines) is dropped as a copy but takes no part in
links: ``members_of`` compares the second half with the line that was verified. Documents are told apart by
128 bits of id and text.

Defined results: a null text stays null and has no lines. A text that loses all its lines becomes empty. Rows
with the same id and text are one document here and all keep what the first keeps. A column
``n_dropped_lines`` of the input is replaced, all others stay, whatever their names. No documents: no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm.components import SAMPLE, Labels, cells, connected, sorted_cells
from haulmark.llm.text import ROW_KEY, row_key
from haulmark.session import staged, staged_texts

SHINGLE = 8
ROWS = 3
BANDS = 8
SIMILARITY = 0.8
FILTER_BITS = 1 << 25
BATCH_CHARS = 1 << 15  # arrays of this size stay in the cache
OUT_CHARS = 1 << 21
SKETCH_BITS = 4096
CELL_ROWS = 4096  # rows of whole cells that are looked at together

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F,
                                         0x165667B19E3779F9, 0xD6E8FEB86659FD93))  # odd multipliers


def lines_of(text: str | None) -> Iterator[tuple[int, str, bytes]]:
    """(number, stripped line, 128 bits that name it) of the lines that take part."""
    for number, line in enumerate((text or "").split("\n")):
        line = line.strip()
        if line:
            yield number, line, xxhash.xxh3_128_digest(line.encode())


def halves(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids and second halves of 128-bit names, as longs."""
    both = np.frombuffer(b"".join(names), ">i8").astype(np.int64).reshape(-1, 2)
    return both[:, 1], both[:, 0]


def _hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the shingles of all lines, each as often as it occurs."""
    sizes = np.array([len(line) for line in lines], np.int64)
    padded = "".join(line + "\0" * (SHINGLE - 1) for line in lines)
    h = np.frombuffer(padded.encode("utf-32-le"), np.uint32).astype(np.uint64)
    for span, factor in ((1, _A), (2, _B), (4, _C)):  # hashes of 2, 4 and 8 characters
        h = h[:-span] * factor + h[span:]
    # A line's shingles lie inside it; one shorter than a shingle has the padded line alone.
    counts = np.maximum(sizes - SHINGLE + 1, 1)
    runs = np.stack([counts, sizes + SHINGLE - 1 - counts], 1).ravel()
    h = h[np.repeat(np.tile([True, False], len(lines)), runs)[:len(h)]]
    h ^= h >> np.uint64(32)
    h *= _D
    h ^= h >> np.uint64(29)
    return np.repeat(np.arange(len(lines), dtype=np.uint64), counts), h


def distinct(owner: np.ndarray, h: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's distinct hashes, owner after owner and sorted, of the top bits that are left beside
    the owner's number, with the positions at which the owners start and end."""
    bits = _owner_bits(owners)
    key = np.sort(owner << np.uint64(64 - bits) | h >> np.uint64(bits))
    key = key[np.append(True, key[1:] != key[:-1])[:len(key)]]
    marks = np.arange(owners, dtype=np.uint64) << np.uint64(64 - bits)
    return key, np.append(np.searchsorted(key, marks), len(key))


def _owner_bits(owners: int) -> int:
    return max(1, int(owners - 1).bit_length())


def signatures(lines: list[str]) -> np.ndarray:
    """A row of ``ROWS * BANDS`` MinHash values for each line."""
    bins = ROWS * BANDS
    owner, h = _hashed(lines)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    table = np.full(len(lines) * bins, empty)
    chosen = ((h >> np.uint64(40)) * np.uint64(bins)) >> np.uint64(24)
    np.minimum.at(table, (owner * np.uint64(bins) + chosen).view(np.int64), h)
    table = table.reshape(-1, bins)
    for _ in range(bins):
        holes = table == empty
        if not holes.any():
            break
        table = np.where(holes, np.where(np.roll(holes, -1, 1), empty,
                                         np.roll(table, -1, 1) * _A + _C), table)
    return table


def bands(lines: list[str]) -> np.ndarray:
    """A row of ``BANDS`` band keys for each line."""
    out = []
    for start, stop in _cut([len(line) for line in lines], BATCH_CHARS):
        table = signatures(lines[start:stop])
        key = np.arange(BANDS, dtype=np.uint64)[None, :] * _B
        for r in range(ROWS):
            key = (key ^ (key >> np.uint64(31))) * _C + table[:, r::ROWS]
        out.append((key ^ (key >> np.uint64(32))).view(np.int64))
    return np.concatenate(out or [np.zeros((0, BANDS), np.int64)])


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, key, text): ``key`` names a document by id and text."""
    return docs.select("doc_id", row_key("doc_id", text).alias("key"), F.col(text).alias("text"))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line; one in ``SAMPLE`` by name has its band keys in ``buckets``, once per few batches."""
    seen: set[bytes] = set()
    for batch in batches:
        if len(seen) > 1_000_000:
            seen.clear()
        at, numbers, names, sampled, some = [], [], [], [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            for number, line, name in lines_of(text):
                if name[-1] % SAMPLE == 0 and name not in seen:
                    seen.add(name)
                    sampled.append(len(at))
                    some.append(line)
                at.append(i)
                numbers.append(number)
                names.append(name)
        sizes = np.zeros(len(at) + 1, np.int32)
        sizes[np.array(sampled, np.int64) + 1] = BANDS
        buckets = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)),
                                           pa.array(bands(some).ravel()))
        at = pa.array(at, pa.int64())
        yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at),
                               pa.array(numbers, pa.int32()), *map(pa.array, halves(names)), buckets],
                              names=["doc_id", "key", "line", "node", "check", "buckets"])


def _distinct_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Names and texts of the lines, each once per few batches; memory stays bounded."""
    seen: set[bytes] = set()
    names, lines, size = [], [], 0
    for batch in batches:
        if len(seen) > 1_000_000:
            seen.clear()
        for text in batch.column(0).to_pylist():
            for _, line, name in lines_of(text):
                if name in seen:
                    continue
                seen.add(name)
                names.append(name)
                lines.append(line)
                size += len(line)
                if size > OUT_CHARS:
                    yield names, lines
                    names, lines, size = [], [], 0
    if names:
        yield names, lines


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for names, lines in _distinct_lines(batches):
        yield pa.record_batch([pa.array(bands(lines).ravel()),
                               pa.array(np.repeat(halves(names)[0], BANDS))],
                              names=["bucket", "node"])


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, node, first) of the nodes in cells with several."""
    rows = sorted_cells(batches)
    if rows is None:
        return
    values, cell, at, last = rows
    head = np.searchsorted(cell, cell, side="left")
    several = np.flatnonzero(last > head)
    for part in np.array_split(several, max(1, len(several) // 50_000)):
        yield pa.record_batch([pa.array(cell[part]), pa.array(values[at[part]]),
                               pa.array(values[at[head[part]]])], names=["cell", "node", "first"])


def shingles(line: str) -> set[str]:
    return {line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def similar(a: set[str], b: set[str]) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < SIMILARITY * large:
        return False
    common = len(a & b)
    return common >= SIMILARITY * (small + large - common)


def sketched(key: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each owner the set of ``SKETCH_BITS`` bits that its hashes set, then their number.

    The bits come from the top of the hashes, which does not depend on the number of owners.
    """
    n = len(spans) - 1
    sizes = np.diff(spans)
    top = (key << np.uint64(_owner_bits(n))) >> np.uint64(65 - SKETCH_BITS.bit_length())
    bits = np.zeros((n, SKETCH_BITS), bool)
    bits[np.repeat(np.arange(n), sizes), top] = True
    return np.column_stack([np.packbits(bits, axis=1).view(np.uint64), sizes.astype(np.uint64)])


def possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two sketches allow a similarity of ``SIMILARITY``; no similar pair fails.

    Each bit that differs stands for a shingle of its own that one line has alone. At a similarity s these
    are at most (1 - s) / (1 + s) of the sizes' sum.
    """
    apart = np.bitwise_count(x[..., :-1] ^ y[..., :-1]).sum(-1, dtype=np.int64)
    return apart * (1 + SIMILARITY) <= (x[..., -1] + y[..., -1]) * (1 - SIMILARITY) + 1e-6


def linked(key: np.ndarray, spans: np.ndarray, a: np.ndarray, b: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of owners are similar by their ``distinct`` hashes, and which are so near to the bound
    that a collision of two hashes could decide."""
    sizes = np.diff(spans)
    small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    at = np.flatnonzero(small >= SIMILARITY * large)
    similar_pair, near = np.zeros(len(a), bool), np.zeros(len(a), bool)
    bits = np.uint64(_owner_bits(len(spans) - 1))
    for part in np.array_split(at, max(1, int((small + large)[at].sum()) >> 21)):
        both = np.concatenate([a[part], b[part]])
        counts = sizes[both]
        place = np.arange(counts.sum()) + np.repeat(spans[both] - np.cumsum(counts) + counts, counts)
        pair = np.repeat(np.tile(np.arange(len(part)), 2), counts)
        shift = np.uint64(_owner_bits(max(1, len(part))))
        held = (key[place] << bits) >> max(bits, shift)
        merged = np.sort(pair.astype(np.uint64) << (np.uint64(64) - shift) | held)
        twice = merged[1:][merged[1:] == merged[:-1]] >> (np.uint64(64) - shift)
        common = np.bincount(twice.astype(np.int64), minlength=len(part))
        wanted = SIMILARITY * (small[part] + large[part] - common)
        similar_pair[part] = common >= wanted
        near[part] = np.abs(common - wanted) <= 2
    return similar_pair, near


def _line_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*_hashed(lines), len(lines))


def _cut(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum to ``most``, or of a single larger one."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def similar_pairs(contents: list, a: np.ndarray, b: np.ndarray, hashes: Callable, parts: Callable
                  ) -> np.ndarray:
    """Which pairs of ``contents``, by position, are similar."""
    sizes = np.array([len(c) for c in contents], np.int64)
    good = np.zeros(len(a), bool)
    for start, stop in _cut((sizes[a] + sizes[b]).tolist(), BATCH_CHARS):
        used, at = np.unique(np.concatenate([a[start:stop], b[start:stop]]), return_inverse=True)
        held = [contents[i] for i in used.tolist()]
        found, near = linked(*hashes(held), at[:stop - start], at[stop - start:])
        for i in np.flatnonzero(near).tolist():
            found[i] = similar(parts(contents[a[start + i]]), parts(contents[b[start + i]]))
        good[start:stop] = found
    return good


def _placed(nodes: list[int], contents: list) -> tuple[np.ndarray, list, dict[int, int]]:
    """Position of each node among the distinct ones, their contents, and the positions by node."""
    place: dict[int, int] = {}
    distinct_contents = []
    for node, content in zip(nodes, contents):
        if node not in place:
            place[node] = len(distinct_contents)
            distinct_contents.append(content)
    return np.array([place[n] for n in nodes], np.int64), distinct_contents, place


def _verify(batches: Iterator[pa.RecordBatch], hashes: Callable = _line_hashes,
            parts: Callable = shingles) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, content of a, content of b), sorted by a, the links (a, b)."""
    for batch in batches:
        a, b, x, y = (c.to_pylist() for c in batch.columns)
        at, contents, _ = _placed(a + b, x + y)
        good = np.flatnonzero(similar_pairs(contents, at[:len(a)], at[len(a):], hashes, parts))
        yield pa.record_batch([pa.array(np.array(c, np.int64)[good]) for c in (a, b)],
                              names=["a", "b"])


def _across(cells_at: np.ndarray, at: np.ndarray, labels: Labels, drawn: np.ndarray,
            test: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links that join all similar contents which share a cell, in bulk.

    ``at`` are positions of contents, sorted by ``cells_at``. A stretch of rows is compared with the rows
    before it in their cells. Of the pairs whose sketches allow it, first one for each content is tested,
    then twice as many, until every pair is tested or inside a component.
    """
    first = np.searchsorted(cells_at, cells_at, side="left")
    before = np.arange(len(at)) - first
    for start, stop in _cut(before.tolist(), 1 << 18):
        counts = before[start:stop]
        i = np.repeat(np.arange(start, stop), counts)
        j = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + first[i]
        a, b = at[i], at[j]
        apart = labels[a] != labels[b]
        a, b = a[apart], b[apart]
        fits = np.concatenate([possible(drawn[a[k:k + 8192]], drawn[b[k:k + 8192]])
                               for k in range(0, len(a), 8192)] or [np.zeros(0, bool)])
        a, b, most = a[fits], b[fits], 1
        while len(a):
            order = np.argsort(a, kind="stable")
            rank = np.arange(len(a)) - np.searchsorted(a[order], a[order], side="left")
            now = order[rank < most]
            good = test(a[now], b[now])
            x, y = a[now][good], b[now][good]
            labels.merge(x, y)
            yield x, y
            left = np.ones(len(a), bool)
            left[now] = False
            left &= labels[a] != labels[b]
            a, b, most = a[left], b[left], 2 * most


def _verify_cells(batches: Iterator[pa.RecordBatch], hashes: Callable = _line_hashes,
                  parts: Callable = shingles) -> Iterator[pa.RecordBatch]:
    """Of rows (cell, node, root, content), sorted by cell, links that join all similar contents of a
    cell. A node that stands in several cells at hand is looked at once."""
    def links(rows: list[list]) -> pa.RecordBatch:
        cell, nodes, roots, contents = rows
        at, contents, place = _placed(nodes, contents)
        labels = Labels(len(contents))
        _, group = np.unique(np.array(roots), return_inverse=True)
        head = np.full(group.max() + 1, len(contents))
        np.minimum.at(head, group, at)
        labels.merge(head[group], at)
        drawn = np.concatenate([sketched(*hashes(contents[i:j])) for i, j in _cut(
            [len(c) for c in contents], BATCH_CHARS)])
        found = list(_across(np.array(cell), at, labels, drawn, lambda a, b: similar_pairs(
            contents, a, b, hashes, parts)))
        names = np.array(list(place), np.int64)
        return pa.record_batch(
            [pa.array(names[np.concatenate([p[side] for p in found] or [np.zeros(0, np.int64)])])
             for side in (0, 1)], names=["a", "b"])

    held: list[list] = [[], [], [], []]
    for batch in batches:
        for kept, column in zip(held, batch.columns):
            kept += column.to_pylist()
        if len(held[0]) >= CELL_ROWS and held[0][0] != held[0][-1]:
            whole = bisect_left(held[0], held[0][-1])  # the last cell may go on
            yield links([kept[:whole] for kept in held])
            held = [kept[whole:] for kept in held]
    if held[0]:
        yield links(held)


def filter_of(nodes: DataFrame) -> bytes:
    """A bit for each node's hash value, at most ``FILTER_BITS`` of them (4 MB)."""
    slot = F.pmod(F.col("node"), F.lit(FILTER_BITS))
    words = (nodes.select(F.shiftright(slot, 5).cast("int").alias("word"),
                          F.pmod(slot, F.lit(32)).cast("int").alias("bit"))
             .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    table = np.zeros(FILTER_BITS >> 5, np.uint32)
    found = words.toArrow()
    table[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint32)
    return table.tobytes()


def may_hold(table: bytes, node: np.ndarray) -> np.ndarray:
    """Which nodes have their bit set in a table of ``filter_of``."""
    slot = node % FILTER_BITS
    return (np.frombuffer(table, np.uint32)[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, check, line) of the lines with the given ids, one per id."""
    held = docs.sparkSession.sparkContext.broadcast(filter_of(nodes))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, lines in _distinct_lines(batches):
            node, check = halves(names)
            keep = np.flatnonzero(may_hold(held.value, node))
            yield pa.record_batch([pa.array(node[keep]), pa.array(check[keep]),
                                   pa.array([lines[i] for i in keep], pa.string())],
                                  names=["node", "check", "line"])

    found = docs.select("text").mapInArrow(pick, "node bigint, check bigint, line string")
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(
        F.min_by(F.struct("check", "line"), "check").alias("held")).select("node", "held.*")


def line_links(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between ids of distinct similar lines of ``docs`` (text), and (node, check) of the
    lines that were compared. Large buckets show in the ``buckets`` of ``found``, the occurrences."""
    sample = found.select(F.explode("buckets").alias("bucket"), "node")
    compared = cells(docs.select("text").mapInArrow(_members, "bucket bigint, node bigint"), sample)
    found = staged_texts(compared.repartition("cell").mapInArrow(
        candidates, "cell bigint, node bigint, first bigint"), "candidates")
    lines = staged_texts(_texts(docs, found.select("node").distinct()), "lines")
    return (verified_links(found, lines.select("node", "line"), _verify, _verify_cells),
            lines.select("node", "check"))


def verified_links(found: DataFrame, lines: DataFrame, verify: Callable, verify_cells: Callable
                   ) -> DataFrame:
    """The links (a, b) among candidates ``found`` (cell, node, first) with content ``lines`` (node, line)."""
    stars = found.where("node <> first").select(F.col("first").alias("a"),
                                                F.col("node").alias("b")).distinct()
    wide = (stars.join(lines.toDF("b", "y"), "b").join(lines.toDF("a", "x"), "a")
            .select("a", "b", "x", "y"))
    links = staged(wide.mapInArrow(verify, "a bigint, b bigint"), "links")

    # Two steps towards the smallest neighbour settle nearly all cells; what they leave is compared.
    once = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
    twice = once.join(once.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left")
    near = twice.select("node", F.coalesce("top", "up").alias("root"))
    labelled = staged(found.select("cell", "node").join(near, "node", "left").select(
        "cell", "node", F.coalesce("root", "node").alias("root")), "labelled")
    # a cell of two was settled by its star
    mixed = labelled.groupBy("cell").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")
    ).where("low <> high and n > 2").select("cell")
    rest = (labelled.join(mixed, "cell", "left_semi").join(lines, "node")
            .select("cell", "node", "root", "line").repartition("cell").sortWithinPartitions("cell"))
    return links.unionByName(staged(rest.mapInArrow(verify_cells, "a bigint, b bigint"), "links"))


def members_of(links: DataFrame, compared: DataFrame) -> DataFrame:
    """(node, check, root) of the contents in components of several.

    Links name contents by 64 bits; only the content that was compared under that name gets the root.
    """
    return connected(links).join(compared, "node").select("node", "check", "root")


def _drops(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, key, line) of every line that repeats an earlier line of its component, once per row."""
    keyed = _keyed(docs, text)
    found = staged_texts(keyed.mapInArrow(
        _occurrences, f"doc_id bigint, key {ROW_KEY}, line int, node bigint, check bigint, "
        "buckets array<bigint>"), "occurrences")
    roots = members_of(*line_links(keyed, found))
    own = F.when(F.col("root").isNull(), F.col("check"))
    wanted = staged(
        found.groupBy("node", "check").agg(F.count(F.lit(1)).alias("n"))
        .join(roots, ["node", "check"], "left").where("n > 1 or root is not null")
        .select("node", "check", F.coalesce("root", "node").alias("root"), own.alias("own")), "nodes")
    placed = staged(found.drop("buckets").join(wanted, ["node", "check"])
                    .select("root", "own", F.struct("doc_id", "key", "line").alias("at")), "repeated")
    keepers = placed.groupBy("root", "own").agg(F.min("at").alias("keeper")).select(
        F.col("root").alias("r"), F.col("own").alias("o"), "keeper")
    same = (F.col("root") == F.col("r")) & F.col("own").eqNullSafe(F.col("o"))
    return placed.join(keepers, same).where(~F.col("at").eqNullSafe(F.col("keeper"))).select("at.*")


def dropped_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, key, line) of every line that repeats an earlier line of its component."""
    return _drops(docs, text).distinct()


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the repeated lines, with their number in ``n_dropped_lines``.

    Texts meet their line numbers by a hash table of the latter, which are few, so that no text is sorted.
    """
    drops = _drops(docs, text).groupBy("key").agg(F.collect_set("line").alias("gone"))
    kept = [c for c in docs.columns if c != "n_dropped_lines"]
    rows = docs.select(F.struct(*kept).alias("row"), row_key("doc_id", text).alias("key"))
    joined = rows.join(drops.hint("shuffle_hash"), "key", "left")
    content = F.col("row").getField(text)

    def without(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    # a lambda's variable holds the lines: an expression would be split again for each of them
    cleaned = F.get(F.transform(F.array(F.split(content, "\n")), without), F.lit(0))
    some = F.col("gone").isNotNull()
    return joined.select(
        *[(F.when(some, cleaned).otherwise(content) if c == text else F.col("row").getField(c)).alias(c)
          for c in kept],
        F.when(some, F.size("gone")).otherwise(0).cast("bigint").alias("n_dropped_lines"))
