"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every file is addressed by the SHA-256 of its text. A version whose (blob, rule
version) pair is in the ledger is not scanned again; each other blob is scanned once, however many
paths hold it, and the findings are joined back to all paths. Copies are reduced on the map side
before the shuffle, so a blob that a third of all files hold is no hot key.

Findings of a blob are the spans of each kind: leftmost, not overlapping within the kind, in code
points, end exclusive. Defined results: a null text is the empty blob, which has no spans. Spans are
ordered by start, then by kind in the order of ``KINDS``. A pem span covers the key's body.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulmark.llm.text import text_of

# The base kinds' patterns.
ASSIGN = (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

BASE_KINDS = ("assign", "access", "hex")
# A key ends with its END line, before which no other such line stands. Without one it ends with its
# base64 body: header lines, then long runs or runs alone on their line. Line ends may be escaped.
_END = r"(?:[^-]|-(?!----))*+-----END (?:[A-Z]+ )*PRIVATE KEY-----"
_BREAK = r"(?:[ \t]*(?:\r?\n|\\r|\\n))"
_BODY = (rf"(?:{_BREAK}[ \t]*[A-Z][A-Za-z-]*:[^\n\\]*+)*+"
         rf"(?:(?:\s|\\[rn])++[A-Za-z0-9+/]{{32,}}+={{0,2}}"
         rf"|{_BREAK}++[ \t]*[A-Za-z0-9+/]++={{0,2}}(?={_BREAK}|[ \t]*(?:[\"']|\Z)))*+")
# Published forms of keys and tokens, scanned besides the base kinds.
MORE = {
    "pem": rf"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:{_END}|{_BODY})",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{36,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "url_login": r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]++:[^\s/:@]{3,}+@",
}
KINDS = BASE_KINDS + tuple(MORE)
RULE_VERSION = hashlib.sha256("\n".join((ASSIGN, ACCESS, HEX, *MORE.values())).encode()
                              ).hexdigest()[:16]
FINDINGS = ("blob string, rule_version string, n_assign bigint, n_access bigint, n_hex bigint, "
            "base_sha256 string, spans string")

_assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
# A run is matched whole or not at all, so the least lengths may stand in the patterns.
_access = re.compile(r"AKIA[A-Z0-9]{14,}")
_hex = re.compile(r"[0-9a-f]{16,}")
_more = [(kind, re.compile(pattern)) for kind, pattern in MORE.items()]


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), ordered by start and kind."""
    # The value's alphabet holds the group's upper and lower letters anyway; only the name's case
    # is free.
    spans = [("assign", m.start(), m.end()) for m in _assign.finditer(text)
             if m.end(2) - m.start(2) >= 12]
    spans += [("access", m.start(), m.end()) for m in _access.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in _hex.finditer(text)]
    for kind, pattern in _more:
        spans += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs, counts, digests, found = batch.column(0), [], [], []
        for text in batch.column(1).to_pylist():
            spans = find_spans(text)
            base = [s for s in spans if s[0] in BASE_KINDS]
            counts.append([sum(s[0] == k for s in base) for k in BASE_KINDS])
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            found.append(_joined(spans))
        yield pa.record_batch([
            blobs, pa.array([RULE_VERSION] * len(blobs), pa.string()),
            *[pa.array([c[i] for c in counts], pa.int64()) for i in range(3)],
            pa.array(digests, pa.string()), pa.array(found, pa.string())],
            names=["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def addressed(files: DataFrame, text: str = "text") -> DataFrame:
    """``files`` with the content address of the text in ``blob``."""
    return files.withColumn("blob", F.sha2(text_of(text), 256))


def scan_unseen(files: DataFrame, ledger: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Ledger entries (columns of ``FINDINGS``) of the blobs that this rule version has not seen.

    Append the result to the ledger table; a rerun after that scans nothing.
    """
    blobs = addressed(files, text).select("blob", text_of(text).alias("content"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
        blobs = blobs.join(seen, "blob", "left_anti")
    once = blobs.groupBy("blob").agg(F.first("content").alias("content"))
    return once.mapInArrow(_scan, FINDINGS)


def report(files: DataFrame, ledger: DataFrame, text: str = "text") -> DataFrame:
    """``files`` with the ledger's findings of their blobs under this rule version."""
    found = (ledger.where(F.col("rule_version") == RULE_VERSION).drop("rule_version")
             .dropDuplicates(["blob"]))
    return addressed(files, text).join(found, "blob", "left")
