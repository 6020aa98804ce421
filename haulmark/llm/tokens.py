"""Token ids of whole texts by a public vocabulary, at corpus speed.

The vocabulary drops white space and never joins across it, so a text's ids are the ids of its chunks
between spaces, and chunks repeat. Ids of chunks are kept in a bounded table per worker; only chunks
that are not there reach the tokenizer, and those of lower-case Latin letters alone, which are one
pre-token each, go straight to its model.
"""

from __future__ import annotations

import sys
from array import array
from functools import lru_cache

TABLE_LIMIT = 400_000


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """Bytes (as Latin-1 characters) to the letters a byte-level vocabulary writes them with:
    printable bytes stand for themselves, the others follow from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ChunkIds(dict):
    """Chunk to its ids as little-endian unsigned 32-bit bytes, filled on demand."""

    def __init__(self, path: str, limit: int = TABLE_LIMIT):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.limit = limit

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if chunk[-1:] in (",", ".") and chunk[-2:-1].isalpha() and _is_latin(chunk[-2]):
            # a lone mark after a letter is a pre-token of its own
            found = self[chunk] = self[chunk[:-1]] + self[chunk[-1]]
            return found
        if chunk.isalpha() and chunk.islower() and _is_latin(chunk):
            letters = chunk if chunk.isascii() else (
                chunk.encode().decode("latin-1").translate(byte_letters()))
            ids = [t.id for t in self.model.tokenize(letters)]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        found = self[chunk] = packed.tobytes()
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text."""
        # Lower case by character is what the vocabulary wants; beyond Latin-1 it can depend on the
        # neighbours, so such texts keep their case until they reach the tokenizer.
        if _is_latin(text):
            text = text.lower()
        chunks = text.replace("\n", " ").replace("\t", " ").split(" ")
        return b"".join(map(self.__getitem__, chunks))


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def chunk_ids(vocabulary: str) -> ChunkIds:
    """The table of this worker; ``vocabulary`` is a path, or a file name of the installed public
    vocabularies, which is looked up where the task runs."""
    if "/" not in vocabulary:
        import public_tokenizers
        vocabulary = public_tokenizers.path(vocabulary)
    return ChunkIds(vocabulary)
