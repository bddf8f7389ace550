"""Encoding of a whole corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the pattern that cuts a text into pieces before merging, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for ASCII texts without the four separators that only the regex library's \s leaves out.
ASCII = r"""'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: Pieces kept with their ids, and the longest of them; others are encoded each time they occur.
CACHE_PIECES, CACHE_CHARS = 1_000_000, 40


class Pieces(dict):
    """Piece of text -> its ids, filled as pieces occur and emptied when full."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = merge(piece.encode(), self.ranks)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def merge(data: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: merges of least rank first, of equal rank the leftmost.

    The symbols are a doubly linked list; a priority queue holds (rank, place) of every pair that was adjacent when it was
    entered. An entry whose place has since been merged away or grown is stale and is skipped.
    """
    if (whole := ranks.get(data)) is not None:
        return (whole,)
    n = len(data)
    before, after, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
    queue = []
    for i in range(n - 1):
        if (r := ranks.get(data[i : i + 2])) is not None:
            queue.append((r, i, i + 2))
    heapq.heapify(queue)
    alive = bytearray(b"\x01" * n)
    while queue:
        r, i, stop = heapq.heappop(queue)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i], after[i], alive[j] = stop, after[j], 0
        if after[j] < n:
            before[after[j]] = i
            k = after[j]
            if (q := ranks.get(data[i : end[k]])) is not None:
                heapq.heappush(queue, (q, i, end[k]))
        if (h := before[i]) >= 0 and (q := ranks.get(data[h:stop])) is not None:
            heapq.heappush(queue, (q, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : end[i]]])
        i = after[i]
    return tuple(out)


class Tokenizer:
    """Encodes and decodes by one vocabulary file (base64 of the bytes, a space, the rank)."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.strings = {i: s for s, i in self.ranks.items()}
        self.pieces = Pieces(self.ranks)
        self.ascii, self.any = re.compile(ASCII).findall, regex.compile(PATTERN).findall

    def encode_parts(self, text: str | None):
        """The ids of a text, as an iterable of tuples; nothing for a null or empty text."""
        if not text:
            return ()
        find = self.ascii if text.isascii() and not SEPARATORS.search(text) else self.any
        return map(self.pieces.__getitem__, find(text))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.encode_parts(text)))

    def decode(self, ids) -> str:
        """The text again: the vocabulary's byte strings one after the other."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public vocabulary file: below TOKENIZERS_DIR if set, else /opt/tokenizers."""
    return os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


def encode_corpus(docs: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids array<int>): one row per row of docs, in one narrow pass without a shuffle.

    A null and an empty text give an empty list. Strings of special tokens in a text are ordinary text. Texts are encoded
    whole, however long: the cost of a piece of n bytes is n log n. Rows with a null key are kept. The vocabulary file is
    read once per Python worker; `path` must exist on every executor. Other columns are not read.
    """
    path = path or vocabulary()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc = tokenizer(path)
        for batch in batches:
            parts, lengths = [], np.zeros(batch.num_rows + 1, dtype=np.int64)
            for i, t in enumerate(batch.column(1)):
                ids = np.fromiter(chain.from_iterable(enc.encode_parts(t.as_py())), dtype=np.int32)
                parts.append(ids)
                lengths[i + 1] = len(ids)
            offsets = np.cumsum(lengths)
            start = 0
            while start < batch.num_rows:  # offsets of one Arrow array are 32 bits
                stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + (1 << 30), side="right")) - 1)
                flat = np.concatenate(parts[start:stop]) if stop > start else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array((offsets[start : stop + 1] - offsets[start]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), lists], names=[key, "ids"])
                start = stop

    return docs.select(f"`{key}`", docs[text].cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(key, text): the texts of token id lists; an empty list gives an empty text, a null list null."""
    path = path or vocabulary()
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        enc = tokenizer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return encoded.select(f"`{key}`", encoded[ids].alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")
