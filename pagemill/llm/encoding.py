"""Encoding texts with a public byte-level BPE vocabulary.

Whole pre-tokens are looked up in a minimal perfect hash over the vocabulary; those not in it are merged from their bytes,
lowest rank first, with a heap over linked positions. A bounded memory of pre-tokens in each worker saves repeated work.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Pre-tokens that a worker remembers before it forgets them all.
REMEMBERED = 400_000
MASK = (1 << 64) - 1

# Fixed value: the pre-token pattern that is published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space as Unicode has it, which leaves out the separators U+001C to U+001F that this library's \s has.
SPACES = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ASCII_SPACES = r"\t\n\x0b\x0c\r "


def with_spaces(pattern: str, spaces: str) -> str:
    """A pattern with this class of white space in place of \\s and \\S."""
    return pattern.replace(r"[^\s", f"[^{spaces}").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")


PRE_TOKEN = regex.compile(with_spaces(PATTERN, SPACES))
ASCII_PRE_TOKEN = re.compile(with_spaces(PATTERN, ASCII_SPACES).replace(r"\p{L}\p{N}]", "A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _slot(h: int, d: int, n: int) -> int:
    x = (h ^ d * 0x9E3779B97F4A7C15) & MASK
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & MASK
    return (x ^ x >> 32) % n


class PerfectHash:
    """A minimal perfect hash: as many slots as keys, one displacement for a bucket of about two keys.

    A bucket of one key has its slot itself, as -1 - slot. Slots hold the key, so that strangers are told from keys.
    """

    def __init__(self, table: dict[bytes, int]):
        n = self.n = len(table)
        self.shifts = [0] * max(1, n // 2)
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for key in table:
            h = xxhash.xxh64_intdigest(key)
            buckets.setdefault(h % len(self.shifts), []).append((h, key))
        free = iter(())
        for b, own in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:
                if not isinstance(free, type(iter([]))):
                    free = iter([s for s in range(n) if self.keys[s] is None])
                slots = [next(free)]
                self.shifts[b] = -1 - slots[0]
            else:
                d = 1
                while True:
                    slots = [_slot(h, d, n) for h, _ in own]
                    if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                        break
                    d += 1
                self.shifts[b] = d
            for s, (_, key) in zip(slots, own):
                self.keys[s], self.values[s] = key, table[key]

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh64_intdigest(key)
        d = self.shifts[h % len(self.shifts)]
        s = -1 - d if d < 0 else _slot(h, d, self.n)
        return self.values[s] if self.keys[s] == key else None


def merge_bytes(piece: bytes, vocabulary: PerfectHash) -> tuple[int, ...]:
    """The ids of a piece: adjacent parts are joined, the pair of the lowest rank (of these the first) first."""
    n = len(piece)
    ends = list(range(1, n + 1))  # the end of the part that starts here; 0 where none does
    before = list(range(-1, n - 1))

    def rank(i: int) -> tuple[int, int, int] | None:
        j = ends[i]
        if j < n and (r := vocabulary.get(piece[i : ends[j]])) is not None:
            return r, i, ends[j]
        return None

    heap = [x for i in range(n - 1) if (x := rank(i))]
    heapq.heapify(heap)
    while heap:
        r, i, end = heapq.heappop(heap)
        j = ends[i]
        if not j or j >= n or ends[j] != end:
            continue
        ends[i], ends[j] = end, 0
        if end < n:
            before[end] = i
        for k in (before[i], i):
            if k >= 0 and (x := rank(k)):
                heapq.heappush(heap, x)
    out, i = [], 0
    while i < n:
        out.append(vocabulary.get(piece[i : ends[i]]))
        i = ends[i]
    return tuple(out)


class Memory(dict):
    """Ids of pre-tokens, worked out when they are first asked for."""

    def __init__(self, vocabulary: PerfectHash):
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        piece = token.encode("utf-8", "replace")
        whole = self.vocabulary.get(piece)
        self[token] = ids = (whole,) if whole is not None else merge_bytes(piece, self.vocabulary)
        return ids


class Sizes(dict):
    """How many ids a pre-token has."""

    def __init__(self, memory: Memory):
        self.memory = memory

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[token] = n = len(self.memory[token])
        return n


def pre_tokens(text: str) -> list[str]:
    return (ASCII_PRE_TOKEN if text.isascii() else PRE_TOKEN).findall(text)


_WORKER: dict[int, Memory] = {}


def _memory(shared) -> Memory:
    """The worker's memory for this broadcast vocabulary; it outlives the task."""
    key = shared._jid if hasattr(shared, "_jid") else id(shared)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Memory(shared.value)
    return _WORKER[key]


def _vocabulary(df: DataFrame, path: str | None):
    return df.sparkSession.sparkContext.broadcast(PerfectHash(read_ranks(path or default_path())))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of docs(doc_id, text, ...), in the vocabulary of the file at path.

    NULL and empty texts have the empty list. Strings that look like special tokens are ordinary text; no special tokens
    are added. Repeated rows give repeated rows; other columns are ignored.
    """
    shared = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(shared)
        get = memory.__getitem__
        for b in batches:
            parts, ends = [], np.zeros(b.num_rows + 1, np.int32)
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = np.fromiter(chain.from_iterable(map(get, pre_tokens(text))), np.int32) if text else np.zeros(0, np.int32)
                parts.append(ids)
                ends[k + 1] = ends[k] + len(ids)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    docs = docs.select("doc_id", "text")
    return arrow_map(docs, run, docs.select("doc_id", F.array().cast("array<int>").alias("ids")).schema)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens) of every row; 0 for NULL and empty texts."""
    shared = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = Sizes(_memory(shared)).__getitem__
        for b in batches:
            n = [sum(map(get, pre_tokens(t))) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    docs = docs.select("doc_id", "text")
    return arrow_map(docs, run, docs.select("doc_id", F.lit(0).cast("bigint").alias("tokens")).schema)
