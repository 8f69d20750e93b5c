"""Token counts of byte-level BPE by merging, with no identifiers emitted.

A pre-token's bytes are a linked list of symbols; a heap holds the adjacent pairs by (rank, place).
The lowest-ranked pair is popped, merged if both its symbols still stand, and its new neighbours
are pushed. The count is the initial symbols minus the merges. Counts of short pre-tokens are kept
in a bounded table, so repeated words cost one lookup.

Defined cases: a null text counts as empty; empty texts have 0 bytes and 0 tokens; the file's added
tokens inside texts are one token each, as the library does by default. Repeated rows, and rows whose
doc_id is null, each keep their row; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the byte-level pre-tokenizer's public split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEEP, KEEP_LEN = 400_000, 64


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class BpeCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            self.rank[vocab[x], vocab[y]] = (r, vocab[x + y])
        self.start = [vocab[c] for c in byte_chars()]
        added = sorted((a["content"] for a in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.split = regex.compile(SPLIT)
        self.known: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Symbols left of one pre-token."""
        sym = [self.start[b] for b in word.encode("utf-8", "replace")]
        n = len(sym)
        left, right, rank = list(range(-1, n - 1)), list(range(1, n + 1)), self.rank
        heap = [(m[0], i, m[1], sym[i], sym[i + 1]) for i in range(n - 1) if (m := rank.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, new, x, y = heapq.heappop(heap)
            j = right[i]
            if sym[i] != x or j >= n or sym[j] != y:
                continue
            merges += 1
            sym[i], sym[j] = new, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if m := rank.get((new, sym[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, sym[k]))
            h = left[i]
            if h >= 0 and (m := rank.get((sym[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], sym[h], new))
        return n - merges

    def plain(self, text: str) -> int:
        known, total = self.known, 0
        for m in self.split.finditer(text):
            w = m[0]
            c = known.get(w)
            if c is None:
                c = self.merged(w)
                if len(w) <= KEEP_LEN:
                    if len(known) >= KEEP:
                        known.clear()
                    known[w] = c
            total += c
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is None:
            return self.plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=2)
def counter(path: str) -> BpeCounter:
    return BpeCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row of docs."""

    def run(batches):
        c = counter(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = np.array([c.count(t) for t in texts], np.int64)
            size = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
