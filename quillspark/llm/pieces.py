"""SentencePiece encoding and decoding by streaming Viterbi.

The model file is of the merging kind: the sum-of-scores path over its pieces is not what the
model itself gives. The transition weight here is therefore 0 where the model's merge order leaves
the seam between two pieces open and minus infinity where it would close it. An encoding is right
exactly if every neighbouring pair is open, so the surviving path is the model's own encoding, and
every prefix has one surviving predecessor. States are end positions; only those within the longest
piece's length can still be extended. Whenever the backpointer paths of all these live states meet
in one boundary, the ids before it are committed and the window is dropped. The pieces that end at
a position come from an Aho-Corasick automaton, longest first. A space mark after another
character, and both sides of a character without a piece, are such boundaries at once, as no piece
spans them; what lies between two of them is kept in a bounded table. All texts, whatever their
length, go this one way.

Defined cases: a null text encodes as empty, an empty text has no ids; characters without a piece
become their UTF-8 bytes' pieces; decoding gives back the text with U+2581 turned into a space;
repeated rows each keep their row, an empty table gives an empty result, and of the columns only
text and those asked for are read, so others may have any name.
"""

from __future__ import annotations

import gc
import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

MARK = "▁"
KEEP, KEEP_LEN = 500_000, 64


class Filled(dict):
    """A table that computes what it lacks; emptied at `most` entries; string keys over `longest` aren't kept."""

    def __init__(self, compute, most: int | None = None, longest: int | None = None):
        self.compute, self.most, self.longest = compute, most, longest

    def __missing__(self, key):
        v = self.compute(key)
        if self.longest is None or len(key) <= self.longest:
            if self.most and len(self) >= self.most:
                self.clear()
            self[key] = v
        return v


class Node(dict):
    """A state of the automaton: by character the state it leads to, filled as they are met. pieces
    are (length, id) of those that end here, longest first; fail is the state of the longest suffix."""

    __slots__ = ("fail", "pieces", "kids")

    def __init__(self):
        self.fail, self.pieces, self.kids = None, (), {}

    def __missing__(self, c: str) -> Node:
        node = self
        while node is not None and c not in node.kids:
            node = node.fail
        v = self[c] = node.kids[c]
        return v


def automaton(ids: dict[str, int]) -> Node:
    """Aho and Corasick's automaton of the pieces; every character that it reads must be a piece."""
    root = Node()
    for p, i in ids.items():
        node = root
        for c in p:
            if c not in node.kids:
                node.kids[c] = Node()
            node = node.kids[c]
        node.pieces = ((len(p), i),)
    level = [root]
    while level:
        below = []
        for node in level:
            for c, kid in node.kids.items():
                kid.fail = root if node is root else node.fail[c]
                kid.pieces += kid.fail.pieces
                below.append(kid)
        level = below
    return root


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        special = {i for i in range(len(self.piece)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        ids = {p: i for i, p in enumerate(self.piece) if i not in special}
        assert not any(MARK in p.lstrip(MARK) for p in ids), "a piece spans a space mark"
        self.score = {p: sp.get_score(i) for p, i in ids.items()}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if sp.is_byte(i)}
        byte_of = {i: b for b, i in self.byte.items()}
        self.plain = [bytes((b,)) if (b := byte_of.get(i)) is not None else b"" if i in special else p.encode() for i, p in enumerate(self.piece)]
        self.size = list(map(len, self.piece))
        self.longest = max(map(len, ids))
        self.letters = {c for p in ids for c in p}
        assert self.letters <= ids.keys(), "a character of a piece is no piece"
        self.root = automaton(ids)
        inside = "".join(map(re.escape, sorted(self.letters)))
        self.run = re.compile(f"[{inside}]+|[^{inside}]+")
        self.chunk = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if "\n" not in self.letters else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.past: dict[int, tuple[list[tuple[float, str, str]], bool]] = {}
        self.seams = 0
        self.after = Filled(lambda left: Filled(lambda right: self.seam(left, right)))  # by left piece (-1 at the start)
        self.known = Filled(self.ids_of, KEEP, KEEP_LEN)

    def history(self, i: int) -> tuple[list[tuple[float, str, str]], bool]:
        """The merges of one piece by itself, best score first and leftmost of equals: (score, first
        and last symbol before it), ended by the whole; and whether they do end in the whole piece."""
        h = self.past.get(i)
        if h is None:
            sym, steps = list(self.piece[i]), []
            while len(sym) > 1:
                best = max(range(len(sym) - 1), key=lambda i: (self.score.get(sym[i] + sym[i + 1], -np.inf), -i))
                s = self.score.get(sym[best] + sym[best + 1])
                if s is None:
                    break
                steps.append((s, sym[0], sym[-1]))
                sym[best : best + 2] = [sym[best] + sym[best + 1]]
            h = self.past[i] = (steps + [(-np.inf, sym[0], sym[-1])], len(sym) == 1)
        return h

    def seam(self, left: int, right: int) -> bool:
        """May right follow left (-1: nothing)? Both pieces' merges are played in the order of their
        scores; the seam closes if the symbols beside it merge before they change."""
        b, v = self.history(right)
        if left >= 0 and v:
            a, i, j = self.history(left)[0], 0, 0
            while True:
                s = self.score.get(a[i][2] + b[j][1])
                if s is not None and s > a[i][0] and s >= b[j][0]:
                    v = False
                    break
                if i + 1 == len(a) and j + 1 == len(b):
                    break
                if j + 1 == len(b) or (i + 1 < len(a) and a[i][0] >= b[j][0]):
                    i += 1
                else:
                    j += 1
        self.seams += 1
        return v

    def path(self, s: str):
        """The ids of a run of characters that are pieces, in stretches: each is committed as soon as the
        paths that can still be extended meet, which is tried once in two windows. last and next_to
        hold, for each position since the last commit, the piece that ends there on its one surviving
        path and the seams of that piece; what was committed is dropped."""
        after, size, window, node = self.after, self.size, self.longest, self.root
        last, next_to = [-1], [after[-1]]
        base, due = -1, 2 * window  # the place before last[0]; when to commit
        for end, c in enumerate(s):
            node = node[c]
            for n, p in node.pieces:
                at = end - n - base
                if at >= 0 and next_to[at][p]:
                    last.append(p)
                    next_to.append(after[p])
                    break
            if end >= due:
                live = set(range(max(0, len(last) - window), len(last)))
                while len(live) > 1:
                    e = max(live)
                    live.remove(e)
                    live.add(max(0, e - size[last[e]]))
                (meet,) = live
                if meet:
                    yield self.back(last, meet)
                    last, next_to = last[meet:], next_to[meet:]
                    base += meet
                due = end + window
        yield self.back(last, len(last) - 1)

    def back(self, last: list[int], end: int) -> list[int]:
        out, size = [], self.size
        while end > 0:
            out.append(last[end])
            end -= size[last[end]]
        out.reverse()
        return out

    def ids_of(self, s: str) -> tuple[int, ...]:
        if self.seams > KEEP:
            self.after.clear()
            self.seams = 0
        if self.letters.issuperset(s):
            return tuple(chain.from_iterable(self.path(s)))
        out: list[int] = []
        for run in self.run.findall(s):
            out += chain.from_iterable(self.path(run)) if run[0] in self.letters else [self.byte[b] for b in run.encode("utf-8", "replace")]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.known.__getitem__, self.chunk.findall(MARK + text.replace(" ", MARK)))))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_file: str, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id) of docs, ids, n_ids, decoded_sha256 (of the decoded ids) and
    round_trip (the decoded ids are the text, U+2581 read as a space)."""
    keep = keep or ["doc_id"]
    d = docs.select("text", *keep)
    told = StructType().add("ids", ArrayType(IntegerType())).add("n_ids", LongType()).add("decoded_sha256", StringType()).add("round_trip", BooleanType())

    def run(batches):
        m = model(model_file)
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            gc.disable()  # the tables hold no cycles, and each collection would walk them
            try:
                ids = [m.encode(t) for t in texts]
                back = [m.decode(x) for x in ids]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())))), pa.array(n), pa.array([hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in back]), pa.array([x == t.replace(MARK, " ") for x, t in zip(back, texts)])],
                names=[*b.schema.names[1:], "ids", "n_ids", "decoded_sha256", "round_trip"],
            )

    return d.mapInArrow(run, StructType([*d.schema.fields[1:], *told.fields]))
