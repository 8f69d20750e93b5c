"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded one character to one character (case, look-alike letters of other scripts, digits
and signs that stand for letters), so match places are places of the text. The lexicon is learned
from labelled rows: word starts and whole words, chosen one after the other by how many toxic rows
not yet explained they occur in while (almost) no clean row has them, each weighted by its log
odds. Some terms are soft: clean rows have them too, but hardly ever twice; their first hit in a text
doesn't count. Phrases of a neighbouring word and a lexicon word that only clean rows have are
exceptions and cancel the hit inside. The summed weight, normalised by the number of words, goes
through a logistic curve fitted on the same rows; 0.7 is the threshold, and a score of 0.7 is toxic.

A pattern may mean several things (a start of a word and the whole word, or an exception); each counts where it holds, and
of what holds at one place the heaviest. The lexicon has no bound but the sample's: a term must explain
0.4 % of the toxic rows beyond those explained, or stand in 2 % of them.

Bound of the labelled sample: SAMPLE rows of `labels` (least hashes), learned from and scored with their
whole texts. The executors count; the driver sees counts of terms that several toxic rows have, the
terms of each toxic row of the sample, and two numbers for each row.

Defined cases: null and empty texts score as texts without hits; without labelled rows of both
kinds every score is 0; of repeated labels of a row the largest counts; rows with one text and label
count once in the fit; rows without doc_id are scored and not held out; repeated rows each keep their
row; an empty table gives an empty result; columns of any other name are left alone.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_sample, stash

SAMPLE, PREFIX = 9000, range(3, 9)
THRESHOLD = 0.7
#: Look-alike letters, and digits and signs read as letters; i, l, 1 and ! count as one.
LOOKALIKES = dict(zip("авеёкмнорстухіјѕԁɡοαενικρτυχ", "abeekmhopctyxijsdgoaevikptyx"))
DIGITS = dict(zip("0134578@$!|", "oleastbasll"))
EXCEPTIONS = ("trash can", "clown fish")
WORDS = re.compile(r"[^\W_]+")


def fold_table() -> dict[int, str]:
    letters = (chr(c) for c in range(0x1F000))  # beyond, no letter has case
    # common signs stand for themselves: translate is slow on what the table lacks
    t = {ord(c): low for c in letters if len(low := c.lower()) == 1 and (low != c or c < "\u0250")}
    for k, v in LOOKALIKES.items():
        t[ord(k)] = t[ord(k.upper())] = v
    t |= {ord(k): v for k, v in DIGITS.items()}
    t |= {c: chr(c - 0xFEE0).lower() for c in range(0xFF21, 0xFF5B)}
    return {k: "l" if v == "i" else v for k, v in t.items()} | {ord("i"): "l", ord("I"): "l"}


FOLD = fold_table()


def fold(text: str) -> str:
    return text.translate(FOLD)


@dataclass
class Lexicon:
    terms: dict[str, float] = field(default_factory=dict)  # folded; a final space means a whole word
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float] = (0.0, 0.0)  # slope, offset
    fitted: bool = False
    soft: frozenset[str] = frozenset()  # terms whose first hit is excused

    @cached_property
    def machine(self) -> ahocorasick.Automaton:
        return automaton(self.terms, self.exceptions)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "machine"}


def automaton(terms: Iterable[str], exceptions: Iterable[str]) -> ahocorasick.Automaton:
    """Of letters, with all that they mean: a start of a word, the whole word, an exception, or several of these."""
    meant: dict[str, list[tuple[str, bool]]] = {}
    for t in terms:
        meant.setdefault(t.strip(), []).append((t, False))
    for e in exceptions:
        meant.setdefault(e, []).append((e, True))
    a = ahocorasick.Automaton()
    for letters, meanings in meant.items():
        a.add_word(letters, (len(letters), meanings))
    if len(a):
        a.make_automaton()
    return a


def hits(text: str, a: ahocorasick.Automaton) -> list[tuple[int, str]]:
    """(start, term) of the lexicon's hits at word starts, without those inside exceptions."""
    if not len(a):
        return []
    f, n = fold(text), len(text)
    found, spared = [], []
    for end, (size, meanings) in a.iter(f):
        start, after = end - size + 1, end + 1
        if start and (text[start - 1].isalnum()):
            continue
        closed = after >= n or not text[after].isalnum()
        for t, excepted in meanings:
            if excepted:
                if closed:
                    spared.append((start, after))
            elif closed or not t.endswith(" "):
                found.append((start, t))
    if not spared:
        return found
    spared.sort()
    starts, reach = [x for x, _ in spared], np.maximum.accumulate([y for _, y in spared]).tolist()
    return [(s, t) for s, t in found if not ((i := bisect_right(starts, s)) and reach[i - 1] > s)]


def weight(text: str | None, lex: Lexicon) -> float:
    """Summed weight of the hits, one for each place (the heaviest), per 100 words of text."""
    if not text or not lex.terms:
        return 0.0
    best: dict[int, str] = {}
    for s, t in hits(text, lex.machine):
        if s not in best or lex.terms[t] > lex.terms[best[s]]:
            best[s] = t
    if not best:
        return 0.0
    total = sum(lex.terms[t] * (n - (t in lex.soft)) for t, n in Counter(best.values()).items())
    return 100.0 * total / (len(text.split()) + 20)


def score(text: str | None, lex: Lexicon) -> float:
    a, b = lex.curve
    return 1.0 / (1.0 + float(np.exp(-(a * np.log1p(weight(text, lex)) + b)))) if lex.fitted else 0.0


def features(text: str) -> Counter[str]:
    """How many words are, or start with, each folded word or start of a word."""
    out: Counter[str] = Counter()
    for w, n in Counter(map(fold, WORDS.findall(text))).items():
        if w.isalpha() and len(w) >= 3:
            out[w + " "] += n
            for k in PREFIX:
                if k < len(w):
                    out[w[:k]] += n
    return out


def tally(texts: Iterable[str], names: set[str] | None = None) -> dict[str, list[int]]:
    """By feature (of names, if given): texts that have it, and texts that have it twice or more."""
    out: dict[str, list[int]] = {}
    for t in texts:
        for f, n in features(t).items():
            if names is None or f in names:
                c = out.setdefault(f, [0, 0])
                c[0] += 1
                c[1] += n > 1
    return out


def common_terms(toxic: dict[str, list[int]], n1: int) -> set[str]:
    least = max(3, 0.004 * n1)
    return {f for f, (n, _) in toxic.items() if n >= least}


@dataclass
class Candidate:
    weight: float
    rows: int  # toxic rows that have it
    soft: bool


def candidates(toxic: dict[str, list[int]], clean: dict[str, list[int]], n1: int, n0: int) -> dict[str, Candidate]:
    """Terms that tell toxic rows: those that clean rows don't have, and those that they don't repeat."""
    out = {}
    for f, (c1, r1) in toxic.items():
        c0, r0 = clean.get(f, (0, 0))
        odds, odds2 = (float(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))) for a, b in ((c1, c0), (r1, r0)))
        if c0 <= 0.06 * c1 and odds > 2:
            out[f] = Candidate(odds, c1, False)
        elif r1 >= max(3, 0.6 * c1) and r0 <= 0.1 * r1 and odds2 > 2:
            out[f] = Candidate(odds2, r1, True)
    return out


def explained(text: str, good: dict[str, Candidate]) -> list[str]:
    """The candidates that a text has, soft ones twice."""
    return sorted(f for f, n in features(text).items() if f in good and n > good[f].soft)


def chosen(rows: list[list[str]], good: dict[str, Candidate]) -> dict[str, float]:
    """The lexicon, from what explains each toxic row."""
    n1 = len(rows)
    members: dict[str, set[int]] = {}
    for i, s in enumerate(rows):
        for f in s:
            members.setdefault(f, set()).add(i)
    terms: dict[str, float] = {}
    least = max(3, 0.004 * n1)
    while members:  # each explains so many more rows that there are 250 at most
        # the term that explains most; of equals the longest, which says most
        f = min(members, key=lambda f: (-len(members[f]), -len(f), f))
        if len(members[f]) < least:
            break
        terms[f], gone = good[f].weight, members.pop(f)
        members = {g: kept for g, m in members.items() if (kept := m - gone)}
    # whatever else holds in at least a fiftieth of the toxic rows joins: the longest start of a word
    # that has as good as all rows of the shorter ones
    common = [f for f, c in good.items() if c.rows >= max(8, 0.02 * n1)]
    longer = {f for g in common for k in range(3, len(g)) if (f := g[:k]) in good and good[g].rows >= 0.9 * good[f].rows}
    for f in sorted(set(common) - longer, key=lambda f: (len(f), f)):
        if not any(f.startswith(t) for t in terms):
            terms[f] = good[f].weight
    return terms


def phrases(text: str, a: ahocorasick.Automaton) -> Counter[str]:
    """A hit's word and the word after it; once a hit, whatever it means."""
    f, out = fold(text), Counter()
    for s in sorted({s for s, _ in hits(text, a)}):
        e = re.compile(r"\W|$").search(f, s).start()
        if near := re.compile(r" \w+").match(f, e):
            out[f[s:e] + near[0]] += 1
    return out


def counted_phrases(texts: list[str], terms: dict[str, float]) -> list[tuple[str, int]]:
    plain = automaton(terms, ())
    return list(sum((phrases(x, plain) for x in texts), Counter()).items())


def with_exceptions(terms: dict[str, float], good: dict[str, Candidate], clean: dict[str, int], toxic: Iterable[str], exceptions: tuple[str, ...]) -> Lexicon:
    bad = set(toxic)
    learned = sorted(p for p, n in clean.items() if n >= 3 and p not in bad)
    return Lexicon(terms, tuple(dict.fromkeys([*map(fold, exceptions), *learned])), (0.0, 0.0), True, frozenset(f for f in terms if good[f].soft))


def curve(points: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope and offset of the logistic curve of (weight, label) points, by Newton's method with a small ridge."""
    x, y = np.log1p([w for w, _ in points]), np.array([v for _, v in points], float)
    a, b = 1.0, -2.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * x + b)))
        s = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - y) * x).sum() + 0.05 * a, (p - y).sum()])
        hess = np.array([[(s * x * x).sum() + 0.05, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 0.0)), float(b)


def learn(rows: list[tuple[str, int]], exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon, exceptions and curve from (text, label) rows; repeated rows count once."""
    rows = sorted(set(rows))
    texts = [t for t, y in rows if y], [t for t, y in rows if not y]
    if not texts[0] or not texts[1]:
        return Lexicon()
    toxic = tally(texts[0])
    names = common_terms(toxic, len(texts[0]))
    good = candidates({f: toxic[f] for f in names}, tally(texts[1], names), len(texts[0]), len(texts[1]))
    terms = chosen([explained(t, good) for t in texts[0]], good)
    plain = automaton(terms, ())
    seen = [sum((phrases(t, plain) for t in x), Counter()) for x in texts]
    lex = with_exceptions(terms, good, seen[1], seen[0], exceptions)
    lex.curve = curve([(weight(t, lex), y) for t, y in rows])
    return lex


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def each(rows: DataFrame, schema: str, make: Callable[[list[str]], list[tuple]]) -> DataFrame:
    """make, of the texts of each Arrow batch of rows (text, toxic)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            out = make(b.column(0).to_pylist())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

    return rows.select("text").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The same as learn, from the labelled rows of docs that aren't held out, counted by the executors.
    The sample of labels has at most `sample` rows of two integers, so it may be broadcast."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    some = bounded_sample(marked, marked.count(), sample, "doc_id")
    texts = docs.select("doc_id", "text").where(F.length("text") > 0)
    rows = stash(texts.join(F.broadcast(some), "doc_id").select("text", "toxic").dropDuplicates(["text", "toxic"]))
    toxic, clean = rows.where("toxic = 1"), rows.where("toxic = 0")
    n1, n0 = toxic.count(), clean.count()
    if not n1 or not n0:
        return Lexicon()

    def counted(part: DataFrame, names: set[str] | None, least: float) -> dict[str, list[int]]:
        told = each(part, "f string, n bigint, m bigint", lambda t: [(f, *c) for f, c in tally(t, names).items()])
        return {r["f"]: [r["n"], r["m"]] for r in told.groupBy("f").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where(F.col("n") >= least).collect()}

    def phrased(part: DataFrame, least: int) -> dict[str, int]:
        told = each(part, "p string, n bigint", lambda t: counted_phrases(t, terms))
        return {r["p"]: r["n"] for r in told.groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}

    found = counted(toxic, None, max(3, 0.004 * n1))
    good = candidates(found, counted(clean, set(found), 1), n1, n0)
    terms = chosen([r["fs"] for r in each(toxic, "fs array<string>", lambda t: [(explained(x, good),) for x in t]).collect()], good)
    lex = with_exceptions(terms, good, phrased(clean, 3), phrased(toxic, 1), exceptions)
    points = [[(r["w"], y) for r in each(part, "w double", lambda t: [(weight(x, lex),) for x in t]).collect()] for part, y in ((clean, 0), (toxic, 1))]
    lex.curve = curve(sorted(points[0]) + sorted(points[1]))
    return lex


def score_documents(docs: DataFrame, lex: Lexicon, keep: list[str], name: str = "score") -> DataFrame:
    """The columns `keep` of docs and the score under `name`."""
    d = docs.select(F.col("text").alias("__qs_text"), *keep)
    schema = StructType([*d.schema.fields[1:], StructField(name, DoubleType())])

    def run(batches):
        for b in batches:
            s = pa.array([score(t, lex) for t in b.column(0).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], s], names=[*b.schema.names[1:], name])

    return d.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    scored = score_documents(docs, fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score 0.7 or more."""
    return score_documents(docs, fit(docs, labels), docs.columns, "__qs_score").where(F.col("__qs_score") < THRESHOLD).drop("__qs_score")
