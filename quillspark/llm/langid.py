"""Language identification: averaged hashed subword embeddings and a linear softmax.

A word's subwords are its characters, its runs of three (with edge marks) and itself, hashed to a fixed
number of rows of an embedding table. A text is the average of the rows of all its subwords; a
linear softmax gives the languages. Both are trained by stochastic gradient descent in numpy. As
everything between table and softmax is linear, prediction folds both into one table of logits per
subword, and keeps each word's sum. A temperature and a rejection threshold are calibrated on a
part of the training rows kept from the descent.

Bound of the training sample: of each language as many rows, of least hash of doc_id, as bring the
languages to SAMPLE together, at least RARE; texts are learned from whole. The executors count their
subwords, so that the driver gets at most BUCKETS numbers of a row. Predictions are made on whole texts.

Defined cases: a null text, or one without a letter (category L; number signs such as ², ½ and Ⅷ are
none), is `und` with score 0; without training rows every text is `und`. A text whose calibrated score is
under the threshold has rejected = true and still names the likeliest language. Equal texts have equal
predictions, repeated rows each keep their row and, in the fit, count as often as they are drawn; an
empty table gives an empty result; only doc_id, text and lang are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .toxicity import held_out

SAMPLE, RARE, BUCKETS, DIM, EPOCHS, RATE = 3000, 200, 1 << 15, 16, 6, 0.5
RUNS = re.compile(r"[^\W\d_]+")
KEEP = 200_000
#: Longer runs of letters are taken whole too, but one by one and in pieces, so that memory stays bounded.
LONG, PIECE = 40, 1 << 16


def letters(text: str) -> list[str]:
    """Runs of letters. The class of words also takes signs that count as numbers; the few runs that hold one are cut there."""
    runs = RUNS.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return [w for r in runs for w in ([r] if r.isalpha() else "".join(c if c.isalpha() else " " for c in r).split())]


def subwords(word: str) -> list[int]:
    w = f"<{word}>"
    crc = zlib.crc32
    return [crc(g.encode()) % BUCKETS for g in [w, *w[1:-1], *[w[i : i + 3] for i in range(len(w) - 2)]]]


def pieces(word: str):
    """The same of a long run, in arrays of at most PIECE."""
    w = f"<{word}>"
    for part in batched(chain((w,), word, (w[i : i + 3] for i in range(len(w) - 2))), PIECE):
        yield np.array([zlib.crc32(g.encode()) % BUCKETS for g in part], np.int64)


class Words(dict):
    """Numbers of words, in order of appearance; fresh has those without logits yet."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def __post_init__(self):
        self.words, self.rows = Words(), np.zeros((0, len(self.languages) + 1))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        if len(self.words) > KEEP:
            self.__post_init__()
        words, out = self.words, []
        number = words.__getitem__
        seen = [[number(w) for w in letters(t.lower())] if t and self.languages else [] for t in texts]
        if words.fresh:
            fresh = np.zeros((len(words.fresh), len(self.languages) + 1))
            long = np.fromiter((len(w) > LONG for w in words.fresh), bool, len(fresh))
            ids = [subwords(w) for w, x in zip(words.fresh, long) if not x]
            if ids:
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
                sums = np.add.reduceat(self.logits[flat], np.concatenate(([0], np.cumsum(n)[:-1])), axis=0)
                fresh[~long] = np.column_stack((sums, n))
            for k in np.flatnonzero(long):
                for part in pieces(words.fresh[k]):
                    fresh[k, :-1] += self.logits[part].sum(axis=0)
                    fresh[k, -1] += len(part)
            self.rows = np.concatenate((self.rows, fresh))
            words.fresh.clear()
        for at in seen:
            if not at:
                out.append(("und", 0.0, True))
                continue
            total = self.rows[at].sum(axis=0)
            z = (total[:-1] / total[-1] + self.bias) / self.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            best = int(p.argmax())
            out.append((self.languages[best], float(p[best]), bool(p[best] < self.threshold)))
        return out


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct subwords of a text and the share of each."""
    seen, total = np.zeros(BUCKETS, np.int64), 0
    for w, n in Counter(letters(text.lower())).items():
        for ids in pieces(w) if len(w) > LONG else (subwords(w),):
            np.add.at(seen, ids, n)
            total += n * len(ids)
    u = np.flatnonzero(seen)
    return u.astype(np.int32), seen[u] / max(1, total)


def train(rows: list[tuple[str, str]], seed: int = 11) -> LanguageModel:
    """From (text, language) rows."""
    return descend([(*counted(t), y) for t, y in sorted(set(rows))], seed)


def descend(rows: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 11) -> LanguageModel:
    """From (subwords, shares, language) rows, in their order."""
    names = sorted({y for *_, y in rows})
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    data = [(u, c, names.index(y)) for u, c, y in rows if len(u)]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    kept, used = order[: len(data) // 5], order[len(data) // 5 :]
    table, out, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((DIM, len(names))), np.zeros(len(names))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for k in rng.permutation(used):
            u, c, y = data[k]
            h = c @ table[u]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            g = out @ p
            out -= rate * np.outer(h, p)
            bias -= 0.05 * rate * p
            table[u] -= rate * 10 * c[:, None] * g
    model = LanguageModel(names, table @ out, bias)
    z = np.array([c @ model.logits[u] + bias for u, c, _ in (data[k] for k in kept)]) if len(kept) else np.zeros((0, len(names)))
    y = np.array([data[k][2] for k in kept], int)

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    if len(y):
        model.temperature = min((0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
        s = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
        top = (s / s.sum(axis=1, keepdims=True)).max(axis=1)
        model.threshold = float(np.quantile(top, 0.005))  # one in 200 known texts is rejected
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", F.col("lang").alias("lang"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return descend([])
    quota = max(RARE, sample // len(counts))
    h = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(1 << 30))
    cut = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, int(np.ceil(min(1.0, (quota + 4 * quota**0.5 + 16) / n) * (1 << 30))))]), F.col("lang"))
    # a first cut by hash leaves little more than the sample, which the window then orders
    order = Window.partitionBy("lang").orderBy(h, "doc_id", F.xxhash64("text"))
    some = known.where(h < cut).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= quota).select("text", "lang", F.xxhash64("doc_id", "text").alias("key"))

    def run(batches):
        for b in batches:
            told = [counted(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([u for u, _ in told], pa.list_(pa.int32())), pa.array([c for _, c in told], pa.list_(pa.float64()))], names=["lang", "key", "u", "c"])

    rows = some.mapInArrow(run, "lang string, key bigint, u array<int>, c array<double>").toArrow()
    lang, key = rows["lang"].to_pylist(), rows["key"].to_pylist()
    u, c = ([np.asarray(x.values) for x in rows[k]] for k in ("u", "c"))
    return descend([(u[i], c[i], lang[i]) for i in sorted(range(len(lang)), key=lambda i: (key[i], lang[i]))])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of docs."""
    model = fit(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            p = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:1], b.column(2), pa.array([x[0] for x in p], pa.string()), pa.array([x[1] for x in p], pa.float64()), pa.array([x[2] for x in p], pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
