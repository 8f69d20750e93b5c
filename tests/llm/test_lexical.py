"""Decontamination, lexical search and the divergence audit against brute force, on small tables with every awkward row."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from quillspark.llm import decontaminate, divergence, search
from quillspark.llm.words import words

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD, TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
EXTRA = "n bigint, term string, row bigint, block bigint, base bigint, key string, score double, rank int, part string, p bigint, item string, total bigint, bucket int, at int"


def split(text, what=WORD):
    return what.findall((text or "").translate(FOLD))


def corpus(seed):
    r = random.Random(seed)
    some = ["the", "of", "and", *("".join(r.choice("abcdeé漢") for _ in range(r.randint(1, 4))) for _ in range(60))]
    prose = lambda n: " ".join(r.choice(some[:3] if r.random() < 0.4 else some) for _ in range(n))
    items = [(k, prose(r.randint(3, 40))) for k in range(12)]
    items += [(3, prose(15)), (None, prose(12)), (12, None), (13, ""), (14, "The"), (15, items[0][1]), (16, items[0][1].upper()), (17, "of the of the of the of the of the of the of the")]
    docs = []
    for k in range(60):
        text = prose(r.randint(0, 60))
        if k % 3 == 0:
            w = (items[r.randrange(len(items))][1] or "x").split()
            lo = r.randrange(len(w)) if w else 0
            cut = w[lo : lo + r.randint(5, 25)]
            if k % 2 and len(cut) > 3:
                cut.insert(r.randrange(len(cut)), r.choice(["zz", "the"]))
            text = f"{text}; {' '.join(cut).title() if k % 4 == 0 else ' '.join(cut)} {prose(3)}"
        docs.append((k // 2 if k > 50 else k, text, r.choice(["en", "de", None]), r.choice(["a", "b", "c", None])))
    docs += [(None, items[0][1], "en", "a"), (None, None, "fr", "x"), (100, "", "fr", "y"), (101, "12 !!", "fr", "y"), (102, prose(6000), "en", "b"), (7, docs[7][1], "en", "a"), (7, docs[7][1], "en", "a")]
    return docs, items


@pytest.fixture(scope="module", params=(1, 2))
def tables(spark, request):
    docs, items = corpus(request.param)
    d = spark.createDataFrame([(*x, *[None] * 14) for x in docs], f"doc_id bigint, text string, lang string, source string, {EXTRA}")
    i = spark.createDataFrame([(*x, *[None] * 14) for x in items], f"item_id bigint, text string, {EXTRA}")
    return docs, items, d.repartition(3), i


def test_words():
    r = random.Random(4)
    for _ in range(2000):
        t = "".join(r.choice("aAzZ09 _-'`{~\x7f\x80éÉ漢\n\t 😀@[") for _ in range(r.randint(0, 12)))
        assert [w.decode() for w in words(t.encode())] == split(t)
    assert words(None) == [] == words(b"")


def brute_matches(docs, items, width=10, slop=2):
    """(row, item_id, window's place, width, exact) straight from the definition."""
    count = Counter(w for _, t, *_ in docs for w in split(t))
    out = []
    for _, text in items:
        ws = split(text)
        for o in range(max(1, len(ws) - width + 1)) if ws else ():
            w = ws[o : o + width]
            if not all(count[x] for x in w):
                continue
            j = min(range(len(w)), key=lambda j: (count[w[j]], j))
            for k, (_, t, *_) in enumerate(docs):
                places = defaultdict(list)
                for p, x in enumerate(split(t)):
                    places[x].append(p)
                for p in places[w[j]]:
                    off = [min((abs(q - (p - j + m)) for q in places[x]), default=99) for m, x in enumerate(w)]
                    if max(off) <= slop:
                        out.append((k, _, p - j, len(w), max(off) == 0))
    return out


def all_matches(docs, items):
    out = []
    for item_id, text in items:
        out += [(k, item_id, *rest) for k, _, *rest in brute_matches(docs, [(item_id, text)])]
    return out


@pytest.mark.parametrize("reach", [None, 64])
def test_decontaminate(tables, reach, monkeypatch):
    docs, items, d, i = tables
    if reach:
        monkeypatch.setattr(decontaminate, "RANGE", reach)
    found = all_matches(docs, items)
    want = []
    for k, (doc_id, text, *_) in enumerate(docs):
        ws, mine = split(text), [m for m in found if m[0] == k]
        hit = {p for _, _, at, n, exact in mine if exact for p in range(at, at + n)}
        assert all(0 <= p < len(ws) for p in hit)
        listed = sorted({str(m[1]) for m in mine if m[4] and m[1] is not None})
        near = {str(m[1]) for m in mine if m[1] is not None} - set(listed)
        want.append((doc_id, len(ws), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit), len(near)))
    got = [tuple(r) for r in decontaminate.decontaminate(d, i).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(w[5] for w in want) > 5 and sum(w[6] > 0 for w in want) > 0


def test_matches_are_spans(tables):
    docs, items, d, i = tables
    want = {(docs[k][0], item, at, n, exact) for k, item, at, n, exact in all_matches(docs, items)}
    assert {tuple(r) for r in decontaminate.matches(d, i).collect()} == want


def test_blocks_of_an_index(spark, tables):
    """Small blocks: places of every term come back, whatever block they are in."""
    docs, _, d, _ = tables
    index = decontaminate.build_index(d)
    base = {(r["block"], r["base"]): r for r in decontaminate.documents(index).collect()}
    got = Counter()
    for r in index.where("term is not null").collect():
        at = decontaminate.places(r["steps"])
        assert len(at) == r["n"] and (at[1:] > at[:-1]).all()
        for p in at.tolist():
            b = max((x for x in base if x[0] == r["block"] and x[1] <= p), key=lambda x: x[1])
            assert p < b[1] + base[b]["n_words"]
            got[base[b]["doc_id"], p - b[1], r["term"]] += 1
    assert got == Counter((x[0], p, w) for x in docs for p, w in enumerate(split(x[1])))
    b = decontaminate.Block(5)
    assert [b.add(t) for t in (b"a b a", None, b"", b"b")] == [(0, 3), (67, 0), (131, 0), (195, 1)]
    terms, count, steps = b.lists()
    assert terms == [b"a", b"b"] and count.tolist() == [2, 2] and [decontaminate.places(s.as_py()).tolist() for s in steps] == [[0, 2], [1, 195]]


def brute_search(docs, items, top=20):
    split_docs = [split(t) for _, t, *_ in docs]
    n_docs, n_terms = sum(map(bool, split_docs)), sum(map(len, split_docs))
    df = Counter(w for ws in split_docs for w in set(ws))
    grouped = defaultdict(list)
    for item_id, t in items:
        grouped[item_id] += split(t)
    out = []
    for item_id, ws in grouped.items():
        scored = []
        for (doc_id, *_), dw in zip(docs, split_docs):
            tf, m = Counter(dw), 100 - 25 + (25 * len(dw) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in ws if tf[w])
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top])]
    return out


@pytest.mark.parametrize("top", [20, 3])
def test_search(tables, top):
    docs, items, d, i = tables
    got = [tuple(r) for r in search.search(d, i, top).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_search(docs, items, top)))


def test_search_of_hot_terms_is_dealt(tables, monkeypatch):
    docs, items, d, i = tables
    monkeypatch.setattr(search, "BUCKETS", 2)  # two parts of each, with four shuffle partitions
    assert sorted(map(repr, (tuple(r) for r in search.search(d, i).collect()))) == sorted(map(repr, brute_search(docs, items)))


def brute_audit(docs, least, shown=10):
    d = [(lang or "", source or "", split(t, TERM)) for _, t, lang, source in docs]
    out = []
    for lang in {x[0] for x in d}:
        own = [x for x in d if x[0] == lang]
        df = Counter(w for _, _, ws in own for w in set(ws))
        kept = sorted(w for w in df if df[w] >= least)
        by = {s: Counter(w for _, x, ws in own if x == s for w in ws) for s in {x[1] for x in own}}
        share = lambda c: {w: 1 + 1000000000 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in by.items()}, share(sum(by.values(), Counter()))
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in by:
            pairs = [(o, sum(far(p[s][w], p[o][w]) for w in kept)) for o in by if o != s]
            terms = [(w, far(p[s][w], q[w])) for w in kept if by[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, shown)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found)]
    return out


@pytest.mark.parametrize("least", [10, 1, 1000])
def test_audit(tables, least):
    docs, _, d, _ = tables
    got = [tuple(r) for r in divergence.audit(d, least).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_audit(docs, least)))


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, kept = 10**17, 3 * 10**17, 10**9
    r = spark.createDataFrame([(n, total, kept)], "n bigint, total bigint, kept bigint").select(F.expr(divergence.SHARE.format(count="n", total="total"))).first()
    assert r[0] == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def test_empty_tables(tables):
    _, _, d, i = tables
    none, nothing = d.where("false"), i.where("false")
    assert decontaminate.decontaminate(none, i).count() == 0 and search.search(none, i).count() == 0 and divergence.audit(none).count() == 0
    assert search.search(d, nothing).count() == 0
    clean = decontaminate.decontaminate(d, nothing)
    assert clean.count() == d.count() and clean.where("contaminated or n_items > 0 or n_near > 0").count() == 0
