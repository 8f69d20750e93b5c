"""Outlines as rows against a recursion in Python and in DuckDB: deep, wide, cyclic and broken ones."""

import random

import duckdb
import pytest

from quillspark.operators.trees import cycles, flatten_adjacency

SCHEMA = "doc_id int, node int, parent int, ord int, title string"


def walk(rows):
    """(doc, ord, node, title, level) by plain recursion from the roots."""
    out = []
    for d in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == d}
        below = {}
        for r in own.values():
            below.setdefault(r[2] if r[2] in own else None, []).append(r)
        todo, k = [(r, 0) for r in sorted(below.get(None, []), key=lambda r: (r[3], r[1]), reverse=True)], 0
        while todo:
            r, level = todo.pop()
            out.append((d, k, r[1], r[4], level))
            k += 1
            todo += [(c, level + 1) for c in sorted(below.get(r[1], []), key=lambda r: (r[3], r[1]), reverse=True)]
    return out


def trees(seed):
    r = random.Random(seed)
    rows = []
    for d in range(12):
        n = r.choice([1, 2, 30, 60])
        for i in range(n):
            parent = None if i == 0 else r.choice([i - 1, i - 1, r.randrange(i), None, 999 if r.random() < 0.1 else i - 1])
            rows.append([d, i, parent, r.randint(0, 3), f"t{i}"])
        if d % 3 == 0 and n > 3:  # a cycle and what hangs from it
            own = rows[-n:]
            own[1][2], own[2][2], own[3][2] = 2, 1, 1
        if d % 4 == 1:
            rows[-1][2] = rows[-1][1]  # its own parent
    rows += [[50, i, i - 1 if i else None, 0, f"deep{i}"] for i in range(300)]
    rows += [[51, i, (i + 1) % 37, 0, f"ring{i}"] for i in range(37)] + [[51, 100 + i, 99 + i if i else 5, 0, "tail"] for i in range(20)]
    rows += [[None, 1, None, 0, "no document"], [52, None, None, 0, "no node"]]
    return [tuple(x) for x in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_flatten(spark, seed):
    rows = trees(seed)
    known = [r for r in rows if r[1] is not None]
    want = walk(known)
    nodes = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in flatten_adjacency(nodes).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and max(w[4] for w in want) == 299
    inside = {(r[0], r[1]) for r in known} - {(w[0], w[2]) for w in want}
    assert {tuple(r) for r in cycles(nodes).collect()} == inside and len(inside) >= 57
    con = duckdb.connect()
    con.execute("CREATE TABLE n (doc_id INT, node INT, parent INT, ord INT, title VARCHAR)")
    con.executemany("INSERT INTO n VALUES (?, ?, ?, ?, ?)", [r for r in known if r[0] is not None])
    duck = con.execute("""WITH RECURSIVE t AS (SELECT n.*, 0 AS level, [{'o': ord, 'n': node}] AS way FROM n WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM n m WHERE m.doc_id = n.doc_id AND m.node = n.parent)
      UNION ALL SELECT n.*, level + 1, list_append(way, {'o': n.ord, 'n': n.node}) FROM t JOIN n ON n.doc_id = t.doc_id AND n.parent = t.node)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY way) - 1, node, title, level FROM t""").fetchall()
    assert sorted(x for x in got if x[0] is not None) == sorted(duck)


def test_empty(spark):
    assert flatten_adjacency(spark.createDataFrame([], SCHEMA)).count() == 0
