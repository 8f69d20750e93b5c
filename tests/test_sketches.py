"""Sketches of columns against exact counts: within their stated errors, the same however they are split and merged."""

import random
from collections import Counter

from quillspark.operators import tables


def cells(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, table_no int, row_no int, col_no int, col_name string, cell string")


def test_small_columns_are_exact(spark):
    r = random.Random(1)
    rows = [(d, 1, k, c, f"c{c}" if c else None, r.choice(["yes", "12", "3.5", "x", "", None, f"v{r.randint(0, 30)}"])) for d in range(5) for k in range(60) for c in range(3)]
    rows += [(9, 1, k, 1, "blank", "") for k in range(4)]
    sketches = tables.column_sketches(cells(spark, rows))
    for got, keys in ((tables.sketched(sketches).collect(), (0, 1, 3, 4)), (tables.sketched(tables.merged(sketches, "col_name")).collect(), (4,))):
        want = {}
        for x in rows:
            want.setdefault(tuple(x[k] for k in keys), []).append(x[5])
        assert len(got) == len(want)
        for g in got:
            values = want[tuple(g)[: len(keys)]]
            full = Counter(v for v in values if v)
            kind = lambda v: "null" if not v else "bool" if v == "yes" else "int" if v == "12" else "float" if v == "3.5" else "str"
            kinds = Counter(map(kind, values))
            assert (g["n"], g["nulls"], g["n_unique"]) == (len(values), sum(not v for v in values), len(full))
            assert g["mode_kind"] == max(tables.KINDS, key=lambda k: (kinds[k], -tables.KINDS.index(k)))
            assert g["top"] == ",".join(f"{v}:{n}" for v, n in sorted(full.items(), key=lambda x: (-x[1], x[0]))[:3])


def test_large_columns_within_bounds(spark):
    """200,000 different values with a few heavy ones, in 50 tables: stored, merged in two steps, estimated."""
    n = 200_000
    light = spark.range(n).selectExpr("int(id % 50) AS doc_id", "1 AS table_no", "int(id) AS row_no", "1 AS col_no", "'c' AS col_name", "concat('v', id) AS cell")
    heavy = spark.range(30_000).selectExpr("int(id % 50)", "1", "int(id)", "1", "'c'", "concat('heavy', id % 3)")
    s = tables.column_sketches(light.unionByName(heavy.toDF(*light.columns)))
    halves = tables.merged(s.selectExpr("*", "doc_id % 2 AS half"), "half", "col_name")
    once, twice = tables.sketched(tables.merged(s, "col_name")).first(), tables.sketched(tables.merged(halves, "col_name")).first()
    for g in (once, twice):
        assert g["n"] == n + 30_000 and abs(g["n_unique"] - (n + 3)) < 0.03 * n
        counts = dict(x.split(":") for x in g["top"].split(","))
        assert set(counts) == {"heavy0", "heavy1", "heavy2"} and all(10_000 <= int(c) <= 10_000 + 3.5 * g["n"] / 16384 for c in counts.values())
