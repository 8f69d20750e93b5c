"""Pipe tables in texts, cell typing and column profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V

KINDS = ("bool", "int", "float", "str", "null")


def markdown_tables(docs: DataFrame) -> DataFrame:
    """doc_id, table_no, n_rows, n_cols: runs of over two pipe lines, less header and rule."""
    runs = F.filter(T.find_all(F.concat(F.lit("\n"), "text", F.lit("\n")), r"(?:\n[^\n]*\|[^\n]*(?=\n)){3,}"), lambda x: x != "")
    d = docs.select("doc_id", F.posexplode(runs).alias("k", "run"))
    return d.select("doc_id", (F.col("k") + 1).alias("table_no"), (F.regexp_count("run", F.lit("\n")) - 2).alias("n_rows"), (F.regexp_count(F.regexp_extract("run", r"^\n([^\n]*)", 1), F.lit(r"\|")) - 1).alias("n_cols"))


def table_cells(docs: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no (from 1, the header is not a row), col_no, col_name, cell of every table."""
    runs = T.find_all(F.concat(F.lit("\n"), "text", F.lit("\n")), r"(?:\n[^\n]*\|[^\n]*(?=\n)){3,}")
    split = lambda run: F.transform(F.split(F.substring(run, 2, 2147483647), "\n", -1), lambda r: F.transform(F.split(F.regexp_replace(r, r"^\s*\||\|\s*$", ""), r"\|", -1), T.strip))
    d = docs.select("doc_id", F.posexplode(F.transform(runs, split)).alias("k", "rows"))
    d = d.select("doc_id", (F.col("k") + 1).alias("table_no"), F.element_at("rows", 1).alias("head"), F.posexplode(F.slice("rows", F.lit(3), F.size("rows"))).alias("r", "cells"))
    d = d.select("doc_id", "table_no", (F.col("r") + 1).alias("row_no"), "head", F.posexplode("cells").alias("c", "cell"))
    return d.select("doc_id", "table_no", "row_no", (F.col("c") + 1).alias("col_no"), F.get("head", F.col("c")).alias("col_name"), "cell")


def profile(cells: DataFrame) -> DataFrame:
    """doc_id, table_no, col_no, col_name, n, nulls, n_unique, kinds (counts by type name), has_bool, has_number,
    column_type, description. Booleans count as numbers."""
    kind, key = T.cell_kind(F.col("cell")), ["doc_id", "table_no", "col_no", "col_name"]
    k = cells.select(*key, F.when(kind != "null", F.col("cell")).alias("cell"), kind.alias("kind"))
    named = [F.count_if(F.col("kind") == x).alias(x) for x in KINDS]
    p = k.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "null").alias("nulls"), F.countDistinct("cell").alias("n_unique"), *named)
    p = p.withColumn("kinds", F.array_join(F.array_compact(F.array(*[F.when(F.col(x) > 0, F.concat(F.lit(f"{x}:"), F.col(x).cast("string"))) for x in KINDS])), ","))
    p = p.withColumn("has_bool", F.col("bool") > 0).withColumn("has_number", F.col("bool") + F.col("int") + F.col("float") > 0).drop(*KINDS)
    t = F.when(F.col("has_bool"), "boolean").when(F.col("has_number"), "number").when(F.col("n_unique") <= 10, "categorical").otherwise("text")
    first = F.when(F.col("has_bool"), "Boolean values").when(F.col("has_number"), "Numeric values").otherwise("Text values")
    size = F.when(F.col("n_unique") <= 5, "(low cardinality)").when(F.col("n_unique") > 50, "(high cardinality)")
    return p.withColumn("column_type", t).withColumn("description", F.concat(F.col("col_name"), F.lit(": "), F.concat_ws(" ", first, size, F.when(F.col("nulls") > 0, "with null values"))))


def table_notes(profiles: DataFrame) -> DataFrame:
    """doc_id, table_no, complexity, notes of each profiled table."""
    t = profiles.groupBy("doc_id", "table_no").agg(F.max("n").alias("rows"), F.count(F.lit(1)).alias("cols"), F.count_if("has_number").alias("numeric"), F.count_if(F.col("n_unique") <= 10).alias("grouping"))
    cells = F.col("rows") * F.col("cols")
    notes = F.array(
        F.when(F.col("rows") > 100, "large").when(F.col("rows") < 5, "small"), F.when(F.col("cols") > 10, "wide"),
        F.when(F.col("numeric") > 0, F.concat(F.lit("numeric:"), F.col("numeric").cast("string"))), F.when(F.col("grouping") > 0, F.concat(F.lit("grouping:"), F.col("grouping").cast("string"))),
    )
    return t.select("doc_id", "table_no", F.when(cells <= 50, "simple").when(cells <= 200, "moderate").when(cells <= 1000, "complex").otherwise("very_complex").alias("complexity"), F.concat_ws(";", F.filter(notes, lambda x: x.isNotNull())).alias("notes"))


def table_json(cells: DataFrame) -> DataFrame:
    """doc_id, table_no, headers, n_rows, rows: each table as JSON, rows as objects of typed values in column order.
    Numbers keep all digits; a name that an earlier column of the row has gets its column's number."""
    kind, s = T.cell_kind(F.col("cell")), F.col("cell")
    shown = F.when(kind == "null", "null").when(kind == "bool", F.lower(s).isin(*V.TRUE_CELLS).cast("string")).when(kind.isin("int", "float"), T.json_number(s)).otherwise(T.json_text(s))
    r = cells.groupBy("doc_id", "table_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", F.coalesce("col_name", F.lit("Column")).alias("name"), shown.alias("v"), "col_name"))).alias("c"))
    names = F.transform("c", lambda x: x["name"])
    own = lambda x, i: F.when(F.array_position("names", x["name"]) <= i, F.concat(x["name"], F.lit(" ("), x["col_no"].cast("string"), F.lit(")"))).otherwise(x["name"])
    pairs = F.transform("c", lambda x, i: F.concat(T.json_text(own(x, i)), F.lit(": "), x["v"]))
    r = r.withColumn("names", names).select("doc_id", "table_no", "row_no", F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("j"), F.transform("c", lambda x: x["col_name"]).alias("h"))
    t = r.groupBy("doc_id", "table_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "j"))).alias("r"), F.min_by("h", "row_no").alias("h"))
    return t.select("doc_id", "table_no", F.array_join("h", ",").alias("headers"), F.size("r").alias("n_rows"), F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["j"]), ", "), F.lit("]")).alias("rows"))


def value_distribution(cells: DataFrame, most: int = 20, keys: tuple[str, ...] = ("col_name",)) -> DataFrame:
    """keys, cell, n of columns with at most `most` different values: by name over all tables, or with the keys of
    table_cells for each table's own columns."""
    counts = cells.where(F.col("cell") != "").groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"))
    width = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") <= most)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return counts.alias("a").join(width.alias("b"), reduce(lambda x, y: x & y, same), "left_semi")


#: Registers of the distinct sketch (2^14: a standard error of 0.8 %) and values that the frequency sketch tracks.
REGISTERS, TRACKED = 14, 10_000


def column_sketches(cells: DataFrame) -> DataFrame:
    """One row for each column of each table: n, nulls, the counts of kinds, and two sketches to be stored and merged
    (`merged`) whatever comes later: different values, and frequent values."""
    kind = T.cell_kind(F.col("cell"))
    k = cells.select("doc_id", "table_no", "col_no", "col_name", F.when(kind != "null", F.col("cell")).alias("cell"), kind.alias("kind"))
    counts = [F.count_if(F.col("kind") == x).alias(x) for x in KINDS]
    return k.groupBy("doc_id", "table_no", "col_no", "col_name").agg(F.count(F.lit(1)).alias("n"), *counts, F.hll_sketch_agg("cell", F.lit(REGISTERS)).alias("different"), F.expr(f"approx_top_k_accumulate(cell, {TRACKED})").alias("frequent"))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """The same of the union of all columns with equal keys: of column_sketches or of what was merged before."""
    counts = [F.sum(x).alias(x) for x in ("n", *KINDS)]
    return sketches.groupBy(*keys).agg(*counts, F.hll_union_agg("different").alias("different"), F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"))


def sketched(sketches: DataFrame, most: int = 3, among: int = 1000) -> DataFrame:
    """Keys, n, nulls, n_unique, mode_kind (the commonest; of equals by KINDS) and top (value:count of the `most` frequent,
    of equals by value). n_unique is exact for small numbers, else within 0.8 % in two cases of three and 2.4 % in all but
    a few of a thousand. A count is exact while at most TRACKED values differ, else too high by at most 3.5 n / 16384."""
    other = [c for c in sketches.columns if c not in ("n", *KINDS, "different", "frequent")]
    mode = F.reduce(F.array(*[F.struct(F.col(x).alias("n"), F.lit(x).alias("kind")) for x in KINDS]), F.expr("named_struct('n', -1L, 'kind', '')"), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))["kind"]
    values = F.filter(F.expr(f"approx_top_k_estimate(frequent, {among})"), lambda x: x["item"].isNotNull())  # null is counted as a value
    found = F.array_sort(F.transform(values, lambda x: F.struct((-x["count"]).alias("c"), x["item"].alias("v"))))
    top = F.array_join(F.transform(F.slice(found, 1, most), lambda x: F.concat(x["v"], F.lit(":"), (-x["c"]).cast("string"))), ",")
    return sketches.select(*other, "n", F.col("null").alias("nulls"), F.hll_sketch_estimate("different").alias("n_unique"), mode.alias("mode_kind"), top.alias("top"))


def embedding_text(cells: DataFrame) -> DataFrame:
    """doc_id, table_no, text: a line that names the columns, then `header: value | ...` rows in column
    order, blanks as N/A."""
    name = F.coalesce("col_name", F.lit("Column"))
    shown = F.concat(name, F.lit(": "), F.when(F.col("cell") == "", "N/A").otherwise(F.col("cell")))
    rows = cells.groupBy("doc_id", "table_no", "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", shown.alias("s"), "col_name"))).alias("c"))
    rows = rows.select("doc_id", "table_no", "row_no", F.array_join(F.transform("c", lambda x: x["s"]), " | ").alias("line"), F.array_join(F.transform(F.filter("c", lambda x: x["col_name"].isNotNull()), lambda x: x["col_name"]), ", ").alias("names"))
    t = rows.groupBy("doc_id", "table_no").agg(F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("ls"), F.min_by("names", "row_no").alias("names"))
    return t.select("doc_id", "table_no", F.concat(F.lit("Table with columns: "), "names", F.lit("\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("text"))


def most_frequent(counts: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
