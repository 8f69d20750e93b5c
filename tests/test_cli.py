"""The command line on files of all kinds."""

import json

import pytest

from quillspark.__main__ import main
from quillspark.operators.reports import word_sections
from quillspark.sources import docx, pdf
from pyspark.sql import functions as F

TEXT = "# Guide\n\nSee Section 2. The API returns JSON.\n\n## Setup\n\nname: value here\ncolor: red\n\n| a | b |\n|---|---|\n| 1 | x |\n| 2 | y |\n"


def lines(folder):
    return [json.loads(x) for f in sorted(folder.glob("*.json")) for x in f.read_text().splitlines()]


@pytest.mark.parametrize("kind", ["md", "pdf", "docx", "html"])
def test_commands(spark, tmp_path, kind):
    (tmp_path / "in").mkdir()
    made = {"md": TEXT.encode(), "pdf": pdf.made([TEXT], "T", [("A", 0, 1)]), "docx": docx.made(TEXT), "html": b"<h1>Guide</h1><p>See Section 2.</p>"}[kind]
    (tmp_path / f"in/a b.{kind}").write_bytes(made)
    if kind in ("pdf", "docx"):
        (tmp_path / f"in/bad.{kind}").write_bytes(b"bad")
    for what in ("convert", "analyze", "extract", "rag"):
        main([what, f"{tmp_path}/in", f"{tmp_path}/{what}", "--kind", kind, *(["--format", "qdrant"] if what == "rag" else [])])
        assert len(lines(tmp_path / what / "errors")) == (kind in ("pdf", "docx"))
    assert len(list((tmp_path / "convert/files").glob("*/README.md"))) == 1 and list((tmp_path / "convert/files").glob("*/sections/01-*.md"))
    assert len(lines(tmp_path / "analyze/analysis")) == 1 and len(lines(tmp_path / "rag/qdrant_format")) >= 1
    assert (lines(tmp_path / "analyze/chapters")[0]["title"] == "A") if kind == "pdf" else True
    assert {"structure", "sections", "fields", "items", "content"} <= {p.name for p in (tmp_path / "extract").iterdir()}


def test_long_word_sections_are_split(spark):
    text = "\n".join(f"## Part {k}\n" + "word " * 30 for k in range(6))
    s = spark.createDataFrame([(1, 1, "Long", text, 1), (1, 2, "Short", "x", 2), (1, 3, "None", None, 1)], "doc_id int, section_id int, title string, content string, level int")
    got = {r["path"]: r["body"] for r in word_sections(s, F.lit("content"), 100, 80).collect()}
    parts = sorted(p for p in got if "Long" in p)
    assert len(parts) > 1 and parts[0] == "sections/01-Long-part01.md" and got[parts[0]].startswith(f"# Long (1 of {len(parts)})\n\nKind: content\n")
    assert all(sum(f"## Part {k}" in got[p] for p in parts) == 1 for k in range(6)) and {"sections/02-Short.md", "sections/03-None.md"} < set(got)
