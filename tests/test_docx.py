"""Word files made here: what real ones hold, large ones and damaged ones."""

import io
import random
import tracemalloc
import zipfile

from quillspark.sources import docx

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:wp="urn:wp" xmlns:mc="urn:mc"'


def package(body, parts=()):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, text in dict(parts).items():
            z.writestr(name, text)
    return b.getvalue()


def p(inner, more=""):
    return f"<w:p><w:pPr>{more}</w:pPr>{inner}</w:p>"


def r(text, more=""):
    return f'<w:r><w:rPr>{more}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def cell(inner, more=""):
    return f"<w:tc><w:tcPr>{more}</w:tcPr>{inner}</w:tc>"


PARTS = {
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="berschrift1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:styleId="O"><w:name w:val="Own"/><w:pPr><w:outlineLvl w:val="2"/></w:pPr></w:style></w:styles>',
    "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
    "word/_rels/document.xml.rels": '<Relationships xmlns="u"><Relationship Id="r1" Target="https://x.y/z"/><Relationship Id="r2" Target="media/image1.png"/></Relationships>',
}


def item(text, level):
    return p(r(text), f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="3"/></w:numPr>')


def test_what_documents_hold():
    body = (
        p(r("Big"), '<w:pStyle w:val="T"/>') + p(r("One", "<w:b/>"), '<w:pStyle w:val="berschrift1"/>') + p(r("Third"), '<w:pStyle w:val="O"/>') + p(r("Two"), '<w:pStyle w:val="Heading2"/>')
        + p(r("plain ") + r("bold ", "<w:b/>") + r("both", "<w:b/><w:i/>") + r(" not", '<w:b w:val="0"/>') + "<w:r><w:tab/><w:t>t</w:t><w:br/><w:t>line &amp; two</w:t></w:r>") + p("")
        + item("a", 0) + item("b", 1) + item("c", 0) + p(r("between")) + item("d", 0)
        + p('<w:hyperlink r:id="r1">' + r("here", "<w:b/>") + "</w:hyperlink>" + r(" or ") + '<w:hyperlink w:anchor="top">' + r("up") + "</w:hyperlink>")
        + p('<w:r><w:drawing><wp:docPr descr="a cat"/><a:blip r:embed="r2"/></w:drawing></w:r><w:del>' + r("gone") + "</w:del><mc:AlternateContent><mc:Choice>" + r("kept") + "</mc:Choice><mc:Fallback>" + r("twice") + "</mc:Fallback></mc:AlternateContent><w:r><w:instrText>FIELD</w:instrText></w:r>")
        + "<w:tbl><w:tr>" + cell(p(r("x|y")), '<w:gridSpan w:val="2"/>') + cell(p(r("z")) + p(r("zz")), '<w:vMerge w:val="restart"/>') + "</w:tr><w:tr>" + cell(p(r("1"))) + cell("<w:tbl><w:tr>" + cell(p(r("in"))) + cell(p(r("ner"))) + "</w:tr></w:tbl>" + p("")) + cell(p(r("hidden")), "<w:vMerge/>") + "</w:tr></w:tbl>"
        + "<w:tbl><w:tr>" + cell(p(r("next"))) + "</w:tr></w:tbl>" + p(r("end"))
    )
    assert docx.markdown_of(package(body, PARTS)) == (
        "# Big\n\n# One\n\n### Third\n\n## Two\n\nplain **bold** ***both*** not\tt\nline & two\n\n1. a\n  - b\n2. c\n\nbetween\n\n3. d\n\n[**here**](https://x.y/z) or [up](#top)\n\n![a cat](media/image1.png)kept\n\n"
        "| x\\|y |  | z zz |\n|---|---|---|\n| 1 | in ner |  |\n\n| next |\n|---|\n\nend"
    )


def test_memory_stays_with_the_text(tmp_path):
    """A body of 49 MB of markup is parsed as it is unpacked: what is held is near the Markdown that comes out."""
    noise = "".join(f'<w:bookmarkStart w:id="{k}" w:name="bookmark{k}"/>' for k in range(200))
    body = (p(r("word " * 5)) + f"<w:p>{noise}</w:p>") * 5000
    data = package(body)
    assert len(body) > 49_000_000
    tracemalloc.start()
    text = docx.markdown_of(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert text.count("word") == 25_000 and peak < 8_000_000


def test_made_files_and_damage(spark, tmp_path):
    md = "# Title é漢😀\n\nText <b> & \"more\"\n- one\n* two\n\n| a | b |\n|---|---|\n| 1 |  |\n\n### Deep"
    (tmp_path / "d").mkdir()
    good = docx.made(md)
    (tmp_path / "d/a.docx").write_bytes(good)
    (tmp_path / "b.docx").write_bytes(b"PK no zip")
    (tmp_path / "c.docx").write_bytes(package("", {"x": "y"}).replace(b"word/document.xml", b"word/documenx.xml"))
    (tmp_path / "e.docx").write_bytes(package(""))
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w") as z:
        z.writestr("word/document.xml", '<!DOCTYPE d [<!ENTITY a "aaaaaaaaaa"><!ENTITY b "&a;&a;&a;">]><d>&b;</d>')
    (tmp_path / "f.docx").write_bytes(bomb.getvalue())
    (tmp_path / "g.docx").write_bytes(package("<w:p>"))
    got = {x["path"].split("/")[-1]: (x["text"], x["error"]) for x in docx.read_docx(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("# Title é漢😀\n\nText <b> & \"more\"\n\n- one\n- two\n\n| a | b |\n|---|---|\n| 1 |  |\n\n### Deep", None)
    assert got["b.docx"] == got["c.docx"] == (None, "not a Word document") and got["e.docx"] == ("", None) and got["f.docx"] == (None, "entity declarations") and got["g.docx"][0] is None
    rnd, rows = random.Random(1), [("null", None)]
    for k in range(150):
        d = bytearray(good)
        for _ in range(rnd.randint(1, 5)):
            d[rnd.randrange(len(d))] = rnd.randrange(256)
        rows.append((f"f{k}", bytes(d[: rnd.randrange(len(d))] if k % 4 == 0 else d)))
    assert docx.docx_markdown(spark.createDataFrame(rows, "path string, content binary")).where("text is null and error is null").count() == 0


def test_too_large(monkeypatch):
    monkeypatch.setattr(docx, "MOST", 1000)
    try:
        docx.markdown_of(package(p(r("x" * 2000))))
    except ValueError as e:
        assert str(e) == "too large"
    else:
        raise AssertionError
