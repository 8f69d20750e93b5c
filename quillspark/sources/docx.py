"""Word documents (.docx) as Markdown: headings, lists, tables, links, pictures, bold and italic.

`read_docx` reads files through Spark's binary reader and parses each in the task that holds it. A document's body is
parsed as a stream of XML events while it is unpacked: beside the Markdown itself only the current
paragraph and table row are held, however large the body.

Defined cases: a file that isn't a Word document, holds entity declarations, or unpacks beyond MOST bytes is
one row with its error and null text; headings come from styles named or numbered as headings and from outline
levels; deleted text, fields' codes and the fallback of alternative contents are left out; a merged cell is empty but
for its first; tables within cells become their text; no body gives an empty text.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST, STEP = 1 << 30, 1 << 16


def events(zipped: zipfile.ZipFile, name: str, start, end=None, chars=None) -> None:
    """Feeds one part of the package to the handlers, by local names and attributes."""
    p = expat.ParserCreate(namespace_separator=" ")
    local = lambda s: s.rsplit(" ", 1)[-1]

    def declared(*_):
        raise ValueError("entity declarations")

    p.EntityDeclHandler = declared
    p.StartElementHandler = lambda tag, a: start(local(tag), {local(k): v for k, v in a.items()})
    if end:
        p.EndElementHandler = lambda tag: end(local(tag))
    if chars:
        p.CharacterDataHandler = chars
    n = 0
    with zipped.open(name) as f:
        while block := f.read(STEP):
            n += len(block)
            if n > MOST:
                raise ValueError("too large")
            p.Parse(block, False)
    p.Parse(b"", True)


class Package:
    """What the body refers to: headings by style, list kinds, targets of links and pictures."""

    def __init__(self, zipped: zipfile.ZipFile):
        self.zipped, names = zipped, set(zipped.namelist())
        self.levels, self.kinds, self.targets = {}, {}, {}
        if "word/styles.xml" in names:
            self.styles()
        if "word/numbering.xml" in names:
            self.numbering()
        if "word/_rels/document.xml.rels" in names:
            events(zipped, "word/_rels/document.xml.rels", lambda tag, a: self.targets.update({a["Id"]: a.get("Target", "")}) if tag == "Relationship" and "Id" in a else None)

    def styles(self) -> None:
        now = [""]

        def start(tag, a):
            if tag == "style":
                now[0] = a.get("styleId", "")
            elif tag == "name" and now[0]:
                m = re.fullmatch(r"(?i)heading (\d)|(title)", a.get("val", ""))
                if m:
                    self.levels[now[0]] = int(m[1] or 1)
            elif tag == "outlineLvl" and now[0] and a.get("val", "9").isdigit() and int(a["val"]) < 9:
                self.levels.setdefault(now[0], int(a["val"]) + 1)

        events(self.zipped, "word/styles.xml", start)

    def numbering(self) -> None:
        now, kinds, level = [None, None], {}, ["0"]

        def start(tag, a):
            if tag == "abstractNum":
                now[0] = a.get("abstractNumId")
            elif tag == "lvl":
                level[0] = a.get("ilvl", "0")
            elif tag == "numFmt" and now[0] is not None:
                kinds[now[0], level[0]] = a.get("val")
            elif tag == "num":
                now[0], now[1] = None, a.get("numId")
            elif tag == "abstractNumId" and now[1] is not None:
                self.kinds |= {(now[1], lvl): kind for (of, lvl), kind in kinds.items() if of == a.get("val")}

        events(self.zipped, "word/numbering.xml", start)

    def heading(self, style: str) -> int | None:
        m = re.fullmatch(r"Heading([1-9])", style)
        return self.levels.get(style, int(m[1]) if m else None)


def on(a: dict) -> bool:
    return a.get("val", "true") not in ("0", "false", "none", "off")


class Body:
    """Blocks of Markdown from the events of a body."""

    def __init__(self, package: Package):
        self.package, self.out, self.last = package, [], ""
        self.skip = self.tables = 0
        self.row: list[str] | None = None
        self.cell: list[str] = []
        self.rows, self.span, self.merged, self.counts = 0, 1, False, {}
        self.inside: list[str] = []
        self.fresh()

    def fresh(self) -> None:
        self.runs: list[tuple[str, bool, bool]] = []
        self.style, self.level, self.list, self.depth, self.link, self.alt = "", None, None, "0", None, ""

    def put(self, kind: str, text: str) -> None:
        """A block; rows of a table and items of a list follow without a blank line."""
        if self.out:
            self.out.append("\n" if kind and kind == self.last else "\n\n")
        self.out.append(text)
        self.last = kind

    def add(self, text: str) -> None:
        if text:
            bold, italic = self.bold, self.italic
            if self.runs and self.runs[-1][1:] == (bold, italic):
                self.runs[-1] = (self.runs[-1][0] + text, bold, italic)
            else:
                self.runs.append((text, bold, italic))

    bold = italic = False

    def text(self, plain: bool) -> str:
        def marked(t, bold, italic):
            mark = "" if plain else "**" * bold + "*" * italic
            core = t.strip()
            return t if not mark or not core else t[: len(t) - len(t.lstrip())] + mark + core + mark[::-1] + t[len(t.rstrip()) :]

        return "".join(marked(*r) for r in self.runs).strip()

    def start(self, tag: str, a: dict) -> None:
        if self.skip or tag in ("Fallback", "del", "moveFrom"):
            self.skip += 1
            return
        self.inside.append(tag)
        above = self.inside[-2] if len(self.inside) > 1 else ""
        if tag == "p" and not self.tables:
            self.fresh()
        elif tag == "tbl":
            self.tables += 1
            self.rows = 0 if self.tables == 1 else self.rows
        elif tag == "tr" and self.tables == 1:
            self.row = []
        elif tag == "tc" and self.tables == 1:
            self.cell, self.span, self.merged = [], 1, False
            self.fresh()
        elif tag == "gridSpan" and self.tables == 1:
            self.span = int(a.get("val", "1"))
        elif tag == "vMerge" and self.tables == 1:
            self.merged = a.get("val", "continue") == "continue"
        elif tag == "pStyle":
            self.style = a.get("val", "")
        elif tag == "outlineLvl" and a.get("val", "9").isdigit() and int(a["val"]) < 9:
            self.level = int(a["val"]) + 1
        elif tag == "ilvl":
            self.depth = a.get("val", "0")
        elif tag == "numId":
            self.list = a.get("val")
        elif tag == "r":
            self.bold = self.italic = False
        elif tag in ("b", "i") and above == "rPr" and "r" in self.inside:
            setattr(self, "bold" if tag == "b" else "italic", on(a))
        elif tag == "tab" and above == "r":
            self.add("\t")
        elif tag in ("br", "cr") and above == "r":
            self.add("\n" if not self.tables else " ")
        elif tag == "hyperlink":
            self.bold = self.italic = False
            self.link = self.package.targets.get(a.get("id", ""), "#" + a["anchor"] if "anchor" in a else None)
            if self.link:
                self.add("[")
        elif tag == "docPr":
            self.alt = a.get("descr") or a.get("name") or ""
        elif tag == "blip" and a.get("embed") in self.package.targets:
            self.bold = self.italic = False
            self.add(f"![{self.alt}]({posixpath.normpath(self.package.targets[a['embed']])})")

    def chars(self, data: str) -> None:
        if not self.skip and self.inside and self.inside[-1] == "t":
            self.add(data)

    def end(self, tag: str) -> None:
        if self.skip:
            self.skip -= 1
            return
        self.inside.pop()
        if tag == "hyperlink" and self.link:
            self.bold = self.italic = False
            self.add(f"]({self.link})")
            self.link = None
        elif tag == "p":
            if self.tables:
                self.cell.append(re.sub(r"\s*\n\s*", " ", self.text(False)))
                self.fresh()
            else:
                self.paragraph()
        elif tag == "tc" and self.tables == 1 and self.row is not None:
            text = "" if self.merged else " ".join(x for x in self.cell if x).replace("|", "\\|")
            self.row += [text, *[""] * (self.span - 1)]
        elif tag == "tr" and self.tables == 1 and self.row is not None:
            self.put("table" if self.rows else "new table", "| " + " | ".join(self.row) + " |")
            self.last = "table"
            if not self.rows:
                self.put("table", "|" + "---|" * len(self.row))
            self.rows, self.row = self.rows + 1, None
        elif tag == "tbl":
            self.tables -= 1
            if not self.tables:
                self.last = "end of table"

    def paragraph(self) -> None:
        level = self.level or self.package.heading(self.style)
        text = self.text(level is not None)
        if not text:
            self.last = "" if self.last == "list" else self.last
            return
        if level is not None:
            self.put("", "#" * min(level, 6) + " " + re.sub(r"\s+", " ", text))
        elif self.list not in (None, "0"):
            kind, key = self.package.kinds.get((self.list, self.depth), "bullet"), (self.list, int(self.depth))
            self.counts = {k: n for k, n in self.counts.items() if k[0] != key[0] or k[1] <= key[1]}
            self.counts[key] = self.counts.get(key, 0) + 1
            mark = "-" if kind in ("bullet", "none") else f"{self.counts[key]}."
            self.put("list", "  " * key[1] + f"{mark} {text}")
        else:
            self.put("", text)


def markdown_of(content: bytes) -> str:
    try:
        zipped = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise ValueError("not a Word document") from None
    with zipped:
        if "word/document.xml" not in zipped.namelist():
            raise ValueError("not a Word document")
        body = Body(Package(zipped))
        events(zipped, "word/document.xml", body.start, body.end, body.chars)
        return "".join(body.out)


def docx_markdown(files: DataFrame) -> DataFrame:
    """path, text, error of files (path, content)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            text, error = [], []
            for content in b.column(1).to_pylist():
                try:
                    text.append(markdown_of(content or b""))
                    error.append(None)
                except Exception as e:  # one broken file doesn't end the job
                    text.append(None)
                    error.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(error, pa.string())], names=["path", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, text (Markdown), error of every Word document under the path."""
    from .tables import read_binary

    return docx_markdown(read_binary(spark, path, "docx"))


SPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def made(text: str) -> bytes:
    """A plain Word document of a Markdown text: its headings, pipe tables and bullets as such, every other line that isn't blank a paragraph."""
    clean = lambda s: re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "�", s)
    para = lambda s, more="": f"<w:p>{more and f'<w:pPr>{more}</w:pPr>'}<w:r><w:t xml:space=\"preserve\">{escape(clean(s))}</w:t></w:r></w:p>"
    out, rows = [], []

    def table():
        cells = [[c.strip() for c in r.strip().strip("|").split("|")] for r in rows]
        if rows:
            out.append("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in r) + "</w:tr>" for r in cells) + "</w:tbl>")
        rows.clear()

    for line in (text or "").split("\n"):
        s = line.strip()
        if re.fullmatch(r"\|.*\|", s):
            if not re.fullmatch(r"[|\-: ]+", s) or not rows:
                rows.append(s)
            continue
        table()
        head, item = re.match(r"(#{1,6})\s+(\S.*)", s), re.match(r"[-*]\s+(\S.*)", s)
        if head:
            out.append(para(head[2], f"<w:pStyle w:val={quoteattr(f'Heading{len(head[1])}')}/>"))
        elif item:
            out.append(para(item[1], '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>'))
        else:
            out.append(para(s))
    table()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{SPACE}"><w:body>{"".join(out)}</w:body></w:document>'.encode("utf-8", "replace"))
    return buffer.getvalue()


def markdown_as_docx(docs: DataFrame) -> DataFrame:
    """path (doc_id as text), content: each Markdown document as a Word file."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([made(t) for t in b.column(1).to_pylist()], pa.binary())], names=["path", "content"])

    return docs.select(F.col("doc_id").cast("string").alias("path"), "text").mapInArrow(run, "path string, content binary")
