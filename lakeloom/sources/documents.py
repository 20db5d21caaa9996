"""Document sources: HTML, HTML tables, mail archives, office packages, format by content."""

from __future__ import annotations

import email
import email.policy
import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose content is no text, and those that begin a line.
SKIPPED = {"script", "style", "noscript", "template"}
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "main", "blockquote", "pre", "title", "hr", "dt", "dd"}
CELLS = {"td", "th"}


class _Events(HTMLParser):
    """What a page is made of, in order: ("open", tag, attributes), ("close", tag, {}) and ("text", content, {})."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple[str, str, dict]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.seen.append(("open", tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        self.seen.append(("close", tag, {}))

    def handle_data(self, data: str) -> None:
        self.seen.append(("text", data, {}))


def html_events(html: str | None) -> list[tuple[str, str, dict]]:
    parser = _Events()
    parser.feed(html or "")
    parser.close()
    return parser.seen


def _one_line(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def html_to_text(html: str | None) -> str:
    """Title first, then the body by lines; scripts and styles dropped, cells parted by " | ", entities decoded."""
    title, body, line, hidden, titled = [], [], [], 0, False
    for what, value, _ in html_events(html):
        if what == "text":
            if titled:
                title.append(value)
            elif hidden <= 0:
                line.append(value)
            continue
        if value in SKIPPED:
            hidden = max(0, hidden + (1 if what == "open" else -1))
        elif value == "title":
            titled = what == "open"
        elif value in CELLS and what == "open" and line:
            line.append(" | ")
        elif value in BLOCKS:
            body.append(_one_line(line))
            line = []
    lines = [_one_line(title), *body, _one_line(line)]
    return "\n".join(x for x in lines if x.strip(" |"))


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(html_to_text)


_CELL = T.StructType([T.StructField(n, t) for n, t in (("table_no", T.IntegerType()), ("r", T.IntegerType()), ("c", T.IntegerType()), ("rowspan", T.IntegerType()), ("colspan", T.IntegerType()), ("is_header", T.BooleanType()), ("text", T.StringType()))])


class _Grid:
    """A table that is being read: where the next cell goes, and from which row on each column is free."""

    def __init__(self, number: int) -> None:
        self.number, self.row, self.at, self.free = number, -1, 0, []
        self.cell: tuple | None = None
        self.words: list[str] = []

    def next_row(self) -> None:
        self.row, self.at = self.row + 1, 0

    def place(self, head: bool, rows: int, columns: int) -> None:
        self.row = max(self.row, 0)
        while self.at < len(self.free) and self.free[self.at] > self.row:
            self.at += 1
        self.cell, self.words = (self.number, self.row, self.at, rows, columns, head), []
        self.free += [0] * (self.at + columns - len(self.free))
        self.free[self.at : self.at + columns] = [self.row + rows] * columns
        self.at += columns

    def finished(self) -> list[tuple]:
        """The open cell, if there is one; it is open no more."""
        done, self.cell = ([(*self.cell, _one_line(self.words))] if self.cell else []), None
        return done


#: Largest spans, as browsers limit them.
ROWSPAN, COLSPAN = 65534, 1000


def _span(attributes: dict, name: str, most: int) -> int:
    said = attributes.get(name) or ""
    return min(most, max(1, int(said))) if said.isdecimal() else 1


def html_cells(html: str | None) -> list[tuple]:
    """Cells by table, row and column; a cell ends at the next cell, row or end of its table at the latest."""
    out: list[tuple] = []
    grids: list[_Grid] = []
    tables = 0
    for what, value, attributes in html_events(html):
        if value == "table" and what == "open":
            grids.append(_Grid(tables))
            tables += 1
        elif not grids:
            continue
        elif what == "text":
            grids[-1].words.append(value)
        elif value in CELLS or value in ("tr", "table"):
            out += grids[-1].finished()
            if value == "table":
                grids.pop()
            elif value == "tr" and what == "open":
                grids[-1].next_row()
            elif what == "open":
                grids[-1].place(value == "th", _span(attributes, "rowspan", ROWSPAN), _span(attributes, "colspan", COLSPAN))
    for g in grids:
        out += g.finished()
    return sorted(out, key=lambda c: c[:3])


@F.pandas_udf(T.ArrayType(_CELL))
def _cells(html: pd.Series) -> pd.Series:
    names = [f.name for f in _CELL.fields]
    return html.map(lambda x: [dict(zip(names, c, strict=True)) for c in html_cells(x)])


def html_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table_no, r, c, rowspan, colspan, is_header, text): cells with their place in the grid."""
    return pages.select(key, F.explode(_cells(html)).alias("x")).select(key, "x.*")


def mail_to_text(data: bytes) -> str:
    """Subject and body of a mail or MIME archive; attachments are left out, HTML serves where there is no plain text."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    plain, html = [], []
    for part in message.walk():
        if part.is_multipart() or part.get_content_disposition() == "attachment":
            continue
        kind = part.get_content_type()
        if kind in ("text/plain", "text/html"):
            try:
                body = part.get_content()
            except (LookupError, UnicodeError):
                body = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
            (plain if kind == "text/plain" else html).append(body)
    body = "\n".join(plain).strip() or "\n".join(html_to_text(x) for x in html)
    return "\n".join(x for x in (str(message["subject"] or "").strip(), body.strip()) if x)


#: Mails of a batch that are worked on at a time.
SLICE = 64


@F.arrow_udf(T.StringType())
def mail_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of a batch a slice at a time is held as bytes and text."""
    for content in batches:
        for at in range(0, len(content), SLICE):
            yield pa.array([mail_to_text(x or b"") for x in content.slice(at, SLICE).to_pylist()], pa.string())


def _xml_texts(data: bytes, block: str, text: str) -> list[str]:
    """Texts of the elements named ``text``, joined within each element named ``block`` (local names)."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    for b in ElementTree.fromstring(data).iter():
        if local(b) == block:
            line = "".join(t.text or "" for t in b.iter() if local(t) == text)
            if line.strip():
                out.append(line.strip())
    return out


#: Parts, block and text elements of the packages: Word, PowerPoint, Hangul.
_PACKAGES = {"docx": ("word/document.xml", "p", "t"), "pptx": ("ppt/slides/slide", "p", "t"), "hwpx": ("Contents/section", "p", "t")}


def office_to_text(data: bytes) -> str | None:
    """Text of a docx, pptx, hwpx or xlsx package by lines; null for anything else or a damaged file."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = z.namelist()
            for prefix, block, text in _PACKAGES.values():
                parts = sorted((n for n in names if n.startswith(prefix) and n.endswith(".xml")), key=lambda n: (len(n), n))
                if parts:
                    return "\n".join(line for n in parts for line in _xml_texts(z.read(n), block, text))
            if "xl/workbook.xml" in names:
                shared = _xml_texts(z.read("xl/sharedStrings.xml"), "si", "t") if "xl/sharedStrings.xml" in names else []
                return "\n".join(line for n in sorted(x for x in names if x.startswith("xl/worksheets/sheet")) for line in _sheet_lines(z.read(n), shared))
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
        return None
    return None


def _sheet_lines(data: bytes, shared: list[str]) -> list[str]:
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    lines = []
    for row in (e for e in ElementTree.fromstring(data).iter() if local(e) == "row"):
        cells = []
        for c in (e for e in row if local(e) == "c"):
            v = "".join(x.text or "" for x in c.iter() if local(x) in ("v", "t"))
            cells.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(shared) else v)
        if any(x.strip() for x in cells):
            lines.append(" | ".join(x.strip() for x in cells if x.strip()))
    return lines


@F.pandas_udf(T.StringType())
def office_text(content: pd.Series) -> pd.Series:
    return content.map(lambda x: office_to_text(bytes(x or b"")))


def sniff(content: Column) -> Column:
    """Real format by the first bytes: pdf, png, jpg, gif, hwp (OLE), zip package, html, xml, text or unknown."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.decode(F.substring(content, 1, 400), "ISO-8859-1"))
    starts = lambda *x: sum((F.startswith(head, F.lit(h)).cast("int") for h in x), F.lit(0)) > 0
    return (
        F.when(starts("25504446"), "pdf")
        .when(starts("89504E47"), "png")
        .when(starts("FFD8FF"), "jpg")
        .when(starts("47494638"), "gif")
        .when(starts("D0CF11E0A1B11AE1"), "ole")
        .when(starts("504B0304"), "zip")
        .when(starts("1F8B"), "gzip")
        .when(text.rlike(r"^\s*(?:<!doctype html|<html)"), "html")
        .when(text.rlike(r"^\s*<\?xml"), "xml")
        .when(F.length(content) == 0, "empty")
        .when(~text.rlike(r"[\x00-\x08]"), "text")
        .otherwise("unknown")
    )
