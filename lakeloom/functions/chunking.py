"""Chunking: articles where a text has them, else sections of prose; thin chunks merge, headings are inherited; table payloads to text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions import text as tx

# Fixed values of the splitter, in characters, and how lines begin or end that open a section, an item or a question.
TARGET, HARD, CAP = 700, 1100, 1400
THIN_BODY, THIN_MERGE = 20, 40
ARTICLES, ARTICLE_MOST = 3, 1600
HEADING_LINE, BULLET_LINE, QUESTION_LINE = 60, 200, 120
ARTICLE = re.compile(r"(?m)^\s*(?=제\s*\d+\s*조(?:의\s*\d+)?\s*[(（]?)")
SECTION = re.compile(r"제\s*\d+\s*[장절관조]|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+\s*[.、\s]|\d+(?:-\d+)?\s*[.)]\s|[가나다라마바사아자차카타파하]\s*[.)]\s|[□■◆▶◇]|[<〈《][^>〉》]{2,40}[>〉》]\s*$")
BULLET = re.compile(r"[○◦▪●·•※\-–]\s?\S")
QUESTION = re.compile(r"(?:\?|？|나요|가요|까요|습니까|ㅂ니까|인가요|는지요)\s*$")

_ARTICLE_HEAD = re.compile(r"제\s*\d+\s*조(?:의\s*\d+)?(?:\s*[(（][^)）\n]*[)）])?")
_SENTENCE = re.compile(r"(?<=[.?!。])\s+|(?<=다\.)\s*")
_SENTENCE_TAIL = re.compile(r"[.?!。？]\s*$|다\s*$")
_SUBSTANCE = re.compile(r"[가-힣A-Za-z0-9]")


class Chunk(NamedTuple):
    heading: str
    text: str


def substance(text: str) -> int:
    return len(_SUBSTANCE.findall(text))


def _merge(chunks: list[Chunk], least: int) -> list[Chunk]:
    out: list[Chunk] = []
    carry: list[Chunk] = []
    thin = 0

    def joined(parts: list[Chunk]) -> Chunk:
        return Chunk(next((c.heading for c in parts if c.heading), ""), "\n".join(c.text for c in parts))

    for c in chunks:
        carry.append(c)
        thin += substance(c.text)
        if thin >= least:
            out.append(joined(carry))
            carry, thin = [], 0
    if carry:
        last = [out.pop()] if out else []
        out.append(joined([*last, *carry]))
    return out


def merge_thin(chunks: list[str], least: int = THIN_MERGE) -> list[str]:
    """A thin chunk joins the next one; a thin last one joins the one before."""
    return [c.text for c in _merge([Chunk("", c) for c in chunks], least)]


def split_long(text: str, cap: int = CAP) -> list[str]:
    """Cut at sentence ends, else at spaces, else hard, so that nothing is longer than cap. Nothing is copied but the pieces."""
    out, at = [], 0
    while len(text) - at > cap:
        end = max((m.end() for m in _SENTENCE.finditer(text, at, at + cap)), default=0) or text.rfind(" ", at, at + cap) + 1
        end = end if end - at > cap // 3 else at + cap
        out.append(text[at:end].strip())
        at = end
    return [p for p in (*out, text[at:].strip()) if p]


def _kind(line: str) -> str:
    if len(line) <= HEADING_LINE and SECTION.match(line):
        return "heading"
    if len(line) <= QUESTION_LINE and QUESTION.search(line):
        return "question"
    return "bullet" if len(line) <= BULLET_LINE and BULLET.match(line) else "line"


def sections(text: str) -> Iterator[tuple[str | None, list[str]]]:
    """(heading, lines): a heading or a question opens a section once the one before has substance; a bullet once it is long enough.

    The heading is among the lines; None: the section goes on under the heading before it.
    """
    heading, body, solid, size = None, [], 0, 0
    for line in filter(None, map(str.strip, re.split(r"\r\n?|\n", text))):
        kind = _kind(line)
        if (kind in ("heading", "question") and solid >= THIN_MERGE) or (kind == "bullet" and size >= TARGET):
            yield heading, body
            heading, body, solid, size = None, [], 0, 0
        if kind == "heading" and not body:
            heading = line
        body.append(line)
        solid, size = solid + substance(line), size + len(line) + 1
    if body:
        yield heading, body


def _row(line: str) -> str:
    """A table's row without blank cells and without a cell repeated right behind itself (merged cells)."""
    if "|" not in line:
        return line
    return " | ".join(c for c, _ in groupby(filter(None, (c.strip() for c in line.split("|")))))


def _gathered(parts: Iterable[str], separator: str) -> Iterator[str]:
    """Parts in order, joined up to TARGET characters; a longer part stands alone."""
    now, size = [], 0
    for p in parts:
        if now and size + len(p) > TARGET:
            yield separator.join(now)
            now, size = [], 0
        now.append(p)
        size += len(p) + len(separator)
    if now:
        yield separator.join(now)


def prose(text: str) -> list[Chunk]:
    """Sections; tables (half of the lines and more are rows) are cut between rows, other sections beyond HARD between sentences."""
    out, current = [], ""
    for heading, body in sections(text):
        if heading and not _SENTENCE_TAIL.search(heading):
            current = heading
        if len(body) >= 2 and 2 * sum(" | " in line for line in body) >= len(body):
            pieces = _gathered(filter(None, map(_row, body)), "\n")
        else:
            whole = re.sub(r"[ \t]+", " ", " ".join(body))
            pieces = [whole] if len(whole) <= HARD else _gathered(filter(None, map(str.strip, _SENTENCE.split(whole))), " ")
        out += [Chunk(current, p) for p in pieces]
    return out


def chunks_in(text: str | None) -> list[Chunk]:
    """Chunks of a document with the heading each stands under ("": none yet), in order, each body once; null and blank texts have none.

    A text with three articles and none beyond ARTICLE_MOST is cut at its articles, any other is prose.
    """
    text = (text or "").strip()
    if not text:
        return []
    parts = [p.strip() for p in ARTICLE.split(text) if p.strip()]
    heads = [_ARTICLE_HEAD.match(p) for p in parts]
    articles = sum(h is not None for h in heads) >= ARTICLES and max(map(len, parts)) <= ARTICLE_MOST
    raw = [Chunk(h[0] if h else "", p) for h, p in zip(heads, parts, strict=True)] if articles else prose(text)
    cut = [Chunk(c.heading, p) for c in _merge(raw, THIN_MERGE) for p in split_long(c.text)]
    return list({"".join(_SUBSTANCE.findall(c.text)): c for c in reversed(cut)}.values())[::-1]


def chunk_text(text: str | None) -> list[str]:
    return [c.text for c in chunks_in(text)]


@F.pandas_udf(T.ArrayType(T.StructType().add("heading", "string").add("text", "string")))
def chunks_of(text: pd.Series) -> pd.Series:
    return text.map(lambda x: [c._asdict() for c in chunks_in(x)])


def chunk(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, seq from 0, heading, text)."""
    return docs.select(doc, F.posexplode(chunks_of(text)).alias("seq", "c")).select(doc, "seq", "c.heading", "c.text")


def register(spark) -> None:
    """chunk(text) as a table function for SQL: SELECT * FROM docs, LATERAL chunk(text)."""

    class Chunks:
        def eval(self, text: str):
            for seq, c in enumerate(chunks_in(text)):
                yield seq, c.heading, c.text

    spark.udtf.register("chunk", F.udtf(Chunks, returnType="seq int, heading string, text string"))


def index_ready(chunks: DataFrame, doc: str = "doc_id", text: str = "text", heading: Column | None = None) -> DataFrame:
    """Chunks that pass the search gate (headings are protected); all of a document if none would."""
    keep = tx.keep(tx.quality_reasons(F.col(text)), tx.SEARCH)
    keep = keep if heading is None else keep | F.coalesce(heading, F.lit(False))
    c = chunks.withColumn("_k", keep)
    return c.withColumn("_n", F.count_if(F.col("_k")).over(W.partitionBy(doc))).where(F.col("_k") | (F.col("_n") == 0)).drop("_k", "_n")


CELLS = "struct<n_rows:int,n_cols:int,cells:array<array<string>>>"


def table_text(payload: Column) -> Column:
    """A table payload {n_rows, n_cols, cells: [[r, c, rowspan, colspan, is_header, text]]} as lines of cells."""
    cells = F.from_json(payload, CELLS)["cells"]
    row = lambda r: F.array_join(F.transform(F.filter(cells, lambda c: (F.get(c, F.lit(0)).cast("int") == r) & (F.trim(F.get(c, F.lit(5))) != "")), lambda c: F.trim(F.get(c, F.lit(5)))), " | ")
    rows = F.array_distinct(F.array_sort(F.transform(cells, lambda c: F.get(c, F.lit(0)).cast("int"))))
    return F.array_join(F.filter(F.transform(rows, row), lambda x: x != ""), "\n")


@F.pandas_udf(T.StringType())
def table_heading(payload: pd.Series) -> pd.Series:
    """The heading in a band table: one or two rows of one to three cells; the first cell if it is a chapter, else all joined."""

    def one(p: str | None) -> str | None:
        try:
            t = json.loads(p or "")
            cells = [str(c[-1]).strip() for c in t["cells"] if str(c[-1]).strip()]
        except (ValueError, KeyError, TypeError, IndexError):
            return None
        if t.get("n_rows", 9) > 2 or not 1 <= len(cells) <= 3:
            return None
        if re.match(r"(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+|[IVX]{1,4})\s*[.．]\s*\S", cells[0]):
            return cells[0]
        return " ".join(cells)[:80]

    return payload.map(one)
