"""Personal data: patterns propose spans, checksums confirm, context adjusts the score.

Four base kinds are fixed by pattern and validator alone (email, ip, card,
phone) and always stay. The method adds kinds whose pattern is weaker, which
need a checksum (iban: mod-97; short_card: Luhn) and/or words nearby
(ssn, local_phone, short_card). Offsets are code points of the whole text.

Every scanner is linear in the text: digit runs are taken whole (possessive
quantifiers, no start inside a run), addresses are found from their "@", and an added
span is held against the union of the base spans by bisection.

Edge cases: null and empty texts have no spans; rows keep their doc_id (null
included); repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import id_and_text

#: Order in which kinds are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "short_card", "local_phone")
KINDS = BASE_KINDS + ADDED_KINDS

#: Score before context, by kind; a checksum has been passed where there is one.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "short_card": 0.3, "local_phone": 0.2}
#: Words that raise the score of a kind when within CONTEXT_CHARS of the span.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social security", "social-security"),
    "short_card": ("card", "visa", "amex", "credit", "payment"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
}
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.35
#: Added spans need at least this score.
MIN_SCORE = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LUHN_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += _LUHN_DOUBLED[ord(c) - 48] if i % 2 else ord(c) - 48
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "").upper()
    rest = 0
    for c in plain[4:] + plain[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # The local part can't hold "@": the leftmost match before an "@" starts where its run does.
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _small_parts(s: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in s.split(".")))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += (("email", s, e) for s, e in _emails(text))
    if _DIGIT.search(text):
        out += (("ip", m.start(), m.end()) for m in _IP.finditer(text) if _small_parts(m[0]))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _NOT_DIGIT.sub("", m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += (("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15)
    return out


_NEARBY = {kind: re.compile(rf"(?<![a-z])(?:{'|'.join(map(re.escape, words))})") for kind, words in CONTEXT.items()}


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS) : start].lower() + " " + text[end : end + CONTEXT_CHARS].lower()
    return round(min(1.0, PRIOR[kind] + CONTEXT_GAIN * bool(_NEARBY[kind].search(near))), 3)


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans, by kind as in KINDS, then start. Added spans overlap no base span."""
    base = base_spans(text)
    found = [(k, s, e, _score(k, text, s, e)) for k, s, e in base]
    if _DIGIT.search(text):
        taken = _merged(base)
        more = [("iban", m.start(), m.end()) for m in _IBAN.finditer(text) if mod97(m[0])]
        more += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 15 and luhn(digits):
                more.append(("short_card", m.start(), m.end()))
        more += [("local_phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
        for k, s, e in more:
            if (score := _score(k, text, s, e)) >= MIN_SCORE and not _overlaps(taken, s, e):
                found.append((k, s, e, score))
    return found


def _merged(found: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans' union, apart and in order."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted((s, e) for _, s, e in found):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _overlaps(taken: tuple[list[int], list[int]], start: int, end: int) -> bool:
    starts, ends = taken
    at = bisect_right(starts, end - 1) - 1
    return at >= 0 and ends[at] > start


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
_SCHEMA = "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in spans(t or "")] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _SPAN)], ["doc_id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): one row per row of docs."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_find, _SCHEMA)


def pii_digest(docs: DataFrame) -> DataFrame:
    listed = lambda part: F.array_join(F.transform(part, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    base = F.filter("spans", lambda x: x.kind.isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in BASE_KINDS]
    return find_pii(docs).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if not text:
        return text
    found = sorted((s, e, k) for k, s, e, _ in spans(text))
    if not found:
        return text
    out, at = [], 0
    for s, e, k in found:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with masked texts (and their lengths, if docs has the column); rows and columns stay."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([masked(t) for t in columns[at].to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out
