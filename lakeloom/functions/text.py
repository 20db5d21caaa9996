"""Text functions: cleaning, structure tests, quality reasons and scores, titles and names."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators.similarity import fingerprint

# Thresholds and patterns that decide results.
TOO_SHORT, THIN = 20, 40
LOW_WORD_SHARE, HIGH_DIGIT_SHARE = 0.35, 0.75
GARBLED_SHARE, GARBLED_LETTERS = 0.15, 40
RUN_LENGTH, RUN_SHARE, RUN_HANGUL = 16, 0.10, 40
SYLLABLE_SHARE, SYLLABLE_TOKENS = 0.25, 12
COLLAPSE_PER_1000 = 0.5
SIGNALS_TO_DROP = 2
FULL_SCORE_CHARS = 200
PENALTIES = {
    "too_short": 0.6,
    "symbol_only": 0.6,
    "page_number": 0.6,
    "toc_line": 0.5,
    "question_only": 0.4,
    "duplicate": 0.5,
    "boilerplate": 0.5,
    "header_footer": 0.5,
    "ocr_damage": 0.3,
    "thin": 0.2,
    "low_text": 0.2,
}
FLAG, SEARCH, INDEX = 0, 1, 2
DROPPED_AT_INDEX_ONLY = ("thin", "low_text")

PAGE_ONLY = r"^[\s\-–—·.()\[\]/]*(?:[pP]\.?\s*)?\d{1,4}\s*(?:/\s*\d{1,4})?[\s\-–—·.()\[\]/]*$"
RULE_ONLY = r"^[\s|+\-–—─━═_.·*~<>]+$"
TOC_LEADER = r"[.·․‧⋯…]{3,}\s*\d{1,4}\s*$|[.·․‧⋯…]{5,}"
TOC_PAGE = r"^\s*\S.{0,58}?[ \t.·…]{2,}\d{1,4}\s*$"
QUESTION = r"(?:\?|？|(?:나요|가요|까요|ㄹ까|은가|는가|습니까|ㅂ니까|인지요|는지요|건가요)\s*[.?!]?)\s*$"
DATE_COLLAPSE = r"\d{5,}\s*[(（][월화수목금토일][)）]|[(（][월화수목금토일][)）]\s*~\s*\d{3,}"
IDEOGRAPH = r"[一-鿿㐀-䶿]"
LETTER = r"[가-힣A-Za-z一-鿿㐀-䶿]"
SCRIPTS = r"[가-힣一-鿿㐀-䶿]"


def normalize(text: Column) -> Column:
    """White space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def substantive_length(text: Column) -> Column:
    return F.length(fingerprint(text))


def solid_lines(text: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def is_page_number(text: Column) -> Column:
    return F.rlike(F.trim(text), F.lit(PAGE_ONLY))


def is_rule(text: Column) -> Column:
    return F.rlike(F.trim(text), F.lit(RULE_ONLY))


def is_toc(text: Column) -> Column:
    """Most lines end in a leader and a page; a single line counts only if it is thin."""
    ls = solid_lines(text)
    hits = F.size(F.filter(ls, lambda x: x.rlike(TOC_LEADER) | x.rlike(TOC_PAGE)))
    one = (hits == 1) & (substantive_length(text) < THIN)
    return F.when(F.size(ls) == 0, False).when(F.size(ls) == 1, one).otherwise(hits >= F.greatest(F.lit(2), F.floor((F.size(ls) + 1) / 2)))


def is_question_only(text: Column) -> Column:
    """Every sentence asks."""
    sentences = F.filter(F.split(normalize(text), r"(?<=[.?!？])\s+"), lambda s: F.trim(s) != "")
    return (F.size(sentences) > 0) & (F.size(F.filter(sentences, lambda s: ~s.rlike(QUESTION))) == 0)


def garbled_share(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(LETTER))
    return F.when(letters < GARBLED_LETTERS, 0.0).otherwise(F.regexp_count(text, F.lit(IDEOGRAPH)) / letters)


def damage_signals(text: Column) -> Column:
    """Names of the signs of a bad text layer. Each of them takes Hangul or ideographs, so other texts aren't searched for any."""
    n = F.greatest(F.length(text), F.lit(1))
    collapsed = F.regexp_count(text, F.lit(DATE_COLLAPSE))
    hangul = F.regexp_count(text, F.lit("[가-힣]"))
    long_ = F.length(F.array_join(F.regexp_extract_all(text, F.lit("[가-힣]{%d,}" % RUN_LENGTH), F.lit(0)), ""))
    words = F.filter(F.split(normalize(text), " "), lambda w: w != "")
    tokens = F.size(F.filter(words, lambda w: w.rlike("^[가-힣]+$")))
    # Runs of three and more one-syllable words, as spans of the normalised text.
    runs = F.regexp_extract_all(F.concat(normalize(text), F.lit(" ")), F.lit("(?<![^ ])(?:[가-힣] ){3,}"), F.lit(0))
    split = F.length(F.array_join(runs, "")) / 2
    signs = F.array_compact(
        F.array(
            F.when(garbled_share(text) >= GARBLED_SHARE, "garbled"),
            F.when((collapsed > 0) & (collapsed / (n / 1000) >= COLLAPSE_PER_1000), "date_collapse"),
            F.when((hangul >= RUN_HANGUL) & (long_ / hangul >= RUN_SHARE), "no_spaces"),
            F.when((tokens >= SYLLABLE_TOKENS) & (split / tokens >= SYLLABLE_SHARE), "split_syllables"),
        )
    )
    return F.when(text.rlike(SCRIPTS), signs).otherwise(F.array().cast("array<string>"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it (a plain Column is computed anew in each branch that names it)."""
    return F.element_at(F.transform(F.array(value), f), 1)


def quality_reasons(text: Column) -> Column:
    """Reasons against a chunk that can be told without its corpus.

    Costly signs are only sought where a cheap one allows them: leaders or trailing
    digits for contents, a question mark or ending for questions, Hangul or ideographs for damage.
    """

    def of(x: Column) -> Column:
        t, sub = x.t, x.sub
        share = sub / F.greatest(x.total, F.lit(1))
        digits = F.regexp_count(t, F.lit("[0-9]")) / F.greatest(sub, F.lit(1))
        reasons = F.array_compact(
            F.array(
                F.when(is_page_number(t), "page_number"),
                F.when((share < LOW_WORD_SHARE) | is_rule(t), "symbol_only"),
                F.when(t.rlike(r"[.·․‧⋯…\t ]{2}") & t.rlike(r"[.·․‧⋯…]{5}|\d\s*(?:\r?\n|$)") & is_toc(t), "toc_line"),
                F.when(sub < TOO_SHORT, "too_short").when(sub < THIN, "thin"),
                F.when(t.rlike(QUESTION) & is_question_only(t), "question_only"),
                F.when(F.size(damage_signals(t)) >= SIGNALS_TO_DROP, "ocr_damage"),
                F.when((sub >= THIN) & (digits >= HIGH_DIGIT_SHARE), "low_text"),
            )
        )
        return F.when(t == "", F.array(F.lit("too_short"))).otherwise(reasons)

    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return let(trimmed, lambda t: let(F.struct(t.alias("t"), substantive_length(t).alias("sub"), F.length(normalize(t)).alias("total")), of))


def quality_score(text: Column, reasons: Column) -> Column:
    base = F.least(F.lit(1.0), substantive_length(text) / FULL_SCORE_CHARS)
    penalty = F.create_map(*[x for k, v in PENALTIES.items() for x in (F.lit(k), F.lit(1 - v))])
    return F.round(F.aggregate(reasons, base, lambda a, r: a * F.coalesce(F.element_at(penalty, r), F.lit(0.9))), 3)


def keep(reasons: Column, level: int) -> Column:
    """Whether a chunk with these reasons stays at FLAG, SEARCH or INDEX strictness."""
    if level == FLAG:
        return F.lit(True)
    bad = reasons if level == INDEX else F.array_except(reasons, F.array(*[F.lit(x) for x in DROPPED_AT_INDEX_ONLY]))
    return F.size(bad) == 0


def heading_level(text: Column) -> Column:
    """1 for roman chapters, 2 for "1." and articles, 3 for "1.1" and "가.", 4 for "1)" and "(1)", null for no heading."""
    t = F.trim(text)
    short = F.length(t) <= 80
    return (
        F.when(~short | (t == ""), F.lit(None).cast("int"))
        .when(t.rlike(r"^(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+|I{1,3}|IV|VI{0,3}|IX|X)\s*[.．]\s*\S"), 1)
        .when(t.rlike(r"^\d{1,2}\.\d{1,2}(?:\.\d{1,2})*\.?\s+\S|^[가-하]\.\s*\S"), 3)
        .when(t.rlike(r"^\d{1,2}[.．]\s*\S|^제\s*\d+\s*[조장절]"), 2)
        .when(t.rlike(r"^\(?\d{1,2}\)\s*\S"), 4)
    )


def self_contained(text: Column) -> Column:
    """At least 40 characters of substance, or 20 to 39 and an end of sentence."""
    n = substantive_length(text)
    return (n >= 40) | ((n >= 20) & F.trim(text).rlike(r"(?:[.?!]|다|함|음|임|됨|요)\s*$"))


def clean_row(row: Column, sep: str = "|") -> Column:
    """Cells of a table row without blanks and without cells that repeat the one before."""
    cells = F.filter(F.transform(F.split(row, re.escape(sep)), lambda x: F.trim(x)), lambda x: x != "")
    kept = F.filter(F.transform(cells, lambda x, i: F.struct(x.alias("x"), ((i > 0) & (F.get(cells, i - 1) == x)).alias("again"))), lambda s: ~s.again)
    return F.array_join(F.transform(kept, lambda s: s.x), f" {sep} ")


def fix_numbering(text: Column) -> Column:
    """Doubled numbering becomes single ("1. 1. x"), and a zero bullet goes."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^(\s*)(\d{1,2}[.)])\s*\2\s*", "$1$2 "), r"(?m)^\s*0[.)]\s+", "")


def join_split_words(text: Column, known: Column | None = None) -> Column:
    """Three and more one-syllable words in a row are one word; two are if the pair is in the array ``known``."""
    joined = F.regexp_replace(text, r"(?<![가-힣])((?:[가-힣] ){2,}[가-힣])(?![가-힣])", "\u0000$1\u0001")
    parts = F.split(joined, "[\u0000\u0001]", -1)
    joined = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit(" "), F.lit(""))).otherwise(x)), "")
    if known is None:
        return joined
    return F.aggregate(known, joined, lambda a, w: F.when(F.length(w) == 2, F.regexp_replace(a, F.concat(F.lit("(?<![가-힣])"), F.substring(w, 1, 1), F.lit(" "), F.substring(w, 2, 1), F.lit("(?![가-힣])")), w)).otherwise(a))


def terms(text: Column) -> Column:
    """Language-neutral content words: distinct lower-case runs of letters or digits, two characters and more, of the whole text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[가-힣a-z0-9]{2,}"), F.lit(0)))


def tidy_reply(text: Column) -> Column:
    """Repeated sentences once, in order."""
    sentences = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.?!])\s+"), lambda s: F.trim(s) != "")
    return F.array_join(F.array_distinct(F.transform(sentences, lambda x: F.trim(x))), " ")


def redact(text: Column) -> Column:
    """The first three characters (one if it begins in Hangul), then stars; the length stays."""
    shown = F.when(text.rlike("^[가-힣]"), 1).otherwise(3)
    return F.concat(text.substr(F.lit(1), shown), F.repeat(F.lit("*"), F.greatest(F.length(text) - shown, F.lit(0))))


def token_estimate(text: Column) -> Column:
    """Tokens by script: 0.7 a Hangul syllable, a quarter of Latin letters, half of digits, one for other signs."""
    hangul, latin = F.regexp_count(text, F.lit("[가-힣]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    digits, rest = F.regexp_count(text, F.lit("[0-9]")), F.regexp_count(text, F.lit(r"[^\s가-힣A-Za-z0-9]"))
    return F.ceil(hangul * F.lit(0.7) + latin * F.lit(0.25) + digits * F.lit(0.5) + rest)


def csv_safe(cell: Column) -> Column:
    """Cells that a spreadsheet would run get a leading apostrophe."""
    return F.when(cell.rlike(r"^\s*[=+@-]") & ~cell.rlike(r"^\s*[+-]?[0-9][0-9.,]*\s*$"), F.concat(F.lit("'"), cell)).otherwise(cell)


def one_typo(a: Column, b: Column) -> Column:
    """Equal length and at most one changed character."""
    return (F.length(a) == F.length(b)) & (F.levenshtein(a, b, 1) >= 0)


# --- names ------------------------------------------------------------------------------------

# How attachments, file types and signs are written in file names.
ATTACHMENT = r"^\s*[\[(（【]?\s*(?:붙임|별첨|별지|첨부)\s*(?:제)?\s*(\d+)?\s*(?:호)?\s*(?:서식)?\s*[\])）】]?\s*[.:·]?\s*"
EXTENSION = r"(?i)\.(hwpx?|pdf|docx?|xlsx?|pptx?|jpe?g|png|txt|md)$"
NOISE = r"[\s_\-–—·ㆍ.,()\[\]{}（）「」『』【】<>《》〈〉'\"“”‘’:;!?/\\~]+"


def family_key(name: Column) -> Column:
    """Key of a file's versions: attachment number, extension, signs and spaces gone, lower case."""
    s = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), EXTENSION, "")
    return F.lower(F.regexp_replace(F.regexp_replace(s, ATTACHMENT, ""), NOISE, ""))


def attachment_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(name, F.lit("")), ATTACHMENT, 1), F.lit("")).cast("int")


def year_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(20\d{2})\s*(?:년|\.)", 1), F.lit("")).cast("int")


# --- Arrow-batched -------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode composed form without NUL."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).replace("\0", ""))


@F.pandas_udf(T.StringType())
def safe_name(s: pd.Series) -> pd.Series:
    """A file name: composed, separators and control characters to "_", at most 200 characters."""
    return s.map(lambda x: None if x is None else (re.sub(r"[\\/:*?\"<>|\x00-\x1f]+", "_", unicodedata.normalize("NFC", x)).strip(" .")[:200] or "_"))


@F.pandas_udf(T.StringType())
def clip(s: pd.Series, n: pd.Series) -> pd.Series:
    """At most n characters, cut behind a sentence if one ends in the second half, else behind a word, with an ellipsis."""

    def one(x: str | None, most: int) -> str | None:
        if x is None or len(x) <= most:
            return x
        head = x[: most - 1]
        end = max((m.end() for m in re.finditer(r"[.?!다]\s", head)), default=0)
        if end >= most // 2:
            return head[:end].rstrip() + "…"
        space = head.rfind(" ")
        return (head[:space] if space >= most // 2 else head).rstrip() + "…"

    return pd.Series([one(x, int(k)) for x, k in zip(s, n, strict=True)])


@F.pandas_udf(T.StringType())
def particle(word: pd.Series, pair: pd.Series) -> pd.Series:
    """word with the particle of "with/without" (such as 은/는) that its last syllable asks for."""

    def one(w: str | None, p: str) -> str | None:
        if not w:
            return w
        with_, without = p.split("/")
        code = ord(w[-1]) - 0xAC00
        closed = code % 28 != 0 if 0 <= code < 11172 else w[-1] in "013678lmnrLMNR"
        if with_ == "으로" and 0 <= code < 11172 and code % 28 == 8:
            closed = False
        return w + (with_ if closed else without)

    return pd.Series([one(w, p) for w, p in zip(word, pair, strict=True)])


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts (0 to 1)."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


#: Texts of a batch that are worked on at a time.
SLICE = 256


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("conflicts", T.ArrayType(T.IntegerType()))]))
def merge_three(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Three-way merge by lines: text (mine wins) and the lines of the base where both sides differ. Of a batch a slice at a time is held as strings."""

    def one(b: str, m: str, t: str) -> tuple[str, list[int]]:
        lines = (b or "").split("\n")

        def changes(other: str) -> list[tuple[int, int, list[str]]]:
            o = (other or "").split("\n")
            return [(i, j, o[k:n]) for tag, i, j, k, n in difflib.SequenceMatcher(None, lines, o, autojunk=False).get_opcodes() if tag != "equal"]

        ours, conflicts, out, at = changes(m), [], [], 0
        taken = list(ours)
        for c in changes(t):
            clash = [o for o in ours if (o[0] < c[1] and c[0] < o[1]) or o[0] == c[0]]
            if any(o == c for o in clash):
                continue
            if clash:
                conflicts.append(c[0])
            else:
                taken.append(c)
        for i, j, new in sorted(taken, key=lambda x: (x[0], x[1])):
            out += lines[at:i] + new
            at = j
        return "\n".join(out + lines[at:]), conflicts

    kind = pa.struct([("text", pa.string()), ("conflicts", pa.list_(pa.int32()))])
    for columns in batches:
        for at in range(0, len(columns[0]), SLICE):
            rows = [one(*x) for x in zip(*(c.slice(at, SLICE).to_pylist() for c in columns), strict=True)]
            yield pa.array([{"text": r[0], "conflicts": r[1]} for r in rows], kind)
