"""Quality rules: base counts, then compression bands.

Repetitive text compresses far better than prose and noise far worse. zstandard
ratios (compressed / raw bytes) of the whole text and of fixed chunks are held
against a band that depends on the length: short texts hardly compress, so
their band is wide and high; long texts have room to and the band is lower. The
lower end rejects repetition, the upper end incompressible text. A chunk is
judged by the band of its own length; a text fails when more than
``MAX_BAD_CHUNKS`` of its chunks lie outside.

Edge cases: null and empty texts have no words, so they fail the base rule;
repeated rows give repeated results; lines compare as they stand, and a line
without a word is never counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lakeloom.llm.common import WORD_SPACE, byte_rows, id_and_text

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
LEVEL = 3
CHUNK = 4096
#: Highest ratios from 128 bytes on are the highest of labelled good texts of that length (0.923, 0.740, 0.680, 0.579,
#: 0.521, 0.482, 0.428) with a margin; from 1.5 KB on random letters in words (0.58 and more) are above them.
#: (bytes below which the row holds, lowest ratio, highest ratio)
BANDS = (
    (128, 0.35, 9.0),
    (256, 0.28, 0.94),
    (512, 0.28, 0.80),
    (1024, 0.22, 0.72),
    (2048, 0.22, 0.60),
    (4096, 0.20, 0.56),
    (16384, 0.20, 0.56),
    (1 << 62, 0.17, 0.56),
)
MAX_BAD_CHUNKS = 0.1


def band(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for below, low, high in BANDS if n_bytes < below)


def _repeats(words: list[bytes]) -> int:
    """Words inside windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(islice(words, i, None) for i in range(WINDOW)), strict=False))
    if len(set(windows)) == n:
        return 0
    seen = Counter(windows)
    again = np.fromiter((seen[w] > 1 for w in windows), bool, n)
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += again
    edges[WINDOW : WINDOW + n] -= again
    return int(np.count_nonzero(np.cumsum(edges)[:-1] > 0))


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    solid = text.translate(None, WORD_SPACE)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), _repeats(words)


def compression_ok(text: bytes, size=None) -> tuple[bool, float, float]:
    """(within the bands, ratio of the whole, share of chunks outside their band)."""
    size = size or (lambda x, c=zstandard.ZstdCompressor(level=LEVEL, write_content_size=False): len(c.compress(x)))
    if not text:
        return False, 0.0, 0.0
    inside = lambda x, r: band(len(x))[0] <= r <= band(len(x))[1]
    whole = size(text) / len(text)
    if len(text) <= CHUNK:
        return inside(text, whole), whole, 0.0
    chunks = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
    bad = sum(not inside(c, size(c) / len(c)) for c in chunks) / len(chunks)
    return inside(text, whole) and bad <= MAX_BAD_CHUNKS, whole, bad


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks"]
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"


def judge(text: bytes, size=None) -> tuple:
    n_words, chars, symbols, dup_lines, repeats = measure(text)
    failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words
    ok, ratio, bad = compression_ok(text, size)
    return n_words, chars, symbols, dup_lines, repeats, failed, ok and not failed, ratio, bad


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    size = lambda x: len(compressor.compress(x))
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
    for batch in batches:
        rows = [judge(t, size) for t in byte_rows(batch, "text")]
        columns = zip(*rows, strict=True) if rows else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], _NAMES)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts, base_failed, kept, and the ratios that decided."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_rules, _SCHEMA)
