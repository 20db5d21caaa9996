"""How sources of one language differ in their terms, counted in mergeable radix tries.

A task cuts its texts into terms, counts equal ones, and files the counts in one
byte trie per language: a leaf holds the number of documents and a counter for
each source. Tries are handed on as their leaves in UTF-8 order whenever they
hold ``LEAVES`` of them, so a task's memory doesn't grow with its texts. Leaves
are dealt by ranges of (language, term), each range is merged into a trie again,
and its traversal gives every term of the range once, in UTF-8 order, with all
its counters. Terms in fewer than ``LEAST_DOCS`` documents end there.

Most words of a large collection are in few documents. A first pass therefore
sums the documents of each term's hash, and hashes that reach ``LEAST_DOCS`` open a bit of a
sieve of fixed size; only terms whose bit is open go into the tries. Equal hashes and bits let
more through, never less: what decides is the count in the merged trie.

What is kept is read in runs of the traversal: for each pair of blocks of
``BLOCK`` sources a run gives the differences of all pairs of sources and the
first terms of each source, ties in the order of the traversal. Terms that
neither source of a pair has differ by the same amount each; they are never
visited, that amount times the vocabulary is added at the end.

All arithmetic is in whole numbers; the quotient is taken by long division, so
that nothing overflows below 9e15 terms.

Edge cases: a null text, lang or source counts as empty; a source without
kept terms, or a language without any, has its pairs all the same (value 0 where
nothing is kept); equal values go by the item's UTF-8 bytes; repeated rows and
null ids are further documents; texts of any length are read whole, in slices
cut between terms; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.llm.common import give_back, stored_table

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
PRIOR = 5
#: Leaves that a task holds before it hands them on.
LEAVES = 150_000
#: Leaves handed on that one merging task gets.
RANGE_LEAVES = 100_000
#: Terms of a piece of the traversal, and sources of a block.
PIECE = 4_096
BLOCK = 256
#: Bytes of text that are cut into terms at once.
SLICE_BYTES = 8 << 20
#: Bits of the sieve (1 MB, whatever the input is), and of one row while it is put together.
SIEVE_BITS, SIEVE_ROW = 1 << 23, 1 << 15

#: For each byte its lower-case form, or 0 where it is no part of a term.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256)], np.uint8)


class RadixTrie:
    """Byte strings with counters: edges hold runs of bytes, a leaf is [documents, {source: occurrences}]."""

    def __init__(self) -> None:
        self.root: list = [None, None]
        self.size = 0

    def leaf(self, term: bytes) -> list:
        """The term's leaf, made where there is none."""
        node, at, end = self.root, 0, len(term)
        while at < end:
            if node[1] is None:
                node[1] = {}
            edge = node[1].get(term[at])
            if edge is None:
                below = [None, None]
                node[1][term[at]] = (term[at:], below)
                node, at = below, end
            elif term.startswith(edge[0], at):
                node, at = edge[1], at + len(edge[0])
            else:
                run = edge[0]
                n = 1
                while at + n < end and term[at + n] == run[n]:
                    n += 1
                middle = [None, {run[n]: (run[n:], edge[1])}]
                node[1][term[at]] = (run[:n], middle)
                node, at = middle, at + n
        if node[0] is None:
            node[0] = [0, {}]
            self.size += 1
        return node[0]

    def merge(self, term: bytes, docs: int, counts: Iterator[tuple[str, int]]) -> None:
        leaf = self.leaf(term)
        leaf[0] += docs
        own = leaf[1]
        for source, n in counts:
            own[source] = own.get(source, 0) + n

    def walk(self) -> Iterator[tuple[bytes, list]]:
        """(term, leaf) in UTF-8 order."""
        waiting = [(b"", self.root)]
        while waiting:
            term, (leaf, edges) = waiting.pop()
            if leaf is not None:
                yield term, leaf
            if edges:
                waiting += [(term + edges[b][0], edges[b][1]) for b in sorted(edges, reverse=True)]


def _cut(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts that lie one behind the other in data, lower-cased, and the text each one is from."""
    low = LOWER[data]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = starts[(starts < len(data))]
    first[heads] = inside[heads]
    at = np.flatnonzero(first)
    kept = low[inside]
    offsets = np.r_[np.flatnonzero(first[inside]), len(kept)].astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return terms, np.searchsorted(starts, at, "right") - 1


def _slices(texts: list[bytes], most: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Runs of texts of about so many bytes; a longer text comes in parts that are cut between terms."""
    rows: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(at + most, len(text))
            while end < len(text) and LOWER[text[end]] and LOWER[text[end - 1]]:
                end += 1
            rows.append(i)
            held.append(text[at:end])
            size += end - at
            at = end
            if size >= most:
                yield rows, held
                rows, held, size = [], [], 0
    if rows:
        yield rows, held


PART = [("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
PART_DDL = "lang string, term binary, docs long, sources array<string>, counts array<long>"


def _leaves(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _given(tries: dict[str, RadixTrie]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for lang in sorted(tries):
        for term, (docs, counts) in tries[lang].walk():
            held.append((lang, term, docs, list(counts), list(counts.values())))
            if len(held) == PIECE:
                yield _leaves(held, PART)
                held = []
    if held:
        yield _leaves(held, PART)
    tries.clear()


def _hashes(terms: pa.Array, lang: int) -> np.ndarray:
    """64-bit hashes of byte strings, each the sum of its bytes times powers of an odd number; lang sets languages apart."""
    offsets = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    data = np.frombuffer(terms.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    powers = np.cumprod(np.full(max(int(lengths.max()), 1), 0x9E3779B97F4A7C15, np.uint64))
    at = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    h = np.add.reduceat(data * powers[at], offsets[:-1] - offsets[0]) ^ np.uint64(lang)
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _coded(batch: pa.RecordBatch, slice_bytes: int) -> Iterator[tuple]:
    """For each slice and language of a batch: (lang, rows, texts, terms, codes, of): distinct terms, and the term and the place in rows of each occurrence."""
    langs = batch.column("lang").to_pylist()
    texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text").cast(pa.large_binary())]
    by_lang: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by_lang.setdefault(lang, []).append(i)
    for lang, mine in by_lang.items():
        for rows, held in _slices([texts[i] for i in mine], slice_bytes):
            terms, of = _cut(np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)])[:-1])
            if len(terms):
                coded = terms.dictionary_encode()
                yield lang, [mine[r] for r in rows], texts, coded.dictionary, coded.indices.to_numpy().astype(np.int64), of


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _documents(slice_bytes: int):
    """(h, docs): documents of each term's hash; parts of one long text count apart, so it may be too many, never too few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, _, _, terms, codes, of in _coded(batch, slice_bytes):
                docs = np.bincount(np.unique(of * len(terms) + codes) % len(terms), minlength=len(terms))
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(terms, _lang_hash(lang))), pa.array(docs.astype(np.int64))], ["h", "docs"])
        give_back()

    return run


def _sieve(docs: DataFrame, least: int, slice_bytes: int) -> bytes:
    """A bit for each hash with enough documents. What comes to the driver has a fixed size."""
    enough = docs.mapInArrow(_documents(slice_bytes), "h long, docs long").groupBy("h").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    bit = F.pmod("h", F.lit(SIEVE_BITS))
    parts = enough.groupBy(F.floor(bit / SIEVE_ROW).alias("row")).agg(F.bitmap_construct_agg(bit % SIEVE_ROW).alias("bits"))
    out = bytearray(SIEVE_BITS // 8)
    for r in parts.collect():
        out[r.row * SIEVE_ROW // 8 : (r.row + 1) * SIEVE_ROW // 8] = bytes(r.bits)
    return bytes(out)


def _count(most: int, slice_bytes: int, sieve: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, RadixTrie] = {}
        open_ = np.unpackbits(np.frombuffer(sieve, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            sources = batch.column("source").to_pylist()
            cut_from, said = -1, set()  # terms that earlier parts of a text have told of
            for lang, rows, texts, terms, codes, of in _coded(batch, slice_bytes):
                through = open_[_hashes(terms, _lang_hash(lang)) & (SIEVE_BITS - 1)]
                kept = np.flatnonzero(through)
                names = terms.take(pa.array(kept)).to_pylist()
                own = through[codes]
                codes, of = (np.cumsum(through) - 1)[codes[own]], of[own]
                n_names = max(len(names), 1)
                kinds: dict[str, int] = {}
                kind = np.array([kinds.setdefault(sources[r], len(kinds)) for r in rows], np.int64)[of]
                told = list(kinds)
                cells, n = np.unique(codes * len(told) + kind, return_counts=True)
                in_docs = np.unique(of * n_names + codes)
                if rows[0] == cut_from and said:
                    known = np.fromiter((x in said for x in names), bool, len(names))
                    in_docs = in_docs[~((in_docs < n_names) & known[in_docs % n_names])] if len(names) else in_docs
                if len(texts[rows[-1]]) > slice_bytes:
                    mine = {names[c] for c in np.unique(codes[of == len(rows) - 1]).tolist()}
                    said = said | mine if rows[-1] == cut_from else mine
                    cut_from = rows[-1]
                trie = tries.setdefault(lang, RadixTrie())
                docs = np.bincount(in_docs % n_names, minlength=n_names).tolist()
                before, leaf = -1, None
                for cell, m in zip(cells.tolist(), n.tolist(), strict=True):
                    c, k = divmod(cell, len(told))
                    if c != before:
                        before, leaf = c, trie.leaf(names[c])
                        leaf[0] += docs[c]
                    leaf[1][told[k]] = leaf[1].get(told[k], 0) + m
                if sum(t.size for t in tries.values()) >= most:
                    yield from _given(tries)
        yield from _given(tries)
        give_back()

    return run


KEPT = [("piece", pa.int64()), ("lang", pa.string()), ("term", pa.binary()), ("total", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
KEPT_DDL = "piece long, lang string, term binary, total long, sources array<string>, counts array<long>"


def _merge(least: int):
    """One range of terms as a trie; its terms in enough documents, numbered by pieces of the traversal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, RadixTrie] = {}
        for batch in batches:
            langs, terms, docs = (batch.column(c).to_pylist() for c in ("lang", "term", "docs"))
            bounds = batch.column("sources").offsets.to_pylist()
            sources, counts = (batch.column(c).values.to_pylist() for c in ("sources", "counts"))
            for i, term in enumerate(terms):
                a, b = bounds[i], bounds[i + 1]
                tries.setdefault(langs[i], RadixTrie()).merge(term, docs[i], zip(sources[a:b], counts[a:b], strict=True))
        piece = TaskContext.get().partitionId() << 32
        for lang in sorted(tries):
            held: list[tuple] = []
            for term, (docs, counts) in tries[lang].walk():
                if docs >= least:
                    held.append((piece, lang, term, sum(counts.values()), list(counts), list(counts.values())))
                    if len(held) == PIECE:
                        yield _leaves(held, KEPT)
                        held, piece = [], piece + 1
            if held:
                yield _leaves(held, KEPT)
                piece += 1
        tries.clear()
        give_back()

    return run


def share(count: np.ndarray, size: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE (count + PRIOR) / (size + PRIOR terms)) by long division in steps of 1000."""
    below = size + PRIOR * terms
    out, rest = np.divmod(count + PRIOR, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + more
    return out + 1


DIFFERENT = "lang string, part string, source string, item binary, value long"


def _compare(top: int):
    """Of a piece and two blocks of sources: sums over pairs beyond what terms of neither give, and first terms."""

    def run(leaves: pa.Table, told: pa.Table) -> pa.Table:
        info = told.to_pylist()[0]
        rows: list[tuple] = []
        if leaves.num_rows:
            leaves = leaves.combine_chunks().sort_by("term")
            names = info["a"] if info["bi"] == info["bj"] else info["a"] + info["b"]
            sizes = np.array(info["na"] if info["bi"] == info["bj"] else info["na"] + info["nb"], np.int64)
            place = {s: i for i, s in enumerate(names)}
            lists = leaves.column("sources").combine_chunks()
            coded = lists.flatten().dictionary_encode()
            at = np.array([place.get(s, -1) for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
            row = np.repeat(np.arange(leaves.num_rows), np.diff(lists.offsets.to_numpy()))
            count = np.zeros((leaves.num_rows, len(names)), np.int64)
            own = at >= 0
            count[row[own], at[own]] = leaves.column("counts").combine_chunks().flatten().to_numpy()[own]
            p = share(count, sizes[None, :], info["terms"])
            none = share(np.zeros(1, np.int64), sizes, info["terms"])
            first = len(info["a"])
            for i in range(first):
                others = range(i + 1, len(names)) if info["bi"] == info["bj"] else range(first, len(names))
                if others:
                    o = slice(others.start, others.stop)
                    sums = np.abs(p[:, o] - p[:, i : i + 1]).sum(0) - leaves.num_rows * np.abs(none[o] - none[i])
                    rows += [(info["lang"], "pair", names[i], names[j].encode(), s) for j, s in zip(others, sums.tolist(), strict=True) if s]
            if info["bi"] == info["bj"]:
                q = share(leaves.column("total").to_numpy(), np.int64(info["lang_size"]), info["terms"])
                terms = leaves.column("term")
                for i, name in enumerate(names):
                    f = np.where(count[:, i] > 0, p[:, i] - q, 0)
                    best = np.flatnonzero(f > 0)
                    best = best[np.argsort(-f[best], kind="stable")[:top]]
                    rows += [(info["lang"], "term", name, terms[int(t)].as_py(), int(f[t])) for t in best]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()), strict=True)], ["lang", "part", "source", "item", "value"])

    return run


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, leaves: int = LEAVES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(piece, lang, term, total, sources, counts) for every term in enough documents of its language; piece numbers runs in UTF-8 order."""
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    sieve = _sieve(own.select("text", "lang"), least_docs, slice_bytes)
    parts = stored_table(own.mapInArrow(_count(leaves, slice_bytes, sieve), PART_DDL))
    ranges = -(-parts.count() // RANGE_LEAVES) or 1
    return parts.repartitionByRange(ranges, "lang", "term").mapInArrow(_merge(least_docs), KEPT_DDL)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language (pair) and the source's leading terms (term)."""
    kept = stored_table(term_counts(docs, least_docs))
    found = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    counted = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("size"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_size"))
    # One row a source of a language from here on.
    groups = found.join(counted, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("size", "terms", "lang_size")])
    groups = stored_table(groups.withColumn("block", F.floor((F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1) / block)))
    listed = groups.groupBy("lang", "block", "terms", "lang_size").agg(F.sort_array(F.collect_list(F.struct("source", "size"))).alias("held"))
    listed = listed.select("lang", "block", "terms", "lang_size", F.col("held.source").alias("a"), F.col("held.size").alias("na"))
    pairs = listed.withColumnRenamed("block", "bi").join(listed.select("lang", F.col("block").alias("bj"), F.col("a").alias("b"), F.col("na").alias("nb")), "lang").where("bi <= bj")
    # Pieces are as many as merging tasks were, and more; neighbours go together until they hold about PIECE terms.
    pieces = kept.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("lang").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = stored_table(pieces.select("lang", "piece", F.floor(before / PIECE).alias("run")))
    blocks = groups.groupBy("lang").agg(F.max("block").alias("last"))
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
    high = F.explode(F.sequence(F.col("bi"), F.col("last")))
    dealt = kept.join(runs, ["lang", "piece"]).join(blocks, "lang").withColumn("bi", low).withColumn("bj", high).drop("last")
    keys = ["lang", "bi", "bj", "run"]
    # Under names of their own: both sides come from one table.
    told = pairs.join(runs.select("lang", "run").distinct(), "lang").select(*[F.col(c).alias(f"of_{c}") for c in keys], "bi", "bj", "lang", "terms", "lang_size", "a", "na", "b", "nb")
    parts = stored_table(dealt.groupBy(*keys).cogroup(told.groupBy(*[f"of_{c}" for c in keys])).applyInArrow(_compare(top), DIFFERENT))

    none = F.when(F.col("terms") > 0, F.expr(f"1 + {SCALE * PRIOR}L div (size + {PRIOR} * terms)")).otherwise(F.lit(0)).cast("long")
    g = groups.select("lang", "source", "terms", none.alias("p"))
    sums = parts.where("part = 'pair'").select("lang", "source", F.col("item").cast("string").alias("item"), "value").groupBy("lang", "source", "item").agg(F.sum("value").alias("more"))
    both = sums.union(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "more"))
    pair = g.join(g.select("lang", F.col("source").alias("item"), F.col("p").alias("q")), "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("terms") * F.abs(F.col("p") - F.col("q")) + F.coalesce("more", F.lit(0))).cast("long").alias("value"))
    term = parts.where("part = 'term'").select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value")
    order = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return pair.withColumn("rank", order).union(term.withColumn("rank", order).where(F.col("rank") <= top))
