"""SimHash near-duplicates through a byte-position inverted index.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in
at most four bits agree in at least four positions (each differing bit spoils
one byte at most), so the guaranteed minimum of shared positional bytes is
``8 - max_bits``. The index posts each distinct fingerprint under *pairs* of
positional bytes: among the four positions of one half at least two agree for
any pair that reaches the minimum, so twelve postings a fingerprint (six pairs
of positions for each half) suffice and a posting list has one in 65,536 of the
fingerprints. Within a list, fingerprints that share two more of the six other
positions are candidates: their shared positional bytes are tallied over all
eight positions, pairs that reach the minimum are verified bit by bit, and
nothing else is ever paired.

Work that grows with the square of a list is avoided: within runs that agree in
four positions, pairs are compared directly only in runs of up to
``PAIRWISE_RUN``; a longer run links its members through common neighbours at
two bits each (a and b differ in <= 4 bits exactly if some c differs from both
in <= 2), which is linear in the run. Posting lists above ``LIST_LIMIT`` leave
the task and take the same neighbour route over the whole cluster. A task
returns a star forest, never all pairs.

Edge cases: null and empty texts have fingerprint zero and link like any other;
a text with fewer words than a shingle is one shingle; repeated rows and ties
share a fingerprint, hence a component; rows with a null doc_id keep a
fingerprint, never name a component, and get a null component_id if alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import byte_rows, connected_components, id_and_text, materialise, star_forest

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Postings of one list that a task holds in memory (8 bytes each).
LIST_LIMIT = 1 << 22
PAIRWISE_RUN = 1 << 11
#: Pairs of byte positions under which a fingerprint is posted, by half.
POSTED = [*combinations(range(4), 2), *combinations(range(4, 8), 2)]
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles (ASCII lower case), unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    n = max(1, len(words) - shingle_words + 1)
    stops = ends[shingle_words - 1 :] or ends[-1:]
    starts = [0, *ends]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        h = np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK], strict=False)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f = np.array([fingerprint(t) for t in byte_rows(batch, "text")], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(f.view(np.int64))], ["doc_id", "fp"])


def _row_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (f,) = _fingerprints(iter([batch]))
        yield pa.RecordBatch.from_arrays([batch.column("row"), *f.columns], ["row", "doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fp long")


def _reach(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Pairs whose tally of shared positional bytes reaches the guaranteed minimum and that differ in at most max_bits bits."""
    differ = x ^ y
    tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    out = tally >= 8 - max_bits
    out[out] = np.bitwise_count(differ[out]) <= max_bits
    return out


def _byte(f: np.ndarray, i: int) -> np.ndarray:
    return (f >> np.uint64(8 * i)) & np.uint64(255)


def _flips(bits: list[int], most: int) -> np.ndarray:
    """0 and every mask of up to ``most`` (1 or 2) of the bits."""
    one = [1 << i for i in bits]
    return np.array([0, *one, *(x | y for x, y in combinations(one, 2) if most > 1)], np.uint64)


def _through_neighbours(f: np.ndarray, bits: list[int], max_bits: int, at_once: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of f within max_bits; f may differ in the given bits only. Linear in f."""
    masks, a, b = _flips(bits, max_bits // 2), [f[:0]], [f[:0]]
    passes = -(-len(f) * len(masks) // at_once)
    for k in range(passes):
        keys, who = [], []
        for m in masks:
            c = f ^ m
            mine = ((c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(passes) == np.uint64(k)
            keys.append(c[mine])
            who.append(f[mine])
        c, w = np.concatenate(keys), np.concatenate(who)
        order = np.argsort(c, kind="stable")
        c, w = c[order], w[order]
        same = c[1:] == c[:-1]
        x, y = star_forest(w[1:][same], w[:-1][same])
        a.append(x)
        b.append(y)
    return star_forest(np.concatenate(a), np.concatenate(b))


def _runs(comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, comp[1:] != comp[:-1]])
    return starts, np.diff(np.r_[starts, len(comp)])


def _links(key: np.ndarray, f: np.ndarray, max_bits: int, pairwise_run: int) -> tuple[np.ndarray, np.ndarray]:
    """Star forest of the verified links within whole posting lists. key: number of the position pair, then the two bytes."""
    a, b = [f[:0]], [f[:0]]
    for number in np.unique(key >> np.uint64(16)):
        inside = (key >> np.uint64(16)) == number
        k, g = key[inside], f[inside]
        starts, lengths = _runs(k)
        many = np.repeat(lengths > 1, lengths)
        k, g = k[many], g[many]
        others = [i for i in range(8) if i not in POSTED[int(number)]]
        for i, j in combinations(others, 2):
            comp = (k << np.uint64(16)) | (_byte(g, i) << np.uint64(8)) | _byte(g, j)
            order = np.argsort(comp, kind="stable")
            c, h = comp[order], g[order]
            starts, lengths = _runs(c)
            for s, n in zip(starts[lengths > 64], lengths[lengths > 64], strict=True):
                run = h[s : s + n]
                if n > pairwise_run:
                    free = [8 * p + q for p in others if p not in (i, j) for q in range(8)]
                    x, y = _through_neighbours(run, free, max_bits)
                else:
                    x, y = [], []
                    for d in range(1, n):
                        near = _reach(run[d:], run[:-d], max_bits)
                        x.append(run[d:][near])
                        y.append(run[:-d][near])
                    x, y = star_forest(np.concatenate(x), np.concatenate(y))
                a.append(x)
                b.append(y)
            short = np.repeat((lengths > 1) & (lengths <= 64), lengths)
            c, h = c[short], h[short]
            d = 1
            while len(c) > d:
                same = c[d:] == c[:-d]
                if not same.any():
                    break
                x, y = h[d:][same], h[:-d][same]
                near = _reach(x, y, max_bits)
                a.append(x[near])
                b.append(y[near])
                d += 1
    return star_forest(np.concatenate(a), np.concatenate(b))


def _link_lists(max_bits: int, list_limit: int, pairwise_run: int):
    """Over rows sorted by posting list: links (a, b), and the members of lists above the limit as (a, null)."""

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), other], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, f = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        large = None  # a list that has outgrown the limit
        for batch in batches:
            k = batch.column("key").to_numpy().astype(np.uint64)
            g = batch.column("fp").to_numpy().view(np.uint64)
            if large is not None:
                rest = int(np.searchsorted(k, large, "right"))
                if rest:
                    yield out(g[:rest], None)
                k, g = k[rest:], g[rest:]
                if not len(k):
                    continue
                large = None
            key, f = np.concatenate([key, k]), np.concatenate([f, g])
            if len(key) < 1 << 18:
                continue
            last = int(np.searchsorted(key, key[-1], "left"))
            if last:
                yield out(*_links(key[:last], f[:last], max_bits, pairwise_run))
                key, f = key[last:], f[last:]
            if len(key) > list_limit:
                large = key[-1]
                yield out(f, None)
                key, f = key[:0], f[:0]
        if len(key) > list_limit and key[0] == key[-1]:
            yield out(f, None)
        elif len(key):
            yield out(*_links(key, f, max_bits, pairwise_run))

    return run


def _representatives(prints: DataFrame, *last: str) -> DataFrame:
    """(fp, vertex): of the rows of a fingerprint, the least (null ids last) with the columns named last as ties."""
    return prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", *last)).alias("vertex"))


def near_components(reps: DataFrame, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT, pairwise_run: int = PAIRWISE_RUN) -> DataFrame:
    """(fp, root) for the distinct fingerprints of _representatives(): root is the least vertex that links reach."""
    if max_bits not in (2, 4):
        raise ValueError("the index and its common neighbours serve two or four differing bits")
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))
    post = [F.lit(n << 16) + byte(i) * 256 + byte(j) for n, (i, j) in enumerate(POSTED)]
    postings = reps.select(F.explode(F.array(*post)).alias("key"), "fp")
    found = materialise(postings.repartition("key").sortWithinPartitions("key").mapInArrow(_link_lists(max_bits, list_limit, pairwise_run), "a long, b long"))
    links = found.where("b is not null")
    large = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    flips = F.array(*[F.lit(int(m)) for m in _flips(list(range(64)), max_bits // 2).view(np.int64)])
    near = large.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("c"))
    low = near.groupBy("c").agg(F.min("fp").alias("m"), F.max("fp").alias("x")).where("m <> x").select("c", "m")
    links = links.union(near.join(low, "c").where("fp <> m").select("fp", "m").distinct())
    # Links go over to vertices, so that the least vertex of a component is its answer and no join on roots follows.
    ends = links.join(reps.select(F.col("fp").alias("a"), F.col("vertex").alias("u")), "a").join(reps.select(F.col("fp").alias("b"), F.col("vertex").alias("v")), "b")
    roots = connected_components(ends, "u", "v").select(F.col("vertex.fp").alias("fp"), "root")
    return reps.join(roots, "fp", "left").select("fp", F.coalesce("root", "vertex").alias("root"))


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, **limits: int) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    prints = materialise(fingerprints(docs, id_col, text_col))
    named = near_components(materialise(_representatives(prints)), max_bits, **limits).select("fp", F.col("root.doc_id").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near-copies, all columns kept: that with the smallest id (null last), then fingerprint.

    Rows are told apart by a number stored with them: ids may be null or repeated,
    and rows of one id may belong to different groups.
    """
    numbered = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")))
    texts = numbered.select(F.col("row"), F.col(f"doc.`{id_col}`").cast("long").alias("doc_id"), F.col(f"doc.`{text_col}`").cast("string").alias("text"))
    prints = materialise(texts.mapInArrow(_row_fingerprints, "row long, doc_id long, fp long"))
    roots = near_components(materialise(_representatives(prints, "row")), max_bits)
    first = roots.select(F.col("root.row").alias("row")).distinct()
    return numbered.join(first, "row", "left_semi").select("doc.*")
