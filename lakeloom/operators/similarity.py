"""Similarity joins on character shingles, words and vectors.

Candidates come from postings (an equi-join on shared terms), never from all
pairs. Postings are shortened by prefix filtering: with terms in one global
order from rare to frequent, two sets of Jaccard >= t share a term within their
first size - ceil(t * size) + 1 terms, so frequent terms hardly ever join.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lakeloom.operators.lineage import cut

#: Runs of characters of substance.
SUBSTANCE = "[A-Za-z0-9가-힣]+"


def fingerprint(text: Column) -> Column:
    """Hangul, Latin letters and digits only. Runs of them are put together, as taking out what lies between costs more than twice as much."""
    return F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SUBSTANCE), F.lit(0)), "")


def shingles(text: Column, k: int = 12, step: int = 1) -> Column:
    """Distinct k-character shingles, sorted; a shorter text is one shingle, an empty one (or null) none.

    An Arrow-batched UDF: in SQL each substring() walks the text again, which is quadratic in its length.
    """

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({t[i : i + k] for i in range(0, max(1, len(t) - k + 1), step)}) if t else [])

    return pieces(text)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)


def bottom_k(terms: Column, k: int = 128) -> Column:
    """The k smallest 64-bit hashes of a set."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(terms, lambda x: F.xxhash64(x)))), 1, k)


def sketch_of(text: str | None, size: int = 128, k: int = 12) -> np.ndarray:
    """bottom_k() of a text's shingles(), without the shingles: only their hashes are held."""
    if not text:
        return np.empty(0, np.int64)
    raw = text.encode("utf-8", "surrogatepass")
    n, digest = max(1, len(text) - k + 1), xxhash.xxh64_intdigest
    if len(raw) == len(text):
        found = (digest(raw[i : i + k], 42) for i in range(n))
    else:
        found = (digest(text[i : i + k].encode("utf-8", "surrogatepass"), 42) for i in range(n))
    return np.unique(np.fromiter(found, np.uint64, n).view(np.int64))[:size].copy()  # a view would keep all of them


def shingle_sketch(text: Column, size: int = 128, k: int = 12) -> Column:
    """As bottom_k(shingles(text)); what a batch holds is bounded by its sketches."""

    @F.pandas_udf("array<long>")
    def sketches(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sketch_of(t, size, k))

    return sketches(text)


def bottom_k_jaccard(a: Column, b: Column) -> Column:
    """Estimate from two bottom-k sketches: the share of the union's bottom k that both hold."""
    k = F.least(F.size(a), F.size(b))
    union = F.slice(F.array_sort(F.array_union(a, b)), F.lit(1), k)
    held = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(k == 0, F.lit(0.0)).otherwise(held / F.size(union))


def _ordered_terms(rows: DataFrame, item: str, term: str, partition: list[str]) -> DataFrame:
    """(partition..., item, term hash h, size, place): terms in the global order rare to frequent."""
    each = rows.select(*partition, item, F.xxhash64(term).alias("h")).distinct()
    df = each.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    w = W.partitionBy(*partition, item)
    return each.join(df, "h").withColumn("size", F.count(F.lit(1)).over(w)).withColumn("place", F.row_number().over(w.orderBy("df", "h")))


def jaccard_join(rows: DataFrame, item: str, term: str, least: float, partition: list[str] | None = None) -> DataFrame:
    """(partition..., a, b, jaccard) for pairs a < b of items whose term sets reach ``least``; rows are (item, term)."""
    partition = partition or []
    t = _ordered_terms(rows, item, term, partition)
    prefix = t.where(F.col("place") <= F.col("size") - F.ceil(F.lit(least) * F.col("size")) + 1)
    left = prefix.select(*partition, "h", F.col(item).alias("a"), F.col("size").alias("na"))
    right = prefix.select(*partition, "h", F.col(item).alias("b"), F.col("size").alias("nb"))
    lengths = (F.col("na") >= F.col("nb") * least) & (F.col("nb") >= F.col("na") * least)
    pairs = left.join(right, [*partition, "h"]).where((F.col("a") < F.col("b")) & lengths).select(*partition, "a", "b", "na", "nb").distinct()
    x = pairs.join(t.select(*partition, F.col(item).alias("a"), "h"), [*partition, "a"])
    y = t.select(*partition, F.col(item).alias("b"), "h")
    both = x.join(y, [*partition, "b", "h"]).groupBy(*partition, "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("n"))
    out = both.withColumn("jaccard", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    return out.where(F.col("jaccard") >= least).select(*partition, "a", "b", "jaccard")


def jaccard_between(left: DataFrame, right: DataFrame, left_id: str, right_id: str, term: str, least: float) -> DataFrame:
    """(left_id, right_id, jaccard) for pairs of two tables, rows (id, term), that reach ``least``; candidates as in jaccard_join, in one order of terms for both."""
    x, y = (t.select(F.lit(s).alias("_s"), F.col(i).alias("_i"), F.xxhash64(term).alias("h")).distinct() for s, t, i in ((0, left, left_id), (1, right, right_id)))
    both = x.union(y)
    df = both.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.count_if(F.col("_s") == 0).alias("l")).where("l > 0 and l < df").drop("l")
    w = W.partitionBy("_s", "_i")
    # Terms of one side only count in sizes, but join nothing.
    t = both.join(df, "h", "left").withColumns({"size": F.count(F.lit(1)).over(w), "place": F.row_number().over(w.orderBy(F.col("df").asc_nulls_first(), "h"))})
    prefix = t.where((F.col("place") <= F.col("size") - F.ceil(F.lit(least) * F.col("size")) + 1) & F.col("df").isNotNull())
    one = lambda rows, s, name, n: rows.where(F.col("_s") == s).select("h", F.col("_i").alias(name), F.col("size").alias(n))
    lengths = (F.col("na") >= F.col("nb") * least) & (F.col("nb") >= F.col("na") * least)
    pairs = one(prefix, 0, left_id, "na").join(one(prefix, 1, right_id, "nb"), "h").where(lengths).select(left_id, right_id, "na", "nb").distinct()
    shared = pairs.join(one(t, 0, left_id, "_").drop("_"), left_id).join(one(t, 1, right_id, "_").drop("_"), [right_id, "h"]).groupBy(left_id, right_id, "na", "nb").agg(F.count(F.lit(1)).alias("n"))
    return shared.withColumn("jaccard", F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).where(F.col("jaccard") >= least).select(left_id, right_id, "jaccard")


#: Rows of a block of short texts, how many of them meet at a time, and grams that are columns at a time.
TEXT_BLOCK, TEXT_TILE, GRAM_COLUMNS = 16_384, 2_048, 4_096


def bigram_codes(text: str) -> np.ndarray:
    """Distinct bigrams of a text as numbers; a single character is a gram of its own."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return -1 - c if len(c) < 2 else np.unique((c[:-1] << 21) | c[1:])


def _gram_matrix(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1: which of the sorted columns a set has."""
    out = np.zeros((len(sets), len(columns)), np.float32)
    for i, s in enumerate(sets):
        at = np.minimum(np.searchsorted(columns, s), len(columns) - 1)
        out[i, at[columns[at] == s]] = 1
    return out


def near_texts(left: list[str], right: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, jaccard) of left and right texts whose bigrams reach ``least``. Shared grams are counted as products of matrices, a tile at a time; counts are whole, so nothing is rounded."""
    x, y = ([bigram_codes(t) for t in texts] for texts in (left, right))
    sx, sy = (np.array([len(s) for s in sets], np.int64) for sets in (x, y))
    ox, oy = np.argsort(sx, kind="stable"), np.argsort(sy, kind="stable")
    found = []
    for a in range(0, len(ox), TEXT_TILE):
        rows = ox[a : a + TEXT_TILE]
        own = np.unique(np.concatenate([x[i] for i in rows]))
        for b in range(0, len(oy), TEXT_TILE):
            cols = oy[b : b + TEXT_TILE]
            # Tiles hold sets of like sizes: most that differ too much never meet.
            if sy[cols[-1]] < least * sx[rows[0]] - 1 or sx[rows[-1]] < least * sy[cols[0]] - 1:
                continue
            both = np.intersect1d(own, np.unique(np.concatenate([y[j] for j in cols])), assume_unique=True)
            n = np.zeros((len(rows), len(cols)), np.float32)
            for c in range(0, len(both), GRAM_COLUMNS):
                part = both[c : c + GRAM_COLUMNS]
                n += _gram_matrix([x[i] for i in rows], part) @ _gram_matrix([y[j] for j in cols], part).T
            # A little below, and then exactly.
            i, j = np.nonzero(n * (1 + least) >= least * (sx[rows][:, None] + sy[cols]) - 0.5)
            shared = n[i, j].astype(np.float64)
            i, j = rows[i], cols[j]
            score = shared / (sx[i] + sy[j] - shared)
            found.append((i[score >= least], j[score >= least], score[score >= least]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def bigram_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str, least: float) -> DataFrame:
    """(left_id, right_id, jaccard) for pairs of rows (id, text) of two tables whose texts' bigrams reach ``least``.

    Of two letters there are so few that every text shares some with every other: postings of them pair nearly all rows, and prefixes hardly help.
    So equal texts are compared as one, and blocks of them as matrices; every pair of a left and a right block is a task.
    What moves is the texts, once for each block of the other side, and the pairs found.
    """
    held = [cut(t.select(F.col(i).alias("i"), F.col(text).alias("t"))) for t, i in ((left, left_id), (right, right_id))]
    one = [cut(h.groupBy("t").agg(F.min("i").alias("c"))) for h in held]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nl, nr = (max(ceil(parts**0.5), ceil(o.count() / TEXT_BLOCK)) for o in one)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda n: F.pmod(F.xxhash64("t"), F.lit(n)).cast("int")
    l = one[0].select("c", "t", at(nl).alias("x"), each(nr).alias("y"))
    r = one[1].select("c", "t", each(nl).alias("x"), at(nr).alias("y"))
    kinds = [h.schema["i"].dataType for h in held]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and b.num_rows:
            i, j, score = near_texts(a.column("t").to_pylist(), b.column("t").to_pylist(), least)
            return pa.table([a.column("c").take(pa.array(i)), b.column("c").take(pa.array(j)), pa.array(score)], ["_a", "_b", "jaccard"])
        return pa.table([pa.array([], to_arrow_type(kinds[0])), pa.array([], to_arrow_type(kinds[1])), pa.array([], pa.float64())], ["_a", "_b", "jaccard"])

    near = l.groupBy("x", "y").cogroup(r.groupBy("x", "y")).applyInArrow(meet, f"_a {kinds[0].simpleString()}, _b {kinds[1].simpleString()}, jaccard double")
    of = lambda k, name, key: held[k].join(one[k], "t").select(F.col("c").alias(key), F.col("i").alias(name))
    return near.join(of(0, left_id, "_a"), "_a").join(of(1, right_id, "_b"), "_b").select(left_id, right_id, "jaccard")


def jaccard_pairs(rows: DataFrame, item: str, terms: str, least: float, partition: list[str], hashed: bool = False) -> DataFrame:
    """As jaccard_join, for rows (item, array of terms): the prefix order is the hash's own, so nothing is counted first. hashed: terms are distinct, sorted hashes already."""
    own = F.col(terms) if hashed else F.array_sort(F.array_distinct(F.transform(terms, lambda x: F.xxhash64(x))))
    h = rows.select(*partition, item, own.alias("h")).where(F.size("h") > 0)
    n = F.size("h")
    each = h.select(*partition, item, n.alias("n"), F.explode(F.slice("h", F.lit(1), n - F.ceil(n * F.lit(least)).cast("int") + 1)).alias("t"))
    x = each.select(*partition, "t", F.col(item).alias("a"), F.col("n").alias("na"))
    y = each.select(*partition, "t", F.col(item).alias("b"), F.col("n").alias("nb"))
    close = (F.col("na") >= F.col("nb") * least) & (F.col("nb") >= F.col("na") * least)
    pairs = x.join(y, [*partition, "t"]).where((F.col("a") < F.col("b")) & close).select(*partition, "a", "b").distinct()
    j = pairs.join(h.select(*partition, F.col(item).alias("a"), F.col("h").alias("ha")), [*partition, "a"]).join(h.select(*partition, F.col(item).alias("b"), F.col("h").alias("hb")), [*partition, "b"])
    return j.select(*partition, "a", "b", jaccard(F.col("ha"), F.col("hb")).alias("jaccard")).where(F.col("jaccard") >= least)


def containment_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, term: str, least: float) -> DataFrame:
    """(left_id, right_id, shared, left_size, right_size) where ``least`` of the left's terms are the right's."""
    a = left.select(left_id, F.xxhash64(term).alias("h")).distinct()
    b = right.select(right_id, F.xxhash64(term).alias("h")).distinct()
    na = a.groupBy(left_id).agg(F.count(F.lit(1)).alias("left_size"))
    nb = b.groupBy(right_id).agg(F.count(F.lit(1)).alias("right_size"))
    both = a.join(b, "h").groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("shared")).join(na, left_id)
    return both.where(F.col("shared") >= F.col("left_size") * least).join(nb, right_id).select(left_id, right_id, "shared", "left_size", "right_size")


def gram_hashes(text: Column, k: int, step: int = 1, short: bool = False) -> Column:
    """Distinct 64-bit hashes of the k-character grams at every step-th place, sorted; a shorter text is one gram if ``short``, else none. Arrow-batched, numpy within a text."""

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: rolling_hashes(t, k, step, short))

    return hashes(text)


def rolling_hashes(text: str | None, k: int, step: int = 1, short: bool = False) -> np.ndarray:
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if short and 0 < len(c) < k:
        c = np.pad(c, (0, k - len(c)))
    n = len(c) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(-(-n // step), np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : i + n : step]
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(h ^ (h >> np.uint64(32))).view(np.int64)


def gram_jaccard(a: Column, b: Column, k: int, step: int = 1) -> Column:
    """The Jaccard overlap of two texts' sets of gram_hashes() (a short text is one gram); the sets are made for the comparison only."""

    @F.pandas_udf("double")
    def overlap(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            g, h = rolling_hashes(p, k, step, True), rolling_hashes(q, k, step, True)
            n = len(np.intersect1d(g, h, assume_unique=True))
            out.append(n / (len(g) + len(h) - n) if n else 0.0)
        return pd.Series(out, dtype="float64")

    return overlap(a, b)


#: Bits of the sieve: its size is fixed, so it may go to the driver and to every task; with very many grams it only lets more through.
SIEVE_BITS, _BUCKET = 1 << 20, 1 << 15


def sieve(hashes: DataFrame, column: str = "h") -> bytes:
    """A bitmap of the low bits of all hashes (128 KB), put together on the cluster."""
    low = F.pmod(F.col(column), F.lit(SIEVE_BITS))
    parts = hashes.select(low.alias("p")).groupBy(F.floor(F.col("p") / _BUCKET).alias("b")).agg(F.bitmap_construct_agg(F.col("p") % _BUCKET).alias("bits"))
    out = bytearray(SIEVE_BITS // 8)
    for r in parts.collect():  # 32 rows of 4 KB at most
        out[r.b * _BUCKET // 8 : (r.b + 1) * _BUCKET // 8] = bytes(r.bits)
    return bytes(out)


def sifted_hashes(text: Column, k: int, bits: bytes, short: bool = False) -> Column:
    """(n, h): how many distinct gram hashes a text has, and those of them that the sieve lets through. What goes through must still be joined."""

    @F.pandas_udf("n int, h array<long>")
    def sift(texts: pd.Series) -> pd.DataFrame:
        open_ = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        every = [rolling_hashes(t, k, 1, short) for t in texts]
        return pd.DataFrame({"n": [len(h) for h in every], "h": [h[open_[h & (SIEVE_BITS - 1)]] for h in every]})

    return sift(text)


#: Characters of needles that one task holds.
NEEDLE_CHARS = 2_000_000


def contains_join(needles: DataFrame, bodies: DataFrame, needle_id: str, needle: str, body_id: str, body: str, gram: int = 8, most_chars: int = NEEDLE_CHARS) -> DataFrame:
    """(needle_id, body_id) where the body contains the needle. Needles shorter than a gram are nobody's (their matches would be chance).

    Needles of up to ``most_chars`` characters in all go to every task as one automaton, and each body is read once where it lies.
    More of them meet the bodies on the hash of one rare gram each, and are tested afterwards.
    """
    n = needles.where(F.length(needle) >= gram).select(needle_id, needle)
    if n.agg(F.coalesce(F.sum(F.length(needle)), F.lit(0)).alias("c")).first().c > most_chars:
        return _contains_by_grams(n, bodies, needle_id, needle, body_id, body, gram)
    by_text: dict[str, list] = {}
    for r in n.collect():  # at most most_chars characters
        by_text.setdefault(r[needle], []).append(r[needle_id])
    kinds = dict(needles.dtypes)[needle_id], dict(bodies.dtypes)[body_id]
    schema = T.StructType([T.StructField(needle_id, needles.schema[needle_id].dataType), T.StructField(body_id, bodies.schema[body_id].dataType)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for text, ids in by_text.items():
            machine.add_word(text, (text, ids))
        machine.make_automaton()
        for batch in batches:
            found: list = []
            rows: list[int] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text and len(machine):
                    hits = {t: ids for _, (t, ids) in machine.iter(text)}
                    for ids in hits.values():
                        found += ids
                        rows += [i] * len(ids)
            left = pa.array(found, to_arrow_type(schema[needle_id].dataType))
            yield pa.RecordBatch.from_arrays([left, batch.column(0).take(pa.array(rows, pa.int64()))], [needle_id, body_id])

    return bodies.select(body_id, body).mapInArrow(search, f"{needle_id} {kinds[0]}, {body_id} {kinds[1]}")


def _contains_by_grams(n: DataFrame, bodies: DataFrame, needle_id: str, needle: str, body_id: str, body: str, gram: int) -> DataFrame:
    """Grams of bodies that no needle has mostly fall through a sieve where they are read, the rest in a semi-join."""
    prepared = n.select(needle_id, F.explode(gram_hashes(F.col(needle), gram)).alias("g"))
    sifted = bodies.select(body_id, sifted_hashes(F.col(body), gram, sieve(prepared, "g")).alias("_s"))
    seen = sifted.select(body_id, F.explode("_s.h").alias("g")).join(prepared.select("g").distinct(), "g", "left_semi")
    seen = cut(seen)  # few rows, asked for twice: bodies are taken apart once
    df = seen.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    key = prepared.join(df, "g").groupBy(needle_id).agg(F.min_by("g", F.struct("df", "g")).alias("g"))
    found = key.join(seen, "g").select(needle_id, body_id).distinct()
    j = found.join(n, needle_id).join(bodies.select(body_id, body), body_id)
    return j.where(F.contains(body, F.col(needle))).select(needle_id, body_id)


#: Queries scored at a time, and how much a product by matrix may differ from one summed in the order of components, for each component of vectors of length 1.
ASKED, CLOSE = 256, 1e-15


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length the places of the vectors that have it, and the vectors; null ones and those with a null component have none."""
    rows = column.to_pylist()
    places: dict[int, list[int]] = {}
    for i, v in enumerate(rows):
        if v is not None and None not in v:
            places.setdefault(len(v), []).append(i)
    return {n: (np.array(at), np.array([rows[i] for i in at], np.float64).reshape(len(at), n)) for n, at in places.items()}


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Equal values of the columns as equal numbers from 0; -1 is null."""
    values = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type)
    known = values.combine_chunks().dictionary_encode()
    codes = known.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _in_blocks(queries: DataFrame, vectors: DataFrame, query: list[Column], row: list[Column], vector: str, vector_id: str, schema: str, score) -> DataFrame:
    """score(queries, vectors) of every block: vectors are dealt into one for each shuffle partition of the session, and every query visits each of them."""
    blocks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = queries.select(*query, F.col(vector).alias("_q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"))
    v = vectors.select(*row, F.col(vector).alias("_v"), F.pmod(F.xxhash64(vector_id), F.lit(blocks)).alias("_at"))
    return q.groupBy("_block").cogroup(v.groupBy("_at")).applyInArrow(score, schema)


def _block_groups(group: str, group_type: pa.DataType):
    """For each query and group of a block: the greatest product, their sum, how many there are, and how many vectors there are."""
    names = ["_id", group, "top", "sum", "scored", "n"]

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        made: list[pa.Table] = []
        if queries.num_rows and vectors.num_rows:
            (code,) = _codes(vectors.column("_g"))
            code -= code.min()
            order = np.argsort(code, kind="stable")
            vectors, code = vectors.take(pa.array(order)), code[order]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            sizes = np.diff(np.r_[first, len(code)])
            label = np.repeat(np.arange(len(first)), sizes)
            groups, held = vectors.column("_g").take(pa.array(first)), _by_length(vectors.column("_v"))
            ids, asked = queries.column("_id"), _by_length(queries.column("_q"))
            for at in range(0, queries.num_rows, ASKED):
                stop = min(at + ASKED, queries.num_rows)
                top, total, scored = np.full((stop - at, len(first)), -np.inf), np.zeros((stop - at, len(first))), np.zeros((stop - at, len(first)), np.int64)
                for n in asked.keys() & held.keys():
                    (qi, q), (vi, v) = asked[n], held[n]
                    some = (qi >= at) & (qi < stop)
                    own = label[vi]
                    cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    product = q[some] @ v.T
                    place = np.ix_(qi[some] - at, own[cuts])
                    top[place] = np.maximum.reduceat(product, cuts, axis=1)
                    total[place] = np.add.reduceat(product, cuts, axis=1)
                    scored[place] = np.diff(np.r_[cuts, len(own)])
                who, which = np.repeat(np.arange(at, stop), len(first)), np.tile(np.arange(len(first)), stop - at)
                top = pa.array(top.ravel(), mask=scored.ravel() == 0)
                made.append(pa.table([ids.take(pa.array(who)), groups.take(pa.array(which)), top, pa.array(total.ravel()), pa.array(scored.ravel()), pa.array(np.tile(sizes, stop - at))], names))
        if made:
            return pa.concat_tables(made)
        empty = (queries.schema.field("_id").type if queries.num_columns else pa.int64(), group_type, pa.float64(), pa.float64(), pa.int64(), pa.int64())
        return pa.table([pa.array([], t) for t in empty], names)

    return run


def cosine_groups(queries: DataFrame, vectors: DataFrame, query_id: str, vector_id: str, vector: str, group: str) -> DataFrame:
    """(query_id, group, top, mean, n): the greatest cosine of each query with a group's unit vectors, their mean, and how many vectors the group has.

    Blocks are scored as matrices, and what leaves one is a row for each of its groups and queries, however
    many vectors it holds. Vectors that are null, hold a null or are of another length count in n only.
    """
    types = dict(queries.dtypes)[query_id], dict(vectors.dtypes)[group]
    score = _block_groups(group, to_arrow_type(vectors.schema[group].dataType))
    schema = f"_id {types[0]}, {group} {types[1]}, top double, sum double, scored long, n long"
    s = _in_blocks(queries, vectors, [F.col(query_id).alias("_id")], [F.col(group).alias("_g")], vector, vector_id, schema, score)
    s = s.groupBy(F.col("_id").alias(query_id), group).agg(F.max("top").alias("top"), F.sum("sum").alias("sum"), F.sum("scored").alias("scored"), F.sum("n").cast("long").alias("n"))
    return s.select(query_id, group, "top", F.when(F.col("scored") > 0, F.col("sum") / F.col("scored")).alias("mean"), "n")


def _block_tops(k: int, least: float, query_id: str, vector_id: str, apart: bool):
    """The k best vectors of a block for each query.

    A product by matrix says which vectors can be among them; the products of these are summed in the order of components, so equal vectors score alike.
    """

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and vectors.num_rows:
            vectors = vectors.sort_by("_id")
            asked, held = _by_length(queries.column("_q")), _by_length(vectors.column("_v"))
            if apart:
                own, other = _codes(queries.column("_a"), vectors.column("_a"))
            for n in asked.keys() & held.keys():
                (qi, q), (vi, v) = asked[n], held[n]
                for at in range(0, len(qi), ASKED):
                    some, who = q[at : at + ASKED], qi[at : at + ASKED]
                    rough = some @ v.T
                    rough[np.isnan(rough)] = np.inf  # the greatest, as in Spark's order
                    if apart:
                        a, b = own[who], other[vi]
                        rough[(a[:, None] == b) | (a[:, None] < 0) | (b < 0)] = -np.inf
                    edge = np.partition(rough, len(vi) - k, axis=1)[:, len(vi) - k] if k < len(vi) else np.full(len(some), -np.inf)
                    error = CLOSE * n * np.linalg.norm(some, axis=1) * np.linalg.norm(v, axis=1).max()
                    edge = np.maximum(edge, least) - np.where(np.isfinite(error), error, np.inf)
                    x, y = np.nonzero((rough >= edge[:, None]) & (rough > -np.inf))
                    score = np.zeros(len(x))
                    for d in range(n):
                        score += some[x, d] * v[y, d]
                    first = np.where(np.isnan(score), np.inf, score)
                    order = np.lexsort((y, -first, x))
                    x, y, score, first = x[order], y[order], score[order], first[order]
                    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
                    turn = np.arange(len(x)) - np.repeat(start, np.diff(np.r_[start, len(x)]))
                    best = (turn < k) & (first >= least)
                    found.append((who[x[best]], vi[y[best]], score[best]))
        q_at, v_at, cosine = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table([queries.column("_id").take(pa.array(q_at)), vectors.column("_id").take(pa.array(v_at)), pa.array(cosine, pa.float64())], [query_id, vector_id, "cosine"])

    return run


def cosine_top(queries: DataFrame, vectors: DataFrame, query_id: str, vector_id: str, vector: str, k: int, least: float, apart: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, vector_id, cosine, rank): exact top k of unit vectors for a stated query set, against all rows in blocks.

    Blocks are scored as matrices, and each keeps its own top k before the shuffle, so what moves is k rows for each query and
    block. ``apart`` names a column of the queries and one of the vectors that must differ (a null differs from nothing).
    """
    extra = [[F.col(c).alias("_a")] for c in apart] if apart else [[], []]
    schema = f"{query_id} {dict(queries.dtypes)[query_id]}, {vector_id} {dict(vectors.dtypes)[vector_id]}, cosine double"
    own, rows = [F.col(query_id).alias("_id"), *extra[0]], [F.col(vector_id).alias("_id"), *extra[1]]
    s = _in_blocks(queries, vectors, own, rows, vector, vector_id, schema, _block_tops(k, least, query_id, vector_id, apart is not None))
    return s.withColumn("rank", F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("cosine"), vector_id))).where(F.col("rank") <= k).select(query_id, vector_id, "cosine", "rank")


def edit_pairs(names: DataFrame, name: str, most: int, partition: list[str]) -> DataFrame:
    """(partition..., a, b, d): names a < b of a partition that are at most ``most`` edits apart.

    Two such names have a string in common that each gives when at most ``most``
    of its characters are left out: these strings are the keys on which candidates
    meet (their number depends on a name's length only), and the distance is checked.
    """

    @F.pandas_udf("array<string>")
    def without(texts: pd.Series) -> pd.Series:
        def keys(text: str | None) -> list[str]:
            found = level = {text or ""}
            for _ in range(most):
                level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
                found = found | level
            return sorted(found)

        return texts.map(keys)

    k = names.select(*partition, F.col(name)).distinct().withColumn("_k", F.explode(without(name)))
    p = k.select(*partition, "_k", F.col(name).alias("a")).join(k.select(*partition, "_k", F.col(name).alias("b")), [*partition, "_k"]).where("a < b")
    return p.select(*partition, "a", "b").distinct().withColumn("d", F.levenshtein("a", "b", most)).where("d >= 0")
