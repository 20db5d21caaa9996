"""Embedding near-duplicates by E8 lattice hashing.

A vector is scaled to length one, projected to eight Gaussian coordinates in
each of ``TABLES`` tables, and decoded to the nearest point of the E8 lattice
(the better of D8 and D8 + 1/2). It is filed under that cell and the
``PROBES - 1`` neighbouring cells nearest to it (of the 240 around the point), so
two vectors meet if any of their cells agree; every meeting is verified by
the cosine in double precision. All rows are indexed; recall against brute force
is measured by a test and in the README.

Cells are named by hashes, so members of one name are told apart by label and
length before they are compared.

Skew: equal vectors of a label first become one member with a count, so copies
are never paired. A cell with more than ``BLOCK`` members is cut into blocks, and
every pair of blocks is a task of its own (matrix products; pairs stay inside
the task). A pair that meets in several cells counts only in the least of the
cells it shares. A task returns, for each member, the number of vectors it
linked and a star forest, never the pairs.

Edge cases: rows with a null label, a null vec_id or a vector that is null,
empty, zero or holds null or non-finite components link with nothing (n_links 0,
their own component); vectors of different lengths never meet; repeated rows
count as further vectors; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import connected_components, materialise, star_forest

COSINE = 0.98
TABLES = 4
PROBES = 3
SCALE = 0.8
BLOCK = 4096
SEED = 8


def nearest_d8(x: np.ndarray) -> np.ndarray:
    y = np.rint(x)
    rest = x - y
    odd = np.flatnonzero(y.sum(1) % 2)
    worst = np.abs(rest[odd]).argmax(1)
    y[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return y


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Rows of x decoded to the nearest lattice points."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def shortest_e8() -> np.ndarray:
    """The 240 shortest lattice vectors: differences between a cell and its neighbours."""
    ones = [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    halves = [v for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array([*ones, *halves])


def cells(unit: np.ndarray, label: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """Signed 64-bit names of each row's cells, tables * probes of them."""
    draw, around = np.random.default_rng(SEED), shortest_e8()
    out = np.empty((len(unit), tables * probes), np.int64)
    for t in range(tables):
        x = unit @ (draw.normal(size=(unit.shape[1], 8)) / scale)
        own = nearest_e8(x)
        points = [own]
        if probes > 1:
            toward = np.argsort(-((x - own) @ around.T), axis=1, kind="stable")[:, : probes - 1]
            points += [own + around[toward[:, p]] for p in range(probes - 1)]
        for p, y in enumerate(points):
            twice = np.rint(2 * y).astype("<i4")
            head = np.c_[label, np.full(len(label), t), np.full(len(label), unit.shape[1])].astype("<i8")
            rows = np.ascontiguousarray(np.c_[head, twice.astype("<i8")])
            out[:, t * probes + p] = [int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest(), "little", signed=True) for r in rows]
    return out


def _file(tables: int, probes: int, scale: float):
    names = ["vec_id", "cls", "label", "vec", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = (batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding"))
            cls, blob, keys = [None] * len(ids), [None] * len(ids), [None] * len(ids)
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                if ids[i] is not None and labels[i] is not None and v and None not in v:
                    by_size.setdefault(len(v), []).append(i)
            for rows in by_size.values():
                raw = np.array([vectors[i] for i in rows], np.float64)
                with np.errstate(all="ignore"):
                    top = np.abs(raw).max(1, keepdims=True)
                    scaled = raw / top
                    unit = scaled / np.sqrt((scaled**2).sum(1, keepdims=True))
                good = np.isfinite(raw).all(1) & (top[:, 0] > 0)
                rows, raw, unit = [i for i, g in zip(rows, good, strict=True) if g], raw[good], unit[good]
                if not rows:
                    continue
                named = cells(unit, np.array([labels[i] for i in rows], np.int64), tables, probes, scale)
                for n, i in enumerate(rows):
                    cls[i] = hashlib.blake2b(np.int64(labels[i]).tobytes() + raw[n].tobytes(), digest_size=16).digest()
                    blob[i], keys[i] = unit[n].tobytes(), sorted(set(named[n].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cls, pa.binary()), pa.array(labels, pa.int64()), pa.array(blob, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names)

    return run


def _shared_first(a: list[np.ndarray], i: np.ndarray, j: np.ndarray, here: int) -> np.ndarray:
    """Whether ``here`` is the least cell that members i and j share."""
    keys = np.stack(a)
    out = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        x, y = keys[i[at : at + (1 << 16)]], keys[j[at : at + (1 << 16)]]
        low = np.full(len(x), np.iinfo(np.int64).max)
        for k in range(x.shape[1]):
            both = (x[:, k : k + 1] == y).any(1)
            low = np.where(both, np.minimum(low, x[:, k]), low)
        out[at : at + (1 << 16)] = low == here
    return out


def _verify(cosine: float, tile: int = 1024):
    """Over rows sorted by (cell, lo, hi): members with links, their number, and the least member they are joined to."""
    types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())

    def pairs(rows: list[dict], width: int) -> list[tuple]:
        """Members of one label and one length of vector that have links."""
        rows = sorted(rows, key=lambda r: (r["rep"], r["cls"]))
        cell, lo, hi = rows[0]["cell"], rows[0]["lo"], rows[0]["hi"]
        unit = np.frombuffer(b"".join(r["vec"] for r in rows)).reshape(len(rows), -1)
        many, block = (np.array([r[c] for r in rows], np.int64) for c in ("many", "block"))
        keys = [np.r_[r["cells"], np.full(width - len(r["cells"]), r["cells"][-1])] for r in rows]
        links, a, b = np.zeros(len(rows), np.int64), [], []
        for s in range(0, len(rows), tile):
            for t in range(s, len(rows), tile):
                i, j = np.nonzero(unit[s : s + tile] @ unit[t : t + tile].T >= cosine)
                i, j = i + s, j + t
                wanted = (i < j) & ((lo == hi) | (block[i] != block[j]))
                i, j = i[wanted], j[wanted]
                if len(i):
                    mine = _shared_first(keys, i, j, cell)
                    i, j = i[mine], j[mine]
                    np.add.at(links, i, many[j])
                    np.add.at(links, j, many[i])
                    a.append(i)
                    b.append(j)
        low = np.arange(len(rows))
        if a:
            moved, least = star_forest(np.concatenate(a), np.concatenate(b))
            low[moved] = least
        return [(rows[i]["rep"], rows[i]["cls"], n, rows[k]["rep"], rows[k]["cls"]) for i, (n, k) in enumerate(zip(links.tolist(), low.tolist(), strict=True)) if n]

    def bucket(rows: list[dict]) -> list[tuple]:
        """The name of a cell is a hash: labels and lengths are compared themselves."""
        apart: dict[tuple, list[dict]] = {}
        for r in rows:
            apart.setdefault((r["label"], len(r["vec"])), []).append(r)
        return [x for some in apart.values() if len(some) > 1 for x in pairs(some, max(len(r["cells"]) for r in some))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        now = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*bucket(held), strict=True)) or [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["rep", "cls", "links", "low", "low_cls"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for r in batch.slice(at, 1024).to_pylist():
                    key = (r["cell"], r["lo"], r["hi"])
                    if key != now:
                        if len(held) > 1:
                            yield out()
                        held, now = [], key
                    held.append(r)
        if len(held) > 1:
            yield out()

    return run


def embedding_near_dedup(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label)."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    filed = materialise(own.mapInArrow(_file(tables, probes, scale), "vec_id long, cls binary, label long, vec binary, cells array<long>"))
    members = filed.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"), F.first("label").alias("label"), F.first("vec").alias("vec"), F.first("cells").alias("cells"))
    members = materialise(members)
    place = members.select("cls", F.explode("cells").alias("cell"))
    sizes = place.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    place = place.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    place = place.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    place = place.select("cls", "cell", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    full = place.join(members, "cls").select("cell", "lo", "hi", "block", "cls", "rep", "many", "label", "vec", "cells")
    found = full.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi").mapInArrow(_verify(cosine), "rep long, cls binary, links long, low long, low_cls binary")
    found = materialise(found)
    # Vertices are (smallest vec_id, content): one id may have several contents.
    roots = connected_components(found, F.struct("rep", "cls"), F.struct(F.col("low").alias("rep"), F.col("low_cls").alias("cls")))
    roots = roots.select(F.col("vertex.cls").alias("cls"), F.col("root.rep").alias("root"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    named = members.select("cls", "rep", "many").join(links, "cls", "left").join(roots, "cls", "left")
    named = named.select("cls", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = filed.select("vec_id", "cls").join(named, "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
