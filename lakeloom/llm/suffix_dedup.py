"""Removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller doc_id. Suffixes are told apart to that depth only, and
only where a repeat is possible:

1. Buckets. In each window of LENGTH bytes the q-gram with the least hash is its
   anchor (the rightmost on ties). Equal windows have equal anchors at equal
   places, so a repeat is always found in the bucket of its anchor's q-gram.
   About one position in fourteen is an anchor. Groups of documents exchange
   sorted, delta-coded hashes of their anchors and learn which of them occur
   in another document; all other buckets are single and never move.
2. Refinement. For shared anchors, the stretch of text over which the anchor
   holds (at most 76 bytes) goes to its bucket once per distinct stretch and
   group. Equal stretches resolve at once by their smallest doc_id. Where a
   bucket has several, their suffixes start with bucket identifiers of
   8-grams and are refined by sorting on (own bucket, bucket at a later offset),
   to 16, 32 and LENGTH bytes; each round reuses the identifiers that the
   last one updated, and suffixes that are alone in their bucket are done.
   (Identifiers of one round aren't reused within it: they would tell suffixes
   apart beyond LENGTH bytes, where windows that must count as equal may differ.)
   The comparison is exact; hashes only decide where to look.
   What is sent is small: a group's stretches are numbered by hash, so a bucket's
   hashes go as deltas and their numbers not at all, and blobs are compressed with a
   dictionary of a few texts' beginnings, so that many small ones take no more than a large one.
3. Marks go back to the groups, which cover, cut and digest their texts.

Texts are stored once, compressed and bucketed by group, in the shared
checkpoint folder, and joined there without another shuffle. A common string
costs one row per group however often it occurs, so hot buckets stay small;
long documents are worked through in overlapping stretches.

Edge cases: null and empty texts have no bytes; documents shorter than LENGTH
lose nothing; rows with one doc_id never remove from each other; a null doc_id
counts as larger than any other; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import secrets
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import byte_rows, checkpoint_dir, give_back, id_and_text, materialise

LENGTH = 50
Q = 24
#: q-grams in a window of LENGTH bytes.
SPAN = LENGTH - Q + 1
PART_BYTES = 512 << 10
GROUP_BYTES = 8 << 20
#: Spare bits of an anchor's hash over those that number all anchors: one false share in 2 ** 7.
SPARE_BITS = 7
#: Bytes of text for each bucket of the stored table, and for each part into which anchors are dealt by hash.
BUCKET_BYTES, ROUTE_BYTES = 8 << 20, 8 << 20
MOST_BUCKETS = 100_000
#: Texts that open the dictionary with which stretches are compressed, and characters of each.
LIKE_TEXTS, LIKE_CHARS = 64, 1500
_TEXTS = "gid long, part int, ids array<long>, lengths array<long>, n_bytes long, texts binary"
_LAST_ID = np.iinfo(np.int64).max
_LOW = np.uint64((1 << 24) - 1)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _zip(data: bytes, like: bytes = b"") -> bytes:
    """data, compressed; bytes like it, if given, are needed again to read it."""
    return zstandard.ZstdCompressor(level=3, dict_data=_dictionary(like)).compress(data)


def _unzip(data: bytes, like: bytes = b"") -> bytes:
    return zstandard.ZstdDecompressor(dict_data=_dictionary(like)).decompress(data)


@functools.lru_cache(maxsize=4)
def _dictionary(like: bytes) -> zstandard.ZstdCompressionDict | None:
    if not like:
        return None
    made = zstandard.ZstdCompressionDict(like, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=3)
    return made


def _planes(values: np.ndarray) -> bytes:
    """64-bit values as byte planes."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view(np.uint64).ravel()


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values by a plain sort (numpy's hash-based unique is many times slower on such hashes)."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def encode_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values as deltas, byte planes, zstandard."""
    deltas = np.diff(values, prepend=np.zeros(1, np.uint64))
    return _zip(_planes(deltas))


def decode_sorted(data: bytes) -> np.ndarray:
    planes = _unzip(data)
    return np.cumsum(_unplanes(planes, len(planes) // 8, 0), dtype=np.uint64)


def anchors(data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, first window, last window, piece) for each stretch of windows with one anchor.

    data: bytes of pieces laid end to end (under 2**24), stops: their ends.
    """
    empty = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.uint64), empty, empty, empty
    with np.errstate(over="ignore"):
        w = data.astype(np.uint64)
        w = w[:-1] | (w[1:] << np.uint64(8))
        w = w[:-2] | (w[2:] << np.uint64(16))
        w = w[:-4] | (w[4:] << np.uint64(32))
        h = w[:-16] * _C[0]
        h ^= h >> np.uint64(29)
        h += w[8:-8] * _C[1]
        h ^= h >> np.uint64(31)
        h *= _C[3]
        h += w[16:] * _C[2]
        del w
        h ^= h >> np.uint64(32)
        h *= _C[4]
        h ^= h >> np.uint64(29)
        m = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[: -(SPAN - 16)], m[SPAN - 16 :])
    starts = np.r_[0, stops[:-1]]
    valid = np.zeros(len(m) + 1, np.int32)
    fits = stops - starts >= LENGTH
    np.add.at(valid, starts[fits], 1)
    np.add.at(valid, stops[fits] - LENGTH + 1, -1)
    j = np.flatnonzero(np.cumsum(valid)[: len(m)])
    if not len(j):
        return np.zeros(0, np.uint64), empty, empty, empty
    at = (_LOW - (m[j] & _LOW)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (j[1:] != j[:-1] + 1)])
    last = np.r_[new[1:], len(j)] - 1
    with np.errstate(over="ignore"):
        mixed = h[at[new]] * _C[1]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _C[3]
        mixed ^= mixed >> np.uint64(32)
    first = j[new]
    return mixed, first, j[last], np.searchsorted(stops, first, "right")


def _like(docs: DataFrame, n_docs: int) -> bytes:
    """Beginnings of a few texts from all over: a dictionary for small blobs of stretches. It only decides how many bytes they take."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n_docs))) < LIKE_TEXTS).select(F.substring("text", 1, LIKE_CHARS).alias("text"))
    return "".join(r.text or "" for r in some.limit(2 * LIKE_TEXTS).collect()).encode()


# --- texts, stored once -------------------------------------------------------------------


def _store(group_bytes: int, part_bytes: int):
    names = ["gid", "part", "ids", "lengths", "n_bytes", "texts"]
    types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, part, filled = secrets.randbits(62), 0, 0
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            values = (gid, part, ids, [len(t) for t in texts], held, _zip(b"".join(texts)))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_rows(batch, "text"), strict=True):
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
                if held >= part_bytes or len(ids) >= 20_000:
                    yield row()
                    part, filled = part + 1, filled + held
                    ids, texts, held = [], [], 0
                    if filled >= group_bytes:
                        gid, part, filled = secrets.randbits(62), 0, 0
        if ids:
            yield row()

    return run


def store_texts(docs: DataFrame, group_bytes: int, part_bytes: int, buckets: int) -> str:
    """Writes the texts to the shared checkpoint folder as a table bucketed by group: its name."""
    name = f"lakeloom_texts_{secrets.token_hex(8)}"
    rows = docs.mapInArrow(_store(group_bytes, part_bytes), _TEXTS)
    folder = f"{checkpoint_dir(docs.sparkSession)}/{name}"
    rows.write.option("path", folder).option("compression", "uncompressed").bucketBy(buckets, "gid").saveAsTable(name)
    return name


def drop_texts(spark: SparkSession, name: str) -> None:
    """Empties the table's folder, then forgets the table."""
    if spark.catalog.tableExists(name):
        spark.createDataFrame([], _TEXTS).write.insertInto(name, overwrite=True)
        spark.sql(f"DROP TABLE {name}")


def _pieces(row: dict, part_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, document numbers in the row, offsets in them): the row's bytes in pieces that overlap by one window less a byte."""
    whole = np.frombuffer(_unzip(row["texts"]), np.uint8)
    lengths = np.array(row["lengths"], np.int64)
    stops = np.cumsum(lengths)
    starts = stops - lengths
    for at in range(0, max(1, len(whole)), 2 * part_bytes):
        piece = whole[at : at + 2 * part_bytes + LENGTH - 1]
        end = at + len(piece)
        first, last = np.searchsorted(stops, at, "right"), np.searchsorted(starts, end, "left")
        yield piece, np.minimum(stops[first:last], end) - at, np.arange(first, last), np.maximum(at - starts[first:last], 0)


def _ids(row: dict) -> np.ndarray:
    return np.array([_LAST_ID if x is None else x for x in row["ids"]], np.int64)


# --- which anchors are shared ---------------------------------------------------------------


def _sketch(bits: int, parts: int, part_bytes: int):
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, hashes = None, []

        def out() -> pa.RecordBatch:
            all_ = distinct(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
            to = _bucket(all_, bits, parts)
            cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
            ends = np.r_[cuts[1:], len(to)] if len(cuts) else cuts
            blobs = [encode_sorted(all_[a:b]) for a, b in zip(cuts, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(to[cuts].astype(np.int32)), pa.array([gid] * len(cuts), pa.int64()), pa.array(blobs, pa.binary())], ["pid", "gid", "hashes"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["gid"] != gid and gid is not None:
                    yield out()
                    hashes = []
                gid = row["gid"]
                for data, stops, _, _ in _pieces(row, part_bytes):
                    hashes.append(anchors(data, stops)[0] >> shift)
        if gid is not None:
            yield out()
            hashes = []
            give_back()

    return run


def _bucket(hashes: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """The part of a hash of so many bits; rises with the hash."""
    low = max(0, bits - 24)
    return ((hashes >> np.uint64(low)) * np.uint64(parts)) >> np.uint64(bits - low)


def _shared(group: pa.Table) -> pa.Table:
    rows = group.select(["pid", "gid", "hashes"]).to_pylist()
    each = [decode_sorted(r["hashes"]) for r in rows]
    values, counts = np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint64),) * 2
    many = values[counts > 1]
    told = [(r["gid"], e[np.isin(e, many, assume_unique=True)]) for r, e in zip(rows, each, strict=True)]
    told = [(g, x) for g, x in told if len(x)]
    return _answers([g for g, _ in told], 0, [encode_sorted(x) for _, x in told])


def _answers(gids: list[int], kind: int, blobs: list[bytes]) -> pa.Table:
    return pa.table({"gid": pa.array(gids, pa.int64()), "kind": pa.array([kind] * len(gids), pa.int32()), "told": pa.array(blobs, pa.binary())})


# --- stretches of shared anchors -------------------------------------------------------------


class Stretches:
    """The distinct stretches of a group's shared anchors, numbered by hash, then first occurrence."""

    def __init__(self, rows: list[dict], shared: np.ndarray, bits: int, part_bytes: int, keep: bool) -> None:
        shift = np.uint64(64 - bits)
        number: dict[bytes, int] = {}
        found: list[tuple] = []  # hash, stretch, owner
        self.places: list[tuple] = []  # row, document, start, windows, stretch, owner
        # Anchors of the whole group are found once and kept as 32-bit places.
        pieces = []
        for r, row in enumerate(rows):
            for data, stops, docs, offsets in _pieces(row, part_bytes):
                h, first, last, piece = anchors(data, stops)
                pieces.append((r, data, stops, docs, offsets, h >> shift, first.astype(np.int32), last.astype(np.int32), piece.astype(np.int32)))
        shared = distinct(np.concatenate([shared, self._local(rows, pieces, bits)]))
        for r, data, stops, docs, offsets, h, first, last, piece in pieces:
            ids = _ids(rows[r])
            at = np.searchsorted(shared, h)
            hit = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == h) if len(shared) else []
            if not len(hit):
                continue
            raw, starts = data.tobytes(), np.r_[0, stops[:-1]]
            docs_, offsets_ = docs, offsets
            p = piece[hit]
            owner = ids[docs_[p]]
            numbers = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(first[hit].tolist(), (last[hit] + LENGTH).tolist(), strict=True)], np.int64)
            found.append((h[hit], numbers, owner))
            if keep:
                start = first[hit] - starts[p] + offsets_[p]
                self.places.append((r, docs_[p], start, (last[hit] - first[hit] + 1).astype(np.int64), numbers, owner))
        hashes, least = np.zeros(len(number), np.uint64), np.full(len(number), _LAST_ID, np.int64)
        for h, numbers, owner in found:
            hashes[numbers] = h
            np.minimum.at(least, numbers, owner)
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.hash, self.least = hashes[order], least[order]
        self.places = [(*place[:4], rank[place[4]], place[5]) for place in self.places]
        # A text is only needed where it is sent.
        if not keep:
            texts = list(number)
            self.content = [texts[i] for i in order.tolist()]

    @staticmethod
    def _local(rows: list[dict], pieces: list[tuple], bits: int) -> np.ndarray:
        """Hashes that occur in two documents of the group."""
        before = np.cumsum([0, *(len(row["lengths"]) for row in rows)])
        found = [(h, docs[piece] + before[r]) for r, _, _, docs, _, h, _, _, piece in pieces if len(h)]
        if not found:
            return np.zeros(0, np.uint64)
        h, doc = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]).astype(np.uint64)
        room = 64 - bits
        if int(before[-1]) < 1 << room:  # hash and document fit one word: one plain sort
            both = distinct((h << np.uint64(room)) | doc)
            h = both >> np.uint64(room)
        else:
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
            h = h[new]
        return distinct(h[1:][h[1:] == h[:-1]])


def _told(replies: pa.Table, kind: int) -> list[bytes]:
    return [r["told"] for r in replies.to_pylist() if r["kind"] == kind]


def _known(replies: pa.Table) -> np.ndarray:
    told = [decode_sorted(x) for x in _told(replies, 0)]
    return distinct(np.concatenate(told)) if told else np.zeros(0, np.uint64)


def _send(bits: int, parts: int, part_bytes: int, like: bytes):
    """A group's stretches, by bucket: (pid, gid, stretches). A bucket's are numbered in a row."""

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        rows = sorted(texts.to_pylist(), key=lambda r: r["part"])
        gid = rows[0]["gid"] if rows else 0
        s = Stretches(rows, _known(replies), bits, part_bytes, keep=False)
        to = _bucket(s.hash, bits, parts).astype(np.int64)
        cuts = np.flatnonzero(np.diff(to)) + 1
        pids, blobs = [], []
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(to)], strict=True):
            if start == stop:
                continue
            own = s.content[start:stop]
            body = (_planes(np.diff(s.hash[start:stop], prepend=np.zeros(1, np.uint64))), _planes(s.least[start:stop]), bytes(map(len, own)))
            pids.append(int(to[start]))
            blobs.append(_zip(struct.pack("<qq", start, stop - start) + b"".join(body) + b"".join(own), like))
        out = pa.table({"pid": pa.array(pids, pa.int32()), "gid": pa.array([gid] * len(pids), pa.int64()), "stretches": pa.array(blobs, pa.binary())})
        del s, blobs, texts, rows
        give_back()
        return out

    return run


def _open(blob: bytes, like: bytes) -> tuple[int, np.ndarray, np.ndarray, list[bytes]]:
    """(number of the first stretch, hashes, least owners, stretches)."""
    raw = _unzip(blob, like)
    start, n = struct.unpack_from("<qq", raw)
    hashes, owners = np.cumsum(_unplanes(raw, n, 16), dtype=np.uint64), _unplanes(raw, n, 16 + 8 * n).view(np.int64)
    ends = (np.cumsum(np.frombuffer(raw, np.uint8, n, 16 + 16 * n).astype(np.int64)) + (16 + 17 * n)).tolist()
    return start, hashes, owners, [raw[a:b] for a, b in zip([16 + 17 * n, *ends], ends, strict=False)]


def refine(stretches: list[bytes], owners: np.ndarray) -> np.ndarray:
    """For each stretch, a mask of its windows (bit k: the one that starts at k) that also occur in a stretch of a smaller owner.

    Bucket-pointer refinement: positions start in 8-gram buckets and are refined
    by sorting on (own bucket, bucket at a later offset) until LENGTH bytes
    are told apart; positions alone in their bucket keep their pointer.
    """
    masks = np.zeros(len(stretches), np.uint32)
    if not stretches:
        return masks
    lengths = np.array([len(s) for s in stretches], np.int64)
    data = np.frombuffer(b"".join(stretches) + bytes(8), np.uint8)
    stops = np.cumsum(lengths)
    n = int(stops[-1])
    left = np.repeat(stops, lengths) - np.arange(n)  # bytes to the end of the stretch
    w = data.astype(np.uint64)
    w = w[:-1] | (w[1:] << np.uint64(8))
    w = w[:-2] | (w[2:] << np.uint64(16))
    w = (w[:-4] | (w[4:] << np.uint64(32)))[:n]
    pointer = np.full(n, -1, np.int64)
    live = np.flatnonzero(left >= 8)
    pointer[live] = np.unique(w[live], return_inverse=True)[1]
    fresh = n + 1
    for depth, offset in ((16, 8), (32, 16), (LENGTH, LENGTH - 32)):
        live = live[left[live] >= depth]
        counts = np.bincount(pointer[live] - pointer[live].min()) if len(live) else np.zeros(0, np.int64)
        if len(live):
            live = live[counts[pointer[live] - pointer[live].min()] > 1]
        if not len(live):
            return masks
        own, later = pointer[live], pointer[live + offset]
        own = np.unique(own, return_inverse=True)[1]
        later = np.unique(later, return_inverse=True)[1]
        refined = np.unique((own << 32) | later, return_inverse=True)[1]
        pointer = pointer.copy()
        pointer[live] = fresh + refined
        fresh += n + 1
    which = np.repeat(np.arange(len(lengths)), lengths)[live]
    bucket = pointer[live] - pointer[live].min()
    least = np.full(int(bucket.max()) + 1, _LAST_ID, np.int64)
    np.minimum.at(least, bucket, owners[which])
    hit = least[bucket] < owners[which]
    starts = stops - lengths
    np.bitwise_or.at(masks, which[hit], np.uint32(1) << (live[hit] - starts[which[hit]]).astype(np.uint32))
    return masks


def _judge(like: bytes):
    def run(group: pa.Table) -> pa.Table:
        rows = group.select(["gid", "stretches"]).to_pylist()
        number: dict[bytes, int] = {}
        opened = []
        for r in rows:
            start, hashes, owners, own = _open(bytes(r["stretches"]), like)
            opened.append((r["gid"], start, hashes, owners, np.array([number.setdefault(s, len(number)) for s in own], np.int64)))
        keys = list(number)
        least, anchor = np.full(len(keys), _LAST_ID, np.int64), np.zeros(len(keys), np.uint64)
        for _, _, hashes, owners, own in opened:
            np.minimum.at(least, own, owners)
            anchor[own] = hashes
        _, inverse, counts = np.unique(anchor, return_inverse=True, return_counts=True)
        several = np.flatnonzero(counts[inverse] > 1)
        part = np.zeros(len(keys), np.uint32)
        part[several] = refine([keys[i] for i in several.tolist()], least[several])
        whole = (np.uint64(1) << (np.array([len(s) for s in keys], np.uint64) - np.uint64(LENGTH - 1))) - np.uint64(1)
        gids, blobs = [], []
        for gid, start, _, owners, own in opened:
            masks = np.where(least[own] < owners, whole[own].astype(np.uint32), part[own])
            some = np.flatnonzero(masks)
            if len(some):
                gids.append(gid)
                blobs.append(_zip(np.r_[(some + start).astype("<u4"), masks[some].astype("<u4")].tobytes()))
        del opened, least, anchor, keys, several, part, rows, number
        give_back()
        return _answers(gids, 1, blobs)

    return run


def _remove(bits: int, part_bytes: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        rows = sorted(texts.to_pylist(), key=lambda r: r["part"])
        s = Stretches(rows, _known(replies), bits, part_bytes, keep=True)
        masks = np.zeros(len(s.least), np.uint32)
        for blob in _told(replies, 1):
            both = np.frombuffer(_unzip(blob), "<u4")
            masks[both[: len(both) // 2]] = both[len(both) // 2 :]
        least = s.least
        by_row: dict[int, list[tuple]] = {}
        for r, *rest in s.places:
            by_row.setdefault(r, []).append(rest)
        out: list[tuple] = []
        for r, row in enumerate(rows):
            lengths = np.array(row["lengths"], np.int64)
            begins = np.cumsum(lengths) - lengths
            total = int(lengths.sum())
            edge = np.zeros(total + 1, np.int64)
            for doc, start, windows, number, owner in by_row.get(r, ()):
                mask = np.where(owner > least[number], (np.uint64(1) << windows.astype(np.uint64)) - np.uint64(1), masks[number].astype(np.uint64))
                for k in range(SPAN):
                    on = np.flatnonzero((mask >> np.uint64(k)) & np.uint64(1))
                    if len(on):
                        at = begins[doc[on]] + start[on] + k
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + LENGTH, -1)
            gone = np.cumsum(edge)[:total] > 0
            raw = np.frombuffer(_unzip(row["texts"]), np.uint8)
            for doc_id, at, n in zip(row["ids"], begins.tolist(), lengths.tolist(), strict=True):
                g = gone[at : at + n]
                removed = int(np.count_nonzero(g))
                text = raw[at : at + n]
                kept = text[~g].tobytes() if removed else text.tobytes()
                runs = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[0]) if removed else 0
                out.append((doc_id, n, removed, runs, hashlib.sha256(kept).hexdigest()))
        columns = zip(*out, strict=True) if out else [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        del s, by_row, rows, texts
        give_back()
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs."""
    spark = docs.sparkSession
    own = id_and_text(docs, id_col, text_col)
    total, n_docs = own.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    # Both grow with the texts, so what a task holds doesn't. Fewer buckets than shuffle partitions would be dealt anew.
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, max(least, -(-total // BUCKET_BYTES)))
    parts = max(least, -(-total // ROUTE_BYTES))
    bits = min(56, max(24, int(2 * total / (SPAN + 1) + 1).bit_length() + SPARE_BITS))
    reply = "gid long, kind int, told binary"
    like = _like(own, n_docs)
    name = store_texts(own, group_bytes, part_bytes, buckets)
    try:
        texts = spark.table(name)
        sketch = texts.mapInArrow(_sketch(bits, parts, part_bytes), "pid int, gid long, hashes binary")
        shared = materialise(sketch.repartition(parts, "pid").groupBy("pid").applyInArrow(_shared, reply))
        sent = texts.groupBy("gid").cogroup(shared.groupBy("gid")).applyInArrow(_send(bits, parts, part_bytes, like), "pid int, gid long, stretches binary")
        judged = materialise(sent.repartition(parts, "pid").groupBy("pid").applyInArrow(_judge(like), reply))
        answers = shared.union(judged)
        return materialise(texts.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(_remove(bits, part_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    finally:
        drop_texts(spark, name)
