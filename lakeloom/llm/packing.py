"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Documents become token ids and an end id; only those longer than a sequence are
cut. Pieces are dealt to shards by hash (about ``SHARD`` pieces each, so a
shard's mix of lengths is that of the corpus and its waste is under one
sequence in some thousands), and each shard is one bin-packing problem.

Grouping GA (the genes are bins, not pieces): crossover injects whole
well-filled bins of one parent into another, drops the other's bins that
share a piece with them, and puts the displaced pieces back by best fit,
longest first; mutation dissolves the emptiest bins the same way. Each shard is
evolved on several islands, which are separate tasks; after each epoch an
island's elite migrates to the next island through a shuffle and takes part in
its next crossovers. Fitness is the number of bins, then the sum of squared fills:
a genome already at the lower bound ceil(tokens / capacity) goes on evolving
towards full bins and one nearly empty one. That bin of each shard is opened
again, and the open bins of all shards are packed together the same way, so
what is wasted in the end is a bin for some thousands of shards, not for each.

Where the tokenizer is of the kind that ``WordIds`` knows (NFC, spaces, lower case;
pre-tokens by pattern), tokens of a pre-token don't depend on its neighbours, so ids
are looked up, from the tokenizer itself on a miss; a test compares with whole
texts. Any other tokenizer is given whole texts.

A further column, crossovers, tells how many the islands of the row's shard made.

Edge cases: null and empty texts are one end id; repeated rows are packed as
often as they occur; an empty table gives an empty result; doc_id may be null.
"""

from __future__ import annotations

import json
import os
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import id_and_text, materialise, small_batches

CAPACITY = 4096
END_ID = 1
SHARD = 16384
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
#: Pre-tokens (and chunks) remembered by a Python worker.
CACHE = 500_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_STATE = "shard long, island int, items binary, genomes array<binary>, crossovers int"
_PACKED = f"{_PIECES}, sequence_id long, offset long, crossovers int, open boolean"
_ITEM = np.dtype([("doc_id", "<i8"), ("null_id", "?"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])


class WordIds:
    """ids of texts as little-endian unsigned 32-bit bytes.

    For texts of plain letters, digits and punctuation the tokenizer's normaliser
    and pattern are followed here in Arrow (lower case, one digit at a time, runs of
    letters and of other signs), and only pre-tokens not seen before go to the
    tokenizer, many at once; its end-of-word marks tell their ids apart. Any other
    text is looked up by chunk between ASCII spaces, from the tokenizer as it is.
    """

    #: Texts with any other character (or an apostrophe, or what may begin a special token) go by chunk: with these, lower case and NFC are one to one.
    ODD = r"<\||[^\t-\r\x20-\x26\x28-\x7e\x{a1}-\x{a7}\x{ab}\x{b0}\x{b1}\x{b6}\x{b7}\x{bb}\x{bf}-\x{12f}\x{132}-\x{148}\x{14a}-\x{17e}\x{410}-\x{44f}\x{2010}-\x{2018}\x{201a}-\x{2027}\x{ac00}-\x{d7a3}]"
    #: What the tokenizer's pattern sets apart from letters: one digit, or a run of other signs.
    SIGNS = r"([0-9]|[^\t-\r 0-9\pL]+)"

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known = self._is_known(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # New pre-tokens are lower case and composed already: the same model behind a plain split.
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}

    #: What the file must say of itself for ids to be looked up by pre-token.
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    @classmethod
    def _is_known(cls, path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        normalizers = (told.get("normalizer") or {}).get("normalizers")
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        split, ends = steps[0], (told.get("model") or {}).get("end_of_word_suffix")
        return normalizers == cls.NORMALIZERS and (split.get("pattern"), split.get("behavior"), split.get("invert"), ends) == ({"Regex": cls.PATTERN}, "Removed", True, "</w>")

    def _encode(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Pre-tokens, in lower case."""
        for at in range(0, len(new), 20_000):
            some = [w for w in new[at : at + 20_000] if w]
            ids = np.array(self.model.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) == len(some):
                raw, ends = ids.tobytes(), ends.tolist()
                self.words.update(zip(some, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            else:
                self.words.update(zip(some, self._encode([w.decode() for w in some]), strict=True))
        self.words[b""] = b""

    def _learn_chunks(self, new: list[bytes]) -> None:
        self.chunks.update(zip(new, self._encode([c.decode("utf-8", "replace") for c in new]), strict=True))

    def _gather(self, parts: pa.Array, known: dict[bytes, bytes], learn) -> list[bytes]:
        """Joined ids of each list of strings: each distinct string is looked up once, the rest is an Arrow take."""
        coded = parts.flatten().dictionary_encode()
        strings = coded.dictionary.cast(pa.binary()).to_pylist()
        ids = list(map(known.get, strings))
        new = [c for c, i in zip(strings, ids, strict=True) if i is None]
        if new:
            if len(known) > CACHE:
                known.clear()
                new = strings
            learn(new)
            ids = list(map(known.__getitem__, strings))
        taken = pa.array(ids, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        raw = memoryview(taken.buffers()[2] or b"") if len(taken) else memoryview(b"")
        at = ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist()
        return [bytes(raw[i:j]) for i, j in zip(at, at[1:], strict=False)]

    def batch(self, texts: pa.Array) -> list[bytes]:
        """One result per string."""
        texts = texts.fill_null("")
        if not self.known:
            return self._encode(texts.to_pylist())
        odd = pc.match_substring_regex(texts, self.ODD)
        out: list[bytes] = [b""] * len(texts)
        plain = pc.utf8_lower(texts.filter(pc.invert(odd)))
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, self.SIGNS, r" \1 "))
        chunks = pc.ascii_split_whitespace(texts.filter(odd))
        for where, parts, known, learn in ((pc.invert(odd), split, self.words, self._learn), (odd, chunks, self.chunks, self._learn_chunks)):
            if len(parts):
                for i, ids in zip(np.flatnonzero(where.to_numpy(zero_copy_only=False)).tolist(), self._gather(parts, known, learn), strict=True):
                    out[i] = ids
        return out


_READY: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each Python worker, kept between its tasks."""
    if path not in _READY:
        _READY[path] = WordIds(path)
    return _READY[path]


def _cut(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        for batch in small_batches(batches, 1000):
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.batch(batch.column("text")), strict=True):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return id_and_text(docs).mapInArrow(_cut(tokenizer_path, capacity, end_id), _PIECES)


class Bins:
    """Bins with room, found by best fit: a bit set of free sizes and a stack of bins for each."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.bits, self.by_free, self.free = capacity, 0, {}, {}

    def put(self, bin_id: int, free: int) -> None:
        self.free[bin_id] = free
        if free:
            if free in self.by_free:
                self.by_free[free].append(bin_id)
            else:
                self.by_free[free] = [bin_id]
            self.bits |= 1 << free

    def take(self, length: int) -> int | None:
        """The fullest bin that has room, taken out of the index."""
        fits = self.bits >> length
        if not fits:
            return None
        free = length + (fits & -fits).bit_length() - 1
        stack = self.by_free[free]
        bin_id = stack.pop()
        if not stack:
            del self.by_free[free]
            self.bits ^= 1 << free
        return bin_id


def best_fit(lengths: list[int], items: list[int], bin_of: np.ndarray, free: dict[int, int], capacity: int) -> None:
    """Put items (in the given order) into the bins of ``free`` or new ones; writes bin_of."""
    bins, fresh = Bins(capacity), max(free, default=-1) + 1
    for b, room in free.items():
        bins.put(b, room)
    for i in items:
        n = lengths[i]
        b = bins.take(n)
        if b is None:
            b, fresh = fresh, fresh + 1
            bins.put(b, capacity - n) if capacity > n else bins.free.__setitem__(b, 0)
        else:
            bins.put(b, bins.free[b] - n)
        bin_of[i] = b


def _tidy(bin_of: np.ndarray) -> np.ndarray:
    return np.unique(bin_of, return_inverse=True)[1].astype(np.int32)


class Island:
    def __init__(self, lengths: np.ndarray, capacity: int, seed: str) -> None:
        self.n, self.array, self.capacity = len(lengths), lengths.astype(np.int64), capacity
        self.lengths, self.random = lengths.tolist(), random.Random(seed)
        self.bound = -(-int(self.array.sum()) // capacity)
        self.crossovers = 0

    def fills(self, genome: np.ndarray) -> np.ndarray:
        return np.bincount(genome, weights=self.array).astype(np.int64)

    def fitness(self, genome: np.ndarray) -> tuple[int, float]:
        """Fewer bins first; then fuller ones (sum of squared fill)."""
        fill = self.fills(genome)
        return len(fill), -float(((fill / self.capacity) ** 2).sum())

    def _refit(self, genome: np.ndarray, loose: np.ndarray) -> np.ndarray:
        """The genome with the loose items (a mask) put back by best fit, longest first."""
        out = genome.copy()
        fill = np.bincount(out[~loose], weights=self.array[~loose]).astype(np.int64)
        used = np.unique(out[~loose])
        best_fit(self.lengths, np.flatnonzero(loose).tolist(), out, dict(zip(used.tolist(), (self.capacity - fill[used]).tolist(), strict=True)), self.capacity)
        return _tidy(out)

    def first(self, shuffled: bool) -> np.ndarray:
        out = np.full(self.n, -1, np.int32)
        order = list(range(self.n))  # items are sorted, longest first
        if shuffled:
            noise = [self.random.uniform(0.8, 1.0) for _ in order]
            order.sort(key=lambda i: -self.lengths[i] * noise[i])
        best_fit(self.lengths, order, out, {}, self.capacity)
        return _tidy(out)

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Well-filled bins of a go whole into b; what they displace is put back."""
        fill = self.fills(a)
        good = np.flatnonzero(fill >= 0.98 * self.capacity)
        if not len(good):
            good = np.argsort(-fill)[: max(1, len(fill) // 4)]
        share = self.random.uniform(0.2, 0.6)
        picked = np.zeros(len(fill), bool)
        picked[self.random.sample(good.tolist(), max(1, int(share * len(good))))] = True
        injected = picked[a]
        hit = np.zeros(int(b.max()) + 1, bool)
        hit[b[injected]] = True
        loose = hit[b] & ~injected
        out = b.copy()
        out[injected] = a[injected] + int(b.max()) + 1
        return self._refit(out, loose)

    def mutate(self, genome: np.ndarray) -> np.ndarray:
        fill = self.fills(genome)
        worst = np.argsort(fill, kind="stable")[: max(2, len(fill) // 50)]
        gone = np.zeros(len(fill), bool)
        gone[worst] = True
        some = self.random.sample(range(len(fill)), max(1, len(fill) // 50))
        gone[some] = True
        return self._refit(genome, gone[genome])

    def evolve(self, population: list[np.ndarray], size: int, generations: int) -> list[np.ndarray]:
        """The best genomes after some generations, best first; genomes of the population (own and migrated) are parents."""
        ranked = [(self.fitness(g), g) for g in population]
        while len(ranked) < size:
            new = self.first(bool(ranked))
            ranked.append((self.fitness(new), new))
        for _ in range(generations):
            ranked = sorted(ranked, key=lambda r: r[0])[:size]
            if len(ranked) > 1:
                (_, a), (_, b) = self.random.sample(ranked, 2)
                child = self.cross(a, b)
                self.crossovers += 1
                ranked.append((self.fitness(child), child))
            changed = self.mutate(ranked[0][1])
            ranked.append((self.fitness(changed), changed))
        return [g for _, g in sorted(ranked, key=lambda r: r[0])[:size]]


def _states(table: list[tuple]) -> pa.Table:
    types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.int32())
    columns = zip(*table, strict=True) if table else [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "island", "items", "genomes", "crossovers"])


def _seed(islands: int):
    def run(group: pa.Table) -> pa.Table:
        items = np.zeros(group.num_rows, _ITEM)
        for name, column in (("piece", "piece"), ("start", "start"), ("length", "length"), ("crc", "ids_crc32")):
            items[name] = group.column(column).to_numpy()
        ids = group.column("doc_id")
        items["null_id"] = ids.is_null().to_numpy()
        items["doc_id"] = ids.fill_null(0).to_numpy()
        items = items[np.lexsort((items["crc"], items["piece"], items["doc_id"], -items["length"]))]
        shard = group.column("shard")[0].as_py()
        return _states([(shard, i, items.tobytes(), [], 0) for i in range(islands)])

    return run


def _epoch(number: int, islands: int, capacity: int, population: int, generations: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next(r for r in rows if r["items"] is not None)
        shard, island = own["shard"], own["island"]
        world = Island(np.frombuffer(own["items"], _ITEM)["length"], capacity, f"{shard}/{island}/{number}")
        genomes = sorted(g for r in rows for g in r["genomes"])
        evolved = world.evolve([np.frombuffer(g, "<i4") for g in genomes], population, generations)
        packed = [g.astype("<i4").tobytes() for g in evolved]
        migrants = [(shard, (island + 1) % islands, None, packed[:1], 0)] if islands > 1 else []
        return _states([(shard, island, own["items"], packed, own["crossovers"] + world.crossovers), *migrants])

    return run


def _finish(capacity: int, first_id: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next(r for r in rows if r["items"] is not None)
        items = np.frombuffer(own["items"], _ITEM)
        world = Island(items["length"], capacity, "")
        best = min((np.frombuffer(g, "<i4") for g in sorted({g for r in rows for g in r["genomes"]})), key=world.fitness)
        emptiest = int(np.argmin(world.fills(best)))
        order = np.argsort(best, kind="stable")
        items, best = items[order], best[order]
        before = np.cumsum(items["length"], dtype=np.int64) - items["length"]
        first = np.searchsorted(best, best, "left")
        columns = {
            "doc_id": pa.array(items["doc_id"], mask=items["null_id"].copy()),
            "piece": pa.array(items["piece"]),
            "start": pa.array(items["start"]),
            "length": pa.array(items["length"].astype(np.int64)),
            "ids_crc32": pa.array(items["crc"].astype(np.int64)),
            "sequence_id": pa.array(((first_id + own["shard"]) << 24) + best.astype(np.int64)),
            "offset": pa.array(before - before[first]),
            "crossovers": pa.array(np.full(len(items), sum(r["crossovers"] for r in rows), np.int32)),
            "open": pa.array(best == emptiest),
        }
        return pa.table(columns)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, generations: int = GENERATIONS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, crossovers) for rows of token_pieces()."""
    pieces = materialise(pieces)

    def evolved(some: DataFrame, shards: int, first_id: int) -> DataFrame:
        # Equal rows hash alike; the number of a row within its task sets them apart.
        dealt = some.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
        state = dealt.groupBy("shard").applyInArrow(_seed(islands), _STATE)
        for number in range(epochs):
            state = state.groupBy("shard", "island").applyInArrow(_epoch(number, islands, capacity, population, generations), _STATE)
        return state.groupBy("shard").applyInArrow(_finish(capacity, first_id), _PACKED)

    shards = max(1, -(-pieces.count() // shard))
    packed = evolved(pieces, shards, 0)
    if shards > 1:
        packed = materialise(packed)
        loose = packed.where("open").select(*pieces.columns)
        packed = packed.where("not open").union(evolved(loose, max(1, -(-loose.count() // shard)), shards))
    return packed.drop("open")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, **options: int) -> DataFrame:
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id), capacity, **options)
