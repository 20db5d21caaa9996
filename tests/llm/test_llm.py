"""Training-data operators against brute force, round trips and held-out accuracy on small fixtures."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lakeloom.llm import chat_format, embedding_dedup, mixing, packing, pii, quality_classifier, quality_rules, simhash, suffix_dedup, warc
from lakeloom.llm.common import connected_components, star_forest
from lakeloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, schema=DOCS):
    """Fixture rows with a clashing extra column or two."""
    rows = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit("clash")).withColumn("spans", F.lit(1))


def odd_texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    base = [" ".join(word() for _ in range(rng.randrange(1, 120))) for _ in range(25)]
    texts = [*base, base[0], base[0], base[3] + " more", "the " + base[4], None, "", " ", "\n\n", "A", "A a a", "é\tß 한국어 문서 \x1c x", "x" * 5000, ("ab " * 4000), "\x0b\x0c"]
    texts += [base[5][: len(base[5]) // 2] + " ZZ " + base[6], base[6] + "\n" + base[6]]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, odd_texts()).repartition(3).cache()


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# --- shared pieces ---------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 60
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(45)] + [(i, i + 1) for i in range(20, 40)]
    want = components(n, links)
    got = {r.vertex: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == want[i] for i in range(n))
    a, b = (np.array(x) for x in zip(*links))
    v, low = star_forest(a, b)
    assert dict(zip(v.tolist(), low.tolist())) == {i: want[i] for i in range(n) if want[i] != i}


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1: SimHash ----------------------------------------------------------------------------------------


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lowered)
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, docs):
    texts = odd_texts()
    fp = [plain_fingerprint(t) for _, t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if (fp[i] ^ fp[j]).bit_count() <= 4]
    want = components(len(fp), links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_near_dedup(docs).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in range(len(fp))}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want)


def test_keep_first_tells_rows_of_one_id_apart(spark):
    rng = random.Random(12)
    a, b, c = (" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40)) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (None, b), (None, c), (None, c), (7, None), (8, ""), (9, a + " x"), (3, a)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, row int, doc int, fp int").repartition(4)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    near = (plain_fingerprint(a) ^ plain_fingerprint(a + " x")).bit_count() <= 4
    assert got == Counter([(3, a), (5, b), (None, c), (7, None), *([] if near else [(9, a + " x")])])
    assert simhash.keep_first(df.where("false")).count() == 0


@pytest.mark.parametrize("limits", [{}, {"list_limit": 3, "pairwise_run": 2}, {"pairwise_run": 8}])
@pytest.mark.parametrize("bits", [2, 4])
def test_simhash_links_are_exact(spark, limits, bits):
    """Random and crowded fingerprints: in memory, through common neighbours, and over the cluster."""
    rng = random.Random(bits)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(140):
        x = rng.choice(prints[:3])
        for b in rng.sample(range(64), rng.randrange(1, 7)):
            x ^= 1 << b
        prints.append(x)
    prints += [0, 0, (1 << 64) - 1]
    want = components(len(prints), [(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= bits])
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    named = simhash.near_components(simhash._representatives(df), bits, **limits)
    got = {r.doc_id: r.root.doc_id for r in df.join(named, "fp").collect()}
    assert got == dict(enumerate(want))


def test_simhash_empty(spark):
    assert simhash.simhash_near_dedup(documents(spark, [])).count() == 0


# --- 2: chat formatting -----------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    control = ["<|im_end|>", "<|im_start|>", "<|\\im_end|>", "<|\\\\im_start|>", "<|nl|>", "<|", "|>", "\n", "\\", "$1", "assistant", "a", "한", " "]
    rng = random.Random(2)
    texts = ["".join(rng.choice(control) for _ in range(rng.randrange(0, 9))) for _ in range(120)]
    rows = [(i // 4, i % 4, rng.choice(["user", "assistant", "system", "o\nd<|im_end|>d", "<|nl|>", None]), t if i % 17 else None) for i, t in enumerate(texts)]
    rows += [(50, None, "user", "b"), (50, 1, "assistant", "x" * 3000), (51, 1, "assistant", "same"), (51, 1, "assistant", "same"), (None, 0, "assistant", "alone")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    formed = chat_format.format_chats(df).select("conv_id", "formatted", "loss_spans", "turns").collect()
    by = defaultdict(list)
    for c, n, role, t in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by[c].append((role or "", t or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in formed} == dict(by)
    assert all(t.sound for r in formed for t in r.turns)
    for r in formed:
        under = [re.sub(r"<\|\\(\\*)(im_start|im_end)\|>", r"<|\1\2|>", r.formatted[s.start : s.start + s.length]) for s in r.loss_spans]
        assert under == [t for role, t in by[r.conv_id] if role == "assistant"]
        assert r.formatted.count("<|im_end|>") == r.formatted.count("<|im_start|>") == len(by[r.conv_id])
    digest = {r.conv_id: r for r in chat_format.chat_digest(df).collect()}
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        d = digest[c]
        assert (d.n_turns, d.loss_chars) == (len(turns), len(loss))
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_leaves_plain_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi \\ <b> | >"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    r = chat_format.format_chats(df).first()
    assert r.formatted == "<|im_start|>user\nhi \\ <b> | ><|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert "Python" not in chat_format.chat_digest(df)._jdf.queryExecution().toString()


def test_chat_empty(spark):
    assert chat_format.chat_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- 3: WARC ------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    long_ = "<html>" + "é" * 80 + "</html>"
    other = "<html>" + "z" * 200
    rows = [(1, "http://b.example.com/x?y=1#f", long_), (2, "https://a.example.com/", "short"), (3, "https://a.example.com/", "short"), (9, "http://c.org", long_), (4, "http://c.org/\r\nX: y", long_), (5, None, other), (6, "http://b.example.com/x?y=1", other), (7, "", None), (8, "nonsense\ttab", "")]
    rows += [(2, "https://a.example.com/", "short again"), (100, "http://u@HOST.com:8080/p", "x" * 99), (101, "http://HOST.com:8080/p", "x" * 99), (102, "h", "x" * 100), (103, "h", "x" * 100)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    want = []
    first: dict[bytes, int] = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        b = (h or "").encode()
        if len(b) >= 100:
            first.setdefault(b, i)
        target = first.get(b, i)
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if target == i else "revisit", None if target == i else target))
    got = warc.warc_round_trip(df, str(tmp_path / "w"), block_entries=2, archive_bytes=600)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    archive = warc.write_archives(df, str(tmp_path / "v"), block_entries=3)
    found = warc.lookup(spark, archive, ["https://a.example.com/", "http://nowhere.example.com/"])
    assert sorted(p for _, p in found) == [b"short", b"short", b"short again"]
    assert [h["WARC-Type"] for h, _ in found] == ["response"] * 3


def test_warc_tells_captures_of_one_page_apart(spark, tmp_path):
    """A revisit finds the payload it stands for among several of its target's id and address, a very large one among them."""
    a, b, c = "A" * 150, "B" * 150, "é" * 10_000_000
    rows = [(1, "u", a), (1, "u", b), (2, "v", b), (3, "v", a), (4, "w", c), (4, "w", a), (5, "u", c), (6, "x", c), (6, "x", b)]
    first = {a: 1, b: 1, c: 4}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.warc_round_trip(df, str(tmp_path / "w"), block_entries=2)
    want = [(i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), *(("response", None) if first[h] == i else ("revisit", first[h]))) for i, _, h in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_warc_key(spark):
    urls = {"http://www.A.com/P?q": "com,a,www)/P?q", "https://a.b.org": "org,b,a)/", "http://a.org:81/x#y": "org,a:81)/x", "": "", "http://u:p@a.org/@z": "org,a)/@z"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.k for r in df.select("u", warc.surt(F.col("u")).alias("k")).collect()} == urls


def test_warc_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.warc_round_trip(df, str(tmp_path / "w")).count() == 0


# --- 4: packing ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_token_lookup(tokenizer):
    import pyarrow as pa

    rng = random.Random(4)
    ranges = [(32, 127), (9, 14), (0x80, 0x250), (0x370, 0x460), (0x2000, 0x2100), (0xAC00, 0xAD00), (32, 33), (0x300, 0x340)]
    texts = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(1, 50))) for _ in range(800)]
    texts += ["It's I'LL we've 'S''s", "a_b__c 12½²x", "İstanbul ΣΑΣ straße", "é é", "<|endoftext|> x", "\x1c\x1da b\x85c\xa0d", "", "ªº¹", "!!..,,--"]
    ids = packing.WordIds(tokenizer_path())
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids.batch(pa.array(texts)) == want
    assert ids.batch(pa.array([None, *texts])) == [b"", *want]


def check_packing(rows, texts, tokenizer, capacity):
    want = Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            want[i, n, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    return len(bins), -(-total // capacity)


@pytest.mark.parametrize("shard", [16384, 20])
def test_packing(spark, docs, tokenizer, shard):
    rows = packing.pack_documents(docs, tokenizer_path(), capacity=256, shard=shard).collect()
    used, bound = check_packing(rows, odd_texts(), tokenizer, 256)
    assert used <= bound + (1 if shard > 100 else 4)


def test_packing_agrees_with_itself(spark, docs):
    a, b = (packing.pack_documents(docs.coalesce(1), tokenizer_path(), capacity=256) for _ in range(2))
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_packing_repeats_and_empty(spark, tokenizer):
    texts = [(1, "a b c"), (1, "a b c"), (None, "x"), (None, None)]
    check_packing(packing.pack_documents(documents(spark, texts), tokenizer_path()).collect(), texts, tokenizer, 4096)
    assert packing.pack_documents(documents(spark, []), tokenizer_path()).count() == 0


def awkward(seed):
    """Lengths of which two or three fill a bin of 150, seldom exactly; longest first."""
    return np.sort(np.random.default_rng(seed).integers(30, 75, 300))[::-1]


@pytest.mark.parametrize("seed", range(4))
def test_genetic_beats_one_pass(seed):
    """Best fit decreasing needs more bins than crossover and mutation end with."""
    lengths = awkward(seed)
    island = packing.Island(lengths, 150, "t")
    first = island.fitness(island.first(False))
    best = island.evolve([], 6, 150)[0]
    assert island.bound <= island.fitness(best)[0] < first[0] and island.crossovers == 150
    assert np.bincount(best, weights=lengths).max() <= 150


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 100, 300))[::-1]
    island = packing.Island(lengths, 128, "c")
    a, b = island.first(True), island.first(True)
    for _ in range(20):
        child = island.cross(a, b)
        assert len(child) == 300 and np.bincount(child, weights=lengths).max() <= 128
        whole = {tuple(np.flatnonzero(child == k)) for k in range(child.max() + 1)}
        assert whole & {tuple(np.flatnonzero(a == k)) for k in range(a.max() + 1)}
        a, b = b, child


def test_elites_migrate():
    """An island that gets another's elite ends at least as well, and differs from one that gets none."""
    lengths = awkward(1)
    elite = packing.Island(lengths, 150, "rich").evolve([], 6, 150)[0]
    alone = packing.Island(lengths, 150, "poor")
    own = alone.evolve([], 4, 3)
    items = np.zeros(len(lengths), packing._ITEM)
    items["length"] = lengths
    state = lambda genomes: [(0, 1, items.tobytes(), [g.astype("<i4").tobytes() for g in genomes], 0)]
    epoch = packing._epoch(1, 2, 150, 4, 3)
    without = epoch(packing._states(state(own))).to_pylist()
    moved = epoch(packing._states([*state(own), (0, 1, None, [elite.astype("<i4").tobytes()], 0)])).to_pylist()
    best = lambda rows: alone.fitness(np.frombuffer(rows[0]["genomes"][0], "<i4"))
    assert best(moved) <= alone.fitness(elite) and best(moved) < best(without)
    assert moved[1]["island"] == 0 and moved[1]["items"] is None and moved[1]["genomes"] == moved[0]["genomes"][:1]


def test_crossovers_happen_in_the_query(spark, docs):
    for shard in (16384, 12):
        rows = packing.pack_documents(docs, tokenizer_path(), capacity=256, shard=shard).collect()
        assert min(r.crossovers for r in rows) > 0


def test_open_bins_are_packed_together(spark):
    """One bin of each shard stays partly empty; they end up together."""
    rng = random.Random(5)
    rows = [(i, 0, 0, rng.randrange(5, 40), i) for i in range(600)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieces, capacity=128, shard=60).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((r[0], r[3]) for r in rows)
    bins = Counter()
    for r in got:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 128 and len(bins) <= -(-sum(r[3] for r in rows) // 128) + 2


def test_other_tokenizers_are_given_whole_texts(tokenizer, tmp_path):
    import json

    import pyarrow as pa

    told = json.loads(tokenizer.to_str())
    told["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told))
    ids = packing.WordIds(str(path))
    assert not ids.known and packing.WordIds(tokenizer_path()).known
    texts = ["e\u0301 a  b", "plain words 12"]
    want = [np.array(e.ids, "<u4").tobytes() for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids.batch(pa.array(texts)) == want


# --- 5: quality rules -------------------------------------------------------------------------------------------


def plain_counts(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_quality_rules(spark, docs):
    texts = dict(odd_texts())
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in texts.items():
        want, r = plain_counts(t), got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_compression_bands():
    rng = random.Random(0)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 9))) for _ in range(800)).encode()
    noise = bytes(rng.randrange(33, 127) for _ in range(5000))
    random_bytes = rng.randbytes(5000)
    assert quality_rules.compression_ok(prose)[0]
    assert not quality_rules.compression_ok(b"buy now " * 700)[0]
    assert not quality_rules.compression_ok(noise)[0] and not quality_rules.compression_ok(random_bytes)[0]
    assert not quality_rules.compression_ok(prose[:4096] + b"la " * 9000)[0]


def test_incompressible_text_is_rejected(spark):
    rng = random.Random(4)

    def letters(n):
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(n))[:n].encode()

    def coded(n):
        b = base64.b64encode(rng.randbytes(n)).decode()
        return " ".join(b[i : i + 8] for i in range(0, n, 8))[:n].encode()

    for n in (1500, 3000, 4096, 20_000, 200_000):
        assert not quality_rules.compression_ok(letters(n))[0], n
    for n in (200, 400, 1500, 4096, 50_000):
        assert not quality_rules.compression_ok(coded(n))[0], n
    good = [r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").where("length(text) > 4200").collect()]
    passed = [t for t in good if quality_rules.compression_ok(t)[0]]
    assert len(passed) >= 0.95 * len(good) > 0
    half = b"".join(passed[0][:4096] + coded(4096) for _ in range(4))
    assert not quality_rules.compression_ok(half)[0]


# --- 6: embeddings ------------------------------------------------------------------------------------------------


def test_lattice_is_e8():
    v = embedding_dedup.shortest_e8()
    assert len(v) == 240 and np.allclose((v**2).sum(1), 2)
    x = np.random.default_rng(1).normal(size=(200, 8))
    near = ((x - embedding_dedup.nearest_e8(x)) ** 2).sum(1)
    around = ((x[:, None] - (embedding_dedup.nearest_e8(x)[:, None] + v[None])) ** 2).sum(-1)
    assert (near[:, None] <= around + 1e-9).all()


def vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 24))
    near = base[:40] + rng.normal(size=(40, 24)) * 0.1
    hot = base[0] + rng.normal(size=(90, 24)) * 0.02
    rows = [(i, x.tolist(), int(i % 3)) for i, x in enumerate(np.concatenate([base, near, hot]))]
    rows = [(i, v, 0 if i >= 160 else 1 if i >= 120 or i < 40 else lab) for i, v, lab in rows]
    n = len(rows)
    rows += [(n + k, rows[0][1], 0) for k in range(5)] + [(n + 5, [2 * x for x in rows[0][1]], 0)]
    rows += [(n + 6, None, 1), (n + 7, [0.0] * 24, 1), (n + 8, [1.0] * 23 + [None], 1), (n + 9, [1.0] * 23 + [float("nan")], 1), (n + 10, rows[0][1], None), (n + 11, [], 1), (n + 12, [1.0] * 5, 1), (n + 13, [float("inf")] + [1.0] * 23, 1)]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, cls string").repartition(4)


@pytest.mark.parametrize("block", [4096, 16])
def test_embeddings(spark, block):
    rows, df = vectors(spark)
    n = len(rows)
    unit = {}
    for k, (_, v, lab) in enumerate(rows):
        if lab is not None and v and None not in v and np.isfinite(v).all() and any(v):
            unit[k] = np.array(v) / np.linalg.norm(v)
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    want, degree = components(n, links), Counter(x for p in links for x in p)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_near_dedup(df, block=block).collect()}
    assert len(got) == n and len(links) > 4000
    found = sum(x[0] for x in got.values()) / 2
    assert found <= len(links) and found >= 0.99 * len(links)
    assert all(got[i][0] <= degree[i] for i in range(n))
    assert {i: got[i][1] for i in range(n)} == dict(enumerate(want))
    assert all(k == (c == i) for i, (_, c, k) in got.items())


def test_lattice_recall_at_the_limit():
    """Pairs of cosine just above .98 in 64 dimensions meet in some cell nearly always."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.9801 * a + np.sqrt(1 - 0.9801**2) * o
    zero = np.zeros(len(a), np.int64)
    x, y = (embedding_dedup.cells(v, zero, embedding_dedup.TABLES, embedding_dedup.PROBES, embedding_dedup.SCALE) for v in (a, b))
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(x, y)]) > 0.97


def test_labels_are_compared_whole(spark):
    v = [0.3, 0.1, -0.9, 0.2]
    rows = [(1, v, 7), (2, v, 7 + (1 << 32)), (3, v, 7), (4, [2 * x for x in v], 7 + (1 << 32)), (5, v, -7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_near_dedup(df).collect()}
    assert got == {1: (1, 1), 3: (1, 1), 2: (1, 2), 4: (1, 2), 5: (0, 5)}


def test_cells_of_one_name_are_told_apart():
    """Even if two labels or lengths had cells of one name, nothing would be linked across them."""
    import pyarrow as pa

    def row(i, v, label):
        unit = np.array(v) / np.linalg.norm(v)
        return {"cell": 1, "lo": 0, "hi": 0, "block": 0, "cls": bytes([i]), "rep": i, "many": 1, "label": label, "vec": unit.tobytes(), "cells": [1]}

    rows = [row(1, [1.0, 0.0], 1), row(2, [1.0, 0.0], 2), row(3, [1.0, 0.0, 0.0], 1), row(4, [1.0, 0.01], 1)]
    out = [r for b in embedding_dedup._verify(0.98)(iter(pa.Table.from_pylist(rows).to_batches())) for r in b.to_pylist()]
    assert sorted((r["rep"], r["links"], r["low"]) for r in out) == [(1, 1, 1), (4, 1, 1)]


def test_contents_of_one_vec_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (3, [0.01, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_near_dedup(df).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1)]


def test_embeddings_empty(spark):
    assert embedding_dedup.embedding_near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# --- 7: suffixes -----------------------------------------------------------------------------------------------------


def plain_removal(texts):
    first: dict[bytes, int] = {}
    data = [(float("inf") if i is None else i, i, (t or "").encode()) for i, t in texts]
    for order, _, b in data:
        for p in range(len(b) - 49):
            g = b[p : p + 50]
            first[g] = min(first.get(g, float("inf")), order)
    out = []
    for order, i, b in data:
        mark = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < order:
                mark[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((i, len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"group_bytes": 700, "part_bytes": 150}])
def test_suffix_dedup(spark, sizes, monkeypatch):
    if sizes:  # more buckets and parts than tasks, rows cut within documents
        monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
        monkeypatch.setattr(suffix_dedup, "ROUTE_BYTES", 500)
    rng = random.Random(7)
    passage = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (49, 50, 51, 75, 120, 400)]
    texts = []
    for i in range(70):
        parts = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 70)))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passage)
            parts += [p[rng.randrange(0, 3) :], "".join(rng.choice("xyz") for _ in range(rng.randrange(0, 9)))]
        texts.append((i, "".join(parts)))
    texts += [(200, "a" * 300), (201, "a" * 130), (202, "ab" * 100), (203, None), (204, ""), (205, passage[5] * 3), (205, passage[5]), (None, passage[5]), (206, "é" * 60), (207, "é" * 60 + "x")]
    rng.shuffle(texts)
    got = suffix_dedup.suffix_dedup(documents(spark, texts).repartition(4), **sizes)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_removal(texts)


def test_bucket_pointer_refinement():
    rng = random.Random(8)
    pool = ["".join(rng.choice("ab") for _ in range(90)).encode() for _ in range(4)]
    stretches = [p[a : a + n] for p in pool for a, n in ((0, 76), (3, 70), (10, 50), (20, 60))]
    owners = np.array([rng.randrange(6) for _ in stretches])
    masks = suffix_dedup.refine(stretches, owners)
    for s, who, mask in zip(stretches, owners, masks):
        for k in range(len(s) - 49):
            g = s[k : k + 50]
            assert bool(int(mask) >> k & 1) == any(g in x and o < who for x, o in zip(stretches, owners))


def test_suffix_dedup_leaves_nothing_behind(spark, monkeypatch):
    from pathlib import Path

    before = set(spark.catalog.listTables())
    monkeypatch.setattr(suffix_dedup, "_judge", None)  # fails once the texts are written
    with pytest.raises(Exception):
        suffix_dedup.suffix_dedup(documents(spark, [(1, "x" * 60), (2, "x" * 60)]))
    assert set(spark.catalog.listTables()) == before
    assert not [f for f in Path(spark.conf.get("spark.checkpoint.dir")).glob("lakeloom_texts_*/*.parquet") if f.stat().st_size > 2000]


def test_small_blobs_of_stretches_take_few_bytes():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(40)]
    like = " ".join(rng.choices(words, k=6000)).encode()
    whole = "".join(texts).encode() * 2
    row = {"gid": 1, "part": 0, "ids": list(range(80)), "lengths": [len(t) for t in texts] * 2, "n_bytes": len(whole), "texts": suffix_dedup._zip(whole)}
    none = pa.table({"gid": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "told": pa.array([], pa.binary())})
    sent = suffix_dedup._send(32, 400, 1 << 20, like)(pa.Table.from_pylist([row]), none).to_pylist()
    opened = [suffix_dedup._open(r["stretches"], like) for r in sorted(sent, key=lambda r: r["pid"])]
    assert len(sent) > 350 and [o[0] for o in opened] == np.cumsum([0, *(len(o[3]) for o in opened)])[:-1].tolist()
    assert all(s in whole for o in opened for s in o[3]) and all(owner < 40 for o in opened for owner in o[2])
    n, size = sum(len(o[3]) for o in opened), sum(len(r["stretches"]) for r in sent)
    assert size < 40 * n, f"{size / n:.1f} bytes a stretch"


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.suffix_dedup(documents(spark, [])).count() == 0


# --- 8: classifier ----------------------------------------------------------------------------------------------------


def labelled(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice("the of and that house river stone window letter morning answer quiet".split()) + rng.choice(["", "s", "ed", ","]) for _ in range(rng.randrange(20, 200)))
    bad = lambda: " ".join(rng.choice("BUY NOW!! $$$ click ### free*** win%%% http xxx".split()) + rng.choice(["!", "##", "$"]) for _ in range(rng.randrange(20, 200)))
    texts = [(i, bad() if i % 4 == 0 else good()) for i in range(600)] + [(600, None), (601, "")]
    labels = [(i, int(i % 4 != 0), 0) for i in range(600)] + [(3, 0, 0), (5, None, 0), (None, 1, 0), (999, 1, 1)]
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in quality_classifier.quality_scores(docs, labels, per_class=120).collect()}
    assert len(got) == 602
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(r.predicted, int(i % 4 != 0)) for i, r in got.items() if r.held_out and i < 600]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.95
    kept = quality_classifier.keep_good(docs, labels, per_class=120)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_scores_by_plain_zstandard_calls(spark):
    """The score again from its definition: two dictionaries, pieces, the difference, a curve and a step."""
    import zstandard

    docs, labels = labelled(spark)
    own = docs.select("doc_id", "text")
    model = quality_classifier.fit(own, labels, per_class=120)
    assert len(model.good) == len(model.bad)
    size = {}
    for name, content in (("good", model.good), ("bad", model.bad)):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=3)
        size[name] = lambda x, c=zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False): len(c.compress(x))
    got = {r.doc_id: r.score for r in quality_classifier.quality_scores(docs, labels, per_class=120).collect()}
    by_length = defaultdict(list)
    for r in own.collect():
        t = (r.text or "").encode()
        pieces = [t[i : i + 64] for i in range(0, len(t), 64)]
        difference = sum(size["bad"](p) - size["good"](p) for p in pieces) / max(1, len(t))
        length_class = sum(len(t) >= n for n in (512, 2048, 8192))
        a, b = model.curves[length_class]
        p = 1 / (1 + np.exp(-(a + b * difference / model.scale)))
        at, share = model.steps
        want = 0.95 * float(np.interp(p, at, share)) + 0.05 * p
        assert abs(got[r.doc_id] - want) < 1e-9
        by_length[length_class].append((difference, want))
    for some in by_length.values():  # rises with the difference and knows nothing else
        scores = [x for _, x in sorted(some)]
        assert scores == sorted(scores)


def test_isotonic():
    at, share = quality_classifier.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert len(at) == 3 and abs(at[1] - 0.25) < 1e-12 and share[1] == 0.5 and (np.diff(share) >= 0).all()


def test_held_out_labels_are_never_used(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("quality", F.when(quality_classifier.fold() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality_classifier.quality_scores(docs, x, per_class=60).collect())) for x in (labels, flipped))
    assert a == b


def test_classifier_without_labels(spark):
    docs, labels = labelled(spark)
    assert {r.score for r in quality_classifier.quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert {r.score for r in quality_classifier.quality_scores(docs, labels.where("quality = 1 and doc_id not in (3, 999)")).collect()} == {1.0}
    assert quality_classifier.quality_scores(docs.where("false"), labels).count() == 0


# --- 9: mixing -------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        rest = sum(w[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else left * w[s] / rest for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("range_rows", [50_000, 7])
def test_mixing(spark, range_rows):
    rng = random.Random(10)
    sources = ["a", "b", "é", "z", None, "tiny", "none"]
    texts = [(i, " ".join("w" for _ in range(rng.randrange(1, 60))), rng.choice(sources[:5])) for i in range(300)] + [(300, "w w w", "tiny"), (301, "", "none"), (302, None, "none"), (None, "w w", "a"), (7, "w w", "a")]
    df = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, source string, size string").repartition(5)
    rows = mixing.mix(df, range_rows=range_rows).collect()
    assert len(rows) == len(texts)
    sizes = Counter()
    for _, t, s in texts:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    taken, by_source = Counter(), {(i, len((t or "").split())): s for i, t, s in texts}
    for r in rows:
        s = by_source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken == r.copies * r.size and r.copies <= 3
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 30
    again = mixing.mix(df.repartition(2), range_rows=range_rows).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


@pytest.mark.parametrize("weight", [1e-6, 0.01, 1.0])
def test_ranges_stay_small_whatever_the_weights(spark, weight):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"), F.lit("a").alias("source"), F.lit(1).alias("m"))
    rows = df.select(*mixing._measured(F.lit(weight), "x"), "m")
    sizes = [r["count"] for r in mixing._decided(rows, 100).groupBy("range").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 60


def test_equal_rows_on_the_edge(spark, monkeypatch):
    """A third of all rows are one row: as many of them are taken as fit."""
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rows = [(1, "w w w", "a", 9)] * 200 + [(i, "w w", "a", 9) for i in range(2, 202)] + [(i, "w", "b", 9) for i in range(202, 402)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies int").repartition(5)
    taken, mixed = mixing.mix(df), mixing.mixed_documents(df)
    assert taken.count() == len(rows) and mixed.columns == df.columns
    for s, size in (("a", 1000), ("b", 200)):
        target = taken.where(F.col("source_size") == size).first().target
        words = mixed.where(F.col("source") == s).agg(F.sum(F.size(F.split("text", " ")))).first()[0]
        assert abs(words - target) <= 3 and words == taken.where(F.col("source_size") == size).agg(F.sum("taken")).first()[0]
    assert max(Counter(map(tuple, mixed.collect())).items(), key=lambda x: x[1])[1] <= 3 * 200


def test_better_documents_come_first(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.when(F.col("id") < 1900, "a").otherwise("b").alias("source"), F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.1).alias("q"))
    counts = {r.good: r.n for r in mixing.mixed_documents(df, F.col("q")).where("source = 'a'").distinct().groupBy((F.col("q") > 0.5).alias("good")).agg(F.count(F.lit(1)).alias("n")).collect()}
    all_ = mixing.mix(df, F.col("q")).where("source_size = 7600").agg(F.sum("taken")).first()[0]
    assert all_ >= 7600 or counts[True] > counts[False]


def test_epochs_come_before_fractions(spark):
    df = spark.createDataFrame([(i, "w " * 10, "b" if i < 3 else "a") for i in range(23)], "doc_id long, text string, source string")
    by = defaultdict(set)
    for r in mixing.mix(df).collect():
        by[r.source_size].add(r.copies)
    assert by[30] == {3} and by[200] <= {0, 1}


def test_mixed_documents(spark):
    df = documents(spark, [(i, "w " * (i % 7 + 1)) for i in range(60)])
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})
    assert mixing.mix(df.where("false")).count() == 0


def test_stages_carry_maps_along(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(i % 9, f"word number {i} and more words", "en", f"s{i % 3}", {"k": i % 2}, [{"m": "x"}]) for i in range(40)], "doc_id long, text string, lang string, source string, extra map<string,int>, nested array<map<string,string>>")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        df = corpus_pipeline.materialise(out)
        assert not df.isEmpty(), name
    assert all(r.extra and r.nested == [{"m": "x"}] for r in df.collect())


def test_sample_of_repeated_ids_is_the_same_in_any_order(spark):
    rows = [(i % 30, f"text {i % 7} of {i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    take = lambda d: sorted(map(tuple, quality_classifier._sample(d, labels, 10).collect()))
    assert take(docs) == take(docs.repartition(7, "text")) == take(docs.orderBy(F.desc("text")))


def test_mixed_documents_tells_rows_of_one_id_apart(spark):
    texts = [(None, f"n{i} " * (i % 5 + 1), "ab"[i % 2]) for i in range(40)] + [(7, f"r{i} " * (i % 4 + 1), "a") for i in range(20)] + [(100 + i, f"u{i} w w", "b") for i in range(20)] + [(8, "same text", "a")] * 2 + [(9, None, "a")]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(5)
    words = lambda t: len((t or "").split())
    want = Counter()
    for r in mixing.mix(df, range_rows=7).collect():
        want[r.doc_id, r.size] += r.copies
    got = mixing.mixed_documents(df, range_rows=7).collect()
    assert Counter((r.doc_id, words(r.text)) for r in got) == Counter({k: n for k, n in want.items() if n})
    there, taken = Counter(texts), Counter(map(tuple, got))
    assert set(taken) <= set(there) and all(n <= 3 * there[t] for t, n in taken.items())
    assert len({t for i, t, _ in taken if i is None}) > 10
    assert Counter(map(tuple, mixing.mixed_documents(df.repartition(2), range_rows=7).collect())) == taken


# --- 10: PII -----------------------------------------------------------------------------------------------------------


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    rng = random.Random(11)
    pieces = ["a", "@", "b.c", ".", "1", "255.1.2.3", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 123-4567", "+", " ", "-", "é", "x@y.z", "..", "00012.3.4.5", "\n", "(", "9" * 20]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(t) == plain_spans(t), t
    for t in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "@" * 100_000):
        pii.base_spans(t)


def test_added_spans():
    t = "IBAN GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33; ssn 123-45-6789, part 123-45-6780; card 378282246310005"
    kinds = [(k, t[s:e]) for k, s, e, _ in pii.spans(t)]
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in kinds and sum(k == "iban" for k, _ in kinds) == 1
    assert ("ssn", "123-45-6789") in kinds and ("short_card", "378282246310005") in kinds
    assert pii.spans("version 123-45-6789 of part 378282246310005") == []


def test_added_spans_overlap_no_base_span():
    rng = random.Random(13)
    pieces = ["tel 555-123-4567 ", "ssn 123-45-6789 ", "card 378282246310005 ", "4111 1111 1111 1111 ", "+1 555 123 4567 ", "IBAN GB82WEST12345698765432 ", "a@b.co ", "10.0.0.1 ", "x "]
    for _ in range(300):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12)))
        base = pii.base_spans(t)
        taken = pii._merged(base)
        for s in range(0, len(t), 3):
            for e in (s + 1, s + 9):
                assert pii._overlaps(taken, s, e) == any(a < e and s < b for _, a, b in base)
        added = [x for x in pii.spans(t) if x[0] not in pii.BASE_KINDS]
        assert not any(a < e and s < b for _, s, e, _ in added for _, a, b in base)
    import time

    def took(n):
        start = time.perf_counter()
        pii.spans("mail a@b.co tel 555-123-4567, " * n)
        return time.perf_counter() - start

    took(100)
    assert took(16_000) < 12 * max(took(4_000), 0.02)


def test_pii_query(spark, docs):
    texts = [(1, "ä mail a@b.co, 10.0.0.1 +1 (555) 123-4567"), (2, None), (3, ""), (4, "4111 1111 1111 1111"), (4, "4111 1111 1111 1111")]
    df = documents(spark, texts)
    got = pii.pii_digest(df).collect()
    assert len(got) == 5
    for r in got:
        t = dict(texts)[r.doc_id] or ""
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(t))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans == base
    masked = {r.doc_id: (r.text, r.n_chars) for r in pii.mask_pii(df).collect()}
    assert masked[1] == ("ä mail [EMAIL], [IP] [PHONE]", 28) and masked[2] == (None, None) and masked[4][0] == "[CARD]"
    assert pii.pii_digest(df.where("false")).count() == 0


# --- the registered queries ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered(spark, name):
    df = QUERIES[name](spark, SF)
    table = {"2": "conversations", "3": "pages", "6": "embeddings"}.get(name[2], "documents")
    n = df.count()
    assert n >= (1 if table == "conversations" else spark.read.parquet(f"{SF}/{table}.parquet").count())


def test_mixing_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES["op9_mixing"](spark, SF)
    want = c.execute(ORACLE_SQL["op9_mixing"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())


def test_pipeline(spark, tokenizer, tmp_path):
    """Stage by stage, as the driver runs it: what each keeps, and the last one's rows against the tokenizer."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        assert docs.columns == columns
        ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
        assert ids(docs) <= ids(before)
        if n == 1:
            assert ids(docs) == {r.component_id for r in simhash.simhash_near_dedup(before).collect()}
        if n == 2:
            assert not any(pii.base_spans(r.text or "") for r in docs.collect()) and docs.count() == before.count()
        if n == 3:
            fitted = quality_classifier.fit(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
            scored = quality_classifier.with_score(before, fitted, "q")
            want = {r.doc_id: r.copies for r in mixing.mix(scored, F.col("q")).collect() if r.copies}
            assert Counter(r.doc_id for r in docs.collect()) == Counter(want)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    used, bound = check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), texts, tokenizer, 4096)
    assert used <= bound + 1
    assert corpus_pipeline.run(spark, SF).count() == packing.token_pieces(docs, tokenizer_path()).count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows, null, empty and long texts, clashing columns, empty tables: nothing is lost or crashes."""
    import corpus_pipeline

    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").where("n_chars > 300").limit(12).collect()]
    rows = [(None, good[0]), (None, good[1]), (None, good[1]), (1, good[2]), (1, good[3]), (1, good[3]), (2, None), (3, ""), (4, " ".join(good) * 30), (5, good[4] + " mail me@x.org"), (5, good[5]), (None, None)]
    names = "_id _n _copy _copies fp vec cls score row doc copies more at edge chunk n key size".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame([(i, t, None, None if k % 3 == 0 else "ab"[k % 2], None if t is None else len(t), *range(len(names))) for k, (i, t) in enumerate(rows)], schema)
    columns = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = Counter((r.doc_id, r.text) for r in docs.collect())
        assert stage(spark, docs.where("false"), SF).count() == 0
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        after = Counter((r.doc_id, r.text) for r in docs.collect())
        assert docs.columns == columns and (n == 2 or set(after) <= set(before))
        if n == 0:
            assert all(after[i, t] == before[i, t] for i, t in before if t and len(t) > 300)
        if n == 1:
            alone = [plain_fingerprint(t) for _, t in before]
            links = [(i, j) for i, j in itertools.combinations(range(len(alone)), 2) if (alone[i] ^ alone[j]).bit_count() <= 4]
            assert sum(after.values()) == len(set(components(len(alone), links)))
        if n == 2:
            assert sum(after.values()) == sum(before.values()) and any(t and t.endswith("mail [EMAIL]") for _, t in after)
        if n == 3:
            assert all(after[x] <= 3 * before[x] for x in after) and after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0
