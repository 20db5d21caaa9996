"""Hard negatives, sharding and the audit of sources against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import hard_negatives, sharding, source_audit
from lakeloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def negatives_by_brute_force(rows, k=5, n=10):
    whole = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i, label, tuple(math.floor(256 * x) for x in v)] = None
    out = []
    for a in whole:
        if a[0] % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in whole if b != a and len(b[2]) == len(a[2])))
        for s, positive, _ in [x for x in scored if x[2] == a[1]][:k]:
            window = [x for x in scored if x[2] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:n]
            out += [(a[0], positive, r, x[1], -s, -x[0]) for r, x in enumerate(window, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int"
MINED = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 40, "anchor_rows": 2}, {"pivots": 1}])
def test_hard_negatives(spark, blocks):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i * 10, (centres[i % 6] + rng.normal(size=8) * 0.4).tolist(), int(rng.integers(3))) for i in range(160)]
    rows += [(5000 + i, rows[10][1], i % 2) for i in range(40)]  # one vector, two labels, many ids
    rows += [rows[10], rows[10], (100, [0.0] * 8, 1), (200, [1.0] * 8, None), (300, None, 1), (400, [1.0, None] * 4, 1), (500, [math.inf] + [0.0] * 7, 1), (None, [1.0] * 8, 1), (600, [math.nan] * 8, 1), (700, [], 0), (701, [], 0), (702, [], 1), (800, [3.0, 4.0], 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("rid", F.lit("clash")).withColumn("dist", F.lit(1)).repartition(3)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **blocks)
    assert got.columns == MINED
    assert sorted(map(tuple, got.collect())) == negatives_by_brute_force(rows)


def test_hard_negatives_of_great_lengths(spark):
    rng = np.random.default_rng(6)
    rows = [(i * 50, (rng.normal(size=4) * 10 ** (i % 7)).tolist(), i % 2) for i in range(40)] + [(1, [1e300] * 4, 0)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == negatives_by_brute_force(rows[:-1])


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS), F.lit(True)).collect() == []
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, None, 1)], VECTORS), F.lit(None)).collect() == []


def test_pivots_rule_rows_out():
    """Brackets hold the score, and near a cluster most rows go unchecked."""
    rng = np.random.default_rng(7)
    x = np.rint(np.repeat(rng.normal(size=(8, 16)) * 300, 50, 0) + rng.normal(size=(400, 16)) * 5).astype("<i4")
    norm = (x.astype(np.int64) ** 2).sum(1)
    top = int(norm.max())
    import pyarrow as pa

    table = lambda **c: pa.table(c)
    told = hard_negatives._choose(8)(table(width=pa.array([64] * 400), top=pa.array([top] * 400), vec=[r.tobytes() for r in x], norm=norm, at=pa.array(range(400))))
    placed = hard_negatives._place(table(rid=pa.array(range(400)), vec=[r.tobytes() for r in x], norm=norm), told)
    block = hard_negatives._Block(table(vec_id=pa.array(range(400)), rid=pa.array(range(400)), label=pa.array([0] * 400), norm=norm, vec=[r.tobytes() for r in x], dist=placed.column("dist")))
    left = 0
    for i in range(400):
        low, high = block.brackets(np.array(placed.column("ask")[i].as_py()), int(norm[i]), top)
        score = x.astype(np.int64) @ x[i]
        assert (low <= score).all() and (score <= high).all()
        left += int((high >= hard_negatives._kth(low, 5)).sum())
    assert left < 400 * 400 / 3


DOCS = "doc_id long, text string, lang string, source string"


def shard_rows():
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(50)}", "en", rng.choices(["a", "b", "c", "", None], [60, 20, 10, 5, 5])[0]) for i in range(700)]
    rows += [(None, "the same", "en", "a")] * 300 + [(None, None, None, None)] * 5 + [(9, "", "en", f"single {i}") for i in range(40)]
    rows += [(1, "x" * 200_000, "en", "b"), (1, "other text", "en", "b")]
    return rows


@pytest.mark.parametrize(("shards", "range_rows"), [(24, 20_000), (24, 16), (7, 50), (2000, 30)])
def test_interleaved(spark, shards, range_rows):
    rows = shard_rows()
    df = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit("clash")).withColumn("rid", F.lit(1)).repartition(5)
    out = sharding.interleaved(df, shards, range_rows=range_rows)
    assert out.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "shard", "rid", "shard_", "slot"]
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in got) == Counter(rows)
    slots = defaultdict(list)
    mixture = Counter()
    for r in got:
        slots[r.shard_].append(r.slot)
        mixture[r.shard_, r.source] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[k]) for k in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    # Each stretch of the order holds a source in proportion, but for roundings of each source.
    for (k, source), n in mixture.items():
        assert abs(n - len(slots[k]) * sum(x[3] == source for x in rows) / len(rows)) <= 4, (k, source)
    again = sharding.interleaved(df.repartition(2), shards, range_rows=range_rows + 7)
    assert Counter((r.doc_id, r.text, r.source, r.shard_, r.slot) for r in got) == Counter((r.doc_id, r.text, r.source, r.shard_, r.slot) for r in again.collect())


def test_shards_as_files(spark, tmp_path):
    df = spark.createDataFrame(shard_rows(), DOCS)
    sharding.write_shards(sharding.interleaved(df, 5), str(tmp_path / "out"), files=9)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == df.count()
    assert sorted(r.shard for r in back.select("shard").distinct().collect()) == [0, 1, 2, 3, 4]
    for f in (tmp_path / "out").glob("shard=3/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(f)).collect()]
        assert slots == sorted(slots)


def test_shard_digest(spark):
    got = QUERIES["op12_sharding"](spark, SF)
    assert got.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    empty = spark.createDataFrame([], DOCS)
    assert sharding.shard_digest(empty).collect() == []


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit_by_brute_force(rows, least=30, top=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = [t.translate(CAPITALS) for t in TERM.findall(text or "")]
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        mine = [s for x, s in groups if x == lang]
        size = {s: sum(counts[lang, s][t] for t in kept) for s in mine}
        p = lambda n, of: 1 + 1_000_000_000 * (n + 5) // (of + 5 * len(kept))
        pairs = [(sum(abs(p(counts[lang, source][t], size[source]) - p(counts[lang, s][t], size[s])) for t in kept), s) for s in mine if s != source]
        terms = []
        for t in kept:
            if n := counts[lang, source][t]:
                f = p(n, size[source]) - p(sum(counts[lang, s][t] for s in mine), sum(size.values()))
                if f > 0:
                    terms.append((f, t))
        for part, items in (("pair", pairs), ("term", terms)):
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, x, f, r) for r, (f, x) in enumerate(items, 1) if part == "pair" or r <= top]
    return sorted(out)


def audit_rows():
    rng = random.Random(4)
    words = ["The", "the", "ÄPFEL", "äpfel", "straße", "don't", "x1y", "文書", "𐐀z", "a", "B", "naïve"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    rows = []
    for i in range(900):
        source = rng.choice(["s1", "s2", "s10", "é", None, ""])
        few = words[: 12 + 4 * (hash_of(source) % 6)]
        rows.append((" ,".join(rng.choice(few) for _ in range(rng.randrange(12))), rng.choice(["en", "en", "de", None]), source))
    rows += [(None, "en", "s1"), ("", "en", "wordless"), ("123 !", "xx", "s1"), ("rare words only", "xx", "s2"), ("the " * 3000, "en", "s2"), ("\x00@[`{\x7f", "en", "s1"), ("the" * 5000, "de", "s1")]
    return rows + [rows[0]] * 50


def hash_of(x):
    return zlib.crc32(repr(x).encode())


@pytest.mark.parametrize("block", [256, 2])
def test_source_divergence(spark, block):
    rows = audit_rows()
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "text string, lang string, source string, term int").withColumn("value", F.lit(1)).repartition(4)
    got = source_audit.source_divergence(df, block=block)
    assert sorted(map(tuple, got.collect())) == audit_by_brute_force(rows)


def test_term_counts_in_small_slices(spark):
    """Texts cut into many slices, tries handed on often."""
    rows = audit_rows()
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(2)
    want = {(r.lang, bytes(r.term), r.total, tuple(sorted(zip(r.sources, r.counts, strict=True)))) for r in source_audit.term_counts(df).collect()}
    got = {(r.lang, bytes(r.term), r.total, tuple(sorted(zip(r.sources, r.counts, strict=True)))) for r in source_audit.term_counts(df, leaves=3, slice_bytes=7).collect()}
    assert got == want and len(want) > 50


def test_source_divergence_of_nothing(spark):
    assert source_audit.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
    one = spark.createDataFrame([(None, None, None), (None, None, "a")], "text string, lang string, source string")
    assert sorted(map(tuple, source_audit.source_divergence(one).collect())) == [("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)]


def test_radix_trie():
    rng = random.Random(8)
    want = Counter()
    trie = source_audit.RadixTrie()
    for _ in range(5000):
        term = "".join(rng.choice("abé文") for _ in range(rng.randrange(1, 7))).encode()
        want[term] += 1
        trie.merge(term, 1, [(f"s{len(term) % 3}", 1)])
    assert [t for t, _ in trie.walk()] == sorted(want) and trie.size == len(want)
    assert {t: leaf[0] for t, leaf in trie.walk()} == want
    assert all(leaf[1] == {f"s{len(t) % 3}": want[t]} for t, leaf in trie.walk())


def test_share_is_exact():
    rng = random.Random(9)
    for _ in range(2000):
        terms = rng.randrange(1, 10**7)
        size = rng.randrange(10 ** rng.randrange(1, 15))
        n = rng.randrange(size + 1)
        assert source_audit.share(np.array([n]), np.array([size]), terms)[0] == 1 + 10**9 * (n + 5) // (size + 5 * terms)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_source_audit"])
def test_query_and_sql(spark, name):
    folder = "/root/testdata/sf0.01" if name == "op13_source_audit" else SF
    c = duckdb.connect()
    for t in ("embeddings", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    result = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    got = QUERIES[name](spark, folder)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(result.fetchall())
