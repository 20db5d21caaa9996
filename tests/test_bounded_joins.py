"""Operators whose results or batches would outgrow their input."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from lakeloom.operators import graph, joins, similarity


def test_equal_classes_tell_all_links_in_a_row_for_each_item(spark):
    df = spark.createDataFrame([(3, 1, "a"), (1, 1, "a"), (2, 1, "b"), (4, None, "a"), (5, None, "a"), (6, 1, "a")], "id long, n int, s string")
    assert rows(joins.equal_classes(df, "id", ["n", "s"]), "id", "class", "links") == [(1, 1, 2), (2, 2, 0), (3, 1, 2), (4, 4, 0), (5, 5, 0), (6, 1, 2)]


def test_sketches_are_those_of_the_shingles_and_empty_texts_have_none(spark, tmp_path):
    from lakeloom.plans.catalog import QUERIES

    texts = [(1, "The quick brown fox jumps over the lazy dog " * 9), (2, "한글 문서 셋"), (3, "short"), (4, "가나다라마바사아자차카타파하 abc 123"), (5, "..."), (6, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    f = similarity.fingerprint(F.col("text"))
    both = df.select(similarity.bottom_k(similarity.shingles(f)).alias("x"), similarity.shingle_sketch(f).alias("y")).collect()
    assert all(r.x == r.y for r in both)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(QUERIES["txt_minhash"](spark, str(tmp_path)), "doc_id", "k")[2:] == [(3, 1), (4, 9), (5, 0), (6, 0)]


def test_a_batch_of_sketches_holds_no_shingles():
    import tracemalloc

    rng = np.random.default_rng(1)
    texts = pd.Series(["".join(rng.choice(list("abcdefgh"), 5000)) for _ in range(50)])
    tracemalloc.start()
    out = texts.map(similarity.sketch_of)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(len(s) == 128 for s in out) and peak < 50 * 5000 * 8


def test_versions_are_judged_without_storing_shingles(spark):
    import os
    import random

    from lakeloom.operators import dedup
    from lakeloom.operators.lineage import shared_folder

    rng = random.Random(2)
    long = ["".join(rng.choice("abcdefghij") for _ in range(30_000)) for _ in range(12)]
    texts = [*long, long[0], long[3][:-60] + "zz", long[3], "", None, long[0] + "."]
    df = spark.createDataFrame([(i, "f", t) for i, t in enumerate(texts)], "doc_id long, family string, text string")
    root = shared_folder(spark).removeprefix("file:")
    stored = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(root) for f in files)
    before = stored()
    got = {r.doc_id: r for r in dedup.judge_versions(df, "family").collect()}
    assert {i: got[i].duplicate_of for i in range(12, 18)} == {12: 0, 13: 3, 14: 3, 15: None, 16: None, 17: 0}
    assert got[12].score == got[14].score == 1.0 and 0.95 <= got[13].score < 1 and [got[i].version_of for i in (0, 1, 13, 15, 16)] == [None, 0, None, 0, 0]
    assert stored() - before < sum(len(t or "") for t in texts) // 2


def test_common_shingles_of_chunks_go_as_hashes(spark):
    from lakeloom.operators import dedup

    shared, own = "The same form is used by every office here", "Nothing else in this place says what is said now"
    df = spark.createDataFrame([(d, d * 10 + i, t) for d in range(6) for i, t in enumerate((shared, f"{own} {d * 7919} {'xyzuvw'[d] * 40}"))], "doc_id long, chunk_id long, text string")
    g = df.select("doc_id", F.explode(dedup.content_shingles(F.col("text"))).alias("term"))
    assert dict(g.dtypes)["term"] == "bigint"
    common = g.where(F.col("term").isin([int(h) for h in similarity.rolling_hashes("".join(c for c in shared if c.isalnum()), 12)])).select("term")
    assert rows(dedup.corpus_reasons(df, common).where("boilerplate"), "chunk_id") == [(d * 10,) for d in (0, 1, 2, 3, 4, 5)]


def test_dense_searches_by_blocks_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(60, 8))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    vectors = [(i, i % 4 if i % 9 else None, unit[i % 50].tolist()) for i in range(60)]  # the last ten are copies
    vectors += [(60, 1, None), (61, 1, [None] + unit[0][1:].tolist()), (62, 2, unit[0][:5].tolist()), (63, 7, None)]
    df = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>")

    def product(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return None
        total = 0.0
        for x, y in zip(a, b, strict=True):  # sum() would be compensated
            total += x * y
        return total

    asked = [v for v in vectors if v[0] % 5 == 0]
    q = df.where("vec_id % 5 = 0").select(F.col("vec_id").alias("q"), F.col("label").alias("own"), "embedding")
    got = {(r.q, r["rank"]): (r.vec_id, r.cosine) for r in similarity.cosine_top(q, df, "q", "vec_id", "embedding", 6, -0.2, apart=("own", "label")).collect()}
    want = {}
    for i, own, e in asked:
        hits = [(product(e, f), j) for j, label, f in vectors if own is not None and label is not None and own != label]
        for rank, (c, j) in enumerate(sorted((h for h in hits if h[0] is not None and h[0] >= -0.2), key=lambda h: (-h[0], h[1]))[:6], 1):
            want[i, rank] = (j, c)
    assert got == want
    groups = {(r.q, r.label): (r.top, r["mean"], r.n) for r in similarity.cosine_groups(q, df, "q", "vec_id", "embedding", "label").collect()}
    assert len(groups) == len(asked) * len({v[1] for v in vectors})
    for (i, label), (top, mean, n) in groups.items():
        every = [product(next(v[2] for v in asked if v[0] == i), f) for _, g, f in vectors if g == label]
        some = [c for c in every if c is not None]
        assert n == len(every) and (top is None) == (not some)
        assert not some or (top == pytest.approx(max(some)) and mean == pytest.approx(sum(some) / len(some)))


def test_siblings_grow_with_nodes_not_pairs(spark):
    edges = spark.createDataFrame([("p", f"n{i:03}", "contains") for i in range(300)] + [("p", "n001", "contains"), ("p", "x", "other"), ("r", "n007", "contains")], "src string, dst string, kind string")
    rows = graph.siblings(edges, "contains").collect()
    assert len(rows) == 301 and {(r["class"], r.links) for r in rows if r.parent == "p"} == {("n000", 299)}
    assert [(r.node, r["class"], r.links) for r in rows if r.parent == "r"] == [("n007", "n007", 0)]


@pytest.mark.parametrize("name", ["src_office", "src_html_table"])
def test_one_small_file_of_costly_rows_is_more_than_one_task(spark, name):
    from lakeloom.plans import catalog

    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_words_are_counted_once_a_title_and_pairs_of_aspects_are_not_shuffled(spark):
    from lakeloom.operators import mining

    titles = [(i, " ".join(f"w{k % 700}" for k in range(20_000)) + f" end{i % 3}") for i in range(6)]
    t = spark.createDataFrame(titles, "doc_id long, title string")
    s = mining.frequent_sequences(t, longest=1).where("gram = 'end1' or gram = 'w5'").select("gram", "docs", "place")
    assert sorted(map(tuple, s.collect())) == [("end1", 2, round(20_000 / 20_001, 9)), ("w5", 6, round(5 / 20_001, 9))]
    roles = mining.document_roles(t, spark.createDataFrame([("end1",), ("w699",)], "word string"))
    assert sorted(map(tuple, roles.collect())) == [(i, "end1" if i % 3 == 1 else "w699") for i in range(6)]
    sections = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "z"), ("d", None)], "section string, word string")
    aspects = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "none")], "aspect int, word string")
    best = joins.best_by_words(sections, F.broadcast(aspects))
    assert sorted(map(tuple, best.collect())) == [(1, "b", 2), (2, "a", 1)]
    assert "hashpartitioning(aspect#" in best._jdf.queryExecution().executedPlan().toString() and not [x for x in best._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:] if x.startswith("aspect#") and ", section#" in x.split(")")[0]]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_hits_are_found_without_shuffling_documents(spark, tmp_path):
    from lakeloom.plans import q_retrieval
    from lakeloom.plans.registry import Tables

    spark.createDataFrame([(1, "a\nb"), (2, "c"), (3, None), (4, "d\n\ne")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    at = lambda d, s: d * 16777216 + s
    hits = spark.createDataFrame([(7, at(1, 2)), (7, at(4, 2)), (8, at(4, 3)), (8, at(9, 1))], "qid int, chunk_id long")
    found = q_retrieval.with_chunks(Tables(spark, str(tmp_path)), hits).select("qid", "doc_id", "seq", "text")
    assert rows(found, "qid", "doc_id", "seq", "text") == [(7, 1, 2, "b"), (7, 4, 2, ""), (8, 4, 3, "e")]
    assert "Exchange hashpartitioning" not in _plan(found)


def test_index_of_terms_by_generations_says_what_its_live_chunks_say(spark, tmp_path, monkeypatch):
    from lakeloom.operators import lineage, retrieval

    words = "alpha beta gamma delta eta theta iota kappa".split()
    chunks = lambda picks: spark.createDataFrame([(i, " ".join(words[(i * k + j) % 8] for j in range(4)) if k else None) for i, k in picks], "chunk_id long, text string")
    questions = spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "kappa"), (2, "eta"), (2, "theta"), (3, "none")], "qid int, term string")
    # Chunk 2 goes and comes back as it was, 3 changes twice, 5 goes, 6 loses its text, 7 is new.
    generations = [[(i, 1) for i in range(7)], [(i, 3 if i == 3 else 1) for i in range(7) if i != 2], [(i, 0 if i == 6 else 5 if i == 3 else 1) for i in (0, 1, 2, 3, 4, 6, 7)]]
    index = retrieval.LexicalIndex(spark, f"{tmp_path}/index")
    for g, picks in enumerate(generations):
        index.update(chunks(picks), g)
    for most in (500_000, 0):
        monkeypatch.setattr(lineage, "HAND_OUT", most)
        for g, picks in enumerate(generations):
            c = chunks(picks)
            want = rows(retrieval.lexical(questions, retrieval.postings(c), c.count()))
            assert rows(index.search(questions, g)) == want and want
    assert [r.chunk_id for r in spark.read.parquet(f"{tmp_path}/index/gone/generation=000001").orderBy("chunk_id").collect()] == [2, 3]


def test_expanding_search_says_the_same_whatever_is_handed_out(spark, monkeypatch):
    from lakeloom.operators import lineage, retrieval

    chunks = [(1, "alpha beta"), (2, "alpha gamma delta"), (3, "beta gamma delta"), (4, "gamma delta eta"), (5, "theta"), (6, "alpha beta gamma delta"), (7, None)]
    index = lineage.stored(retrieval.postings(spark.createDataFrame(chunks, "chunk_id long, text string")))
    questions = spark.createDataFrame([(1, "alpha"), (1, "beta"), (1, "nowhere"), (2, "eta"), (2, "gamma"), (3, "none")], "qid int, term string")
    n = spark.createDataFrame([(7,)], "n long")
    found = []
    for most in (500_000, 0):
        monkeypatch.setattr(lineage, "HAND_OUT", most)
        assert rows(retrieval.lexical(questions, index, n, held=True)) == rows(retrieval.lexical(questions, index, n))
        found.append(rows(retrieval.search_expanding(questions, index, n, floor=0.9)))
    assert found[0] == found[1] and found[0]


def test_lines_that_share_a_passage_are_not_held_against_each_other():
    import time

    from lakeloom.operators import dedup

    rng = np.random.default_rng(3)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    passage = letters(130)
    lines = [passage + letters(40) for _ in range(1500)]
    lines += [lines[7][:-2] + "zz", lines[8][20:90], lines[9], lines[10][:5]]
    prints = sorted(lines, key=lambda f: -len(f))
    at = time.process_time()
    fallen = dedup._fallen(prints, 0.9)
    assert time.process_time() - at < 4 and sum(fallen) == 4
    for trial in range(40):
        few = sorted(("".join(rng.choice(list("ab"), rng.integers(1, 40))) for _ in range(40)), key=lambda f: -len(f))
        kept, want = [], []
        for f in few:
            g = {f[i : i + 12] for i in range(max(1, len(f) - 11))}
            want.append(any(f in t or len(g & h) >= 0.9 * len(g | h) for t, h in kept))
            if not want[-1]:
                kept.append((f, g))
        assert dedup._fallen(few, 0.9) == want


def test_titles_of_few_letters_meet_in_blocks(spark, monkeypatch):
    from lakeloom.operators import joins

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abc가"), rng.integers(1, 9))) for _ in range(120)]
    grams = lambda t: {t[i : i + 2] for i in range(max(1, len(t) - 1))}
    near = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    monkeypatch.setattr(similarity, "TEXT_BLOCK", 10)
    monkeypatch.setattr(similarity, "TEXT_TILE", 7)
    monkeypatch.setattr(similarity, "GRAM_COLUMNS", 3)
    sides = [spark.createDataFrame([(i, t) for i, t in enumerate(texts) if i % 2 == s], f"{n} long, t string") for s, n in ((0, "a"), (1, "b"))]
    want = sorted((i, j, near(x, y)) for i, x in enumerate(texts) for j, y in enumerate(texts) if i % 2 == 0 and j % 2 == 1 and near(x, y) >= 0.6)
    assert want and sorted(map(tuple, similarity.bigram_join(*sides, "a", "b", "t", 0.6).collect())) == want
    empty = sides[0].where("a < 0")
    assert similarity.bigram_join(empty, sides[1], "a", "b", "t", 0.6).collect() == []
    titled = [s.withColumnRenamed("t", "title") for s in sides]
    assert "jaccard" not in joins.match_titles(*titled, left_id="a", right_id="b").columns


def test_near_chunks_make_no_frame_for_each_group(spark):
    from lakeloom.operators import dedup

    line = "a line of some length that another one nearly equals"
    chunks = spark.createDataFrame([(1, 2, line), (1, 1, line), (1, 3, line + " x"), (None, 4, "short"), (None, None, "a shorter"), (2, 5, None), (2, 6, "..")], "doc_id long, chunk_id long, text string")
    found = dedup.near_chunks(chunks)
    assert "InPandas" not in _plan(found)
    assert sorted((r.chunk_id or 0, r.duplicate) for r in found.collect()) == [(0, False), (1, True), (2, True), (3, False), (4, True), (5, False), (6, False)]


def test_hits_are_held_against_kept_ones_and_fall_inside_them(spark):
    from lakeloom.operators import retrieval

    rng = np.random.default_rng(7)
    text = "".join(rng.choice(list("abcdefghijklmnop"), 220))
    swap = lambda t, i: t[:i] + "Z" + t[i + 1 :]
    once, twice = "Q" + text[:-9], "Q" + text[8:-9] + "W" * 4  # near the row before each, not near the first
    assert retrieval.NEAR_COPY == 0.9
    grams = lambda t: {t[i : i + 12] for i in range(len(t) - 11)}
    near = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.9
    assert near(text, once) and near(once, twice) and not near(text, twice)
    hits = [(1, 1, text), (1, 2, once), (1, 3, twice), (1, 4, text[30:90]), (1, 5, text[3:9]), (1, 6, "!!"), (1, 7, "??"), (1, 8, swap(text[:40], 20)), (2, 1, text[30:90]), (2, 2, text), (2, 3, text[:5] + " - " + text[5:])]
    ranked = spark.createDataFrame([(q, 100 * q + r, r, t) for q, r, t in hits], "qid long, chunk_id long, rank int, text string")
    found = rows(retrieval.drop_near_copies(ranked), "qid", "rank")
    # What is near a dropped row only stays, what lies inside a kept one falls; a longer one behind a shorter stays.
    assert found == [(1, 1), (1, 3), (1, 6), (1, 8), (2, 1), (2, 2)]


def test_all_pairs_of_a_key_are_given_and_a_large_key_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIR_BLOCK", 7)
    df = spark.createDataFrame([(i, 1 if i < 40 else 2, "a") for i in range(45)] + [(90, None, "a"), (91, None, "a"), (92, 3, "a")], "id long, n int, s string")
    got = rows(joins.equal_pairs(df, "id", ["n", "s"]).where("a < b"), "a", "b")
    assert got == sorted(((a, b) for a in range(45) for b in range(a + 1, 45) if (a < 40) == (b < 40)), key=repr)


def test_siblings_are_told_by_pairs(spark):
    from lakeloom.plans.catalog import QUERIES

    edges = spark.createDataFrame([("p", "x", "contains"), ("p", "y", "contains"), ("p", "z", "other"), ("q", "x", "contains"), (None, "w", "contains"), (None, "v", "contains")], "src string, dst string, kind string")
    assert rows(graph.sibling_pairs(edges, "contains"), "a", "b", "parent") == [("x", "y", "p"), ("y", "x", "p")]
    assert set(QUERIES["gr_two_hop"](spark, "/root/testdata/sf0.001").columns) == {"a", "b", "parent"}
    assert set(QUERIES["jn_self_graph"](spark, "/root/testdata/sf0.001").columns) == {"a", "b"}


def test_estimates_do_not_multiply_with_every_jump(spark):
    from lakeloom.operators import dedup, organisation

    chain = [(f"n{i:05}", f"n{i + 1:05}") for i in range(600)]
    bits = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    ends = organisation._ends(spark.createDataFrame([*chain, ("x", "y"), ("y", "x")], "node string, next string"))
    assert bits(ends) < 500
    got = {r.node: r for r in ends.collect()}
    assert {r.end for n, r in got.items() if n[0] == "n"} == {"n00600"} and got["x"].end is None and got["x"].low == got["y"].low == "x"
    cards = dedup.name_cards(spark.createDataFrame(chain[:40], "a string, b string"))
    assert bits(cards) < 500 and {r.card for r in cards.collect()} == {"n00000"}


def test_a_graph_keeps_a_row_for_each_document_not_for_each_rule(spark):
    from lakeloom.operators import graph_build

    docs = spark.createDataFrame([(f"d{i}", "p", 2020 + i % 3, "plan", "c") for i in range(20)] + [("n", None, None, "plan", None)], "doc string, program string, year int, kind string, code string")
    empty = {"sections": "doc string, path string, title string", "mentions": "doc string, program string", "measures": "doc string, indicator string, value string", "ledger": "doc string, program string, family string, successor string, into string"}
    built = graph_build.build({"docs": docs.union(docs)} | {name: spark.createDataFrame([], schema) for name, schema in empty.items()})
    assert built.seen.count() == 21
    assert {r.doc: len(r.scopes) for r in built.seen.collect()} == {f"d{i}": 4 for i in range(20)} | {"n": 1}


def test_versions_meet_as_texts_not_as_sets_of_hashes(spark):
    from lakeloom.operators import dedup

    rng = np.random.default_rng(9)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnop 가나"), n))
    base = letters(3000)
    texts = [base, base[:-20] + letters(15), base, letters(400), "", None, "short", "short "]
    df = spark.createDataFrame([(i, "f", t) for i, t in enumerate(texts)], "doc_id long, family string, text string")
    out = dedup.judge_versions(df, "family")
    assert "array_intersect" not in _plan(out)
    squeeze = lambda t: "".join((t or "").split())
    grams = lambda t: {squeeze(t)[i : i + 8] for i in range(0, max(1, len(squeeze(t)) - 7), 3)} if squeeze(t) else set()
    got = {r.doc_id: (r.duplicate_of, r.score) for r in out.collect()}
    for i, t in enumerate(texts):
        scores = [(len(grams(t) & grams(u)) / len(grams(t) | grams(u)) if grams(t) and grams(u) else 0.0, -j) for j, u in enumerate(texts[:i])]
        best = max(scores, default=(0.0, 0))
        assert got[i] == ((-best[1], best[0]) if best[0] >= 0.95 else (None, None))


@pytest.mark.parametrize("chars", [1, 90, 2_000_000])
def test_common_grams_are_counted_without_shuffling_the_others(spark, monkeypatch, chars):
    from lakeloom.operators import dedup

    rng = np.random.default_rng(11)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    form, rare = "page of the yearly report", "seldom said in any text"
    texts = [letters(30) + "\n" + (form if i % 3 == 0 else letters(9)) + "\n" + (rare if i < 4 else "..") for i in range(30)] + ["", None, "!!", form, form]
    docs = spark.createDataFrame([(i if i < 33 else 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(dedup, "GROUP_CHARS", chars)
    chunks = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    got = {r.term for r in dedup.common_grams(docs, chunks, least=5, share=0.05).collect()}
    fp = lambda t: "".join(c for c in t if c.isalnum())
    want = similarity.rolling_hashes(fp(form), dedup.SHINGLE, 1, True)
    assert got == set(want.tolist())


def test_occurrences_of_sequences_are_stored_as_tables(spark, monkeypatch):
    from lakeloom.operators import mining

    held, cut = [], mining.cut
    monkeypatch.setattr(mining, "cut", lambda df: held.append(df.columns) or cut(df))
    titles = spark.createDataFrame([(i, "regional innovation platform support programme report") for i in range(3)], "doc_id long, title string")
    assert mining.frequent_sequences(titles, longest=3).count() == 15
    assert held and not any("at" in columns for columns in held)
