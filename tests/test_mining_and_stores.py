"""Mined names, respaced runs, stores of versions and shapes, by cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import brute
from lakeloom.functions import segment
from lakeloom.operators import mining, shapes, versions


@pytest.mark.parametrize("longest", [6, None, 2])
def test_sequences_and_names(spark, longest):
    rng = random.Random(1)
    front, back = ["Big Data Hub", "Big Data", "Green Campus Project", "기관지원사업 육성", "12 Steps"], ["plan 2020", "report", "final report", "application form", ""]
    titles = [(i, f"{rng.choice(front)} {rng.choice(back)}".strip()) for i in range(40)] + [(50, None), (51, ""), (52, "a b a b a b"), (53, "a b a b")]
    bodies = [(i, f"On {rng.choice(front)}, then {rng.choice(front)} and {rng.choice(front)}.") for i in range(30)] + [(60, None), (61, "")]
    t = spark.createDataFrame(titles, "doc_id long, title string").withColumn("gram", F.lit("clash"))
    b = spark.createDataFrame(bodies, "doc_id long, text string")
    got = mining.frequent_sequences(t, longest=longest).collect()
    want = brute.sequences(titles, longest=longest)
    assert {r.gram: (r.docs, r.place) for r in got} == want
    for r in got:
        longer = [h for h in want if f" {r.gram} " in f" {h} " and h != r.gram and want[h][0] >= r.docs]
        assert r.closed == (not longer)
    names = mining.mine_names(t, b, longest=longest, least_mentions=1.2)
    assert sorted(map(tuple, names.collect())) == sorted(tuple(r.values()) for r in brute.mined_names(titles, bodies, longest=longest, least_mentions=1.2))
    assert longest != 6 or {"big data", "green campus project"} <= {n for r in names.collect() for n in r.surfaces}


def test_nothing_to_mine(spark):
    t = spark.createDataFrame([], "doc_id long, title string, text string")
    assert mining.frequent_sequences(t).collect() == [] and mining.mine_names(t, t).collect() == []


def test_respace(spark):
    corpus = ["the cat sat on the mat with the hat"] * 20 + ["a cat and a dog sat", "기관 지원 사업 안내 및 일정"] * 10
    docs = spark.createDataFrame([(x,) for x in corpus], "text string")
    costs = segment.word_costs(docs)
    rows = spark.createDataFrame([("thecatsatonthehat",), ("short\nthematwiththecat x",), ("기관지원사업안내및일정 모름",), (None,), ("",), ("zzzzqqqqzzzzqqqq",)], "text string")
    got = [r.t for r in rows.select(segment.respace(F.col("text"), costs).alias("t")).collect()]
    assert got[:5] == ["the cat sat on the hat", "short\nthe mat with the cat x", "기관 지원 사업 안내 및 일정 모름", None, ""]
    assert got[5].replace(" ", "") == "zzzzqqqqzzzzqqqq"
    assert len(segment.word_costs(docs, vocabulary=3)) == 4


def test_versions(spark):
    rng = random.Random(2)
    rows, texts = [], {}
    for doc, n in ((1, 120), (2, 1), (3, 51)):
        lines: list[str] = []
        for v in range(n):
            for _ in range(rng.randrange(4)):
                if lines and rng.random() < 0.5:
                    del lines[rng.randrange(len(lines))]
                else:
                    lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", "a", "line", "é", "x\ty"]))
            texts[doc, 3 * v] = "\n".join(lines)
            rows.append((doc, 3 * v, texts[doc, 3 * v] if v != 7 else None))
            if v == 7:
                texts[doc, 3 * v] = ""
    df = spark.createDataFrame(rows, "doc_id long, version int, text string").repartition(3)
    log = versions.write_deltas(df).cache()
    kinds = {(r.doc_id, r.version): r.kind for r in log.collect()}
    assert {k for k, v in kinds.items() if v == "full"} == {(1, 0), (1, 150), (1, 300), (2, 0), (3, 0), (3, 150)}
    got = versions.read_versions(log).collect()
    assert {(r.doc_id, r.version): r.text for r in got} == texts and max(r.step for r in got) == 49
    some = versions.read_some(log, spark.createDataFrame([(1, 297), (1, 3), (3, 150), (9, 1)], "doc_id long, version int"))
    assert {(r.doc_id, r.version): r.text for r in some.collect()} == {k: texts[k] for k in ((1, 297), (1, 3), (3, 150))}
    assert versions.read_versions(versions.write_deltas(df.where("false"))).collect() == []


def test_line_delta():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ("\n".join(rng.choice(["", "x", "y"]) for _ in range(rng.randrange(5))) for _ in range(2))
        at, removed, lines = versions.line_delta(a, b)
        added = len(b.split("\n")) - len(a.split("\n")) + removed
        assert versions.apply_delta(a, at, removed, lines if added else "", added) == b


def test_shapes(spark):
    nodes = spark.createDataFrame([("a", "doc", "A", "2020"), ("b", "doc", None, "x"), ("c", "doc", "c!", None), ("p", "program", "P", "1"), ("q", "program", "", "1"), ("z", "other", None, None)], "id string, type string, label string, year string")
    edges = spark.createDataFrame([("p", "a", "has"), ("p", "a", "has"), ("q", "a", "has"), ("p", "b", "has"), ("p", "q", "has"), ("p", "gone", "has"), ("a", "b", "cites"), ("z", "a", "has"), ("b", "a", "odd")], "src string, dst string, kind string")
    doc = shapes.Shape("doc", [shapes.Value("label", pattern="^[A-Z]$"), shapes.Value("year", False, datatype="int")], [shapes.Link("has", 1, 2, "program", inverse=True), shapes.Link("cites", 0, 0)], closed=True)
    program = shapes.Shape("program", [shapes.Value("label")], [shapes.Link("has", 2, None, "doc")])
    got = shapes.violations(nodes, edges, [doc, program])
    want = [
        ("doc", "a", "class", "^has", 1), ("doc", "a", "too many", "^has", 3), ("doc", "a", "too many", "cites", 1), ("doc", "b", "missing", "label", 1), ("doc", "b", "datatype", "year", 1), ("doc", "b", "closed", "odd", 1),
        ("doc", "c", "pattern", "label", 1), ("doc", "c", "too few", "^has", 0), ("program", "p", "class", "has", 2), ("program", "q", "missing", "label", 1), ("program", "q", "too few", "has", 1),
    ]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {(r.shape, r.rule, r.path): r.nodes for r in shapes.report(got).collect()}["doc", "too many", "^has"] == 1
    assert shapes.violations(nodes, edges, []).collect() == []
    lines = shapes.schema_triples([doc, program])
    assert lines == sorted(set(lines)) and "<urn:graph:has> <http://www.w3.org/2000/01/rdf-schema#range> <urn:graph:doc> ." in lines


def test_best_words_look_at_words_that_end_at_a_place_only():
    """As trying every length of the last word does, and without a lookup for each of them."""

    class Counting(dict):
        lookups = 0

        def get(self, *a):
            Counting.lookups += 1
            return super().get(*a)

    def plain(run, costs):
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            tried = [(best[end - n] + costs.get(run[end - n : end], costs.get("", 0.0) + segment.UNKNOWN_CHAR * n), n) for n in range(1, min(segment.LONGEST_WORD, end) + 1)]
            low, n = min(tried)
            best.append(low)
            back.append(end - n)
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return out[::-1]

    rng = random.Random(3)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 6))): rng.choice([1.0, 2.0, 2.5, 4.0]) for _ in range(40)} | {"z" * 30: 0.1, "": 6.0}
    for n in [0, 1, 5, *range(20, 200, 7)]:
        run = "".join(rng.choices("abcdz", weights=[5, 5, 5, 1, 1], k=n))
        costs = Counting(words)
        assert segment.best_words(run, costs) == plain(run, words)
        assert segment.best_words(run, {}) == plain(run, {})
    assert Counting.lookups < 100
