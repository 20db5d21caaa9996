"""Names in texts, scopes of questions, matching and alignment, by cases and against sequential rules."""

from __future__ import annotations

import random

import pytest

import brute
from lakeloom.operators import joins, names


@pytest.mark.parametrize("most", [names.NAME_CHARS, 12])
def test_find_names(spark, most):
    rng = random.Random(1)
    dictionary = ["NATION_1", "nation_12", "Nation 12 east", "aba", "bab", "ababab", "xx", None, "", "a.b.a.b", "기관 이름", "이름"] + ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 6))) for _ in range(30)]
    texts = ["nation_12 and Nation_1", "NATION 12 EAST", "abababab", None, "", "기관이름 이름", "n.a.t.i.o.n_1"] + ["".join(rng.choice("abc .") for _ in range(rng.randrange(300))) for _ in range(40)]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    n = spark.createDataFrame([(x,) for x in dictionary], "name string")
    got = names.find_names(t, n, most_chars=most)
    known = {brute.flat_name(x) for x in dictionary if len(brute.flat_name(x)) >= 3}
    assert sorted(map(tuple, got.collect())) == sorted((i, *h) for i, x in enumerate(texts) for h in brute.found_names(x, known))


def test_find_names_of_nothing(spark):
    t = spark.createDataFrame([(1, "abc")], "id long, text string")
    n = spark.createDataFrame([("abc",)], "name string")
    assert names.find_names(t, n.where("false")).collect() == [] and names.find_names(t.where("false"), n).collect() == []


@pytest.mark.parametrize("most", [names.NAME_CHARS, 12])
def test_classify(spark, most):
    docs = [(1, "Alpha plan", "b/alpha one", "beta beta beta"), (2, "Alpha One", "x", "alpha " * 9), (3, None, None, "beta"), (4, "beta", "beta", "alpha one alpha one alpha one beta"), (5, "", "", ""), (6, "gamma", "gamma", "none")]
    dictionary = [("alpha", "A"), ("alpha one", "A1"), ("beta", "B"), ("gamma", "G"), ("gamma", "H"), (None, "N"), ("x", "X")]
    d = spark.createDataFrame(docs, "doc_id long, title string, path string, head string")
    got = names.classify(d, spark.createDataFrame(dictionary, "name string, program string"), most_chars=most)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r.values()) for r in brute.classified(docs, dictionary))


def test_scope(spark):
    questions = [("q1", "Plans of Big Data 2020"), ("q2", "reports of big data two in 2021, and what was before?"), ("q3", "Anything?"), ("q4", "plans of bigdata in 1999"), ("q5", None), ("q6", "big data two")]
    programs = [("P1", "Big Data"), ("P2", "Big Data Two"), ("P2", "BD2")]
    docs = [("d1", "P1", 2020, "plan"), ("d2", "P1", 2020, "report"), ("d3", "P1", 2021, "plan"), ("d4", "P2", 2021, "report"), ("d5", "P2", None, None), ("d6", "P3", 2020, "plan")]
    df = spark.createDataFrame
    got = names.resolve_scope(
        df(questions, "qid string, text string"), df(programs, "program string, name string"), df(docs, "doc string, program string, year int, kind string"),
        df([("P2", "P1", "predecessor"), ("P2", "P2", "predecessor"), ("P1", "P2", "successor")], "src string, dst string, relation string"),
        df([("plan", "plans"), ("report", "reports")], "kind string, word string"), df([("predecessor", "what was before"), ("successor", "afterwards")], "relation string, word string"),
    )
    want = [("q1", "d1", "scope"), ("q2", "d4", "scope"), ("q2", "d2", "predecessor"), ("q3", None, "everything"), ("q4", "d1", "program"), ("q4", "d2", "program"), ("q4", "d3", "program"), ("q5", None, "everything"), ("q6", "d4", "scope"), ("q6", "d5", "scope")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_greedy_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.randrange(40), rng.randrange(6) / 5) for _ in range(400)]
    rows += [(100 + i, 100 + i, 5.0 - i / 50) for i in range(30)] + [(100 + i + 1, 100 + i, 5.0 - i / 50 - 0.01) for i in range(30)] + [(1, 2, None)]
    best = {}
    for a, b, s in rows:
        if s is not None:
            best[a, b] = max(s, best.get((a, b), s))
    want, used_a, used_b = [], set(), set()
    for (a, b), s in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.append((a, b, s))
    got = joins.greedy_pairs(spark.createDataFrame(rows, "a int, b int, score double"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_match_titles(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(3, 9)))
    base = [" ".join(word() for _ in range(3)) for _ in range(30)]
    change = lambda s: s.replace(rng.choice("abcde"), rng.choice("xyz"), 1)
    left = [*base, base[0], "1. " + base[1], "3) 제목", None, "", "7"]
    right = [change(b) for b in base] + [change(change(b)) for b in base[:10]] + [base[0].upper(), base[0] + "!", "제 목"]
    df = lambda rows, i: spark.createDataFrame(list(enumerate(rows)), f"{i} long, title string").repartition(2)
    got = sorted((r.left, r.right, round(r.score, 9)) for r in joins.match_titles(df(left, "left"), df(right, "right")).collect())
    want = sorted((a, b, round(s, 9)) for a, b, s in brute.matched_titles(list(enumerate(left)), list(enumerate(right))))
    assert got == want and len({a for a, *_ in got}) == len(got) == len({b for _, b, _ in got})


def sections(spark, rows):
    words = spark.createDataFrame([(s["pair"], s["path"], w) for s in rows for w in sorted(s["words"])], "pair int, path string, word string")
    titles = spark.createDataFrame([(s["pair"], s["path"], s["parent"], s["title"], s["ancestors"]) for s in rows], "pair int, path string, parent string, title_key string, ancestors array<string>")
    return words, titles


def section(path, title, words, ancestors=(), pair=1):
    return {"pair": pair, "path": path, "parent": path.rpartition(".")[0] or None, "title": title, "ancestors": list(ancestors), "words": set(words.split())}


def both_ways(spark, a, b):
    (wa, ta), (wb, tb) = sections(spark, a), sections(spark, b)
    got = {(r.pair, r.a_path, r.b_path): r.score for r in joins.align_by_context(wa, wb, ta, tb).collect()}
    want = {(r["pair"], r["a_path"], r["b_path"]): r["score"] for r in brute.aligned(a, b)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    return set(got)


def test_a_link_goes_with_the_link_above_it(spark):
    """Tasks of one title in three levels: the lowest bodies agree, those of the tops don't, so everything below goes in turn."""
    a, b = [], []
    for side, rows in ((0, a), (1, b)):
        for n, top in enumerate(("red green blue", "one two three", "sun moon star")):
            if n == 2:
                top = ("sun moon star", "cat dog cow")[side]
            p = str(n)
            rows += [section(p, "task", top), section(f"{p}.1", "task", f"mid{n} alpha{n}", ["task"]), section(f"{p}.1.1", "task", f"low{n} beta{n}", ["task", "task"]), section(f"{p}.1.1.1", f"own{n}", f"deep{n}", ["task"] * 3)]
    links = both_ways(spark, a, b)
    assert {(1, "0", "0"), (1, "0.1", "0.1"), (1, "0.1.1", "0.1.1"), (1, "1.1.1", "1.1.1"), (1, "2.1.1.1", "2.1.1.1")} <= links
    assert not {(1, "2", "2"), (1, "2.1", "2.1"), (1, "2.1.1", "2.1.1")} & links


def test_alignment_of_random_forests(spark):
    rng = random.Random(4)
    a, b = [], []
    for pair in (1, 2):
        for rows in (a, b):
            paths = [str(i) for i in range(3)]
            while len(paths) < 16:
                paths.append(f"{rng.choice(paths)}.{len(paths)}")
            titles = {p: rng.choice(["goal", "cost", "result", "", "plan"]) for p in paths}
            for p in paths:
                up, chain = p.rpartition(".")[0], []
                while up and len(chain) < 3:
                    chain.append(titles[up] or "none")
                    up = up.rpartition(".")[0]
                rows.append(section(p, titles[p], " ".join(rng.sample(["u", "v", "w", "x", "y", "z"], rng.randrange(4))), chain, pair))
    assert both_ways(spark, a, b)


@pytest.mark.parametrize("held", [True, False])
def test_a_large_dictionary_is_read_by_tasks_or_cut_into_parts(spark, monkeypatch, held):
    monkeypatch.setattr(names.wordlist, "MOST_NAMES", 100 if held else 1)
    monkeypatch.setattr(names.wordlist, "GROUP_CHARS", 40)
    texts = ["Alpha one and a very long name of many words", "alpha.one ALPHA", "", "étude \U0001f600\U0001f600\U0001f600 etude", "very long name", "a" * 100]
    dictionary = ["alpha", "alpha one", "very long name", "very long name of many words", "\U0001f600\U0001f600\U0001f600", "aaaaaaaaaaaa", "long", "ong name of ma", None, ""]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    n = spark.createDataFrame([(x,) for x in dictionary], "name string")
    known = {brute.flat_name(x) for x in dictionary if x and len(brute.flat_name(x)) >= 3}
    plans = names.find_names(t, n, most_chars=5)
    assert ("CoGroup" in plans._jdf.queryExecution().toString()) != held  # texts stay where they are
    assert sorted(map(tuple, plans.collect())) == sorted((i, *h) for i, x in enumerate(texts) for h in brute.found_names(x, known))
    want = sorted((i, x, sum(brute.flat_name(t).startswith(brute.flat_name(x), k) for k in range(len(t)))) for i, t in enumerate(texts) for x in dictionary if x)
    assert sorted(map(tuple, names.count_names(t, n, most_chars=5).collect())) == [w for w in want if w[2]]


def test_documents_are_classified_where_they_lie(spark):
    d = spark.createDataFrame([(1, "beta", "b", "alpha alpha"), (2, "none", "", "")], "doc_id long, title string, path string, head string")
    got = names.classify(d, spark.createDataFrame([("alpha", None), ("beta", "B"), ("alpha", "A")], "name string, program string"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, "B", 3, False)]
