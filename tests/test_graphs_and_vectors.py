"""Closures, graph builds by steps and the vector index, by cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import graph, graph_build, retrieval, vector_index


def reached(links, root):
    out, level, depth = {root: 0}, [root], 0
    while level:
        depth += 1
        level = sorted({b for a in level for x, b in links if x == a and b not in out})
        out |= dict.fromkeys(level, depth)
    return {(root, i, d) for i, d in out.items()}


CHAIN = [(f"c{i}", f"c{i + 1}") for i in range(200)]
LADDER = [(f"l{i}{a}", f"l{i + 1}{b}") for i in range(30) for a in "xy" for b in "xy"]
CYCLE = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "a"), ("d", "e"), ("a", "e")]


@pytest.mark.parametrize(("links", "roots"), [(CHAIN, ["c0", "c150"]), (LADDER, ["l0x", "l7y"]), (CYCLE, ["a", "c", "e", "nowhere"])])
def test_descendants(spark, links, roots):
    edges = spark.createDataFrame([*links, links[0], (None, "a"), ("a", None)], "src string, dst string").withColumn("depth", F.lit("clash"))
    got = graph.descendants(edges, spark.createDataFrame([(r,) for r in [*roots, roots[0], None]], "id string"))
    assert sorted(map(tuple, got.collect())) == sorted(x for r in roots for x in reached(links, r))


def test_closure_of_a_long_chain_is_packed_whole(spark):
    needs = spark.createDataFrame([(i, i + 1) for i in range(60)], "src int, dst int")
    sizes = spark.createDataFrame([(i, 1) for i in range(61)], "id int, size int")
    roots = spark.createDataFrame([(0,), (20,)], "root int")
    assert sorted(map(tuple, retrieval.pack_closure(roots, needs, sizes, 60).collect())) == [(20, i) for i in range(20, 61)]


FACTS = {
    "docs": "doc string, program string, year int, kind string, code string",
    "sections": "doc string, path string, title string",
    "mentions": "doc string, program string",
    "measures": "doc string, indicator string, value string",
    "ledger": "doc string, program string, family string, successor string, into string",
}
ROWS = {
    "docs": [("p1", "A", 2020, "plan", "x"), ("r1", "A", 2020, "report", "x"), ("e1", "A", 2020, "evaluation", "x"), ("p2", "A", 2022, "plan", "x"), ("p3", "B", 2020, "plan", None), ("u", "B", None, "other", None), ("n", None, 2020, "plan", "x")],
    "sections": [("p1", "1", "aims"), ("p1", "1", "aims"), ("p1", "2", "cost"), ("r1", "1", "aims"), ("p2", "7", "aims"), ("p2", "8", None), ("p3", "1", "aims"), ("n", "1", "aims")],
    "mentions": [("p1", "B"), ("r1", "B"), ("e1", "B"), ("p2", "A"), ("p3", "A")],
    "measures": [("r1", "visits", "12"), ("p3", "visits", "3")],
    "ledger": [("L1", "A", "g", "B", None), ("L2", "B", "g", None, "C")],
}


def facts(spark, rows):
    return {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in FACTS.items()}


def edge_rows(built):
    return sorted((r.src, r.dst, r.kind, r.basis, tuple(r.evidence), r.weight) for r in built.graph().collect())


def test_every_kind_of_edge(spark):
    got = graph_build.build(facts(spark, ROWS)).graph().collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r.kind, set()).add((r.src, r.dst))
        assert r.evidence and all(r.evidence)
    assert set(kinds) == {"contains", "plans_reports", "evaluates", "continues", "instance_of", "has_indicator", "measures", "succeeded_by", "integrated_into", "related"}
    assert kinds["plans_reports"] == {("p1", "r1"), ("p1:sec:1", "r1:sec:1")}
    assert kinds["evaluates"] == {("e1", "p1"), ("e1", "r1")}
    assert kinds["continues"] == {("p1:sec:1", "p2:sec:7")}
    assert kinds["instance_of"] == {("p1:sec:1", "unit:A:aims"), ("r1:sec:1", "unit:A:aims"), ("p2:sec:7", "unit:A:aims")}
    assert kinds["has_indicator"] == {("A", "ind:A:visits"), ("B", "ind:B:visits")}
    assert kinds["measures"] == {("r1", "ind:A:visits"), ("p3", "ind:B:visits")}
    assert kinds["succeeded_by"] == {("A", "B")} and kinds["integrated_into"] == {("B", "C")}
    assert kinds["related"] == {("A", "B")}
    assert {("group:g", "A"), ("A", "year:A:2020"), ("year:A:2020", "p1"), ("B", "u"), ("p1", "p1:sec:2"), ("n", "n:sec:1"), ("A", "unit:A:aims")} <= kinds["contains"]


def test_builds_by_steps_equal_one_build(spark):
    changes = [
        {**ROWS, "docs": ROWS["docs"][:3], "sections": ROWS["sections"][:4], "mentions": [], "measures": [], "ledger": []},
        {**ROWS, "docs": [*ROWS["docs"][1:], ("p1", "B", 2020, "plan", "x")], "sections": [*ROWS["sections"], ("u", "1", "cost")]},
        {**ROWS, "ledger": [("L1", "A", "h", None, None)]},
        {**ROWS, "docs": [d for d in ROWS["docs"] if d[0] != "r1"]},
        {},
        ROWS,
    ]
    built = graph_build.build(facts(spark, changes[0]))
    for rows in changes[1:]:
        built = graph_build.update(built, facts(spark, rows))
        assert edge_rows(built) == edge_rows(graph_build.build(facts(spark, rows)))


def test_only_scopes_of_changed_documents_are_built_again(spark):
    built = graph_build.build(facts(spark, ROWS))
    same = graph_build.update(built, facts(spark, {k: list(reversed(v)) for k, v in ROWS.items()}))
    assert {r.version for r in same.edges.collect()} == {0}
    changed = graph_build.update(built, facts(spark, {**ROWS, "measures": [("r1", "visits", "13"), ("p3", "visits", "3")]}))
    again = {(r.rule, r.scope) for r in changed.edges.where("version = 1").collect()}
    assert ("measured", "r1") in again and ("indicator", "A") in again
    assert not any(scope.startswith(("B", "p3", "p1\x1f")) or scope in ("p1", "L1") for _, scope in again)
    assert "12" not in repr(edge_rows(changed)) and "13" in repr(edge_rows(changed))


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def clustered(n, seed=1, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, round(n**0.5) // 2), width))
    return unit(centres[rng.integers(len(centres), size=n)] + 0.3 * rng.normal(size=(n, width)))


def vectors(spark, x, labels=10):
    return spark.createDataFrame([(i, v.tolist(), i % labels) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")


def recall(found, x, queries, allowed, k=10):
    hits = wanted = 0
    for q in queries:
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        best = [i for i in np.argsort(-s, kind="stable") if allowed(i)][:k]
        hits, wanted = hits + len(set(best) & {r.vec_id for r in found if r.qid == q}), wanted + len(best)
    return hits / wanted


def test_vector_index(spark, tmp_path):
    x = clustered(3000)
    df = vectors(spark, x)
    index = vector_index.VectorIndex(spark, str(tmp_path / "i")).build(df, ["label"])
    assert spark.read.parquet(str(tmp_path / "i/lists")).count() == 3000
    asked = list(range(0, 3000, 100))
    q = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    found = index.search(q).collect()
    assert recall(found, x, asked, lambda i: True) >= 0.9
    # Of some 55 lists few are visited.
    assert sum({r.qid: r.lists for r in found}.values()) / len(asked) < 25
    # Few rows pass the filter: searches widen until they have ten, or have seen everything.
    few = index.search(q, where=F.col("label") == 3).collect()
    assert recall(few, x, asked, lambda i: i % 10 == 3) >= 0.9 and all(r.vec_id % 10 == 3 for r in few)
    rare = index.search(q, where=F.col("vec_id") < 4).collect()
    assert len(rare) == 4 * len(asked) and {r.lists for r in rare} == {len(index._about()[1])}


def test_work_of_a_search_grows_less_than_the_rows(spark, tmp_path):
    seen = []
    for n in (500, 8000):
        x = clustered(n, 2)
        index = vector_index.VectorIndex(spark, str(tmp_path / str(n))).build(vectors(spark, x))
        lists = index.search(vectors(spark, x).where("vec_id < 20").select(F.col("vec_id").alias("qid"), "embedding")).select("qid", "lists").distinct().agg(F.avg("lists")).first()[0]
        seen.append(lists * n / len(index._about()[1]))
    assert seen[1] < 8 * seen[0]


def test_vector_index_edges(spark, tmp_path):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    index = vector_index.VectorIndex(spark, str(tmp_path / "odd")).build(df)
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None), (9, [1.0])], "qid long, embedding array<float>")
    assert sorted((r.qid, r.rank, r.vec_id, r.score) for r in index.search(q, 5).collect()) == [(7, 1, 1, 1.0), (7, 2, 2, 1.0), (7, 3, 2, 0.0)]
    empty = vector_index.VectorIndex(spark, str(tmp_path / "none")).build(df.where("vec_id < 0"))
    assert empty.search(q, 5).collect() == []
