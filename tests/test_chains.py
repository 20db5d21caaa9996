"""Steps down trees of sections."""

from __future__ import annotations

import random

import brute
from lakeloom.operators import chains, graph_build, organisation

SECTIONS = "doc_id int, path string, parent string, seq int, heading string, text string"


def rows(df):
    return sorted((r.doc_id, r.path, r.level, r.kind, " > ".join(r.node_path), len(r.evidence), ",".join(r.unsupported)) for r in df.collect())


def plain(sections):
    names = [c.split()[0] for c in SECTIONS.split(", ")]
    return sorted((r["doc_id"], r["path"], r["level"], r["kind"], r["node_path"], r["evidence"], r["unsupported"]) for r in brute.chained([dict(zip(names, s, strict=True)) for s in sections]))


def test_chain_over_levels(spark):
    sections = [
        (1, "a", None, 0, "Plan 2020", "We need 12 rooms."), (1, "a1", "a", 1, "Rooms", "There are 12 rooms.\nThey cost 3,400 each."), (1, "a2", "a", 2, "Cost", "In all 40,800. It is 2020."), (1, "a11", "a1", 3, "Sizes", "12 and 3400 again. 7 are new!"),
        (1, "x", "y", 4, "Lost", "1"), (1, "y", "x", 5, "Circle", None), (1, "z", "none", 6, "Top", None), (2, "a", None, 0, None, None),
    ]
    steps = chains.tree_steps(spark.createDataFrame(sections, SECTIONS))
    got = rows(steps)
    assert got == plain(sections)
    assert [(r[1], r[2], r[6]) for r in got] == [("a", 0, "40800"), ("a1", 1, ""), ("a11", 2, ""), ("a2", 1, "")]
    turns = {r.doc_id: [x.gpt for x in r.turns] for r in chains.sound_chains(steps).collect()}
    assert turns == {1: ["- Sizes: 12 and 3400 again.", "1) In all 40,800.\n2) It is 2020.", "1) 12 and 3400 again.\n2) 7 are new!"]}


def test_random_trees(spark):
    rng = random.Random(1)
    sections = []
    for doc in range(4):
        for i in range(25):
            text = " ".join(rng.choice(["one", "12", "3,000", "end.", "4.5", "go!", "\n"]) for _ in range(rng.randrange(7)))
            sections.append((doc, f"p{i:02}", f"p{rng.randrange(i):02}" if i and rng.random() < 0.9 else None, rng.randrange(5), rng.choice(["Part 1", "Aims", None]), text or None))
    assert rows(chains.tree_steps(spark.createDataFrame(sections, SECTIONS).repartition(3))) == plain(sections)
    assert chains.tree_steps(spark.createDataFrame([], SECTIONS)).collect() == []


def test_levels_are_stored_as_compressed_columns(spark):
    """Checkpoints held every row whole and uncompressed, the answer too."""
    rows = [("d", i, None if i == 0 else (i - 1) // 3, i, f"h{i}", f"First thing of {i}. Second thing of {i}.") for i in range(14)]
    steps = chains.tree_steps(spark.createDataFrame(rows, "doc_id string, path int, parent int, seq int, heading string, text string"))
    plan = steps._jdf.queryExecution().executedPlan().toString()
    assert steps.count() == 14 and "FileScan parquet" in plan and "ExistingRDD" not in plan
    assert steps.where("path = 13").first().answer == "1) First thing of 13.\n2) Second thing of 13."


def test_facts_and_edges_of_a_graph_are_stored_as_compressed_columns(spark):
    docs = spark.createDataFrame([("d1", "p", 2020, "plan", "c"), ("d2", "p", None, "plan", "c")], "doc string, program string, year int, kind string, code string")
    empty = {"sections": "doc string, path string, title string", "mentions": "doc string, program string", "measures": "doc string, indicator string, value string", "ledger": "doc string, program string, family string, successor string, into string"}
    built = graph_build.build({"docs": docs} | {name: spark.createDataFrame([], schema) for name, schema in empty.items()})
    assert {(r.src, r.dst) for r in built.edges.collect()} == {("p", "year:p:2020"), ("year:p:2020", "d1"), ("p", "d2")}
    for df in (built.edges, built.seen):
        assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()


def test_units_above_nobody_take_no_part_in_the_rounds(spark, monkeypatch):
    votes = [(f"leaf{i}", p, v, 1) for i in range(50) for p, v in (("a", 2), ("b", 1))] + [("a", "b", 3, 1), ("b", "a", 1, 1), ("b", "top", 1, 0)]
    seen, ends = [], organisation._ends
    monkeypatch.setattr(organisation, "_ends", lambda step: seen.append(step.count()) or ends(step))
    got = {r.unit: (r.parent, r.votes) for r in organisation.forest(spark.createDataFrame(votes, "unit string, parent string, votes long, latest long")).collect()}
    assert got == {f"leaf{i}": ("a", 2) for i in range(50)} | {"a": ("b", 3), "b": ("top", 1)}
    assert seen and max(seen) == 2
