"""Numbering over all rows, current versions, and the dictionary of units, by cases."""

from __future__ import annotations

import random

import brute
from pyspark.sql import functions as F

from lakeloom.operators import organisation, ranking, windows
from lakeloom.sources import sinks


def test_number_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(20), rng.choice(["a", "b", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, n int, k string").repartition(6)
    got = {r.id: r.place for r in windows.number_rows(df, [F.desc("n"), F.col("id")], "place").collect()}
    assert got == {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    turns = {r.id: r.turn for r in windows.round_robin(df.where("k is not null"), "k", [F.col("id")]).collect()}
    by = {k: [r[0] for r in rows if r[2] == k] for k in "ab"}
    want = [x for i in range(500) for k in "ab" for x in by[k][i : i + 1]]
    assert turns == {x: i for i, x in enumerate(want, 1)}
    ranked = windows.number_rows(df.select("id", "k"), [F.col("id")], "rank")
    moved = {r.id: r["rank"] for r in ranking.promote(ranked, F.col("k") == "b", "rank").collect()}
    order = [r[0] for r in rows if r[2] == "b"] + [r[0] for r in rows if r[2] != "b"]
    assert moved == {x: i for i, x in enumerate(order, 1)}
    assert windows.number_rows(df.where("false"), [F.col("id")], "place").collect() == []


def current(versions):
    """The rule, version by version; rows (version, latest, trusted, dates, grams)."""
    vs = sorted(versions, key=lambda v: (v[1] is not None, v[1] or "", v[0]), reverse=True)
    at = len(vs) - 1
    for i, v in enumerate(vs):
        older = vs[i + 1 :]
        if v[2] or not older:
            at = i
            break
        a = next((o for o in older if o[2]), older[0])
        g, h = set(v[4] or ()), set(a[4] or ())
        if (v[1] or "") > (a[1] or "") and set(a[3] or ()) <= set(v[3] or ()) and len(g & h) / max(1, min(len(g), len(h))) >= 0.3:
            at = i
            break
    return {v[0]: "unsure" if i < at else "current" if i == at else "old" for i, v in enumerate(vs)}


def test_current_versions(spark):
    rng = random.Random(2)
    rows = []
    for family in range(60):
        for v in range(rng.randrange(1, 7)):
            dates = [d for d in "abcd" if rng.random() < 0.4 + 0.1 * v]
            rows.append((family, v, rng.choice(["2020", "2021", "2022", "2023", None]), rng.choice([True, False, False, None]), rng.choice([dates, None]), rng.choice([[rng.randrange(9) for _ in range(6)], []])))
    df = spark.createDataFrame(rows, "family int, version int, latest string, trusted boolean, dates array<string>, grams array<long>")
    got = {(r.family, r.version): r.status for r in windows.current_versions(df).collect()}
    want = {(f, v): s for f in range(60) for v, s in current([r[1:] for r in rows if r[0] == f]).items()}
    assert got == want and set(want.values()) == {"current", "old", "unsure"}


def test_unit_dictionary(spark):
    docs = [
        (1, "총장 직속으로 기획처, 교무처(약칭: 교무) 및 산학협력단(구: 산학처)을 둔다. 기획처에는 예산팀 또는 평가실을 두며, 예산팀을 재정팀으로 변경한다."),
        (2, "기획처에 예산팀을 둔다.\n재정팀에 결산과를 둘 수 있다."),
        (3, "가부에 나부를 둔다. 나부에 다부를 둔다. 다부에 가부를 둔다. 총장에 다부를 둔다."),
        (4, "다부에 가부를 둔다. 갑실을 을실로 변경한다. 을실을 갑실로 개칭한다. 갑실에 병센터를 둔다."),
        (5, None), (6, ""), (7, "가부에 가부를 둔다."),
    ]
    rng = random.Random(3)
    for i in range(8, 40):
        docs.append((i, f"단위{rng.randrange(9)}에 단위{rng.randrange(9)}, 단위{rng.randrange(9)}을 둔다. 단위{rng.randrange(30, 36)}을 단위{rng.randrange(30, 36)}으로 변경한다."))
    got = organisation.unit_dictionary(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    plain = lambda rows: sorted((r["unit"], r["kind"], r["parent"], r["path"], tuple(r["aliases"]), tuple(r["former"]), r["votes"]) for r in rows)
    assert plain([r.asDict() | {"path": " > ".join(r.path)} for r in got]) == plain(brute.organised(docs))
    unit = {r.unit: r for r in got}
    assert unit["재정팀"].path == ["총장", "기획처", "재정팀"] and unit["재정팀"].former == ["예산팀"] and unit["재정팀"].votes == 2
    assert unit["교무처"].kind == "처·국" and unit["산학협력단"].former == ["산학처"] and unit["병센터"].parent == "갑실"
    assert len(got) == len(unit)


def test_bundles_are_held_against_their_manifest(spark, tmp_path):
    files = spark.createDataFrame([("a", b"one"), ("b", b""), ("c", b"\x00\xff"), ("d", b"four")], "path string, content binary")
    folder = str(tmp_path / "bundle")
    sinks.export_bundle(files, folder)
    assert {r.path: r.state for r in sinks.check_bundle(spark, folder).collect()} == dict.fromkeys("abcd", "intact")
    spark.createDataFrame([("a", b"one"), ("b", b"!"), ("d", b"four"), ("e", b"new")], "path string, content binary").write.mode("overwrite").parquet(f"{folder}/artefacts")
    assert {r.path: r.state for r in sinks.check_bundle(spark, folder).collect()} == {"a": "intact", "b": "changed", "c": "missing", "d": "intact", "e": "unlisted"}


def test_exports_come_back_as_they_were(spark, tmp_path):
    rows = [(1, "en", 'a "quoted", text\nof two lines', None), (2, "de", "", 1.5), (3, "en", None, -2.0)]
    df = spark.createDataFrame(rows, "id long, lang string, text string, x double")
    folder = str(tmp_path / "export")
    told = sinks.export_json(df, folder, "rows", "lang")
    assert {(r.split, r.rows) for r in told.collect()} == {("en", 2), ("de", 1)}
    assert sorted(map(tuple, sinks.read_export(spark, folder, "rows").select("id", "lang", "text", "x").collect())) == rows
    numbers = spark.createDataFrame([(i % 7, i, f"{i},5") for i in range(50)], "a int, b int, c string")
    sinks.export_csv(numbers, str(tmp_path / "csv"), ["a", "b"])
    back = sinks.read_csv(spark, str(tmp_path / "csv"), "a int, b int, c string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, numbers.collect()))
