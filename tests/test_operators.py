from __future__ import annotations

import pytest

import itertools
import random

from conftest import rows
from pyspark.sql import functions as F

from lakeloom.operators import access, datasets, dedup, graph, joins, retrieval, similarity, windows
from lakeloom.sources import sinks, tables
from lakeloom.streaming import batch, events


def test_access_matrix(spark):
    """Every document against every viewer, by the rules written out."""
    docs = list(itertools.product(["a", "b", "공통", None], ["public", "dept", "owner", None], ["u", "v", None], ["regulation", "plan"], ["student", None]))
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "id int, dept string, access_level string, owner string, doc_type string, audience string")

    def sees(v, dept, level, owner, kind, audience):
        level, dept = level or "public", dept or "공통"
        if v.role == "dev":
            return True
        if v.role == "student":
            return level == "public" and kind == "regulation" and audience == "student"
        return level == "public" or (v.user and owner == v.user) or (level == "dept" and dept in ("공통", v.dept, *v.also, *v.lent))

    for v in (access.Viewer("dev"), access.Viewer("student", "a"), access.Viewer("staff", "a", "u"), access.Viewer("staff", "a", None, also=("b",)), access.Viewer("head", None, "v", lent=("b",)), access.Viewer("", None)):
        want = [i for i, d in enumerate(docs) if sees(v, *d)]
        assert sorted(r.id for r in df.where(access.visible(v)).collect()) == want


def test_jaccard_join_is_exact(spark):
    rng = random.Random(3)
    sets = {i: {rng.randrange(30) for _ in range(rng.randrange(1, 12))} for i in range(60)}
    df = spark.createDataFrame([(i, str(x)) for i, s in sets.items() for x in s], "item long, term string")
    for t in (0.3, 0.6, 0.9):
        want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        assert {(r.a, r.b) for r in similarity.jaccard_join(df, "item", "term", t).collect()} == want


def test_contains_join(spark):
    rng = random.Random(5)
    bodies = ["".join(rng.choice("ab ") for _ in range(80)) for _ in range(30)]
    needles = [b[10 : 10 + rng.randrange(6, 20)] for b in bodies[:20]]
    n = spark.createDataFrame(list(enumerate(needles)), "n long, needle string")
    b = spark.createDataFrame(list(enumerate(bodies)), "b long, body string")
    want = {(i, j) for i, x in enumerate(needles) for j, y in enumerate(bodies) if len(x) >= 8 and x in y}
    for most in (similarity.NEEDLE_CHARS, 0):
        assert {(r.n, r.b) for r in similarity.contains_join(n, b, "n", "needle", "b", "body", most_chars=most).collect()} == want


def test_following(spark):
    chunks = spark.createDataFrame([(d, s) for d in (1, 2) for s in range(20)], "doc_id long, seq long")
    hits = spark.createDataFrame([(1, 3), (2, 18)], "doc_id long, seq long")
    assert rows(joins.following(hits, chunks)) == sorted([(1, 3, k) for k in range(4, 10)] + [(2, 18, 19)], key=repr)


def test_diff_listings(spark):
    s = "rel string, size long, mtime long, kind string"
    old = spark.createDataFrame([("a/x", 1, 1, "p"), ("a/y", 2, 2, "p"), ("a/z", 3, 3, "p"), ("a/w", 4, 4, "p"), ("a/v", 5, 5, "p")], s)
    new = spark.createDataFrame([("a/x", 1, 1, "p"), ("b/y", 2, 2, "p"), ("a/z", 9, 3, "p"), ("a/w", 4, 4, "q"), ("n", 7, 7, "p")], s)
    assert rows(joins.diff_listings(old, new, ["kind"])) == sorted([("b/y", "moved", "a/y"), ("a/z", "changed", None), ("a/w", "reclassified", None), ("n", "added", None), ("a/v", "removed", None)], key=repr)


def test_breadcrumbs(spark):
    c = spark.createDataFrame([(1, 0, 1, 1, "I"), (1, 0, 2, 2, "1"), (1, 0, 3, None, "t"), (1, 0, 4, 2, "2"), (1, 0, 5, 3, "2.1"), (1, 0, 6, 1, "II"), (1, 0, 7, None, "u")], "doc_id long, page int, seq int, level int, title string")
    got = {r.seq: r.path for r in windows.breadcrumbs(c).collect()}
    assert got == {1: ["I"], 2: ["I", "1"], 3: ["I", "1"], 4: ["I", "2"], 5: ["I", "2", "2.1"], 6: ["II"], 7: ["II"]}


def test_greedy_first_representative(spark):
    """A chain a-b-c: b falls to a, c stays, as in a sequential pass."""
    n = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "a long, b long")
    assert rows(dedup.greedy(n, "id", pairs, [F.col("id")])) == [(1, None), (2, 1), (3, None), (4, 3), (5, None)]


def test_greedy_decides_long_chains(spark):
    n = spark.range(1, 109)
    pairs = n.where("id < 108").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = rows(dedup.greedy(n, "id", pairs.union(pairs.select("b", "a")).union(pairs.select("a", "a")), [F.col("id")]))
    assert got == sorted(((i, None if i % 2 else i - 1) for i in range(1, 109)), key=repr)


def test_greedy_cover_equals_the_sequential_rule(spark):
    for seed in range(4):
        rng = random.Random(seed)
        n = 60
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(110)} | {(i, i + 1) for i in range(12)}
        place = {i: rng.randrange(8) for i in range(n)}
        near = lambda a, b: (min(a, b), max(a, b)) in pairs
        kept, want = [], {}
        for i in sorted(range(n), key=lambda i: (place[i], i)):
            want[i] = next((k for k in kept if near(k, i)), None)
            kept += [i] if want[i] is None else []
        items = spark.createDataFrame(list(place.items()), "item long, place int")
        got = dedup.greedy(items, "item", spark.createDataFrame(list(pairs), "a long, b long"), [F.col("place")])
        assert dict(rows(got)) == want


def test_document_groups_equal_comparing_all_sketches(spark, monkeypatch):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (40, 90, 145, 150, 400, 400, 900)]
    texts = []
    for i in range(160):
        t = list(base[rng.randrange(len(base))])
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            t[rng.randrange(len(t))] = "z"
        texts.append("".join(t)[: rng.choice([None, None, 139, 145])])
    texts += [None, "", "  ", "x"]
    sketch = {i: sorted(dedup._shingle_hashes(t).tolist())[:128] for i, t in enumerate(texts) if t and t.strip()}

    def near(a, b):
        k = min(len(a), len(b))
        union = sorted(set(a) | set(b))[:k]
        return len(set(union) & set(a) & set(b)) / k >= 0.6

    kept, want = [], {i: i for i in range(len(texts))}
    for i in sorted(sketch):
        want[i] = next((k for k in kept if near(sketch[k], sketch[i])), i)
        kept += [i] if want[i] == i else []
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(dedup, "COMMON_SHARE", 2.0)
    assert dict(rows(dedup.document_groups(df.repartition(3)))) == want
    monkeypatch.setattr(dedup, "HAND_OUT", -1)
    assert dict(rows(dedup.document_groups(df.repartition(2)))) == want


def test_document_groups_leave_shared_forms_out(spark):
    rng = random.Random(3)
    letters = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    form, own = letters(600), [letters(150) for _ in range(7)]
    texts = [(i, form + own[i]) for i in range(6)] + [(6, form + own[0][:145]), (7, own[6]), (8, own[6][:140]), (9, form), (10, form[:590]), (11, ""), (12, None)]
    got = dict(rows(dedup.document_groups(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))))
    assert got == {i: i for i in range(13)} | {6: 0, 8: 7, 10: 9}


def test_near_chunks(spark):
    base = "".join(chr(97 + i % 23) for i in range(60))
    c = spark.createDataFrame([(1, 1, base), (1, 2, base[:30]), (1, 3, base.upper()), (2, 4, base), (1, 5, base + " ")], "doc_id long, chunk_id long, text string")
    got = {r.chunk_id: r.duplicate for r in dedup.near_chunks(c).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True}


def test_variants(spark):
    n = spark.createDataFrame([("o", "한국장학재단", 9), ("o", "기한국장학재단", 1), ("o", "한국장학재딘", 2), ("o", "국가장학", 3), ("p", "한국장학재단", 1)], "kind string, name string, n long")
    got = {(r.kind, r.name): r.canonical for r in dedup.merge_variants(n).collect()}
    assert got[("o", "기한국장학재단")] == got[("o", "한국장학재딘")] == "한국장학재단"
    assert got[("o", "국가장학")] == "국가장학" and got[("p", "한국장학재단")] == "한국장학재단"


def test_audit_pairs(spark):
    review = ("accept", "r", {k: True for k in datasets.REVIEW_CHECKS})
    say = lambda *x: [("human" if i % 2 == 0 else "gpt", v) for i, v in enumerate(x)]
    good = ("p", ["a"], review, say("자료: 예산 300만", "예산은 300만"), [(1, 1, "예산 300만", 0, "p")])
    invented = ("p", ["a"], review, say("자료: 예산 300만", "예산은 400만"), [(1, 1, "예산 300만", 0, "p")])
    hidden = ("p", ["a"], review, say("자료", "답이다"), [(1, 1, "예산", 0, "p")])
    cross = ("p", ["a"], review, say("자료: 예산", "답이다"), [(1, 1, "예산", 0, "q")])
    bare = (None, [], None, say("x"), None)
    s = "program_id string, node_path array<string>, review struct<decision:string,reviewer:string,checks:map<string,boolean>>, conversations array<struct<from:string,value:string>>, evidence array<struct<doc_id:long,chunk_id:long,text:string,turn:int,program_id:string>>"
    got = [r.issues for r in datasets.audit_pairs(spark.createDataFrame([good, invented, hidden, cross, bare], s)).collect()]
    assert got[0] == []
    assert got[1] == ["unsupported_number"]
    assert got[2] == ["answer_without_evidence", "evidence_not_visible"]
    assert got[3] == ["answer_without_evidence", "cross_program_evidence"]
    assert got[4] == ["invalid_conversation", "missing_node_path", "missing_program_id", "review_incomplete"]


def test_graph_rules(spark):
    e = spark.createDataFrame([("a", "b", "k", "구조", ["x" * 300], 1.0), ("a", "b", "k", "구조", ["y"], 2.0), ("a", "c", "k", "guess", ["x"], 1.0), ("a", "d", "k", "구조", [], 1.0)], "src string, dst string, kind string, basis string, evidence array<string>, weight double")
    assert rows(graph.valid_edges(e), "src", "dst", "weight") == [("a", "b", 2.0)]
    assert rows(graph.rejected_edges(e), "dst", "why") == [("c", "unknown basis"), ("d", "no evidence")]
    assert graph.fingerprint(e).collect() == graph.fingerprint(e.repartition(3)).collect()


def test_lexical_without_evidence(spark):
    """A question whose telling terms occur nowhere finds nothing, however common its other words are."""
    index = spark.createDataFrame([("common", i) for i in range(300)] + [("other", i) for i in range(300)] + [("rare", 7)], "term string, chunk_id long")
    q = spark.createDataFrame([(1, "common"), (1, "absent"), (1, "missing"), (2, "common"), (2, "rare")], "qid long, term string")
    assert rows(retrieval.lexical(q, index, 300), "qid", "chunk_id") == [(2, 7)]


def test_upsert(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "x"), (3, "y")], "k long, v string")
    assert rows(sinks.upsert(a, b, ["k"])) == [(1, "a"), (2, "x"), (3, "y")]
    assert rows(sinks.upsert(a, b, ["k"], update=False)) == [(1, "a"), (2, "b"), (3, "y")]
    assert sinks.table_digest(a).first() == sinks.table_digest(a.orderBy(F.desc("k"))).first()
    assert sinks.table_digest(a).first().digest != sinks.table_digest(a.withColumn("k", F.col("k").cast("string"))).first().digest


def test_files(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/a.csv").write_bytes("이름, 값\n, 3\n".encode("cp949"))
    (tmp_path / "csv/b.csv").write_bytes(b"x,y\n")
    assert sorted(r.text for r in tables.csv_files(spark, str(tmp_path / "csv")).collect()) == ["x | y", "이름 | 값\n3"]
    (tmp_path / "l.jsonl").write_text('{"a": 1, "t": "2024-01-01"}\nbroken\n{"a": 2, "t": "2024-02-01"}\n')
    assert [r.a for r in tables.json_lines(spark, str(tmp_path / "l.jsonl"), "a long, t string", "t", "2024-01-15").collect()] == [2]
    base = str(tmp_path / "vectors")
    tables.write_version(spark.range(3), base, 1)
    tables.write_version(spark.range(5), base, 2)
    assert tables.read_version(spark, base).count() == 5 and tables.read_version(spark, base, 1).count() == 3
    told = sinks.export_json(spark.range(4).withColumn("split", F.lit("train")), str(tmp_path / "out"), "x", "split")
    assert told.first().rows == 4 and spark.read.json(str(tmp_path / "out/x")).count() == 4
    assert {r.rel for r in tables.listing(spark, str(tmp_path / "csv")).collect()} == {"a.csv", "b.csv"}


def test_lease_steps():
    ask = lambda held, user, at: events.lease_step(held, {"field": "f", "user": user, "at": at})
    assert ask(None, "a", 10) == ([("f", 10, "a", "acquire", 310)], ("a", 10, 310))
    assert ask(("a", 10, 310), "a", 100) == ([("f", 100, "a", "extend", 400)], ("a", 10, 400))
    assert ask(("a", 10, 310), "b", 20) == ([("f", 20, "b", "wait", 130)], ("a", 10, 130))
    rows_, held = events.fold("f", ("a", 10, 130), [{"field": "f", "user": "b", "at": 131.0}], 132, events.lease_step, events.lease_deadline, events.lease_ends)
    assert [r[3] for r in rows_] == ["expire", "acquire"] and held == ("b", 131, 431)
    assert events.fold("f", held, [], 500, events.lease_step, events.lease_deadline, events.lease_ends) == ([("f", 431, "b", "expire", 431)], None)


@pytest.mark.parametrize("rule", ["leases", "versions", "write_backs"])
def test_stream_equals_batch(spark, tmp_path, rule):
    """Rows late and out of order, cut into files at random: the stream says what the batch twin says, timers included."""
    import random

    rng = random.Random(3)
    at = [1_700_000_000 + x for x in sorted(rng.sample(range(4000), 120))]
    e = [(rng.choice("abc"), rng.choice("uvw"), float(x), n, rng.randrange(0, 9), rng.choice("xyz")) for n, x in enumerate(at)]
    schema = "field string, user string, at double, seq long, base int, text string"
    end = [("end", "z", at[-1] + 9000.0, 1000, 0, "x")]
    late = sorted(e, key=lambda r: r[2] + rng.random() * 200)  # up to 200 seconds out of order
    for n, part in enumerate([late[:40], late[40:90], late[90:], end]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={n}"))
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = getattr(events, rule)(stream.drop("part"), "5 minutes").writeStream.format("memory").queryName(f"{rule}_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = getattr(batch, rule)(spark.createDataFrame(e, schema))
    assert rows(spark.table(f"{rule}_out").where("field <> 'end'")) == rows(want) and want.count() > 20


def test_stream_operations_and_windows(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(i, "c", i % 5, t0 + dt.timedelta(hours=i)) for i in range(60)], "event_id long, client string, seq long, ts timestamp")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = lambda: events.event_stream(spark, str(tmp_path / "in"), e.schema)
    for name, df, n in (("ops", events.first_of_operation(s(), ["client", "seq"], late="100 hours"), 5), ("days", events.tumbling_counts(s(), ["client"]), 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == n


def test_sieve_lets_every_asked_hash_through(spark):
    import numpy as np
    from lakeloom.operators import similarity

    asked = np.r_[similarity.rolling_hashes("every gram of this text is asked for", 8), [0, -1, (1 << 20) - 1, 1 << 20, -(1 << 63), (1 << 63) - 1]]
    bits = np.unpackbits(np.frombuffer(similarity.sieve(spark.createDataFrame([(int(x),) for x in asked], "h long")), np.uint8), bitorder="little")
    low = asked.astype(np.int64) & (similarity.SIEVE_BITS - 1)
    assert bits[low].all() and bits.sum() == len(set(low.tolist()))
    r = spark.createDataFrame([("every gram of this text is asked for",), (None,), ("no",)], "t string").select(similarity.sifted_hashes(F.col("t"), 8, similarity.sieve(spark.createDataFrame([(int(asked[3]),)], "h long"))).alias("s")).select("s.*").collect()
    assert [x.n for x in r] == [29, 0, 0] and list(r[0].h) == [int(asked[3])] and not r[1].h


def test_a_fold_gets_its_keys_one_after_the_other_in_sorted_tasks(spark):
    values = [(k, i, None if i == 3 else i * 10, f"t{i}") for k in [*range(300), None] for i in (4, 1, 3, 2)] + [(1000, i, i, "x") for i in range(5000)]
    df = spark.createDataFrame(values, "k long, at long, size long, t string")
    seen = windows.grouped_fold(df, "k", ["size"], "k long, n int, first long, last long, t string", lambda rows: [(rows[0]["k"], len(rows), rows[0]["at"], rows[-1]["at"], rows[0]["t"])])
    got = {r.k: tuple(r)[1:] for r in seen.collect()}
    assert got == {k: (4, 1, 3, "t1") for k in [*range(300), None]} | {1000: (5000, 0, 4999, "x")}
    assert "MapInArrow" in seen._jdf.queryExecution().executedPlan().toString()
