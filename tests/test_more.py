from __future__ import annotations

import math
import random

from conftest import rows
from pyspark.sql import functions as F

from lakeloom.functions import chunking
from lakeloom.operators import aggregates, datasets, dedup, evaluation, joins, ranking, retrieval


def test_chunks_cover_the_text():
    rng = random.Random(1)
    for _ in range(30):
        text = "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 120))) + "." for _ in range(rng.randrange(1, 30)))
        parts = chunking.chunk_text(text)
        assert "".join("".join(parts).split()) == "".join(text.split())
        assert all(0 < len(p) <= chunking.CAP for p in parts)


def test_articles_are_the_units():
    text = "\n".join(f"제{i}조(목적) 이 규정은 학사 운영에 필요한 사항을 정함을 목적으로 하며 세부 사항은 총장이 따로 정한다." for i in range(1, 5))
    assert [p[:3] for p in chunking.chunk_text(text)] == ["제1조", "제2조", "제3조", "제4조"]
    assert chunking.chunk_text(None) == [] and chunking.chunk_text(" \n ") == []
    assert chunking.chunk_text("x" * 5000) == ["x" * 1400, "x" * 800]  # equal pieces once, the shorter rest


def test_thin_chunks_merge():
    long_ = "a" * 50
    assert chunking.merge_thin(["ab", long_, "cd"]) == [f"ab\n{long_}\ncd"]
    assert chunking.merge_thin(["ab"]) == ["ab"]


def test_sections_pass_their_heading_on():
    item = "신청 자격과 절차를 적은 항목으로 해마다 같은 내용이며 담당 부서가 확인하고 학기 초에 다시 알린다"
    bullets = [f"○ {i}번 {item}" for i in range(40)]
    table = ["구분 | 기한 | 기한 | 방법"] + [f"{i}차 | {i}월 | {i}월 | 누리집에서 서식 {i}을 내려받아 담당 부서로 낸다 | " for i in range(40)]
    question = ["4월에 낸 신청서를 고칠 수 있나요?", "기한 안이면 고칠 수 있으며 담당 부서에 먼저 알린 뒤 새 서식으로 다시 내야 한다."]
    text = "\n".join(["머리말 없이 시작하는 안내문으로서 이 문서가 무엇을 위한 것인지 길게 설명하고 있는 첫 문단이다", "1. 신청 방법", *bullets, "2. 제출 기한", *table, *question])
    got = chunking.chunks_in(text)
    assert list(dict.fromkeys(c.heading for c in got)) == ["", "1. 신청 방법", "2. 제출 기한"]
    first = [c.text for c in got if c.heading == "1. 신청 방법"]
    assert len(first) > 1 and first[0].startswith("1. 신청 방법 ○ 0번") and all(p.startswith("○") for p in first[1:])  # items stay whole
    rows_ = [r for c in got if " | " in c.text for r in c.text.split("\n") if " | " in r]
    assert rows_ == ["구분 | 기한 | 방법"] + [f"{i}차 | {i}월 | 누리집에서 서식 {i}을 내려받아 담당 부서로 낸다" for i in range(40)]  # rows stay whole
    assert got[-1] == chunking.Chunk("2. 제출 기한", " ".join(question))  # question and answer together


def test_thin_headings_stay_with_what_follows():
    body = "이 절은 운영 방침을 정하며 자세한 사항은 따로 둔 지침에서 정하고 해마다 고쳐 다시 알리도록 하며 모든 부서가 따른다"
    got = chunking.chunks_in(f"Ⅰ. 개요\n1. 목적\n{body}\n□ 방침을 정한다\n{body} 둘째")
    assert [c.heading for c in got] == ["Ⅰ. 개요", "Ⅰ. 개요"]  # a sentence is no heading; "1. 목적" comes before there is any substance
    assert got[0].text.startswith("Ⅰ. 개요 1. 목적")


def test_long_lines_are_cut_in_linear_time():
    import time

    start = time.monotonic()
    assert sum(map(len, chunking.split_long("ab" * 4_000_000))) == 8_000_000
    parts = chunking.chunk_text(" ".join(f"word{i}" for i in range(400_000)))
    assert sum(len(p.split()) for p in parts) == 400_000 and time.monotonic() - start < 20


def test_weak_questions_are_searched_again(spark):
    """A line that has much of the question but neither of its two most telling words is found by words of the lines that have one."""
    import brute

    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(["north", "south", "east", "west", "road", "river"]) + str(rng.randrange(60)) for _ in range(6)) for i in range(300)}
    telling = {1000: "zzqfirst budget8 ledger audit", 1001: "zzqfirst ledger audit travel9", 1002: "wwksecond ledger audit refund7"}
    telling |= {1100 + i: f"{w} apart{i}" for i, w in enumerate(["zzqfirst", "wwksecond"] * 6)}
    answer = {1003: "budget8 travel9 refund7 grant6 ledger audit"}
    common = {2000 + i: f"{w} filler{i}" for i, w in enumerate(["budget8", "travel9", "refund7", "grant6"] * 10)}
    chunks = texts | telling | answer | common
    asked = {1: "zzqfirst wwksecond budget8 travel9 refund7 grant6", 2: texts[7], 3: "nothing here"}
    index = retrieval.postings(spark.createDataFrame(list(chunks.items()), "chunk_id long, text string"))
    q = spark.createDataFrame([(k, w) for k, v in asked.items() for w in v.split()], "qid long, term string")
    n = spark.createDataFrame([(len(chunks),)], "n long")
    expected = brute.expanded_search({k: set(v.split()) for k, v in asked.items()}, {k: set(v.split()) for k, v in chunks.items()}, 0.6)
    got = retrieval.search_expanding(q, index, n, floor=0.6)
    shape = lambda rs: sorted((r["qid"], r["chunk_id"], round(r["score"], 6), r["rank"], r["weak"], r["expanded"]) for r in rs)
    assert shape(r.asDict() for r in got.collect()) == shape(expected)
    assert [(r["chunk_id"], r["expanded"]) for r in got.where("qid = 1").collect()] == [(1003, True)] and got.where("qid = 2 and not expanded and not weak").count()
    proposed = spark.createDataFrame([(1, "ledger"), (1, "audit")], "qid long, term string")
    told = retrieval.search_expanding(q, index, n, proposed, 0.6)
    assert shape(r.asDict() for r in told.collect()) == shape(expected)
    none = retrieval.search_expanding(q.where("false"), index, n)
    assert none.isEmpty()


def test_intake_audit_names_what_is_wrong(spark):
    good = "A sound line of plain prose that says enough to stand for itself in any search."
    docs = {1: [good] * 4, 2: ["", "  ", None], 3: ["short one here only"] * 5, 4: [good] * 2 + ["漢字" * 40], 5: [good] * 12, 6: [f"{good} {good}"] * 3 + ["- 3 -"] * 3}
    rows_ = [(d, c, "Ⅰ. 개요" if d == 1 else None) for d, cs in docs.items() for c in cs]
    df = spark.createDataFrame(rows_, "doc_id int, text string, heading string")
    got = {r.doc_id: (r.issues, r.severity) for r in datasets.ingest_audit(df, heading="heading").collect()}
    assert got == {2: (["no text"], 3), 3: (["fragmented", "noisy"], 2), 4: (["damaged"], 2), 5: (["no headings"], 1), 6: (["noisy"], 1)}, got
    assert 5 not in {r.doc_id for r in datasets.ingest_audit(df).collect()}
    assert datasets.ingest_audit(df.where("false")).isEmpty()


def test_numbers_need_their_label_near(spark):
    text = "세미나에는 61명이 왔다. " + "그 밖의 내용 " * 10 + "교육을 이수한 학생은 42명 이다. 합계 42명"
    cases = [("교육 이수 인원", "61명", False), ("교육 이수 인원", "42 명", True), ("금액", "61명", True), ("교육 이수", "완료", True), (None, "61명", True), ("교육 이수", "99명", False), ("교육 이수", None, True)]
    df = spark.createDataFrame([(i, a, b, text) for i, (a, b, _) in enumerate(cases)], "i int, item string, value string, text string")
    got = dict(rows(df.select("i", datasets.label_near(F.col("item"), F.col("value"), F.col("text")).alias("near"))))
    assert got == {i: c[2] for i, c in enumerate(cases)}
    facts = df.withColumn("quote", F.col("text"))
    assert {r.i for r in datasets.supported_facts(facts, item="item").collect()} == {1, 2, 4}


def test_cards_join_chains(spark):
    pairs = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [("x", "y")], "a string, b string")
    got = dict(rows(dedup.name_cards(pairs)))
    assert {got[f"n{i:02d}"] for i in range(21)} == {"n00"} and got["y"] == "x"


def test_weighted_overlap(spark):
    a = [(1, p, w) for p, ws in ((1, "red blue"), (2, "green")) for w in ws.split()]
    b = [(1, p, w) for p, ws in ((7, "red green"), (8, "green")) for w in ws.split()]
    df = lambda x: spark.createDataFrame(x, "pair long, path long, word string")
    idf = lambda c: math.log(5 / (c + 0.5))
    got = {(r.a_path, r.b_path): round(r.body, 6) for r in joins.weighted_overlap(df(a), df(b)).collect()}
    red, blue, green = idf(2), idf(1), idf(3)
    assert got == {(1, 7): round(red / (red + blue + green), 6), (2, 7): round(green / (red + green), 6), (2, 8): 1.0}
    assert rows(joins.align_by_content(df(a), df(b)), "a_path", "b_path") in ([(1, 7), (2, 8)], [(2, 8)])


def test_weak_evidence_is_replaced(spark):
    s = "qid long, chunk_id long, score double, weak boolean"
    first = spark.createDataFrame([(1, 1, 0.1, True), (2, 2, 0.9, False), (3, 3, 0.2, True)], s)
    second = spark.createDataFrame([(1, 5, 0.5, False), (2, 6, 1.0, False), (3, 7, 0.1, True)], s)
    assert rows(retrieval.expand_weak(first, second), "qid", "chunk_id") == [(1, 5), (2, 2), (3, 3)]


def test_prune_keeps_one(spark):
    s = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.5, 2), (1, 3, 0.1, 3), (2, 4, 0.1, 1), (2, 5, 0.05, 2)], "qid long, chunk_id long, score double, rank int")
    assert rows(retrieval.prune(s), "qid", "chunk_id", "weak") == [(1, 1, False), (1, 2, False), (2, 4, True)]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (2, 21, 2)], "qid long, item long, rank int")
    gold = spark.createDataFrame([(1, 11), (2, 99), (3, 1)], "qid long, item long")
    m = evaluation.retrieval_metrics(ranked, gold, gold.select("qid"), (1, 2)).first()
    assert (m.n, m.mrr, m.recall_1, round(m.recall_2, 6)) == (3, 0.5 / 3, 0.0, round(1 / 3, 6))
    assert round(m.ndcg_2, 6) == round(1 / math.log2(3) / 3, 6)


def test_fact_units(spark):
    f = spark.createDataFrame([("g", 38.0, "명", "d", 1), ("g", 38.0, "명", "d", 1), ("g", 4.0, "명", "d", 2), ("g", 2.0, "개", "d", 3), ("h", 5.0, "건", "e", 1)], "g string, v double, u string, doc string, line int")
    got = {r.g0: (r.unit, float(r.total), r.n, r.off_unit, r.share) for r in aggregates.fact_aggregate(f, [F.col("g")], F.col("v"), F.col("u"), ["doc", "line"]).collect()}
    assert got == {"g": ("명", 42.0, 2, 1, 89.4), "h": ("건", 5.0, 1, 0, 10.6)}


def test_bootstrap_and_sampling(spark):
    r = spark.range(400).select(F.lit("a").alias("k"), F.col("id"), (F.col("id") % 2).alias("v"))
    b = aggregates.bootstrap(r, "k", "v", reps=300).first()
    assert b.mean == 0.5 and 0.42 < b.low < 0.5 < b.high < 0.58
    one, two = (rows(ranking.stable_sample(r.repartition(n), [F.col("id")], "s", 20), "id") for n in (1, 7))
    assert one == two and len(one) == 20


def test_pending_cells(spark):
    c = spark.createDataFrame([("r", "c", "3"), ("r", "c", "확인 필요"), ("r", "d", "확인 필요"), ("s", "c", "1"), ("s", "c", "2"), ("s", "c", "확인 필요")], "row_label string, col_label string, value string")
    assert sorted(r.filled for r in datasets.fill_pending(c).collect()) == ["1", "2", "3", "3", "확인 필요", "확인 필요"]
