"""Queries of the remaining operators: chunking, sources of files, review flows, alignment, revisions."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions import chunking, numbers, privacy, segment
from lakeloom.functions import text as tx
from lakeloom.functions.sql import register_sql
from lakeloom.operators import chains, datasets, dedup, evaluation, joins, mining, organisation, retrieval, windows
from lakeloom.plans.q_aggregates import LINES_SQL, lines
from lakeloom.plans.q_datasets import answers
from lakeloom.plans.q_retrieval import LEX_SQL, chunks, questions, ranked, with_chunks
from lakeloom.operators.lineage import cut, dealt, scratch, stored
from lakeloom.plans.registry import Tables, query
from lakeloom.sources import documents as sources
from lakeloom.sources import tables


@query("SELECT n_nationkey, n_name || ' | ' || n_regionkey AS text FROM nation")
def src_csv(t: Tables) -> DataFrame:
    content = F.encode(F.concat(F.lit('"'), "n_name", F.lit('", ,'), F.col("n_regionkey").cast("string"), F.lit("\n")), "UTF-8")
    return t.nation.select("n_nationkey", tables.csv_text(content).alias("text"))


@query()
def src_mht_eml(t: Tables) -> DataFrame:
    mail = F.concat(F.lit("Subject: page\r\nMIME-Version: 1.0\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), "html")
    return t.pages.select("page_id", sources.mail_text(F.encode(mail, "UTF-8")).alias("text"))


@F.pandas_udf(T.BinaryType())
def office_package(name: pd.Series, kind_name: pd.Series, size: pd.Series, kind: pd.Series) -> pd.Series:
    """Files as office programs write them, to read back."""

    def one(n: str, k: str, z: int, which: int) -> bytes:
        p = lambda *runs: "<x:p>" + "".join(f"<x:r><x:t>{r}</x:t></x:r>" for r in runs) + "</x:p>"
        doc = lambda body: f'<?xml version="1.0"?><x:root xmlns:x="urn:x">{body}</x:root>'
        parts = {
            0: {"[Content_Types].xml": "<t/>", "word/document.xml": doc(p(n[:2], n[2:]) + p(" ") + p(k, " &amp; co"))},
            1: {"ppt/slides/slide10.xml": doc(p(str(z))), "ppt/slides/slide2.xml": doc(p(n))},
            2: {"xl/workbook.xml": "<w/>", "xl/sharedStrings.xml": doc(f"<si><t>name</t></si><si><t>size</t></si><si><r><t>{n}</t></r></si>"), "xl/worksheets/sheet1.xml": doc(f'<row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row/><row><c t="s"><v>2</v></c><c/><c><v>{z}</v></c></row>')},
            3: {"mimetype": "application/hwp+zip", "Contents/section0.xml": doc(p(n, " ", k))},
        }.get(which)
        if parts is None:
            return b"PK\x03\x04 broken" if z % 2 else n.encode()
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for path, content in parts.items():
                archive.writestr(path, content)
        return out.getvalue()

    return pd.Series([one(*x) for x in zip(name, kind_name, size, kind, strict=True)])


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || chr(10) || p_type || ' & co' WHEN 1 THEN p_name || chr(10) || p_size WHEN 2 THEN 'name | size' || chr(10) || p_name || ' | ' || p_size WHEN 3 THEN p_name || ' ' || p_type ELSE NULL END AS text FROM part"""
)
def src_office(t: Tables) -> DataFrame:
    """Packages of each kind (document, slides, sheet, Hangul) with a part's words, and files that are none."""
    part = dealt(t.part.select("p_partkey", "p_name", "p_type", "p_size"))
    return part.select("p_partkey", sources.office_text(office_package("p_name", "p_type", "p_size", (F.col("p_partkey") % 5).alias("kind"))).alias("text"))


@query()
def src_dir_listing(t: Tables) -> DataFrame:
    return tables.listing(t.spark, t.sf_dir)


@query()
def txt_chunk(t: Tables) -> DataFrame:
    return chunking.chunk(t.documents)


@query()
def udtf_chunk(t: Tables) -> DataFrame:
    chunking.register(t.spark)
    t.documents.createOrReplaceTempView("_lakeloom_documents")
    return t.spark.sql("SELECT d.doc_id, c.seq, c.heading, c.text FROM _lakeloom_documents d, LATERAL chunk(d.text) c")


@query()
def txt_index_ready(t: Tables) -> DataFrame:
    return chunking.index_ready(chunks(t)).select("doc_id", "chunk_id")


@query("SELECT doc_id, text, len(regexp_extract_all(text, '[éèñü]')) AS accents FROM documents WHERE text IS NOT NULL")
def txt_nfc(t: Tables) -> DataFrame:
    """Texts taken apart into letters and accents, with a NUL behind each, and composed again."""
    apart = F.col("text")
    for whole, parts in (("é", "e\u0301"), ("è", "e\u0300"), ("ñ", "n\u0303"), ("ü", "u\u0308")):
        apart = F.replace(apart, F.lit(whole), F.lit(parts + "\0"))
    d = t.documents.where("text is not null").select("doc_id", tx.nfc(apart).alias("text"))
    return d.select("doc_id", "text", F.regexp_count("text", F.lit("[éèñü]")).cast("long").alias("accents"))


@query(
    rf"""WITH l AS ({LINES_SQL}), h AS (SELECT *, substr(line, 1, 39) AS head FROM l), e AS (SELECT *, length(regexp_extract(head, '(?s)^.*[.?!다]\s')) AS stop, CASE WHEN contains(head, ' ') THEN length(head) - strpos(reverse(head), ' ') ELSE -1 END AS space FROM h)
SELECT doc_id, seq, CASE WHEN length(line) <= 40 THEN line WHEN stop >= 20 THEN regexp_replace(substr(head, 1, stop), '[\s\x0b]+$', '') || '…' WHEN space >= 20 THEN regexp_replace(substr(head, 1, space), '[\s\x0b]+$', '') || '…' ELSE regexp_replace(head, '[\s\x0b]+$', '') || '…' END AS clipped FROM e"""
)
def txt_clip(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "seq", tx.clip("line", F.lit(40)).alias("clipped"))


@query(
    """WITH w AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '부품' WHEN 2 THEN '길' ELSE '나사' END AS word, CASE p_partkey % 2 WHEN 0 THEN '은' ELSE '이' END AS closed, CASE p_partkey % 2 WHEN 0 THEN '는' ELSE '가' END AS open FROM part)
SELECT p_partkey, word || CASE WHEN word = '부품' OR word = '길' OR (word <> '나사' AND substr(word, -1) IN ('0', '1', '3', '6', '7', '8', 'l', 'm', 'n', 'r')) THEN closed ELSE open END AS name,
word || CASE WHEN word = '부품' OR (word NOT IN ('나사', '길') AND substr(word, -1) IN ('0', '1', '3', '6', '7', '8', 'l', 'm', 'n', 'r')) THEN '으로' ELSE '로' END AS by FROM w"""
)
def txt_josa(t: Tables) -> DataFrame:
    word = F.element_at(F.array(F.col("p_name"), F.lit("부품"), F.lit("길"), F.lit("나사")), (F.col("p_partkey") % 4 + 1).cast("int"))
    pair = F.when(F.col("p_partkey") % 2 == 0, "은/는").otherwise("이/가")
    return t.part.select("p_partkey", tx.particle(word, pair).alias("name"), tx.particle(word, F.lit("으로/로")).alias("by"))


@query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '. ' || p_type || '.' WHEN 1 THEN p_type || '? ' || p_name || '! ' || p_size || '.' ELSE p_name || ' ' || p_name END AS text FROM part"""
)
def txt_tidy_reply(t: Tables) -> DataFrame:
    name, kind, size = F.col("p_name"), F.col("p_type"), F.col("p_size").cast("string")
    said = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(name, F.lit(". "), kind, F.lit(".  "), name, F.lit(".")))
        .when(F.col("p_partkey") % 3 == 1, F.concat(kind, F.lit("? "), name, F.lit("!\n"), kind, F.lit("? "), size, F.lit(". "), name, F.lit("!")))
        .otherwise(F.concat(name, F.lit(" "), name))
    )
    return t.part.select("p_partkey", tx.tidy_reply(said).alias("text"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '1. ' || p_name WHEN 1 THEN '12) ' || p_name WHEN 2 THEN p_name WHEN 3 THEN '1. 2. ' || p_name ELSE 'x' || chr(10) || '  3. ' || p_name END AS text FROM part")
def txt_numbering(t: Tables) -> DataFrame:
    heads = F.array(*[F.lit(x) for x in ("1. 1. ", "12)12)  ", "0. ", "1. 2. ", "x\n  3. 3. ")])
    return t.part.select("p_partkey", tx.fix_numbering(F.concat(F.element_at(heads, (F.col("p_size") % 5 + 1).cast("int")), "p_name")).alias("text"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '첨단소재 ' WHEN 1 THEN '첨 단 ' WHEN 2 THEN '첨단 소재 ' WHEN 3 THEN '새첨 단소재 ' ELSE '연구비 a 집행률 ' END || p_name AS text, CASE p_size % 5 WHEN 0 THEN '첨단소재' WHEN 1 THEN '첨단' WHEN 2 THEN '첨단 소재' WHEN 3 THEN '새첨 단소재' ELSE '연구비 a 집행률' END AS known FROM part")
def txt_repair_split(t: Tables) -> DataFrame:
    heads = F.array(*[F.lit(x) for x in ("첨 단 소 재", "첨 단", "첨단 소재", "새첨 단 소 재", "연 구 비 a 집 행 률")])
    head = F.element_at(heads, (F.col("p_size") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", tx.join_split_words(F.concat(head, F.lit(" "), "p_name")).alias("text"), tx.join_split_words(head, F.array(F.lit("첨단"))).alias("known"))


@query("SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN 2 * length(p_name) / (2 * length(p_name) + p_size) WHEN 1 THEN 1.0 ELSE 0.0 END, 9)::DOUBLE AS ratio FROM part")
def txt_seq_ratio(t: Tables) -> DataFrame:
    """Names against themselves with a tail, against themselves, and against signs alone."""
    other = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.repeat(F.lit("#"), F.col("p_size").cast("int")))).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.lit("##"))
    return t.part.select("p_partkey", F.round(tx.sequence_ratio("p_name", other), 9).alias("ratio"))


PAYLOAD = ("""{"n_rows": 2, "n_cols": 2, "cells": [[0, 0, 1, 1, true, "name"], [0, 1, 1, 1, true, "size"], [1, 0, 1, 1, false, \"""", """\"], [1, 1, 1, 1, false, \"""", """\"]]}""")


def _payload() -> F.Column:
    return F.concat(F.lit(PAYLOAD[0]), "p_name", F.lit(PAYLOAD[1]), F.col("p_size").cast("string"), F.lit(PAYLOAD[2]))


@query("SELECT p_partkey, 'name | size' || chr(10) || p_name || ' | ' || p_size AS text FROM part")
def json_table_text(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", chunking.table_text(_payload()).alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Ⅱ. ' || p_name WHEN 1 THEN p_name || ' ' || p_size WHEN 2 THEN NULL WHEN 3 THEN 'IV. ' || p_name ELSE NULL END AS heading FROM part")
def txt_table_heading(t: Tables) -> DataFrame:
    """Band tables of one row, a chapter, two cells, three rows, four cells, and no table at all."""
    cells = lambda *texts: F.array(*[F.array(F.lit("0"), F.lit(str(i)), F.lit("1"), F.lit("1"), F.lit("false"), x) for i, x in enumerate(texts)])
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    table = lambda rows, c: F.to_json(F.struct(F.lit(rows).alias("n_rows"), c.alias("cells")))
    kind = F.col("p_partkey") % 5
    payload = (
        F.when(kind == 0, table(1, cells(F.concat(F.lit("Ⅱ. "), name), size)))
        .when(kind == 1, table(2, cells(name, F.lit(" "), size)))
        .when(kind == 2, table(3, cells(name)))
        .when(kind == 3, table(1, cells(F.concat(F.lit("IV. "), name))))
        .otherwise(F.when(F.col("p_size") < 25, table(1, cells(name, name, name, size))).otherwise(F.lit("no table")))
    )
    return t.part.select("p_partkey", chunking.table_heading(payload).alias("heading"))


@query(
    """SELECT p_partkey, CAST(CAST(p_size AS BIGINT) * CASE p_partkey % 4 WHEN 0 THEN 1000000 WHEN 1 THEN 1000 WHEN 2 THEN 10000 ELSE 1 END AS VARCHAR) AS won FROM part"""
)
def num_scaled(t: Tables) -> DataFrame:
    """Money by a table's head, a unit in brackets, a unit declared above, and a won sign."""
    n = F.col("p_size").cast("string")
    said = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("| 구분 | 금액(백만원) |\n| 장비 | "), n, F.lit(" |")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("장비 "), n, F.lit("(단위: 천원)")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("단위: 만원\n장비 "), n))
        .otherwise(F.concat(F.lit("장비 "), n, F.lit("원")))
    )
    return t.part.select("p_partkey", F.array_join(numbers.scaled_values(said), ",").alias("won"))


@query("SELECT l_orderkey, CAST(len(list_intersect(a, b)) AS INTEGER) AS both_, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS either, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS inside FROM (SELECT l_orderkey, list(DISTINCT l_linenumber) AS a, [1, 2, 3] AS b FROM lineitem GROUP BY 1)")
def arr_set(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("a")).withColumn("b", F.array(F.lit(1), F.lit(2), F.lit(3)))
    return g.select("l_orderkey", F.size(F.array_intersect("a", "b")).alias("both_"), F.size(F.array_union("a", "b")).alias("either"), (F.size(F.array_except("a", "b")) == 0).alias("inside"))


@query(
    """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'KR_NAME' WHEN 1 THEN 'KR_NAME' WHEN 2 THEN 'NONE' WHEN 3 THEN 'KR_STUDENT_ID' WHEN 4 THEN 'KR_BIRTHDATE' WHEN 5 THEN 'EMAIL' WHEN 6 THEN 'NONE' ELSE 'KR_PHONE' END AS entity, CASE WHEN c_custkey % 8 IN (2, 6) THEN 0 ELSE 1 END::BIGINT AS n FROM customer"""
)
def pii_rows(t: Tables) -> DataFrame:
    """Table rows whose label, in the cell before, says what a cell holds; a form's next label is nobody's name."""
    rows = ("성 명 | 홍길동 | 끝", "담당자: 김철수", "성명 | 생년월일 | 비고", "학번 2020123456", "생년월일 | 1990. 1. 2 | 끝", "문의 hong@example.org", "품명 | 의자 | 끝", "전화 010-1234-5678")
    row = F.element_at(F.array(*[F.lit(x) for x in rows]), (F.col("c_custkey") % 8 + 1).cast("int"))
    return privacy.events(t.customer.select("c_custkey", row.alias("text")), "c_custkey")


# --- retrieval -------------------------------------------------------------------------------------------


#: Below this share of a question's weight its evidence is weak.
WEAK_SHARE = 0.6


@query()
def ret_expand_query(t: Tables) -> DataFrame:
    """Benchmark passages, and whole documents (every id divisible by 50), as questions to all lines; searched again with terms of the best lines where these have little of the question."""
    c = chunks(t)
    n = cut(c.agg(F.count(F.lit(1)).alias("n")))
    asked = t.documents.where("doc_id % 50 = 0").select((-1 - F.col("doc_id")).alias("qid"), F.explode(tx.terms(F.col("text"))).alias("term"))
    return retrieval.search_expanding(questions(t).union(asked), stored(retrieval.postings(c)), n, floor=WEAK_SHARE)


@query("WITH f AS (SELECT doc_id, source || lang AS family FROM documents), n AS (SELECT family, max(doc_id) AS current FROM f GROUP BY 1) SELECT doc_id, current, current <> doc_id AS stale FROM f JOIN n USING (family)")
def ret_revisions(t: Tables) -> DataFrame:
    f = t.documents.select("doc_id", F.concat("source", "lang").alias("family"), F.col("doc_id").alias("version"))
    return retrieval.newest_revision(t.documents.select("doc_id"), f).select("doc_id", "current", "stale")


@query(
    """WITH r AS (SELECT DISTINCT l_returnflag AS qid, l_partkey AS doc_id FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.08), p AS (SELECT p_partkey AS src, p_partkey + 1 AS dst, p_retailprice AS weight FROM part), b AS (SELECT * FROM p UNION ALL SELECT dst, src, weight FROM p),
j AS (SELECT r.qid, b.dst AS partner, arg_max(r.doc_id, weight) AS doc_id, max(weight) AS weight FROM r JOIN b ON r.doc_id = b.src WHERE (r.qid, b.dst) NOT IN (SELECT qid, doc_id FROM r) GROUP BY 1, 2)
SELECT qid, doc_id, partner FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, partner) AS k FROM j) WHERE k <= 3"""
)
def ret_cover(t: Tables) -> DataFrame:
    r = t.lineitem.where("l_quantity > 49 and l_discount > 0.08").select(F.col("l_returnflag").alias("qid"), F.col("l_partkey").alias("doc_id")).distinct()
    p = t.part.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"), F.col("p_retailprice").alias("weight"))
    return retrieval.cover_partners(r, p)


@query()
def ret_refs(t: Tables) -> DataFrame:
    c = chunks(t).withColumn("clause", F.regexp_extract("text", r"^(\w+)", 1))
    return retrieval.follow_references(ranked(t).select("qid", "chunk_id", "rank"), c, r"\. (\w+)", "clause").where("rank <= 20")


# --- alignment, entities -----------------------------------------------------------------------------------


def _above(turn: str, low: int) -> Column:
    """Titles of the turns above one, nearest first: turns from low on as a tree in which each has two below it."""
    chain, place = [], F.col(turn) - low
    for _ in range(3):
        place = F.when(place > 0, F.floor((place - 1) / 2))
        chain.append(F.concat(F.lit("part "), place.cast("string")))
    return F.filter(F.array(*chain), lambda c: c.isNotNull())


def _sections(t: Tables, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    c = t.conversations.where(F.col("turn").between(low, high))
    words = c.select(F.col("conv_id").alias("pair"), F.col("turn").alias("path"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)))).alias("word"))
    titles = c.select(F.col("conv_id").alias("pair"), F.col("turn").alias("path"), F.col("role").alias("title_key"), _above("turn", low).alias("ancestors"), F.expr(f"CASE WHEN turn > {low} THEN {low} + (turn - {low} - 1) div 2 END").alias("parent"))
    return words, titles


@query()
def jn_align_content(t: Tables) -> DataFrame:
    return joins.align_by_content(_sections(t, 0, 3)[0], _sections(t, 2, 9)[0])


@query()
def jn_align_context(t: Tables) -> DataFrame:
    (a, ta), (b, tb) = _sections(t, 0, 3), _sections(t, 2, 9)
    return joins.align_by_context(a, b, ta, tb)


@query("SELECT p_name AS name, first_value(p_name) OVER (PARTITION BY split_part(p_name, ' ', 2) ORDER BY p_name) AS card FROM (SELECT DISTINCT p_name FROM part)")
def er_cards(t: Tables) -> DataFrame:
    p = t.part.select("p_name", F.element_at(F.split("p_name", " "), 2).alias("k")).distinct()
    head = p.groupBy("k").agg(F.max("p_name").alias("b"))
    return dedup.name_cards(p.join(head, "k").select(F.col("p_name").alias("a"), "b"))


@query(
    """WITH f AS (SELECT c_custkey, n_name || '/' || c_mktsegment AS path, 'own' AS label FROM customer JOIN nation ON c_nationkey = n_nationkey), r(folder, label) AS (VALUES ('NATION_3', 'three'), ('NATION_3/BUILDING', 'three-b'))
SELECT c_custkey, coalesce((SELECT arg_max(r.label, length(folder)) FROM r WHERE f.path = folder OR starts_with(f.path, folder || '/')), label) AS label FROM f"""
)
def er_inherit(t: Tables) -> DataFrame:
    f = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws("/", "n_name", "c_mktsegment").alias("path"), F.lit("own").alias("label"))
    r = t.spark.sql("SELECT * FROM VALUES ('NATION_3', 'three'), ('NATION_3/BUILDING', 'three-b') AS r(folder, label)")
    return dedup.inherit_label(f, r).select("c_custkey", "label")


@query("WITH m AS (SELECT c_mktsegment AS unit, n_name AS parent, max(n_regionkey) AS depth, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT unit, arg_max(parent, (depth, n, parent)) AS parent FROM m GROUP BY 1")
def hier_assemble(t: Tables) -> DataFrame:
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return dedup.parents_by_mention(j.select(F.col("c_mktsegment").alias("unit"), F.col("n_name").alias("parent"), F.col("n_regionkey").alias("depth")))


def _titled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text")


@query()
def er_mine_programs(t: Tables) -> DataFrame:
    """Names from first lines, borne out by whole texts."""
    d = _titled(t)
    return mining.mine_names(d, d, least_mentions=1.0).withColumn("titles", F.col("titles").cast("long"))


@query()
def er_dept_dictionary(t: Tables) -> DataFrame:
    """Rules written from the tables: regions found nations, nations suppliers with aliases and former names; names change, and some nations claim their region."""
    item = F.concat("s_name", F.when(F.col("s_acctbal") < 0, F.concat(F.lit("(약칭: S"), F.col("s_suppkey").cast("string"), F.lit(")"))).when(F.col("s_acctbal") > 5000, F.concat(F.lit("(구: Old"), F.col("s_suppkey").cast("string"), F.lit(")"))).otherwise(""))
    items = lambda c: F.array_join(F.sort_array(F.collect_list(c)), ", ")
    region = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(items("n_name").alias("i"))
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_name", "r_name").agg(items(item).alias("i"))
    text = F.concat("n_name", F.lit("에는 "), "i", F.lit("를 둔다. "), F.when(F.col("n_nationkey") >= 20, F.concat("n_name", F.lit("에 "), "r_name", F.lit("을 둘 수 있다."))).otherwise(""))
    docs = region.select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat("r_name", F.lit(" 직속으로 "), "i", F.lit("를 둔다.")).alias("text"))
    docs = docs.union(nation.where("i <> ''").select((F.col("n_nationkey") + 1000).cast("long"), text))
    old = F.concat("n_name", F.lit("_before"))
    docs = docs.union(t.nation.select((F.col("n_nationkey") + 2000).cast("long"), F.concat(old, F.lit("에 사업"), "n_nationkey", F.lit("팀을 둔다. "), old, F.lit("을 "), "n_name", F.lit("으로 명칭을 변경한다."))))
    return organisation.unit_dictionary(docs).withColumn("path", F.array_join("path", " > "))


@query()
def er_roles(t: Tables) -> DataFrame:
    """What first lines end in, by words that mostly stand at the back."""
    d = _titled(t)
    return mining.document_roles(d, mining.role_words(mining.frequent_sequences(d, longest=1)))


@query("SELECT key, arg_max(p_name, (n, p_name)) AS name, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lower(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS key, p_name, count(*) AS n FROM part GROUP BY ALL) GROUP BY key")
def er_group_names(t: Tables) -> DataFrame:
    c = t.part.groupBy(F.lower(F.regexp_replace("p_name", "[^A-Za-z]", "")).alias("key"), "p_name").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("key").agg(F.max_by("p_name", F.struct("n", "p_name")).alias("name"), F.sum("n").alias("n"))


# --- training data ---------------------------------------------------------------------------------------------


@query(
    """WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_regionkey <> 2 AS approved FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey <> 7 FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_acctbal > 0 FROM supplier),
u AS (SELECT id, parent, approved AS usable FROM n UNION ALL SELECT u.id, n.parent, u.usable AND n.approved FROM u JOIN n ON u.parent = n.id)
SELECT id, bool_and(usable) AS usable FROM u GROUP BY 1"""
)
def ds_authoring(t: Tables) -> DataFrame:
    n = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), (F.col("r_regionkey") != 2).alias("approved"))
    n = n.union(t.nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_nationkey") != 7))
    n = n.union(t.supplier.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.col("s_acctbal") > 0))
    return datasets.approved_to_the_root(n, 4)


@query(
    """SELECT item_id AS id, CASE item_id % 7 WHEN 0 THEN 'no_candidates' WHEN 1 THEN 'accepted_without_selection' WHEN 2 THEN 'unknown_selection' WHEN 3 THEN 'selected_and_rejected' WHEN 4 THEN 'cross_program_candidate' WHEN 5 THEN 'empty_question,unknown_selection,selected_and_rejected' ELSE '' END AS issues FROM benchmark WHERE trim(text) <> ''"""
)
def ds_cases(t: Tables) -> DataFrame:
    kind = F.col("item_id") % 7
    candidate = lambda program: F.array(F.struct(F.lit("a").alias("node_id"), program.alias("program_id"), F.lit("t").alias("text")))
    ids = lambda *x: F.array(*[F.lit(i) for i in x]).cast("array<string>")
    c = t.benchmark.where("trim(text) <> ''").select(
        F.col("item_id").alias("id"),
        F.when(kind == 5, " ").otherwise(F.col("text")).alias("question"),
        F.lit("p").alias("program_id"),
        F.when(kind == 1, "accept").otherwise("hold").alias("decision"),
        F.when(kind != 0, candidate(F.when(kind == 4, "q").otherwise("p"))).alias("candidates"),
        F.when(kind.isin(2, 5), ids("b")).when(kind == 1, ids()).otherwise(F.when(kind == 3, ids("a"))).alias("selected"),
        F.when(kind.isin(3), ids("a")).when(kind == 5, ids("b")).alias("rejected"),
    )
    return datasets.case_issues(c).select("id", F.array_join("issues", ",").alias("issues"))


@query("SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS decision, 'r' || toxic AS reviewer FROM labels")
def ds_labelstudio(t: Tables) -> DataFrame:
    choice = F.when(F.col("quality") == 1, "accept").otherwise("reject")
    done = F.to_json(F.struct(F.col("doc_id").alias("id"), F.array(F.struct(F.concat(F.lit("r"), "toxic").alias("completed_by"), F.array(F.struct(F.struct(F.array(choice).alias("choices")).alias("value"))).alias("result"))).alias("annotations")))
    return datasets.review_decisions(t.labels.select(done.alias("task")))


@query("SELECT doc_id FROM labels WHERE quality = 1")
def snk_dataset(t: Tables) -> DataFrame:
    tasks = datasets.review_tasks(t.labels.where("quality = 1").withColumnRenamed("doc_id", "row"))
    return tasks.select(F.get_json_object("task", "$.id").cast("long").alias("doc_id"))


@query()
def ev_ngram_recall(t: Tables) -> DataFrame:
    return answers(t).select("conv_id", "turn", evaluation.ngram_recall("hyp", "ref").alias("recall3"))


@query("SELECT p_brand, CAST(count(*) FILTER (p_size >= 10) AS BIGINT) AS filled, count(*) AS cells FROM part GROUP BY 1")
def ev_table_fill(t: Tables) -> DataFrame:
    v = F.when(F.col("p_size") < 10, "확인 필요").otherwise("x")
    return t.part.groupBy("p_brand").agg(F.count_if((F.trim(v) != "") & (v != "확인 필요")).alias("filled"), F.count(F.lit(1)).alias("cells"))


# --- context, ledgers, kinds, indexes -------------------------------------------------------------------------


@query(
    """WITH d AS (SELECT p_partkey, p_size AS n, p_partkey % 6 AS k FROM part)
SELECT p_partkey, CAST(n AS VARCHAR) AS value, '명' AS unit, 6 AS at FROM d WHERE CASE k WHEN 0 THEN n <= 10 WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN n <= 10 ELSE n <= 10 END"""
)
def num_context(t: Tables) -> DataFrame:
    """A draft's count of people against evidence: of another thing, given, of the same thing, with another counter, without a counter, and none."""
    n = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 6
    told = F.when(kind == 0, F.concat(F.lit("팀 "), n, F.lit("명으로"))).when(kind == 1, F.concat(F.lit("팀 "), n, F.lit("명"))).when(kind == 2, F.concat(F.lit("학생 참여자는 "), n, F.lit("명"))).when(kind == 3, F.concat(F.lit("참여 "), n, F.lit("개 기관"))).when(kind == 4, F.concat(F.lit("참여 "), n, F.lit(" 안내"))).otherwise("없음")
    drafts = t.part.select("p_partkey", F.concat(F.lit("참여 인원 "), n, F.lit("명")).alias("draft"))
    return numbers.out_of_context(drafts, t.part.select("p_partkey", told.alias("text"), (kind == 1).alias("given")), "p_partkey")


@query(
    """WITH c AS (SELECT p_partkey AS card, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_partkey ELSE '' END AS name, 'a' || p_partkey AS acronym, 2000 + p_size AS s, 2010 + p_size AS e FROM part),
l AS (SELECT s_suppkey AS entry, (SELECT name FROM c WHERE card = s_suppkey) AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'A' || (s_suppkey + 1) ELSE 'none' END AS acronym, 2020 + s_nationkey AS s, CASE WHEN s_suppkey % 2 = 0 THEN 2022 + s_nationkey END AS e FROM supplier),
k AS (SELECT entry, CASE WHEN lower(regexp_replace(l.name, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(c.name, '[^A-Za-z0-9]', '', 'g')) THEN 1 ELSE 2 END AS grade, card FROM l JOIN c ON (lower(regexp_replace(l.name, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(c.name, '[^A-Za-z0-9]', '', 'g')) OR upper(l.acronym) = upper(c.acronym)) AND l.s <= c.e AND c.s <= coalesce(l.e, 9999)),
g AS (SELECT entry, grade, min(card) AS a, max(card) AS b FROM k GROUP BY 1, 2), m AS (SELECT entry, min(grade) AS grade FROM g GROUP BY 1)
SELECT entry, CASE WHEN a = b THEN a END AS card, CASE WHEN a <> b THEN 'ambiguous' WHEN grade = 1 THEN 'name' ELSE 'acronym' END AS by FROM g JOIN m USING (entry, grade)"""
)
def jn_ledger_program(t: Tables) -> DataFrame:
    """Half of the cards have names of their own, the others share theirs; some entries know an acronym."""
    key = F.col("p_partkey").cast("string")
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), key)).otherwise(""))
    cards = t.part.select(F.col("p_partkey").alias("card"), name.alias("name"), F.concat(F.lit("a"), key).alias("acronym"), (2000 + F.col("p_size")).alias("start"), (2010 + F.col("p_size")).alias("end"))
    year, entry = 2020 + F.col("s_nationkey"), F.col("s_suppkey")
    named = t.supplier.join(cards.select(F.col("card").alias("s_suppkey"), F.upper("name").alias("name")), "s_suppkey", "left")
    ledger = named.select(
        entry.alias("entry"), F.concat(F.lit("2) "), "name").alias("name"), F.when(entry % 3 == 0, F.concat(F.lit("A"), (entry + 1).cast("string"))).otherwise("none").alias("acronym"), year.alias("start"), F.when(entry % 2 == 0, year + 2).alias("end")
    )
    return joins.match_ledger(ledger, cards)


_KIND_SQL = r"""t AS (SELECT DISTINCT doc_id, lang AS kind, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents), n AS (SELECT kind, count(DISTINCT doc_id) AS n FROM t GROUP BY 1), p AS (SELECT term, kind, count(*) AS df FROM t GROUP BY 1, 2), s AS (SELECT term, count(*) AS kinds FROM p GROUP BY 1),
w AS (SELECT term, kind, df / n * (ln((1 + (SELECT count(*) FROM n)) / (1 + kinds)) + 1) AS weight FROM p JOIN n USING (kind) JOIN s USING (term))"""


def _kind_terms(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("lang").alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("term"))


@query(f"WITH {_KIND_SQL}, x AS (SELECT t.doc_id, w.kind, round(sum(weight), 9) AS score FROM t JOIN w USING (term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER v AS r, coalesce(lead(score) OVER v, 0) AS second FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY score DESC, kind)) SELECT doc_id, kind, round(score, 6) AS score, score >= 1.2 * second AS sure FROM r WHERE r = 1")
def txt_kind_weights(t: Tables) -> DataFrame:
    """The kind (here: language) of each document by the weights of its terms, and whether it leads clearly."""
    terms = _kind_terms(t)
    return datasets.guess_kind(terms, datasets.kind_weights(terms)).withColumn("score", F.round("score", 6))


@query(f"WITH {LEX_SQL} SELECT qid, chunk_id, rare_hits, round(score, 6) AS score, matched, rank FROM lex")
def ret_lexical_indexed(t: Tables) -> DataFrame:
    """An index of half the lines, some of them with other texts, brought up to date and searched."""
    index = retrieval.LexicalIndex(t.spark, scratch(t.spark, "lexical"))
    c = chunks(t).select("chunk_id", "text")
    first = c.where("chunk_id % 2 = 0").withColumn("text", F.when(F.col("chunk_id") % 3 == 0, F.lit("worthless words that are gone later")).otherwise(F.col("text"))).union(c.limit(1).select(F.lit(-1).cast("long"), F.lit("a line that goes")))
    index.update(first, 0)
    index.update(c, 1)
    return index.search(questions(t), 1).select("qid", "chunk_id", "rare_hits", F.round("score", 6).alias("score"), "matched", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH RECURSIVE c AS (SELECT p_partkey AS root, p_partkey AS id FROM part WHERE p_size > 40 UNION SELECT root, id // 2 FROM c WHERE id > 1), t AS (SELECT root, sum(p_size) AS s FROM c JOIN part ON p_partkey = id GROUP BY 1) SELECT root, id FROM c JOIN t USING (root) WHERE s <= 260"""
)
def ret_pack_closure(t: Tables) -> DataFrame:
    """Parts that need the part of half their number, and so on; a part comes with all it needs or not at all."""
    needs = t.part.where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"))
    sizes = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return retrieval.pack_closure(t.part.where("p_size > 40").select(F.col("p_partkey").alias("root")), needs, sizes, 260)


@query(
    """WITH s AS (SELECT q.vec_id AS criterion, v.label AS document, max(c) AS top, avg(c) AS mean, count(*) AS n FROM (SELECT q.vec_id, v.label, v.vec_id AS p, list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE)) AS c FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, embeddings v) x JOIN (SELECT vec_id FROM embeddings) q ON q.vec_id = x.vec_id JOIN (SELECT DISTINCT label FROM embeddings) v ON v.label = x.label GROUP BY 1, 2)
SELECT criterion, document, round(top, 6) AS top, top >= 0.4 AND top - mean >= 0.1 AND n >= 4 AS covered FROM s"""
)
def num_coverage_meaning(t: Tables) -> DataFrame:
    criteria = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("criterion"), "embedding")
    paragraphs = t.embeddings.select(F.col("vec_id").alias("paragraph"), F.col("label").alias("document"), "embedding")
    return retrieval.covered_by_meaning(criteria, paragraphs, "criterion", "paragraph", "document", "embedding").withColumn("top", F.round("top", 6))


_STYLE_SQL = r"""SELECT conv_id, turn, len(regexp_extract_all(text, '[^\s\x0b]+')) AS words, length(regexp_replace(text, '[\s\x0b]', '', 'g')) AS letters, len(list_filter(string_split(regexp_replace(text, '([.?!])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS sentences, len(list_filter(string_split(regexp_replace(text, '([.?!])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\?[\s\x0b]*$'))) AS asks,
len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND regexp_matches(x, '^[\s\x0b]*(?:[-*•]|\d{1,2}[.)])[\s\x0b]'))) AS listed, len(regexp_extract_all(text, '[0-9]')) AS digits FROM conversations"""


@query(
    f"""WITH s AS ({_STYLE_SQL}), f AS (SELECT conv_id, turn, words / greatest(sentences, 1) AS a, letters / greatest(words, 1) AS b, listed / greatest(lines, 1) AS c, digits / greatest(letters, 1) AS d, asks / greatest(sentences, 1) AS e FROM s)
SELECT conv_id, round(((CASE WHEN greatest(x.a, y.a) > 0 THEN abs(x.a - y.a) / greatest(x.a, y.a) ELSE 0 END) + (CASE WHEN greatest(x.b, y.b) > 0 THEN abs(x.b - y.b) / greatest(x.b, y.b) ELSE 0 END) + (CASE WHEN greatest(x.c, y.c) > 0 THEN abs(x.c - y.c) / greatest(x.c, y.c) ELSE 0 END) + (CASE WHEN greatest(x.d, y.d) > 0 THEN abs(x.d - y.d) / greatest(x.d, y.d) ELSE 0 END) + (CASE WHEN greatest(x.e, y.e) > 0 THEN abs(x.e - y.e) / greatest(x.e, y.e) ELSE 0 END)) / 5, 6) AS gap
FROM f x JOIN f y USING (conv_id) WHERE x.turn = 0 AND y.turn = 1"""
)
def ev_style(t: Tables) -> DataFrame:
    """How differently the first two turns of a conversation are written."""
    c = t.conversations
    j = c.where("turn = 0").select("conv_id", F.col("text").alias("a")).join(c.where("turn = 1").select("conv_id", F.col("text").alias("b")), "conv_id")
    return j.select("conv_id", F.round(evaluation.style_gap(F.col("a"), F.col("b")), 6).alias("gap"))


@query()
def txt_respace(t: Tables) -> DataFrame:
    """All texts without their spaces, and how many of these come back where they were."""
    costs = segment.word_costs(t.documents)
    restored = segment.respace(F.replace("text", F.lit(" "), F.lit("")), costs)
    return t.documents.select("doc_id", restored.alias("restored"), "text").select("doc_id", F.md5("restored").alias("digest"), segment.spaces_restored(F.col("text"), F.col("restored")).alias("s")).select("doc_id", "digest", "s.*")


@query(f"WITH {LEX_SQL}, x AS (SELECT qid, l.chunk_id, rank AS old, round((length(c.text) % 97) / 97, 6) AS score FROM lex l JOIN c USING (chunk_id)) SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, old, chunk_id) AS rank FROM x")
def udf_callable(t: Tables) -> DataFrame:
    """A function of (questions, texts) as the reranker, run in Arrow batches."""

    def judge(question: pd.Series, text: pd.Series) -> pd.Series:
        return (text.str.len() % 97) / 97

    r = with_chunks(t, ranked(t)).drop("seq", "doc_id").join(t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question")), "qid")
    return retrieval.rerank(r, judge).select("qid", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT event_id, user_id, event_type FROM events")
def src_gz_json(t: Tables) -> DataFrame:
    """Events as compressed JSON lines, some of them broken, read back."""
    folder = scratch(t.spark, "json")
    t.events.select("event_id", "user_id", "event_type").write.option("compression", "gzip").json(folder)
    t.spark.createDataFrame([("{broken",), ("",), ("not json",)], "value string").coalesce(1).write.mode("append").option("compression", "gzip").text(folder)
    return tables.json_lines(t.spark, folder, "event_id long, user_id long, event_type string")



def _written_sql(text: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({text}, '[0-9][0-9,]*(?:\\.[0-9]+)?%?'), lambda x: replace(x, ',', '')))"


def _missing_sql(answer: str, question: str) -> str:
    facts = f"list_filter({_written_sql(answer)}, lambda x: NOT regexp_full_match(x, '[0-9]{{1,2}}(?:\\.[0-9]{{1,2}}){{1,3}}') AND (length(regexp_replace(x, '[^0-9]', '', 'g')) >= 3 OR contains(x, '.') OR contains(x, '%')))"
    return f"array_to_string(list_sort(list_filter({facts}, lambda y: NOT list_contains({_written_sql(question)}, y))), ' ')"


@query(
    f"""WITH f AS (SELECT o_custkey AS pair, '1. ' || substr(o_orderpriority, 3) AS heading, min(o_orderkey) AS k, count(*) AS n, max(o_totalprice) AS price FROM orders GROUP BY 1, 2), g AS (SELECT pair, heading, 'order ' || k || CASE WHEN n > 2 THEN ' of 3,500.75' ELSE '' END AS guide, n FROM f),
h AS (SELECT pair, substr(heading, 4) AS title, 'placed ' || k || ' at 3500.75 or ' || n || '% and 1.2 on 12' AS body FROM f WHERE n <> 2)
SELECT g.pair, g.heading, g.heading || chr(10) || guide AS human, body AS output, {_missing_sql("body", "g.heading || chr(10) || guide")} AS missing FROM g JOIN h ON g.pair = h.pair AND substr(g.heading, 4) = h.title"""
)
def ds_form_pairs(t: Tables) -> DataFrame:
    """A customer's orders by priority as a form and its finished version, which lacks some sections and has others twice."""
    f = t.orders.groupBy(F.col("o_custkey").alias("pair"), F.concat(F.lit("1. "), F.substring("o_orderpriority", 3, 99)).alias("heading")).agg(F.min("o_orderkey").cast("string").alias("k"), F.count(F.lit(1)).alias("n"))
    forms = f.select("pair", "heading", F.concat(F.lit("order "), "k", F.when(F.col("n") > 2, " of 3,500.75").otherwise("")).alias("guide"), F.lit(None).cast("string").alias("facts"))
    done = f.select("pair", F.substring("heading", 4, 99).alias("heading"), "n", F.concat(F.lit("placed "), "k", F.lit(" at 3500.75 or "), F.col("n").cast("string"), F.lit("% and 1.2 on 12")).alias("body"))
    finals = done.where("n <> 2").select("pair", "heading", "body").union(done.where("n = 2").select("pair", "heading", "body")).union(done.where("n = 2").select("pair", F.concat(F.lit("9) "), "heading"), F.lit("again")))
    return datasets.form_pairs(forms, finals).withColumn("missing", F.array_join("missing", " "))


@query(
    f"""WITH h AS (SELECT n_regionkey AS doc_id, n_nationkey * 100000 AS seq, [r_name, n_name] AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey, -1, [r_name] FROM region UNION ALL SELECT n_regionkey, n_nationkey * 100000 + s_suppkey, [r_name, n_name, s_name || CASE WHEN s_acctbal > 5000 THEN ' ' || s_suppkey || '%' ELSE '' END] FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT doc_id, list_slice(path, 1, len(path) - 1) AS path, string_agg('- ' || path[-1], chr(10) ORDER BY seq) AS answer FROM h WHERE len(path) > 1 GROUP BY 1, 2), j AS (SELECT h.doc_id, h.seq, '범위: ' || array_to_string(h.path, ' → ') || chr(10) || '[질문] 이 절의 소제목을 차례대로 적어 줘.' AS human, answer FROM h JOIN c ON h.doc_id = c.doc_id AND h.path = c.path)
SELECT doc_id, seq, human, answer, {_missing_sql("answer", "human")} AS missing FROM j"""
)
def ds_outline_steps(t: Tables) -> DataFrame:
    """Regions as documents, nations and suppliers as sections."""
    name = F.concat("s_name", F.when(F.col("s_acctbal") > 5000, F.concat(F.lit(" "), F.col("s_suppkey").cast("string"), F.lit("%"))).otherwise(""))
    seq = F.col("n_nationkey").cast("long") * 100000
    # Sections stand by nation, then supplier: seq alone mixes nations where keys pass 100,000.
    first = F.lit(-1).cast("long")
    lines_ = t.region.select(F.col("r_regionkey").alias("doc_id"), first.alias("seq"), F.lit(1).alias("level"), F.col("r_name").alias("title"), first.alias("nation"), first.alias("supplier"))
    nation = F.col("n_nationkey").cast("long")
    lines_ = lines_.union(t.nation.select("n_regionkey", seq, F.lit(2), "n_name", nation, first))
    lines_ = lines_.union(t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", seq + F.col("s_suppkey"), F.lit(3), name, nation, "s_suppkey"))
    return datasets.outline_steps(windows.breadcrumbs(lines_, order=["nation", "supplier"], deepest=3)).withColumn("missing", F.array_join("missing", " "))


@query()
def ds_tree_chains(t: Tables) -> DataFrame:
    """Lines of documents as a tree in which each line has up to three below it: steps down all levels."""
    l = lines(t).withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("seq")) - 1)
    words = F.filter(F.split("line", " "), lambda w: F.length(w) > 0)
    rest = F.array_join(F.slice(words, F.lit(4), F.greatest(F.size(words) - 3, F.lit(0))), " ")
    s = l.select("doc_id", F.col("n").alias("path"), F.expr("CASE WHEN n > 0 THEN (n - 1) div 3 END").cast("int").alias("parent"), F.col("n").alias("seq"), F.array_join(F.slice(words, 1, 3), " ").alias("heading"), rest.alias("text"))
    steps = chains.tree_steps(s)
    return steps.select("doc_id", "path", "level", "kind", F.array_join("node_path", " > ").alias("node_path"), F.md5("answer").alias("digest"), F.size("evidence").alias("evidence"), F.array_join("unsupported", ",").alias("unsupported"))


@query(
    r"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(CASE WHEN strpos(substr(event_type, 2), 'i') > 0 THEN strpos(substr(event_type, 2), 'i') + 1 ELSE 0 END AS INTEGER) AS at,
upper(regexp_replace(event_type || ' . ' || user_id, '[ \t\n.]+', '', 'g')) AS name, round(CASE WHEN value > 0 THEN user_id / value ELSE 0 END, 6)::DOUBLE AS share FROM events"""
)
def udf_sql(t: Tables) -> DataFrame:
    """A SQL text with functions that are registered in SQL, over all events."""
    register_sql(t.spark)
    return t.spark.sql(
        "SELECT event_id, cast(json_extract(props, '$.k') AS INT) AS k, instr_from(event_type, 'i', 2) AS at, flat_name(event_type || ' . ' || user_id) AS name, round(share_of(user_id, value), 6) AS share FROM {events}", events=t.events
    )
