"""Retrieval and graph queries. Benchmark passages are the questions, lines of documents the chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators import graph, graph_build, joins, names, retrieval, shapes, similarity, windows
from lakeloom.operators.aggregates import dot
from lakeloom.operators.lineage import cut, handed
from lakeloom.plans.q_aggregates import LINES_SQL, chunk_id, lines, lines_of
from lakeloom.plans.registry import Tables, query


def chunks(t: Tables) -> DataFrame:
    return lines(t).select(chunk_id().alias("chunk_id"), "doc_id", "seq", F.col("line").alias("text"))


def questions(t: Tables) -> DataFrame:
    from lakeloom.functions.text import terms

    return t.benchmark.select(F.col("item_id").alias("qid"), F.explode(terms(F.col("text"))).alias("term"))


def ranked(t: Tables) -> DataFrame:
    """The ranking, stored: it has at most TOP rows a question, and most queries ask for it more than once."""
    c = chunks(t)
    return cut(retrieval.lexical(questions(t), retrieval.postings(c), c.agg(F.count(F.lit(1)).alias("n"))))


def with_chunks(t: Tables, hits: DataFrame) -> DataFrame:
    """Hits (chunk_id) with doc_id, seq and text of their lines: only documents that hold one are split, where they lie."""
    hits = handed(hits)
    held = handed(hits.select(F.shiftright("chunk_id", 24).alias("doc_id")).distinct())
    found = lines_of(t.documents.join(held, "doc_id", "left_semi"))
    return hits.join(found.select(chunk_id().alias("chunk_id"), "doc_id", "seq", F.col("line").alias("text")), "chunk_id")


TERM = "list_distinct(regexp_extract_all(lower(text), '[가-힣a-z0-9]{2,}'))"
LEX_SQL = f"""c AS (SELECT doc_id * 16777216 + seq AS chunk_id, doc_id, seq, line AS text FROM ({LINES_SQL})), i AS (SELECT chunk_id, unnest({TERM}) AS term FROM c), n AS (SELECT count(*) AS n FROM c),
q0 AS (SELECT item_id AS qid, unnest({TERM}) AS term FROM benchmark), d AS (SELECT term, count(*) AS df FROM i WHERE term IN (SELECT term FROM q0) GROUP BY 1),
q1 AS (SELECT qid, q0.term, coalesce(df, 0) AS df, ln(1 + n / (1 + coalesce(df, 0))) AS idf, n, count(*) OVER (PARTITION BY qid) AS size FROM q0 LEFT JOIN d ON q0.term = d.term, n),
q2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY idf DESC, length(term) DESC, term) AS place FROM q1), q3 AS (SELECT *, size > 2 AND n >= 200 AS focused, size > 2 AND n >= 200 AND place <= 2 AND df > 0 AS focus FROM q2),
q4 AS (SELECT *, max(focus) OVER (PARTITION BY qid) AS has_focus FROM q3), q AS (SELECT * FROM q4 WHERE NOT focused OR has_focus),
s AS (SELECT qid, chunk_id, count(*) FILTER (df <= greatest(3, floor(n * 0.1))) AS rare_hits, round(sum(least(length(q.term), 4) * idf), 9) AS score, count(*) AS matched, max(focus) AS on_focus, max(has_focus) AS needs FROM q JOIN i ON q.term = i.term AND q.df > 0 GROUP BY 1, 2),
lex AS (SELECT * FROM (SELECT qid, chunk_id, rare_hits, score, matched, row_number() OVER (PARTITION BY qid ORDER BY rare_hits DESC, score DESC, matched DESC, chunk_id) AS rank FROM s WHERE matched >= 2 AND rare_hits > 0 AND (on_focus OR NOT needs)) WHERE rank <= 20)"""


@query(f"WITH {LEX_SQL} SELECT qid, chunk_id, rare_hits, round(score, 6) AS score, matched, rank FROM lex")
def ret_lexical(t: Tables) -> DataFrame:
    return ranked(t).select("qid", "chunk_id", "rare_hits", F.round("score", 6).alias("score"), "matched", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH q AS (SELECT label AS qid, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
s AS (SELECT qid, v.vec_id AS chunk_id, list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE)) AS c FROM q, embeddings v)
SELECT qid, chunk_id, round(c, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, chunk_id) AS rank FROM s WHERE c >= 0.2) WHERE rank <= 12"""
)
def ret_dense(t: Tables) -> DataFrame:
    q = windows.first_seen(t.embeddings, ["label"], [F.col("vec_id")]).select(F.col("label").alias("qid"), "embedding")
    v = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")
    s = similarity.cosine_top(q, v, "qid", "chunk_id", "embedding", 12, 0.2)
    return s.select("qid", "chunk_id", F.round("cosine", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    """WITH q AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT qid, v.label AS chunk_id, max(list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE))) AS c FROM q, embeddings v GROUP BY 1, 2)
SELECT qid, chunk_id, round(c, 6) AS score FROM s"""
)
def ret_question_axis(t: Tables) -> DataFrame:
    """Every fiftieth vector asks; a chunk answers with the best of its question vectors."""
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    s = similarity.cosine_groups(q, t.embeddings.select(F.col("label").alias("chunk_id"), "vec_id", "embedding"), "qid", "vec_id", "embedding", "chunk_id")
    return s.select("qid", "chunk_id", F.round("top", 6).alias("score"))


DENSE_SQL = """dense AS (SELECT qid, b.vec_id * 16777216 + 1 AS chunk_id, row_number() OVER (PARTITION BY qid ORDER BY list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) DESC, b.vec_id) AS rank FROM (SELECT DISTINCT qid FROM lex) JOIN embeddings a ON a.vec_id = qid, embeddings b)"""


def dense(t: Tables, lex: DataFrame) -> DataFrame:
    """(qid, chunk_id, rank) by vectors: vector n stands for question n and for the first chunk of document n."""
    q = t.embeddings.select(F.col("vec_id").alias("qid"), "embedding").join(lex.select("qid").distinct(), "qid", "left_semi")
    s = similarity.cosine_top(q, t.embeddings.select("vec_id", "embedding"), "qid", "vec_id", "embedding", 20, -2.0)
    return s.select("qid", (F.col("vec_id") * 16777216 + 1).alias("chunk_id"), "rank")


FUSED_SQL = f"""{LEX_SQL}, {DENSE_SQL}, f0 AS (SELECT qid, chunk_id, sum(w) AS score FROM (SELECT qid, chunk_id, 0.4::DOUBLE / (60 + rank) AS w FROM lex UNION ALL SELECT qid, chunk_id, 1.0::DOUBLE / (60 + rank) FROM dense WHERE rank <= 20) GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM f0)"""


@query(f"WITH {FUSED_SQL} SELECT qid, chunk_id, round(score, 8) AS score, rank FROM f")
def ret_rrf(t: Tables) -> DataFrame:
    lex = ranked(t)
    return retrieval.hybrid(lex, dense(t, lex)).select("qid", "chunk_id", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"WITH {FUSED_SQL}, l AS (SELECT qid, chunk_id, rank AS l FROM lex WHERE rank <= 2) SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN f.rank <= 5 THEN 0 WHEN l IS NOT NULL THEN 1 ELSE 2 END, CASE WHEN f.rank <= 5 OR l IS NULL THEN f.rank ELSE l END, chunk_id) AS rank FROM f LEFT JOIN l USING (qid, chunk_id)"
)
def ret_keep_lex(t: Tables) -> DataFrame:
    lex = ranked(t)
    return retrieval.keep_lexical_tops(retrieval.hybrid(lex, dense(t, lex)), lex).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query()
def ret_candidates(t: Tables) -> DataFrame:
    return retrieval.candidates(ranked(t), chunks(t)).select("qid", "chunk_id", "quality", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {LEX_SQL}, x AS (SELECT qid, chunk_id, rank AS old, round(score / 60, 6) AS score FROM lex), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, old, chunk_id) AS rank, max(score) OVER (PARTITION BY qid) AS top FROM x),
k AS (SELECT *, score >= greatest(top * 0.25, 0.271) AS inside FROM r), m AS (SELECT *, max(inside) OVER (PARTITION BY qid) AS anyone FROM k)
SELECT qid, chunk_id, score, rank, NOT anyone OR top < 0.271 AS weak FROM m WHERE inside OR (NOT anyone AND rank = 1)"""
)
def ret_rerank_prune(t: Tables) -> DataFrame:
    r = retrieval.rerank(ranked(t), F.round(F.col("score") / 60, 6))
    return retrieval.prune(r).select("qid", "chunk_id", "score", F.col("rank").cast("long").alias("rank"), "weak")


@query(
    f"""WITH {LEX_SQL}, x AS (SELECT qid, l.chunk_id, c.doc_id, l.rank FROM lex l JOIN c USING (chunk_id)), y AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY rank) AS n FROM x)
SELECT qid, chunk_id, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM y WHERE n <= 2"""
)
def ret_diversify(t: Tables) -> DataFrame:
    r = with_chunks(t, ranked(t)).drop("seq", "text")
    return retrieval.diversify(r).select("qid", "chunk_id", "doc_id", F.col("rank").cast("long").alias("rank"))


@query()
def ret_near_copies(t: Tables) -> DataFrame:
    r = with_chunks(t, ranked(t)).drop("seq", "doc_id")
    return retrieval.drop_near_copies(r).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {LEX_SQL}, z AS (SELECT qid, c.doc_id, sum(1 / rank) AS score FROM lex JOIN c USING (chunk_id) WHERE rank <= 12 GROUP BY 1, 2)
SELECT qid, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM z) WHERE rank <= 3"""
)
def ret_suggest_docs(t: Tables) -> DataFrame:
    r = with_chunks(t, ranked(t)).drop("seq", "text")
    return retrieval.suggest_documents(r).select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {LEX_SQL}, x AS (SELECT qid, chunk_id, rank, length(c.text) AS n FROM lex JOIN c USING (chunk_id)), y AS (SELECT *, sum(n) OVER (PARTITION BY qid ORDER BY rank) AS s FROM x) SELECT qid, chunk_id, rank FROM y WHERE rank = 1 OR (rank <= 8 AND s <= 3000)"""
)
def ret_pack(t: Tables) -> DataFrame:
    r = with_chunks(t, ranked(t)).drop("seq", "doc_id")
    return retrieval.pack_until(r, 3000, 8, F.length("text")).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH RECURSIVE {LEX_SQL}, x AS (SELECT qid, chunk_id, rank, length(c.text) AS n FROM lex JOIN c USING (chunk_id)),
p AS (SELECT qid, chunk_id, rank, n <= 3000 AS inside, CASE WHEN n <= 3000 THEN 3000 - n ELSE 3000 END AS rest, CASE WHEN n <= 3000 THEN 1 ELSE 0 END AS k FROM x WHERE rank = 1
UNION ALL SELECT x.qid, x.chunk_id, x.rank, x.n + CASE WHEN p.k > 0 THEN 2 ELSE 0 END <= p.rest, CASE WHEN x.n + CASE WHEN p.k > 0 THEN 2 ELSE 0 END <= p.rest THEN p.rest - x.n - CASE WHEN p.k > 0 THEN 2 ELSE 0 END ELSE p.rest END,
CASE WHEN x.n + CASE WHEN p.k > 0 THEN 2 ELSE 0 END <= p.rest THEN p.k + 1 ELSE p.k END FROM p JOIN x ON x.qid = p.qid AND x.rank = p.rank + 1)
SELECT qid, chunk_id FROM p WHERE inside"""
)
def ret_pack_fitting(t: Tables) -> DataFrame:
    r = with_chunks(t, ranked(t)).withColumn("size", F.length("text")).drop("seq", "doc_id", "text")
    return retrieval.pack_fitting(r, 3000, "size")


def facts(t: Tables) -> dict[str, DataFrame]:
    """Orders as documents of programs (nation and segment), their lines as sections that name parts, suppliers' nations as mentions, brands as indicators."""
    key = lambda nation: F.concat(F.lit("program:"), F.col(nation).cast("string"), F.lit(":"), "c_mktsegment")
    doc = lambda c: F.concat(F.lit("doc:"), F.col(c).cast("string"))
    kind = F.when(F.startswith("o_orderpriority", F.lit("1")), "plan").when(F.startswith("o_orderpriority", F.lit("2")), "report").when(F.startswith("o_orderpriority", F.lit("3")), "evaluation").otherwise("other")
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    docs = o.select(doc("o_orderkey").alias("doc"), key("c_nationkey").alias("program"), F.year("o_orderdate").alias("year"), kind.alias("kind"), F.col("o_custkey").cast("string").alias("code"))
    l = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    sections = l.select(doc("l_orderkey").alias("doc"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("path"), F.col("p_name").alias("title"))
    measures = l.groupBy(doc("l_orderkey").alias("doc"), F.col("p_brand").alias("indicator")).agg(F.sum("l_quantity").cast("long").cast("string").alias("value"))
    m = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    mentions = m.select(doc("l_orderkey").alias("doc"), key("s_nationkey").alias("program"))
    p = t.nation.crossJoin(t.customer.select("c_mktsegment").distinct())
    after = F.lead("n_nationkey").over(W.partitionBy("n_regionkey", "c_mktsegment").orderBy("n_nationkey"))
    ledger = p.withColumn("_next", after).select(F.concat(F.lit("ledger:"), key("n_nationkey")).alias("doc"), key("n_nationkey").alias("program"), F.col("n_regionkey").cast("string").alias("family"), key("_next").alias("successor"), F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("program:"), F.col("n_nationkey").cast("string"), F.lit(":BUILDING"))).alias("into"))
    return {"docs": docs, "sections": sections, "measures": measures, "mentions": mentions, "ledger": ledger}


BUILT_SQL = """docs AS (SELECT 'doc:' || o_orderkey AS doc, 'program:' || c_nationkey || ':' || c_mktsegment AS program, CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey AS code,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'plan' WHEN '2' THEN 'report' WHEN '3' THEN 'evaluation' ELSE 'other' END AS kind FROM orders JOIN customer ON o_custkey = c_custkey),
sec AS (SELECT DISTINCT d.*, d.doc || ':sec:' || l_linenumber || '-' || l_partkey AS node, p_name AS title FROM lineitem JOIN part ON l_partkey = p_partkey JOIN docs d ON d.doc = 'doc:' || l_orderkey),
mea AS (SELECT DISTINCT d.doc, d.program, p_brand AS indicator FROM lineitem JOIN part ON l_partkey = p_partkey JOIN docs d ON d.doc = 'doc:' || l_orderkey),
men AS (SELECT DISTINCT d.doc, d.program, 'program:' || s_nationkey || ':' || split_part(d.program, ':', 3) AS other FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN docs d ON d.doc = 'doc:' || l_orderkey),
led AS (SELECT n_regionkey, n_nationkey, c_mktsegment, lead(n_nationkey) OVER (PARTITION BY n_regionkey, c_mktsegment ORDER BY n_nationkey) AS after FROM nation, (SELECT DISTINCT c_mktsegment FROM customer)),
units AS (SELECT program, title FROM sec GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 2),
py AS (SELECT DISTINCT program, code, year FROM sec WHERE kind = 'plan'),
nx AS (SELECT a.program, a.code, a.year, min(b.year) AS following FROM py a JOIN py b ON a.program = b.program AND a.code = b.code AND b.year > a.year GROUP BY 1, 2, 3),
tot AS (SELECT program, count(*) AS total FROM docs GROUP BY 1),
rel AS (SELECT men.program, other, count(DISTINCT doc) AS n, total FROM men JOIN tot ON tot.program = men.program WHERE men.program <> other GROUP BY 1, 2, 4 HAVING count(DISTINCT doc) >= 3 AND count(DISTINCT doc) >= 0.05 * total),
built AS (
SELECT 'group:' || n_regionkey AS src, 'program:' || n_nationkey || ':' || c_mktsegment AS dst, 'contains' AS kind, '분류' AS basis, 1.0::DOUBLE AS weight FROM led
UNION SELECT program, 'year:' || program || ':' || year, 'contains', '분류', 1.0 FROM docs
UNION SELECT 'year:' || program || ':' || year, doc, 'contains', '분류', 1.0 FROM docs
UNION SELECT doc, node, 'contains', '구조', 1.0 FROM sec
UNION SELECT program, 'unit:' || program || ':' || title, 'contains', '식별자 일치', 1.0 FROM units
UNION SELECT node, 'unit:' || program || ':' || title, 'instance_of', '식별자 일치', 1.0 FROM sec JOIN units USING (program, title)
UNION SELECT a.doc, b.doc, 'plans_reports', '식별자 일치', 1.0 FROM docs a JOIN docs b ON a.program = b.program AND a.year = b.year AND a.code = b.code WHERE a.kind = 'plan' AND b.kind = 'report'
UNION SELECT a.node, b.node, 'plans_reports', '식별자 일치', 1.0 FROM sec a JOIN sec b ON a.program = b.program AND a.year = b.year AND a.code = b.code AND a.title = b.title WHERE a.kind = 'plan' AND b.kind = 'report'
UNION SELECT a.doc, b.doc, 'evaluates', '분류', 1.0 FROM docs a JOIN docs b ON a.program = b.program AND a.year = b.year AND a.code = b.code WHERE a.kind = 'evaluation' AND b.kind IN ('plan', 'report')
UNION SELECT a.node, b.node, 'continues', '식별자 일치', 1.0 FROM sec a JOIN nx ON nx.program = a.program AND nx.code = a.code AND nx.year = a.year JOIN sec b ON b.program = a.program AND b.code = a.code AND b.year = nx.following AND b.title = a.title WHERE a.kind = 'plan' AND b.kind = 'plan'
UNION SELECT program, 'ind:' || program || ':' || indicator, 'has_indicator', '추출', 1.0 FROM mea
UNION SELECT doc, 'ind:' || program || ':' || indicator, 'measures', '추출', 1.0 FROM mea
UNION SELECT 'program:' || n_nationkey || ':' || c_mktsegment, 'program:' || after || ':' || c_mktsegment, 'succeeded_by', '분류', 1.0 FROM led WHERE after IS NOT NULL
UNION SELECT 'program:' || n_nationkey || ':' || c_mktsegment, 'program:' || n_nationkey || ':BUILDING', 'integrated_into', '분류', 1.0 FROM led WHERE c_mktsegment = 'MACHINERY'
UNION SELECT program, other, 'related', '식별자 일치', least(1.0, n / total * 5) FROM rel)"""


_ASKED_SQL = """a AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) || ':' || c_mktsegment || ':' || year(o_orderdate) AS qid, c_nationkey AS nation, c_mktsegment AS segment, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(
    f"""WITH {BUILT_SQL}, {_ASKED_SQL},
k AS (SELECT qid, nation, segment, 'program:' || nation || ':' || segment AS program, CASE WHEN segment = 'FURNITURE' THEN NULL ELSE year END AS asked, CASE WHEN segment IN ('BUILDING', 'FURNITURE') THEN 'plan' WHEN segment = 'MACHINERY' THEN 'report' END AS kind, segment IN ('MACHINERY', 'AUTOMOBILE') AS wide, segment = 'HOUSEHOLD' AS lost FROM a),
own AS (SELECT qid, doc, (asked IS NULL OR asked = year) AND (k.kind IS NULL OR k.kind = docs.kind) AS fits FROM k JOIN docs ON docs.program = k.program WHERE NOT lost),
far AS (SELECT qid, doc, 'succeeded_by' AS why FROM k JOIN led ON n_nationkey = nation AND c_mktsegment = segment JOIN docs ON docs.program = 'program:' || after || ':' || segment WHERE wide AND NOT lost AND (k.kind IS NULL OR k.kind = docs.kind))
SELECT qid, doc, 'scope' AS why FROM own WHERE fits UNION ALL SELECT qid, doc, 'program' FROM own WHERE qid NOT IN (SELECT qid FROM own WHERE fits) UNION ALL SELECT * FROM far UNION ALL SELECT qid, NULL, 'everything' FROM k WHERE lost"""
)
def ret_scope(t: Tables) -> DataFrame:
    """A question for each program and year: names lie within one another (NATION_1, NATION_12), some questions name no program, kind or year, some follow a relation."""
    f = facts(t)
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "c_mktsegment", F.year("o_orderdate").alias("year")).distinct()
    segment = F.col("c_mktsegment")
    nation = F.concat(F.lit("Nation_"), F.col("c_nationkey").cast("string"))
    kind = F.when(segment.isin("BUILDING", "FURNITURE"), "plans").when(segment == "MACHINERY", "reports").otherwise("papers")
    when = F.when(segment == "FURNITURE", "ever").otherwise(F.concat(F.lit("in "), F.col("year").cast("string")))
    told = F.when(segment == "HOUSEHOLD", nation).otherwise(F.concat_ws(" ", segment, nation))
    text = F.concat_ws(" ", F.lit("Which"), kind, F.lit("of"), told, when, F.when(segment.isin("MACHINERY", "AUTOMOBILE"), "and what came after?").otherwise("?"))
    questions = o.select(F.concat_ws(":", "c_nationkey", "c_mktsegment", "year").alias("qid"), text.alias("text"))
    programs = f["docs"].select("program").distinct().withColumn("name", F.regexp_replace("program", r"^program:(\d+):(.*)$", "$2 NATION_$1"))
    relations = f["ledger"].where("successor is not null").select(F.col("program").alias("src"), F.col("successor").alias("dst"), F.lit("succeeded_by").alias("relation"))
    kinds = t.spark.sql("SELECT * FROM VALUES ('plan', 'plans'), ('report', 'reports') AS k(kind, word)")
    words = t.spark.sql("SELECT * FROM VALUES ('succeeded_by', 'came after') AS r(relation, word)")
    return names.resolve_scope(questions, programs, f["docs"], relations, kinds, words)


@query(
    """WITH a AS (SELECT doc_id AS chunk_id, md5(text) AS digest FROM documents WHERE n_chars > 300), b AS (SELECT doc_id AS chunk_id, CASE WHEN lang = 'es' THEN 'old' ELSE md5(text) END AS digest FROM documents WHERE n_chars < 5000)
SELECT coalesce(a.chunk_id, b.chunk_id) AS chunk_id, CASE WHEN b.chunk_id IS NULL THEN 'embed' WHEN a.chunk_id IS NULL THEN 'drop' ELSE 'embed_again' END AS action FROM a FULL JOIN b ON a.chunk_id = b.chunk_id WHERE a.digest IS DISTINCT FROM b.digest"""
)
def ret_index_incr(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("chunk_id"), F.md5("text").alias("digest"), "n_chars", "lang")
    old = d.where("n_chars < 5000").withColumn("digest", F.when(F.col("lang") == "es", "old").otherwise(F.col("digest")))
    return retrieval.index_delta(d.where("n_chars > 300"), old)


@query(
    f"""WITH c AS (SELECT doc_id * 16777216 + seq AS chunk_id, doc_id, seq, line AS text FROM ({LINES_SQL})), k AS (SELECT chunk_id, doc_id, seq, lower(regexp_replace(regexp_replace(text, '^\\s*[0-9]+(?:[.)-][0-9]*)*\\s*', ''), '[^가-힣A-Za-z0-9]', '', 'g')) AS k FROM c)
SELECT a.doc_id AS qid, min(b.chunk_id) AS chunk_id, count(*) AS n FROM k a JOIN k b USING (k) WHERE a.seq = 1 AND k <> '' GROUP BY 1""".replace("\\\\", "\\")
)
def ret_section_hits(t: Tables) -> DataFrame:
    """The first line of each document, numbered anew, as a question for a section."""
    k = chunks(t).select("chunk_id", "doc_id", "seq", "text")
    asked = k.where("seq = 1").select(F.col("doc_id").alias("qid"), joins.key_of(F.concat(F.lit("3-1. "), joins.unnumbered("text"))).alias("k")).where("k <> ''")
    # Equal keys of a section first become one row with a count.
    held = k.select("chunk_id", joins.key_of(F.col("text")).alias("k")).groupBy("k").agg(F.min("chunk_id").alias("chunk_id"), F.count(F.lit(1)).alias("n"))
    return asked.join(held, "k").select("qid", "chunk_id", "n")


# --- graph: region -> nation -> customer and supplier -> part ------------------------------------------------


def nodes(t: Tables) -> DataFrame:
    n = t.region.select(F.concat(F.lit("region:"), "r_regionkey").alias("id"), F.lit("region").alias("type"), F.col("r_name").alias("label"))
    n = n.union(t.nation.select(F.concat(F.lit("nation:"), "n_nationkey"), F.lit("nation"), F.col("n_name")))
    n = n.union(t.supplier.select(F.concat(F.lit("supplier:"), "s_suppkey"), F.lit("supplier"), F.col("s_name")))
    return n.union(t.part.select(F.concat(F.lit("part:"), "p_partkey"), F.lit("part"), F.col("p_name")))


def edges(t: Tables) -> DataFrame:
    def edge(src, dst, kind, basis, weight, df):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(basis).alias("basis"), F.array(F.lit("table")).alias("evidence"), weight.cast("double").alias("weight"))

    key = lambda p, c: F.concat(F.lit(p + ":"), F.col(c))
    e = edge(key("region", "n_regionkey"), key("nation", "n_nationkey"), "contains", "구조", F.lit(1), t.nation)
    e = e.union(edge(key("nation", "s_nationkey"), key("supplier", "s_suppkey"), "contains", "구조", F.lit(1), t.supplier))
    s = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return e.union(edge(key("supplier", "l_suppkey"), key("part", "l_partkey"), "supplies", "분류", F.col("n"), s))


NODES_SQL = "nodes AS (SELECT 'region:' || r_regionkey AS id, 'region' AS type, r_name AS label FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'part:' || p_partkey, 'part', p_name FROM part)"
EDGES_SQL = """edges AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS kind, '구조' AS basis, 1.0::DOUBLE AS weight FROM nation UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', '구조', 1.0 FROM supplier
UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies', '분류', count(*)::DOUBLE FROM lineitem GROUP BY l_suppkey, l_partkey)"""
GRAPH_SQL = f"{NODES_SQL}, {EDGES_SQL}"


@query(f"WITH {BUILT_SQL} SELECT src, dst, kind, basis, round(weight, 6) AS weight FROM built")
def gr_build_v3(t: Tables) -> DataFrame:
    """All ten kinds of edges from all facts."""
    return graph_build.build(facts(t)).graph().select("src", "dst", "kind", "basis", F.round("weight", 6).alias("weight"))


@query(f"WITH {BUILT_SQL} SELECT src, dst, kind, basis, round(weight, 6) AS weight FROM built")
def gr_build_increments(t: Tables) -> DataFrame:
    """The same graph in two steps: orders that were still open are missing at first, those of priority 3 are plans, and some are there that go."""
    now = facts(t)
    f = t.orders.where("o_orderstatus <> 'O'").select(F.concat(F.lit("doc:"), F.col("o_orderkey").cast("string")).alias("doc"))
    then = {name: rows if name == "ledger" else rows.join(f, "doc", "left_semi") for name, rows in now.items()}
    gone = then["docs"].where("kind = 'report'").withColumn("doc", F.concat("doc", F.lit("-gone")))
    then["docs"] = then["docs"].withColumn("kind", F.when(F.col("kind") == "evaluation", "plan").otherwise(F.col("kind"))).union(gone)
    then["ledger"] = then["ledger"].withColumn("into", F.lit("program:none"))
    return graph_build.update(graph_build.build(then), now).graph().select("src", "dst", "kind", "basis", F.round("weight", 6).alias("weight"))


@query(f"WITH {EDGES_SQL}, e AS (SELECT * FROM edges UNION ALL SELECT dst, src, kind, basis, weight FROM edges WHERE kind = 'contains') SELECT least(src, dst) AS a, greatest(src, dst) AS b, kind, max(weight) AS weight FROM e GROUP BY 1, 2, 3")
def gr_build_v2(t: Tables) -> DataFrame:
    e = edges(t)
    back = e.where("kind = 'contains'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "basis", "evidence", "weight")
    return graph.undirected(e.unionByName(back))


@query(
    f"""WITH {GRAPH_SQL}, c AS (SELECT id FROM nodes WHERE type = 'supplier'), j AS (SELECT c.id AS center, kind, 'out' AS dir, dst AS other, weight FROM c JOIN edges ON c.id = src UNION ALL SELECT c.id, kind, 'in', src, weight FROM c JOIN edges ON c.id = dst),
k AS (SELECT j.*, type, label, count(*) OVER w AS total, row_number() OVER (PARTITION BY center, kind, dir, type ORDER BY weight DESC, label, other) AS r FROM j JOIN nodes ON nodes.id = j.other WINDOW w AS (PARTITION BY center, kind, dir, type))
SELECT center, kind, dir, type, other, label, weight, total FROM k WHERE r <= 5"""
)
def gr_neighbors(t: Tables) -> DataFrame:
    n = nodes(t)
    return graph.neighbours(n.where("type = 'supplier'"), n, edges(t), per_group=5)


@query(f"WITH {EDGES_SQL} SELECT x.dst AS a, y.dst AS b, x.src AS parent FROM edges x JOIN edges y ON x.src = y.src AND x.dst <> y.dst WHERE x.kind = 'contains' AND y.kind = 'contains'")
def gr_two_hop(t: Tables) -> DataFrame:
    """Nodes two steps away over their parent, each ordered pair."""
    return graph.sibling_pairs(edges(t), "contains")


@query("WITH s AS (SELECT n_regionkey || '.' || n_nationkey AS path, n_name FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name FROM region) SELECT path, n_name FROM s WHERE path = '1' OR path LIKE '1.%'")
def gr_subtree(t: Tables) -> DataFrame:
    s = t.nation.select(F.concat_ws(".", "n_regionkey", "n_nationkey").alias("path"), "n_name").union(t.region.select(F.col("r_regionkey").cast("string"), "r_name"))
    return graph.subtree(s, "1")


@query(f"WITH RECURSIVE {EDGES_SQL}, b AS (SELECT 'region:' || r_regionkey AS root, 'region:' || r_regionkey AS id, 0 AS depth FROM region UNION ALL SELECT b.root, e.dst, b.depth + 1 FROM b JOIN edges e ON e.src = b.id AND e.kind = 'contains') SELECT root, id, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY 1, 2")
def gr_hierarchy(t: Tables) -> DataFrame:
    roots = nodes(t).where("type = 'region'").select("id")
    return graph.descendants(edges(t).where("kind = 'contains'"), roots)


@query(
    f"""WITH {GRAPH_SQL}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1), n AS (SELECT nodes.*, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN d USING (id) WHERE type = 'part'),
b AS (SELECT label, arg_max(id, (degree, id)) AS keep FROM n GROUP BY 1 HAVING count(*) > 1), m AS (SELECT n.id, keep FROM n JOIN b USING (label) WHERE n.id <> keep)
SELECT DISTINCT coalesce(s.keep, src) AS src, coalesce(t.keep, dst) AS dst, kind FROM edges LEFT JOIN m s ON s.id = src LEFT JOIN m t ON t.id = dst WHERE coalesce(s.keep, src) <> coalesce(t.keep, dst)"""
)
def gr_merge_dups(t: Tables) -> DataFrame:
    return graph.merge_equal_labels(nodes(t), edges(t), "part")[1].select("src", "dst", "kind")


@query(f"WITH {GRAPH_SQL} SELECT a.type AS src_type, kind, b.type AS dst_type, basis, count(*) AS n FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY 1, 2, 3, 4")
def gr_schema_summary(t: Tables) -> DataFrame:
    return graph.schema_summary(nodes(t), edges(t))


@query("SELECT n_regionkey AS program, count(DISTINCT l_partkey) AS docs FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE p_retailprice < 1500 GROUP BY 1")
def gr_doc_sets(t: Tables) -> DataFrame:
    j = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).join(t.lineitem.select("l_suppkey", "l_partkey").distinct(), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.join(t.part.where("p_retailprice < 1500"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").groupBy(F.col("n_regionkey").alias("program")).agg(F.countDistinct("l_partkey").alias("docs"))


@query(
    f"""WITH l AS ({LINES_SQL}), s AS (SELECT doc_id, trim(line) AS title, lower(regexp_replace(regexp_replace(line, '^\\s*[0-9]+(?:[.)-][0-9]*)*\\s*', ''), '[^가-힣A-Za-z0-9]', '', 'g')) AS key FROM l WHERE length(line) <= 60),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM s WHERE length(key) >= 6), m AS (SELECT * FROM k WHERE n < 3), c AS (SELECT key, title, count(*) AS c FROM m GROUP BY 1, 2), b AS (SELECT key, arg_max(title, (c, title)) AS label FROM c GROUP BY 1)
SELECT key, substr(label, 1, 120) AS label, count(DISTINCT doc_id) AS docs FROM m JOIN b USING (key) GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2"""
)
def gr_units(t: Tables) -> DataFrame:
    s = lines(t).where(F.length("line") <= 60).select("doc_id", F.trim("line").alias("title"), joins.key_of(F.col("line")).alias("key"))
    return graph.recurring_titles(s)


@query(
    """WITH s AS (SELECT o_custkey AS table_id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS indicator, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2, 3) SELECT table_id, indicator, year, value FROM s WHERE year >= 2000"""
)
def gr_indicators(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    v = t.orders.groupBy(F.col("o_custkey").alias("table_id"), y.alias("c"), F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("v"))
    r = F.dense_rank().over(W.partitionBy("table_id").orderBy("name"))
    v = v.withColumn("r", r)
    cells = v.select("table_id", "r", "c", F.lit(False).alias("is_header"), F.col("v").cast("string").alias("text"))
    cells = cells.union(v.select("table_id", "r", F.lit(0), F.lit(False), "name").distinct()).union(v.select("table_id", F.lit(0), "c", F.lit(True), F.concat(F.col("c").cast("string"), F.lit("년"))).distinct())
    return graph.indicator_observations(cells)


_FAULTS_SQL = f"""{GRAPH_SQL}, n AS (SELECT id, label FROM nodes UNION ALL SELECT 'blank:' || p_partkey, ' ' FROM part WHERE p_size = 46 UNION ALL SELECT 'lone:' || p_partkey, 'x' FROM part WHERE p_size >= 48),
e AS (SELECT src, dst, basis, 1 AS evidence FROM edges UNION ALL SELECT 'part:' || p_partkey, CASE WHEN p_size = 50 THEN 'part:' ELSE 'gone:' END || p_partkey, CASE WHEN p_size = 48 THEN 'guess' ELSE '구조' END, CASE WHEN p_size = 47 THEN 0 ELSE 1 END FROM part WHERE p_size >= 47)"""


@query(
    f"""WITH {_FAULTS_SQL} SELECT 'edge to a missing node' AS rule, (SELECT count(*) FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) WHERE id NOT IN (SELECT id FROM n)) AS n UNION ALL SELECT 'loop', (SELECT count(*) FROM e WHERE src = dst) UNION ALL SELECT 'unknown basis', (SELECT count(*) FROM e WHERE basis = 'guess') UNION ALL SELECT 'no evidence', (SELECT count(*) FROM e WHERE evidence = 0)
UNION ALL SELECT 'empty label', (SELECT count(*) FROM n WHERE trim(coalesce(label, '')) = '') UNION ALL SELECT 'isolated node', (SELECT count(*) FROM n WHERE id NOT IN (SELECT src FROM e UNION ALL SELECT dst FROM e))"""
)
def gr_audit(t: Tables) -> DataFrame:
    """The graph with faults of each kind added to it."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    n = nodes(t).select("id", "label").union(t.part.where("p_size = 46").select(F.concat(F.lit("blank:"), key), F.lit(" "))).union(t.part.where("p_size >= 48").select(F.concat(F.lit("lone:"), key), F.lit("x")))
    bad = t.part.where("p_size >= 47").select(
        F.concat(F.lit("part:"), key).alias("src"), F.concat(F.when(size == 50, "part:").otherwise("gone:"), key).alias("dst"), F.lit("odd").alias("kind"), F.when(size == 48, "guess").otherwise("구조").alias("basis"),
        F.when(size == 47, F.array().cast("array<string>")).otherwise(F.array(F.lit("table"))).alias("evidence"), F.lit(1.0).alias("weight"),
    )
    return graph.audit(n, edges(t).unionByName(bad))


@query()
def gr_fingerprint(t: Tables) -> DataFrame:
    return graph.fingerprint(t.lineitem)


@query(f"WITH {GRAPH_SQL} SELECT '<urn:graph:' || replace(src, ':', '%3A') || '> <urn:graph:' || kind || '> <urn:graph:' || replace(dst, ':', '%3A') || '> .' AS line FROM edges UNION ALL SELECT '<urn:graph:' || replace(id, ':', '%3A') || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <urn:graph:' || type || '> .' FROM nodes UNION ALL SELECT '<urn:graph:' || replace(id, ':', '%3A') || '> <http://www.w3.org/2000/01/rdf-schema#label> \"' || label || '\" .' FROM nodes")
def snk_rdf(t: Tables) -> DataFrame:
    return graph.ntriples(nodes(t), edges(t))


SHAPES = [
    shapes.Shape("region", [shapes.Value("label")], [shapes.Link("contains", 1, None, "nation")], closed=True),
    shapes.Shape("nation", [shapes.Value("label", pattern="^NATION_[0-9]+$")], [shapes.Link("contains", 0, None, "supplier"), shapes.Link("contains", 1, 1, "region", inverse=True)], closed=True),
    shapes.Shape("supplier", [shapes.Value("label")], [shapes.Link("supplies", 1, None, "part"), shapes.Link("contains", 1, 1, "nation", inverse=True)], closed=True),
    shapes.Shape("part", [shapes.Value("label")], [shapes.Link("supplies", 0, None, "supplier", inverse=True)], closed=True),
]


@query(
    f"""WITH {GRAPH_SQL}, n AS (SELECT * FROM nodes UNION ALL SELECT 'blank:' || p_partkey, 'part', ' ' FROM part WHERE p_size = 46 UNION ALL SELECT 'lone:' || p_partkey, 'supplier', 'x' FROM part WHERE p_size = 49 UNION ALL SELECT 'odd:' || p_partkey, 'nation', 'Nation' FROM part WHERE p_size = 45),
e AS (SELECT src, dst, kind FROM edges UNION SELECT 'part:' || p_partkey, 'part:' || p_partkey, 'odd' FROM part WHERE p_size = 47 UNION SELECT 'nation:0', 'part:' || p_partkey, 'contains' FROM part WHERE p_size = 48 UNION SELECT 'nation:' || n_nationkey, 'supplier:1', 'contains' FROM nation UNION SELECT 'supplier:2', 'gone:' || p_partkey, 'supplies' FROM part WHERE p_size = 50),
l(type, kind, inv, least, most, other) AS (VALUES ('region', 'contains', false, 1, NULL, 'nation'), ('nation', 'contains', false, 0, NULL, 'supplier'), ('nation', 'contains', true, 1, 1, 'region'), ('supplier', 'supplies', false, 1, NULL, 'part'), ('supplier', 'contains', true, 1, 1, 'nation'), ('part', 'supplies', true, 0, NULL, 'supplier')),
d AS (SELECT src AS node, dst AS far, kind, false AS inv FROM e UNION ALL SELECT dst, src, kind, true FROM e),
c AS (SELECT n.type AS shape, n.id AS node, CASE WHEN l.inv THEN '^' ELSE '' END || l.kind AS path, least, most, count(d.far) AS k, count(CASE WHEN d.far IS NOT NULL AND m.type IS DISTINCT FROM l.other THEN 1 END) AS foreign_ends
  FROM n JOIN l ON n.type = l.type LEFT JOIN d ON d.node = n.id AND d.kind = l.kind AND d.inv = l.inv LEFT JOIN n m ON m.id = d.far GROUP BY 1, 2, 3, 4, 5)
SELECT type AS shape, id AS node, 'missing' AS rule, 'label' AS path, CAST(1 AS BIGINT) AS n FROM n WHERE trim(coalesce(label, '')) = '' UNION ALL SELECT type, id, 'pattern', 'label', 1 FROM n WHERE type = 'nation' AND NOT regexp_matches(label, '^NATION_[0-9]+$')
UNION ALL SELECT shape, node, 'too few', path, k FROM c WHERE k < least UNION ALL SELECT shape, node, 'too many', path, k FROM c WHERE k > most UNION ALL SELECT shape, node, 'class', path, foreign_ends FROM c WHERE foreign_ends > 0
UNION ALL SELECT n.type, n.id, 'closed', d.kind, count(*) FROM d JOIN n ON n.id = d.node WHERE NOT inv AND NOT EXISTS (SELECT 1 FROM l WHERE l.type = n.type AND l.kind = d.kind AND NOT l.inv) GROUP BY 1, 2, 4"""
)
def snk_rdf_shapes(t: Tables) -> DataFrame:
    """The graph with faults of every kind against the shapes of its nodes."""
    key = F.col("p_partkey").cast("string")
    more = lambda size, prefix, kind, label: t.part.where(F.col("p_size") == size).select(F.concat(F.lit(prefix), key).alias("id"), F.lit(kind).alias("type"), F.lit(label).alias("label"))
    n = nodes(t).union(more(46, "blank:", "part", " ")).union(more(49, "lone:", "supplier", "x")).union(more(45, "odd:", "nation", "Nation"))
    link = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))
    part, sized = F.concat(F.lit("part:"), key), lambda size: t.part.where(F.col("p_size") == size)
    e = edges(t).select("src", "dst", "kind").union(link(sized(47), part, part, "odd")).union(link(sized(48), F.lit("nation:0"), part, "contains"))
    e = e.union(link(t.nation, F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")), F.lit("supplier:1"), "contains")).union(link(sized(50), F.lit("supplier:2"), F.concat(F.lit("gone:"), key), "supplies"))
    return shapes.violations(n, e, SHAPES)
