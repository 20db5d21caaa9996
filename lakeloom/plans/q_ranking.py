"""Window, sort, limit and paging queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import aggregates as agg
from lakeloom.operators import ranking, similarity, vector_index, versions, windows
from lakeloom.operators.lineage import cut, scratch
from lakeloom.plans.q_aggregates import LINES_SQL, WORDS_SQL, lines, words
from lakeloom.plans.registry import Tables, query

DOT_SQL = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 2")
def win_rank_topk_group(t: Tables) -> DataFrame:
    out = windows.top_k(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 2)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY regexp_replace(text, '[^가-힣A-Za-z0-9]', '', 'g') ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def win_first_seen_dedup(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "n_chars", F.sha2(F.regexp_replace("text", "[^가-힣A-Za-z0-9]", ""), 256).alias("fp"))
    return windows.first_seen(d, ["fp"], [F.desc("n_chars"), F.col("doc_id")]).select("doc_id")


@query(
    """WITH f AS (SELECT doc_id AS rel, lang AS name, n_chars AS size, CASE WHEN source <> 'src0' THEN md5(text) END AS digest FROM documents),
h AS (SELECT rel, CASE WHEN digest IS NULL THEN first_value(rel) OVER (PARTITION BY name, size ORDER BY rel) ELSE first_value(rel) OVER (PARTITION BY name, size, digest ORDER BY rel) END AS head FROM f)
SELECT rel, CASE WHEN head <> rel THEN head END AS dup_of FROM h"""
)
def win_dup_of_first(t: Tables) -> DataFrame:
    f = t.documents.select(F.col("doc_id").alias("rel"), F.col("lang").alias("name"), F.col("n_chars").alias("size"), F.when(F.col("source") != "src0", F.md5("text")).alias("digest"))
    return windows.duplicate_of(f).select("rel", "dup_of")


@query(
    """WITH o AS (SELECT o_custkey AS family, o_orderkey AS version, o_orderdate AS latest, o_orderstatus = 'F' AS trusted, list_distinct(list(year(l_shipdate)) FILTER (l_shipdate IS NOT NULL)) AS dates, list_distinct(list(p_brand) FILTER (p_brand IS NOT NULL)) AS grams
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3, 4),
a AS (SELECT *, row_number() OVER w AS place, coalesce(first_value(CASE WHEN trusted THEN version END IGNORE NULLS) OVER (PARTITION BY family ORDER BY latest DESC NULLS LAST, version DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), lead(version) OVER w) AS anchor FROM o WINDOW w AS (PARTITION BY family ORDER BY latest DESC NULLS LAST, version DESC)),
g AS (SELECT a.family, a.version, a.place, a.trusted OR a.anchor IS NULL OR (a.latest > b.latest AND len(list_filter(coalesce(b.dates, []), lambda x: NOT list_contains(coalesce(a.dates, []), x))) = 0
  AND len(list_intersect(coalesce(a.grams, []), coalesce(b.grams, []))) / greatest(least(len(coalesce(a.grams, [])), len(coalesce(b.grams, []))), 1) >= 0.3) AS good FROM a LEFT JOIN o b ON b.family = a.family AND b.version = a.anchor)
SELECT family, version, CASE WHEN place = f THEN 'current' WHEN place < f THEN 'unsure' ELSE 'old' END AS status FROM (SELECT *, min(CASE WHEN good THEN place END) OVER (PARTITION BY family) AS f FROM g)"""
)
def win_latest_version(t: Tables) -> DataFrame:
    """A customer's orders as versions: finished ones are trusted, years of shipping are revisions, brands the text."""
    l = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("l_orderkey").agg(F.collect_set(F.year("l_shipdate")).alias("dates"), F.collect_set("p_brand").alias("grams"))
    o = t.orders.join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return windows.current_versions(o.select(F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("latest"), (F.col("o_orderstatus") == "F").alias("trusted"), "dates", "grams"))


@query(
    f"""WITH RECURSIVE l AS ({LINES_SQL}), g AS (
SELECT doc_id, seq, seq AS upto, line AS acc FROM l WHERE length(line) < 400
UNION ALL SELECT g.doc_id, g.seq, n.seq, CASE WHEN length(g.acc) >= 1200 THEN g.acc WHEN g.acc = '' THEN n.line ELSE g.acc || chr(10) || n.line END FROM g JOIN l n ON n.doc_id = g.doc_id AND n.seq = g.upto + 1 WHERE g.upto < g.seq + 6)
SELECT doc_id, seq, substr(arg_max(acc, upto), 1, 1200) AS expanded FROM g GROUP BY doc_id, seq
UNION ALL SELECT doc_id, seq, line FROM l WHERE length(line) >= 400"""
)
def win_neighbor_concat(t: Tables) -> DataFrame:
    return windows.neighbours(lines(t), text="line").select("doc_id", "seq", "expanded")


HEAD_SQL = f"""WITH l AS ({LINES_SQL}), h AS (SELECT doc_id, seq, CASE WHEN length(line) < 12 THEN 1 WHEN length(line) < 30 THEN 2 WHEN length(line) < 60 THEN 3 END AS level, line FROM l)"""


def headed(t: Tables) -> DataFrame:
    n = F.length("line")
    return lines(t).select("doc_id", F.lit(0).alias("page"), "seq", F.when(n < 12, 1).when(n < 30, 2).when(n < 60, 3).alias("level"), F.col("line").alias("title"))


@query(
    f"""{HEAD_SQL}, w AS (SELECT doc_id, seq, max(CASE WHEN level = 1 THEN seq END) OVER p AS n1, max(CASE WHEN level = 2 THEN seq END) OVER p AS n2, max(CASE WHEN level = 3 THEN seq END) OVER p AS n3
FROM h WINDOW p AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT w.doc_id, w.seq, concat_ws(' > ', a.line, b.line, c.line) AS path FROM w LEFT JOIN h a ON a.doc_id = w.doc_id AND a.seq = w.n1
LEFT JOIN h b ON b.doc_id = w.doc_id AND b.seq = w.n2 AND w.n2 > coalesce(w.n1, 0) LEFT JOIN h c ON c.doc_id = w.doc_id AND c.seq = w.n3 AND w.n3 > greatest(coalesce(w.n1, 0), coalesce(w.n2, 0))"""
)
def win_breadcrumb(t: Tables) -> DataFrame:
    return windows.breadcrumbs(headed(t), deepest=3).select("doc_id", "seq", F.array_join("path", " > ").alias("path"))


@query(
    f"""{HEAD_SQL}, i AS (SELECT *, level IS NOT NULL AS hd, seq - row_number() OVER (PARTITION BY doc_id, level IS NOT NULL ORDER BY seq) AS isle FROM h)
SELECT doc_id, seq, hd AND count(*) OVER (PARTITION BY doc_id, hd, isle) >= 2 AS toc FROM i"""
)
def win_toc_run(t: Tables) -> DataFrame:
    return windows.toc_runs(headed(t), F.col("level").isNotNull(), least=2).select("doc_id", "seq", "toc")


@query(
    """SELECT user_id AS doc_id, event_id AS version, 'user ' || user_id || chr(10) || string_agg(coalesce(props, ''), chr(10)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) || chr(10) || 'end' AS text,
CAST((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 50 AS INTEGER) AS step FROM events"""
)
def win_version_history(t: Tables) -> DataFrame:
    """A text for each user that shows the last four events: written as deltas, read back version by version."""
    recent = F.collect_list(F.coalesce("props", F.lit(""))).over(windows.W.partitionBy("user_id").orderBy("event_id").rowsBetween(-3, 0))
    text = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit("\n"), F.array_join(recent, "\n"), F.lit("\nend"))
    log = cut(versions.write_deltas(t.events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("version"), text.alias("text"))))
    return versions.read_versions(log)


@query(
    f"""WITH RECURSIVE l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k, seq, length(line) AS n FROM ({LINES_SQL}) WHERE length(line) <= 2000),
p AS (SELECT doc_id, k, seq, 0 AS win, n AS used FROM l WHERE k = 1
UNION ALL SELECT l.doc_id, l.k, l.seq, CASE WHEN p.used > 0 AND p.used + l.n > 2000 THEN p.win + 1 ELSE p.win END, CASE WHEN p.used > 0 AND p.used + l.n > 2000 THEN l.n ELSE p.used + l.n END FROM p JOIN l ON l.doc_id = p.doc_id AND l.k = p.k + 1)
SELECT doc_id, seq, CAST(win AS INTEGER) AS "window" FROM p"""
)
def win_pack_budget(t: Tables) -> DataFrame:
    return windows.pack_windows(lines(t).withColumn("n", F.length("line")), "doc_id", ["seq"], "n", 2000).select("doc_id", "seq", "window")


@query("SELECT doc_id, source, row_number() OVER (ORDER BY r, source) AS turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents)")
def win_round_robin(t: Tables) -> DataFrame:
    return windows.round_robin(t.documents.select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "source", F.col("turn").cast("long").alias("turn"))


@query("SELECT conv_id, turn, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seen FROM conversations")
def win_turn_prefix(t: Tables) -> DataFrame:
    return windows.evidence_before(t.conversations, "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", F.col("seen").cast("long").alias("seen"))


@query(
    """WITH a AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 20),
b AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents QUALIFY r <= 20),
s AS (SELECT lang, doc_id, sum(s) AS score FROM (SELECT lang, doc_id, 0.4 / (60 + r) AS s FROM a UNION ALL SELECT lang, doc_id, 1.0 / (60 + r) FROM b) GROUP BY 1, 2)
SELECT lang, doc_id, round(score, 8)::DOUBLE AS score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM s"""
)
def win_rrf(t: Tables) -> DataFrame:
    a = windows.top_k(t.documents, ["lang"], [F.desc("n_chars"), F.col("doc_id")], 20)
    b = windows.top_k(t.documents, ["lang"], [F.col("doc_id")], 20)
    return windows.fuse(a, b, ["lang"], "doc_id", w_a=0.4).select("lang", "doc_id", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


# --- sort, limit, paging ---------------------------------------------------------------------------


@query(f"SELECT q, vec_id, round(s, 6) AS score, rank FROM (SELECT a.vec_id AS q, b.vec_id, {DOT_SQL} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DOT_SQL} DESC, b.vec_id) AS rank FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) a, embeddings b WHERE b.label <> a.label) WHERE rank <= 20")
def srt_topk_dense(t: Tables) -> DataFrame:
    """Every fiftieth vector asks; rows of its own label don't answer."""
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "label", "embedding")
    v = t.embeddings.select("vec_id", F.col("label").alias("other"), "embedding")
    top = similarity.cosine_top(q, v, "q", "vec_id", "embedding", 20, -2.0, apart=("label", "other"))
    return top.select("q", "vec_id", F.round("cosine", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _searched(t: Tables, where: Column | None = None) -> DataFrame:
    index = vector_index.VectorIndex(t.spark, scratch(t.spark, "vectors")).build(t.embeddings, ["label"])
    found = index.search(t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), "embedding"), 10, where, "q")
    return found.select("q", "vec_id", "score", F.col("rank").cast("long").alias("rank"), F.col("lists").cast("long").alias("lists"))


@query()
def srt_ann_hnsw(t: Tables) -> DataFrame:
    """Nearest neighbours from an index on files that holds every row; recall is measured against the exact order."""
    return _searched(t)


@query()
def srt_ann_filtered(t: Tables) -> DataFrame:
    """The same within one of ten labels: searches widen until they have their ten rows."""
    return _searched(t, F.col("label") == 3)


@query("SELECT l_partkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS rare, round(sum(l_extendedprice), 2) AS score, count(*) AS matched FROM lineitem GROUP BY 1 ORDER BY rare DESC, score DESC, matched DESC, l_partkey LIMIT 50")
def srt_multi_key(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("rare"), F.round(F.sum("l_extendedprice"), 2).alias("score"), F.count(F.lit(1)).alias("matched"))
    return g.orderBy(F.desc("rare"), F.desc("score"), F.desc("matched"), "l_partkey").limit(50)


@query("SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN contains(text, 'License') THEN 0 ELSE 1 END, r) AS rank FROM (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents)")
def srt_stable_promote(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "n_chars", F.contains("text", F.lit("License")).alias("has"))
    ranked = windows.number_rows(d, [F.desc("n_chars"), F.col("doc_id")], "rank")
    return ranking.promote(ranked, F.col("has"), "rank").select("doc_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def srt_page_offset(t: Tables) -> DataFrame:
    return ranking.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 25)


@query("SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (100, 500) ORDER BY o_custkey, o_orderkey LIMIT 40")
def srt_keyset(t: Tables) -> DataFrame:
    return ranking.keyset_page(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], (100, 500), 40)


@query("SELECT o_orderkey, o_custkey, max(o_orderdate) OVER (PARTITION BY o_custkey) AS group_at FROM orders ORDER BY group_at DESC, o_custkey, o_orderdate DESC, o_orderkey LIMIT 60")
def srt_group_order(t: Tables) -> DataFrame:
    g = ranking.newest_groups_first(t.orders, "o_custkey", "o_orderdate")
    return g.orderBy(F.desc("group_at"), "o_custkey", F.desc("o_orderdate"), "o_orderkey").limit(60).select("o_orderkey", "o_custkey", "group_at")


@query("SELECT doc_id FROM documents ORDER BY sha1('7|' || doc_id || '|' || text), doc_id LIMIT 50")
def srt_sample_stable(t: Tables) -> DataFrame:
    return ranking.stable_sample(t.documents.select("doc_id", "text"), [F.col("doc_id"), F.col("text")], "7", 50).select("doc_id")


@query(
    f"""WITH w AS ({WORDS_SQL}), d AS (SELECT term, count(*) AS df FROM w GROUP BY 1), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS term FROM benchmark),
s AS (SELECT item_id, term, df, coalesce(sum(df) OVER (PARTITION BY item_id ORDER BY df, term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q JOIN d USING (term))
SELECT item_id, term, df FROM s WHERE before < 500"""
)
def srt_pool_rare_first(t: Tables) -> DataFrame:
    df = agg.document_frequency(words(t))
    q = t.benchmark.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("term")).distinct()
    return ranking.rare_first(q.join(df, "term"), "item_id", budget=500).select("item_id", "term", "df")


@query("SELECT * FROM (SELECT 'event' AS what, event_id AS id, ts AS moment FROM events UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders) ORDER BY moment DESC, what, id LIMIT 30")
def srt_latest_activity(t: Tables) -> DataFrame:
    e = t.events.select(F.lit("event").alias("what"), F.col("event_id").alias("id"), F.col("ts").alias("moment"))
    o = t.orders.select(F.lit("order").alias("what"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("moment"))
    return e.unionByName(o).orderBy(F.desc("moment"), "what", "id").limit(30)
