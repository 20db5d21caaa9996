"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import aggregates as agg
from lakeloom.plans.registry import Tables, query

LINES_SQL = r"SELECT doc_id, CAST(i AS BIGINT) AS seq, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)"
WORDS_SQL = r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS term FROM documents"


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line")).withColumn("seq", (F.col("seq") + 1).cast("long"))


def lines(t: Tables) -> DataFrame:
    """Lines of documents stand in for chunks: (doc_id, seq from 1, line)."""
    return lines_of(t.documents)


def chunk_id() -> F.Column:
    """Number of a line: 16 million lines a document, as many documents as a long holds beside them."""
    return F.col("doc_id") * 16777216 + F.col("seq")


def words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("term")).distinct()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def agg_count_group(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def agg_count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"))


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS docs FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 30")
def agg_having(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("docs")).where("docs >= 30")


@query(
    """SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS closed, CAST(sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS dear,
count(*) AS n FROM orders GROUP BY 1"""
)
def agg_conditional(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("closed"), F.count_if(F.col("o_totalprice") > 200000).alias("dear"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, max(event_id) AS latest, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1")
def agg_minmax_first(t: Tables) -> DataFrame:
    e = t.events
    return e.groupBy("user_id").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max("event_id").alias("latest"), F.max_by("event_type", "event_id").alias("last_type"))


@query(
    """WITH r AS (SELECT p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part)
SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM r WHERE p_type = 'ECONOMY' AND p_size = '10' GROUP BY 2
UNION ALL SELECT 'p_type', p_type, count(*) FROM r WHERE p_brand = 'Brand#2' AND p_size = '10' GROUP BY 2
UNION ALL SELECT 'p_size', p_size, count(*) FROM r WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY' GROUP BY 2"""
)
def agg_facet(t: Tables) -> DataFrame:
    r = t.part.select("p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    return agg.facets(r, {"p_brand": "Brand#2", "p_type": "ECONOMY", "p_size": "10"}, ["p_brand", "p_type", "p_size"])


@query(
    """WITH y AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS y, o_orderpriority AS k FROM orders),
top AS (SELECT k, row_number() OVER (ORDER BY count(*) DESC, k) - 1 AS i FROM y GROUP BY k)
SELECT y, CAST(count(*) FILTER (i = 0) AS BIGINT) AS c_0, CAST(count(*) FILTER (i = 1) AS BIGINT) AS c_1, CAST(count(*) FILTER (i = 2) AS BIGINT) AS c_2, CAST(count(*) FILTER (i > 2) AS BIGINT) AS rest, count(*) AS total
FROM y JOIN top USING (k) GROUP BY y"""
)
def agg_pivot_matrix(t: Tables) -> DataFrame:
    y = t.orders.select(F.year("o_orderdate").cast("long").alias("y"), F.col("o_orderpriority").alias("k"))
    return agg.pivot_top(y, "y", "k", agg.top_values(y, "k", 3))


@query("SELECT n_regionkey AS program, c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)")
def agg_rail(t: Tables) -> DataFrame:
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup(F.col("n_regionkey").alias("program"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 'documents' AS metric, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'chars', sum(n_chars)::DOUBLE FROM documents
UNION ALL SELECT 'events', count(*)::DOUBLE FROM events UNION ALL SELECT 'active_users', count(DISTINCT user_id)::DOUBLE FROM events
UNION ALL SELECT 'errors', (count(*) FILTER (event_type = 'error'))::DOUBLE FROM events UNION ALL SELECT 'conversations', count(DISTINCT conv_id)::DOUBLE FROM conversations
UNION ALL SELECT 'toxic', sum(toxic)::DOUBLE FROM labels UNION ALL SELECT 'good', sum(quality)::DOUBLE FROM labels"""
)
def agg_metrics(t: Tables) -> DataFrame:
    def told(df: DataFrame, **measures) -> DataFrame:
        one = df.agg(*[v.cast("double").alias(k) for k, v in measures.items()])
        return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in measures])).alias("x")).select("x.*")

    out = told(t.documents, documents=F.count(F.lit(1)), chars=F.sum("n_chars"))
    out = out.unionByName(told(t.events, events=F.count(F.lit(1)), active_users=F.countDistinct("user_id"), errors=F.count_if(F.col("event_type") == "error")))
    out = out.unionByName(told(t.conversations, conversations=F.countDistinct("conv_id")))
    return out.unionByName(told(t.labels, toxic=F.sum("toxic"), good=F.sum("quality")))


@query(
    """WITH f AS (SELECT DISTINCT l_returnflag AS g0, strftime(l_shipdate, '%Y-%m') AS g1, CAST(l_quantity AS DECIMAL(38,6)) AS value, l_linestatus AS unit, l_orderkey, l_partkey FROM lineitem),
u AS (SELECT g0, g1, unit, sum(value) AS total, count(*) AS n FROM f GROUP BY 1, 2, 3),
g AS (SELECT g0, g1, sum(n) AS all_n, arg_max(unit, (n, unit)) AS top, max(n) AS top_n FROM u GROUP BY 1, 2),
s AS (SELECT g.g0, g.g1, CASE WHEN top_n >= all_n * 0.6 THEN top ELSE '' END AS unit, sum(u.total) FILTER (top_n < all_n * 0.6 OR u.unit = top) AS total, sum(u.n) FILTER (top_n < all_n * 0.6 OR u.unit = top) AS n, any_value(all_n) AS all_n
      FROM g JOIN u ON g.g0 = u.g0 AND g.g1 = u.g1 GROUP BY g.g0, g.g1, top, top_n, g.all_n)
SELECT g0, g1, unit, CAST(total AS DOUBLE) AS total, CAST(n AS BIGINT) AS n, CAST(all_n - n AS BIGINT) AS off_unit, round(CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) * 100, 1) AS share FROM s"""
)
def agg_fact(t: Tables) -> DataFrame:
    out = agg.fact_aggregate(t.lineitem, [F.col("l_returnflag"), F.date_format("l_shipdate", "yyyy-MM")], F.col("l_quantity"), F.col("l_linestatus"), ["l_orderkey", "l_partkey"])
    return out.withColumn("total", F.col("total").cast("double"))


@query(
    r"""WITH s AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS BIGINT) AS n FROM documents)
SELECT source, sum(n)::BIGINT AS events, CAST(count(*) FILTER (n > 0) AS BIGINT) AS docs FROM s JOIN documents USING (doc_id) GROUP BY source"""
)
def agg_mask_stats(t: Tables) -> DataFrame:
    n = F.regexp_count("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")).cast("long")
    return t.documents.select("source", n.alias("n")).groupBy("source").agg(F.sum("n").alias("events"), F.count_if(F.col("n") > 0).alias("docs"))


@query(f"WITH w AS ({WORDS_SQL}), d AS (SELECT term, count(*) AS df FROM w GROUP BY term) SELECT term, df, round(ln(1 + (SELECT count(*) FROM documents) / (1 + df)), 6) AS idf FROM d")
def agg_term_df_idf(t: Tables) -> DataFrame:
    df = agg.document_frequency(words(t))
    return df.crossJoin(t.documents.agg(F.count(F.lit(1)).alias("n"))).select("term", "df", F.round(agg.idf(F.col("df"), F.col("n")), 6).alias("idf"))


@query(
    f"""WITH w AS (SELECT DISTINCT source, term FROM ({WORDS_SQL}) JOIN documents USING (doc_id)), d AS (SELECT term, count(*) AS df FROM w GROUP BY term)
SELECT term, df FROM d WHERE df >= greatest(3, ceil((SELECT count(DISTINCT source) FROM documents) * 0.05))"""
)
def agg_boilerplate_df(t: Tables) -> DataFrame:
    w = words(t).join(t.documents.select("doc_id", "source"), "doc_id").select("source", "term").distinct()
    return agg.boilerplate_terms(w, "source", "term")


@query(f"WITH l AS ({LINES_SQL}), k AS (SELECT doc_id, regexp_replace(line, '[^가-힣A-Za-z0-9]', '', 'g') AS line FROM l) SELECT doc_id, line, count(*) AS n FROM k WHERE length(line) BETWEEN 2 AND 40 GROUP BY 1, 2 HAVING count(*) >= 3")
def agg_running_heads(t: Tables) -> DataFrame:
    k = lines(t).select("doc_id", F.regexp_replace("line", "[^가-힣A-Za-z0-9]", "").alias("line"))
    return k.where(F.length("line").between(2, 40)).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query(
    """WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM e GROUP BY 1, 2),
n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY 1) SELECT m.label, CAST(i - 1 AS INTEGER) AS i, round(x / (norm + 1e-9), 6) AS x FROM m JOIN n USING (label)"""
)
def agg_mean_vector(t: Tables) -> DataFrame:
    return agg.mean_vectors(t.embeddings, "label").select("label", F.posexplode("mean").alias("i", "x")).withColumn("x", F.round("x", 6))


@query()
def agg_corpus_stats(t: Tables) -> DataFrame:
    return agg.noise_floor(t.embeddings)


@query(
    """WITH m AS (SELECT DISTINCT l_orderkey AS doc, p_brand AS name FROM lineitem JOIN part ON l_partkey = p_partkey), d AS (SELECT name, count(*) AS docs FROM m GROUP BY 1),
p AS (SELECT x.name AS a, y.name AS b, count(*) AS n FROM m x JOIN m y ON x.doc = y.doc AND x.name < y.name GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT a, b, n, round(n / least(da.docs, db.docs), 6) AS share FROM p JOIN d da ON da.name = a JOIN d db ON db.name = b WHERE n / least(da.docs, db.docs) >= 0.02"""
)
def agg_related_share(t: Tables) -> DataFrame:
    m = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc"), F.col("p_brand").alias("name"))
    return agg.co_mentions(m, "doc", "name").withColumn("share", F.round("share", 6))


@query(
    """WITH r AS (SELECT n_name || '/' || c_mktsegment AS path, CASE WHEN c_acctbal > c_nationkey * 400 THEN 'rich' ELSE 'poor' END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey),
x AS (SELECT path, split_part(path, '/', 1) AS folder, label FROM r UNION ALL SELECT path, path, label FROM r),
n AS (SELECT folder, label, count(*) AS n FROM x GROUP BY 1, 2),
c AS (SELECT folder, arg_max(label, (n, label)) AS label FROM n GROUP BY folder HAVING sum(n) >= 3 AND max(n) >= 0.7 * sum(n)),
p AS (SELECT DISTINCT path, folder FROM x)
SELECT path, arg_max(label, length(folder)) AS label FROM p JOIN c USING (folder) GROUP BY path"""
)
def agg_dominant_share(t: Tables) -> DataFrame:
    r = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws("/", "n_name", "c_mktsegment").alias("path"), F.when(F.col("c_acctbal") > F.col("c_nationkey") * 400, "rich").otherwise("poor").alias("label"))
    return agg.dominant_share(r, "path", "label", least=3)


@query(
    """WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1)
SELECT event_type, round(CASE WHEN len(v) % 2 = 1 THEN v[(len(v) + 1) // 2] ELSE (v[len(v) // 2] + v[len(v) // 2 + 1]) / 2 END, 6) AS median, v[least(len(v), CAST(floor(0.9 * len(v)) AS BIGINT) + 1)] AS p90 FROM s"""
)
def agg_percentile(t: Tables) -> DataFrame:
    places = {"a": lambda n: F.floor((n - 1) / 2), "b": lambda n: F.floor(n / 2), "p90": agg.at_share(0.9)}
    return agg.percentiles(t.events, "event_type", "value", places).select("event_type", F.round((F.col("a") + F.col("b")) / 2, 6).alias("median"), "p90")


@query(
    """WITH s AS (SELECT source, sum(quality)::DOUBLE AS h, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1), p AS (SELECT *, h / n AS p, 1.96 * 1.96 AS z2 FROM s)
SELECT source, round((p + z2 / (2 * n)) / (1 + z2 / n) - 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n), 6) AS low,
round((p + z2 / (2 * n)) / (1 + z2 / n) + 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n), 6) AS high FROM p"""
)
def agg_wilson(t: Tables) -> DataFrame:
    s = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("quality").cast("double").alias("h"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = agg.wilson(F.col("h"), F.col("n"))
    return s.select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query()
def agg_bootstrap(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "quality")
    return agg.bootstrap(rows, "lang", "quality")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_grouping_sets(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem GROUP BY 1, 2")
def agg_partial_final(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n"))
