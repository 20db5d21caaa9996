"""Streaming semantics as batch queries over the event table, and one real stream run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators import datasets, platform
from lakeloom.operators.lineage import scratch
from lakeloom.streaming import batch, events
from lakeloom.plans.q_aggregates import lines
from lakeloom.plans.q_text import REASONS_SQL
from lakeloom.plans.registry import Tables, query


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def st_op_dedup(t: Tables) -> DataFrame:
    return batch.first_of_operation(t.events, ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", "event_id")


def _requests(t: Tables) -> DataFrame:
    """Events as requests for the fields of documents: a kind of event on a day is a field."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    field = F.concat_ws("/", "event_type", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"))
    return t.events.select(field.alias("field"), F.col("user_id").cast("string").alias("user"), at.alias("at"), F.col("event_id").alias("seq"), "value", F.col("props").alias("text"))


@query()
def st_lease(t: Tables) -> DataFrame:
    return batch.leases(_requests(t).select("field", "user", "at"))


@query()
def st_version(t: Tables) -> DataFrame:
    n = F.row_number().over(W.partitionBy("field").orderBy("at", "seq"))
    e = _requests(t).withColumn("base", n - F.when(F.col("value") > 90, 3).otherwise(1)).select("field", "seq", "at", "base", "text")
    return batch.versions(e)


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def st_presence(t: Tables) -> DataFrame:
    p = batch.presence(t.events, gap=1800)
    return p.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query()
def st_debounce(t: Tables) -> DataFrame:
    # Ten minutes of the table count as a second of typing.
    return batch.write_backs(_requests(t).select("field", (F.col("at") / 600).alias("at")))


@query("SELECT event_id, event_type FROM events WHERE event_id > 900 - 50")
def st_cursor(t: Tables) -> DataFrame:
    return events.since(t.events, 900, 50).select("event_id", "event_type")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def st_retention(t: Tables) -> DataFrame:
    return events.retained(t.events, F.col("user_id"), 5, [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_daily_counts(t: Tables) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    """WITH c AS (SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS b FROM events), s AS (SELECT event_type, unnest([b - INTERVAL 5 MINUTE, b]) AS start FROM c)
SELECT start, event_type, count(*) AS n FROM s GROUP BY 1, 2"""
)
def st_sliding(t: Tables) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "10 minutes", "5 minutes")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def st_incremental_sync(t: Tables) -> DataFrame:
    """The event file as a stream, applied in micro-batches to a table until nothing is left."""
    spark = t.spark
    out = scratch(spark, "sync")
    schema = t.events.schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    # A batch that is run again overwrites what it wrote.
    events.sync(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/table/batch={n}"), f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


# --- small data operators of the platform -------------------------------------------------------------------------


@query("SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS requests, round(sum(value), 4) AS tokens FROM events GROUP BY 1, 2")
def act_collect(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("value"), 4).alias("tokens"))


@query("SELECT o_orderkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND year(o_orderdate) = 1996 AND c_mktsegment = 'BUILDING' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def prj_browse(t: Tables) -> DataFrame:
    o = t.orders.where((F.col("o_orderstatus") == "F") & (F.year("o_orderdate") == 1996))
    j = o.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
    return j.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice", "c_mktsegment")


@query(
    """SELECT part, arg_min(role, p) AS role FROM (SELECT l_partkey AS part, CASE WHEN l_discount > 0.09 AND l_quantity > 45 THEN 0 WHEN l_tax > 0.07 AND l_quantity > 45 THEN 1 ELSE 2 END AS p, CASE WHEN l_discount > 0.09 AND l_quantity > 45 THEN 'attachment' WHEN l_tax > 0.07 AND l_quantity > 45 THEN 'reference' ELSE 'criteria' END AS role FROM lineitem) GROUP BY 1"""
)
def doc_three_way(t: Tables) -> DataFrame:
    """Each document once, in its strongest role."""
    big = F.col("l_quantity") > 45
    attached, referred = big & (F.col("l_discount") > 0.09), big & (F.col("l_tax") > 0.07)
    j = t.lineitem.select(F.col("l_partkey").alias("part"), F.when(attached, 0).when(referred, 1).otherwise(2).alias("p"), F.when(attached, "attachment").when(referred, "reference").otherwise("criteria").alias("role"))
    return j.groupBy("part").agg(F.min_by("role", "p").alias("role"))


@query(
    """WITH k AS (SELECT l_orderkey AS tbl, CASE WHEN l_quantity > 25 THEN 'number' WHEN l_discount > 0.05 THEN 'percent' WHEN l_tax > 0.06 THEN 'empty' ELSE 'text' END AS kind FROM lineitem), c AS (SELECT tbl, kind, count(*) AS n FROM k GROUP BY 1, 2)
SELECT tbl, arg_max(kind, (n, kind)) AS kind, CAST(sum(n) AS BIGINT) AS cells FROM c GROUP BY 1"""
)
def tbl_classify(t: Tables) -> DataFrame:
    said = F.when(F.col("l_quantity") > 25, F.format_number("l_quantity", 2)).when(F.col("l_discount") > 0.05, F.concat(F.lit(" "), F.format_number(F.col("l_discount") * 100, 0), F.lit(" %"))).when(F.col("l_tax") > 0.06, " ").otherwise(F.col("l_returnflag"))
    return platform.classify_tables(t.lineitem.select(F.col("l_orderkey").alias("tbl"), platform.cell_kind(said).alias("kind")), "tbl")


@query("WITH c AS (SELECT p_type, p_size, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_type, arg_max(p_size, (n, p_size)) AS style, max(n) AS n FROM c GROUP BY 1 HAVING sum(n) >= 20 AND max(n) >= 0.02 * sum(n)")
def tbl_style_mode(t: Tables) -> DataFrame:
    return platform.usual_style(t.part.withColumnRenamed("p_size", "style"), "p_type", "style", least=20, share=0.02)


@query("WITH c AS (SELECT role, length(text) % 7 AS font, sum(length(text)) AS chars FROM conversations GROUP BY 1, 2) SELECT role, CAST(arg_max(font, (chars, font)) AS INTEGER) AS font FROM c GROUP BY 1")
def role_style_mode(t: Tables) -> DataFrame:
    c = t.conversations.withColumn("font", F.length("text") % 7)
    return platform.usual_style(c, "role", "font", F.length("text")).drop("n")


@query("SELECT o_orderpriority AS heading, CASE WHEN o_totalprice < 50000 THEN 'no evidence' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'filled' END AS cause, count(*) AS n FROM orders GROUP BY 1, 2")
def gap_causes(t: Tables) -> DataFrame:
    return platform.gap_causes(t.orders.withColumnRenamed("o_orderpriority", "heading"), "heading", F.col("o_totalprice") >= 50000, F.col("o_orderstatus") == "P")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 're%' OR p_type LIKE 'RE%' OR p_name LIKE '%re%' ORDER BY CASE WHEN p_name LIKE 're%' THEN 0 WHEN p_type LIKE 'RE%' THEN 1 ELSE 2 END, p_name, p_partkey LIMIT 20")
def suggest_prefix(t: Tables) -> DataFrame:
    rank = F.when(F.startswith("p_name", F.lit("re")), 0).when(F.startswith("p_type", F.lit("RE")), 1).when(F.contains("p_name", F.lit("re")), 2)
    return t.part.withColumn("r", rank).where("r is not null").orderBy("r", "p_name", "p_partkey").limit(20).select("p_partkey", "p_name")


@query("WITH l AS (SELECT doc_id, i AS seq, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)), k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY seq) AS prev FROM l) SELECT doc_id, count(*) AS n FROM k WHERE line = prev AND trim(line) <> '' GROUP BY 1")
def fix_repeat_lines(t: Tables) -> DataFrame:
    from lakeloom.plans.q_aggregates import lines

    prev = F.lag("line").over(W.partitionBy("doc_id").orderBy("seq"))
    return lines(t).withColumn("prev", prev).where("line = prev and trim(line) <> ''").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {REASONS_SQL}, a AS (SELECT doc_id, count(*) FILTER (t <> '') AS n, CAST(floor(median(sub) FILTER (t <> '')) AS BIGINT) AS mid, count(*) FILTER (len(list_filter(reasons, lambda x: x NOT IN ('thin', 'low_text'))) > 0) / count(*) AS noise FROM r GROUP BY 1),
i AS (SELECT *, CASE WHEN n = 0 THEN ['no text'] ELSE list_filter([CASE WHEN mid < 40 THEN 'fragmented' END, CASE WHEN noise >= 0.5 THEN 'noisy' END], lambda x: x IS NOT NULL) END AS issues FROM a)
SELECT doc_id, n AS n_chunks, mid AS median, round(noise, 6) AS noise, array_to_string(issues, ',') AS issues, CASE WHEN n = 0 THEN 3 WHEN mid < 40 THEN 2 ELSE 1 END AS severity FROM i WHERE len(issues) > 0"""
)
def ing_audit(t: Tables) -> DataFrame:
    """Lines as chunks; none of these tables has a bad text layer, which the tests make."""
    a = datasets.ingest_audit(lines(t), text="line")
    return a.select("doc_id", "n_chunks", "median", F.round("noise", 6).alias("noise"), F.array_join("issues", ",").alias("issues"), "severity")


@query("SELECT event_type, round(median(value), 6) AS value, round(median(event_id), 6)::DOUBLE AS id FROM events GROUP BY 1")
def tok_timing(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("value"), F.round(F.median("event_id"), 6).alias("id"))


@query(
    """WITH s AS (SELECT user_id, ts, value, avg(value) OVER w AS recent, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING))
SELECT user_id, CASE WHEN recent > 2 * first THEN 'diverging' WHEN recent < first THEN 'improving' ELSE 'flat' END AS status FROM s WHERE r = 1"""
)
def train_judge(t: Tables) -> DataFrame:
    return platform.training_status(t.events, "user_id", ["ts", "event_id"], "value")


@query(
    """WITH c AS (SELECT source, count(*) AS chunks FROM documents GROUP BY 1), i AS (SELECT source, count(*) AS indexed, bool_or(changed) AS changed FROM (SELECT source, source = 'src1' AND doc_id % 7 = 0 AS changed FROM documents WHERE source <> 'src2' OR doc_id % 5 <> 0) GROUP BY 1)
SELECT source, chunks, coalesce(indexed, 0) AS indexed, changed OR chunks <> coalesce(indexed, 0) AS stale FROM c LEFT JOIN i USING (source)"""
)
def stale_index(t: Tables) -> DataFrame:
    """One source has lost documents since, another has changed ones."""
    d = t.documents.select("source", "doc_id", F.md5("text").alias("digest"))
    old = d.where("source <> 'src2' or doc_id % 5 <> 0").withColumn("digest", F.when((F.col("source") == "src1") & (F.col("doc_id") % 7 == 0), F.lit("old")).otherwise(F.col("digest")))
    return platform.stale_indexes(d, old, "source", "digest")


@query("WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier), b AS (SELECT 'r1' AS id UNION ALL SELECT dst FROM b JOIN e ON src = id) SELECT DISTINCT id FROM b")
def hier_covered(t: Tables) -> DataFrame:
    from lakeloom.operators import graph

    e = t.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")).union(t.supplier.select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey")))
    roots = t.spark.sql("SELECT 'r1' AS id")
    return graph.descendants(e, roots).select("id")


@query(
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'mine' || substr(text, length(split_part(text, chr(10), 1)) + 1) WHEN 1 THEN 'mine' || chr(10) || text || chr(10) || 'theirs' ELSE text || chr(10) || 'both' END AS text, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS conflicts FROM documents"""
)
def merge3(t: Tables) -> DataFrame:
    """Both sides change the first line; one adds at the top and one at the end; both add the same."""
    from lakeloom.functions.text import merge_three

    first = F.length(F.substring_index("text", "\n", 1))
    rest = F.col("text").substr(first + 1, F.length("text"))
    kind = F.col("doc_id") % 3
    mine = F.when(kind == 0, F.concat(F.lit("mine"), rest)).when(kind == 1, F.concat(F.lit("mine\n"), "text")).otherwise(F.concat("text", F.lit("\nboth")))
    theirs = F.when(kind == 0, F.concat(F.lit("theirs"), rest)).when(kind == 1, F.concat("text", F.lit("\ntheirs"))).otherwise(F.concat("text", F.lit("\nboth")))
    return t.documents.select("doc_id", merge_three("text", mine, theirs).alias("m")).select("doc_id", "m.text", F.size("m.conflicts").alias("conflicts"))
