"""Queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import ranking
from lakeloom.sources import documents as docs
from lakeloom.sources import sinks
from lakeloom.operators.lineage import dealt, scratch
from lakeloom.plans.registry import Tables, query


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'")
def src_jsonl(t: Tables) -> DataFrame:
    """JSON lines parsed with a fixed schema and cut to a time range."""
    e = t.events.where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")))
    return e.select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.k")


@query()
def src_html(t: Tables) -> DataFrame:
    return t.pages.select("page_id", docs.html_text("html").alias("text"))


@query(
    """WITH g(r, c, rowspan, colspan, is_header) AS (VALUES (0, 0, 1, 2, true), (0, 2, 2, 1, true), (1, 0, 1, 1, false), (1, 1, 1, 1, false), (2, 0, 1, 1, false), (2, 1, 1, 1, false), (2, 2, 1, 1, false))
SELECT p_partkey, 0 AS table_no, r, c, rowspan, colspan, is_header, CASE WHEN (r, c) = (0, 0) THEN p_brand WHEN (r, c) = (0, 2) THEN p_type WHEN (r, c) = (1, 0) THEN p_name WHEN (r, c) = (1, 1) THEN CAST(p_size AS VARCHAR) WHEN (r, c) = (2, 0) THEN '' WHEN (r, c) = (2, 1) THEN 'a & b' ELSE 'last' END AS text FROM part, g
UNION ALL SELECT p_partkey, 1, 0, 0, 1, 1, false, 'inner' FROM part WHERE p_size > 25"""
)
def src_html_table(t: Tables) -> DataFrame:
    """Cells with spans, entities, missing end tags and, for some, a table within a cell."""
    inner = F.when(F.col("p_size") > 25, "<table><tr><td>inner</table>").otherwise("")
    html = F.concat(
        F.lit("<p>x</p><TABLE><tr><th colspan=2>"), "p_brand", F.lit("</th><th rowspan='2'> "), "p_type", F.lit("</th></tr><tr><td>"), "p_name", F.lit("<td>"), F.col("p_size").cast("string"),
        F.lit("</td></tr><tr><td></td><td>a &amp;\n b</td><td>"), inner, F.lit("last</td></tr></TABLE><td>outside</td>"),
    )
    part = dealt(t.part.select("p_partkey", "p_brand", "p_type", "p_name", "p_size"))
    return docs.html_tables(part.select("p_partkey", html.alias("html")), "p_partkey")


@query(
    """SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'zip' WHEN 3 THEN 'gzip' WHEN 4 THEN 'xml' WHEN 5 THEN 'text' WHEN 6 THEN 'ole' WHEN 7 THEN 'unknown' WHEN 8 THEN 'empty' ELSE CASE WHEN regexp_matches(lower(substr(html, 1, 300)), '^\\s*(?:<!doctype html|<html)') THEN 'html' ELSE 'text' END END AS format FROM pages""".replace("\\\\", "\\")
)
def src_sniff(t: Tables) -> DataFrame:
    """Pages behind the first bytes of other formats, and as they are."""
    heads = ("255044462D", "89504E470D0A1A0A", "504B030414", "1F8B08", None, None, "D0CF11E0A1B11AE1", "0001020304")
    page, kind = F.encode("html", "UTF-8"), F.col("page_id") % 10
    content = F.when(kind == 8, F.unhex(F.lit(""))).otherwise(page)
    for k, head in enumerate(heads):
        if head:
            content = F.when(kind == k, F.concat(F.unhex(F.lit(head)), page)).otherwise(content)
    content = F.when(kind == 4, F.concat(F.encode(F.lit(" <?xml version='1.0'?>"), "UTF-8"), page)).when(kind == 5, F.concat(F.encode(F.lit("so: "), "UTF-8"), page)).otherwise(content)
    return t.pages.select("page_id", docs.sniff(content).alias("format"))


@query("SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS first_mean FROM embeddings GROUP BY 1")
def src_vectors(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.element_at("embedding", 1).cast("double")), 6).alias("first_mean"))


@query(
    """WITH c AS (SELECT c_custkey AS id, c_mktsegment AS seg FROM customer WHERE c_mktsegment <> 'BUILDING'), i AS (SELECT c_custkey AS id, 'new ' || c_mktsegment AS seg FROM customer WHERE c_nationkey >= 12)
SELECT * FROM c WHERE id NOT IN (SELECT id FROM i) UNION ALL SELECT * FROM i"""
)
def snk_upsert(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), "c_nationkey")
    new = c.where("c_nationkey >= 12").select("id", F.concat(F.lit("new "), "seg").alias("seg"))
    return sinks.upsert(c.where("seg <> 'BUILDING'").select("id", "seg"), new, ["id"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderstatus = 'P'")
def snk_replace_child(t: Tables) -> DataFrame:
    new = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return sinks.replace_children(t.lineitem.select("l_orderkey", "l_linenumber"), new, "l_orderkey")


@query("SELECT 'documents' AS name, lang AS split, count(*) AS rows, 'doc_id:bigint,lang:string,n_chars:bigint' AS fields FROM documents GROUP BY lang")
def snk_jsonl_zip(t: Tables) -> DataFrame:
    """Written as compressed lines, a folder for each language; the rows are those read back from the files."""
    folder = scratch(t.spark, "export")
    told = sinks.export_json(t.documents.select("doc_id", "lang", "n_chars"), folder, "documents", "lang")
    back = sinks.read_export(t.spark, folder, "documents").groupBy(F.col("lang").alias("split")).agg(F.count("doc_id").alias("rows"))
    return told.drop("rows").join(back, "split").select("name", "split", "rows", "fields")


@query("SELECT o_orderdate, o_orderkey, o_totalprice FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1998-01-01', 0) ORDER BY o_orderdate, o_orderkey LIMIT 100")
def snk_csv_keyset(t: Tables) -> DataFrame:
    """All orders written as CSV in order of their keys; a page is read from the files."""
    folder, keys = scratch(t.spark, "csv"), ["o_orderdate", "o_orderkey"]
    sinks.export_csv(t.orders.select("o_orderdate", "o_orderkey", "o_totalprice"), folder, keys)
    back = sinks.read_csv(t.spark, folder, "o_orderdate timestamp, o_orderkey bigint, o_totalprice double")
    return ranking.keyset_page(back, keys, ("1998-01-01 00:00:00", 0), 100)


@query("SELECT page_id, CAST(strlen(html) AS BIGINT) AS size, sha256(html) AS sha256, 'intact' AS state FROM pages")
def snk_bundle(t: Tables) -> DataFrame:
    """Pages written as artefacts with a manifest, read back and held against it."""
    folder = scratch(t.spark, "bundle")
    sinks.export_bundle(t.pages.select("page_id", F.encode("html", "UTF-8").alias("content")), folder, path="page_id")
    return sinks.check_bundle(t.spark, folder, path="page_id")


@query()
def mig_digest(t: Tables) -> DataFrame:
    out = None
    for name in ("customer", "orders", "part"):
        d = sinks.table_digest(getattr(t, name)).select(F.lit(name).alias("name"), "rows", "digest")
        out = d if out is None else out.unionByName(d)
    return out
