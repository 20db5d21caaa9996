"""Scans, projections, filters and set operations (orders with their customers stand in for a document ledger)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators import access, filters
from lakeloom.plans.registry import Tables, query

LEDGER_SQL = """
SELECT o.o_orderkey AS id, c.c_mktsegment AS dept, CAST(o.o_custkey AS VARCHAR) AS owner,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'owner' WHEN '2-HIGH' THEN 'dept' WHEN '3-MEDIUM' THEN 'dept' WHEN '5-LOW' THEN NULL ELSE 'public' END AS access_level,
       CASE o.o_orderstatus WHEN 'F' THEN 'regulation' WHEN 'O' THEN 'plan' ELSE 'report' END AS doc_type,
       CASE WHEN c.c_acctbal < 0 THEN 'student' END AS audience, o.o_orderstatus AS kind, o.o_totalprice AS price, o.o_orderdate AS at
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""


def ledger(t: Tables) -> DataFrame:
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.col("c_mktsegment").alias("dept"),
        F.col("o_custkey").cast("string").alias("owner"),
        F.when(p == "1-URGENT", "owner").when(p.isin("2-HIGH", "3-MEDIUM"), "dept").when(p == "5-LOW", F.lit(None)).otherwise("public").alias("access_level"),
        F.when(s == "F", "regulation").when(s == "O", "plan").otherwise("report").alias("doc_type"),
        F.when(F.col("c_acctbal") < 0, "student").alias("audience"),
        s.alias("kind"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
    )


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_quantity < 10")
def src_table_scan(t: Tables) -> DataFrame:
    return t.lineitem.where((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") < 10)).select("l_orderkey", "l_linenumber", "l_quantity")


def _who(sql: str) -> str:
    return f"WITH d AS ({LEDGER_SQL}) SELECT id FROM d WHERE {sql}"


STAFF = access.Viewer("staff", "BUILDING", "7", also=("MACHINERY",), lent=("FURNITURE",))


@query(_who("coalesce(access_level, 'public') = 'public' OR owner = '7' OR (access_level = 'dept' AND dept IN ('공통', 'BUILDING', 'MACHINERY', 'FURNITURE'))"))
def flt_access_doc(t: Tables) -> DataFrame:
    return ledger(t).where(access.visible(STAFF)).select("id")


@query(_who("coalesce(access_level, 'public') = 'public' AND doc_type = 'regulation' AND audience = 'student'"))
def flt_access_student(t: Tables) -> DataFrame:
    return ledger(t).where(access.visible(access.Viewer("student"))).select("id")


@query(_who("owner = '7' OR (coalesce(access_level, '') <> 'owner' AND dept IN ('BUILDING', 'MACHINERY'))"))
def flt_can_edit(t: Tables) -> DataFrame:
    return ledger(t).where(access.can_edit(STAFF)).select("id")


@query(_who("kind NOT IN ('P') AND (coalesce(access_level, 'public') = 'public' OR owner = '7' OR (access_level = 'dept' AND dept IN ('AUTOMOBILE')))"))
def flt_access_grant(t: Tables) -> DataFrame:
    return ledger(t).where(access.search_filter(["AUTOMOBILE"], "7", ["P"])).select("id")


@query(
    f"""WITH d AS ({LEDGER_SQL}) SELECT l.l_orderkey AS doc_id, l.l_linenumber AS seq, l.l_partkey AS part FROM lineitem l
WHERE l.l_orderkey IN (SELECT id FROM d WHERE dept = 'BUILDING' AND coalesce(access_level, 'public') IN ('public', 'dept'))"""
)
def flt_access_chunk(t: Tables) -> DataFrame:
    open_ = ledger(t).where((F.col("dept") == "BUILDING") & F.coalesce("access_level", F.lit("public")).isin("public", "dept")).select("id")
    return t.lineitem.join(open_, F.col("l_orderkey") == F.col("id"), "left_semi").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"))


@query(
    """WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS usr, c_mktsegment AS dept, CASE WHEN c_acctbal > 5000 THEN 3 WHEN c_acctbal > 0 THEN 2 ELSE 1 END AS grade FROM customer),
m AS (SELECT usr, grade, dept FROM a UNION SELECT usr, grade, '공통' FROM a),
g(owner_dept, to_dept) AS (VALUES ('FURNITURE', 'BUILDING'), ('MACHINERY', 'AUTOMOBILE'), ('HOUSEHOLD', 'BUILDING')),
e AS (SELECT * FROM m UNION SELECT m.usr, m.grade, g.owner_dept FROM m JOIN g ON m.dept = g.to_dept),
x(dept, min_grade) AS (VALUES ('FURNITURE', 3), ('MACHINERY', 2)),
k AS (SELECT e.* FROM e LEFT JOIN x ON e.dept = x.dept WHERE x.min_grade IS NULL OR e.grade >= x.min_grade)
SELECT usr AS "user", string_agg(dept, ',' ORDER BY dept) AS depts FROM k GROUP BY usr"""
)
def flt_rag_scope(t: Tables) -> DataFrame:
    b = F.col("c_acctbal")
    accounts = t.customer.select(F.col("c_custkey").cast("string").alias("user"), F.col("c_mktsegment").alias("dept"), F.lit(None).cast("array<string>").alias("also"), F.when(b > 5000, 3).when(b > 0, 2).otherwise(1).alias("grade"))
    grants = t.spark.sql("SELECT * FROM VALUES ('FURNITURE', 'BUILDING'), ('MACHINERY', 'AUTOMOBILE'), ('HOUSEHOLD', 'BUILDING') AS g(owner_dept, to_dept)")
    least = t.spark.sql("SELECT * FROM VALUES ('FURNITURE', 3), ('MACHINERY', 2) AS x(dept, min_grade)")
    return access.scopes(accounts, grants, least).select("user", F.array_join("depts", ",").alias("depts"))


@query(
    """SELECT c_custkey AS id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE '공통' END AS dept,
CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN CASE WHEN c_acctbal < 0 THEN 'owner' ELSE 'dept' END ELSE CASE WHEN c_acctbal < 0 THEN 'owner' ELSE 'public' END END AS access_level FROM customer"""
)
def prj_classify_access(t: Tables) -> DataFrame:
    wanted = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment")).alias("wanted_dept"), F.when(F.col("c_acctbal") < 0, "owner").otherwise("unknown").alias("wanted_level"))
    return access.classify_intake(wanted).select("id", "dept", "access_level")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion')")
def flt_like_terms(t: Tables) -> DataFrame:
    return t.documents.where(filters.all_terms(F.col("text"), "The tion")).select("doc_id")


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://')")
def flt_prefix(t: Tables) -> DataFrame:
    return t.pages.where(filters.prefix(F.col("url"), "https://")).select("page_id", "url")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def flt_json_path(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.where(k >= 50).select("event_id", k.alias("k"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'registered'
WHEN o_orderpriority = '5-LOW' THEN 'excluded' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'waiting' END AS state FROM orders"""
)
def prj_case_state(t: Tables) -> DataFrame:
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct().withColumn("done", F.lit(True))
    j = t.orders.join(done, F.col("o_orderkey") == F.col("k"), "left")
    state = F.when(F.col("done"), "registered").when(F.col("o_orderpriority") == "5-LOW", "excluded").when(F.col("o_orderstatus") == "P", "failed").otherwise("waiting")
    return j.select(F.col("o_orderkey").alias("id"), state.alias("state"))


@query(
    """SELECT p_partkey FROM part WHERE p_type NOT LIKE 'SMALL%' AND p_type NOT LIKE 'PROMO%'
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)"""
)
def flt_original(t: Tables) -> DataFrame:
    cleaned = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 45").select("l_partkey")
    kept = t.part.where(~F.startswith("p_type", F.lit("SMALL")) & ~F.startswith("p_type", F.lit("PROMO")))
    return kept.join(cleaned, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query(
    """SELECT p_partkey, CASE WHEN p_size < 5 THEN 'too small' WHEN p_retailprice > 1500 THEN 'too dear' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'brand closed' ELSE '' END AS reason FROM part"""
)
def prj_exclusion_reason(t: Tables) -> DataFrame:
    r = F.when(F.col("p_size") < 5, "too small").when(F.col("p_retailprice") > 1500, "too dear").when(F.col("p_brand").isin("Brand#1", "Brand#2"), "brand closed").otherwise("")
    return t.part.select("p_partkey", r.alias("reason"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders WHERE year(o_orderdate) BETWEEN 2000 AND 2001")
def flt_plausible_year(t: Tables) -> DataFrame:
    y = F.year("o_orderdate").cast("long")
    return t.orders.where(filters.plausible_year(y, 1999)).select("o_orderkey", y.alias("y"))


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-16'")
def flt_period(t: Tables) -> DataFrame:
    return t.events.where(filters.period(F.col("ts").cast("timestamp"), "7d", date(2024, 1, 15))).select("event_id", "user_id")


@query("SELECT c.c_custkey, coalesce(sum(o.o_totalprice), 0)::DOUBLE AS spent, coalesce(max(o.o_orderpriority), '(none)') AS priority FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
def prj_coalesce(t: Tables) -> DataFrame:
    j = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("spent"), F.coalesce(F.max("o_orderpriority"), F.lit("(none)")).alias("priority"))


@query(
    """SELECT p_partkey, p_brand FROM part WHERE (p_size BETWEEN 10 AND 30) AND (p_type LIKE '%UM' OR p_type LIKE '%ARD')
AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.05)"""
)
def flt_business(t: Tables) -> DataFrame:
    used = t.lineitem.where("l_discount >= 0.05").select("l_partkey")
    chip = F.col("p_size").between(10, 30) & (F.endswith("p_type", F.lit("UM")) | F.endswith("p_type", F.lit("ARD")))
    return t.part.where(chip).join(used, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


# --- set operations -----------------------------------------------------------------------------


@query("SELECT n_nationkey AS src, n_regionkey AS dst FROM nation UNION ALL SELECT n_regionkey, n_nationkey FROM nation")
def set_union_all(t: Tables) -> DataFrame:
    out = t.nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"))
    return out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def set_distinct(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_type").distinct()


@query(
    """WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS f, list(DISTINCT l_linestatus) AS g FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CAST(len(list_intersect(f, ['A', 'R'])) AS BIGINT) AS both_, len(f) = len(list_intersect(f, ['A', 'R'])) AS inside, CAST(len(list_distinct(list_concat(f, g))) AS BIGINT) AS either FROM s"""
)
def set_py_ops(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"), F.collect_set("l_linestatus").alias("g"))
    wanted = F.array(F.lit("A"), F.lit("R"))
    return s.select("l_orderkey", F.size(F.array_intersect("f", wanted)).cast("long").alias("both_"), (F.size(F.array_except("f", wanted)) == 0).alias("inside"), F.size(F.array_union("f", "g")).cast("long").alias("either"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select(F.col("s_nationkey").alias("k")))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def set_except(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("k")).subtract(t.lineitem.where("l_quantity > 40").select(F.col("l_partkey").alias("k")))
