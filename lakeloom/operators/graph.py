"""A property graph as two tables: nodes (id, type, label, doc_id) and edges (src, dst, kind, basis, evidence array, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators.joins import equal_pairs
from lakeloom.operators.lineage import cut

#: Steps down that descendants() takes between two checkpoints.
MOST_STEPS = 8

# Bases an edge may rest on, and the limits of what is kept.
BASES = ("구조", "분류", "식별자 일치", "추출", "유사도")
LABEL_CHARS, EVIDENCE_CHARS, EVIDENCE_ITEMS = 300, 240, 5


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """Labels cut, the last row of each id."""
    n = nodes.withColumn("label", F.substring("label", 1, LABEL_CHARS))
    return n.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("updated_at")))).where("_n = 1").drop("_n") if "updated_at" in nodes.columns else n.dropDuplicates(["id"])


def valid_edges(edges: DataFrame) -> DataFrame:
    """Edges of a known basis with evidence (cut to its limits); one row for each (src, dst, kind)."""
    e = edges.where(F.col("basis").isin(*BASES) & (F.size("evidence") > 0))
    cut = F.transform(F.slice("evidence", 1, EVIDENCE_ITEMS), lambda x: F.substring(x, 1, EVIDENCE_CHARS))
    best = F.max_by(F.struct("basis", cut.alias("evidence"), "weight"), F.struct("weight", "basis"))
    return e.groupBy("src", "dst", "kind").agg(best.alias("e")).select("src", "dst", "kind", "e.*")


def rejected_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, kind, why) of edges that aren't valid."""
    why = F.when(~F.coalesce(F.col("basis").isin(*BASES), F.lit(False)), "unknown basis").when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "no evidence")
    return edges.select("src", "dst", "kind", why.alias("why")).where("why is not null")


def undirected(edges: DataFrame) -> DataFrame:
    """One row for each unordered pair and kind."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "kind").agg(F.max("weight").alias("weight"))


def neighbours(center: DataFrame, nodes: DataFrame, edges: DataFrame, allowed: Column | None = None, per_group: int = 20, offset: int = 0) -> DataFrame:
    """(center, kind, dir, type, other, label, weight, total): neighbours in both directions, a page per (kind, dir, type), heaviest first."""
    c = center.select(F.col("id").alias("center"))
    out = c.join(edges, F.col("center") == F.col("src")).select("center", "kind", F.lit("out").alias("dir"), F.col("dst").alias("other"), "weight")
    inn = c.join(edges, F.col("center") == F.col("dst")).select("center", "kind", F.lit("in").alias("dir"), F.col("src").alias("other"), "weight")
    n = nodes if allowed is None else nodes.where(allowed)
    j = out.unionByName(inn).where("other <> center").join(n.select(F.col("id").alias("other"), "type", "label"), "other")
    group = W.partitionBy("center", "kind", "dir", "type")
    j = j.withColumn("total", F.count(F.lit(1)).over(group)).withColumn("_r", F.row_number().over(group.orderBy(F.desc("weight"), "label", "other")))
    return j.where((F.col("_r") > offset) & (F.col("_r") <= offset + per_group)).select("center", "kind", "dir", "type", "other", "label", "weight", "total")


def siblings(edges: DataFrame, kind: str) -> DataFrame:
    """(node, parent, class, links): nodes under one parent by edges of a kind. All of them are siblings of each other, so their pairs are told by the least one under the parent and how many others there are.

    An edge that is repeated counts once; a parent that is null has no nodes.
    """
    e = edges.where(F.col("kind") == kind).select(F.col("src").alias("parent"), F.col("dst").alias("node")).where("parent is not null and node is not null").distinct()
    of = e.groupBy("parent").agg(F.min("node").alias("class"), (F.count(F.lit(1)) - 1).alias("links"))
    return e.join(of, "parent").select("node", "parent", "class", "links")


def sibling_pairs(edges: DataFrame, kind: str) -> DataFrame:
    """(a, b, parent): nodes under one parent by edges of a kind, each ordered pair of different ones."""
    e = edges.where(F.col("kind") == kind).select(F.col("src").alias("parent"), F.col("dst").alias("node"))
    return equal_pairs(e, "node", ["parent"]).where("a <> b").select("a", "b", "parent")


def subtree(nodes: DataFrame, root: str, path: str = "path") -> DataFrame:
    """The node at a materialised path and all below it."""
    return nodes.where((F.col(path) == root) | F.startswith(path, F.lit(root + ".")))


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, depth): each root and everything below it by (src, dst) edges, with the length of the shortest way down.

    Semi-naive rounds without a limit: only what the last round found first is followed further,
    so each (root, id) is followed once, and cycles and many ways to one node cost nothing more. A round
    takes one step at first and ``MOST_STEPS`` later, so that long chains need few checkpoints. Null ends lead nowhere.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    new = cut(roots.select(F.col("id").alias("root"), "id").where("id is not null").distinct().withColumn("depth", F.lit(0)))
    known, depth, steps = new, 0, 1
    while not new.isEmpty():
        step, found = new.where(F.col("depth") == depth), None
        for _ in range(steps):
            step = step.join(e, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id"), F.col("depth") + 1).toDF("root", "id", "depth").distinct()
            found = step if found is None else found.union(step)
        found = found.groupBy("root", "id").agg(F.min("depth").alias("depth"))
        new = cut(found.join(known.select("root", "id"), ["root", "id"], "left_anti"))
        known, depth, steps = known.union(new), depth + steps, min(2 * steps, MOST_STEPS)
    return known


def merge_equal_labels(nodes: DataFrame, edges: DataFrame, type_: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of a type with one label become the one of highest degree; edges are re-pointed, loops and repeats go."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    n = nodes.where(F.col("type") == type_).join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = n.groupBy("label").agg(F.max_by("id", F.struct("degree", F.col("id"))).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    moved = n.join(best, "label").where("id <> keep").select("id", "keep")
    kept = nodes.join(moved, "id", "left_anti")
    point = lambda side: F.coalesce(F.col(f"k{side}.keep"), F.col(side))
    e = edges.join(moved.alias("ksrc"), F.col("src") == F.col("ksrc.id"), "left").join(moved.alias("kdst"), F.col("dst") == F.col("kdst.id"), "left")
    e = e.select(point("src").alias("src"), point("dst").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]).where("src <> dst")
    return kept, e.dropDuplicates(["src", "dst", "kind"])


def schema_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src_type, kind, dst_type, basis, n)."""
    t = nodes.select("id", "type")
    j = edges.join(t.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src").join(t.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst")
    return j.groupBy("src_type", "kind", "dst_type", "basis").agg(F.count(F.lit(1)).alias("n"))


def recurring_titles(sections: DataFrame, least_docs: int = 2, least_chars: int = 6, per_doc: int = 3, key: str = "key", title: str = "title", doc: str = "doc_id") -> DataFrame:
    """(key, label, docs): titles of enough documents; those repeated within one don't count there. The label is the most frequent spelling."""
    s = sections.where(F.length(key) >= least_chars).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(doc, key))).where(F.col("_n") < per_doc)
    spelled = s.groupBy(key, title).agg(F.count(F.lit(1)).alias("c"))
    label = spelled.groupBy(key).agg(F.max_by(title, F.struct("c", title)).alias("label"))
    return s.groupBy(key).agg(F.countDistinct(doc).alias("docs")).where(F.col("docs") >= least_docs).join(label, key).select(key, F.substring("label", 1, 120).alias("label"), "docs")


def audit(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, n): violations of the graph's rules."""
    rules = {
        "edge to a missing node": edges.select(F.explode(F.array("src", "dst")).alias("id")).join(nodes, "id", "left_anti"),
        "loop": edges.where("src = dst"),
        "unknown basis": edges.where(~F.coalesce(F.col("basis").isin(*BASES), F.lit(False))),
        "no evidence": edges.where(F.coalesce(F.size("evidence"), F.lit(0)) <= 0),
        "empty label": nodes.where(F.coalesce(F.trim("label"), F.lit("")) == ""),
        "isolated node": nodes.join(edges.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_anti"),
    }
    out = None
    for rule, bad in rules.items():
        row = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def fingerprint(rows: DataFrame) -> DataFrame:
    """(n, digest): the same for the same rows in any order and partitioning; sums of row hashes combine before the shuffle."""
    h = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest"))


def indicator_observations(cells: DataFrame, table: str = "table_id", year: str = r"(20\d\d)") -> DataFrame:
    """(table, indicator, year, value) from table cells (table, r, c, is_header, text): the year heads the column, the name the row."""
    head = cells.where("is_header").select(table, "c", F.regexp_extract("text", year, 1).alias("year")).where("year <> ''").groupBy(table, "c").agg(F.max("year").alias("year"))
    name = cells.where("c = 0 and not is_header").select(table, "r", F.trim("text").alias("indicator"))
    value = cells.where("c > 0 and not is_header").select(table, "r", "c", F.regexp_replace(F.regexp_extract("text", r"(-?\d[\d,]*(?:\.\d+)?)", 1), ",", "").alias("v")).where("v <> ''")
    return value.join(head, [table, "c"]).join(name, [table, "r"]).select(table, "indicator", F.col("year").cast("int").alias("year"), F.col("v").cast("double").alias("value"))


def ntriples(nodes: DataFrame, edges: DataFrame, base: str = "urn:graph:") -> DataFrame:
    """(line): the graph as N-Triples."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    iri = lambda c: F.concat(F.lit(f"<{base}"), F.url_encode(c), F.lit(">"))
    typed = nodes.select(F.concat(iri(F.col("id")), F.lit(" <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> "), iri(F.col("type")), F.lit(" .")).alias("line"))
    label = nodes.select(F.concat(iri(F.col("id")), F.lit(' <http://www.w3.org/2000/01/rdf-schema#label> "'), esc(F.col("label")), F.lit('" .')).alias("line"))
    link = edges.select(F.concat(iri(F.col("src")), F.lit(" "), iri(F.col("kind")), F.lit(" "), iri(F.col("dst")), F.lit(" .")).alias("line"))
    return typed.union(label).union(link)
