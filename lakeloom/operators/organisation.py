"""A dictionary of organisational units read from rules: who is placed under whom, under which names.

Rules say it in a few forms of sentence (fixed values below): units are founded under a parent or directly under a head, a unit
is renamed, a name is followed by an alias or a former name in brackets. Names that one
unit has had become its last one. Each sentence of a document is a vote for a
parent; every unit takes the parent with most votes (then the latest document, then the least name), and
where that closes a circle, its weakest link gives way to the unit's next choice, until the units form a forest.

Edge cases: null and empty texts say nothing; a unit is never under itself; repeated sentences
of one document are one vote; a circle of renamings is named by its least name; units without a parent are
roots; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators.lineage import cut, stored

# Forms of the sentences, and kinds by how a name ends (longer endings first).
FOUNDED = r"(?:^|\s)([^\s,]+?)(?:에는|에|\s+직속으로)\s+([^.\n]+?)(?:을|를)\s*(?:두며|두고|둔다|두어|두되|둘\s*수)"
RENAMED = r"([0-9A-Za-z가-힣·_-]+?)(?:을|를)\s+([0-9A-Za-z가-힣·_-]+?)(?:으로|로)\s+(?:명칭을\s+)?(?:변경|개칭)"
ITEMS = r",\s*|\s+및\s+|\s+또는\s+"
NAME, BRACKET = r"^([^()]+?)\s*(?:\(|$)", r"\(([^()]*)\)"
FORMER = r"^\s*(?:구|옛|종전)\s*[:：]?\s*"
KINDS = {"위원회": "위원회", "본부": "본부", "센터": "센터", "학과": "학과·계열", "계열": "학과·계열", "처": "처·국", "국": "처·국", "실": "실", "단": "단", "원": "원·관", "관": "원·관", "팀": "팀", "부": "부", "과": "과"}


def kind_of(name: Column) -> Column:
    out = F.lit("기관")
    for ending in sorted(KINDS, key=len):
        out = F.when(F.endswith(name, F.lit(ending)), KINDS[ending]).otherwise(out)
    return out


def statements(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, parent, unit) of what is founded, and (doc, old, new, what) of names, as two kinds of rows: said, a, b. said is under, former, alias or renamed."""
    t = F.coalesce(F.col(text), F.lit(""))
    pairs = lambda pattern: F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("b"))
    founded = docs.select(doc, F.explode(pairs(FOUNDED)).alias("x")).select(doc, F.col("x.a").alias("parent"), F.explode(F.split("x.b", ITEMS)).alias("item"))
    founded = founded.select(doc, "parent", F.trim(F.regexp_extract("item", NAME, 1)).alias("unit"), F.explode_outer(F.regexp_extract_all("item", F.lit(BRACKET), F.lit(1))).alias("note")).where("unit <> ''")
    under = founded.select(doc, F.lit("under").alias("said"), F.col("unit").alias("a"), F.col("parent").alias("b")).where("a <> b")
    old = F.col("note").rlike(FORMER)
    noted = founded.where(F.trim("note") != "").select(doc, F.when(old, "former").otherwise("alias").alias("said"), F.trim(F.regexp_replace("note", FORMER, "")).alias("a"), F.col("unit").alias("b"))
    renamed = docs.select(doc, F.explode(pairs(RENAMED)).alias("x")).select(doc, F.lit("renamed").alias("said"), F.col("x.a").alias("a"), F.col("x.b").alias("b"))
    return under.union(noted.where("a <> '' and a <> b")).union(renamed.where("a <> b")).distinct()


def _ends(step: DataFrame) -> DataFrame:
    """(node, end, low) of (node, next): where following next from each node ends, by jumps of doubling length. A circle has no end (null); low is its least node.

    Jumps are stored as tables: a checkpoint keeps Spark's estimate of its size, a product at every join, and the digits of that number double with every jump.
    """
    ends = stored(step.select("node", F.col("next").alias("end"), F.least("node", "next").alias("low")))
    n, length = ends.count(), 1
    while length <= n:
        on = ends.select(F.col("node").alias("end"), F.col("end").alias("far"), F.col("low").alias("far_low"))
        ends = ends.join(on, "end", "left").select("node", F.coalesce("far", "end").alias("end"), F.least("low", F.coalesce("far_low", "low")).alias("low"))
        ends, length = stored(ends), 2 * length
    loops = ends.select(F.col("node").alias("end"), F.lit(True).alias("loop"))
    return ends.join(loops, "end", "left").select("node", F.when(F.col("loop").isNull(), F.col("end")).alias("end"), F.col("end").alias("last"), "low")


def last_names(said: DataFrame) -> DataFrame:
    """(name, unit): for each name that has been given up, the one that its unit bears now. Of several new names the one said in the latest document counts."""
    r = said.where("said in ('renamed', 'former')").groupBy(F.col("a").alias("node")).agg(F.max_by("b", F.struct("doc_id", "b")).alias("next"))
    e = _ends(r)
    # Circles, and what leads into them, bear the least name of the circle: that of the place where the jumps have come to.
    least = e.select(F.col("node").alias("last"), F.col("low").alias("circle"))
    return e.join(least, "last", "left").select(F.col("node").alias("name"), F.coalesce("end", "circle").alias("unit")).where("name <> unit")


def forest(votes: DataFrame) -> DataFrame:
    """(unit, parent, votes) from (unit, parent, votes, latest): each unit's best parent such that nobody is above themselves."""
    order = [F.desc("votes"), F.desc("latest"), F.asc("parent")]
    left = cut(votes.where("unit <> parent"))
    # Who is above nobody is on no circle and keeps the best parent; rounds only look at the others.
    above = left.select(F.col("parent").alias("unit")).distinct()
    first = F.row_number().over(W.partitionBy("unit").orderBy(*order))
    leaves = left.join(above, "unit", "left_anti").withColumn("_n", first).where("_n = 1").select("unit", "parent", "votes")
    left = cut(left.join(above, "unit", "left_semi"))
    while True:
        best = cut(left.withColumn("_n", F.row_number().over(W.partitionBy("unit").orderBy(*order))).where("_n = 1").drop("_n"))
        e = _ends(best.select(F.col("unit").alias("node"), F.col("parent").alias("next")))
        # The nodes of a circle are those that jumps of more than all nodes' number come to.
        on_circle = cut(e.where("end is null").select(F.col("last").alias("unit")).distinct())
        if on_circle.isEmpty():
            return leaves.union(best.select("unit", "parent", "votes"))
        # A circle is told by its least node: every other one's jumps go round it.
        circle = e.select(F.col("node").alias("unit"), F.col("low").alias("circle")).join(on_circle, "unit", "left_semi").join(best, "unit")
        weakest = circle.withColumn("_n", F.row_number().over(W.partitionBy("circle").orderBy("votes", "latest", F.desc("unit")))).where("_n = 1").select("unit", "parent")
        left = cut(left.join(weakest, ["unit", "parent"], "left_anti"))


def unit_dictionary(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(unit, kind, parent, path, aliases, former, votes) of all units that docs speak of; path is the names from the root down."""
    said = cut(statements(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))))
    now = cut(last_names(said))
    by = lambda c: now.select(F.col("name").alias(c), F.col("unit").alias(f"_{c}"))
    own = said.join(by("a"), "a", "left").join(by("b"), "b", "left")
    under = own.where("said = 'under'").select("doc_id", F.coalesce("_a", "a").alias("unit"), F.coalesce("_b", "b").alias("parent")).where("unit <> parent")
    tree = forest(under.groupBy("unit", "parent").agg(F.countDistinct("doc_id").alias("votes"), F.max("doc_id").alias("latest")))
    tree = cut(tree)
    named = own.where("said <> 'under'").select(F.coalesce("_b", "b").alias("unit"))
    units = under.select("unit").union(under.select(F.col("parent").alias("unit"))).union(named).distinct()
    alias = own.where("said = 'alias'").select(F.coalesce("_b", "b").alias("unit"), "a").groupBy("unit").agg(F.sort_array(F.collect_set("a")).alias("aliases"))
    former = now.groupBy("unit").agg(F.sort_array(F.collect_set("name")).alias("former"))
    rows = units.join(tree, "unit", "left").join(alias, "unit", "left").join(former, "unit", "left")
    none = F.array().cast("array<string>")
    rows = cut(rows.select("unit", kind_of(F.col("unit")).alias("kind"), "parent", F.coalesce("aliases", none).alias("aliases"), F.coalesce("former", none).alias("former"), F.coalesce("votes", F.lit(0)).cast("long").alias("votes")))
    level = cut(rows.where("parent is null").select("unit", F.array("unit").alias("path")))
    paths = level
    while not level.isEmpty():
        above = level.select(F.col("unit").alias("parent"), F.col("path").alias("up"))
        level = cut(rows.select("unit", "parent").join(above, "parent").select("unit", F.concat("up", F.array("unit")).alias("path")))
        paths = paths.union(level)
    return rows.join(paths, "unit").select("unit", "kind", "parent", "path", "aliases", "former", "votes")
