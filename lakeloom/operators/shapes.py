"""Shapes of a graph's nodes, compiled into joins and aggregates that find what doesn't fit; and the schema they state as triples.

Nodes are (id, type, label ...), edges (src, dst, kind). A shape holds for all nodes of its type.

Edge cases: a null value breaks a required property; an edge to a node that isn't there breaks the class of its end;
types without a shape are only named by ``closed`` graphs; empty tables break nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RDF, _RDFS, _XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2001/XMLSchema#"


@dataclass(frozen=True)
class Value:
    """A column of a node: whether it must be there, what it must match, and its datatype."""

    column: str
    required: bool = True
    pattern: str | None = None
    datatype: str = "string"


@dataclass(frozen=True)
class Link:
    """Edges of a kind out of a node (into it, if ``inverse``): how many, and the type at their other end."""

    kind: str
    least: int = 0
    most: int | None = None
    of: str | None = None
    inverse: bool = False

    def name(self) -> str:
        return f"^{self.kind}" if self.inverse else self.kind


@dataclass(frozen=True)
class Shape:
    """What holds for the nodes of a type. closed: no edge out of them has another kind than the links say."""

    type: str
    values: list[Value] = field(default_factory=list)
    links: list[Link] = field(default_factory=list)
    closed: bool = False


VIOLATION = ["shape", "node", "rule", "path", "n"]


def _castable(c: Column, datatype: str) -> Column:
    return F.lit(True) if datatype == "string" else c.cast("string").try_cast(datatype).isNotNull()


def violations(nodes: DataFrame, edges: DataFrame, shapes: list[Shape]) -> DataFrame:
    """(shape, node, rule, path, n): a row for each node and rule that it breaks; n is how many links or values are at fault.

    Links of all shapes are counted in one pass for each direction, and ends are looked up once; every rule is a filter or an anti-join on that.
    """
    typed = nodes.select(F.col("id").alias("node"), F.col("type").alias("shape"))
    e = edges.select("src", "dst", "kind").distinct()
    out: list[DataFrame] = []
    for s in shapes:
        mine = nodes.where(F.col("type") == s.type)
        for v in s.values:
            c = F.col(v.column)
            rules = [("missing", c.isNull() | (F.trim(c.cast("string")) == ""))] if v.required else []
            rules += [("datatype", c.isNotNull() & ~_castable(c, v.datatype))] if v.datatype != "string" else []
            rules += [("pattern", c.isNotNull() & ~c.cast("string").rlike(v.pattern))] if v.pattern else []
            out += [mine.where(bad).select(F.lit(s.type).alias("shape"), F.col("id").alias("node"), F.lit(rule).alias("rule"), F.lit(v.column).alias("path"), F.lit(1).cast("long").alias("n")) for rule, bad in rules]
    for inverse in (False, True):
        near, far = ("dst", "src") if inverse else ("src", "dst")
        links = [(s.type, k) for s in shapes for k in s.links if k.inverse == inverse]
        if not links:
            continue
        at = e.select(F.col(near).alias("node"), F.col(far).alias("other"), "kind").join(typed, "node")
        ends = at.join(typed.select(F.col("node").alias("other"), F.col("shape").alias("end")), "other", "left")
        wanted = F.coalesce(*[F.when((F.col("shape") == t) & (F.col("kind") == k.kind), F.lit(k.of)) for t, k in links])
        counted = ends.groupBy("shape", "node", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(wanted.isNotNull() & ~(F.col("end").eqNullSafe(wanted))).alias("foreign"))
        for t, k in links:
            found = counted.where((F.col("shape") == t) & (F.col("kind") == k.kind))
            row = lambda df, rule, n: df.select(F.lit(t).alias("shape"), "node", F.lit(rule).alias("rule"), F.lit(k.name()).alias("path"), n.cast("long").alias("n"))  # noqa: B023, E731
            if k.most is not None:
                out.append(row(found.where(F.col("n") > k.most), "too many", F.col("n")))
            if k.of is not None:
                out.append(row(found.where("foreign > 0"), "class", F.col("foreign")))
            if k.least:
                own = typed.where(F.col("shape") == t).select("node").join(found.select("node", "n"), "node", "left")
                out.append(row(own.where(F.coalesce("n", F.lit(0)) < k.least), "too few", F.coalesce("n", F.lit(0))))
    for s in (s for s in shapes if s.closed):
        known = [k.kind for k in s.links if not k.inverse]
        odd = e.where(~F.col("kind").isin(known)) if known else e
        odd = odd.join(typed.where(F.col("shape") == s.type), F.col("src") == F.col("node")).groupBy("shape", "node", F.col("kind").alias("path")).agg(F.count(F.lit(1)).alias("n"))
        out.append(odd.select("shape", "node", F.lit("closed").alias("rule"), "path", "n"))
    if not out:
        return typed.select("shape", "node", F.lit("").alias("rule"), F.lit("").alias("path"), F.lit(0).cast("long").alias("n")).where("false")
    return reduce(DataFrame.unionByName, out)


def report(found: DataFrame) -> DataFrame:
    """(shape, rule, path, nodes, n, example): violations by rule."""
    return found.groupBy("shape", "rule", "path").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("n"), F.min("node").alias("example"))


def schema_triples(shapes: list[Shape], base: str = "urn:graph:") -> list[str]:
    """The classes, properties, domains and ranges that shapes state, as sorted N-Triples lines."""
    out = set()
    for s in shapes:
        out.add(f"<{base}{s.type}> <{_RDF}type> <{_RDFS}Class> .")
        for v in s.values:
            kind = {"string": "string", "int": "integer", "long": "integer", "double": "double", "date": "date"}.get(v.datatype, "string")
            out |= {f"<{base}{v.column}> <{_RDF}type> <{_RDF}Property> .", f"<{base}{v.column}> <{_RDFS}domain> <{base}{s.type}> .", f"<{base}{v.column}> <{_RDFS}range> <{_XSD}{kind}> ."}
        for k in s.links:
            start, end = (k.of, s.type) if k.inverse else (s.type, k.of)
            out.add(f"<{base}{k.kind}> <{_RDF}type> <{_RDF}Property> .")
            out |= {f"<{base}{k.kind}> <{_RDFS}{side}> <{base}{t}> ." for side, t in (("domain", start), ("range", end)) if t}
    return sorted(out)
