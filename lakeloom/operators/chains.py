"""Chains of training steps down a tree of sections: what a section is asked, on which evidence, with what answer.

All sections of one level are worked on together, from the top down. A step knows the path of
headings, the answers above it and its own text; its answer outlines the sections below it,
each with the first thing that it says, or, at a leaf, lists what the section says. Numbers of an answer that are neither in its
evidence, in its path nor in an answer above are named with the step, so that it can be left out or
given more evidence; they don't count as known further down.

Edge cases: sections with a null or unknown parent are tops; sections in a circle are reached from no top and have no step; a null text
says nothing; headings may repeat, paths may not; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.numbers import numbers_in
from lakeloom.operators.lineage import stored

#: A section's first items that its parent's outline shows, and characters of each.
SHOWN, SHOWN_CHARS = 1, 120


def items_of(text: Column) -> Column:
    """What a text says, sentence by sentence or line by line."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n"), lambda x: F.trim(x)), lambda x: x != "")


def _union(*lists: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*lists)))


def tree_steps(sections: DataFrame, doc: str = "doc_id", path: str = "path", parent: str = "parent", seq: str = "seq", heading: str = "heading", text: str = "text") -> DataFrame:
    """(doc, path, seq, level, kind, node_path, evidence, answer, unsupported): a step for every section with something below it or something to say."""
    s = sections.select(doc, F.col(path).alias("path"), F.col(parent).alias("parent"), F.col(seq).alias("seq"), F.coalesce(heading, F.lit("")).alias("heading"), items_of(F.col(text)).alias("items"))
    line = F.concat("heading", F.when(F.size("items") > 0, F.concat(F.lit(": "), F.substring(F.array_join(F.slice("items", 1, SHOWN), " "), 1, SHOWN_CHARS))).otherwise(""))
    below = s.where("parent is not null and parent <> path").groupBy(doc, F.col("parent").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "path", line.alias("line")))), lambda x: x.line).alias("outline"))
    s = stored(s.join(below, [doc, "path"], "left"))
    tops = s.join(s.select(doc, F.col("path").alias("parent")), [doc, "parent"], "left_anti")
    none = F.array().cast("array<string>")
    level, n, out = tops.select(*s.columns, none.alias("above"), none.alias("known")), 0, None
    while True:
        kind = F.when(F.size("outline") > 0, "outline").when(F.size("items") > 0, "items")
        numbered = F.transform("items", lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x))
        answer = F.array_join(F.when(F.size("outline") > 0, F.transform("outline", lambda x: F.concat(F.lit("- "), x))).otherwise(numbered), "\n")
        node = F.concat("above", F.array("heading"))
        given = _union("known", numbers_in(F.array_join("items", "\n")), numbers_in(F.array_join(node, "\n")))
        # The numbering of items is the answer's own.
        said = F.when(F.size("outline") > 0, numbers_in(F.array_join("outline", "\n"))).otherwise(numbers_in(F.array_join("items", "\n")))
        # What is said again (the answer) is made anew where it is asked for.
        here = level.select(*s.columns, node.alias("node_path"), kind.alias("kind"), said.alias("said"), given.alias("given"))
        here = stored(here.withColumn("unsupported", F.array_sort(F.array_except("said", "given")))).withColumn("answer", answer)
        if here.isEmpty():
            break
        steps = here.where("kind is not null").select(doc, "path", "seq", F.lit(n).alias("level"), "kind", "node_path", F.col("items").alias("evidence"), "answer", "unsupported")
        out = steps if out is None else out.union(steps)
        state = here.select(doc, F.col("path").alias("parent"), F.col("node_path").alias("above"), F.array_except(_union("given", "said"), "unsupported").alias("known"))
        level, n = s.join(state, [doc, "parent"]).select(*s.columns, "above", "known"), n + 1
    if out is None:
        out = here.select(doc, "path", "seq", F.lit(0).alias("level"), "kind", "node_path", F.col("items").alias("evidence"), "answer", "unsupported")
    return out


def sound_chains(steps: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, turns): each document's steps without unsupported numbers as one conversation, level by level; a question states its path, so it can be asked by itself."""
    ask = F.concat(F.array_join("node_path", " > "), F.when(F.size("evidence") > 0, F.concat(F.lit("\n"), F.array_join("evidence", "\n"))).otherwise(""), F.when(F.col("kind") == "outline", "\nWhat does this part consist of?").otherwise("\nWhat does this part say?"))
    turn = F.struct("level", "seq", "path", ask.alias("human"), F.col("answer").alias("gpt"))
    good = steps.where(F.size("unsupported") == 0).groupBy(doc).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return good.select(doc, F.transform("t", lambda x: F.struct(x.human.alias("human"), x.gpt.alias("gpt"))).alias("turns"))
