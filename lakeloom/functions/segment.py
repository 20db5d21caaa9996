"""Spaces put back into runs that have lost them, by the most likely words of a corpus."""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that a model keeps (the most frequent), and the longest of them: a bound on what each task holds.
VOCABULARY, LONGEST_WORD = 100_000, 24
#: What each character of a word outside the vocabulary costs.
UNKNOWN_CHAR = math.log(40)
#: More than sums of costs are off by rounding.
NEAR = 1e-6


def word_costs(docs: DataFrame, text: str = "text", vocabulary: int = VOCABULARY) -> dict[str, float]:
    """-ln of each word's share of all words, counted over all documents; what comes to the driver is at most the vocabulary. The cost of '' is that of one unknown word."""
    words = docs.select(F.explode(F.split(F.col(text), r"\s+")).alias("w")).where((F.col("w") != "") & (F.length("w") <= LONGEST_WORD))
    n = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    top = n.orderBy(F.desc("n"), "w").limit(vocabulary).collect()
    return {r.w: -math.log(r.n / total) for r in top} | {"": math.log(total + 1)}


def word_machine(costs: dict[str, float]) -> ahocorasick.Automaton:
    """An automaton that finds all words of a model in one pass over a run."""
    machine = ahocorasick.Automaton()
    for word, cost in costs.items():
        if 0 < len(word) <= LONGEST_WORD:
            machine.add_word(word, (len(word), cost))
    machine.make_automaton()
    return machine


def best_words(run: str, costs: dict[str, float], machine: ahocorasick.Automaton | None = None) -> list[str]:
    """The cheapest way to cut a run into words (Viterbi over its places); of equally cheap last words the shortest.

    Each place looks at the words that end there and at one unknown word, the best that can end there: where it begins is kept as
    the least of a sliding window. machine is word_machine(costs), for those who cut many runs.
    """
    machine = word_machine(costs) if machine is None else machine
    unknown = costs.get("", 0.0)
    best, back = [0.0], [0]
    starts = deque([(0.0, 0)])
    words = machine.iter(run) if len(machine) else iter(())
    last, word = next(words, (-1, None))
    for end in range(1, len(run) + 1):
        if starts[0][1] < end - LONGEST_WORD:
            starts.popleft()
        # Starts that are equally good but for rounding are compared by their whole cost.
        low, at, near = math.inf, 0, starts[0][0] + 3 * NEAR
        for rest, start in starts:
            if rest > near:
                break
            cost = best[start] + (unknown + UNKNOWN_CHAR * (end - start))
            if cost <= low:
                low, at = cost, start
        while last == end - 1:
            start = end - word[0]
            cost = best[start] + word[1]
            if cost < low or (cost == low and start > at):
                low, at = cost, start
            last, word = next(words, (-1, None))
        best.append(low)
        back.append(at)
        rest = low - UNKNOWN_CHAR * end
        while starts and starts[-1][0] > rest + NEAR:
            starts.pop()
        starts.append((rest, end))
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def respace(text: Column, costs: dict[str, float], least: int = 10) -> Column:
    """Runs of ``least`` and more characters without a space get their spaces back; other white space and shorter runs stay. Null stays null."""
    pattern = re.compile(r"\S{%d,}" % least)

    @F.pandas_udf(T.StringType())
    def run_on(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = word_machine(costs)
        for s in batches:
            yield s.map(lambda x: None if x is None else pattern.sub(lambda m: " ".join(best_words(m[0], costs, machine)), x))

    return run_on(text)


def spaces_restored(original: Column, restored: Column) -> Column:
    """(wanted, given, right): how many spaces a text had, has again, and has where they were; other white space counts as text."""

    @F.pandas_udf("wanted int, given int, right int")
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        def places(x: str | None) -> set[int]:
            out, at = set(), 0
            for piece in (x or "").split(" "):
                at += len(piece)
                out.add(at)
            return out - {0, at}

        pairs = [(places(x), places(y)) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame([(len(x), len(y), len(x & y)) for x, y in pairs], columns=["wanted", "given", "right"])

    return compare(original, restored)
