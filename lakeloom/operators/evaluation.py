"""Retrieval and text metrics."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators.aggregates import wilson


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 5, 10), by: tuple[str, ...] = (), qid: str = "qid", item: str = "item") -> DataFrame:
    """(by..., n, mrr, recall_k, ndcg_k): any-hit recall, reciprocal rank and binary nDCG over all queries (those without hits count 0).

    ranked (by..., qid, item, rank from 1), gold (qid, item), queries (by..., qid).
    """
    hit = ranked.join(gold.select(qid, item).distinct(), [qid, item])
    gain = 1 / F.log2(F.col("rank") + 1)
    aggs = [F.min("rank").alias("first")] + [F.sum(F.when(F.col("rank") <= k, gain)).alias(f"dcg_{k}") for k in ks]
    per = hit.groupBy(*by, qid).agg(*aggs)
    size = gold.select(qid, item).distinct().groupBy(qid).agg(F.count(F.lit(1)).alias("gold"))
    j = queries.select(*by, qid).distinct().join(per, [*by, qid], "left").join(size, qid, "left")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.coalesce("gold", F.lit(0)), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = [F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr")]
    for k in ks:
        out.append(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}"))
        out.append(F.avg(F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / ideal(k)).alias(f"ndcg_{k}"))
    return j.groupBy(*by).agg(*out) if by else j.agg(*out)


def loss_causes(gold: DataFrame, stages: dict[str, DataFrame], qid: str = "qid", item: str = "item") -> DataFrame:
    """(cause, n): the first stage (in order) at which no gold item of a query is left; "kept" if all have one."""
    j = gold.select(qid).distinct()
    cause = F.lit("kept")
    for name, df in reversed(stages.items()):
        has = df.select(qid, item).join(gold, [qid, item], "left_semi").select(qid).distinct().withColumn(f"_{name}", F.lit(True))
        j = j.join(has, qid, "left")
        cause = F.when(F.col(f"_{name}").isNull(), f"lost in {name}").otherwise(cause)
    return j.groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def _chrf(hyp: str, ref: str, longest: int = 6, beta: float = 2.0) -> float:
    h, r = (re.sub(r"\s+", "", x or "") for x in (hyp, ref))
    precision, recall = [], []
    for n in range(1, longest + 1):
        a, b = (Counter(s[i : i + n] for i in range(len(s) - n + 1)) for s in (h, r))
        if a and b:
            same = sum((a & b).values())
            precision.append(same / sum(a.values()))
            recall.append(same / sum(b.values()))
    if not precision or not (sum(precision) + sum(recall)):
        return 0.0
    p, q = sum(precision) / len(precision), sum(recall) / len(recall)
    return round(100 * (1 + beta**2) * p * q / (beta**2 * p + q), 2) if p + q else 0.0


def _rouge_l(hyp: str, ref: str) -> float:
    h, r = (hyp or "").split(), (ref or "").split()
    row = [0] * (len(r) + 1)
    for x in h:
        left = 0
        for j, y in enumerate(r, 1):
            up = row[j]
            row[j] = left + 1 if x == y else max(up, row[j - 1])
            left = up
    if not row[-1]:
        return 0.0
    p, q = row[-1] / len(h), row[-1] / len(r)
    return round(100 * 2 * p * q / (p + q), 2)


@F.pandas_udf(T.DoubleType())
def chrf(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """Character n-gram F-score (n to 6, beta 2), 0 to 100."""
    return pd.Series([_chrf(h, r) for h, r in zip(hyp, ref, strict=True)])


@F.pandas_udf(T.DoubleType())
def rouge_l(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """F of the longest common subsequence of words, 0 to 100."""
    return pd.Series([_rouge_l(h, r) for h, r in zip(hyp, ref, strict=True)])


@F.pandas_udf(T.DoubleType())
def ngram_recall(ref: pd.Series, got: pd.Series) -> pd.Series:
    """Share of the reference's character trigrams (spaces aside) that the result has; null for references under three characters."""

    def one(a: str, b: str) -> float | None:
        a, b = (re.sub(r"\s+", "", x or "") for x in (a, b))
        grams = [a[i : i + 3] for i in range(len(a) - 2)]
        have = {b[i : i + 3] for i in range(len(b) - 2)}
        return sum(g in have for g in grams) / len(grams) if grams else None

    return pd.Series([one(a, b) for a, b in zip(ref, got, strict=True)])


def word_f1(rows: DataFrame, key: str, hyp: str, ref: str) -> DataFrame:
    """(key, f1) of word multisets: minima of counts, joined by word."""
    count = lambda c, n: rows.select(key, F.explode(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias(n))
    j = count(F.col(hyp), "h").join(count(F.col(ref), "r"), [key, "w"], "full_outer").groupBy(key)
    s = j.agg(F.sum(F.least(F.coalesce("h", F.lit(0)), F.coalesce("r", F.lit(0)))).alias("both"), F.sum("h").alias("h"), F.sum("r").alias("r"))
    return rows.select(key).distinct().join(s, key, "left").select(key, F.coalesce(2 * F.col("both") / (F.coalesce("h", F.lit(0)) + F.coalesce("r", F.lit(0))), F.lit(0.0)).alias("f1"))


def cer(hyp: Column, ref: Column) -> Column:
    """Edit distance over the reference's length."""
    return F.levenshtein(hyp, ref) / F.greatest(F.length(ref), F.lit(1))


def pairwise(a: Column, b: Column, margin: float = 0.0) -> list[Column]:
    """Counts of wins, ties and losses of a against b."""
    return [F.count_if(a > b + margin).alias("win"), F.count_if(F.abs(a - b) <= margin).alias("tie"), F.count_if(b > a + margin).alias("loss")]


def pairwise_shares(rows: DataFrame, by: str, a: Column, b: Column, margin: float = 0.0) -> DataFrame:
    """(by, win, tie, loss, share, low, high): counts of a against b, a's share of them with ties as halves, and its Wilson interval. Rows without one of the two count for nothing."""
    r = rows.groupBy(by).agg(*pairwise(a, b, margin)).withColumn("n", F.col("win") + F.col("tie") + F.col("loss")).where("n > 0")
    hits = F.col("win") + F.lit(0.5) * F.col("tie")
    low, high = wilson(hits, F.col("n"))
    return r.select(by, "win", "tie", "loss", (hits / F.col("n")).alias("share"), low.alias("low"), high.alias("high"))


def table_cells(got: DataFrame, want: DataFrame, keys: tuple[str, ...] = ("page", "r", "c")) -> DataFrame:
    """(cells, found, equal): how many wanted cells a parser found and read alike."""
    j = want.select(*keys, F.col("text").alias("_w")).join(got.select(*keys, F.col("text").alias("_g")), list(keys), "left")
    return j.agg(F.count(F.lit(1)).alias("cells"), F.count("_g").alias("found"), F.count_if(F.trim("_w") == F.trim("_g")).alias("equal"))


def style(text: Column) -> dict[str, Column]:
    """How a text is written: words a sentence, letters a word, and shares of list lines, digits and questions."""
    sentences = F.filter(F.split(text, r"(?<=[.?!])\s+"), lambda x: F.trim(x) != "")
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    words, letters = F.regexp_count(text, F.lit(r"\S+")), F.length(F.regexp_replace(text, r"\s", ""))
    at_least_one = lambda c: F.greatest(c, F.lit(1))
    return {
        "sentence_words": words / at_least_one(F.size(sentences)),
        "word_letters": letters / at_least_one(words),
        "list_share": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(?:[-*•]|\d{1,2}[.)])\s"))) / at_least_one(F.size(lines)),
        "digit_share": F.regexp_count(text, F.lit("[0-9]")) / at_least_one(letters),
        "question_share": F.size(F.filter(sentences, lambda x: x.rlike(r"\?\s*$"))) / at_least_one(F.size(sentences)),
    }


def style_gap(a: Column, b: Column) -> Column:
    """How differently two texts are written, 0 to 1: the mean over style() of |x - y| / max(x, y), 0 where both are 0."""
    x, y = style(a), style(b)
    gaps = [F.when(F.greatest(x[k], y[k]) > 0, F.abs(x[k] - y[k]) / F.greatest(x[k], y[k])).otherwise(F.lit(0.0)) for k in x]
    return sum(gaps[1:], gaps[0]) / len(gaps)
