"""Joins with a rule: neighbours, intervals, section alignment, listings, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.operators.lineage import cut, stored
from lakeloom.operators.similarity import bigram_join, contains_join, fingerprint, gram_hashes, jaccard_between, shingles, sieve, sifted_hashes
from lakeloom.operators.windows import grouped_fold


def following(hits: DataFrame, chunks: DataFrame, doc: str = "doc_id", seq: str = "seq", ahead: int = 6) -> DataFrame:
    """(doc, seq, next) for the chunks of (seq, seq + ahead] behind each hit: an equi-join on (doc, bucket of seq).

    Buckets of ``ahead`` sequence numbers turn the range into at most two equal keys.
    """
    h = hits.select(doc, seq, F.explode(F.array(F.floor(F.col(seq) / ahead), F.floor(F.col(seq) / ahead) + 1)).alias("_b"))
    c = chunks.select(doc, F.col(seq).alias("next"), F.floor(F.col(seq) / ahead).alias("_b"))
    return h.join(c, [doc, "_b"]).where((F.col("next") > F.col(seq)) & (F.col("next") <= F.col(seq) + ahead)).select(doc, seq, "next")


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """Points with the intervals of their key that hold them; both ends included."""
    return points.join(intervals, on).where(F.col(at).between(F.col(start), F.col(end)))


def align_sections(a: DataFrame, b: DataFrame, least_key: int = 4) -> DataFrame:
    """(pair, a_path, b_path, depth): sections of two documents with one title.

    Rows are (pair, path, title_key, ancestors array, nearest first). A title that is unique on both sides
    pairs at once (depth -1). A repeated one goes to the candidate with the
    longest common start of ancestors (at most three); no link at depth 0 or on a tie,
    and a section of b is used once.
    """
    a, b = (x.where(F.length("title_key") >= least_key) for x in (a, b))
    one = W.partitionBy("pair", "title_key")
    x = a.withColumn("na", F.count(F.lit(1)).over(one)).select("pair", "title_key", F.col("path").alias("a_path"), F.slice("ancestors", 1, 3).alias("aa"), "na")
    y = b.withColumn("nb", F.count(F.lit(1)).over(one)).select("pair", "title_key", F.col("path").alias("b_path"), F.slice("ancestors", 1, 3).alias("ba"), "nb")
    j = x.join(y, ["pair", "title_key"])
    same = [F.coalesce(F.get("aa", F.lit(i)) == F.get("ba", F.lit(i)), F.lit(False)) for i in range(3)]
    depth = F.when(same[0] & same[1] & same[2], 3).when(same[0] & same[1], 2).when(same[0], 1).otherwise(0)
    j = j.withColumn("depth", F.when((F.col("na") == 1) & (F.col("nb") == 1), -1).otherwise(depth)).where("depth <> 0")
    best_a, best_b = W.partitionBy("pair", "a_path"), W.partitionBy("pair", "b_path")
    j = j.withColumn("top", F.max("depth").over(best_a)).where("depth = top").withColumn("ties", F.count(F.lit(1)).over(best_a)).where("ties = 1")
    j = j.withColumn("turn", F.row_number().over(best_b.orderBy(F.desc("depth"), "a_path"))).where("turn = 1")
    return j.select("pair", "a_path", "b_path", "depth")


def diff_listings(old: DataFrame, new: DataFrame, classes: list[str]) -> DataFrame:
    """(rel, change, old_rel): added, changed, moved, removed or reclassified, from two listings (rel, size, mtime, classes...).

    Moved: exactly one removed and one added file share (name, size, mtime).
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    o = old.select(F.col("rel").alias("o_rel"), F.col("size").alias("o_size"), F.col("mtime").alias("o_mtime"), F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in classes]).alias("o_class"))
    n = new.select(F.col("rel").alias("n_rel"), F.col("size").alias("n_size"), F.col("mtime").alias("n_mtime"), F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in classes]).alias("n_class"))
    j = o.join(n, F.col("o_rel") == F.col("n_rel"), "full_outer")
    both = F.col("o_rel").isNotNull() & F.col("n_rel").isNotNull()
    differs = (F.col("o_size") != F.col("n_size")) | (F.col("o_mtime") != F.col("n_mtime"))
    kind = F.when(both & differs, "changed").when(both & (F.col("o_class") != F.col("n_class")), "reclassified").when(both, "same").when(F.col("o_rel").isNull(), "added").otherwise("removed")
    j = j.withColumn("change", kind)
    rel = F.coalesce("n_rel", "o_rel")
    lone = j.where(F.col("change").isin("added", "removed")).select(rel.alias("rel"), "change", name(rel).alias("name"), F.coalesce("n_size", "o_size").alias("size"), F.coalesce("n_mtime", "o_mtime").alias("mtime"))
    sig = W.partitionBy("name", "size", "mtime")
    lone = lone.withColumns({"a": F.count_if(F.col("change") == "added").over(sig), "r": F.count_if(F.col("change") == "removed").over(sig), "from": F.max(F.when(F.col("change") == "removed", F.col("rel"))).over(sig)})
    moved = (F.col("a") == 1) & (F.col("r") == 1)
    lone = lone.where(~(moved & (F.col("change") == "removed"))).select("rel", F.when(moved, "moved").otherwise(F.col("change")).alias("change"), F.when(moved, F.col("from")).alias("old_rel"))
    rest = j.where(F.col("change").isin("changed", "reclassified")).select(rel.alias("rel"), "change", F.lit(None).cast("string").alias("old_rel"))
    return lone.unionByName(rest)


def relink_gold(golds: DataFrame, chunks: DataFrame, gold_id: str = "gold_id", chunk_id: str = "chunk_id", text: str = "text", gram: int = 8) -> DataFrame:
    """(gold_id, chunk_id): chunks that now hold a gold text, by shared character grams.

    Fixed values of the rule: a chunk counts when it covers .6 of the gold, or .6 of
    it lies in the gold and it has half of the best chunk's overlap; nothing counts unless the best
    has .2 of the gold and one of its two covers reaches .5; the best is kept if no other is.

    Grams are hashes in one array for each text, so sizes need no counting; those that no gold has
    fall through a sieve where they are read, or in a semi-join before anything is shuffled.
    """
    g = golds.select(gold_id, gram_hashes(F.col(text), gram, short=True).alias("_h")).where(F.size("_h") > 0)
    g = g.select(gold_id, F.size("_h").alias("ng"), F.explode("_h").alias("h"))
    c = chunks.select(chunk_id, sifted_hashes(F.col(text), gram, sieve(g), short=True).alias("_s"))
    c = c.select(chunk_id, F.col("_s.n").alias("nc"), F.explode("_s.h").alias("h")).join(g.select("h").distinct(), "h", "left_semi")
    hits = g.join(c, "h").groupBy(gold_id, chunk_id, "ng", "nc").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(gold_id)
    hits = hits.withColumns({"cg": F.col("n") / F.col("ng"), "cc": F.col("n") / F.col("nc"), "r": F.row_number().over(w.orderBy(F.desc("n"), chunk_id)), "best": F.max("n").over(w)})
    hits = hits.withColumn("sound", F.max(F.when(F.col("r") == 1, (F.col("n") >= 0.2 * F.col("ng")) & (F.greatest("cg", "cc") >= 0.5))).over(w)).where("sound")
    hits = hits.withColumn("own", (F.col("cg") >= 0.6) | ((F.col("cc") >= 0.6) & (F.col("n") >= 0.5 * F.col("best"))))
    return hits.withColumn("any", F.max("own").over(w)).where(F.col("own") | (~F.col("any") & (F.col("r") == 1))).select(gold_id, chunk_id)


def provenance(lines: DataFrame, chunks: DataFrame, line: str = "line", chunk_id: str = "chunk_id", text: str = "text", piece: int = 40, least: int = 14) -> DataFrame:
    """lines with chunk_id: the first chunk with the whole line, else one that has its first ``piece`` characters of substance within a line, else its last.

    Lines shorter than that count as a piece from ``least`` characters on. Whole lines meet as equal
    fingerprints, pieces by contains_join(); each line of the chunks is one row, however often it occurs.
    """
    k = chunks.select(chunk_id, F.explode(F.split(text, "\n")).alias("_l")).select(chunk_id, fingerprint(F.col("_l")).alias("_f")).where("_f <> ''")
    whole = cut(k.groupBy("_f").agg(F.min(chunk_id).alias("_c")))
    f, long_ = F.col("_f"), F.length("_f") >= piece
    asked = lines.withColumn("_f", fingerprint(F.col(line)))
    asked = asked.withColumns({"_p1": F.when(long_, F.substring(f, 1, piece)).when(F.length(f) >= least, f), "_p2": F.when(long_, F.substring(f, -piece, piece))})
    probes = asked.select(F.explode(F.array("_p1", "_p2")).alias("_p")).where("_p is not null").distinct().select("_p", F.col("_p").alias("_n"))
    bodies = whole.select("_f", F.col("_f").alias("_b"))
    held = contains_join(probes, bodies, "_p", "_n", "_f", "_b", gram=least).join(whole, "_f").groupBy("_p").agg(F.min("_c").alias("_h"))
    held = cut(held)
    first, last = held.select(F.col("_p").alias("_p1"), F.col("_h").alias("_h1")), held.select(F.col("_p").alias("_p2"), F.col("_h").alias("_h2"))
    out = asked.join(whole, "_f", "left").join(first, "_p1", "left").join(last, "_p2", "left")
    return out.withColumn(chunk_id, F.coalesce("_c", "_h1", "_h2")).drop("_f", "_p1", "_p2", "_c", "_h1", "_h2")


def best_by_words(sections: DataFrame, aspects: DataFrame, least: int = 1) -> DataFrame:
    """(aspect, section, shared): the section with the most words of each aspect; rows are (section, word) and (aspect, word)."""
    asked = aspects.distinct()
    # Words that no aspect has go where they are read; a section's words are then brought together once, so that pairs of an aspect and a section aren't shuffled.
    s = sections.join(asked.select("word").distinct(), "word", "left_semi").repartition("section").distinct()
    n = s.join(asked, "word").groupBy("aspect", "section").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    return n.groupBy("aspect").agg(F.min_by(F.struct("section", "shared"), F.struct(-F.col("shared"), "section")).alias("b")).select("aspect", "b.*")


def equal_classes(rows: DataFrame, item: str, keys: list[str]) -> DataFrame:
    """(item, class, links): a self-join on equal keys links all rows of a key with each other, so its pairs are told by the least item of the key and a count.

    A row with a null among its keys is linked with none and a class of its own.
    """
    of = rows.groupBy(*keys).agg(F.min(item).alias("_least"), F.count(F.lit(1)).alias("_rows"))
    j = rows.select(item, *keys).join(of, keys, "left")
    return j.select(item, F.coalesce("_least", item).alias("class"), F.coalesce(F.col("_rows") - 1, F.lit(0)).cast("long").alias("links"))


#: Rows of a key that meet the key's others in one place.
PAIR_BLOCK = 2_000


def equal_pairs(rows: DataFrame, item: str, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(keys..., a, b): every two rows with equal keys, both ways round, and each with itself; rows with a null among their keys are nobody's.

    The result has the square of a key's rows. A key's rows are dealt into blocks by hash and each block meets all of them in
    a place of its own, so a large key is the work of many tasks, and what moves is the rows once for each block.
    """
    rows = rows.select(*keys, F.col(item).alias("_i")).dropna(subset=keys)
    rows = cut(rows.join(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).alias("_of")), keys))
    left = rows.select(*keys, F.col("_i").alias(a), F.pmod(F.xxhash64("_i"), F.col("_of")).alias("_block"))
    right = rows.select(*keys, F.col("_i").alias(b), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)).alias("_block"))
    return left.join(right, [*keys, "_block"]).select(*keys, a, b)


def unnumbered(title: Column | str) -> Column:
    """A title without the number at its start."""
    return F.regexp_replace(title, r"^\s*[0-9]+(?:[.)-][0-9]*)*\s*", "")


def key_of(title: Column) -> Column:
    """Comparison key of a title: numbering, spaces and signs gone, lower case."""
    return F.lower(F.regexp_replace(unnumbered(title), "[^가-힣A-Za-z0-9]", ""))


def _word_weights(sections: DataFrame, word: str = "word") -> DataFrame:
    n = sections.select("pair", "side", "path").distinct().groupBy("pair").agg(F.count(F.lit(1)).alias("bags"))
    df = sections.select("pair", "side", "path", word).distinct().groupBy("pair", word).agg(F.count(F.lit(1)).alias("df"))
    return df.join(n, "pair").select("pair", word, F.log((F.col("bags") + 1) / (F.col("df") + F.lit(0.5))).alias("w"))


def weighted_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair, a_path, b_path, body): idf-weighted Jaccard of section words; rows are (pair, path, word). Pairs of sections meet on shared words."""
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    w = _word_weights(both)
    x = a.distinct().join(w, ["pair", "word"])
    y = b.distinct().join(w, ["pair", "word"])
    shared = x.select("pair", "word", "w", F.col("path").alias("a_path")).join(y.select("pair", "word", F.col("path").alias("b_path")), ["pair", "word"]).groupBy("pair", "a_path", "b_path").agg(F.sum("w").alias("s"))
    na, nb = x.groupBy("pair", F.col("path").alias("a_path")).agg(F.sum("w").alias("na")), y.groupBy("pair", F.col("path").alias("b_path")).agg(F.sum("w").alias("nb"))
    j = shared.join(na, ["pair", "a_path"]).join(nb, ["pair", "b_path"])
    return j.select("pair", "a_path", "b_path", (F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))).alias("body"))


def best_with_margin(scored: DataFrame, score: str, accept: float, margin: float, ratio: float = 1.0) -> DataFrame:
    """(pair, a_path, b_path, score): the best b of each a, if it reaches accept, leads the second by the margin and the ratio; each b once, for its best a."""
    w = W.partitionBy("pair", "a_path").orderBy(F.desc(score), "b_path")
    s = scored.withColumn("second", F.coalesce(F.lead(score).over(w), F.lit(0.0))).withColumn("r", F.row_number().over(w)).where("r = 1")
    s = s.where((F.col(score) >= accept) & (F.col(score) - F.col("second") >= margin) & (F.col(score) >= ratio * F.col("second")))
    return s.withColumn("k", F.row_number().over(W.partitionBy("pair", "b_path").orderBy(F.desc(score), "a_path"))).where("k = 1").select("pair", "a_path", "b_path", F.col(score).alias("score"))


def align_by_content(a: DataFrame, b: DataFrame, accept: float = 0.2, margin: float = 0.05, ratio: float = 2.0) -> DataFrame:
    """Sections aligned by their bodies alone."""
    return best_with_margin(weighted_overlap(a, b), "body", accept, margin, ratio)


#: A title that often within one document says little by itself; then parents must agree, bodies weigh more and must overlap.
GENERIC_FROM, GENERIC_PARENT, GENERIC_BODY = 3, 0.5, 0.15
_LINK = "pair {pair}, a_path {path}, b_path {path}, score double, generic boolean"


def _bigrams(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))


def _alike(p: Column, q: Column) -> Column:
    return F.size(F.array_intersect(_bigrams(p), _bigrams(q))) / F.size(F.array_union(_bigrams(p), _bigrams(q)))


def align_by_context(a: DataFrame, b: DataFrame, titles_a: DataFrame, titles_b: DataFrame, accept: float = 0.25, margin: float = 0.08) -> DataFrame:
    """(pair, a_path, b_path, score): sections of one title, aligned by their ancestors' titles and their bodies.

    titles rows: (pair, path, parent, title_key, ancestors array of titles, nearest first); a and b rows: (pair, path, word). An
    ancestor level weighs .6, .3 or .1 and overlaps by character bigrams; two sections at the top agree wholly. A score is half
    ancestors, half bodies, and every pair that reaches ``accept`` is linked. A title that one document has three times or more is
    generic: nearest ancestors must overlap by half, bodies count .7 and must overlap by .15, links are one to one, best first,
    and each must lead what rivals are left by the margin. A generic link whose parents bear one title holds only while the
    parents are linked; links are taken away until that is so everywhere. Sections without words on both sides have no score.
    """
    side = lambda t, s: t.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("pair", "title_key"))).select(
        "pair", "title_key", F.col("path").alias(f"{s}_path"), F.col("parent").alias(f"{s}_parent"), F.col("ancestors").alias(f"{s}a"), F.col("_n").alias(f"{s}n")
    )
    x, y = side(titles_a, "a"), side(titles_b, "b")
    j = x.join(y, ["pair", "title_key"]).where("title_key <> ''").join(weighted_overlap(a, b), ["pair", "a_path", "b_path"], "left")
    worded = lambda w, s: w.select("pair", F.col("path").alias(f"{s}_path")).distinct().withColumn(f"{s}w", F.lit(True))
    j = j.join(worded(a, "a"), ["pair", "a_path"], "left").join(worded(b, "b"), ["pair", "b_path"], "left")
    total, weight = F.lit(0.0), F.lit(0.0)
    for i, w in enumerate((0.6, 0.3, 0.1)):
        p, q = F.get("aa", F.lit(i)), F.get("ba", F.lit(i))
        there = p.isNotNull() & q.isNotNull()
        total, weight = total + F.when(there, w * _alike(p, q)).otherwise(0.0), weight + F.when(there, w).otherwise(0.0)
    top = (F.size("aa") == 0) & (F.size("ba") == 0)
    up = F.when(top, 1.0).when(weight > 0, total / weight).otherwise(0.0)
    near = F.when(top, 1.0).when((F.size("aa") > 0) & (F.size("ba") > 0), _alike(F.get("aa", F.lit(0)), F.get("ba", F.lit(0)))).otherwise(0.0)
    body = F.coalesce("body", F.lit(0.0))
    generic = (F.col("an") >= GENERIC_FROM) | (F.col("bn") >= GENERIC_FROM)
    score = F.when(F.col("aw").isNull() & F.col("bw").isNull(), 0.0).when(~generic, 0.5 * up + 0.5 * body).when((near >= GENERIC_PARENT) & (body >= GENERIC_BODY), 0.3 * up + 0.7 * body).otherwise(0.0)
    scored = cut(j.select("pair", "title_key", "a_path", "b_path", "a_parent", "b_parent", score.alias("score"), generic.alias("generic")).where(F.col("score") > 0))

    def best_first(rows: list[dict]) -> list[tuple]:
        out, used_a, used_b = [], set(), set()
        rows = sorted(rows, key=lambda r: (-r["score"], r["a_path"], r["b_path"]))
        for r in rows:
            p, q = r["a_path"], r["b_path"]
            if r["score"] < accept or p in used_a or q in used_b:
                continue
            rival = max((o["score"] for o in rows if (o["a_path"] == p) != (o["b_path"] == q) and o["a_path"] not in used_a and o["b_path"] not in used_b), default=0.0)
            if r["score"] - rival >= margin:
                used_a.add(p)
                used_b.add(q)
                out.append((r["pair"], p, q, r["score"], True))
        return out

    kinds = dict(titles_a.dtypes)
    # A group is one title in one pair of documents.
    group = F.concat_ws("\x1f", F.col("pair").cast("string"), "title_key")
    chosen = grouped_fold(scored.where("generic").select(group.alias("_g"), "pair", "a_path", "b_path", "score"), "_g", ["a_path", "b_path"], _LINK.format(pair=kinds["pair"], path=kinds["path"]), best_first)
    links = scored.where(F.col("generic") == F.lit(False)).where(F.col("score") >= accept).select("pair", "a_path", "b_path", "score", "generic").union(chosen)
    titled = lambda t, s: t.select("pair", F.col("path").alias(f"{s}_parent"), F.col("title_key").alias(f"{s}_title"))
    parents = scored.select("pair", "a_path", "b_path", "a_parent", "b_parent").join(titled(titles_a, "a"), ["pair", "a_parent"]).join(titled(titles_b, "b"), ["pair", "b_parent"])
    parents = parents.where("a_title = b_title and a_title <> ''").select("pair", "a_path", "b_path", "a_parent", "b_parent")
    links = cut(links.join(parents, ["pair", "a_path", "b_path"], "left"))
    bound = links.where("generic and a_parent is not null")
    held = links.select("pair", F.col("a_path").alias("a_parent"), F.col("b_path").alias("b_parent"))
    # Only links below one that has just gone can go next.
    gone = cut(bound.join(held, ["pair", "a_parent", "b_parent"], "left_anti").select("pair", "a_path", "b_path"))
    last = gone
    while not last.isEmpty():
        above = last.select("pair", F.col("a_path").alias("a_parent"), F.col("b_path").alias("b_parent"))
        last = cut(bound.join(above, ["pair", "a_parent", "b_parent"], "left_semi").select("pair", "a_path", "b_path").join(gone, ["pair", "a_path", "b_path"], "left_anti"))
        gone = gone.union(last)
    return links.join(gone, ["pair", "a_path", "b_path"], "left_anti").select("pair", "a_path", "b_path", "score")


def greedy_pairs(scored: DataFrame, a: str = "a", b: str = "b", score: str = "score") -> DataFrame:
    """One-to-one pairs of (a, b, score), as taking the best pair left (highest score, then least a, then least b) again and again gives them.

    Each round takes every pair that is the best of both its ends, which the sequential rule would take too, and drops what they exclude;
    what is left shrinks by rounds, and no group is ever held by a task.
    """
    left, taken = stored(scored.select(a, b, score).where(F.col(score).isNotNull()).groupBy(a, b).agg(F.max(score).alias(score))), None
    while not left.isEmpty():
        order = [F.desc(score), a, b]
        ranked = left.withColumns({"_i": F.row_number().over(W.partitionBy(a).orderBy(*order)), "_j": F.row_number().over(W.partitionBy(b).orderBy(*order))})
        now = cut(ranked.where("_i = 1 and _j = 1").select(a, b, score))
        taken = now if taken is None else taken.union(now)
        left = stored(left.join(now.select(a), a, "left_anti").join(now.select(b), b, "left_anti"))
    return left if taken is None else taken


def match_titles(left: DataFrame, right: DataFrame, least: float = 0.6, left_id: str = "left", right_id: str = "right", title: str = "title", gram: int = 2) -> DataFrame:
    """(left_id, right_id, score): rows of two tables matched one to one by title.

    Equal keys (numbering, spaces, signs and case don't count) go first, in order of ids, with score 1; what is
    left is matched by the Jaccard overlap of character bigrams, from ``least`` on, best first. Titles without a key match nothing; an id is one row's.
    """
    l, r = (t.select(i, key_of(F.col(title)).alias("_k")).where("_k <> ''") for t, i in ((left, left_id), (right, right_id)))
    nth = lambda t, i: t.withColumn("_n", F.row_number().over(W.partitionBy("_k").orderBy(i)))
    equal = cut(nth(l, left_id).join(nth(r, right_id), ["_k", "_n"]).select(left_id, right_id, F.lit(1.0).alias("score")))
    rest = lambda t, i: t.join(equal.select(i), i, "left_anti").select(i, "_k")
    if gram == 2:
        near = bigram_join(rest(l, left_id), rest(r, right_id), left_id, right_id, "_k", least)
    else:
        grams = lambda t, i: rest(t, i).select(i, F.explode(shingles(F.col("_k"), gram)).alias("_g"))
        near = jaccard_between(grams(l, left_id), grams(r, right_id), left_id, right_id, "_g", least)
    return equal.union(greedy_pairs(near.withColumnRenamed("jaccard", "score"), left_id, right_id))


def match_ledger(ledger: DataFrame, cards: DataFrame, entry: str = "entry", card: str = "card", name: str = "name", acronym: str = "acronym", start: str = "start", end: str = "end") -> DataFrame:
    """(entry, card, by): the card of each ledger entry (name, acronym, start, end): one that bears its name, else its acronym, in years that meet the entry's.

    Names compare without numbering, spaces and signs; an open year meets any. Two cards that
    answer equally well leave the entry without one (by = ambiguous), none at all gives no row.
    """
    keys = lambda df, who: df.select(
        F.col(who), F.col(start).alias("_from"), F.col(end).alias("_to"), F.explode(F.array(F.struct(F.lit(1).alias("grade"), key_of(F.col(name)).alias("key")), F.struct(F.lit(2).alias("grade"), F.upper(acronym).alias("key")))).alias("k")
    ).select(who, "_from", "_to", "k.*").where("key <> ''")
    e = keys(ledger, entry)
    c = keys(cards, card).select(card, "grade", "key", F.col("_from").alias("_since"), F.col("_to").alias("_until"))
    meets = (F.coalesce("_from", "_until", F.lit(0)) <= F.coalesce("_until", F.lit(9999))) & (F.coalesce("_since", "_to", F.lit(0)) <= F.coalesce("_to", F.lit(9999)))
    hit = e.join(c, ["grade", "key"]).where(meets).groupBy(entry, "grade").agg(F.min(card).alias("a"), F.max(card).alias("b"))
    best = hit.groupBy(entry).agg(F.min_by(F.struct("a", "b"), "grade").alias("x"), F.min("grade").alias("grade"))
    one = F.col("x.a") == F.col("x.b")
    return best.select(entry, F.when(one, F.col("x.a")).alias(card), F.when(~one, "ambiguous").when(F.col("grade") == 1, "name").otherwise("acronym").alias("by"))
