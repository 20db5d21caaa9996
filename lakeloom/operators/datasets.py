"""Training data: conversations, quality gate, splits, leakage, contamination, cases, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.functions import numbers
from lakeloom.functions import text as tx
from lakeloom.operators.joins import key_of
from lakeloom.operators.similarity import contains_join

#: What a reviewer must have checked.
REVIEW_CHECKS = ("grounding", "structure", "context", "privacy")
SHORTEST_ANSWER = 40


def sessions(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): each conversation as an ordered array of (turn, role, text)."""
    return turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")))).alias("turns"))


def training_form(rows: DataFrame, turns: str = "turns") -> Column:
    """conversations: [{from, value}] of user and assistant turns."""
    spoken = F.filter(turns, lambda t: t.role.isin("user", "assistant"))
    return F.transform(spoken, lambda t: F.struct(F.when(t.role == "user", "human").otherwise("gpt").alias("from"), t.text.alias("value")))


def pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, question, answer, reason): answers right behind a question, with the reason to drop them (null: kept)."""
    w = W.partitionBy(conv).orderBy(turn)
    t = turns.withColumn("_role", F.lag(role).over(w)).withColumn("question", F.lag(text).over(w)).where((F.col(role) == "assistant") & (F.col("_role") == "user"))
    answer = F.col(text)
    bare = F.size(F.array_except(numbers.numbers_in(answer), numbers.numbers_in(F.col("question")))) > 0
    reason = F.when(F.length(F.trim(answer)) < SHORTEST_ANSWER, "short").when(bare, "unsupported_number")
    return t.select(conv, turn, "question", answer.alias("answer"), reason.alias("reason"))


def audit_pairs(pairs: DataFrame) -> DataFrame:
    """pairs with issues: codes against a training pair, empty for a sound one.

    Columns: program_id, node_path array<string>, review struct(decision, reviewer,
    checks map<string, boolean>), conversations array<struct(from, value)>, evidence
    array<struct(doc_id, chunk_id, text, turn, program_id)>.
    """
    turns, evidence, program = F.col("conversations"), F.coalesce("evidence", F.array()), F.col("program_id")
    n = F.coalesce(F.size("conversations"), F.lit(0))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    shape = (n <= 0) | (n % 2 == 1)
    review = ~F.coalesce(F.col("review.decision").isin("accept", "corrected"), F.lit(False)) | blank(F.col("review.reviewer"))
    for check in REVIEW_CHECKS:
        review = review | ~F.coalesce(F.element_at("review.checks", check), F.lit(False))
    whole = lambda e: ~blank(e.doc_id.cast("string")) & ~blank(e.chunk_id.cast("string")) & ~blank(e.text) & F.coalesce((e.turn >= 0) & (e.turn < n) & (e.turn % 2 == 0), F.lit(False))
    own = lambda e: F.coalesce(e.program_id == program, F.lit(False))
    seen = lambda e: F.contains(F.coalesce(F.get(turns, e.turn.cast("int"))["value"], F.lit("")), e.text)
    valid = F.filter(evidence, lambda e: whole(e) & own(e) & seen(e))
    order = F.exists(F.transform(turns, lambda t, i: F.coalesce(t["from"] != F.when(i % 2 == 0, "human").otherwise("gpt"), F.lit(True))), lambda x: x)
    empty = F.exists(turns, lambda t: blank(t["value"]))
    answers = F.filter(F.transform(turns, lambda t, i: F.struct(i.alias("i"), t["value"].alias("v"))), lambda s: s.i % 2 == 1)
    known = lambda i: F.flatten(F.transform(F.filter(valid, lambda e: e.turn < i), lambda e: numbers.numbers_in(e.text)))
    unsourced = F.exists(answers, lambda s: F.size(F.filter(valid, lambda e: e.turn < s.i)) == 0)
    invented = F.exists(answers, lambda s: F.size(F.array_except(numbers.numbers_in(F.regexp_replace(F.coalesce(s.v, F.lit("")), r"\[\d+단계:[^\]]*\]|\[E\d+\]", "")), known(s.i))) > 0)
    inside = [
        F.when(F.size(evidence) <= 0, "missing_evidence_records"),
        F.when(F.exists(evidence, lambda e: ~whole(e)), "invalid_evidence_record"),
        F.when(F.exists(evidence, lambda e: whole(e) & ~own(e)), "cross_program_evidence"),
        F.when(F.exists(evidence, lambda e: whole(e) & own(e) & ~seen(e)), "evidence_not_visible"),
        F.when(order, "invalid_turn_order"),
        F.when(empty, "empty_turn"),
        F.when(unsourced, "answer_without_evidence"),
        F.when(invented, "unsupported_number"),
    ]
    first = [
        F.when(blank(program), "missing_program_id"),
        F.when((F.coalesce(F.size("node_path"), F.lit(0)) <= 0) | F.exists("node_path", blank), "missing_node_path"),
        F.when(review, "review_incomplete"),
        F.when(shape, "invalid_conversation"),
    ]
    return pairs.withColumn("issues", F.array_sort(F.array_compact(F.array(*first, *[F.when(~shape, x) for x in inside]))))


def leakage(rows: DataFrame, program: str = "program_id", split: str = "split", content: str = "content", order: str = "row") -> DataFrame:
    """rows with program_split_leakage (a program in several splits) and duplicate_conversation (a later row of the same content)."""
    splits = rows.where(F.col(program).isNotNull() & F.col(split).isNotNull()).groupBy(program).agg((F.countDistinct(split) > 1).alias("program_split_leakage"))
    w = W.partitionBy(F.sha2(content, 256)).orderBy(order)
    return rows.join(splits, program, "left").withColumn("program_split_leakage", F.coalesce("program_split_leakage", F.lit(False))).withColumn("duplicate_conversation", F.row_number().over(w) > 1)


def question_key(c: Column) -> Column:
    """A question without spaces and signs."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def hold_out(rows: DataFrame, questions: DataFrame, question: str, split: str = "split", least: int = 6) -> DataFrame:
    """rows whose question is in the evaluation set become "heldout"."""
    held = questions.select(question_key(F.col(questions.columns[0])).alias("_q")).where(F.length("_q") >= least).distinct().withColumn("_h", F.lit(True))
    return rows.withColumn("_q", question_key(F.col(question))).join(held, "_q", "left").withColumn(split, F.when(F.col("_h"), "heldout").otherwise(F.col(split))).drop("_q", "_h")


def contamination(benchmark: DataFrame, docs: DataFrame, item: str = "item_id", passage: str = "text", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, doc): benchmark passages that occur in documents."""
    b = benchmark.select(item, F.col(passage).alias("_p"))
    return contains_join(b, docs.select(doc, F.col(text).alias("_t")), item, "_p", doc, "_t", gram=12)


def select_core(files: DataFrame, key: list[str], submitted: Column, revision: Column, version: Column, mtime: str, rel: str = "rel") -> DataFrame:
    """One final document of each key: submitted first, then revision, version, time, name."""
    w = W.partitionBy(*key).orderBy(F.desc(submitted), F.desc_nulls_last(revision), F.desc_nulls_last(version), F.desc_nulls_last(mtime), rel)
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def newest_within(turns: DataFrame, size: Column, budget: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """turns with kept: the newest messages up to the budget (the newest always); the rest is for a summary."""
    w = W.partitionBy(conv).orderBy(F.desc(turn))
    total = F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))
    return turns.withColumn("kept", (total <= budget) | (F.row_number().over(w) == 1))


def keeps_goal(old: Column, new: Column, asked: Column, share: float = 0.5) -> Column:
    """The line to keep: the new one if a change was asked for or it keeps half of the old one's words."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[가-힣a-z0-9]{2,}"), F.lit(0)))
    kept = F.size(F.array_intersect(words(old), words(new))) / F.greatest(F.size(words(old)), F.lit(1))
    return F.when(asked | (kept >= share), new).otherwise(old)


def fill_pending(cells: DataFrame, row: str = "row_label", column: str = "col_label", value: str = "value", pending: str = "확인 필요") -> DataFrame:
    """cells with filled: a pending cell takes the one value that equally labelled cells have; several or none leave it."""
    told = cells.where(F.trim(value) != pending).groupBy(row, column).agg(F.countDistinct(value).alias("_n"), F.min(value).alias("_v")).where("_n = 1")
    return cells.join(told.select(row, column, "_v"), [row, column], "left").withColumn("filled", F.when((F.trim(value) == pending) & F.col("_v").isNotNull(), F.col("_v")).otherwise(F.col(value))).drop("_v")


#: How far before a number its item's words may stand, and words of items that name nothing (fixed values).
LABEL_BEFORE = 50
GENERIC_ITEM = ("인원", "건수", "금액", "실적", "개수", "합계", "전체")


def label_near(item: Column, value: Column, text: Column) -> Column:
    """Whether a number of an item of several telling words has all of these right before it, at one of its places in the text; true for other values and items.

    Spaces count neither in the value nor in the text. Null items have no words.
    """
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.coalesce(item, F.lit("")), F.lit("[가-힣A-Za-z]{2,}"), F.lit(0))), lambda w: ~w.isin(*GENERIC_ITEM))
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    # What lies between two places of the value, and so before each; a window may reach back over places of the value.
    before = F.split(bare(text), F.concat(F.lit("\\Q"), bare(value), F.lit("\\E")))
    place = F.sequence(F.lit(1), F.size(before) - 1)
    back = lambda i: F.slice(before, F.greatest(i - F.lit(LABEL_BEFORE), F.lit(1)), F.least(i, F.lit(LABEL_BEFORE + 1)))
    window = lambda i: F.right(F.call_function("array_join", back(i), bare(value)), F.lit(LABEL_BEFORE))
    near = F.exists(place, lambda i: F.forall(words, lambda w: F.contains(window(i), w)))
    return (F.size(words) < 2) | ~F.coalesce(value, F.lit("")).rlike("[0-9]") | ((F.size(before) > 1) & F.when(F.size(before) > 1, near))


def supported_facts(facts: DataFrame, quote: str = "quote", value: str = "value", text: str = "text", item: str | None = None) -> DataFrame:
    """Facts whose quote stands in the source and holds the value, spaces aside; with an item, its words must stand near the value too."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    kept = facts.where(F.contains(bare(F.col(text)), bare(F.col(quote))) & F.contains(bare(F.col(quote)), bare(F.col(value))) & (F.trim(value) != ""))
    return kept.where(label_near(F.col(item), F.col(value), F.col(text))) if item else kept


#: Limits of the audit of what came in: characters of the median chunk, shares of damaged and of useless chunks, chunks that need a heading among them.
LOW_MEDIAN, HIGH_DAMAGE, HIGH_NOISE, HEADED_FROM = 40, 0.20, 0.50, 10


def ingest_audit(chunks: DataFrame, doc: str = "doc_id", text: str = "text", heading: str | None = None) -> DataFrame:
    """(doc, n_chunks, median, damage, noise, issues, severity) of documents that need a look, by their chunks.

    No text (severity 3: no chunk has any); fragmented (the median chunk is short) and damaged (bad text layer), severity 2;
    no headings and noisy (chunks of no use to a search), severity 1. Sound documents have no row.
    """
    c = F.col(text)
    solid = F.coalesce(c.rlike(r"\S"), F.lit(False))
    facts = chunks.select(doc, solid.alias("s"), F.when(solid, tx.substantive_length(c)).alias("n"), (solid & (F.size(tx.damage_signals(c)) > 0)).alias("d"), F.coalesce(tx.keep(tx.quality_reasons(c), tx.SEARCH), F.lit(False)).alias("k"), F.coalesce(F.col(heading) != "", F.lit(False)).alias("h") if heading else F.lit(True).alias("h"))
    a = facts.groupBy(doc).agg(F.count_if("s").alias("n_chunks"), F.floor(F.median("n")).alias("median"), (F.count_if("d") / F.nullif(F.count_if("s"), F.lit(0))).alias("damage"), (F.count_if(~F.col("k")) / F.count(F.lit(1))).alias("noise"), F.max("h").alias("h"))
    heavy = F.array_compact(F.array(F.when(F.col("median") < LOW_MEDIAN, "fragmented"), F.when(F.col("damage") >= HIGH_DAMAGE, "damaged")))
    light = F.array_compact(F.array(F.when(~F.col("h") & (F.col("n_chunks") >= HEADED_FROM), "no headings"), F.when(F.col("noise") >= HIGH_NOISE, "noisy")))
    empty = F.col("n_chunks") == 0
    a = a.withColumn("issues", F.when(empty, F.array(F.lit("no text"))).otherwise(F.concat(heavy, light))).where(F.size("issues") > 0)
    return a.withColumn("severity", F.when(empty, 3).when(F.size(heavy) > 0, 2).otherwise(1)).drop("h")


def plan_import(sheet: DataFrame, known: DataFrame, key: str = "key", fields: list[str] | None = None) -> DataFrame:
    """(key, action, changed): what an import would do, without writing: new, same, change (with the fields), ambiguous (a key twice in the sheet), missing."""
    fields = fields or [c for c in sheet.columns if c != key]
    s = sheet.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in fields])
    j = s.alias("s").join(known.alias("k"), key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}")), F.lit(c)) for c in fields]))
    here, there = F.col("_n").isNotNull(), F.coalesce(*[F.col(f"k.{c}").cast("string") for c in fields]).isNotNull()
    action = F.when(~here, "missing").when(F.col("_n") > 1, "ambiguous").when(~there, "new").when(F.size(changed) == 0, "same").otherwise("change")
    return j.select(key, action.alias("action"), F.when(action == "change", F.array_join(changed, ",")).otherwise("").alias("changed"))


def approved_to_the_root(nodes: DataFrame, depth: int = 20) -> DataFrame:
    """(id, usable): nodes (id, parent, approved) that are approved with all their ancestors, by one step per level of the tree."""
    state = nodes.select("id", F.col("parent").alias("up"), F.col("approved").alias("usable"))
    for _ in range(depth):
        above = nodes.select(F.col("id").alias("up"), F.col("parent").alias("next"), F.col("approved").alias("ok"))
        if state.where("up is not null").isEmpty():
            break
        state = state.join(above, "up", "left").select("id", F.col("next").alias("up"), (F.col("usable") & F.coalesce("ok", F.col("up").isNull())).alias("usable"))
    return state.select("id", "usable")


def case_issues(cases: DataFrame) -> DataFrame:
    """(id, issues) of retrieval cases: question, decision, candidates array<struct(node_id, program_id, text)>, selected and rejected arrays of ids."""
    known = F.transform("candidates", lambda c: c.node_id)
    issues = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("question"), F.lit("")) == "", "empty_question"),
            F.when(F.coalesce(F.size("candidates"), F.lit(0)) <= 0, "no_candidates"),
            F.when((F.col("decision") == "accept") & (F.coalesce(F.size("selected"), F.lit(0)) <= 0), "accepted_without_selection"),
            F.when(F.size(F.array_except("selected", known)) > 0, "unknown_selection"),
            F.when(F.size(F.array_intersect("selected", "rejected")) > 0, "selected_and_rejected"),
            F.when(F.exists("candidates", lambda c: c.program_id != F.col("program_id")), "cross_program_candidate"),
        )
    )
    return cases.select("id", issues.alias("issues"))


def review_tasks(rows: DataFrame, key: str = "row") -> DataFrame:
    """(task): rows as review tasks, a JSON object each."""
    return rows.select(F.to_json(F.struct(F.col(key).alias("id"), F.struct(*[F.col(c) for c in rows.columns if c != key]).alias("data"))).alias("task"))


def review_decisions(tasks: DataFrame, task: str = "task") -> DataFrame:
    """(id, decision, reviewer) from finished tasks: the last annotation's first choice."""
    schema = "struct<id:bigint,annotations:array<struct<completed_by:string,result:array<struct<value:struct<choices:array<string>>>>>>>"
    t = F.from_json(task, schema)
    last = F.element_at(t["annotations"], -1)
    return tasks.select(t["id"].alias("id"), F.get(F.get(last["result"], F.lit(0))["value"]["choices"], F.lit(0)).alias("decision"), last["completed_by"].alias("reviewer"))


def kind_weights(terms: DataFrame, doc: str = "doc_id", kind: str = "kind", term: str = "term") -> DataFrame:
    """(term, kind, weight): how telling a term is of a kind: its share of the kind's documents times ln((1 + kinds) / (1 + kinds that have it)) + 1."""
    t = terms.select(doc, kind, term).distinct()
    n = t.groupBy(kind).agg(F.countDistinct(doc).alias("n"))
    per = t.groupBy(term, kind).agg(F.count(F.lit(1)).alias("df"))
    spread = per.groupBy(term).agg(F.count(F.lit(1)).alias("kinds"))
    every = n.agg(F.count(F.lit(1)).alias("all"))
    j = per.join(n, kind).join(spread, term).crossJoin(F.broadcast(every))  # one row
    return j.select(term, kind, (F.col("df") / F.col("n") * (F.log((1 + F.col("all")) / (1 + F.col("kinds"))) + 1)).alias("weight"))


def guess_kind(terms: DataFrame, weights: DataFrame, margin: float = 1.2, doc: str = "doc_id", kind: str = "kind", term: str = "term") -> DataFrame:
    """(doc, kind, score, sure): the kind with the greatest sum of its terms' weights; sure if it is ``margin`` times the second's. Equal sums go by name."""
    s = terms.select(doc, term).distinct().join(weights, term).groupBy(doc, kind).agg(F.round(F.sum("weight"), 9).alias("score"))
    w = W.partitionBy(doc).orderBy(F.desc("score"), kind)
    s = s.withColumn("_n", F.row_number().over(w)).withColumn("_second", F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return s.where("_n = 1").select(doc, kind, "score", (F.col("score") >= margin * F.col("_second")).alias("sure"))


# --- pairs from forms and outlines -----------------------------------------------------------------------------

# How a number is written, and what is a section's number rather than a fact.
WRITTEN_NUMBER, SECTION_NUMBER, FACT_DIGITS = r"([0-9][0-9,]*(?:\.[0-9]+)?%?)", r"^[0-9]{1,2}(?:\.[0-9]{1,2}){1,3}$", 3


def written_numbers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WRITTEN_NUMBER), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def fact_numbers(text: Column) -> Column:
    """Numbers that state a fact: three digits and more, with a point, or per cent; section numbers don't."""
    fact = lambda x: (F.length(F.regexp_replace(x, "[^0-9]", "")) >= FACT_DIGITS) | F.contains(x, F.lit(".")) | F.contains(x, F.lit("%"))
    return F.filter(written_numbers(text), lambda x: ~x.rlike(SECTION_NUMBER) & fact(x))


def form_pairs(forms: DataFrame, finals: DataFrame, pair: str = "pair", heading: str = "heading", guide: str = "guide", body: str = "body", facts: str = "facts") -> DataFrame:
    """(pair, heading, human, output, missing): a form's section with the finished text of the same title.

    A title that occurs twice on either side says nothing, and an empty text teaches nothing. human is what the writer
    saw: heading, guide, facts. missing are facts in numbers that the text states and human doesn't have.
    """
    alone = lambda df: df.withColumn("_k", key_of(F.col(heading))).where("_k <> ''").withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(pair, "_k"))).where("_n = 1").drop("_n")
    j = alone(forms).join(alone(finals.where(F.coalesce(F.trim(body), F.lit("")) != "")).select(pair, "_k", F.col(body).alias("output")), [pair, "_k"])
    human = F.concat_ws("\n", heading, guide, facts)
    return j.select(pair, heading, human.alias("human"), "output", F.array_sort(F.array_except(fact_numbers(F.col("output")), written_numbers(human))).alias("missing"))


def outline_steps(headings: DataFrame, doc: str = "doc_id", path: str = "path", order: str = "seq") -> DataFrame:
    """(doc, order, human, answer, missing): for each section that has others below it, the question for its skeleton and the answer.

    headings carry their path (breadcrumbs()). A path that a document has twice names no section. The question
    states the path, so it can be asked by itself; missing are the answer's facts in numbers that the question doesn't have.
    """
    h = headings.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(doc, path)))
    below = h.where(F.size(path) > 1).groupBy(doc, F.slice(path, F.lit(1), F.size(path) - 1).alias("_p")).agg(F.array_sort(F.collect_list(F.struct(order, F.element_at(path, -1).alias("t")))).alias("_c"))
    j = h.where("_n = 1").join(below.withColumnRenamed("_p", path), [doc, path])
    human = F.concat(F.lit("범위: "), F.array_join(path, " → "), F.lit("\n[질문] 이 절의 소제목을 차례대로 적어 줘."))
    answer = F.array_join(F.transform("_c", lambda c: F.concat(F.lit("- "), c.t)), "\n")
    return j.select(doc, order, human.alias("human"), answer.alias("answer"), F.array_sort(F.array_except(fact_numbers(answer), written_numbers(human))).alias("missing"))
