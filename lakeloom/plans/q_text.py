"""Queries of scalar functions: text, numbers, dates, vectors, arrays, JSON, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import numbers, text
from lakeloom.operators import similarity
from lakeloom.operators.aggregates import dot
from lakeloom.plans.q_aggregates import LINES_SQL, lines
from lakeloom.plans.registry import Tables, query

FP = "regexp_replace({t}, '[^가-힣A-Za-z0-9]', '', 'g')"
NORM = r"trim(regexp_replace({t}, '[\s\x0b]+', ' ', 'g'))"


@query(rf"SELECT doc_id, {NORM.format(t='text')} AS text FROM documents")
def txt_norm_ws(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.normalize(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {FP.format(t='text')} AS fp, CAST(length({FP.format(t='text')}) AS INTEGER) AS substance FROM documents")
def txt_fingerprint(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", similarity.fingerprint(F.col("text")).alias("fp"), text.substantive_length(F.col("text")).alias("substance"))


@query(f"SELECT doc_id, CAST(length({FP.format(t='text')}) AS INTEGER) AS substance FROM documents")
def txt_substantive_len(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.substantive_length(F.col("text")).alias("substance"))


GRAM12 = "list_distinct(list_transform(range(1, greatest(length(f) - 11, 1) + 1), lambda i: substr(f, i, 12)))"


@query(f"WITH l AS ({LINES_SQL}), k AS (SELECT doc_id, seq, {FP.format(t='line')} AS f FROM l) SELECT doc_id, seq, CAST(CASE WHEN f = '' THEN 0 ELSE len({GRAM12}) END AS INTEGER) AS n FROM k")
def txt_shingles(t: Tables) -> DataFrame:
    k = lines(t).withColumn("f", similarity.fingerprint(F.col("line")))
    return k.select("doc_id", "seq", F.size(similarity.shingles(F.col("f"))).alias("n"))


@query(
    r"""WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard FROM b a JOIN b ON b.item_id = a.item_id + 1"""
)
def txt_jaccard(t: Tables) -> DataFrame:
    b = t.benchmark.select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    j = b.select(F.col("item_id").alias("a"), F.col("w").alias("wa"), (F.col("item_id") + 1).alias("b")).join(b.select(F.col("item_id").alias("b"), F.col("w").alias("wb")), "b")
    return j.select("a", "b", F.round(similarity.jaccard(F.col("wa"), F.col("wb")), 6).alias("jaccard"))


@query()
def txt_minhash(t: Tables) -> DataFrame:
    k = t.documents.select("doc_id", similarity.shingle_sketch(similarity.fingerprint(F.col("text"))).alias("sketch"))
    return k.select("doc_id", F.size("sketch").alias("k"), F.get("sketch", F.lit(0)).alias("least"))


@query(
    rf"""WITH l AS ({LINES_SQL}) SELECT doc_id, seq, regexp_full_match(trim(line), '[\s\-–—·.()\[\]/]*(?:[pP]\.?\s*)?\d{{1,4}}\s*(?:/\s*\d{{1,4}})?[\s\-–—·.()\[\]/]*') AS page_only,
regexp_full_match(trim(line), '[\s|+\-–—─━═_.·*~<>]+') AS rule_only FROM l"""
)
def txt_page_rule_only(t: Tables) -> DataFrame:
    line = F.col("line")
    return lines(t).select("doc_id", "seq", text.is_page_number(line).alias("page_only"), text.is_rule(line).alias("rule_only"))


@query(rf"WITH l AS ({LINES_SQL}) SELECT doc_id, seq, trim(line) <> '' AND regexp_matches({NORM.format(t='line')}, '\?\s*$') AND NOT regexp_matches({NORM.format(t='line')}, '[.!]\s') AS asks FROM l")
def txt_question_only(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "seq", text.is_question_only(F.col("line")).alias("asks"))


@query()
def txt_toc(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.is_toc(F.col("text")).alias("toc"))


@query(
    """WITH d AS (SELECT doc_id, repeat('漢', CAST(doc_id % 30 AS INTEGER)) || repeat('가', CAST(doc_id % 7 AS INTEGER)) || text AS text FROM documents) SELECT doc_id, round(CASE WHEN len(regexp_extract_all(text, '[가-힣A-Za-z一-鿿㐀-䶿]')) < 40 THEN 0.0 ELSE len(regexp_extract_all(text, '[一-鿿㐀-䶿]')) / len(regexp_extract_all(text, '[가-힣A-Za-z一-鿿㐀-䶿]')) END, 6)::DOUBLE AS share FROM d"""
)
def txt_garbled_ratio(t: Tables) -> DataFrame:
    """Whole documents behind more and more ideographs."""
    many = lambda s, n: F.repeat(F.lit(s), (F.col("doc_id") % n).cast("int"))
    page = F.concat(many("漢", 30), many("가", 7), "text")
    return t.documents.select("doc_id", F.round(text.garbled_share(page), 6).alias("share"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CASE WHEN n / (n + 40) >= 0.15 THEN 'garbled' ELSE '' END WHEN 1 THEN CASE WHEN 1000 / (9 + 60 * n) >= 0.5 THEN 'date_collapse' ELSE '' END
WHEN 2 THEN CASE WHEN n >= 16 AND n / (n + 40) >= 0.1 THEN 'no_spaces' ELSE '' END WHEN 3 THEN CASE WHEN n >= 3 AND n / (n + 12) >= 0.25 THEN 'split_syllables' ELSE '' END
ELSE array_to_string(list_filter([CASE WHEN 40 / (40 + n) >= 0.15 THEN 'garbled' END, CASE WHEN n >= 40 THEN 'no_spaces' END], lambda x: x IS NOT NULL), ',') END AS signals FROM (SELECT p_partkey, p_size AS n FROM part)"""
)
def txt_ocr_damage(t: Tables) -> DataFrame:
    """Pages with more and more of each kind of damage."""
    n = F.col("p_size").cast("int")
    many = lambda s, k: F.repeat(F.lit(s), k)
    page = (
        F.when(F.col("p_partkey") % 5 == 0, F.concat(many("漢", n), F.repeat(F.lit("a"), F.lit(40))))
        .when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("12345(월) "), many("ab cd ", n * 10)))
        .when(F.col("p_partkey") % 5 == 2, F.concat(many("가", n), F.lit(" "), F.repeat(F.lit("나다 "), F.lit(20))))
        .when(F.col("p_partkey") % 5 == 3, F.concat(many("가 ", n), F.repeat(F.lit("나다 "), F.lit(12))))
        .otherwise(F.concat(F.repeat(F.lit("漢"), F.lit(40)), many("라", n)))
    )
    return t.part.select("p_partkey", F.array_join(text.damage_signals(page), ",").alias("signals"))


REASONS_SQL = rf"""l AS ({LINES_SQL}), m AS (SELECT doc_id, seq, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM l),
n AS (SELECT *, length({FP.format(t='t')}) AS sub, length({NORM.format(t='t')}) AS total, len(regexp_extract_all(t, '[0-9]')) AS digits FROM m),
r AS (SELECT doc_id, seq, t, sub, CASE WHEN t = '' THEN ['too_short'] ELSE list_filter([
CASE WHEN regexp_full_match(t, '[\s\-–—·.()\[\]/]*(?:[pP]\.?\s*)?\d{{1,4}}\s*(?:/\s*\d{{1,4}})?[\s\-–—·.()\[\]/]*') THEN 'page_number' END,
CASE WHEN regexp_full_match(t, '[\s|+\-–—─━═_.·*~<>]+') OR sub / greatest(total, 1) < 0.35 THEN 'symbol_only' END,
CASE WHEN (regexp_matches(t, '[.·․‧⋯…]{{3,}}\s*\d{{1,4}}\s*$|[.·․‧⋯…]{{5,}}') OR regexp_matches(t, '^\s*\S.{{0,58}}?[ \t.·…]{{2,}}\d{{1,4}}\s*$')) AND sub < 40 THEN 'toc_line' END,
CASE WHEN sub < 20 THEN 'too_short' WHEN sub < 40 THEN 'thin' END,
CASE WHEN regexp_matches({NORM.format(t='t')}, '\?\s*$') AND NOT regexp_matches({NORM.format(t='t')}, '[.!]\s') THEN 'question_only' END,
CASE WHEN sub >= 40 AND digits / greatest(sub, 1) >= 0.75 THEN 'low_text' END], lambda x: x IS NOT NULL) END AS reasons FROM n)"""


@query(f"WITH {REASONS_SQL} SELECT doc_id, seq, array_to_string(reasons, ',') AS reasons FROM r")
def txt_quality_reasons(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "seq", F.array_join(text.quality_reasons(F.col("line")), ",").alias("reasons"))


@query(
    f"""WITH {REASONS_SQL} SELECT doc_id, seq, round(list_reduce(list_prepend(least(1.0, sub / 200)::DOUBLE, list_transform(reasons, lambda x: CASE x WHEN 'page_number' THEN 0.4 WHEN 'symbol_only' THEN 0.4 WHEN 'too_short' THEN 0.4 WHEN 'toc_line' THEN 0.5 WHEN 'question_only' THEN 0.6 ELSE 0.8 END::DOUBLE)), lambda a, b: a * b), 3) AS score,
len(list_filter(reasons, lambda x: x NOT IN ('thin', 'low_text'))) = 0 AS kept FROM r"""
)
def txt_quality_score(t: Tables) -> DataFrame:
    r = lines(t).withColumn("reasons", text.quality_reasons(F.col("line")))
    return r.select("doc_id", "seq", text.quality_score(F.col("line"), F.col("reasons")).alias("score"), text.keep(F.col("reasons"), text.SEARCH).alias("kept"))


@query(
    rf"""WITH l AS ({LINES_SQL}), h AS (SELECT doc_id, seq, trim(line, ' ') AS t FROM l) SELECT doc_id, seq, CASE WHEN regexp_matches(t, '^(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+|I{{1,3}}|IV|VI{{0,3}}|IX|X)[\s\x0b]*[.．][\s\x0b]*[^\s\x0b]') THEN 1
WHEN regexp_matches(t, '^\d{{1,2}}\.\d{{1,2}}(?:\.\d{{1,2}})*\.?[\s\x0b]+[^\s\x0b]|^[가-하]\.[\s\x0b]*[^\s\x0b]') THEN 3 WHEN regexp_matches(t, '^\d{{1,2}}[.．][\s\x0b]*[^\s\x0b]|^제[\s\x0b]*\d+[\s\x0b]*[조장절]') THEN 2 WHEN regexp_matches(t, '^\(?\d{{1,2}}\)[\s\x0b]*[^\s\x0b]') THEN 4 END AS level FROM h WHERE length(t) <= 80"""
)
def txt_heading_level(t: Tables) -> DataFrame:
    return lines(t).where(F.length(F.trim("line")) <= 80).select("doc_id", "seq", text.heading_level(F.col("line")).alias("level"))


@query(rf"WITH l AS ({LINES_SQL}), k AS (SELECT *, length({FP.format(t='line')}) AS n FROM l) SELECT doc_id, seq, n >= 40 OR (n >= 20 AND regexp_matches(trim(line), '(?:[.?!]|다|함|음|임|됨|요)\s*$')) AS whole FROM k")
def txt_self_contained(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "seq", text.self_contained(F.col("line")).alias("whole"))


@query(
    rf"""WITH l AS ({LINES_SQL}), c AS (SELECT doc_id, seq, list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> '') AS cells FROM l WHERE contains(line, '|'))
SELECT doc_id, seq, array_to_string(list_filter(cells, lambda x, i: i = 1 OR cells[i - 1] <> x), ' | ') AS "row" FROM c"""
)
def txt_clean_row(t: Tables) -> DataFrame:
    return lines(t).where(F.contains("line", F.lit("|"))).select("doc_id", "seq", text.clean_row(F.col("line")).alias("row"))


@query("WITH l AS (" + LINES_SQL + r") SELECT doc_id, seq, list_sort(list_distinct(regexp_extract_all(lower(line), '[가-힣a-z0-9]{2,}'))) AS terms FROM l")
def txt_nouns(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "seq", F.array_sort(text.terms(F.col("line"))).alias("terms"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '홍' || repeat('*', 2 + p_size) WHEN 1 THEN substr(p_name, 1, 3) || repeat('*', greatest(length(p_name) - 3, 0)) ELSE substr(p_type, 1, 2) END AS name FROM part")
def txt_redact(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("홍길동"), F.repeat(F.lit("x"), F.col("p_size").cast("int")))).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.substring("p_type", 1, 2))
    return t.part.select("p_partkey", text.redact(name).alias("name"))


@query("SELECT doc_id, CAST(ceil(len(regexp_extract_all(text, '[가-힣]')) * 0.7::DOUBLE + len(regexp_extract_all(text, '[A-Za-z]')) * 0.25::DOUBLE + len(regexp_extract_all(text, '[0-9]')) * 0.5::DOUBLE + len(regexp_extract_all(text, '[^\\s가-힣A-Za-z0-9]'))) AS BIGINT) AS tokens FROM documents".replace("\\\\", "\\"))
def txt_tokens_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(
    """WITH n AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2) SELECT a.p_brand, a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name) AS d, a.n * b.n AS pairs
FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 2"""
)
def txt_levenshtein(t: Tables) -> DataFrame:
    """Names of a brand that are at most two edits apart, and how many pairs of parts bear them."""
    n = t.part.groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"))
    p = similarity.edit_pairs(n, "p_name", 2, ["p_brand"])
    of = lambda c: n.select("p_brand", F.col("p_name").alias(c), F.col("n").alias(f"n{c}"))
    return p.join(of("a"), ["p_brand", "a"]).join(of("b"), ["p_brand", "b"]).select("p_brand", "a", "b", F.col("d").cast("long").alias("d"), (F.col("na") * F.col("nb")).alias("pairs"))


@query()
def txt_repair(t: Tables) -> DataFrame:
    """Joined syllables, numbering, tidied replies and clipping, on lines."""
    line = F.col("line")
    return lines(t).select("doc_id", "seq", text.fix_numbering(text.join_split_words(line)).alias("repaired"), text.tidy_reply(line).alias("tidy"), text.clip(line, F.lit(40)).alias("clipped"), text.nfc(line).alias("composed"))


@query(
    r"""SELECT page_id, lower(regexp_replace(regexp_replace(split_part(url, '/', -1), '(?i)\.(hwpx?|pdf|docx?|xlsx?|pptx?|jpe?g|png|txt|md)$', ''), '[\s_\-–—·ㆍ.,()\[\]{}（）「」『』【】<>《》〈〉''"“”‘’:;!?/\\~]+', '', 'g')) AS key FROM pages"""
)
def txt_program_key(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.family_key(F.element_at(F.split("url", "/"), -1)).alias("key"))


@query(
    """WITH w AS (SELECT doc_id, lower(text) AS h FROM documents), s AS (SELECT doc_id, CASE WHEN contains(h, 'the ') THEN 2 ELSE 0 END + CASE WHEN contains(h, ' and ') THEN 1 ELSE 0 END AS en, CASE WHEN contains(h, 'der ') THEN 2 ELSE 0 END + CASE WHEN contains(h, ' und ') THEN 1 ELSE 0 END AS de, CASE WHEN contains(h, 'les ') THEN 2 ELSE 0 END + CASE WHEN contains(h, ' et ') THEN 1 ELSE 0 END AS fr FROM w)
SELECT doc_id, CASE WHEN en > greatest(de, fr) THEN 'en' WHEN de > greatest(en, fr) THEN 'de' WHEN fr > greatest(en, de) THEN 'fr' ELSE 'unknown' END AS kind FROM s"""
)
def txt_kind_rules(t: Tables) -> DataFrame:
    h = F.lower("text")
    has = lambda w, n: F.when(F.contains(h, F.lit(w)), n).otherwise(0)
    s = t.documents.select("doc_id", (has("the ", 2) + has(" and ", 1)).alias("en"), (has("der ", 2) + has(" und ", 1)).alias("de"), (has("les ", 2) + has(" et ", 1)).alias("fr"))
    top = lambda a, b, c: F.col(a) > F.greatest(b, c)
    return s.select("doc_id", F.when(top("en", "de", "fr"), "en").when(top("de", "en", "fr"), "de").when(top("fr", "en", "de"), "fr").otherwise("unknown").alias("kind"))


@query(rf"WITH l AS ({LINES_SQL}) SELECT doc_id, arg_min(trim(line), seq) AS title FROM l WHERE length({FP.format(t='line')}) >= 4 GROUP BY doc_id")
def txt_title(t: Tables) -> DataFrame:
    return lines(t).where(text.substantive_length(F.col("line")) >= 4).groupBy("doc_id").agg(F.min_by(F.trim("line"), "seq").alias("title"))


# --- numbers, dates, vectors, arrays, JSON, hashes ------------------------------------------------------


@query(
    """WITH a AS (SELECT o_orderkey, CAST(floor(o_totalprice / 10000) AS BIGINT) AS m, CAST(floor(o_totalprice) AS BIGINT) % 10000 AS r FROM orders)
SELECT o_orderkey, CAST(CASE WHEN r = 0 THEN m * 10000 ELSE m * 10000 + r END AS DOUBLE) AS amount FROM a"""
)
def num_parse_unit(t: Tables) -> DataFrame:
    whole = F.floor("o_totalprice")
    said = F.concat(F.format_number(F.floor(whole / 10000), 0), F.lit("만 "), F.format_number(whole % 10000, 0), F.lit("원"))
    return t.orders.select("o_orderkey", numbers.parse_amount(said).cast("double").alias("amount"))


@query(r"SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?'), lambda x: replace(x, ',', '')))) AS numbers FROM documents")
def num_extract(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_sort(numbers.numbers_in(F.col("text"))).alias("numbers"))


@query()
def num_canonical(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", numbers.canonical_values("text").alias("values"), numbers.scaled_values("text").alias("money"))


@query(
    r"""WITH c AS (SELECT conv_id, turn, role, regexp_extract_all(text, '\d+') AS n FROM conversations), e AS (SELECT conv_id, list_distinct(flatten(list(n))) AS n FROM c WHERE role <> 'assistant' GROUP BY 1)
SELECT c.conv_id, c.turn, len(list_filter(c.n, lambda x: NOT list_contains(coalesce(e.n, []), x))) = 0 AS ok FROM c LEFT JOIN e USING (conv_id) WHERE role = 'assistant'"""
)
def num_verify(t: Tables) -> DataFrame:
    c = t.conversations
    e = c.where("role <> 'assistant'").groupBy("conv_id").agg(F.collect_list("text").alias("evidence"))
    j = c.where("role = 'assistant'").join(e, "conv_id", "left")
    return j.select("conv_id", "turn", (F.size(numbers.unsupported_numbers("text", "evidence")) == 0).alias("ok"))


@query()
def num_mask(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", numbers.mask_numbers("text", F.array(F.lit("2024 196"))).alias("masked"))
    return d.where(F.contains("masked", F.lit("○○")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity * 2 = l_quantity + l_linenumber THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' × 2 = ' || CAST(CAST(l_quantity AS BIGINT) + l_linenumber AS VARCHAR) END AS issue FROM lineitem")
def num_calc(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    said = F.concat(q.cast("string"), F.lit(" × 2 = "), (q + F.col("l_linenumber")).cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(numbers.budget_issues(said), ";").alias("issue"))


@query(
    """SELECT l_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,0)) * CAST(round(l_extendedprice / l_quantity) AS DECIMAL(18,0))) AS BIGINT) AS total, sum(CAST(l_quantity AS DECIMAL(18,0)) * CAST(round(l_extendedprice / l_quantity) AS DECIMAL(18,0))) <= 150000 AS within_limit FROM lineitem GROUP BY 1"""
)
def num_budget(t: Tables) -> DataFrame:
    sub = F.col("l_quantity").cast("decimal(18,0)") * F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(18,0)")
    return t.lineitem.groupBy("l_orderkey").agg(F.sum(sub).cast("long").alias("total")).withColumn("within_limit", F.col("total") <= 150000)


@query(
    """WITH c(name, points, keys) AS (VALUES ('legal', 30, ['license', 'copyright']), ('contact', 20, ['@', 'phone']), ('toxic', 50, ['worthless', 'disgusting']))
SELECT doc_id, CAST(sum(CASE WHEN len(list_filter(keys, lambda k: contains(lower(text), k))) > 0 THEN points ELSE 0 END) AS BIGINT) AS covered FROM documents, c GROUP BY doc_id"""
)
def num_coverage(t: Tables) -> DataFrame:
    low = F.lower("text")
    has = lambda words, n: F.when(F.lit(False) if not words else sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0, n).otherwise(0)
    return t.documents.select("doc_id", (has(("license", "copyright"), 30) + has(("@", "phone"), 20) + has(("worthless", "disgusting"), 50)).cast("long").alias("covered"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y') AS year FROM orders")
def dt_month(t: Tables) -> DataFrame:
    said = F.date_format("o_orderdate", "yyyy. M. d.")
    return t.orders.select("o_orderkey", F.coalesce(numbers.month_of(said), F.date_format("o_orderdate", "yyyy-MM")).alias("month"), F.coalesce(numbers.year_of(said), F.date_format("o_orderdate", "yyyy")).alias("year"))


@query("SELECT o_custkey, max(CAST(o_orderdate AS DATE)) FILTER (o_orderdate < TIMESTAMP '1999-01-01') AS latest FROM orders GROUP BY 1")
def dt_rule_dates(t: Tables) -> DataFrame:
    said = F.array_join(F.collect_list(F.date_format("o_orderdate", "yyyy. M. d.")), ", ")
    g = t.orders.groupBy("o_custkey").agg(said.alias("said"))
    return g.select("o_custkey", numbers.latest_date(F.col("said"), F.lit("1998-12-31").cast("date")).alias("latest"))


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS kst FROM events")
def dt_kst(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Seoul"), "yyyy-MM-dd HH:mm").alias("kst"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vec_cosine(t: Tables) -> DataFrame:
    e = t.embeddings
    j = e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.col("embedding").alias("x")).join(e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "b")
    return j.select("a", "b", F.round(dot("x", "y"), 6).alias("cosine"))


@query("SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) AS top FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1")
def map_counter(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "event_type")))
    return n.groupBy("user_id").agg(F.array_join(F.transform(F.slice(ranked, 1, 3), lambda s: F.concat_ws(":", s.event_type, (-s.m).cast("string"))), ",").alias("top"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_get(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT doc_id, sha256(text) AS sha, substr(md5(text), 1, 10) AS short FROM documents")
def hash_sha(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.md5("text"), 1, 10).alias("short"))
