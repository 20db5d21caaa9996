"""Plain Python versions of the queries that have no SQL: name -> rows from tables (name -> list of dicts), or a check of the rows got.

They follow the rules as the operators' docstrings state them, by loops over everything.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import unicodedata
from collections import Counter, defaultdict
from html import unescape
from itertools import combinations

import xxhash

MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", re.A)
NUMBER = re.compile(r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?")
LINE_ID = 1 << 24


def print_of(text):
    return re.sub("[^가-힣A-Za-z0-9]", "", text)


def squeezed(text):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")


def grams(text, k=12):
    return {text[i : i + k] for i in range(max(1, len(text) - k + 1))} if text else set()


def lines(t):
    return [{"chunk_id": d["doc_id"] * LINE_ID + i, "doc_id": d["doc_id"], "seq": i, "text": x} for d in t["documents"] for i, x in enumerate(d["text"].split("\n"), 1)]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


# --- text and numbers -------------------------------------------------------------------------------


def txt_minhash(t):
    out = []
    for d in t["documents"]:
        h = sorted({x - (1 << 64) if x >> 63 else x for x in (xxhash.xxh64_intdigest(g.encode(), 42) for g in grams(print_of(d["text"])))})[:128]
        out.append({"doc_id": d["doc_id"], "k": len(h), "least": h[0]})
    return out


def txt_toc(t):
    leader = re.compile(r"[.·․‧⋯…]{3,}\s*\d{1,4}\s*$|[.·․‧⋯…]{5,}", re.A)
    page = re.compile(r"^\s*\S.{0,58}?[ \t.·…]{2,}\d{1,4}\s*$", re.A)
    out = []
    for d in t["documents"]:
        solid = [x.strip() for x in d["text"].split("\n") if x.strip()]
        hits = sum(bool(leader.search(x) or page.search(x)) for x in solid)
        toc = hits == 1 and len(print_of(d["text"])) < 40 if len(solid) == 1 else hits >= max(2, (len(solid) + 1) // 2)
        out.append({"doc_id": d["doc_id"], "toc": bool(solid) and toc})
    return out


def _clip(x, most):
    if len(x) <= most:
        return x
    head = x[: most - 1]
    ends = [i + 2 for i in range(len(head) - 1) if head[i] in ".?!다" and head[i + 1].isspace()]
    if ends and ends[-1] >= most // 2:
        return head[: ends[-1]].rstrip() + "…"
    space = head.rfind(" ")
    return (head[:space] if space >= most // 2 else head).rstrip() + "…"


def txt_repair(t):
    out = []
    for c in lines(t):
        x = c["text"]
        assert not re.search("[가-힣]", x)  # joining syllables has a query of its own
        sentences = list(dict.fromkeys(s.strip(" ") for s in re.split(r"(?<=[.?!])[ \t\n\x0b\f\r]+", x) if s.strip(" ")))
        repaired = re.sub(r"^\s*0[.)]\s+", "", re.sub(r"^(\s*)(\d{1,2}[.)])\s*\2\s*", r"\1\2 ", x, flags=re.A), flags=re.A)
        out.append({"doc_id": c["doc_id"], "seq": c["seq"], "repaired": repaired, "tidy": " ".join(sentences), "clipped": _clip(x, 40), "composed": unicodedata.normalize("NFC", x).replace("\0", "")})
    return out


def _listless(text):
    return re.sub(r"(?:^|\n)\s*\d+[.)]\s", "\n", text)


def num_canonical(t):
    out = []
    for d in t["documents"]:
        assert not re.search("[조억만천백십원]", d["text"])
        values = set()
        for x in NUMBER.findall(_listless(d["text"])):
            x = x.replace(",", "")
            whole, _, rest = x.partition(".")
            rest = rest.rstrip("0")
            whole = whole.lstrip("0") or "0"
            values.add(f"{whole}.{rest}" if rest else whole)
        out.append({"doc_id": d["doc_id"], "values": sorted(values), "money": []})
    return out


def num_mask(t):
    out = []
    for d in t["documents"]:
        told = {"2024", "196"}
        bad = set()
        for x in NUMBER.findall(_listless(d["text"])):
            x = x.replace(",", "")
            if x not in told and (x.lstrip("0") or "0").rstrip(".") not in told:
                bad.add(x)

        def one(m):
            x = m[0].replace(",", "")
            year = re.fullmatch(r"(?:19|20)\d\d(?:\.(?:0?[1-9]|1[0-2]))?", x)
            small = x.isdigit() and int(x) <= 10 and d["text"][m.end() : m.end() + 1] != "%"
            return m[0] if x not in bad or year or small else "○○"

        masked = NUMBER.sub(one, d["text"])
        if "○○" in masked:
            out.append({"doc_id": d["doc_id"], "masked": masked})
    return out


# --- sources ---------------------------------------------------------------------------------------------


def _page_text(html):
    html = re.sub(r"<!--.*?-->|<!DOCTYPE[^>]*>", "", html, flags=re.S | re.I)
    html = re.sub(r"<(script|style)\b.*?</\1>", "", html, flags=re.S | re.I)
    title = re.search(r"<title>(.*?)</title>", html, re.S | re.I)
    html = re.sub(r"<title>.*?</title>", "\n", html, flags=re.S | re.I)
    html = html.replace("\n", " ")
    html = re.sub(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|nav|main|blockquote|pre|hr|dt|dd)\b[^>]*>", "\n", html, flags=re.I)
    assert not re.search(r"<t[dh]\b", html, re.I)
    text = unescape(re.sub(r"<[^>]+>", "", html))
    return [" ".join(x.split()) for x in ((unescape(title[1]) if title else ""), *text.split("\n"))]


def src_html(t):
    return [{"page_id": p["page_id"], "text": "\n".join(x for x in _page_text(p["html"]) if x.strip(" |"))} for p in t["pages"]]


def src_mht_eml(t):
    return [{"page_id": r["page_id"], "text": "page\n" + r["text"]} for r in src_html(t)]


def src_dir_listing(t):
    folder = t["folder"]
    return [{"rel": n, "size": os.path.getsize(f"{folder}/{n}"), "mtime": int(os.path.getmtime(f"{folder}/{n}"))} for n in os.listdir(folder)]


def _same_digest(columns):
    def check(got, t, spark, query):
        """The same for the same rows in any order, another for other rows."""
        from pyspark.sql import functions as F

        from lakeloom.operators import graph
        from lakeloom.sources import sinks

        for digest in (graph.fingerprint, sinks.table_digest):
            df = spark.read.parquet(f"{t['folder']}/customer.parquet")
            once, again = digest(df).first(), digest(df.orderBy(F.desc("c_custkey")).repartition(7).select(*reversed(df.columns))).first()
            changed = digest(df.withColumn("c_acctbal", F.when(F.col("c_custkey") == 5, 0.123).otherwise(F.col("c_acctbal")))).first()
            assert once == again and changed[0] == once[0] and changed[1] != once[1]
        assert [sorted(r) for r in got] == [sorted(columns)] * len(got) and all(len(str(r["digest"])) > 8 for r in got)

    return check


# --- personal data ---------------------------------------------------------------------------------------


def pii_detect(t):
    return [{"doc_id": d["doc_id"], "start": m.start(), "end": m.end(), "entity": "EMAIL"} for d in t["documents"] for m in MAIL.finditer(d["text"])]


def pii_mask(t):
    return [{"doc_id": d["doc_id"], "masked": hashlib.sha256(MAIL.sub("[EMAIL]", d["text"]).encode()).hexdigest()} for d in t["documents"]]


def pii_events(t):
    n = {d["doc_id"]: len(MAIL.findall(d["text"])) for d in t["documents"]}
    return [{"doc_id": k, "entity": "EMAIL" if v else "NONE", "n": v} for k, v in n.items()]


# --- retrieval ---------------------------------------------------------------------------------------------


def ranked(t):
    from lakeloom.plans.q_retrieval import LEX_SQL

    rows = t["duck"].execute(f"WITH {LEX_SQL} SELECT qid, chunk_id, rare_hits, score, matched, rank FROM lex").fetchall()
    return [dict(zip(("qid", "chunk_id", "rare_hits", "score", "matched", "rank"), r, strict=True)) for r in rows]


def _quality(t):
    from lakeloom.plans.q_text import txt_quality_score  # noqa: F401
    from lakeloom.plans.registry import ORACLE_SQL

    return {d * LINE_ID + s: (score, kept) for d, s, score, kept in t["duck"].execute(f"SELECT doc_id, seq, score, kept FROM ({ORACLE_SQL['txt_quality_score']})").fetchall()}


def ret_candidates(t):
    quality, text, out = _quality(t), {c["chunk_id"]: c["text"] for c in lines(t)}, []
    for qid, rows in _by(ranked(t), "qid").items():
        seen = []
        for r in sorted(rows, key=lambda r: r["rank"]):
            body = squeezed(text[r["chunk_id"]])
            if quality[r["chunk_id"]][1] and body not in seen:
                seen.append(body)
                out.append({"qid": qid, "chunk_id": r["chunk_id"], "quality": quality[r["chunk_id"]][0], "rank": len(seen)})
    return [r for r in out if r["rank"] <= 20]


def ret_near_copies(t):
    text, out = {c["chunk_id"]: print_of(c["text"]) for c in lines(t)}, []
    for qid, rows in _by(ranked(t), "qid").items():
        rows = sorted(rows, key=lambda r: r["rank"])
        for i, r in enumerate(rows):
            f = text[r["chunk_id"]]
            if not any(text[b["chunk_id"]] == f or jaccard(grams(text[b["chunk_id"]]), grams(f)) >= 0.9 for b in rows[:i]):
                out.append({"qid": qid, "chunk_id": r["chunk_id"], "rank": r["rank"]})
    return out


def _terms(text):
    return set(re.findall("[가-힣a-z0-9]{2,}", text.lower()))


def _lexical(questions, chunks):
    """{question: [chunk ids, best first]} by the rules of the lexical ranking, from {question: terms} and {chunk: terms}."""
    n, df, out = len(chunks), Counter(w for c in chunks.values() for w in c), {}
    idf = lambda w: math.log(1 + n / (1 + df[w]))
    for q, asked in questions.items():
        focus = set()
        if len(asked) > 2 and n >= 200:
            focus = {w for w in sorted(asked, key=lambda w: (-idf(w), -len(w), w))[:2] if df[w]}
            if not focus:
                continue
        found = []
        for c, own in chunks.items():
            shared = asked & own
            rare = sum(df[w] <= max(3, math.floor(n * 0.1)) for w in shared)
            if len(shared) >= 2 and rare and (not focus or shared & focus):
                found.append((-rare, -round(sum(min(len(w), 4) * idf(w) for w in shared), 9), -len(shared), c))
        out[q] = [f[-1] for f in sorted(found)[:20]]
    return {q: c for q, c in out.items() if c}


def expanded_search(questions, chunks, floor):
    n, df, out = len(chunks), Counter(w for c in chunks.values() for w in c), []
    weight = lambda w: min(len(w), 4) * math.log(1 + n / (1 + df[w]))

    def judged(q, hits):
        whole = sum(map(weight, questions[q]))
        scored = [(-round(sum(map(weight, questions[q] & chunks[c])) / whole, 9), i, c) for i, c in enumerate(hits)]
        ranked = [(c, -s, i) for i, (s, _, c) in enumerate(sorted(scored), 1)]
        top = ranked[0][1]
        kept = [r for r in ranked if r[1] >= max(floor, top * 0.25)]
        return kept or ranked[:1], not kept or top < floor

    first = _lexical(questions, chunks)
    more, results = {}, {q: judged(q, hits) for q, hits in first.items()}
    for q, (_, weak) in results.items():
        if weak:
            near = Counter(w for c in first[q][:5] for w in chunks[c] - questions[q])
            best = sorted((-k, -round(weight(w), 9), w) for w, k in near.items() if k >= 2)[:6]
            more[q] = questions[q] | {w for _, _, w in best}
    second = {q: judged(q, hits) for q, hits in _lexical(more, chunks).items()}
    for q, result in results.items():
        better = q in second and second[q][0][0][1] > result[0][0][1]
        kept, weak = second[q] if better else result
        out += [{"qid": q, "chunk_id": c, "score": s, "rank": i, "weak": weak, "expanded": better} for c, s, i in kept]
    return out


def ret_expand_query(t):
    questions = {b["item_id"]: _terms(b["text"]) for b in t["benchmark"]} | {-1 - d["doc_id"]: _terms(d["text"]) for d in t["documents"] if d["doc_id"] % 50 == 0}
    return expanded_search(questions, {c["chunk_id"]: _terms(c["text"]) for c in lines(t)}, 0.6)


def ret_refs(t):
    chunks, out = lines(t), []
    by_id = {c["chunk_id"]: c for c in chunks}
    first = defaultdict(list)
    for c in chunks:
        word = re.match(r"[A-Za-z0-9_]+", c["text"])
        first[c["doc_id"], word[0] if word else ""].append(c["chunk_id"])
    for qid, rows in _by(ranked(t), "qid").items():
        best = {r["chunk_id"]: (0, r["rank"]) for r in rows}
        for r in rows:
            c = by_id[r["chunk_id"]]
            for word in re.findall(r"\. ([A-Za-z0-9_]+)", c["text"]):
                for other in first[c["doc_id"], word]:
                    best[other] = min(best.get(other, (2, 0)), (1, r["rank"]))
        order = sorted(best, key=lambda k: (best[k][1], best[k][0], k))
        out += [{"qid": qid, "chunk_id": k, "rank": i} for i, k in enumerate(order, 1) if i <= 20]
    return out


def _by(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def txt_index_ready(t):
    quality, out = _quality(t), []
    for doc, rows in _by(lines(t), "doc_id").items():
        sound = [r for r in rows if quality[r["chunk_id"]][1]]
        out += [{"doc_id": doc, "chunk_id": r["chunk_id"]} for r in sound or rows]
    return out


# --- chunks and duplicates -----------------------------------------------------------------------------------


def chunk_rules(got, t, spark, query):
    """Chunks in order hold the document's substance once, none beyond the cap, and none thin but a lone one; the table function agrees."""
    from lakeloom.plans.catalog import QUERIES

    by = _by(got, "doc_id")
    for d in t["documents"]:
        rows = sorted(by.get(d["doc_id"], []), key=lambda r: r["seq"])
        assert [r["seq"] for r in rows] == list(range(len(rows)))
        bodies = [print_of(r["text"]) for r in rows]
        assert len(set(bodies)) == len(bodies) and all(len(r["text"]) <= 1400 for r in rows)
        whole, at = print_of(d["text"]), 0
        for b in bodies:  # in order of first occurrence, nothing invented
            at = whole.find(b, at)
            assert at >= 0
        assert set(squeezed(d["text"]).split()) == {w for r in rows for w in r["text"].split()}
        assert len(rows) <= 1 or sum(len(b) < 40 for b in bodies) <= len([b for b in bodies if len(b) > 300]) + 1
    other = QUERIES["udtf_chunk" if query == "txt_chunk" else "txt_chunk"](spark, t["folder"]).collect()
    assert sorted((r.doc_id, r.seq, r.heading, r.text) for r in other) == sorted((r["doc_id"], r["seq"], r["heading"], r["text"]) for r in got)
    text = {d["doc_id"]: d["text"] for d in t["documents"]}
    assert all(not r["heading"] or r["heading"] in text[r["doc_id"]] for r in got)


def txt_corpus_reasons(t):
    chunks = [c for c in lines(t) if c["text"]]
    own = {c["chunk_id"]: grams(print_of(c["text"])) for c in chunks}
    docs_of = defaultdict(set)
    for c in chunks:
        for g in own[c["chunk_id"]]:
            docs_of[g].add(c["doc_id"])
    n_docs = len({c["doc_id"] for c in chunks if own[c["chunk_id"]]})
    common = {g for g, d in docs_of.items() if len(d) >= max(5, math.ceil(n_docs * 0.05))}
    heads = Counter((c["doc_id"], print_of(x.strip())) for c in chunks for x in c["text"].split("\n") if 2 <= len(print_of(x.strip())) <= 40)
    out = []
    for c in chunks:
        g = own[c["chunk_id"]]
        boiler = len(g) >= 3 and len(g & common) / len(g) >= 0.6
        solid = [print_of(x.strip()) for x in c["text"].split("\n") if print_of(x.strip())]
        head = bool(solid) and all(2 <= len(x) <= 40 and heads[c["doc_id"], x] >= 3 for x in solid)
        if boiler or head:
            out.append({"chunk_id": c["chunk_id"], "boilerplate": boiler, "header_footer": head})
    return out


def ddp_near_chunk(t):
    out = []
    for doc, rows in _by(lines(t), "doc_id").items():
        kept = []
        for c in sorted(rows, key=lambda c: (-len(print_of(c["text"])), c["chunk_id"])):
            f = print_of(c["text"])
            if not f:
                continue
            if any(f in k or jaccard(grams(f), grams(k)) >= 0.9 for k in kept):
                out.append({"doc_id": doc, "chunk_id": c["chunk_id"]})
            else:
                kept.append(f)
    return out


def doc_groups(got, t, spark, query):
    """Representatives are earlier documents near enough; documents surely near an earlier representative have one, and unlike ones don't (the sketch may err between)."""
    sets = {d["doc_id"]: grams(print_of(d["text"])) for d in t["documents"]}
    df = Counter(g for s in sets.values() for g in s)
    common = {g for g, n in df.items() if n > max(2, int(len(sets) * 0.5))}
    sets = {k: s - common or s for k, s in sets.items()}
    told = {r["doc_id"]: r["representative"] for r in got}
    assert set(told) == set(sets)
    kept = [k for k, v in told.items() if k == v]
    assert all(v <= k and told[v] == v for k, v in told.items())
    for k, v in told.items():
        if k != v:
            assert jaccard(sets[k], sets[v]) >= 0.45
        else:
            assert not any(b < k and jaccard(sets[k], sets[b]) >= 0.75 for b in kept)


def er_variants(t):
    n = Counter((d["lang"], w) for d in t["documents"] for w in re.findall("[a-z]+", d["text"].lower()))
    names = defaultdict(list)
    for (kind, w), k in n.items():
        names[kind].append((-k, len(w), w))
    out = []

    def close(x, y):
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
        return abs(len(x) - len(y)) <= 2 and (x in y or y in x)

    for kind, rows in names.items():
        kept = []
        for _, _, w in sorted(rows):
            head = next((k for k in kept if close(k, w)), None)
            if head is None:
                kept.append(w)
            out.append({"kind": kind, "name": w, "canonical": head or w})
    return out


# --- alignment and evaluation --------------------------------------------------------------------------------


def _sections(t, low, high):
    return {(c["conv_id"], c["turn"]): (set(re.findall("[a-z]{2,}", c["text"].lower())), c["role"], ["dialogue", f"part {c['turn']}"]) for c in t["conversations"] if low <= c["turn"] <= high}


def _overlaps(a, b):
    """Weighted Jaccard of section words, by (pair, path of a, path of b)."""
    weight, out = {}, {}
    for pair in {p for p, _ in (*a, *b)}:
        bags = [w for side in (a, b) for (p, _), (w, *_) in side.items() if p == pair and w]
        df = Counter(w for bag in bags for w in bag)
        for w, n in df.items():
            weight[pair, w] = math.log((len(bags) + 1) / (n + 0.5))
    for (p, x), (wx, *_) in a.items():
        for (q, y), (wy, *_) in b.items():
            if p == q and wx & wy:
                s = sum(weight[p, w] for w in wx & wy)
                out[p, x, y] = s / (sum(weight[p, w] for w in wx) + sum(weight[p, w] for w in wy) - s)
    return out


def _best(scored, accept, margin, ratio=1.0):
    by, chosen = defaultdict(list), []
    for (p, x, y), s in scored.items():
        by[p, x].append((-s, y))
    for (p, x), rows in by.items():
        rows.sort()
        s, second = -rows[0][0], -rows[1][0] if len(rows) > 1 else 0.0
        if s >= accept and s - second >= margin and s >= ratio * second:
            chosen.append((p, x, rows[0][1], s))
    out = {}
    for p, x, y, s in sorted(chosen, key=lambda r: (-r[3], r[1])):
        out.setdefault((p, y), {"pair": p, "a_path": x, "b_path": y, "score": s})
    return list(out.values())


def jn_align_content(t):
    return _best(_overlaps(_sections(t, 0, 3), _sections(t, 2, 9)), 0.2, 0.05, 2.0)


def aligned(a, b, accept=0.25, margin=0.08):
    """Links of sections (pair, path, parent, title, ancestors, words) by title, ancestors and bodies, one step after the other."""
    out = []
    for pair in sorted({s["pair"] for s in a} & {s["pair"] for s in b}, key=repr):
        x, y = ([s for s in side if s["pair"] == pair] for side in (a, b))
        body = _overlaps({(0, s["path"]): (s["words"],) for s in x}, {(0, s["path"]): (s["words"],) for s in y})
        bigrams = lambda s: {s[i : i + 2] for i in range(max(1, len(s) - 1))}
        titles = Counter(s["title"] for s in x), Counter(s["title"] for s in y)
        cands = []
        for p in x:
            for q in y:
                if p["title"] != q["title"] or not p["title"]:
                    continue
                up, uq = p["ancestors"], q["ancestors"]
                levels = [(w, jaccard(bigrams(m), bigrams(n))) for w, m, n in zip((0.6, 0.3, 0.1), up, uq, strict=False)]
                anc = 1.0 if not up and not uq else sum(w * j for w, j in levels) / sum(w for w, _ in levels) if levels else 0.0
                near = 1.0 if not up and not uq else levels[0][1] if levels else 0.0
                words = body.get((0, p["path"], q["path"]), 0.0)
                generic = max(n[p["title"]] for n in titles) >= 3
                if not p["words"] and not q["words"]:
                    score = 0.0
                elif not generic:
                    score = 0.5 * anc + 0.5 * words
                else:
                    score = 0.3 * anc + 0.7 * words if near >= 0.5 and words >= 0.15 else 0.0
                if score > 0:
                    cands.append((score, p, q, generic))
        cands.sort(key=lambda c: (-c[0], c[1]["path"], c[2]["path"]))
        links, used_p, used_q = {}, set(), set()
        for score, p, q, generic in cands:
            if score < accept or (generic and (p["path"] in used_p or q["path"] in used_q)):
                continue
            if generic:
                rival = max((s for s, u, v, g in cands if g and u["title"] == p["title"] and (u is p) != (v is q) and u["path"] not in used_p and v["path"] not in used_q), default=0.0)
                if score - rival < margin:
                    continue
                used_p.add(p["path"])
                used_q.add(q["path"])
            links[p["path"], q["path"]] = score, generic
        by_path = [{s["path"]: s for s in side} for side in (x, y)]
        while True:
            bad = []
            for (i, j), (_, generic) in links.items():
                up, uq = by_path[0].get(by_path[0][i]["parent"]), by_path[1].get(by_path[1][j]["parent"])
                if generic and up and uq and up["title"] == uq["title"] and up["title"] and (up["path"], uq["path"]) not in links:
                    bad.append((i, j))
            if not bad:
                break
            for k in bad:
                del links[k]
        out += [{"pair": pair, "a_path": i, "b_path": j, "score": s} for (i, j), (s, _) in links.items()]
    return out


def jn_align_context(t):
    def side(low, high):
        out = []
        for (pair, turn), (words, role, _) in _sections(t, low, high).items():
            chain, place = [], turn - low
            while place > 0 and len(chain) < 3:
                place = (place - 1) // 2
                chain.append(f"part {place}")
            out.append({"pair": pair, "path": turn, "parent": low + (turn - low - 1) // 2 if turn > low else None, "title": role, "ancestors": chain, "words": words})
        return out

    return aligned(side(0, 3), side(2, 9))


def matched_titles(left, right, least=0.6):
    """Equal keys in order of ids, then the best pair left by bigrams again and again."""
    key = lambda s: re.sub("[^가-힣A-Za-z0-9]", "", re.sub(r"^[ \t\n\x0b\f\r]*[0-9]+(?:[.)-][0-9]*)*[ \t\n\x0b\f\r]*", "", s or "")).lower()
    sides = [sorted((i, key(x)) for i, x in side if key(x)) for side in (left, right)]
    out, used = [], (set(), set())
    for k in {k for _, k in sides[0]} & {k for _, k in sides[1]}:
        for a, b in zip(*([i for i, x in side if x == k] for side in sides), strict=False):
            out.append((a, b, 1.0))
            used[0].add(a)
            used[1].add(b)
    grams = lambda s: {s[i : i + 2] for i in range(max(1, len(s) - 1))}
    x, y = ([(i, grams(k)) for i, k in side if i not in u] for side, u in zip(sides, used, strict=True))
    scored = sorted((-len(p & q) / len(p | q), a, b) for a, p in x for b, q in y if len(p & q) / len(p | q) >= least)
    for s, a, b in scored:
        if a not in used[0] and b not in used[1]:
            used[0].add(a)
            used[1].add(b)
            out.append((a, b, -s))
    return out


def jn_fuzzy_title(t):
    first = lambda d: (d["doc_id"], (d["text"] or "").split("\n")[0])
    left, right = [first(d) for d in t["documents"] if len(d["source"]) < 5], [first(d) for d in t["documents"] if len(d["source"]) >= 5]
    return [{"left": a, "right": b, "score": round(s, 6)} for a, b, s in matched_titles(left, right)]


def flat_name(s):
    return re.sub(r"[ \t\n\x0b\f\r.]+", "", s or "").upper()


def found_names(text, names):
    """Longest names first, leftmost of equal ones; what is covered can't be found again."""
    text, hits, covered, out = flat_name(text), [], set(), []
    for name in names:
        at = text.find(name)
        while at >= 0:
            hits.append((-len(name), at, name))
            at = text.find(name, at + 1)
    for n, at, name in sorted(hits):
        if covered.isdisjoint(range(at, at - n)):
            covered.update(range(at, at - n))
            out.append((at, at - n, name))
    return sorted(out)


def classified(docs, names, floor=3):
    owners = defaultdict(set)
    for name, program in names:
        if len(flat_name(name)) >= 3:
            owners[flat_name(name)].add(program)
    out = []
    for doc, title, path, head in docs:
        score = Counter()
        for place, text in (("title", title), ("path", path), ("head", head)):
            n = Counter(p for *_, name in found_names(text, owners) for p in owners[name])
            for p, k in n.items():
                score[p] += 3 if place == "title" else 2 if place == "path" else min(k, 5)
        if score:
            (program, best), *rest = sorted(score.items(), key=lambda x: (-x[1], x[0]))
            out.append({"doc_id": doc, "program": program, "score": best, "sure": best >= floor and best >= 2 * (rest[0][1] if rest else 0)})
    return out


def er_classify(t):
    docs, names = [], []
    for d in t["documents"]:
        title = d["text"].split("\n")[0]
        docs.append((d["doc_id"], title, f"{d['source']}/{d['lang']}", d["text"]))
        w = [x for x in title.split(" ") if x]
        names += [(" ".join(w[:n]), d["source"]) for n in (1, 2)]
    return classified(docs, names)


def title_words(s):
    return re.findall(r"[^\s!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+", (s or "").lower(), re.ASCII)


def sequences(titles, least=2, longest=6):
    """{gram: (documents, mean place)} of repeated word sequences."""
    first = defaultdict(dict)
    for doc, title in titles:
        w = title_words(title)
        for n in range(1, (longest or len(w)) + 1):
            for i in range(len(w) - n + 1):
                first[" ".join(w[i : i + n])].setdefault(doc, i / len(w))
    return {g: (len(p), round(sum(p.values()) / len(p), 9)) for g, p in first.items() if len(p) >= least}


def mined_names(titles, bodies, least=2, longest=6, least_bodies=2, least_mentions=2.0):
    found = sequences(titles, least, longest)
    inside = lambda g, h: g != h and f" {g} " in f" {h} "
    roles = {g for g, (_, p) in found.items() if " " not in g and p >= 0.45 and len(g) >= 2}
    core = {}
    for g, (n, p) in found.items():
        longer = any(k >= n and len(h.split()) == len(g.split()) + 1 and inside(g, h) for h, (k, _) in found.items())
        if not longer and p <= 0.25 and len(re.sub(r"[\W_]+", "", g, flags=re.ASCII)) >= 3 and not any(re.fullmatch(r"[0-9]{1,2}", w) for w in g.split()):
            core[g] = n
    kept = {g: n for g, n in core.items() if not any(inside(h, g) and roles & (set(g.split()) - set(h.split())) for h in core)}
    names = defaultdict(set)
    for g, n in kept.items():
        over = [h for h, m in kept.items() if inside(g, h) and m >= 0.6 * n]
        names[max(over, key=lambda h: (len(h), h)) if over else g].add(g)
    out = []
    for name, surfaces in names.items():
        if not any(re.fullmatch(r"[A-Za-z0-9.]{3,}", w) or len(re.findall("[가-힣]", w)) >= 3 for w in name.split()):
            continue
        key, seen = flat_name(name), Counter()
        for doc, text in bodies:
            text = flat_name(text)
            seen[doc] += sum(text.startswith(key, i) for i in range(len(text)))
        seen = {d: n for d, n in seen.items() if n}
        if len(seen) >= least_bodies and sum(seen.values()) >= least_mentions * len(seen):
            out.append({"name": name, "surfaces": sorted(surfaces | {name}), "titles": kept[name], "documents": len(seen), "mentions": sum(seen.values())})
    return out


def _titled(t):
    return [(d["doc_id"], d["text"].split("\n")[0]) for d in t["documents"]]


def er_mine_programs(t):
    return mined_names(_titled(t), [(d["doc_id"], d["text"]) for d in t["documents"]], least_mentions=1.0)


def er_roles(t):
    roles = {g for g, (_, p) in sequences(_titled(t), longest=1).items() if p >= 0.45 and len(g) >= 2}
    last = {doc: [w for w in title_words(title) if w in roles] for doc, title in _titled(t)}
    return [{"doc_id": doc, "role": w[-1]} for doc, w in last.items() if w]


def spaced(run, costs):
    """The cheapest cut of a run; of cuts that cost the same the one whose last words are shorter."""
    best = {0: (0.0, 0)}
    for end in range(1, len(run) + 1):
        best[end] = min((best[end - n][0] + costs.get(run[end - n : end], costs[""] + math.log(40) * n), n) for n in range(1, min(24, end) + 1))
    out, end = [], len(run)
    while end:
        out.insert(0, run[end - best[end][1] : end])
        end -= best[end][1]
    return out


def respaced(rows, t, spark, name):
    """Cuts cost what a plain search finds, and most spaces come back."""
    words = Counter(w for d in t["documents"] for w in re.split(r"[ \t\n\x0b\f\r]+", d["text"]) if w and len(w) <= 24)
    total = sum(words.values())
    costs = {w: -math.log(n / total) for w, n in words.items()} | {"": math.log(total + 1)}
    digest = {r["doc_id"]: r["digest"] for r in rows}
    assert set(digest) == {d["doc_id"] for d in t["documents"]}
    same = 0
    for d in t["documents"][:40]:
        text = re.sub(r"\S{10,}", lambda m: " ".join(spaced(m[0], costs)), d["text"].replace(" ", ""))
        same += hashlib.md5(text.encode()).hexdigest() == digest[d["doc_id"]]
    assert same == len(t["documents"][:40])
    wanted, given, right = (sum(r[c] for r in rows) for c in ("wanted", "given", "right"))
    assert 2 * right / (wanted + given) > 0.9, (wanted, given, right)


def _answers(t):
    by = defaultdict(list)
    for c in sorted(t["conversations"], key=lambda c: c["turn"]):
        if c["role"] == "assistant":
            by[c["conv_id"]].append((c["turn"], c["text"]))
    return [(k, n, x, y) for k, turns in by.items() for (n, x), (_, y) in zip(turns, turns[1:], strict=False) if y is not None]


def _trigram_recall(ref, got):
    ref, got = ("".join(x.split()) for x in (ref, got))
    want = [ref[i : i + 3] for i in range(len(ref) - 2)]
    return sum(g in got for g in want) / len(want) if want else None


def ev_ngram_recall(t):
    return [{"conv_id": k, "turn": n, "recall3": _trigram_recall(a, b)} for k, n, a, b in _answers(t)]


def ev_chrf_rouge(t):
    out = []
    for k, turn, hyp, ref in _answers(t):
        h, r = "".join(hyp.split()), "".join(ref.split())
        scores = []
        for n in range(1, 7):
            a, b = [h[i : i + n] for i in range(len(h) - n + 1)], [r[i : i + n] for i in range(len(r) - n + 1)]
            if a and b:
                same = sum(min(a.count(g), b.count(g)) for g in set(a))
                scores.append((same / len(a), same / len(b)))
        p, q = (sum(s[i] for s in scores) / len(scores) for i in (0, 1)) if scores else (0, 0)
        chrf = round(100 * 5 * p * q / (4 * p + q), 2) if p + q else 0.0
        x, y = hyp.split(), ref.split()
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if u == v else max(best[i][j + 1], best[i + 1][j])
        n = best[-1][-1]
        rouge = round(100 * 2 * (n / len(x)) * (n / len(y)) / (n / len(x) + n / len(y)), 2) if n else 0.0
        out.append({"conv_id": k, "turn": turn, "chrf": chrf, "rouge_l": rouge, "recall3": _trigram_recall(ref, hyp)})
    return out


WRITTEN = r"[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?"


def audited(program, path, review, turns, evidence):
    """Codes against a training pair, one check after the other."""
    blank = lambda x: not (x or "").strip(" ")
    n, out = len(turns), set()
    if blank(program):
        out.add("missing_program_id")
    if not path or any(map(blank, path)):
        out.add("missing_node_path")
    if review[0] not in ("accept", "corrected") or blank(review[1]) or not all(review[2].get(c) for c in ("grounding", "structure", "context", "privacy")):
        out.add("review_incomplete")
    if n == 0 or n % 2:
        return out | {"invalid_conversation"}
    valid = []
    if not evidence:
        out.add("missing_evidence_records")
    for doc, chunk, text, turn, whose in evidence:
        if doc is None or chunk is None or blank(text) or turn is None or not 0 <= turn < n or turn % 2:
            out.add("invalid_evidence_record")
        elif whose != program:
            out.add("cross_program_evidence")
        elif text not in (turns[turn][1] or ""):
            out.add("evidence_not_visible")
        else:
            valid.append((turn, text))
    numbers = lambda s: {x.replace(",", "") for x in re.findall(WRITTEN, s or "")}
    for i, (who, text) in enumerate(turns):
        if who != ("human", "gpt")[i % 2]:
            out.add("invalid_turn_order")
        if blank(text):
            out.add("empty_turn")
        if i % 2:
            before = [x for k, x in valid if k < i]
            if not before:
                out.add("answer_without_evidence")
            if numbers(re.sub(r"\[[0-9]+단계:[^\]]*\]|\[E[0-9]+\]", "", text or "")) - set().union(*map(numbers, before)):
                out.add("unsupported_number")
    return out


def ds_audit(t):
    by, out = defaultdict(list), []
    for c in sorted(t["conversations"], key=lambda c: c["turn"]):
        by[c["conv_id"]].append(c)
    for k, rows in by.items():
        fault = sum(len(c["text"] or "") for c in rows) % 11
        turns = [("human" if c["role"] == "user" else "gpt", c["text"]) for c in rows if c["role"] in ("user", "assistant")]
        program = " " if fault == 1 else f"p{k}"
        evidence = [(k, i, f"{x} unseen" if fault == 4 else x, 1 if fault == 3 and i == 0 else i, "another" if fault == 5 else program) for i, (_, x) in enumerate(turns) if i % 2 == 0 and fault != 2]
        checks = {c: c != "privacy" or fault != 6 for c in ("grounding", "structure", "context", "privacy")}
        review = ("reject" if fault == 7 else "accept", "" if fault == 8 else "r1", checks)
        out.append({"conv_id": k, "issues": ",".join(sorted(audited(program, [] if fault == 9 else ["root"], review, turns, evidence)))})
    return out


def organised(docs):
    """Units and their names, by reading sentence after sentence and breaking one circle after the other."""
    said = set()
    for doc, text in docs:
        for parent, items in re.findall(r"(?:^|[ \n])([^ \n,]+?)(?:에는|에| +직속으로) +([^.\n]+?)(?:을|를) *(?:두며|두고|둔다|두어|두되|둘 *수)", text or ""):
            for item in re.split(r", *| +및 +| +또는 +", items):
                unit = (re.match(r"^([^()]+?) *(?:\(|$)", item) or [None, ""])[1].strip()
                if not unit:
                    continue
                if unit != parent:
                    said.add((doc, "under", unit, parent))
                for note in re.findall(r"\(([^()]*)\)", item):
                    name = re.sub(r"^ *(?:구|옛|종전) *[:：]? *", "", note)
                    if name.strip() and name.strip() != unit:
                        said.add((doc, "former" if name != note else "alias", name.strip(), unit))
        for old, new in re.findall(r"([0-9A-Za-z가-힣·_-]+?)(?:을|를) +([0-9A-Za-z가-힣·_-]+?)(?:으로|로) +(?:명칭을 +)?(?:변경|개칭)", text or ""):
            if old != new:
                said.add((doc, "renamed", old, new))
    nexts = {}
    for doc, _, a, b in sorted(x for x in said if x[1] in ("renamed", "former")):
        nexts[a] = max(nexts.get(a, (doc, b)), (doc, b))

    def last(x):
        seen = []
        while x in nexts and x not in seen:
            seen.append(x)
            x = nexts[x][1]
        return min(seen[seen.index(x) :]) if x in seen else x

    votes = defaultdict(set)
    for doc, what, a, b in said:
        if what == "under" and last(a) != last(b):
            votes[last(a), last(b)].add(doc)
    left = {k: (len(d), max(d)) for k, d in votes.items()}
    while True:
        best = {}
        for (u, p), (n, doc) in left.items():
            best[u] = min(best.get(u, (-n, -doc, p)), (-n, -doc, p))
        circles, done = [], set()
        for u in best:
            way = []
            while u in best and u not in way and u not in done:
                way.append(u)
                u = best[u][2]
            if u in way:
                circles.append(way[way.index(u) :])
            done |= set(way)
        if not circles:
            break
        for circle in circles:
            weakest = min(circle, key=lambda u: (-best[u][0], -best[u][1], [-ord(x) for x in u]))
            del left[weakest, best[weakest][2]]
    units = {x for k in votes for x in k} | {last(b) for _, what, _, b in said if what != "under"}
    kinds = [("위원회", "위원회"), ("본부", "본부"), ("센터", "센터"), ("학과", "학과·계열"), ("계열", "학과·계열"), ("처", "처·국"), ("국", "처·국"), ("실", "실"), ("단", "단"), ("원", "원·관"), ("관", "원·관"), ("팀", "팀"), ("부", "부"), ("과", "과")]
    out = []
    for u in units:
        path = [u]
        while path[0] in best:
            path.insert(0, best[path[0]][2])
        out.append({
            "unit": u, "kind": next((k for end, k in kinds if u.endswith(end)), "기관"), "parent": best[u][2] if u in best else None, "path": " > ".join(path), "votes": -best[u][0] if u in best else 0,
            "aliases": sorted({a for _, what, a, b in said if what == "alias" and last(b) == u}), "former": sorted(a for a in nexts if last(a) == u and a != u),
        })
    return out


def er_dept_dictionary(t):
    docs, region = [], {r["r_regionkey"]: r["r_name"] for r in t["region"]}
    for k, name in region.items():
        docs.append((k, f"{name} 직속으로 {', '.join(sorted(n['n_name'] for n in t['nation'] if n['n_regionkey'] == k))}를 둔다."))
    for n in t["nation"]:
        k, name = n["n_nationkey"], n["n_name"]
        items = sorted(s["s_name"] + (f"(약칭: S{s['s_suppkey']})" if s["s_acctbal"] < 0 else f"(구: Old{s['s_suppkey']})" if s["s_acctbal"] > 5000 else "") for s in t["supplier"] if s["s_nationkey"] == k)
        if items:
            docs.append((k + 1000, f"{name}에는 {', '.join(items)}를 둔다. " + (f"{name}에 {region[n['n_regionkey']]}을 둘 수 있다." if k >= 20 else "")))
        docs.append((k + 2000, f"{name}_before에 사업{k}팀을 둔다. {name}_before을 {name}으로 명칭을 변경한다."))
    return organised(docs)


def chained(sections):
    """Steps down a tree of sections (doc, path, parent, seq, heading, text), one section after the other."""
    items = lambda x: [y.strip(" ") for y in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n", x or "") if y.strip(" ")]
    numbers = lambda xs: {y.replace(",", "") for x in xs for y in re.findall(WRITTEN, x)}
    by = {(s["doc_id"], s["path"]): s for s in sections}
    below = defaultdict(list)
    for s in sections:
        if s["parent"] is not None and s["parent"] != s["path"]:
            below[s["doc_id"], s["parent"]].append(s)
    out = []

    def walk(s, level, above, known):
        key, said = (s["doc_id"], s["path"]), items(s["text"])
        node = [*above, s["heading"] or ""]
        kids = sorted(below.get(key, []), key=lambda k: (k["seq"], k["path"]))
        outline = [(k["heading"] or "") + (": " + " ".join(items(k["text"])[:1])[:120] if items(k["text"]) else "") for k in kids]
        given = known | numbers(said) | numbers(node)
        told = numbers(outline) if outline else numbers(said)
        answer = "\n".join(f"- {x}" for x in outline) if outline else "\n".join(f"{i}) {x}" for i, x in enumerate(said, 1))
        if outline or said:
            out.append({"doc_id": key[0], "path": key[1], "level": level, "kind": "outline" if outline else "items", "node_path": " > ".join(node), "digest": hashlib.md5(answer.encode()).hexdigest(), "evidence": len(said), "unsupported": ",".join(sorted(told - given))})
        for k in kids:
            walk(k, level + 1, node, given | (told & given))

    for s in sections:
        if (s["doc_id"], s["parent"]) not in by:
            walk(s, 0, [], set())
    return out


def ds_tree_chains(t):
    sections = []
    for d in t["documents"]:
        for n, line in enumerate(d["text"].split("\n")):
            w = [x for x in line.split(" ") if x]
            sections.append({"doc_id": d["doc_id"], "path": n, "parent": (n - 1) // 3 if n else None, "seq": n, "heading": " ".join(w[:3]), "text": " ".join(w[3:])})
    return chained(sections)


def bootstrap(got, t, spark, query):
    """Means are exact; the interval holds the mean and is about as wide as the normal one; equal rows have weights of their own."""
    lang = {d["doc_id"]: d["lang"] for d in t["documents"]}
    by = defaultdict(list)
    for r in t["labels"]:
        by[lang[r["doc_id"]]].append(r["quality"])
    assert {r["lang"] for r in got} == set(by)
    for r in got:
        v = by[r["lang"]]
        p = sum(v) / len(v)
        assert abs(r["mean"] - p) < 1e-9 and r["low"] <= p <= r["high"]
        width = 2 * 1.96 * math.sqrt(p * (1 - p) / len(v))
        assert 0.6 * width <= r["high"] - r["low"] <= 1.6 * width + 1e-9
    from lakeloom.operators.aggregates import bootstrap as operator

    coins = spark.createDataFrame([("a", x % 2) for x in range(400)], "k string, v int")
    r = operator(coins, "k", "v", reps=500).first()
    assert 0.06 <= r.high - r.low <= 0.14


def agg_corpus_stats(t):
    order = sorted(t["embeddings"], key=lambda r: _signed(xxhash.xxh64_intdigest(r["vec_id"].to_bytes(8, "little"), 42)))
    s = [sum(x * y for x, y in zip(a["embedding"], b["embedding"], strict=True)) for a, b in zip(order, order[1:], strict=False)]
    mean = sum(s) / len(s)
    return [{"n": len(order), "floor": mean + 3 * math.sqrt(sum((x - mean) ** 2 for x in s) / len(s))}]


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


# --- streaming -------------------------------------------------------------------------------------------------


def _field(e):
    return f"{e['event_type']}/{e['ts']:%Y-%m-%d}"


def st_lease(t):
    state, out = {}, []

    def row(field, at, user, action, until):
        out.append({"field": field, "at": at, "user": user, "action": action, "until": until})

    for e in sorted(t["events"], key=lambda e: (_seconds(e["ts"]), str(e["user_id"]))):
        field, user, at = _field(e), str(e["user_id"]), _seconds(e["ts"])
        if field in state and state[field][2] < at:
            holder, _, until = state.pop(field)
            row(field, until, holder, "expire", until)
        if field not in state:
            state[field] = (user, at, at + 300)
            row(field, at, user, "acquire", at + 300)
            continue
        holder, since, until = state[field]
        if holder == user:
            until = at + 300
            row(field, at, user, "extend", until)
        else:  # two minutes from the start are the holder's, then half a minute from the request, never longer than before
            until = min(until, max(since + 120, at + 30)) if at >= since + 120 else min(until, since + 120)
            row(field, at, user, "wait", until)
        state[field] = (holder, since, until)
    for field, (holder, _, until) in state.items():
        row(field, until, holder, "expire", until)
    return out


def _seconds(ts):
    return (ts - ts.__class__(1970, 1, 1)).total_seconds()


def st_version(t):
    out, fields = [], defaultdict(list)
    for e in sorted(t["events"], key=lambda e: (_seconds(e["ts"]), e["event_id"])):
        fields[_field(e)].append(e)
    for field, rows in fields.items():
        version, text = 0, ""
        for n, e in enumerate(rows, 1):
            base = n - (3 if e["value"] > 90 else 1)
            if base == version:
                version, text, result = version + 1, e["props"], "applied"
            else:
                result = "same" if e["props"] == text else "conflict"
            out.append({"field": field, "seq": e["event_id"], "result": result, "version": version, "copy": e["props"] if result == "conflict" else None})
    return out


def st_debounce(t):
    out, fields = [], defaultdict(list)
    for e in t["events"]:
        fields[_field(e)].append(_seconds(e["ts"]) / 600)
    for field, times in fields.items():
        burst = []
        for at in [*sorted(times), math.inf]:
            if burst and (at - burst[-1] > 3 or at - burst[0] > 20):
                out.append({"field": field, "at": min(burst[-1] + 3, burst[0] + 20), "edits": len(burst)})
                burst = []
            burst.append(at)
    return out


def nearest(rows, t, spark, name):
    """Recall of at least 0.9 in the exact first ten; scores, order and filter are exact."""
    import numpy as np

    kept = [e for e in t["embeddings"] if name != "srt_ann_filtered" or e["label"] == 3]
    x = np.array([e["embedding"] for e in kept], np.float64)
    at = {e["vec_id"]: i for i, e in enumerate(kept)}
    queries = {e["vec_id"]: np.array(e["embedding"], np.float64) for e in t["embeddings"] if e["vec_id"] % 50 == 0}
    found, hits, wanted = defaultdict(list), 0, 0
    for r in rows:
        found[r["q"]].append(r)
    assert set(found) == set(queries)
    for q, v in queries.items():
        mine = sorted(found[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, min(10, len(kept)) + 1))
        scores = x @ v
        assert all(abs(scores[at[r["vec_id"]]] - r["score"]) < 1e-9 for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        best = {kept[i]["vec_id"] for i in np.argsort(-scores, kind="stable")[:10]}
        hits, wanted = hits + len(best & {r["vec_id"] for r in mine}), wanted + len(best)
    assert hits >= 0.9 * wanted, (hits, wanted)


ROWS = {
    f.__name__: f
    for f in (
        txt_minhash, txt_toc, txt_repair, num_canonical, num_mask, src_html, src_mht_eml, src_dir_listing, pii_detect, pii_mask, pii_events, ret_candidates, ret_near_copies, ret_expand_query,
        ret_refs, txt_index_ready, txt_corpus_reasons, ddp_near_chunk, er_variants, ds_tree_chains, ds_audit, er_dept_dictionary, er_mine_programs, er_roles, er_classify, jn_fuzzy_title, jn_align_content, jn_align_context, ev_ngram_recall, ev_chrf_rouge, agg_corpus_stats, st_lease, st_version, st_debounce,
    )
}
CHECKS = {"gr_fingerprint": _same_digest(("n", "digest")), "mig_digest": _same_digest(("name", "rows", "digest")), "txt_chunk": chunk_rules, "udtf_chunk": chunk_rules, "ddp_doc_groups": doc_groups, "agg_bootstrap": bootstrap, "txt_respace": respaced, "srt_ann_hnsw": nearest, "srt_ann_filtered": nearest}
