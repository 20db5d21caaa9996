"""Queries against their SQL on rows that the given tables don't have."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from lakeloom.plans.catalog import ORACLE_SQL, QUERIES
from test_oracle import SF, plain


@pytest.fixture
def same(spark, tmp_path):
    """Runs a query on tables of one's own (name -> SQL that makes it from the given ones), holds it against its SQL, gives its rows."""

    def run(name: str, **tables: str) -> list[dict]:
        duck = duckdb.connect()
        for t, sql in tables.items():
            duck.execute(f"COPY ({sql.format(SF=SF)}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        rows = [r.asDict() for r in df.collect()]
        result = duck.execute(ORACLE_SQL[name])
        at = [[d[0] for d in result.description].index(c) for c in df.columns]
        assert Counter(tuple(plain(r[c]) for c in df.columns) for r in rows) == Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
        return rows

    return run


def documents(*texts: str, first: int = 0) -> str:
    rows = ", ".join(f"({first + 6 * i}, '{x}')" for i, x in enumerate(texts))
    return f"SELECT doc_id::BIGINT AS doc_id, text, 'en' AS lang, 'web' AS source, length(text)::BIGINT AS n_chars FROM (VALUES {rows}) v(doc_id, text)"


def test_outline_steps_with_supplier_keys_beyond_a_nations_range(same):
    of = "SELECT * FROM '{SF}/%s.parquet'"
    keys = "SELECT s_suppkey + i * 1000000 AS s_suppkey, s_name, s_nationkey, s_acctbal FROM '{SF}/supplier.parquet', range(2) r(i)"
    assert same("ds_outline_steps", region=of % "region", nation=of % "nation", supplier=keys)


def test_scrub_of_cards_that_share_a_sign_with_a_number_before(same):
    (row,) = same("prv_scrub", documents=documents("+1 (846) 555-8765", first=1))
    assert row["text"] == "+1 (846) 555-[CARD]-[CARD] 0004"


def test_residual_counts_of_cards_that_share_a_sign(same):
    assert same("pii_residual_scan", documents=documents("+1 (846) 555-8765", "010-1234-5678 01012345678.010.123.4567", first=1))


def test_tokens_stand_for_addresses_alone(same):
    """Numbers that a secret's digits happen to form are no addresses: the SQL and the text of the query don't have them."""
    got = same("pii_tokenize", documents=documents('a 900101-1234568 b c@d.io x', "c@d.io 010-1234-5678 e.f@g.org c@d.io"))
    assert sorted((r["tokens"], r["hidden"]) for r in got) == [(1, "c@d.io"), (2, "c@d.io e.f@g.org")]
    assert all(r["restored"] for r in got)


def test_section_hits_of_lines_that_begin_with_a_number(same):
    got = same("ret_section_hits", documents=documents("8316107434564120 Thanlyan of", "12 34 ab", "3. thanlyan OF"))
    assert sorted((r["qid"], r["n"]) for r in got) == [(0, 2), (6, 1), (12, 2)]


def test_heading_levels_of_chapters_and_articles(same):
    got = same("txt_heading_level", documents=documents("IV. Ofer", "제 3 조 목적", "가. 개요", "1.2 a", "1. a", "(1) a", "Inhain. a", " X . a", "I.", "XI. a"))
    assert [r["level"] for r in sorted(got, key=lambda r: r["doc_id"])] == [1, 2, 3, 3, 2, 4, None, 1, None, None]
