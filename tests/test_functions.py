from __future__ import annotations

import io
import zipfile
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakeloom.functions import numbers, privacy, text
from lakeloom.sources import documents


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "said, value",
    [("42명", 42), ("3,400,000원", 3400000), ("340만 원", 3400000), ("1억 2,000만원", 120000000), ("4.3점", Decimal("4.3")), ("3개 4개", None), ("없음", None), ("", None)],
)
def test_amounts(spark, said, value):
    got = one(spark, numbers.parse_amount(F.col("t")), t=said)
    assert got == value


def test_numbers_against_evidence():
    assert numbers.unsupported("총 6천만 원을 지원", ["60,000,000원"]) == []
    assert numbers.unsupported("총 7천만 원을 지원", ["60,000,000원"]) == ["7"]
    assert numbers.unsupported("500(백만원)", ["5억 원"]) == []
    assert numbers.unsupported("학생 500명", ["5억 원, (단위: 백만원)"]) == ["500"]
    assert numbers.canonical_numbers("3억 5천만") >= {"350000000", "3", "5"}
    assert numbers.canonical_numbers("1만 1799명") >= {"11799"}
    assert numbers.unsupported("| 구분 | 금액(천원) |\n| 장비 | 1,000 |", ["1,000,000원"]) == []


def test_numbers_masked():
    assert numbers.masked_numbers("2026년 300명", ["없음"]) == "2026년 ○○명"
    assert numbers.masked_numbers("3대 전략", []) == "3대 전략"


def test_sums():
    assert numbers.wrong_totals("750만 원(250만 원 × 3명)") == []
    assert numbers.wrong_totals("800만 원(250만 원 × 3명)")
    assert numbers.wrong_products("2 × 3 = 6, 2 x 3 = 7") == ["2 x 3 = 7"]


@pytest.mark.parametrize("said, month", [("2024.3", "2024-03"), ("2024년 11월", "2024-11"), ("3월", "3월"), ("2024.13", None), ("봄", None)])
def test_months(spark, said, month):
    assert one(spark, numbers.month_of(F.col("t")), t=said) == month


def test_quality(spark):
    def reasons(t):
        return one(spark, text.quality_reasons(F.col("t")), t=t)

    assert reasons("") == ["too_short"]
    assert reasons("- 12 -") == ["page_number", "symbol_only", "too_short"] or "page_number" in reasons("- 12 -")
    assert "symbol_only" in reasons("─────────")
    assert "question_only" in reasons("휴학 신청은 언제까지 하나요?")
    long_ = "휴학 신청은 학기 개시일부터 사 주 안에 학과장의 승인을 받아 교무처에 제출하여야 한다. 기간을 넘기면 다음 학기에 신청한다."
    assert reasons(long_) == []
    assert one(spark, text.quality_score(F.col("t"), text.quality_reasons(F.col("t"))), t=long_ * 5) == 1.0


def test_damage(spark):
    assert "split_syllables" in one(spark, text.damage_signals(F.col("t")), t="첨 단 신 소 재 와 학 과 는 기 업 의 요 구")
    assert "garbled" in one(spark, text.damage_signals(F.col("t")), t="是收百亡" * 15)


def test_small_text_functions(spark):
    assert one(spark, text.join_split_words(F.col("t")), t="첨 단 소 재 개발") == "첨단소재 개발"
    assert one(spark, text.fix_numbering(F.col("t")), t="1. 1. 목적") == "1. 목적"
    assert one(spark, text.clean_row(F.col("t")), t="a | | b|b | c") == "a | b | c"
    assert one(spark, text.family_key(F.col("t")), t="(붙임2) 사업 계획서.hwp") == "사업계획서"
    assert one(spark, text.attachment_number(F.col("t")), t="붙임 3. 서식") == 3
    assert one(spark, text.csv_safe(F.col("t")), t="=1+2") == "'=1+2"
    assert one(spark, text.csv_safe(F.col("t")), t="-12.5") == "-12.5"
    assert one(spark, text.particle(F.col("t"), F.lit("은/는")), t="학과") == "학과는"
    assert one(spark, text.particle(F.col("t"), F.lit("은/는")), t="학생") == "학생은"
    assert one(spark, text.sequence_ratio(F.col("a"), F.col("b")), a="abcd", b="abcd") == 1.0
    assert one(spark, text.nfc(F.col("t")), t="가\0") == "가"
    assert one(spark, text.one_typo(F.col("a"), F.col("b")), a="학과장", b="학괴장")


def test_merge(spark):
    m = one(spark, text.merge_three(F.col("a"), F.col("b"), F.col("c")), a="1\n2\n3", b="1\nx\n3", c="1\n2\n3\n4")
    assert m.text == "1\nx\n3\n4" and m.conflicts == []
    m = one(spark, text.merge_three(F.col("a"), F.col("b"), F.col("c")), a="1\n2\n3", b="1\nx\n3", c="1\ny\n3")
    assert m.text == "1\nx\n3" and m.conflicts == [1]


def test_privacy(spark):
    good = "900101-1234568"
    digits = good.replace("-", "")
    check = (11 - sum(int(d) * w for d, w in zip(digits, privacy.RRN_WEIGHTS)) % 11) % 10
    good = good[:-1] + str(check)
    bad = good[:-1] + str((check + 1) % 10)
    t = f"성명: 홍길동 {good} {bad} a.b@c.kr 010-1234-5678 학번 20241234"
    assert [k for _, _, k in privacy.spans_of(t)] == ["KR_NAME", "KR_RRN", "EMAIL", "KR_PHONE", "KR_STUDENT_ID"]
    df = spark.createDataFrame([(1, t), (2, None), (3, "nothing")], "doc_id long, text string")
    k = df.select("text", privacy.tokenize("text").alias("k"))
    assert all(r[0] == r[1] for r in k.select("text", privacy.restore(F.col("k.text"), F.col("k.vault"))).collect())
    assert rows(privacy.events(df).where("doc_id > 1")) == [(2, "NONE", 0), (3, "NONE", 0)]
    assert one(spark, privacy.mask("t"), t="메일 a@b.kr") == "메일 [EMAIL]"


def test_split_is_the_whole_hash(spark):
    import hashlib

    for s in ("a", "b", "세션", "x" * 50):
        want = "eval" if int(hashlib.sha256(f"salt:s:{s}".encode()).hexdigest(), 16) % 10 == 0 else "train"
        assert one(spark, privacy.split_of(F.col("t"), "salt"), t=s) == want


def test_html():
    html = "<html><head><title>T &amp; U</title><script>x<y</script></head><body><p>a<b>b</b></p><table><tr><th rowspan=2>h</th><td>1</td></tr><tr><td>2</td></tr></table></body></html>"
    assert documents.html_to_text(html) == "T & U\nab\nh | 1\n2"
    assert [c[1:] for c in documents.html_cells(html)] == [(0, 0, 2, 1, True, "h"), (0, 1, 1, 1, False, "1"), (1, 1, 1, 1, False, "2")]


def test_packages_and_mail():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", "<d xmlns:w='u'><w:p><w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:p/></d>")
    assert documents.office_to_text(data.getvalue()) == "ab"
    assert documents.office_to_text(b"nonsense") is None
    mail = b"Subject: s\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>hi</p>"
    assert documents.mail_to_text(mail) == "s\nhi"


def test_names_by_label_role_title_and_list():
    found = lambda t: [t[s:e] for s, e, k in privacy.spans_of(t) if k == "KR_NAME"]
    assert found("성 명: 홍길동, 소속 없음") == ["홍길동"]
    assert found("이름 김철수") == ["김철수"] and found("이름으로 변경한다") == []
    assert found("담당자 | 사무관 | 홍길동") == ["홍길동"] and found("과 장 | 이영희") == ["이영희"]
    assert found("신청인 자격은 없다") == [] and found("담당자: 박민수") == ["박민수"]
    assert found("성명 | 생년월일 | 연락처") == [] and found("성명 | 성명 | 성명") == [] and found("총장: 정보학과") == []
    assert found("참석자: 홍길동, 김철수, 이영희") == ["홍길동, 김철수, 이영희"]
    assert found("서울, 인천, 경기") == [] and found("참석자: 홍길동, 김철수") == []
    for t in ("성명 " * 20_000, "홍길동, " * 20_000, "가나다 | " * 20_000):
        privacy.spans_of(t)


def test_labelled_numbers():
    kinds = lambda t: [(k, t[s:e]) for s, e, k in privacy.spans_of(t)]
    assert kinds("학 번: 20201234") == [("KR_STUDENT_ID", "20201234")] and kinds("번호 20201234") == []
    assert kinds("생년월일 | 1990. 1. 2") == [("KR_BIRTHDATE", "1990. 1. 2")] and kinds("작성일 1990. 1. 2") == []
    assert kinds("입금계좌: 123-456-789012") == [("KR_BANK_ACCOUNT", "123-456-789012")] and kinds("품번 123-456-789012") == []
    assert kinds("880101-1234568")[:1] in ([], [("KR_RRN", "880101-1234568")])


def test_counts_in_context(spark):
    from lakeloom.functions import numbers

    def bad(draft, evidence):
        d = spark.createDataFrame([(1, draft)], "k int, draft string")
        e = spark.createDataFrame([(1, t, g) for t, g in evidence], "k int, text string, given boolean")
        return [(r.value, r.unit) for r in numbers.out_of_context(d, e, "k").orderBy("at").collect()]

    assert bad("팀 인원 4명", [("팀 4명으로 운영", False)]) == []
    assert bad("참여 인원 4명", [("팀 4명", False)]) == [("4", "명")]
    assert bad("참여 인원 4명", [("팀 4명", True)]) == []
    assert bad("참여 인원 30명", [("작년 30개 기관 참여", False)]) == [("30", "명")]
    assert bad("참여 인원 30명", [("| 구분 | 인원 |\n| 학생 | 30 |", False)]) == []
    assert bad("총 4회 운영", [("각 2회 운영", True)]) == [("4", "회")]
    assert bad("2026년 착수", [("없음", False)]) == []


def test_batches_are_worked_on_by_slices():
    import pyarrow as pa

    from lakeloom.sources import documents

    column = pa.array(["a\nb"] * 600)
    merged = list(text.merge_three.func(iter([(column, column, pa.array(["a\nb\nc"] * 600))])))
    mails = list(documents.mail_text.func(iter([pa.array([b"Subject: x\r\n\r\nbody", None] * 300)])))
    assert max(map(len, merged)) == text.SLICE and max(map(len, mails)) == documents.SLICE
    assert pa.concat_arrays(merged).to_pylist() == [{"text": "a\nb\nc", "conflicts": []}] * 600
    assert pa.concat_arrays(mails).to_pylist() == ["x\nbody", ""] * 300


def test_substance_is_put_together_from_runs(spark):
    from lakeloom.operators.similarity import fingerprint

    texts = ["a-b 가나!\n9é_\U0001f600z", "", None, "...", "㈜漢abc"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    plan = d.select(fingerprint(F.col("t")).alias("f"), F.size(text.damage_signals(F.col("t"))).alias("n"))
    assert [tuple(r) for r in plan.collect()] == [("ab가나9z", 0), ("", 0), ("", 0), ("", 0), ("abc", 0)]
    explained = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "[^" not in explained.split("AS f#")[0] and "CASE WHEN RLIKE(t" in explained
