"""Explicit wording, refusals, redaction and chunking."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fitgrid.functions import text as T
from fitgrid.operators import facts
from fitgrid.operators.chunks import bounded_chunks, cut_points


def read(spark, parse, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    return [r.v for r in df.select("n", parse(F.col("text")).alias("v")).orderBy("n").collect()]


def test_annual_salaries_only(spark):
    assert read(
        spark, T.salary_values, "年収：600万円〜1,600万円", "年収 5,000,000円～7,000,000円", "月給 30万円〜40万円",
        "年収 900万円〜600万円", "Salary range: 6,000,000 JPY / year to 9,000,000 JPY / year",
        "9,000,000 JPY / year and 6,000,000 JPY / year", "年収　400 〜 500万",
    ) == [["6000000-16000000"], ["5000000-7000000"], [], [], ["6000000-9000000"], [], []]


def test_located_salary_needs_an_annual_word(spark):
    df = spark.createDataFrame([("給与", "600万円〜800万円"), ("年俸", "600万円〜800万円"), ("年収", "月給 60万円〜80万円")], "s string, t string")
    got = [r.v for r in df.select(T.located_salary_values(F.col("s"), F.col("t")).alias("v")).collect()]
    assert got == [[], ["6000000-8000000"], []]


def test_locations(spark):
    assert read(
        spark, T.location_values, "勤務地：東京都、大阪府 休日 土日", "勤務地 将来的に全国の可能性 休日 土日",
        "Work Location: Tokyo or Yokohama", "勤務地 東京都港区", "営業拠点は東京都です", "勤務地 東京都庁前と京都市 待遇 良",
    ) == [["東京都、大阪府"], [], ["東京都、神奈川県"], ["東京都"], [], ["東京都、京都府"]]
    assert read(spark, T.prefectures_in, "東京都市部", "札幌支社", "Narashino", "日本Osaka支社") == [
        ["東京都"], ["北海道"], [], ["大阪府"]]


def test_remote_and_office_days(spark):
    assert read(spark, T.remote_values, "フルリモート可", "フルリモート不可", "原則、出社です", "Fully remote team",
                "You must regularly work from our office", "リモートについては相談") == [
        ["true"], ["false"], ["false"], ["true"], ["false"], []]
    assert read(spark, T.office_day_values, "週3日の出社必須。週2日出社。", "週2日出社。", "週2日出社できる方",
                "in the office at least 3 days per week") == [["3"], ["2"], [], ["3"]]
    assert read(spark, T.work_location_anchors, "週0日出社。", "週5日出社必須", "週2日出社。", "出社必須") == [
        ["100"], ["0"], ["50"], ["0"]]


def test_schedules_and_employment(spark):
    assert read(spark, T.schedule_values, "フレックスタイム制（コアタイムなし）", "フレックスタイム制", "固定勤務時間", "no core time") == [
        ["100"], ["50"], ["0"], ["100"]]
    assert read(spark, T.employment_values, "雇用形態 正社員", "雇用形態　契約社員", "正社員を募集") == [
        ["FULL_TIME"], ["CONTRACTOR"], []]
    assert read(spark, T.role_values, "募集ポジション 営業 マネージャー 雇用形態 正社員", "募集中") == [["営業 マネージャー"], []]


def test_go_needs_a_context(spark):
    assert read(
        spark, T.technology_values, "We go fast", "Backend engineer (Go)", "日本Go language講座", "技術スタック: Rust、Node.js",
        "技術スタック：とても新しい", "Ruby on Rails and GitHub Actions", "Kubernates and k8s",
    ) == [[], ["Go"], ["Go"], ["Rust", "Node.js"], [], ["Ruby on Rails", "GitHub Actions"], ["Kubernetes"]]


def test_redaction(spark):
    texts = ["Mail hr.team@example.co.jp or +81 (0)3-1234-5678", "key sk-ABCDEFGHIJKLMNOP1234 and Bearer abcdefghijklmnop1",
             "short 12-34", "AIza" + "x" * 24]
    assert read(spark, T.redact, *texts) == [
        "Mail [email] or [phone]", "key [secret] and [secret]", "short 12-34", "[secret]"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    steps = T.redacted_step_by_step(df, "text").orderBy("n").collect()
    assert [r.redacted for r in steps] == read(spark, T.redact, *texts)
    assert [r.hits_secret + r.hits_bearer for r in steps] == [0, 2, 0, 1]


def fragments(spark, *rows):
    return spark.createDataFrame(rows, "document_id bigint, position int, section string, text string")


def test_facts_are_known_conflicting_or_unknown(spark):
    df = fragments(
        spark, (1, 1, None, "フルリモート可"), (1, 2, None, "年収 500万円〜600万円"), (1, 3, None, "年収 500万円〜600万円 です"),
        (2, 1, None, "フルリモート可"), (2, 2, None, "原則出社"), (3, 1, None, "月給 30万円"))
    got = {(r.document_id, r.kind): (r.status, r.value) for r in facts.facts_of(df, ["salary", "fullRemote"]).collect()}
    assert got == {
        (1, "salary"): ("known", "5000000-6000000"), (1, "fullRemote"): ("known", "true"), (2, "salary"): ("unknown", None),
        (2, "fullRemote"): ("conflicting", None), (3, "salary"): ("unknown", None), (3, "fullRemote"): ("unknown", None)}
    excerpt = facts.facts_of(df, ["salary"]).where("document_id = 1").first().excerpt
    assert excerpt == "年収 500万円〜600万円"


def test_fallback_reads_the_smallest_text(spark):
    df = fragments(
        spark, (1, 1, "給与", "年収"), (1, 2, "給与", "500万円〜600万円"), (2, 1, "a", "年収"), (2, 2, "b", "500万円〜600万円"),
        (2, 3, "c", "ほか"), (3, 1, None, "なし"))
    got = {r.document_id: (r.read_from, r.excerpt) for r in facts.field_with_fallback(df, "salary", T.salary_values).collect()}
    assert got == {1: ("section", "年収 500万円〜600万円"), 2: ("whole", "年収 500万円〜600万円")}


def judged(spark, choices, evidence):
    c = spark.createDataFrame([(1, "autonomy", k, p, conf) for k, p, conf in choices],
                              "document_id bigint, axis_key string, choice string, probability double, confidence double")
    e = spark.createDataFrame([(1, "autonomy", i, p, t) for i, (p, t) in enumerate(evidence)],
                              "document_id bigint, axis_key string, position int, probability double, text string")
    r = facts.axis_judgements(c, e).first()
    return r.status, r.anchor_value, r.anchor_max


@pytest.mark.parametrize("choices, expected", [
    ([("50", 0.9, 0.9), ("0", 0.1, 0.9)], ("known", 50, None)),
    ([("50", 0.9, 0.7), ("0", 0.1, 0.7)], ("unknown", None, None)),
    ([("50", 0.6, 0.6), ("100", 0.4, 0.6)], ("range", 50, 100)),
    ([("50", 0.6, 0.6), ("0", 0.25, 0.6), ("100", 0.15, 0.6)], ("range", 0, 50)),
    ([("0", 0.5, 0.5), ("100", 0.5, 0.5)], ("unknown", None, None)),
    ([("conflicting", 0.9, 0.9)], ("conflicting", None, None)),
    ([("none", 0.9, 0.9)], ("unknown", None, None)),
])
def test_judgements(spark, choices, expected):
    assert judged(spark, choices, [(0.9, "設計方針を決める")]) == expected


def test_a_judgement_needs_support(spark):
    sure = [("50", 0.9, 0.9)]
    assert judged(spark, sure, [(0.7, "設計方針を決める")])[0] == "unknown"
    assert judged(spark, sure, [(0.9, "フレックスタイム制")])[0] == "unknown"
    assert judged(spark, sure, [(0.9, "変更の範囲：会社の定める業務")])[0] == "unknown"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="あい。！? .;\n■-x", max_size=120), st.integers(1, 25))
def test_cuts_are_bounded_and_lose_nothing(text, limit):
    ends = cut_points(text, limit)
    starts = [0, *ends[:-1]]
    assert ends[-1] == len(text) and all(0 < b - a <= limit for a, b in zip(starts, ends) if text)
    pieces = [text[a:b].strip() for a, b in zip(starts, ends)]
    assert re.sub(r"\s", "", "".join(pieces)) == re.sub(r"\s", "", text)


def test_chunks_end_at_sentences(spark):
    df = spark.createDataFrame([(1, "一文目です。二文目です。三文目です。"), (2, "abc def ghi"), (3, "  ")], "document_id bigint, text string")
    rows = bounded_chunks(df, 8).orderBy("document_id", "part").collect()
    assert [(r.document_id, r.chunk) for r in rows] == [
        (1, "一文目です。"), (1, "二文目です。"), (1, "三文目です。"), (2, "abc def"), (2, "ghi")]
    assert len({r.chunk_id for r in rows}) == 5
