import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetgrid.functions import present, rules, text


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["o"] for r in rows.select("k", expr(F.col("v")).alias("o")).orderBy("k").collect()]


def check(spark, cases, expr, kind="string"):
    assert column(spark, [c[0] for c in cases], expr, kind) == [c[1] for c in cases]


def test_fold(spark):
    check(spark, [("ＡＢ１２　ｘ", "ab12 x"), ("İÉß", "İÉß"), ("Ａ~～！", "a~~!"), ("微分ＸyZ", "微分xyz"), ("", ""), (None, None)], text.fold)


@settings(max_examples=100, deadline=None)
@given(st.text())
def test_fold_text_is_one_to_one_and_idempotent(s):
    once = text.fold_text(s)
    assert len(once) == len(s)
    assert text.fold_text(once) == once


def test_fold_agrees_with_python(spark):
    rng = random.Random(1)
    values = ["".join(chr(rng.choice((rng.randrange(32, 128), rng.randrange(0xFF00, 0xFF70), 0x3000, 0x130, 0x20BB7))) for _ in range(12)) for _ in range(300)]
    assert column(spark, values, text.fold) == [text.fold_text(v) for v in values]


def test_trim_and_buckets(spark):
    check(spark, [("　 a b　\n", "a b"), ("　", None), ("", None), (None, None)], text.none_if_blank)
    check(spark, [("　", "その他"), (None, "その他"), (" x ", "x")], text.or_other)


def test_credits(spark):
    cases = [("2単位", 2.0), (".5", 0.5), ("5.", 5.0), ("1.2.3", None), (".", None), ("２", None), ("　3 ", 3.0), ("", None), (None, None), ("x2", None), ("2", 2.0)]
    check(spark, cases, text.parse_credits)


def test_weekday_session_lines(spark):
    check(spark, [("月", 0), ("日", 6), ("x", None), ("月火", None), ("", None)], text.weekday_index)
    check(spark, [("第１０回", 10), ("第3回", 3), ("3回", None), ("第回", None)], text.session_number)
    check(spark, [("  a　 b \r\n\n c\n", "a b\nc"), ("\n　\n", "")], text.normalize_lines)
    check(spark, [("𠮷a", 3), ("", 0)], text.utf16_length)
    check(spark, [("Ａｂ１！ア", "Ab1！ア")], text.fold_alnum)


def test_head_bytes(spark):
    check(spark, [("abcdef", "abcd… (6 bytes)"), ("abcé", "abc… (5 bytes)"), ("ab", "ab"), ("a漢字", "a漢… (7 bytes)")], lambda c: text.head_bytes(c, 4))


def test_haystack_keeps_empty_required_parts(spark):
    row = spark.range(1).select(text.haystack(F.lit("Ａ"), F.lit(None).cast("string"), F.lit(""), F.lit("01"), F.lit("x"), F.lit(""), F.lit("y")).alias("h")).first()
    assert row["h"] == "a  01 x y"


def test_keyword_split(spark):
    cases = [("微分、積分，x,y　z\nw", ["微分", "積分", "x", "y", "z", "w"]), ("a(b、c)、d", ["a(b、c)", "d"]), ("a)b、c", ["a)b", "c"]), ("a（b、c", ["a（b、c"]), ("Euler Lagrange", ["Euler Lagrange"]), ("、、", []), ("", [])]
    check(spark, cases, rules.split_keywords)


def test_keyword_repair(spark):
    cases = [(["方程式(Euler", "Lagrange's", "equation)"], ["方程式(Euler Lagrange's equation)"]), (["a", "b)"], ["a", "b)"]), (["(", *"abcdefgh"], ["( a b c d e f", "g", "h"]), ([], [])]
    check(spark, cases, rules.repair_keywords, "array<string>")


def test_numbers_hours_segments(spark):
    check(spark, [("4 質の高い/13 気候\n x", ["4", "13"]), ("", [])], rules.goal_numbers)
    check(spark, [("２時間", 2.0), ("1時間半", 1.5), ("1～2時間", None), ("1時間と2時間", None), ("13時間", None), ("0.25 時間", 0.3), ("なし", None)], rules.study_hours)
    cases = [("予習：本を読む\n復習:ノート", "本を読む"), ("予習内容： x ", "x"), ("予習：\n次の行", None), ("x予習：y", None), (" 予習 ：z", "z")]
    check(spark, cases, lambda c: rules.labelled_segment(c, "予習"))
    check(spark, [("(（a", 2), ("))a", 0), ("(a)", 0)], rules.bracket_debt)


def test_textbooks(spark):
    rows = column(spark, ["特になし", "教科書：A\nB\n参考書\nC", "『なし』の本", "", "教科書なしで進めるので参考書は指定しないこととする予定です"], rules.textbook_info)
    assert rows[0]["isNone"] and rows[0]["sections"][0]["lines"] == ["特になし"]
    assert [(s["label"], s["lines"]) for s in rows[1]["sections"]] == [("教科書：A", ["B"]), ("参考書", ["C"])]
    assert not rows[2]["isNone"] and not rows[4]["isNone"]
    assert [(s["label"], s["lines"]) for s in rows[3]["sections"]] == [(None, [""])]


def test_classifiers(spark):
    cases = [("期末試験", "exam"), ("中間レポート", "report"), ("小レポート", "minireport"), ("小テスト", "quiz"), ("学習意欲・授業参加度", "attendance"), ("その他", "other"), ("毎回の小テスト試験", "quiz"), ("ミニレポート提出", "minireport"), ("定期", "exam"), ("期末レポートの提出", "report"), ("期末評価", "exam"), ("面接", "other")]
    check(spark, cases, rules.assessment_type)
    check(spark, [("対面", "onsite"), ("非対面", "unknown"), ("対面・遠隔", "hybrid"), ("オンデマンド", "ondemand"), ("オンデマンドと双方向", "online"), ("遠隔", "online"), ("", "unknown")], rules.delivery_mode)
    rows = spark.createDataFrame([("期末試験の解説", 15), ("臨床試験", 3), ("まとめ", 15), ("ガイダンス", 1), ("ガイダンス", 2)], "t string, n int")
    assert [r["k"] for r in rows.select(rules.plan_kind("t", "n").alias("k")).collect()] == ["exam", None, "milestone", "start", None]


def test_numbering_and_language(spark):
    got = column(spark, ["30-2A1B-12", "x", "90-9000-99"], present.numbering)
    assert got[0].asDict() == {"faculty": "理工学部", "level": "プラットフォーム科目", "format": "講義", "lang": "英語"}
    assert got[1] is None and set(got[2].asDict().values()) == {None}
    check(spark, [(["30-2A1B-11", "30-2A1B-12"], "英語"), ([], None)], present.course_language, "array<string>")


def test_goals_teachers_prose(spark):
    got = column(spark, [["【知識】1. 説明できる。\n2進数", "・ ", "①x"]], present.goal_items, "array<string>")[0]
    assert [(g["tag"], g["text"], g["canDo"]) for g in got] == [("知識", "説明できる。", True), (None, "2進数", False), (None, "x", False)]
    got = column(spark, [["○ 田中", "◎ 山田", " ", "◎佐藤"], []], present.teachers, "array<string>")
    assert (got[0]["rep"], got[0]["others"]) == ("山田", ["田中", "佐藤"]) and (got[1]["rep"], got[1]["others"]) == (None, [])
    got = column(spark, ["a\nb\n\n・x\n・y\nc\n1. z"], present.prose_blocks)[0]
    assert [(b["kind"], b["items"]) for b in got] == [("paragraph", ["a\nb"]), ("list", ["x", "y"]), ("paragraph", ["c"]), ("list", ["z"])]


def test_links_tile_the_text(spark):
    said = "see https://a.b/c、『本』 or x@y.zz."
    got = column(spark, [said, "", "none"], present.link_parts)
    assert "".join(p["text"] for p in got[0]) == said
    assert [(p["text"], p["kind"]) for p in got[0] if p["kind"]] == [("https://a.b/c", "url"), ("『本』", "title"), ("x@y.zz", "email")]
    assert got[1] == [] and [p["text"] for p in got[2]] == ["none"]
    check(spark, [("12345 123456 ａ54321", ["12345", "54321"])], present.course_codes)


def test_plan_tokens(spark):
    codes = [["001", "a-b", "é~!'()"], [], ["x y"]]
    tokens = column(spark, codes, present.encode_plan, "array<string>")
    assert tokens == ["1.001-a%2Db-%C3%A9~!'()", "", "1.x%20y"]
    assert column(spark, tokens, present.decode_plan) == codes
    cases = [("1.a-a-b;later", ["a", "b"]), ("0.a", []), ("x", []), ("1.%zz-b", ["b"]), ("2.a+b", ["a+b"]), ("1.", [])]
    check(spark, cases, present.decode_plan)


def test_highlight(spark):
    rows = spark.createDataFrame([("abcdef", [(1, 2), (2, 2), (4, 9)]), ("ab", [])], "t string, s array<struct<start:int,len:int>>")
    got = [[tuple(p) for p in r["o"]] for r in rows.select(present.highlight(F.col("t"), F.col("s")).alias("o")).collect()]
    assert got == [[("a", False), ("bc", True), ("d", True), ("ef", True)], [("ab", False)]]


@pytest.mark.parametrize(("code", "bucket"), [("", 0), ("a", 7), ("00123", None), ("微分", None)])
def test_colour_bucket(spark, code, bucket):
    h = 0
    for c in code:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    h = h - (1 << 32) if h >= 1 << 31 else h
    want = abs(h) % present.PALETTE_SIZE
    assert bucket is None or want == bucket
    check(spark, [(code, want)], present.colour_bucket)


def test_terms_years_names(spark):
    rows = spark.sql("select explode(sequence(1, 12)) as m")
    got = [r["t"] for r in rows.select("m", present.default_term(F.col("m")).alias("t")).orderBy("m").collect()]
    assert got == ["2学期", None, None, "1学期", "1学期", "1学期", "1学期", None, None, "2学期", "2学期", "2学期"]
    check(spark, [("2026-03-31", 2025), ("2026-04-01", 2026)], lambda c: present.academic_year(c.cast("date")))
    check(spark, [("a, b", "a ほか"), (" a ,", "a"), ("", "")], present.instructor_short)
    check(spark, [("4 x", "質の高い教育をみんなに"), ("18", None), ("x", None)], present.goal_title)
