"""Rule-based splitting and classification of free text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetgrid.functions.text import SPACE, characters, col, fold_digits, let, lines, none_if_blank, utrim

# Word lists of the rules, in the order in which they are tried.
OPEN, CLOSE, SEPARATORS = ("(", "（"), (")", "）"), ("、", "，", ",", "　", "\n")
EXACT_ASSESSMENTS = {"期末試験": "exam", "中間試験": "exam", "期末レポート": "report", "中間レポート": "report", "小レポート": "minireport", "小テスト": "quiz", "学習意欲・授業参加度": "attendance", "その他": "other"}
ASSESSMENT_WORDS = {
    "quiz": ("小テスト", "小テ", "クイズ", "確認テスト"),
    "minireport": ("小レポート", "ミニレポート"),
    "exam": ("試験", "テスト", "定期"),
    "report": ("レポート", "課題", "提出", "作品", "小論"),
    "attendance": ("出席", "参加", "受講態度", "授業態度", "平常", "意欲", "取り組み"),
}
LATE_EXAM_WORDS = ("期末", "中間")
ONLINE_WORDS, ON_DEMAND_WORDS, LIVE_WORDS = ("オンライン", "遠隔", "双方向", "同時"), ("オンデマンド", "録画", "配信"), ("双方向", "同時")
EXAM_TERMS = ("期末試験", "定期試験", "中間試験", "最終試験", "筆記試験", "実技試験", "口述試験", "口頭試験", "期末テスト", "中間テスト", "定期テスト")
MILESTONE_TERMS = ("まとめ", "発表", "プレゼン", "報告会")
START_TERMS = ("オリエンテーション", "ガイダンス", "イントロダクション")
NO_BOOK_WORDS = ("特になし", "なし", "無し", "使用しない", "指定しない", "指定なし")
BOOK_LABELS = ("教科書", "参考書", "参考資料", "参考文献", "テキスト")
KINDS = ("exam", "report", "minireport", "quiz", "attendance", "other")
MODES = ("onsite", "online", "ondemand", "hybrid")


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def split_keywords(c: Column | str) -> Column:
    """Terms between separators outside brackets, trimmed, empty ones dropped.

    The fold runs over brackets and separators only and keeps where to cut.
    """
    text = col(c)
    signs = "".join(("\\" + s if s in "()" else s) for s in (*OPEN, *CLOSE, *SEPARATORS))
    marks = F.regexp_extract_all(text, F.lit(f"(?s)[^{signs}]*[{signs}]"), F.lit(0))
    start = F.struct(F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("at"), F.lit(0).alias("depth"))

    def step(s: Column, piece: Column) -> Column:
        sign, at = F.right(piece, F.lit(1)), s["at"] + F.length(piece)
        cut = sign.isin(*SEPARATORS) & (s["depth"] == 0)
        depth = F.when(sign.isin(*OPEN), s["depth"] + 1).when(sign.isin(*CLOSE), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(F.when(cut, F.array_append(s["cuts"], at)).otherwise(s["cuts"]).alias("cuts"), at.alias("at"), depth.alias("depth"))

    cuts = F.aggregate(marks, start, step, lambda s: s["cuts"])
    between = F.zip_with(cuts, F.slice(cuts, F.lit(2), F.size(cuts)), lambda a, b: F.substring(text, a + 1, F.when(b.isNull(), F.length(text) - a).otherwise(b - a - 1)))
    return F.filter(F.transform(between, utrim), lambda t: t != "")


def goal_numbers(c: Column | str) -> Column:
    """The first number of each part between line breaks or slashes."""
    found = F.transform(F.split(col(c), "[\n/]"), lambda s: F.regexp_extract(s, r"(\p{Nd}+)", 1))
    return F.filter(found, lambda n: n != "")


def bracket_debt(c: Column | str) -> Column:
    """Brackets opened and not closed; stray closing ones do not count."""
    def step(d: Column, ch: Column) -> Column:
        return F.when(ch.isin(*OPEN), d + 1).when(ch.isin(*CLOSE), F.greatest(d - 1, F.lit(0))).otherwise(d)

    return F.aggregate(characters(c), F.lit(0), step)


def repair_keywords(c: Column | str, most: int = 6) -> Column:
    """Entries joined by a space while a bracket is open, at most ``most`` times.

    The fold carries the entries joined so far (a few) and keeps where entries end.
    """
    entries = col(c)
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit("").alias("buf"), F.lit(0).alias("joined"), F.lit(0).alias("at"))

    def step(s: Column, k: Column) -> Column:
        first = s["buf"] == ""
        buf = F.when(first, k).otherwise(F.concat(s["buf"], F.lit(" "), k))
        joined = s["joined"] + F.when(first, 0).otherwise(1)
        full = F.aggregate(F.array(buf), F.lit(False), lambda _, b: bracket_debt(b) <= 0) | (joined >= most)
        return F.struct(
            F.when(full, F.array_append(s["ends"], s["at"] + 1)).otherwise(s["ends"]).alias("ends"),
            F.when(full, F.lit("")).otherwise(buf).alias("buf"), F.when(full, F.lit(0)).otherwise(joined).alias("joined"), (s["at"] + 1).alias("at"),
        )

    ends = F.aggregate(entries, start, step, lambda s: F.when(s["buf"] == "", s["ends"]).otherwise(F.array_append(s["ends"], s["at"])))
    begins = F.array_prepend(ends, F.lit(0))
    return F.zip_with(ends, F.slice(begins, F.lit(1), F.size(ends)), lambda b, a: F.array_join(F.slice(entries, a + 1, b - a), " "))


def study_hours(c: Column | str) -> Column:
    """The one "N hours (and a half)" of a text without ranges, from 0.25 to 12, to a tenth."""
    ascii_text = fold_digits(c)
    pattern = rf"([0-9]+(?:\.[0-9]+)?){SPACE}*時間(半)?"
    number = F.regexp_extract(ascii_text, pattern, 1).try_cast("double") + F.when(F.regexp_extract(ascii_text, pattern, 2) == "半", 0.5).otherwise(0.0)
    one = F.size(F.regexp_extract_all(ascii_text, F.lit(pattern), F.lit(0))) == 1
    return F.when(one & ~has_any(ascii_text, ("～", "〜", "~")) & number.between(0.25, 12.0), F.floor(number * 10 + 0.5) / 10)


def labelled_segment(c: Column | str, label: str) -> Column:
    """What follows ``label:`` (or ``label内容:``) on the first line that has something there."""
    gap = rf"[{SPACE}&&[^\n]]*"
    found = F.regexp_extract(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), rf"(?m)^{gap}{label}(?:内容)?{gap}[：:]{gap}([^\n]*?[^{SPACE}]){gap}$", 1)
    return F.nullif(found, F.lit(""))


def prep_info(c: Column | str) -> Column:
    """struct<hours, yoshu, fukushu>, null if all three are."""
    hours, before, after = study_hours(c), labelled_segment(c, "予習"), labelled_segment(c, "復習")
    return F.when(hours.isNotNull() | before.isNotNull() | after.isNotNull(), F.struct(hours.alias("hours"), before.alias("yoshu"), after.alias("fukushu")))


def textbook_info(c: Column | str) -> Column:
    """struct<isNone, sections array<struct<label, lines>>>: label lines open sections."""
    text = utrim(c)
    none = (F.length(text) <= 20) & ~has_any(text, ("『", "「")) & has_any(text, NO_BOOK_WORDS)
    section = "array<struct<label:string,lines:array<string>>>"
    label = f"^(?:{'|'.join(BOOK_LABELS)})(?:$|[：:【［\\[ 　])"
    each = F.filter(F.transform(F.split(text, "\n"), utrim), lambda s: s != "")
    is_label = lambda line: F.rlike(line, F.lit(label))

    def parted(each: Column, starts: Column) -> Column:
        def opened(a: Column, b: Column) -> Column:
            own, first = F.slice(each, a + 1, F.coalesce(b, F.size(each)) - a), F.get(each, a)
            after = F.slice(each, a + 2, F.coalesce(b, F.size(each)) - a - 1)
            return F.when(is_label(first), F.struct(first.alias("label"), after.alias("lines"))).otherwise(F.struct(F.lit(None).cast("string").alias("label"), own.alias("lines")))

        return F.zip_with(starts, F.slice(starts, F.lit(2), F.size(starts)), opened)

    starts_of = lambda each: F.filter(F.transform(each, lambda line, k: F.when((k == 0) | is_label(line), k)), lambda k: k.isNotNull())
    sections = let(each, lambda each: let(starts_of(each), lambda starts: parted(each, starts))).cast(section)
    whole = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.array(text).alias("lines"))).cast(section)
    return F.when(col(c).isNotNull(), F.struct(none.alias("isNone"), F.when(F.size(sections) > 0, sections).otherwise(whole).alias("sections")))


def plan_kind(text: Column | str, n: Column | str) -> Column:
    """exam, milestone, start (first session only) or null."""
    text = col(text)
    return F.when(has_any(text, EXAM_TERMS), "exam").when(has_any(text, MILESTONE_TERMS), "milestone").when((col(n) == 1) & has_any(text, START_TERMS), "start")


def assessment_type(c: Column | str) -> Column:
    """Exact labels first, then the specific kinds before the general ones."""
    text = col(c)
    out = None
    for label, kind in EXACT_ASSESSMENTS.items():
        out = F.when(utrim(text) == label, kind) if out is None else out.when(utrim(text) == label, kind)
    for kind, words in ASSESSMENT_WORDS.items():
        out = out.when(has_any(text, words), kind)
    return out.when(has_any(text, LATE_EXAM_WORDS), "exam").otherwise("other")


def delivery_mode(c: Column | str) -> Column:
    """Two signals, on site and remote, decide; a negated on-site word is none."""
    text = col(c)
    onsite = F.contains(text, F.lit("対面")) & ~F.contains(text, F.lit("非対面"))
    on_demand = has_any(text, ON_DEMAND_WORDS)
    remote = on_demand | has_any(text, ONLINE_WORDS)
    return F.when(onsite & remote, "hybrid").when(onsite, "onsite").when(on_demand & ~has_any(text, LIVE_WORDS), "ondemand").when(remote, "online").otherwise("unknown")


def known_kind(c: Column | str) -> Column:
    return F.when(col(c).isin(*KINDS), col(c)).otherwise("other")


def known_mode(c: Column | str) -> Column:
    return F.when(col(c).isin(*MODES), col(c))


def clean_lines(c: Column | str) -> Column:
    return F.filter(F.transform(lines(c), none_if_blank), lambda s: s.isNotNull())
