"""Presentation-level derivations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetgrid.functions.text import SPACE, col, let, none_if_blank, utrim

# Lookup tables.
FACULTIES = {"0": "共通教育", "1": "人文社会科学部", "2": "教育学部", "3": "理工学部", "4": "医学部", "5": "農林海洋科学部", "6": "地域協働学部"}
LEVELS = {"0": "初年次・教養", "1": "基礎", "2": "プラットフォーム科目", "3": "専門科目", "4": "卒業論文"}
FORMATS = {"1": "講義", "2": "演習", "3": "実験", "4": "実習"}
LANGUAGES = {"1": "日本語", "2": "英語", "3": "日本語・英語", "4": "外国語", "5": "その他"}
GOALS = {1: "貧困をなくそう", 2: "飢餓をゼロに", 3: "すべての人に健康と福祉を", 4: "質の高い教育をみんなに", 5: "ジェンダー平等を実現しよう", 6: "安全な水とトイレを世界中に", 7: "エネルギーをみんなに そしてクリーンに", 8: "働きがいも経済成長も", 9: "産業と技術革新の基盤をつくろう", 10: "人や国の不平等をなくそう", 11: "住み続けられるまちづくりを", 12: "つくる責任 つかう責任", 13: "気候変動に具体的な対策を", 14: "海の豊かさを守ろう", 15: "陸の豊かさも守ろう", 16: "平和と公正をすべての人に", 17: "パートナーシップで目標を達成しよう"}
RELATED_LABELS = ("関連科目", "RELATED COURSES", "COMPUTER LINK")
LINK = r"https?://[^\s<>\"'）」』】、。，]+|『[^』]*』|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CODE = r"(?<![0-9])[0-9]{5}(?![0-9])"
BULLET = r"^(?:[・･]|[①-⑳]|\(?[0-9]+\)?[.．)])\s*"
ENUMERATION = r"^(?:\([0-9]+\)|[0-9]+[.．)、]|[①-⑳]|[・･])\s*"
CAN_DO = r"(?:できる|出来る)[。.．）)」]*$"
PALETTE_SIZE = 10


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def numbering(c: Column | str) -> Column:
    """struct<faculty, level, format, lang> of a code, null for another shape."""
    shape = r"^([0-9])[0-9]-([0-9])[0-9A-Z]{3}-([0-9])([0-9])$"
    part = lambda k: F.regexp_extract(col(c), shape, k)
    tables = (("faculty", FACULTIES, 1), ("level", LEVELS, 2), ("format", FORMATS, 3), ("lang", LANGUAGES, 4))
    return F.when(F.rlike(col(c), F.lit(shape)), F.struct(*[F.try_element_at(_table(t), part(k)).alias(n) for n, t, k in tables]))


def course_language(codes: Column | str) -> Column:
    """The first decodable language other than the default."""
    langs = F.transform(col(codes), lambda c: numbering(c)["lang"])
    return F.try_element_at(F.filter(langs, lambda s: s.isNotNull() & (s != LANGUAGES["1"])), F.lit(1))


def goal_items(goals: Column | str) -> Column:
    """array<struct<tag, text, canDo>>: lines, a leading tag lifted, one enumeration mark stripped."""
    raw = F.flatten(F.transform(col(goals), lambda g: F.split(g, "\n")))

    def item(line: Column) -> Column:
        tag = F.regexp_extract(utrim(line), r"^【([^】]*)】\s*", 1)
        tagged = F.rlike(utrim(line), F.lit(r"^【[^】]*】"))
        text = utrim(F.regexp_replace(F.regexp_replace(utrim(line), r"^【[^】]*】\s*", ""), ENUMERATION, ""))
        return F.struct(F.when(tagged, utrim(tag)).alias("tag"), text.alias("text"), F.rlike(text, F.lit(CAN_DO)).alias("canDo"))

    return F.filter(F.transform(raw, item), lambda i: i["text"] != "")


def teachers(names: Column | str) -> Column:
    """struct<rep, others>: the first marked name leads; marks are stripped."""
    each = F.filter(F.transform(col(names), utrim), lambda n: n != "")
    plain = lambda n: utrim(F.regexp_replace(n, r"^[◎○]\s*", ""))
    at = F.array_position(F.transform(each, lambda n: F.startswith(n, F.lit("◎"))), F.lit(True))
    rest = F.filter(each, lambda n, i: (i + 1) != at)
    return F.struct(F.when(at > 0, plain(F.try_element_at(each, at.cast("int")))).alias("rep"), F.transform(rest, plain).alias("others"))


def line_kind(line: Column) -> Column:
    """"" for a blank line, list for a bullet, else paragraph."""
    return F.when(line == "", "").when(F.rlike(line, F.lit(BULLET)), "list").otherwise("paragraph")


def prose_blocks(c: Column | str) -> Column:
    """array<struct<kind, items>>: runs of bullet lines are lists, others paragraphs; blank lines part paragraphs.

    Where runs begin and end is found by neighbours, so each line is copied once.
    """
    plain = lambda line: utrim(F.regexp_replace(line, BULLET, ""))

    def edges(kinds: Column, step: int) -> Column:
        return F.filter(F.transform(kinds, lambda k, i: F.when((k != "") & (F.coalesce(F.get(kinds, i + step), F.lit("")) != k), i)), lambda i: i.isNotNull())

    def blocks(each: Column, kinds: Column) -> Column:
        def block(a: Column, b: Column) -> Column:
            run, kind = F.slice(each, a + 1, b - a + 1), F.get(kinds, a)
            return F.struct(kind.alias("kind"), F.when(kind == "list", F.transform(run, plain)).otherwise(F.array(F.array_join(run, "\n"))).alias("items"))

        return F.zip_with(edges(kinds, -1), edges(kinds, 1), block)

    return let(F.transform(F.split(col(c), "\n"), utrim), lambda each: let(F.transform(each, line_kind), lambda kinds: blocks(each, kinds)))


def prose_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, kind, before): a row for each line with its kind and the kind of the line before, by a window over each text's lines."""
    rows = df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    kinds = rows.select(key, "at", line_kind(utrim("line")).alias("kind"))
    return kinds.withColumn("before", F.coalesce(F.lag("kind").over(Window.partitionBy(key).orderBy("at")), F.lit("")))


def link_parts(c: Column | str, pattern: str = LINK) -> Column:
    """array<struct<text, kind>> that tiles the text: url, title, email, or null between.

    The matches and what stands between them interleave to the whole text.
    """
    text = col(c)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    kind = lambda t: F.when(F.rlike(t, F.lit("^https?://")), "url").when(F.startswith(t, F.lit("『")), "title").otherwise("email")
    gaps = F.transform(between, lambda t: F.struct(t.alias("text"), F.lit(None).cast("string").alias("kind")))
    links = F.transform(found, lambda t: F.struct(t.alias("text"), kind(t).alias("kind")))
    return F.filter(F.flatten(F.transform(gaps, lambda g, i: F.when(i < F.size(links), F.array(g, F.get(links, i))).otherwise(F.array(g)))), lambda p: p["text"] != "")


def link_target(text: Column, kind: Column) -> Column:
    title = utrim(F.substring(text, F.lit(2), F.length(text) - 2))
    search = F.concat(F.lit("https://www.google.com/search?q="), uri_component(F.concat(F.lit("『"), title, F.lit("』"))))
    return F.when(kind == "url", text).when(kind == "email", F.concat(F.lit("mailto:"), text)).when((kind == "title") & (title != ""), search)


def course_codes(c: Column | str) -> Column:
    """All five-digit numbers that stand alone."""
    return F.regexp_extract_all(col(c), F.lit(CODE), F.lit(0))


def related_parts(c: Column | str, known: Column) -> Column:
    """array<struct<text, code>> that tiles the text; only numbers among ``known`` are codes."""
    text = col(c)
    found = F.regexp_extract_all(text, F.lit(CODE), F.lit(0))
    gaps = F.split(text, CODE, -1)
    kind = "array<struct<text:string,code:string>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit("").alias("buf"))
    pairs = F.transform(gaps, lambda g, i: F.struct(g.alias("gap"), F.get(found, i).alias("code")))

    def step(s: Column, p: Column) -> Column:
        buf = F.concat(s["buf"], p["gap"])
        hit = p["code"].isNotNull() & F.array_contains(known, p["code"])
        plain = F.filter(F.array(F.struct(buf.alias("text"), F.lit(None).cast("string").alias("code"))), lambda x: x["text"] != "")
        link = F.array(F.struct(p["code"].alias("text"), p["code"].alias("code")))
        return F.when(hit, F.struct(F.concat(s["out"], plain, link).alias("out"), F.lit("").alias("buf"))).otherwise(F.struct(s["out"].alias("out"), F.concat(buf, F.coalesce(p["code"], F.lit(""))).alias("buf")))

    return F.aggregate(pairs, start, step, lambda s: F.when(s["buf"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["buf"].alias("text"), F.lit(None).cast("string").alias("code"))))))


def is_related_label(c: Column | str) -> Column:
    found = F.lit(False)
    for label in RELATED_LABELS:
        found = found | F.contains(col(c), F.lit(label))
    return found


def goal_title(c: Column | str) -> Column:
    """Title of goals 1 to 17 by the leading number, else null."""
    return F.try_element_at(_table(GOALS), F.regexp_extract(col(c), r"^\s*([0-9]+)", 1).try_cast("int"))


def uri_component(c: Column | str) -> Column:
    """Percent-encoding as in browsers: form encoding with these five put right."""
    out = F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20"))
    for sign, code in (("~", "%7E"), ("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def encode_plan(codes: Column | str, version: int = 1) -> Column:
    """``1.code-code``, the separator escaped inside codes; no codes, no token."""
    parts = F.transform(col(codes), lambda c: F.replace(uri_component(c), F.lit("-"), F.lit("%2D")))
    return F.when(F.size(col(codes)) == 0, "").otherwise(F.concat(F.lit(f"{version}."), F.array_join(parts, "-")))


def decode_plan(token: Column | str) -> Column:
    """Codes of a token in order, each once; what cannot be read drops out."""
    text = col(token)
    dot = F.instr(text, F.lit("."))
    version = F.substring(text, F.lit(1), dot - 1).try_cast("double")
    payload = F.split(F.substring(text, dot + 1, F.length(text)), ";")[0]
    decoded = F.transform(F.split(payload, "-"), lambda p: F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))))
    codes = F.array_distinct(F.filter(decoded, lambda c: c.isNotNull() & (c != "")))
    return F.when((dot > 1) & (version >= 1), codes).otherwise(F.array().cast("array<string>"))


def plan_add(codes: Column, code: Column) -> Column:
    return F.when(F.array_contains(codes, code), codes).otherwise(F.array_append(codes, code))


def plan_toggle(codes: Column, code: Column) -> Column:
    return F.when(F.array_contains(codes, code), F.array_remove(codes, code)).otherwise(F.array_append(codes, code))


def highlight(text: Column, spans: Column) -> Column:
    """array<struct<text, mark>> that tiles the text once; spans ``struct<start, len>`` are clamped and may overlap."""
    size = F.length(text)
    start = F.struct(F.array().cast("array<struct<text:string,mark:boolean>>").alias("out"), F.lit(0).alias("at"))
    part = lambda a, b, mark: F.array(F.struct(F.substring(text, a + 1, b - a).alias("text"), F.lit(mark).alias("mark")))

    def step(s: Column, span: Column) -> Column:
        a = F.greatest(F.least(span["start"], size), s["at"])
        b = F.least(span["start"] + span["len"], size)
        gap = F.when(a > s["at"], part(s["at"], a, False)).otherwise(F.array().cast("array<struct<text:string,mark:boolean>>"))
        return F.when(b > a, F.struct(F.concat(s["out"], gap, part(a, b, True)).alias("out"), b.alias("at"))).otherwise(s)

    return F.aggregate(F.array_sort(spans), start, step, lambda s: F.when(s["at"] < size, F.concat(s["out"], part(s["at"], size, False))).otherwise(s["out"]))


def colour_bucket(code: Column | str) -> Column:
    """31 h + UTF-16 unit with 32-bit wrap, absolute, modulo the palette."""
    units = F.regexp_extract_all(F.hex(F.encode(col(code), "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    two = 1 << 32
    h = F.aggregate(units, F.lit(0).cast("bigint"), lambda h, u: F.pmod(h * 31 + F.conv(u, 16, 10).cast("bigint"), F.lit(two)))
    signed = F.when(h >= two // 2, h - two).otherwise(h)
    return (F.abs(signed) % PALETTE_SIZE).cast("int")


def default_term(month: Column) -> Column:
    return F.when(month.between(4, 7), "1学期").when(month.between(10, 12) | (month == 1), "2学期")


def default_term_in(available: Column, month: Column) -> Column:
    term = default_term(month)
    return F.when(F.array_contains(available, term), term).otherwise("all")


def academic_year(day: Column) -> Column:
    """January to March belong to the year before."""
    return F.year(F.add_months(day, -3))


def weekday_labels(saturday: Column) -> Column:
    five = [F.lit(d) for d in "月火水木金"]
    return F.when(saturday, F.array(*five, F.lit("土"))).otherwise(F.array(*five))


def instructor_short(c: Column | str) -> Column:
    names = F.filter(F.transform(F.split(col(c), ","), utrim), lambda n: n != "")
    first = F.coalesce(F.try_element_at(names, F.lit(1)), F.lit(""))
    return F.when(F.size(names) > 1, F.concat(first, F.lit(" ほか"))).otherwise(first)


def facet_line(raw: Column, term: Column, *others: Column) -> Column:
    """The slot text, or the term without one, and the other labels, joined by a middle dot."""
    keep = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(" · ", F.coalesce(keep(raw), keep(term)), *[keep(c) for c in others])


def bounded_pull(overshoot: Column, dimension: Column, c: float = 0.55) -> Column:
    """Monotone in the overshoot and bounded by the dimension."""
    return (F.lit(1.0) - F.lit(1.0) / (overshoot * c / dimension + 1)) * dimension


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def blank(c: Column | str) -> Column:
    return none_if_blank(c).isNull()


def collapse(c: Column | str) -> Column:
    return F.regexp_replace(utrim(c), f"{SPACE}+", " ")
