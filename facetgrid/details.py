"""Queries of detail pages, enrichment, presentation and bookkeeping over the driver's tables.

Pages and texts are put together from columns, so the SQL can say from the columns
what each operator should find in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgrid.functions import present, rules, text
from facetgrid.operators import detail, grid, html_detail, incremental, tallies
from facetgrid.plans import fields
from facetgrid.queries import YEAR_LONG, dealt, event_slots, query, table
from facetgrid.queries import _EVENTS as EVENTS
from facetgrid.queries import _ON_GRID as ON_GRID
from facetgrid.sources import index_codec, ingest, sinks

e = F.expr


def _list(c: Column | str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|")


# --- detail pages ---

_ROWS = (
    ("単位数", "concat(p_size % 4 + 1, '単位')"), ("授業の概要", "concat(' ', p_name, '<br>', p_brand, '  &amp; more')"),
    ("授業の目的", "concat('<table class=\"selectGroupTable\"><tr><td>', p_type, '</td></tr></table>')"), ("授業実施方法", "case p_partkey % 3 when 0 then '対面' when 1 then 'オンデマンド' else '対面とオンライン' end"),
    ("メディア授業科目", "case when p_partkey % 2 = 0 then '○' else '' end"), ("キーワード", "concat(p_name, '、', p_brand, '（', p_type, '、x）')"), ("SDGs", "concat(p_size % 17 + 1, ' goal<br>', '17 last')"),
    ("備考", "p_type"), ("年度", "'2026'"), ("教科書", "case when p_partkey % 2 = 0 then '' else p_name end"),
)


def detail_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(cd, html): a page for each part, with nested and mobile tables, a cut end and unclosed cells."""
    cells = [F.concat(F.lit(f"<tr><th>{label}<td>"), e(value), F.lit("</tr>")) for label, value in _ROWS]
    plan = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("p_size") % 3 + 1)), lambda k: F.concat(F.lit("<tr><td>第"), k.cast("string"), F.lit("回</td><td>授業概要</td><td>"), F.col("p_name"), F.lit(" "), k.cast("string"), F.lit("</td></tr>"))), "")
    html = F.concat(
        F.lit("<html><body><p>intro</p><table class='a'>"), *cells, F.lit("</table><table class='is-hidden-tablet'><tr><th>単位数</th><td>9</td></tr></table>"),
        F.lit("<table class='tbl_status_jugyo'>"), plan, F.lit("</table><table><tr><th>No</th><th>到達目標</th></tr><tr><th>1</th><td>"), F.col("p_type"), F.lit("できる</td></tr><tr><th>x</th><td>skip</td></tr></table>"),
        F.lit("<table><tr><th>評価項目</th><th>比重</th></tr><tr><th>期末試験</th><td>"), F.col("p_size").cast("string"), F.lit("%</td></tr><tr><th>レポート</th><td>なし</td></tr></table>"),
        F.lit("<table><tr><th>氏名</th><th>所属</th></tr><tr><td>"), F.col("p_brand"), F.lit("</td><td>x</td></tr></table><table><tr><th>ナンバリングコード</th></tr><tr><td>12-345A-1"), (F.col("p_size") % 5 + 1).cast("string"), F.lit("</td></tr></table>"),
        F.lit("<table><tr><th>氏名</th><th>曜日</th><th>場所</th></tr><tr><td>"), F.col("p_brand"), F.lit("</td><td>月</td><td>10:00</td><td>room "), F.col("p_partkey").cast("string"), F.lit("</td></tr></table><table><tr><th>cut"),
    )
    # A page is made and read by the task that has its row, and takes far longer than the row: few tasks read the table.
    return dealt(table(spark, sf, "part"), "p_partkey").select(F.col("p_partkey").cast("string").alias("cd"), html.alias("html"))


@query("""
select p_partkey::varchar as cd, (p_size % 4 + 1) || '単位' as unit, p_name || chr(10) || p_brand || ' & more' as summary, p_type as aims,
  case p_partkey % 3 when 0 then 'onsite' when 1 then 'ondemand' else 'hybrid' end as mode, p_partkey % 2 = 0 as media, p_name || '|' || p_brand || '（' || p_type || '、x）' as keywords,
  (p_size % 17 + 1) || '|17' as sdgs, '備考=' || p_type as extra, case when p_partkey % 2 = 1 then p_name end as textbooks,
  list_aggregate([k || ':' || p_name || ' ' || k for k in range(1, p_size % 3 + 2)], 'string_agg', '|') as plan, p_type || 'できる' as goals,
  '期末試験=' || p_size || '/exam|レポート=-/report' as weights, p_brand as teachers, '12-345A-1' || (p_size % 5 + 1) as numbering, p_brand || ',月,10:00,room ' || p_partkey as hours from part""")
def detail_record(spark, sf):
    """Every part of a detail page: routing, plan, goals, weights, hours, nested and mobile tables."""
    d = html_detail.extract_details(detail_pages(spark, sf))
    joined = lambda c, f: F.array_join(F.transform(c, f), "|")
    return d.select(
        "cd", "unit", "summary", "aims", F.col("delivery.mode").alias("mode"), F.col("delivery.isMedia").alias("media"), _list("keywords").alias("keywords"), _list("sdgs").alias("sdgs"),
        joined("extra", lambda x: F.concat(x["label"], F.lit("="), x["text"])).alias("extra"), "textbooks", joined("plan", lambda x: F.concat(x["n"].cast("string"), F.lit(":"), x["text"])).alias("plan"), _list("goals").alias("goals"),
        joined("eval.rows", lambda x: F.concat(x["item"], F.lit("="), F.coalesce(x["weight"].cast("string"), F.lit("-")), F.lit("/"), x["type"])).alias("weights"), _list("teachers").alias("teachers"), _list("numbering").alias("numbering"),
        joined("officeHour", lambda x: F.concat_ws(",", x["name"], x["day"], x["time"], x["place"])).alias("hours"),
    )


# --- enrichment ---


def detail_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Detail records (the wire schema) of parts, not yet enriched."""
    p = table(spark, sf, "part")
    none = F.lit(None).cast("string")
    shape = F.struct(
        e("cast(p_partkey as string)").alias("cd"), none.alias("unit"), e("named_struct('mode', 'x', 'raw', case p_partkey % 3 when 0 then '対面' when 1 then '同時双方向' else '' end, 'isMedia', false)").alias("delivery"),
        F.struct(F.array(e("named_struct('item', case p_partkey % 4 when 0 then '期末試験' when 1 then '小テスト' when 2 then '作品の提出' else '面談' end, 'weight', p_size, 'type', 'x')")).alias("rows"), none.alias("note")).alias("eval"),
        e("concat('ＡＢＣ１２（', p_name, '）')").alias("summary"), e("case when p_partkey % 2 = 0 then '特になし' else concat('教科書：', p_name, '\n', p_brand, '\n参考書 ', p_type) end").alias("textbooks"),
        e("case p_partkey % 3 when 0 then concat('予習：', p_name, '\n復習内容: ', p_brand, '\n毎回２時間半') when 1 then '1～2時間' else '読む' end").alias("prep"),
        e("array(named_struct('n', 1, 'text', 'ガイダンス', 'kind', null), named_struct('n', 2, 'text', concat('ガイダンス', p_name), 'kind', null), named_struct('n', 15, 'text', concat(p_type, ' まとめ'), 'kind', null), named_struct('n', 16, 'text', '期末試験', 'kind', null))").alias("plan"),
        e("array(concat(p_name, ' ('), concat(p_brand, ')'), p_type)").alias("keywords"), e("array(concat('ｋ＝', p_size))").alias("goals"),
        F.array(F.struct(F.lit("備考１").alias("label"), F.lit("ＸＹ").alias("text"))).alias("extra"),
    )
    return p.select(F.from_json(F.to_json(shape), ingest.DETAIL).alias("d")).select("d.*")


@query("""
select p_partkey::varchar as cd, case p_partkey % 3 when 0 then 'onsite' when 1 then 'online' else 'x' end as mode,
  case p_partkey % 4 when 0 then 'exam' when 1 then 'quiz' when 2 then 'report' else 'other' end as kind, 'ABC12（' || p_name || '）' as summary, 'k＝' || p_size as goals, '備考１:XY' as extra,
  'start|-|milestone|exam' as plan, p_name || ' ( ' || p_brand || ')|' || p_type as keywords, p_partkey % 2 = 0 as no_book,
  case when p_partkey % 2 = 0 then '-:特になし' else '教科書：' || p_name || ':' || p_brand || '|参考書 ' || p_type || ':' end as books,
  case when p_partkey % 3 = 0 then 2.5 end::double as hours, case when p_partkey % 3 = 0 then p_name end as before, case when p_partkey % 3 = 0 then p_brand end as after from part""")
def detail_enrich(spark, sf):
    """Widths, kinds, modes, sessions, textbooks, study time and keywords derived anew."""
    d = detail.enrich(detail_texts(spark, sf))
    section = lambda s: F.concat(F.coalesce(s["label"], F.lit("-")), F.lit(":"), F.array_join(s["lines"], ","))
    return d.select(
        "cd", F.col("delivery.mode").alias("mode"), F.col("eval.rows")[0]["type"].alias("kind"), "summary", _list("goals").alias("goals"), F.concat(F.col("extra")[0]["label"], F.lit(":"), F.col("extra")[0]["text"]).alias("extra"),
        F.array_join(F.transform("plan", lambda x: F.coalesce(x["kind"], F.lit("-"))), "|").alias("plan"), _list("keywords").alias("keywords"), F.col("textbookInfo.isNone").alias("no_book"),
        F.array_join(F.transform("textbookInfo.sections", section), "|").alias("books"), F.col("prepInfo.hours").alias("hours"), F.col("prepInfo.yoshu").alias("before"), F.col("prepInfo.fukushu").alias("after"),
    )


@query("""
select p_partkey::varchar as cd, case p_partkey % 3 when 0 then 'onsite' when 1 then 'online' end as dm,
  case p_partkey % 4 when 0 then 'exam' when 1 then 'quiz' when 2 then 'report' else 'other' end || ':' || p_size as ev from part where p_partkey % 3 <> 2
union all select p_partkey::varchar, 'x', case p_partkey % 4 when 0 then 'exam' when 1 then 'quiz' when 2 then 'report' else 'other' end || ':' || p_size from part where p_partkey % 3 = 2""")
def detail_cards(spark, sf):
    """Card fields joined from enriched details."""
    from facetgrid.plans.convert import with_details

    courses = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("cd"))
    return with_details(courses, detail.enrich(detail_texts(spark, sf))).select("cd", "dm", F.array_join("ev", "|").alias("ev"))


@query("""
with s as (select p_partkey::varchar as cd, unnest([['eval', '成績評価', ''], ['summary', '授業の概要', ''], ['goals', '到達目標', '授業内容'], ['plan', '授業計画', '授業内容'], ['textbooks', '教科書・参考書', '授業内容'], ['prep', '授業時間外の学習', '授業内容'],
  ['keywords', 'キーワード', 'その他'], ['extra:備考１', '備考１', 'その他'], ['__base__', '科目情報', 'その他']]) as r from part)
select cd, r[1] as key, r[2] as label, r[3] as "group" from s""")
def detail_sections(spark, sf):
    """What a page shows of each record, by the field specification."""
    return fields.sections(detail.enrich(detail_texts(spark, sf))).select("cd", "key", "label", "group")


@query("select p_partkey, p_size % 17 + 1 as first, 17 as last, 2 as n from part")
def goal_numbers(spark, sf):
    """Numbers of goals, wide digits aside (C14)."""
    found = rules.goal_numbers(e("concat(p_size % 17 + 1, ' ', p_name, '/17\nnone')"))
    return table(spark, sf, "part").select("p_partkey", found[0].cast("int").alias("first"), found[1].cast("int").alias("last"), F.size(found).alias("n"))


# --- presentation ---


@query("""
select p_partkey, case p_size % 7 when 0 then '共通教育' when 1 then '人文社会科学部' when 2 then '教育学部' when 3 then '理工学部' when 4 then '医学部' when 5 then '農林海洋科学部' else '地域協働学部' end as faculty,
  case p_size % 5 when 0 then '初年次・教養' when 1 then '基礎' when 2 then 'プラットフォーム科目' when 3 then '専門科目' else '卒業論文' end as level, '演習' as format,
  case p_size % 6 when 1 then '日本語' when 2 then '英語' when 3 then '日本語・英語' when 4 then '外国語' when 5 then 'その他' end as lang,
  case when p_size % 6 between 2 and 5 then case p_size % 6 when 2 then '英語' when 3 then '日本語・英語' when 4 then '外国語' else 'その他' end else '外国語' end as course_lang from part""")
def numbering_decode(spark, sf):
    """Parts of a numbering code, and the first language of several that is not the default."""
    code = e("concat(p_size % 7, '0-', p_size % 5, 'A1Z-2', p_size % 6)")
    shown = present.numbering(code)
    return table(spark, sf, "part").select("p_partkey", shown["faculty"].alias("faculty"), shown["level"].alias("level"), shown["format"].alias("format"), shown["lang"].alias("lang"), present.course_language(F.array(F.lit("bad"), code, F.lit("00-0000-14"))).alias("course_lang"))


@query("""select p_partkey, '知識:' || p_name || 'できる:1|-:' || p_brand || ':0|-:出来る。:1' as items from part""")
def goal_checklist(spark, sf):
    """Lines of goals with tag, text and whether they say "can" (C31)."""
    goals = F.array(F.concat(F.lit("【知識】 (1) "), "p_name", F.lit("できる\n\n2. "), "p_brand"), F.lit("・出来る。"))
    item = lambda i: F.concat_ws(":", F.coalesce(i["tag"], F.lit("-")), i["text"], i["canDo"].cast("int").cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(present.goal_items(goals), item), "|").alias("items"))


@query("select p_partkey, case when p_size % 2 = 0 then p_brand end as rep, case when p_size % 2 = 0 then p_name || '|' || p_type else p_name || '|' || p_brand || '|' || p_type end as others, p_name || ' ほか' as short from part")
def teacher_split(spark, sf):
    """The marked name leads, marks go."""
    names = F.array(F.col("p_name"), F.concat(F.when(F.col("p_size") % 2 == 0, "◎").otherwise("○"), F.lit("　"), "p_brand"), F.lit(" "), F.col("p_type"))
    found = present.teachers(names)
    return table(spark, sf, "part").select("p_partkey", found["rep"].alias("rep"), _list(found["others"]).alias("others"), present.instructor_short(F.concat_ws(",", "p_name", F.lit(" "), "p_type")).alias("short"))


@query("select p_partkey, case when p_size % 2 = 0 then 'see |<12345>| and 5432100 or ' else 'see 12345 and 5432100 or ' end || p_brand as parts, p_size % 3 = 0 as related from part")
def related_parts(spark, sf):
    """Known codes within a text that it tiles."""
    known = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("12345"))).otherwise(F.array().cast("array<string>"))
    parts = present.related_parts(F.concat(F.lit("see 12345 and 5432100 or "), "p_brand"), known)
    shown = F.array_join(F.transform(parts, lambda p: F.when(p["code"].isNotNull(), F.concat(F.lit("<"), p["text"], F.lit(">"))).otherwise(p["text"])), "|")
    return table(spark, sf, "part").select("p_partkey", shown.alias("parts"), present.is_related_label(F.when(F.col("p_size") % 3 == 0, "関連科目（1）").otherwise("備考")).alias("related"))


@query("select p_partkey, case when p_size % 2 = 0 then '[paragraph]' || p_name || chr(10) || p_brand || ';[list]' || p_type || '/x;[paragraph]end' else '[list]a' end as blocks from part")
def prose_items(spark, sf):
    """Blocks of one text with their items."""
    said = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("\n "), "p_brand", F.lit("\n・"), "p_type", F.lit("\n(2) x\n\nend"))).otherwise(F.lit("\n① a\n"))
    block = lambda b: F.concat(F.lit("["), b["kind"], F.lit("]"), F.array_join(b["items"], "/"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(present.prose_blocks(said), block), ";").alias("blocks"))


@query("""
select p_partkey, p_size::bigint as session, p_brand || 'Ａ'[1:0] || 'A1（' as width, case when p_size % 7 = 0 then null else p_size % 7 - 1 end as day, greatest(10, least(p_size, 40)) as clamped,
  '[TOKEN] ' || p_name as redacted, p_size % 2 = 0 as present, 5 + (p_size % 2) as days, coalesce(nullif(p_brand, 'Brand#1'), 'その他') as bucket, 2 * length(p_name) + 2 as units from part""")
def text_bits(spark, sf):
    """Small text functions: session number, widths, weekdays, clamping, secrets, presence, defaults, units."""
    p = table(spark, sf, "part")
    wide = F.translate(F.col("p_size").cast("string"), text.DIGITS, text.FULL_DIGITS)
    day = F.when(F.col("p_size") % 7 == 0, "x").otherwise(F.substring(F.lit(text.WEEKDAYS), F.col("p_size") % 7, F.lit(1)))
    return p.select(
        "p_partkey", text.session_number(F.concat(F.lit("第"), wide, F.lit("回"))).alias("session"), text.fold_alnum(F.concat("p_brand", F.lit("Ａ１（"))).alias("width"), text.weekday_index(day).alias("day"),
        present.clamp(F.col("p_size"), F.lit(10), F.lit(40)).alias("clamped"), text.redact(F.concat(F.lit("s3cret "), "p_name"), "s3cret").alias("redacted"),
        text.has_value(F.when(F.col("p_size") % 2 == 0, "p_name").otherwise("　 "), "string").alias("present"), F.size(present.weekday_labels(F.col("p_size") % 2 == 1)).alias("days"),
        text.or_other(F.when(F.col("p_brand") == "Brand#1", "　").otherwise(F.col("p_brand"))).alias("bucket"), (2 * text.utf16_length(F.concat("p_name", F.lit("𝄞"))) - 2).alias("units"),
    )


@query("select doc_id, case when strlen(text) <= 1200 then text else '… (' || strlen(text) || ' bytes)' end as tail, strlen(text) > 1200 as cut from (select doc_id, coalesce(text, '') as text from documents)")
def body_snippet(spark, sf):
    """The head of each text by bytes, with the total where it is cut."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    head = docs.select("doc_id", text.head_bytes("text").alias("h"), (F.octet_length("text") > 1200).alias("cut"))
    return head.select("doc_id", F.when(F.col("cut"), F.regexp_extract("h", r"(?s)(… \([0-9]+ bytes\))$", 1)).otherwise(F.col("h")).alias("tail"), "cut")


@query("select p_partkey, case when p_size % 2 = 0 then p_name else 'T' end || ' · ' || p_brand as line from part")
def facet_line(spark, sf):
    """Slot text or term, and labels."""
    line = present.facet_line(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(""), F.lit("T"), F.lit(""), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", line.alias("line"))


@query("select c_custkey, c_name || '|x' as added, case when c_custkey % 2 = 0 then 'x' else c_name || '|x|y' end as toggled, c_name as kept from customer")
def plan_store(spark, sf):
    """A plan's codes: added once, toggled."""
    one, x = F.array("c_name"), F.lit("x")
    toggled = present.plan_toggle(F.array("c_name", x), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("y"))
    return table(spark, sf, "customer").select("c_custkey", _list(present.plan_add(one, x)).alias("added"), _list(toggled).alias("toggled"), _list(present.plan_add(one, F.col("c_name"))).alias("kept"))


# --- grids and tallies ---


@query(f"select 6 * 6 as cells, (select count(*) from (select distinct day, period from {EVENTS} where {ON_GRID}))::int as filled, case when (select bool_or(day = 5 and {ON_GRID}) from {EVENTS}) then 6 else 5 end as days")
def grid_shape(spark, sf):
    """Ordered cells and the number of days."""
    rows = grid.placed(event_slots(spark, sf))
    counts = grid.ordered_cells(grid.cell_counts(rows)).agg(F.count("*").cast("int").alias("filled"))
    saturday = grid.has_saturday(event_slots(spark, sf)).first()["has_saturday"]
    return counts.select(F.lit(36).alias("cells"), "filled", F.lit(grid.day_count(saturday)).alias("days"))


@query(f"select idx from (select distinct day, period, idx from {EVENTS} where {ON_GRID} and term = 'click') c join (select distinct day, period from {EVENTS} where {ON_GRID} and idx = 7) using (day, period) where idx <> 7 group by idx")
def clash_set(spark, sf):
    """Who meets the plan in a cell."""
    rows = event_slots(spark, sf)
    return grid.clash_set(grid.placed(rows.where("term = 'click'")), grid.placed(rows.where("idx = 7")))


@query(f"select day, period, count(*)::bigint as n from (select distinct day, period, idx from {EVENTS} where {ON_GRID} and day = 2 and period = 3) group by all")
def grid_cell(spark, sf):
    """One cell (F4)."""
    return grid.cell(grid.cell_counts(grid.placed(event_slots(spark, sf))), 2, 3)


@query("""
select l_orderkey, l_linenumber, l_returnflag, l_quantity, round(l_quantity / 100 * 2 * pi() * 10, 6) as length,
  round(-coalesce(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and 1 preceding), 0) / 100 * 2 * pi() * 10, 6) + 0 as "offset" from lineitem""")
def arcs(spark, sf):
    """Arcs of shares on a circle, one after another."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", F.col("l_quantity").alias("pct"))
    laid = tallies.arcs(rows, "l_orderkey", 10.0, "l_linenumber", "l_partkey", "l_suppkey")
    return laid.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", F.round("length", 6).alias("length"), (F.round("offset", 6) + 0).alias("offset"))


# --- bookkeeping ---


@query("""
with r as (select trim((event_id // 3)::varchar) as cd, case when event_id % 4 = 0 then '' else '7' end as pattern, event_type as u, event_id as ord from events where event_id % 11 <> 0)
select cd, arg_min(case when pattern = '' then '4' else pattern end, ord) as pattern, arg_min(u, ord) as last_update, min(ord) as ord from r group by cd""")
def detail_targets(spark, sf):
    """First row of each code, pattern 4 by default."""
    raw = table(spark, sf, "events").select(F.when(F.col("event_id") % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), e("cast(event_id div 3 as string)"))).alias("code"), F.when(F.col("event_id") % 4 == 0, "").otherwise("7").alias("p"), F.col("event_type").alias("u"), "event_id")
    return incremental.targets(raw, "code", "event_id", "p", "u")


@query("select event_id, case event_id % 5 when 0 then 'http' when 1 then 'fatal' when 2 then 'fatal' when 3 then 'fatal' else 'ok' end as outcome, case event_id % 5 when 0 then 'HTTP 429 30' when 1 then 'not JSON' when 2 then 'gone ' || event_type when 3 then 'no guid' else event_type end as detail from events")
def response_kinds(spark, sf):
    """Answers with a token, an error or none (H6, H7)."""
    body = e("case event_id % 5 when 0 then 'x' when 1 then '<html>' when 2 then concat('{\"errorMsg\":\"gone ', event_type, '\"}') when 3 then '{}' else concat('{\"guid\":\"', event_type, '\"}') end")
    out = incremental.classify_response(F.when(F.col("event_id") % 5 == 0, 429).otherwise(200), body, F.lit("30"))
    return table(spark, sf, "events").select("event_id", out["outcome"].alias("outcome"), out["detail"].alias("detail"))


@query("select page_id, case when page_id % 7 = 0 then 'http' when page_id % 7 = 1 then 'fatal' else 'ok' end as outcome, case when page_id % 7 = 0 then 'HTTP 503' when page_id % 7 = 1 then 'empty html' else sha256(html) end as detail, page_id % 7 = 0 as retriable, page_id % 7 = 0 as blocking from pages")
def html_kinds(spark, sf):
    """Pages by status and body, and what to try again."""
    status = F.when(F.col("page_id") % 7 == 0, 503).otherwise(200)
    out = incremental.classify_html(status, F.when(F.col("page_id") % 7 == 1, "  ").otherwise(F.col("html")))
    return table(spark, sf, "pages").select("page_id", out["outcome"].alias("outcome"), F.when(out["outcome"] == "ok", F.sha2(out["detail"], 256)).otherwise(out["detail"]).alias("detail"), incremental.is_retriable(status, F.lit(False)).alias("retriable"), incremental.is_blocking(status).alias("blocking"))


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    kinds = "case event_type when 'error' then 403 when 'click' then 404 end"
    return table(spark, sf, "events").select("user_id", "event_id", e(kinds).alias("status"), F.concat(F.lit("HTTP "), e(kinds).cast("string")).alias("reason"), (F.col("event_id") % 13 == 0).alias("fatal"))


@query("""
with o as (select user_id, event_id, case event_type when 'error' then 403 when 'click' then 404 end as status, event_id % 13 = 0 as fatal from events),
r as (select *, sum(coalesce(status = 403, false)::int) over (partition by user_id order by event_id rows between 1 preceding and current row) as run from o),
t as (select *, coalesce(max((run = 2)::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as over from r)
select user_id, count(*) filter (where status is null and not fatal) as fetched, count(*) filter (where status is not null or fatal) as skipped, count(*) filter (where fatal) as no_detail, bool_or(run = 2) as aborted
from t where over = 0 group by user_id""")
def crawl_report(spark, sf):
    """What each run fetched, skipped and gave up on, until its breaker trips."""
    report = incremental.crawl_report(_outcomes(spark, sf), "user_id", "event_id", 2)
    return report.select("user_id", "fetched", "skipped", "no_detail", "aborted")


@query("""
with t as (select case event_type when 'error' then 'HTTP 403' else 'fatal' end as reason, count(*) as n from events group by 1)
select (select string_agg(n || '× ' || reason, ', ' order by n desc, reason) from (select * from t order by n desc, reason limit 3)) || case when count(*) > 3 then ', +' || (count(*) - 3) || ' more' else '' end as summary from t""")
def reason_summary(spark, sf):
    """The commonest reasons in one line."""
    said = table(spark, sf, "events").select(F.when(F.col("event_type") == "error", "HTTP 403").otherwise(F.concat(F.lit("fatal: fatal: "), "event_type")).alias("reason"))
    return incremental.top_reasons(incremental.failure_tally(said))


@query("select count(*)::bigint as skipped, 'blocked or limited: wait longer' as hint from events where event_type = 'error'")
def skip_verdict(spark, sf):
    """What the reasons hint at."""
    rows = table(spark, sf, "events").where("event_type = 'error'").select(F.lit("HTTP 403").alias("reason"), F.lit("Empty HTML").alias("diagnostics"))
    return incremental.verdict(rows)


@query("select page_id::varchar as name, page_id % 3 = 0 or page_id % 5 = 0 as changed, page_id % 7 = 0 as stale from pages where not (page_id % 7 = 0 and page_id % 5 = 0) and page_id % 7 <> 0 union all select page_id::varchar, false, true from pages where page_id % 7 = 0 and page_id % 5 <> 0")
def page_changes(spark, sf):
    """Changed, new and stale pages by digest."""
    p = table(spark, sf, "pages").select(F.col("page_id"), F.col("page_id").cast("string").alias("name"), F.col("html").alias("content"))
    now = p.where("page_id % 7 <> 0").drop("page_id")
    before = p.where("page_id % 5 <> 0").select("name", F.when(F.col("page_id") % 3 == 0, F.concat("content", F.lit("."))).otherwise(F.col("content")).alias("content"))
    return incremental.page_changes(now, before)


@query("select k as page, case when k % 50 = 0 then 'page number' when k % 77 = 0 then 'page count' when k % 91 = 0 then 'page not full' end as problem from (select page_id + 1 as k from pages) where k % 50 = 0 or k % 77 = 0 or k % 91 = 0")
def page_violations(spark, sf):
    """Pages that contradict the first."""
    k = (F.col("page_id") + 1).alias("page")
    rows = table(spark, sf, "pages").select(k, F.when(k % 50 == 0, 0).otherwise(k).alias("echoed"), F.when(k % 77 == 0, -1).otherwise(1 << 30).alias("max_page"), F.when(k % 91 == 0, 3).otherwise(500).alias("rows"))
    return incremental.page_violations(rows, 500)


@query("select page_id + 1 as page, case when page_id = 0 then 'page.json' else 'page-' || lpad((page_id + 1)::varchar, greatest(2, length((page_id + 1)::varchar))::int, '0') || '.json' end as name from pages")
def page_names(spark, sf):
    """Names of page files."""
    k = F.col("page_id") + 1
    return table(spark, sf, "pages").select(k.alias("page"), incremental.page_name(k, "page").alias("name"))


@query("""
select 'd/' || p_partkey as path, 'delete' as action from part where p_size % 3 = 0 union all select 'm/' || p_partkey, 'add' from part where p_size % 3 = 1
union all select 'r/' || p_partkey, 'delete' from part where p_size % 3 = 2 union all select 'n/' || p_partkey, 'add' from part where p_size % 3 = 2""")
def change_set(spark, sf):
    """Name-status lines to additions and deletions."""
    line = e("case p_size % 3 when 0 then concat('D\td/', p_partkey) when 1 then concat('M\tm/', p_partkey) else concat('R090\tr/', p_partkey, '\tn/', p_partkey) end")
    return incremental.change_set(table(spark, sf, "part").select(line.alias("line")).unionByName(spark.createDataFrame([("",), ("X",)], "line string")))


@query("select 'a/' || p_partkey as path, case when p_size % 2 = 0 then 'add' else 'delete' end as action, case when p_size % 2 = 0 then base64(encode(p_name)) end as contents from part")
def commit_payload(spark, sf):
    """Contents of additions in base64."""
    p = table(spark, sf, "part")
    path = F.concat(F.lit("a/"), F.col("p_partkey").cast("string")).alias("path")
    changes = p.select(path, F.when(F.col("p_size") % 2 == 0, "add").otherwise("delete").alias("action"))
    return sinks.commit_payload(changes, p.select(path, F.encode("p_name", "UTF-8").alias("content")))
