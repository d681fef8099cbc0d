"""Queries of the conversion and the façade: ``part`` as files of raw course records.

Codes repeat across files, some records are no objects, some codes are blank,
timetables of five shapes give slots, year-long slots and warnings.  The SQL
writes down what the conversion should give from the part rows themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgrid.operators import search
from facetgrid.operators.bitmaps import from_base64, positions
from facetgrid.plans import convert as c
from facetgrid.plans.engine import Engine, Filters
from facetgrid.queries import query, table
from facetgrid.queries import _fold as fold_sql
from facetgrid.sources import ingest, sample

#: Timetables by kind.
TIMETABLES = ("", "1学期: 月曜日１時限", "2学期: 火曜日２時限,2学期: 水曜日３時限", "通年: 木曜日４時限", "1学期: 集中講義", "1学期: 金曜日５時限, 集中, 2学期: 日曜日１時限")
RECORDS_PER_FILE = 500
#: Courses of a cell that a grid shows at once, the best ones.
PAGE = 50


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """(file_ord, text): four files for each 2,000 parts, so a file is a page of a bounded size."""
    kind = F.element_at(F.array(*[F.lit(t) for t in TIMETABLES]), F.col("p_size") % 6 + 1)
    campus = F.element_at(F.array(*[F.lit(t) for t in ("朝倉キャンパス", "物部キャンパス", "岡豊キャンパス", "")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    e = F.expr
    record = F.struct(
        F.when(F.col("p_partkey") % 97 == 0, "　").otherwise(e("cast(p_partkey div 2 as string)")).alias("kogiCd"), e("concat('  ', p_name, '　')").alias("kogiNm"),
        F.col("p_brand").alias("tantoKyoin"), kind.alias("jikanwari"), e("case p_partkey % 3 when 0 then '1学期' when 1 then ' 2学期 ' end").alias("kogiKaikojikiNm"),
        e("case when p_size = 1 then '' else p_type end").alias("kogiKubunNm"), e("case when p_partkey % 5 = 0 then null else p_brand end").alias("sekininBushoNm"), campus.alias("kochiNm"),
        e("case when p_size % 2 = 0 then p_name else concat(p_name, '学') end").alias("gakusokuKamokuNm"), e("case when p_size > 25 then ' ' else p_type end").alias("fukudai"),
        e("case when p_partkey % 2 = 0 then p_type end").alias("kamokuBunrui"), F.col("p_size").alias("taishoNenji"), F.lit("2026").alias("kaikoNendo"),
        F.col("p_partkey").alias("lastUpdate"), F.struct(F.col("p_size").alias("x")).alias("unknown"),
    )
    row = F.struct("p_partkey", F.when(F.col("p_partkey") % 89 == 0, "17").otherwise(F.to_json(record)).alias("j"))
    parts = table(spark, sf, "part").select(e("cast(4 * (p_partkey div 2000) + (p_partkey * 3) % 4 as int)").alias("file_ord"), row.alias("r"))
    files = parts.groupBy("file_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["j"]), ",").alias("list"))
    body = F.when(F.col("file_ord") % 2 == 0, F.concat(F.lit('{"selectKogiDtoList":['), "list", F.lit("]}"))).otherwise(F.concat(F.lit("["), "list", F.lit("]")))
    return files.select("file_ord", body.alias("text"))


def dataset(spark: SparkSession, sf: str) -> c.Dataset:
    return c.convert(ingest.raw_courses(ingest.parse_documents(texts(spark, sf))))


_ITEMS = """
raw as (select *, p_partkey as p, 4 * (p_partkey // 2000) + (p_partkey * 3) % 4 as f, p_partkey % 89 = 0 as bad, p_partkey % 97 = 0 as blank, (p_partkey // 2)::varchar as cd, p_size % 6 as k from part),
items as (select *, (row_number() over (partition by f order by p) - 1)::int as item from raw)"""
_KIND = "case k when 0 then '' " + " ".join(f"when {k} then '{t}'" for k, t in enumerate(TIMETABLES) if k) + " end"
_BASE = f"""
with {_ITEMS},
good as (select * from items where not bad and not blank),
firsts as (select *, (row_number() over (order by f, p) - 1)::int as idx from (select *, row_number() over (partition by cd order by f, p) as n from good) where n = 1),
labelled as (select *, case p % 3 when 0 then '1学期' when 1 then '2学期' else 'その他' end as term_label, case when p_size = 1 or p_type = '' then 'その他' else p_type end as kubun,
  case when p % 5 = 0 then 'その他' else p_brand end as department, case p % 4 when 0 then '朝倉キャンパス' when 1 then '物部キャンパス' when 2 then '岡豊キャンパス' else 'その他' end as campus_label,
  case when p_size <= 25 then p_type end as sub, case when p % 2 = 0 then p_type end as bunrui from firsts),
form as (select * from (values (1, 0, '1学期', 0, 1), (2, 0, '2学期', 1, 2), (2, 1, '2学期', 2, 3), (3, 0, '通年', 3, 4), (5, 0, '1学期', 4, 5), (5, 1, '2学期', 6, 1)) t(k, pos, term, day, period)),
semesters as (select (row_number() over (order by case term when '1学期' then 0 when '2学期' then 3 else 6 end) - 1)::int as s, term from (select distinct term from good join form using (k))),
owned as (select i.idx, g.f, g.p, pos, term, day, period, i.p = g.p as own from good g join form using (k) join firsts i using (cd)),
judged as (select *, bool_or(own) over (partition by idx, term, day, period) as has_own, row_number() over (partition by idx, term, day, period order by f, p, pos) as nth from owned),
slots as (select idx, f, p, pos, term, day, period, s from judged join semesters using (term) where own or (not has_own and nth = 1)),
dict as (
  select 'departments' as name, (row_number() over (order by label = 'その他', label) - 1)::int as idx, label from (select distinct department as label from labelled)
  union all select 'kubun', (row_number() over (order by label = 'その他', label) - 1)::int, label from (select distinct kubun as label from labelled)
  union all select 'campuses', (row_number() over (order by case label when '朝倉キャンパス' then 0 when '物部キャンパス' then 1 when '岡豊キャンパス' then 2 else 3 end) - 1)::int, label from (select distinct campus_label as label from labelled)
  union all select 'kaikojiki', (row_number() over (order by case label when '1学期' then 0 when '2学期' then 3 else 99 end) - 1)::int, label from (select distinct term_label as label from labelled)
  union all select 'semesters', s, term from semesters),
courses as (select l.*, ki.idx as ki, kb.idx as kbn, de.idx as dept, ca.idx as campus from labelled l
  join dict ki on ki.name = 'kaikojiki' and ki.label = term_label join dict kb on kb.name = 'kubun' and kb.label = kubun
  join dict de on de.name = 'departments' and de.label = department join dict ca on ca.name = 'campuses' and ca.label = campus_label)
"""


# --- sources ---


@query(f"with {_ITEMS} select f::int as file_ord, item, not bad as valid from items")
def record_scan(spark, sf):
    """Files in order, envelope or bare array, each record by itself (A1-A3)."""
    return ingest.parse_documents(texts(spark, sf)).select("file_ord", "item", "valid")


@query(f"""with {_ITEMS} select f::int as file_ord, item, case when blank then '　' else cd end as code, p::varchar as update_mark, p_size::varchar as year, case p % 3 when 0 then '1学期' when 1 then ' 2学期 ' else '' end as term,
  case when p % 2 = 0 then p_type end as bunrui, case when p % 5 = 0 then '' else p_brand end as department from items where not bad""")
def scalar_coercion(spark, sf):
    """Numbers as text, absent required fields empty, absent optional ones null (A4, A5)."""
    r = ingest.raw_courses(ingest.parse_documents(texts(spark, sf)))
    return r.select("file_ord", "item", F.col("kogiCd").alias("code"), F.col("lastUpdate").alias("update_mark"), F.col("taishoNenji").alias("year"), F.col("kogiKaikojikiNm").alias("term"), F.col("kamokuBunrui").alias("bunrui"), F.col("sekininBushoNm").alias("department"))


@query(f"with {_ITEMS} select '[item ' || (item + 1) || '] skipped' as warning, count(*)::bigint as n from items where bad group by all")
def record_warnings(spark, sf):
    return ingest.load_warnings(ingest.parse_documents(texts(spark, sf))).groupBy("warning").agg(F.count("*").alias("n"))


# --- conversion ---


@query(f"""{_BASE} select idx, cd, p_name as nm, sub, p_brand as prof, {_KIND} as raw, ki, kbn, dept, campus, case when p_size % 2 = 1 then p_name || '学' end as gaku, p_size::varchar as nen, bunrui,
  coalesce((select string_agg(s || '-' || day || '-' || period, '|' order by s.f, s.p, pos) from slots s where s.idx = c.idx), '') as slots from courses c""")
def convert_courses(spark, sf):
    """First rows with merged slots, trimmed, coded by dictionaries."""
    listed = F.array_join(F.transform("slots", lambda x: F.concat_ws("-", x["s"].cast("string"), x["d"].cast("string"), x["p"].cast("string"))), "|")
    return dataset(spark, sf).courses.select("idx", "cd", "nm", "sub", "prof", "raw", "ki", "kbn", "dept", "campus", "gaku", "nen", "bunrui", listed.alias("slots"))


@query(f"{_BASE} select idx, term, day, period, s from slots")
def convert_slots(spark, sf):
    """Slots of the first row, and new ones of later rows."""
    return dataset(spark, sf).slots.select("idx", "term", "day", "period", "s")


@query(f"""{_BASE}, members as (select 'semester' as facet, s as value, idx from slots
  union select 'semester', t.s, x.idx from slots x cross join semesters t where x.term = '通年'
  union all select 'department', dept, idx from courses union all select 'campus', campus, idx from courses)
select facet, value, idx from members""")
def convert_members(spark, sf):
    """The filter index with year-long slots in every term."""
    return dataset(spark, sf).members


@query(f"{_BASE} select name, idx, label from dict")
def convert_dictionaries(spark, sf):
    """Labels in each dimension's own order."""
    out = None
    for name, entries in dataset(spark, sf).dictionaries.items():
        rows = entries.select(F.lit(name).alias("name"), "idx", "label")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""with {_ITEMS}, said as (
  select unnest(case when k = 4 then ['[' || cd || ']   ' || p_name || '　: no weekday or period: 1学期: 集中講義', '[' || cd || ']   ' || p_name || '　: no slot could be read from 1学期: 集中講義']
    else ['[' || cd || ']   ' || p_name || '　: no weekday or period: 集中'] end) as warning from items where not bad and not blank and k in (4, 5)
  union all select '[item ' || (item + 1) || '] course code is empty; skipped' from items where blank and not bad)
select warning, count(*)::bigint as n from said group by all""")
def convert_warnings(spark, sf):
    return dataset(spark, sf).warnings.groupBy("warning").agg(F.count("*").alias("n"))


@query(f"with {_ITEMS} select count(*)::int as \"totalRaw\", '2026' as year from items where not bad")
def convert_facts(spark, sf):
    return dataset(spark, sf).facts.select("totalRaw", "year")


_DOCUMENT_LIMIT = 32_768


@query(f"""{_BASE} select cd, p_name as nm, ki, (select count(*) from slots s where s.idx = c.idx)::int as slots from courses c""")
def dataset_document(spark, sf):
    """The whole document as JSON and read back by its schema."""
    json = c.document(dataset(spark, sf), "2026-01-01T00:00:00Z")
    read = json.select(F.from_json("json", ingest.DATASET).alias("d")).where("d.version = 3")
    return read.select(F.explode("d.courses").alias("c")).select("c.cd", "c.nm", "c.ki", F.size("c.slots").alias("slots"))


@query(f"{_BASE} select dept as value, idx as position from courses")
def document_bitmaps(spark, sf):
    """The department bitmaps of the document, read back to positions."""
    json = c.document(dataset(spark, sf), "2026-01-01T00:00:00Z")
    read = json.select(F.from_json("json", ingest.DATASET).alias("d")).select(F.posexplode("d.indices.department").alias("value", "wire"))
    return read.select("value", F.explode(positions(from_base64(F.col("wire")))).alias("position"))


@query(f"""{_BASE} select idx, p_name as name, coalesce(sub, '') as subtitle, p_brand as instructor, cd as code, department || case when bunrui is null then '' else ' ' || bunrui end as keywords from courses""")
def search_inputs(spark, sf):
    """Fields of the search index."""
    return c.search_fields(dataset(spark, sf).courses)


# --- the façade ---


def engine(spark: SparkSession, sf: str, indexed: bool = False) -> Engine:
    data = dataset(spark, sf)
    made = Engine(data)
    if indexed:
        made.load_index(search.build_index(c.search_fields(data.courses), "idx", {f: F.col(f) for f in search.FIELDS}))
    return made


_HAY = fold_sql("concat_ws(' ', p_name, sub, p_brand, cd, department, bunrui)")
_TERM = "idx in (select idx from slots where term in ('1学期', '通年'))"
_CELL = "day between 0 and 5 and period between 1 and 6"


@query(f"{_BASE} select idx from courses where {_TERM} and campus_label = '朝倉キャンパス' and contains({_HAY}, 'ring')")
def engine_filter(spark, sf):
    """Facets and a literal, unranked."""
    return engine(spark, sf).filter(Filters(term="1学期", campus="朝倉キャンパス", query="ＲＩＮＧ"))


@query(f"""{_BASE}, hits as (select idx from courses where {_TERM} and contains({_HAY}, 'ring')),
placed as (select distinct day, period, idx from slots join hits using (idx) where term in ('1学期', '通年') and {_CELL})
select day, period, string_agg(idx::varchar, ',' order by idx) as ids from (select *, row_number() over (partition by day, period order by idx) as nth from placed) where nth <= {PAGE} group by all""")
def engine_query(spark, sf):
    """Cells of a query without an index, a page of each."""
    found = engine(spark, sf).query(term="1学期", query="ring", page=PAGE)
    return found.cells.select("day", "period", _ids())


@query(f"""{_BASE}, hits as (select idx from courses where {_TERM} and contains({_HAY}, 'ring'))
select count(distinct idx)::bigint as n from slots join hits using (idx) where term in ('1学期', '通年') and {_CELL}""")
def engine_count(spark, sf):
    return engine(spark, sf).query(term="1学期", query="ring").count


def _score(q: str) -> str:
    count = lambda e: f"((length({e}) - length(replace({e}, '{q}', ''))) // {len(q)})"
    words = fold_sql("department || case when bunrui is null then '' else ' ' || bunrui end")
    return f"(3 * {count(fold_sql('p_name'))} + 1.5 * {count(fold_sql('coalesce(sub, chr(32))'))} + 2 * {count(fold_sql('p_brand'))} + {count(words)})"


@query(f"""{_BASE}, scored as (select idx, {_score('r')} as score from courses), hits as (select * from scored where score > 0),
placed as (select distinct day, period, idx, score from slots join hits using (idx) where {_CELL})
select day, period, string_agg(idx::varchar, ',' order by score desc, idx) as ids from placed group by all""")
def engine_ranked(spark, sf):
    """Whole cells best first once an index is loaded."""
    return engine(spark, sf, indexed=True).query(query="R").cells.select("day", "period", _ids())


@query(f"{_BASE} select cd, (length({fold_sql('p_name')}) - length(replace({fold_sql('p_name')}, 'ring', ''))) // 4 as spans from courses where contains({fold_sql('p_name')}, 'ring')")
def engine_names(spark, sf):
    """Spans in names only."""
    return engine(spark, sf, indexed=True).query(query="ring").highlights.select("cd", F.size("name_spans").cast("bigint").alias("spans"))


_PLAN = "('3', '11', '400', '77', '3', 'x')"


@query(f"{_BASE} select idx from courses where cd in {_PLAN}")
def engine_resolve(spark, sf):
    """Codes to positions; unknown and repeated ones do nothing."""
    return engine(spark, sf).resolve(_codes(spark))


@query(f"""{_BASE}, placed as (select distinct day, period, idx from slots join courses using (idx) where cd in {_PLAN} and {_CELL})
select d::int as day, p::int as period, coalesce(string_agg(idx::varchar, ',' order by idx), '') as ids
from (select unnest(range(0, 6)) as d) a cross join (select unnest(range(1, 7)) as p) b left join placed on day = d and period = p group by all""")
def engine_plan_grid(spark, sf):
    """A plan on a full grid."""
    return engine(spark, sf).plan_grid(_codes(spark)).select("day", "period", _ids())


@query(f"""{_BASE}, placed as (select distinct day, period, idx from slots join courses using (idx) where dept = 0 and term in ('1学期', '通年') and {_CELL})
select d::int as day, p::int as period, coalesce(string_agg(idx::varchar, ',' order by idx), '') as ids
from (select unnest(range(0, 5)) as d) a cross join (select unnest(range(1, 7)) as p) b
left join (select * from (select *, row_number() over (partition by day, period order by idx) as nth from placed) where nth <= {PAGE}) on day = d and period = p group by all""")
def engine_client_grid(spark, sf):
    """Filter and full grid in one, a page of each cell."""
    made = engine(spark, sf)
    label = made.dicts["departments"].where("idx = 0").first()["label"]
    return made.filter_and_grid(days=5, term="1学期", department=label, page=PAGE).cells.select("day", "period", _ids())


@query(f"""{_BASE}, own as (select idx, term, day, period from slots join courses using (idx) where courses.p < 60 and {_CELL}), t as (select distinct term from own where term <> '通年'),
dealt as (select distinct t.term, day, period, idx from own join t on own.term = t.term or own.term = '通年'),
g as (select term, day, period, string_agg(idx::varchar, ',' order by idx) as ids from dealt group by all having count(*) >= 2)
select day, period, ids, min(term) as term from g group by all""")
def engine_plan_summary(spark, sf):
    """Clashes of a plan by term."""
    made = engine(spark, sf)
    plan = _first_codes(spark, sf, made)
    return made.plan_summary(plan)[0].select("day", "period", _ids(), "term")


@query(f"""{_BASE}, own as (select * from courses where p < 60)
select 'kubun' as axis, kubun as key, 0::float as credits, count(*)::bigint as count, count(*)::bigint as uncredited from own group by kubun
union all select 'bunrui', bunrui, 0, count(*), count(*) from own where bunrui is not null group by bunrui
union all select 'nen', p_size::varchar, 0, count(*), count(*) from own group by p_size
union all select 'total', '', 0, count(*), count(*) from own""")
def engine_plan_credits(spark, sf):
    """Credit tallies of a plan on three axes; no course of this catalogue has credits."""
    made = engine(spark, sf)
    return made.plan_summary(_first_codes(spark, sf, made))[1]


@query(f"{_BASE} select idx, cd, department, campus_label from courses")
def engine_views(spark, sf):
    return engine(spark, sf).views().select("idx", "cd", "department", "campus_label")


@query(f"{_BASE} select count(*)::bigint as n, bool_or(day = 5 and {_CELL}) as saturday from slots")
def engine_facts(spark, sf):
    """Saturday flag and the number of slots."""
    made = engine(spark, sf)
    return made.data.slots.agg(F.count("*").alias("n")).join(made.has_saturday().select(F.col("has_saturday").alias("saturday")), how="cross")


def _ids(column: str = "courses"):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias("ids")


def _codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ("3", "11", "400", "77", "3", "x")], "cd string")


def _first_codes(spark: SparkSession, sf: str, made: Engine) -> DataFrame:
    """The plan of the courses whose first row is one of the first sixty parts."""
    return made.data.courses.where(F.col("cd").cast("int") < 30).select("idx")


# --- the synthetic catalogue ---


@query("""
select lpad((i + 1)::varchar, 5, '0') as cd, case i % 5 when 0 then '1学期' when 1 then '2学期' when 2 then '通年' when 3 then '1学期前半' else '2学期後半' end as term,
  case when i = 7 then '' else ['人文社会科学部', '教育学部', '理工学部', '医学部', '農林海洋科学部', '共通教育'][(i % 6 + 1)::int] end as department,
  case when i % 9 = 8 then 0 when i % 7 = 3 then 2 else 1 end as slots
from (select unnest(range(0, 3000)) as i)""")
def sample_catalogue(spark, sf):
    """Synthetic courses and timetables."""
    from facetgrid.operators.slots import good_slots, parse_slots

    rows = sample.courses(spark)
    return rows.select(F.col("kogiCd").alias("cd"), F.col("kogiKaikojikiNm").alias("term"), F.col("sekininBushoNm").alias("department"), F.size(good_slots(parse_slots(F.col("jikanwari")))).alias("slots"))


@query("""
select lpad((i + 1)::varchar, 5, '0') as cd, ((i % 4) + 1)::double::varchar as unit, ['onsite', 'online', 'ondemand', 'hybrid', 'unknown'][(i % 5 + 1)::int] as mode,
  (case when i % 10 < 5 then 15 else i % 6 + 3 end)::int as sessions, (i % 3 + 3)::int as goals, case when i % 6 = 5 then 0 else 100 end::bigint as weight
from (select unnest(range(0, 3000)) as i) where i % 10 < 7""")
def sample_details(spark, sf):
    """Synthetic details of seven in ten courses."""
    d = sample.details(spark)
    weight = F.aggregate("eval.rows", F.lit(0).cast("bigint"), lambda s, r: s + F.coalesce(r["weight"], F.lit(0)))
    return d.select("cd", "unit", F.col("delivery.mode").alias("mode"), F.size("plan").alias("sessions"), F.size("goals").alias("goals"), weight.alias("weight"))
