"""Queries of the catalogue operators over the driver's tables, with their SQL.

Roles: ``part`` is a course with facets, ``documents`` the searchable corpus,
``events`` a user's slots (term: event type, signup being year-long; day: weekday;
period: three hours), ``labels`` details that some documents lack, ``lineitem``
an order's weighted rows, ``conversations`` ordered lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgrid.functions import present, rules, text
from facetgrid.operators import bitmaps, dictionaries, grid, html_detail, incremental, search, slots, tallies
from facetgrid.plans import convert, engine
from facetgrid.sources import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
YEAR_LONG = "signup"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all tasks by ``key``, for work on a row that takes far longer than reading it; a number that is given is not coalesced."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fold(c: str) -> str:
    return f"translate({c}, {_sql(text.FOLD_FROM)}, {_sql(text.FOLD_TO)})"


def _count(c: str, q: str) -> str:
    return f"((length({c}) - length(replace({c}, {_sql(q)}, ''))) // {len(q)})"


def event_slots(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("idx"), F.col("event_type").alias("term"), F.weekday("ts").alias("day"), (F.floor(F.hour("ts") / 3) + 1).cast("int").alias("period"), "value")


_EVENTS = "(select user_id as idx, event_type as term, (isodow(ts) - 1)::int as day, (hour(ts) // 3 + 1)::int as period, value from events)"
_ON_GRID = "day between 0 and 5 and period between 1 and 6"


def _joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# --- facets and search ---


@query("select doc_id, n_chars from documents where lang = 'en' and source = 'src7'")
def facet_and(spark, sf):
    return search.narrow(table(spark, sf, "documents"), {"lang": "en", "source": "src7"}).select("doc_id", "n_chars")


@query("select count(*)::bigint as n from documents where lang = 'xx'")
def facet_unknown_empty(spark, sf):
    return search.narrow(table(spark, sf, "documents"), {"lang": "xx", "source": None}).agg(F.count("*").alias("n"))


@query(f"select doc_id from documents where lang = 'en' and contains({_fold('text')}, 'the er')")
def substring_filter(spark, sf):
    docs = search.narrow(table(spark, sf, "documents"), {"lang": "en"})
    return docs.where(search.contains_literal(text.fold("text"), "ＴＨＥ　er")).select("doc_id")


@query(f"select doc_id, {_count(_fold('text'), '.')}::int as n from documents where contains({_fold('text')}, '.')")
def literal_not_regex(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.fold("text").alias("folded"))
    return docs.where(search.contains_literal(F.col("folded"), ".")).select("doc_id", search.occurrences(F.col("folded"), ".").alias("n"))


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return search.build_index(docs, "doc_id", {"name": F.substring_index("text", "\n", 1), "keywords": F.col("text")})


@query(f"""
with d as (select doc_id, {_fold("split_part(text, chr(10), 1)")} as name, {_fold("text")} as words from documents),
s as (select doc_id, (3 * {_count('name', 'the')} + {_count('words', 'the')})::float as score from d)
select doc_id, score from s where score > 0 order by score desc, doc_id limit 50""")
def ranked_search(spark, sf):
    hits = search.ranked(_corpus(spark, sf), "The", "doc_id", spans=False)
    return search.in_rank_order(hits, "doc_id", 50).select("doc_id", "score")


@query(f"""
with p as (select p_partkey, {_fold('p_name')} as a, {_fold('p_brand')} as b, {_fold('p_type')} as c from part)
select p_partkey, (3 * {_count('a', 'r')} + 2 * {_count('b', 'r')} + {_count('c', 'r')})::float as score from p
where contains(a, 'r') or contains(b, 'r') or contains(c, 'r')""")
def multi_field_score(spark, sf):
    p = table(spark, sf, "part")
    index = search.build_index(p, "p_partkey", {"name": F.col("p_name"), "instructor": F.col("p_brand"), "keywords": F.col("p_type")})
    return search.ranked(index, "R", "p_partkey", spans=False).select("p_partkey", "score")


_SPANS = f"""
with p as (select p_partkey, field, {_fold('t')} as t from (select p_partkey, 0 as field, p_name as t from part union all select p_partkey, 4, p_type from part)),
s as (select p_partkey, field, string_split(t, 'e') as parts from p where contains(t, 'e')),
k as (select p_partkey, field, parts, unnest(range(1, len(parts))) as n from s)
select p_partkey, field::int as field, (list_sum([length(x) for x in parts[1:n]]) + n - 1)::int as start, 1::int as len from k"""


@query(_SPANS)
def match_spans(spark, sf):
    p = table(spark, sf, "part")
    index = search.build_index(p, "p_partkey", {"name": F.col("p_name"), "keywords": F.col("p_type")})
    return search.ranked(index, "e", "p_partkey").select("p_partkey", F.explode("spans").alias("s")).select("p_partkey", "s.*")


@query("select p_partkey, (length(p_name) - length(replace(p_name, 'e', '')))::int as marked, length(replace(p_name, 'e', ''))::int as unmarked from part where contains(p_name, 'e')")
def highlight_tiles(spark, sf):
    p = table(spark, sf, "part")
    hits = search.ranked(search.build_index(p, "p_partkey", {"name": F.col("p_name")}), "e", "p_partkey")
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len")))
    tiles = hits.join(p, "p_partkey").select("p_partkey", present.highlight(F.col("p_name"), spans).alias("tiles"))
    chars = lambda mark: F.aggregate(F.filter("tiles", lambda t: t["mark"] == mark), F.lit(0), lambda n, t: n + F.length(t["text"]))
    return tiles.select("p_partkey", chars(True).alias("marked"), chars(False).alias("unmarked"))


@query(f"select p_partkey, {_fold(chr(39).join(['p_name || ', '  ', ' || p_partkey || ', ' ', ' || p_brand || ', ' ', ' || p_type']))} as haystack from part")
def haystack(spark, sf):
    p = table(spark, sf, "part")
    none = F.lit(None).cast("string")
    return p.select("p_partkey", text.haystack(F.col("p_name"), none, F.lit(""), F.col("p_partkey").cast("string"), F.col("p_brand"), F.lit(""), F.col("p_type")).alias("haystack"))


@query(f"select count(*)::bigint as n, sum((length({_fold('text')}) <> length(text))::int)::bigint as violations from documents")
def fold_lengths(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.agg(F.count("*").alias("n"), F.sum((F.length(text.fold("text")) != F.length("text")).cast("int")).alias("violations"))


# --- dictionaries and bitmaps ---


@query("select p_partkey, (dense_rank() over (order by p_brand) - 1)::int as brand from part")
def dict_encode(spark, sf):
    p = table(spark, sf, "part")
    return dictionaries.encode(p, "p_brand", dictionaries.catch_all_last(p.select("p_brand")), "brand").select("p_partkey", "brand")


@query("""
select (row_number() over (order by case o_orderpriority when '3-MEDIUM' then 0 when '1-URGENT' then 1 else 99 end, o_orderpriority) - 1)::int as idx, o_orderpriority as label
from (select distinct o_orderpriority from orders)""")
def domain_sort(spark, sf):
    labels = table(spark, sf, "orders").select("o_orderpriority")
    return dictionaries.dictionary(labels, dictionaries.known_order(F.col("label"), ("3-MEDIUM", "1-URGENT")))


@query("select lang as value, doc_id as position from documents")
def bitmap_members(spark, sf):
    rows = bitmaps.bitmap_rows(table(spark, sf, "documents"), "lang", "doc_id")
    return bitmaps.explode_positions(rows, "value")


@query("select count(distinct doc_id)::bigint as n from documents where lang = 'en' and source = 'src0'")
def bitmap_and(spark, sf):
    docs = table(spark, sf, "documents")
    side = lambda c, v: bitmaps.bitmap_rows(docs.where(F.col(c) == v), c, "doc_id")
    return bitmaps.count_bits(bitmaps.intersect(side("lang", "en"), side("source", "src0")))


@query("select lang as value, doc_id as position from documents")
def bitmap_wire(spark, sf):
    """All members read back from the wire form of each bucket."""
    wire = bitmaps.wire_buckets(table(spark, sf, "documents"), "lang", "doc_id")
    return bitmaps.explode_positions(wire.select("value", "bucket", bitmaps.from_base64(F.col("wire")).alias("bits")), "value")


@query("select a.lang as value, d.doc_id, d.lang = a.lang as member from documents d cross join (select distinct lang from documents) a")
def bitmap_has(spark, sf):
    """Membership of every document in the bitmap of every language, theirs and others."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    rows = bitmaps.bitmap_rows(docs, "lang", "doc_id")
    values = dictionaries.small_side(docs.select(F.col("lang").alias("value")).distinct())
    at = docs.select("doc_id", F.bitmap_bucket_number(F.col("doc_id") + 1).alias("bucket")).join(values, how="cross")
    # A value with nothing in a bucket has no row there.
    read = at.join(dictionaries.small_side(rows), ["bucket", "value"], "left")
    return read.select("value", "doc_id", F.coalesce(bitmaps.has(F.col("bits"), F.pmod("doc_id", F.lit(bitmaps.BUCKET))), F.lit(False)).alias("member"))


@query("select distinct conv_id, first_value(role) over w as role, first_value(text) over w as text from conversations window w as (partition by conv_id order by turn)")
def first_wins(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("cd"), F.col("turn").alias("ord"), "role", "text")
    return convert.first_rows(rows).select(F.col("cd").alias("conv_id"), "role", "text")


@query("select conv_id, string_agg(role, ',' order by first) as roles from (select conv_id, role, min(turn) as first from conversations group by all) group by conv_id")
def merge_distinct_ordered(spark, sf):
    """Each turn brings one slot, its role: what the first turn lacks is merged in order."""
    slot = F.struct(F.col("role").alias("term"), F.lit("月").alias("day"), F.lit(1).alias("period"), F.lit(None).cast("string").alias("warning"))
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("cd"), F.col("turn").alias("ord"), F.array(slot).alias("parsed"))
    merged = convert.merged_slots(rows, convert.first_rows(rows.drop("parsed").withColumn("x", F.lit(0))))
    listed = merged.groupBy("cd").agg(F.array_sort(F.collect_list(F.struct("ord", "term"))).alias("l"))
    return listed.select(F.col("cd").alias("conv_id"), F.array_join(F.transform("l", lambda x: x["term"]), ",").alias("roles"))


@query("select min(doc_id) as doc_id, count(*)::bigint as copies from documents group by text")
def text_dedup(spark, sf):
    """First rows by the text itself, which its digest and length stand for."""
    docs = table(spark, sf, "documents").select(F.struct(F.md5("text").alias("h"), F.octet_length("text").alias("n")).alias("cd"), F.col("doc_id").alias("ord"), "lang")
    return convert.first_rows(docs, copies="copies").select(F.col("ord").alias("doc_id"), "copies")


# --- slots and grids ---


@query(f"""
select t.term, count(distinct idx)::bigint as users from {_EVENTS} e join (select distinct term from {_EVENTS}) t
on e.term = t.term or e.term = '{YEAR_LONG}' group by t.term""")
def term_propagation(spark, sf):
    rows = event_slots(spark, sf).select("idx", "term").distinct()
    dealt = grid.spread_terms(rows, rows.select(F.col("term").alias("base")), YEAR_LONG).unionByName(rows.where(F.col("term") == YEAR_LONG).withColumn("base", F.col("term")))
    return dealt.select("idx", F.col("base").alias("term")).groupBy("term").agg(F.countDistinct("idx").alias("users"))


def _timetable(spark: SparkSession, sf: str) -> DataFrame:
    e = event_slots(spark, sf)
    day = F.substring(F.lit(text.WEEKDAYS), F.col("day") + 1, F.lit(1))
    wide = F.translate(F.col("period").cast("string"), text.DIGITS, text.FULL_DIGITS)
    return e.select("idx", F.concat("term", F.lit(": "), day, F.lit("曜日"), wide, F.lit("時限, "), "term", F.lit(":集中講義, ,"), day, F.lit("曜日"), F.col("period").cast("string"), F.lit("時限")).alias("jikanwari"))


@query(f"select term, day, period, count(*)::bigint as n from {_EVENTS} group by all")
def slot_parse(spark, sf):
    rows = slots.explode_slots(_timetable(spark, sf), "jikanwari", "idx").where("warning is null")
    return rows.groupBy("term", "day", "period").agg(F.count("*").alias("n"))


@query("select w as warning, count(*)::bigint as n from events, (select unnest(['no weekday or period', 'no period']) as w) group by w")
def slot_warnings(spark, sf):
    rows = slots.explode_slots(_timetable(spark, sf), "jikanwari", "idx").where("warning is not null")
    return rows.groupBy("warning").agg(F.count("*").alias("n"))


@query(f"select day, period, count(distinct idx)::bigint as users from {_EVENTS} where {_ON_GRID} group by all")
def grid_cells(spark, sf):
    return grid.cell_counts(grid.placed(event_slots(spark, sf))).withColumnRenamed("n", "users")


@query(f"select distinct day, period, idx from {_EVENTS} where {_ON_GRID} and term in ('error', '{YEAR_LONG}')")
def grid_by_term(spark, sf):
    return grid.placed(event_slots(spark, sf), "error", year_long=YEAR_LONG).select("day", "period", "idx")


@query(f"select day, period, string_agg(idx::varchar, ',' order by idx) as ids from (select distinct day, period, idx from {_EVENTS} where {_ON_GRID} and idx < 20) group by all")
def grid_lists(spark, sf):
    """Cells as lists, of the users that someone chose."""
    return grid.build_grid(event_slots(spark, sf).where("idx < 20")).select("day", "period", _joined(F.col("courses")).alias("ids"))


@query(f"select count(distinct idx)::bigint as n from {_EVENTS} where {_ON_GRID}")
def grid_unique(spark, sf):
    return grid.unique_count(grid.placed(event_slots(spark, sf)))


@query(f"select bool_or(day = 5 and {_ON_GRID}) as has_saturday from {_EVENTS}")
def saturday_flag(spark, sf):
    return grid.has_saturday(event_slots(spark, sf))


_RARE = "(select user_id from events group by user_id order by count(*), user_id limit 1)"


@query(f"""
select d::int as day, p::int as period, count(distinct e.idx)::bigint as users
from (select unnest(range(0, 6)) as d) a cross join (select unnest(range(1, 7)) as p) b
left join (select * from {_EVENTS} where idx in {_RARE}) e on e.day = d and e.period = p group by all""")
def grid_densify(spark, sf):
    rare = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy("n", "user_id").limit(1).select(F.col("user_id").alias("idx"))
    cells = grid.build_grid(event_slots(spark, sf).join(rare, "idx", "left_semi"))
    return grid.densify(cells).select("day", "period", F.size("courses").cast("long").alias("users"))


@query(f"""
with s as (select idx, count(*) as score from {_EVENTS} group by idx),
c as (select distinct day, period, idx, score from {_EVENTS} join s using (idx) where {_ON_GRID})
select day, period, string_agg(idx::varchar, ',' order by score desc, idx) as ids from (select *, row_number() over (partition by day, period order by score desc, idx) as nth from c) where nth <= 20 group by all""")
def grid_ranked(spark, sf):
    """The first twenty of each cell, best first: a page of a grid that may be of any size."""
    rows = event_slots(spark, sf)
    score = rows.groupBy("idx").agg(F.count("*").alias("score"))
    placed = grid.placed(rows.drop("value")).drop("rank").join(score, "idx").withColumn("rank", F.struct((-F.col("score")).alias("s"), "idx"))
    return grid.cells(placed, page=20).select("day", "period", _joined(F.col("courses")).alias("ids"))


@query(f"select day, period, idx from (select distinct day, period, idx, count(distinct idx) over (partition by day, period) as n from {_EVENTS} where {_ON_GRID}) where n >= 2")
def conflicts(spark, sf):
    return grid.conflict_rows(grid.placed(event_slots(spark, sf)))


@query(f"""
with s as (select distinct idx, term, day, period from {_EVENTS} where {_ON_GRID}),
t as (select distinct term from s where term <> '{YEAR_LONG}'),
b as (select distinct t.term, s.day, s.period, s.idx from s join t on s.term = t.term or s.term = '{YEAR_LONG}'),
c as (select term, day, period, string_agg(idx::varchar, ',' order by idx) as ids from b group by all having count(*) >= 2),
f as (select day, period, ids, min(term) as term from c group by all)
select day, period, idx, term from b join f using (day, period, term)""")
def plan_conflicts(spark, sf):
    return grid.plan_conflict_rows(event_slots(spark, sf).drop("value"), year_long=YEAR_LONG)


@query(f"""
with s as (select distinct idx, term, day, period from {_EVENTS} where {_ON_GRID} and idx < 40),
t as (select distinct term from s where term <> '{YEAR_LONG}'),
b as (select distinct t.term, s.day, s.period, s.idx from s join t on s.term = t.term or s.term = '{YEAR_LONG}'),
c as (select term, day, period, string_agg(idx::varchar, ',' order by idx) as ids from b group by all having count(*) >= 2)
select day, period, ids, min(term) as term from c group by all""")
def plan_conflict_lists(spark, sf):
    """Clashes of a chosen plan as lists."""
    found = grid.plan_conflicts(event_slots(spark, sf).where("idx < 40").drop("value"), year_long=YEAR_LONG)
    return found.select("day", "period", _joined(F.col("courses")).alias("ids"), "term")


@query(f"""
with g as (select day, period, string_agg(idx::varchar, ',' order by idx) as ids from (select distinct day, period, idx from {_EVENTS} where {_ON_GRID} and term = 'click' and idx < 40) group by all),
p as (select day, period, string_agg(idx::varchar, ',' order by idx) as ids from (select distinct day, period, idx from {_EVENTS} where {_ON_GRID} and idx = 7) group by all)
select coalesce(g.day, p.day) as day, coalesce(g.period, p.period) as period, coalesce(p.ids, g.ids) as ids, p.ids is not null as planned
from g full outer join p on g.day = p.day and g.period = p.period""")
def plan_overlay(spark, sf):
    rows = event_slots(spark, sf)
    shown = grid.overlay(grid.build_grid(rows.where("term = 'click' and idx < 40")), grid.build_grid(rows.where("idx = 7")))
    return shown.select("day", "period", _joined(F.col("courses")).alias("ids"), "planned")


@query("select p_partkey from part where p_partkey::varchar in ('3', '11', '7', 'x', '3', '99999999')")
def resolve_codes(spark, sf):
    p = table(spark, sf, "part")
    codes = spark.createDataFrame([(c,) for c in ("3", "11", "7", "x", "3", "99999999")], "cd string")
    return engine.resolve(p.withColumn("cd", F.col("p_partkey").cast("string")), codes, key="p_partkey")


# --- tallies ---


@query("select p_partkey, case when p_size % 5 = 0 then null else (p_size / 2)::float end as credits from part")
def credit_parse(spark, sf):
    raw = F.when(F.col("p_size") % 5 == 0, F.lit("単位なし")).otherwise(F.concat(F.lit("　"), (F.col("p_size") / 2).cast("string"), F.lit("単位")))
    return table(spark, sf, "part").select("p_partkey", text.parse_credits(raw).alias("credits"))


@query("""
with p as (select p_brand, case when p_size > 25 then p_type else '' end as t, (p_size // 10)::varchar as y, case when p_size % 5 = 0 then null else p_size / 2 end as c from part),
a as (select 'kubun' as axis, p_brand as key, c from p union all select 'bunrui', t, c from p where t <> '' union all select 'nen', y, c from p union all select 'total', '', c from p)
select axis, key, coalesce(sum(c), 0)::float as credits, count(*)::bigint as count, sum((c is null)::int)::bigint as uncredited from a group by all""")
def credit_axes(spark, sf):
    size = F.col("p_size")
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("kubun"), F.when(size > 25, F.col("p_type")).alias("bunrui"), F.floor(size / 10).cast("string").alias("nen"), F.when(size % 5 == 0, None).otherwise(size / 2).alias("credit"))
    return tallies.credit_axes(rows)


@query("select d.doc_id, case l.quality when 1 then 'good' when 0 then 'junk' end as card, l.toxic from documents d left join labels l using (doc_id)")
def detail_left_join(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    mode = F.struct(F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "junk").alias("mode"))
    none = F.array().cast("array<struct<item:string,weight:bigint,type:string>>")
    details = labels.select(F.col("doc_id").alias("cd"), F.col("toxic").alias("unit"), mode.alias("delivery"), F.struct(none.alias("rows")).alias("eval"))
    cards = convert.with_details(docs.select(F.col("doc_id").alias("cd")), details)
    return cards.select(F.col("cd").alias("doc_id"), F.col("dm").alias("card"), F.col("unit").alias("toxic"))


_W = "(case when l_orderkey % 7 = 0 then 0 else l_quantity end)"
_SEGMENTS = f"""
select l_orderkey, l_linenumber, l_returnflag, floor(100 * (case when sum(w) over o > 0 then w / sum(w) over o else 1 / count(*) over o end) + 0.5)::int as pct, sum(w) over o > 0 as has_weight
from (select *, {_W} as w from lineitem) window o as (partition by l_orderkey)"""


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_orderkey") % 7 == 0, F.lit(0.0)).otherwise(F.col("l_quantity")).alias("w"))
    return tallies.shares(rows, "l_orderkey", "w").drop("w")


@query(_SEGMENTS)
def eval_share(spark, sf):
    return _segments(spark, sf)


@query(f"""
with t as (select l_orderkey, l_returnflag, sum(pct)::bigint as pct, min(l_linenumber) as first from ({_SEGMENTS}) group by all),
r as (select *, row_number() over o as n, lead(pct) over o as next from t window o as (partition by l_orderkey order by pct desc, first, l_returnflag))
select l_orderkey, l_returnflag, pct, coalesce(next = pct, false) as tie from r where n = 1""")
def eval_top_tie(spark, sf):
    """Line numbers may repeat within an order, so ties end with the flag."""
    sums = tallies.by_type(_segments(spark, sf), "l_orderkey", "l_returnflag", "l_linenumber")
    return tallies.top_type(sums.withColumn("first", F.struct("first", "l_returnflag")), "l_orderkey", "l_returnflag")


@query(f"""
with t as (select l_orderkey, l_returnflag, sum(pct)::bigint as pct from ({_SEGMENTS}) group by all)
select l_orderkey, l_returnflag, pct, coalesce(sum(pct) over (partition by l_orderkey order by rank, pct desc rows between unbounded preceding and 1 preceding), 0)::bigint as before
from (select *, case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end as rank from t where pct > 0)""")
def eval_running(spark, sf):
    sums = tallies.by_type(_segments(spark, sf), "l_orderkey", "l_returnflag", "l_linenumber")
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return tallies.laid_out(sums, "l_orderkey", rank).select("l_orderkey", "l_returnflag", "pct", "before")


# --- rules over text ---


#: Words of assessments in the order in which they decide.
_KINDS = (("小テスト", "quiz"), ("ミニレポート", "minireport"), ("試験", "exam"), ("レポート", "report"), ("課題", "report"), ("授業態度", "attendance"), ("期末", "exam"), ("面接", "other"))


@query("""
with w(i, w, k) as (values (0, '小テスト', 'quiz'), (1, 'ミニレポート', 'minireport'), (2, '試験', 'exam'), (3, 'レポート', 'report'), (4, '課題', 'report'), (5, '授業態度', 'attendance'), (6, '期末', 'exam'), (7, '面接', 'other'))
select p_partkey, case when a.i < b.i then a.k else b.k end as kind from part join w a on a.i = p_size % 8 join w b on b.i = p_partkey % 8""")
def classify_rules(spark, sf):
    """Two words of every pair of kinds in a text: the specific kind decides."""
    word = lambda i: F.element_at(F.array(*[F.lit(w) for w, _ in _KINDS]), (i + 1).cast("int"))
    said = F.concat("p_name", word(F.col("p_size") % 8), F.lit("・"), word(F.col("p_partkey") % 8), "p_brand")
    return table(spark, sf, "part").select("p_partkey", rules.assessment_type(said).alias("kind"))


@query("""
select p_partkey, case when o and (d or r) then 'hybrid' when o then 'onsite' when d and not l then 'ondemand' when d or r then 'online' else 'unknown' end as mode
from (select p_partkey, p_size % 2 = 1 as o, p_size % 3 = 1 as d, p_partkey % 3 = 1 or p_partkey % 5 = 1 as r, p_partkey % 5 = 1 as l from part)""")
def delivery_bits(spark, sf):
    """All combinations of on site, on demand, remote and live words."""
    raw = F.concat("p_name", F.expr("if(p_size % 2 = 1, '対面', '非対面')"), F.expr("if(p_size % 3 = 1, '録画', '')"), F.expr("if(p_partkey % 3 = 1, '遠隔', '')"), F.expr("if(p_partkey % 5 = 1, '同時', '')"))
    return table(spark, sf, "part").select("p_partkey", rules.delivery_mode(raw).alias("mode"))


@query("""
select doc_id, len([x for x in string_split(text, chr(10)) if regexp_matches(x, '\\S')])::int as kept, (1 + length(text) - length(replace(text, chr(10), '')))::int as all_lines from documents""")
def line_normalize(spark, sf):
    out = text.normalize_lines("text")
    return table(spark, sf, "documents").select("doc_id", F.when(out == "", 0).otherwise(F.size(F.split(out, "\n"))).alias("kept"), F.size(text.lines("text")).alias("all_lines"))


@query("select p_partkey, p_name || '（' || p_brand || '、x）|' || p_type || '|a b|c' as terms from part")
def keyword_split(spark, sf):
    """Separators within brackets and ASCII spaces do not split."""
    said = F.concat("p_name", F.lit("（"), "p_brand", F.lit("、x）、 "), "p_type", F.lit(",,a b　c\n"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(rules.split_keywords(said), "|").alias("terms"))


@query("select p_partkey, p_name || ' (' || p_brand || ' x)|' || p_type as terms from part")
def keyword_repair(spark, sf):
    """Entries that an open bracket holds together."""
    parts = F.array(F.concat("p_name", F.lit(" (") , "p_brand"), F.lit("x)"), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(rules.repair_keywords(parts), "|").alias("terms"))


@query("""
with l as (select doc_id, unnest(range(1, len(p) + 1)) as k, p from (select doc_id, string_split(text, chr(10)) as p from documents)),
m as (select doc_id, k, case when not regexp_matches(p[k], '\\S') then '' when regexp_matches(trim(p[k], ' ' || chr(9) || chr(13)), '^(?:[・･]|[①-⑳]|\\(?[0-9]+\\)?[.．)])\\s*') then 'list' else 'paragraph' end as kind from l),
s as (select doc_id, kind, lag(kind, 1, '') over (partition by doc_id order by k) as before from m)
select doc_id, sum((kind = 'list' and before <> 'list')::int)::bigint as lists, sum((kind = 'paragraph' and before <> 'paragraph')::int)::bigint as paragraphs from s group by doc_id""")
def prose_blocks(spark, sf):
    """Runs of list and paragraph lines, by a window over the lines of each text."""
    runs = present.prose_runs(table(spark, sf, "documents"), "doc_id", "text")
    opens = lambda name: F.sum(((F.col("kind") == name) & (F.col("before") != name)).cast("int"))
    return runs.groupBy("doc_id").agg(opens("list").alias("lists"), opens("paragraph").alias("paragraphs"))


@query("select page_id, len(regexp_extract_all(t, 'https?://[^\\s<>\"'')]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))::int as links, length(t)::int as chars from (select page_id, 'see ' || url || ' or a.b@example.org now' as t from pages)")
def link_tokens(spark, sf):
    """Links of a sentence with the page's URL; the parts tile the sentence."""
    said = F.concat(F.lit("see "), F.col("url"), F.lit(" or a.b@example.org now"))
    parts = table(spark, sf, "pages").select("page_id", present.link_parts(said).alias("parts"))
    chars = F.aggregate("parts", F.lit(0), lambda n, p: n + F.length(p["text"]))
    return parts.select("page_id", F.size(F.filter("parts", lambda p: p["kind"].isNotNull())).alias("links"), chars.alias("chars"))


_PLAIN = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g'), '(?i)<br\\s*/?>|</(?:p|div|li|tr|h[1-6])>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g')"
for _sign, _text in html_detail.ENTITIES:
    _PLAIN = f"replace({_PLAIN}, '{_sign}', {_sql(_text)})"


@query(f"select page_id, array_to_string([regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') for x in string_split({_PLAIN}, chr(10)) if regexp_matches(x, '\\S')], chr(10)) as text from pages")
def html_text(spark, sf):
    return html_detail.block_text(table(spark, sf, "pages"), "html", "page_id")


@query("select doc_id, code from (select doc_id, unnest(list_distinct(regexp_extract_all(' ' || regexp_replace(text || ' ' || (doc_id + 10000), '([0-9]+)', ' \\1 ', 'g') || ' ', ' ([0-9]{5}) ', 1))) as code from documents) where code::int - 10000 in (select p_partkey from part)")
def code_xref(spark, sf):
    """Five-digit numbers in texts (with one put after each) that name a part."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(" "), (F.col("doc_id") + 10000).cast("string")).alias("t"))
    codes = docs.select("doc_id", F.explode(F.array_distinct(present.course_codes("t"))).alias("code"))
    known = table(spark, sf, "part").select((F.col("p_partkey") + 10000).cast("string").alias("code"))
    return codes.join(known, "code", "left_semi").select("doc_id", "code")


# --- lenient JSON ---


@query("select event_id, coalesce(json_extract_string(props, '$.k'), '') as k from events")
def lenient_json(spark, sf):
    return ingest.lenient_fields(table(spark, sf, "events"), "props", ("k",), (), "event_id")


@query("select (event_id % 50 <> 0) as valid, count(*)::bigint as n from events group by all")
def bad_record_split(spark, sf):
    """Each user's events as documents, where some records are no objects."""
    e = table(spark, sf, "events").select("user_id", F.expr("event_id div 1000").alias("page"), F.when(F.col("event_id") % 50 == 0, "17").otherwise(F.col("props")).alias("p"))
    # A document has a user's events among a thousand, so a hot user has many documents and no large one.
    docs = e.groupBy(F.col("user_id").cast("int").alias("file_ord"), "page").agg(F.concat(F.lit('{"selectKogiDtoList":['), F.array_join(F.collect_list("p"), ","), F.lit("]}")).alias("text"))
    return ingest.parse_documents(docs).groupBy("valid").agg(F.count("*").alias("n"))


# --- bookkeeping ---


@query("""
with w as (select doc_id::varchar as cd, lang as last_update, doc_id as ord from documents), o as (select doc_id::varchar as cd from labels),
s as (select doc_id::varchar as cd, 'en' as last_update from documents where source = 'src1'), t as (select doc_id::varchar as cd, 'de' as last_update from documents where n_chars < 1000)
select cd, last_update, ord from w where cd in (select cd from o) and not exists (select 1 from s where s.cd = w.cd and s.last_update = w.last_update) and not exists (select 1 from t where t.cd = w.cd and t.last_update = w.last_update)""")
def incremental_select(spark, sf):
    docs = table(spark, sf, "documents")
    cd = F.col("doc_id").cast("string").alias("cd")
    wanted = docs.select(cd, F.col("lang").alias("last_update"), F.col("doc_id").alias("ord"))
    saved = docs.where("source = 'src1'").select(cd, F.lit("en").alias("last_update"))
    dead = docs.where("n_chars < 1000").select(cd, F.lit("de").alias("last_update"), F.lit(2).alias("fails"))
    return incremental.select_stale(wanted, saved, dead, only=table(spark, sf, "labels").select(cd))


@query("""
with s as (select doc_id::varchar as cd, 'a' as u, 1 as fails from labels), f as (select doc_id::varchar as cd, case when source = 'src0' then 'b' else 'a' end as n from documents where lang = 'en'),
d as (select doc_id::varchar as cd from documents where source = 'src3')
select coalesce(s.cd, f.cd) as cd, coalesce(n, u) as last_update, (case when n is null or n = u then coalesce(fails, 0) else 0 end + (n is not null)::int)::int as fails
from s full outer join f on s.cd = f.cd where coalesce(s.cd, f.cd) not in (select cd from d)""")
def tombstone_merge(spark, sf):
    docs, cd = table(spark, sf, "documents"), F.col("doc_id").cast("string").alias("cd")
    state = table(spark, sf, "labels").select(cd, F.lit("a").alias("last_update"), F.lit(1).alias("fails"))
    failed = docs.where("lang = 'en'").select(cd, F.when(F.col("source") == "src0", "b").otherwise("a").alias("last_update"))
    return incremental.merge_tombstones(state, failed, docs.where("source = 'src3'").select(cd))


@query("""
with e as (select user_id, event_id, sum((event_type = 'error')::int) over (partition by user_id order by event_id rows between 1 preceding and current row) as run from events)
select user_id, min(event_id) as tripped_at from e where run = 2 group by user_id""")
def breaker(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("blocked"))
    return incremental.breaker(e, "user_id", "event_id", F.col("blocked"), 2)


_REASON = "case event_id % 4 when 0 then 'fatal: ' || event_type || ': no detail' when 1 then 'save failed: disk ' || user_id when 2 then 'HTTP 403' else 'fatal: empty html' end"


@query("select case event_id % 4 when 0 then event_type when 1 then 'save failed' when 2 then 'HTTP 403' else 'empty html' end as reason, count(*)::bigint as n from events group by all")
def failure_tally(spark, sf):
    return incremental.failure_tally(table(spark, sf, "events").select(F.expr(_REASON).alias("reason")))


@query("select o_orderkey, (year(o_orderdate) - (month(o_orderdate) <= 3)::int)::int as year from orders")
def academic_year(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", present.academic_year(F.col("o_orderdate")).alias("year"))


@query("select case when month(o_orderdate) between 4 and 7 then '1学期' when month(o_orderdate) >= 10 or month(o_orderdate) = 1 then '2学期' else 'all' end as term, count(*)::bigint as n from orders group by all")
def term_by_month(spark, sf):
    available = F.array(F.lit("1学期"), F.lit("2学期"))
    return table(spark, sf, "orders").groupBy(present.default_term_in(available, F.month("o_orderdate")).alias("term")).agg(F.count("*").alias("n"))


@query("select c_custkey, c_name || '|' || c_mktsegment || '-~(é)' as codes, '1.' || replace(c_name, '#', '%23') || '-' || c_mktsegment || '%2D~(%C3%A9)' as token from customer")
def plan_token(spark, sf):
    codes = F.array("c_name", F.concat("c_mktsegment", F.lit("-~(é)")))
    rows = table(spark, sf, "customer").select("c_custkey", present.encode_plan(codes).alias("token"))
    return rows.select("c_custkey", F.array_join(present.decode_plan(F.concat("token", F.lit(";later"))), "|").alias("codes"), "token")


def _hash_sql(c: str) -> str:
    return f"list_reduce(list_prepend(0::bigint, [ord(x)::bigint for x in string_split({c}, '')]), lambda h, u: (h * 31 + u) % 4294967296)"


@query(f"select p_partkey, (abs(case when h >= 2147483648 then h - 4294967296 else h end) % {present.PALETTE_SIZE})::int as bucket from (select p_partkey, {_hash_sql('p_name')} as h from part)")
def colour_bucket(spark, sf):
    return table(spark, sf, "part").select("p_partkey", present.colour_bucket("p_name").alias("bucket"))


@query("select n_nationkey, case when n_nationkey between 1 and 17 then n_nationkey end as goal from nation")
def goal_lookup(spark, sf):
    raw = F.concat(F.col("n_nationkey").cast("string"), F.lit(" "), F.col("n_name"))
    number = F.map_from_arrays(F.array(*[F.lit(t) for t in present.GOALS.values()]), F.array(*[F.lit(k) for k in present.GOALS]))
    return table(spark, sf, "nation").select("n_nationkey", F.try_element_at(number, present.goal_title(raw)).alias("goal"))


@query("select user_id, least(power(2.0, n) * 0.5, 60.0) as seconds from (select user_id, (count(*) % 12)::int as n from events group by user_id)")
def backoff(spark, sf):
    tries = table(spark, sf, "events").groupBy("user_id").agg((F.count("*") % 12).cast("int").alias("n"))
    return tries.select("user_id", incremental.backoff_seconds(F.lit(0.5), F.col("n")).alias("seconds"))
