"""Queries of what is indexed, encoded or written, and read back: indexes, containers, lookups, files.

Each works on tables that it derives from the driver's and keeps in the shared
folder; the SQL says what reading back must give.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgrid import catalogue
from facetgrid.catalogue import _BASE as BASE
from facetgrid.catalogue import _CELL as CELL
from facetgrid.catalogue import _score as score_sql
from facetgrid.functions.text import fold_text
from facetgrid.operators import bitmaps, containers, gram_index, page_tree, search
from facetgrid.plans import convert as c
from facetgrid.plans.engine import Engine
from facetgrid.queries import _corpus as corpus
from facetgrid.queries import _count as count_sql
from facetgrid.queries import _fold as fold_sql
from facetgrid.queries import _sql as quoted_sql
from facetgrid.queries import _PLAIN as PLAIN
from facetgrid.queries import dealt, query, table
from facetgrid.sources import index_codec, ingest, lookup, sinks, upsert
from facetgrid.sources.shared import new_path
from facetgrid.streaming import crawl


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- literal search over postings ---

LITERALS = ("The", "ＴＨＥ　er", ".", "nn", "the the", "qqq")


@query("with d as (select doc_id, " + fold_sql("split_part(text, chr(10), 1)") + " as name, " + fold_sql("text") + " as words from documents) " + " union all ".join(
    f"select {quoted_sql(q)} as literal, doc_id, (3 * {count_sql('name', fold_text(q))} + {count_sql('words', fold_text(q))})::float as score from d where contains(words, {quoted_sql(fold_text(q))})" for q in LITERALS))
def indexed_search(spark, sf):
    """Ranked literals from postings of their grams alone, no text read."""
    docs = table(spark, sf, "documents")
    index = gram_index.write(docs, new_path(spark, "grams"), "doc_id", {"name": F.substring_index("text", "\n", 1), "keywords": F.col("text")})
    return union([index.ranked(spark, q).select(F.lit(q).alias("literal"), "doc_id", "score") for q in LITERALS])


@query(f"select doc_id from documents where lang = 'en' and contains({fold_sql('text')}, 'the er')")
def indexed_filter(spark, sf):
    """A facet and a literal found by its rarest gram first."""
    docs = table(spark, sf, "documents")
    index = gram_index.write(docs, new_path(spark, "grams"), "doc_id", {"text": F.col("text")})
    found = index.containing(spark, "ＴＨＥ　er")
    return search.narrow(docs, {"lang": "en"}).join(found, "doc_id", "left_semi").select("doc_id")


PARTS_OF = ("e", "ee", "ring", "an")


@query(" union all ".join(f"""select * from (with p as (select p_partkey, field, {fold_sql('t')} as t from (select p_partkey, 0 as field, p_name as t from part union all select p_partkey, 4, p_type from part)),
s as (select p_partkey, field, string_split(t, '{q}') as parts from p where contains(t, '{q}')), k as (select p_partkey, field, parts, unnest(range(1, len(parts))) as n from s)
select '{q}' as literal, p_partkey, field::int as field, (list_sum([length(x) for x in parts[1:n]]) + {len(q)} * (n - 1))::int as start, {len(q)}::int as len from k)""" for q in PARTS_OF))
def indexed_spans(spark, sf):
    """Spans of literals, made from positions in postings."""
    index = gram_index.write(table(spark, sf, "part"), new_path(spark, "grams"), "p_partkey", {"name": F.col("p_name"), "keywords": F.col("p_type")})
    spans = [index.ranked(spark, q.upper()).select(F.lit(q).alias("literal"), "p_partkey", F.explode("spans").alias("s")) for q in PARTS_OF]
    return union(spans).select("literal", "p_partkey", "s.*")


@query(f"""{BASE}, scored as (select idx, {score_sql('ring')} as score from courses where term_label is not null), hits as (select * from scored where score > 0),
placed as (select distinct day, period, idx, score from slots join hits using (idx) where {CELL})
select day, period, string_agg(idx::varchar, ',' order by score desc, idx) as ids from (select *, row_number() over (partition by day, period order by score desc, idx) as nth from placed) where nth <= {catalogue.PAGE} group by all""")
def engine_grams(spark, sf):
    """The façade over postings: cells best first."""
    data = catalogue.dataset(spark, sf)
    engine = Engine(data)
    engine.load_grams(gram_index.write(c.search_fields(data.courses), new_path(spark, "grams"), "idx", {f: F.col(f) for f in search.FIELDS}))
    ids = F.array_join(F.transform("courses", lambda x: x.cast("string")), ",").alias("ids")
    return engine.query(query="ＲＩＮＧ", page=catalogue.PAGE).cells.select("day", "period", ids)


# --- bitmaps of any number of positions ---


@query("select lang as value, doc_id as position from documents")
def container_members(spark, sf):
    """Containers of any kind, read back."""
    return containers.unpack(containers.build(table(spark, sf, "documents"), "lang", "doc_id"), "value")


@query("select lang as value, doc_id as position from documents where n_chars > 500 or source = 'src0'")
def container_union(spark, sf):
    """Two sets of containers merged."""
    docs = table(spark, sf, "documents")
    parts = [containers.build(docs.where(w), "lang", "doc_id") for w in ("n_chars > 500", "source = 'src0'")]
    return containers.unpack(containers.merge(*parts), "value")


@query("select lang as value, doc_id as position from documents where n_chars > 500 and source = 'src0'")
def container_common(spark, sf):
    """Two sets of containers intersected, value by value."""
    docs = table(spark, sf, "documents")
    return containers.common(*[containers.build(docs.where(w), "lang", "doc_id") for w in ("n_chars > 500", "source = 'src0'")])


@query("select o_orderpriority as value, o_orderkey as position from orders")
def wire_members(spark, sf):
    """The wire form over all buckets of positions, read back."""
    orders = table(spark, sf, "orders")
    n = orders.agg(F.max("o_orderkey")).first()[0] + 1
    wires = containers.wire(bitmaps.bitmap_rows(orders, "o_orderpriority", "o_orderkey"), n, "value")
    return containers.from_wire(wires, "value")


# --- lookups ---


def _store(spark: SparkSession, sf: str) -> lookup.Lookup:
    docs = table(spark, sf, "documents").select(F.concat(F.lit("D"), "doc_id").alias("cd"), "lang", "n_chars")
    return lookup.write(docs, new_path(spark, "lookup"), "cd", files=16)


@query("select 'D' || doc_id as cd, lang, n_chars from documents where doc_id in (select doc_id from labels)")
def point_lookup(spark, sf):
    """Keys of labelled documents, and as many that no record has."""
    labels = table(spark, sf, "labels")
    keys = union([labels.select(F.concat(F.lit("D"), "doc_id", F.lit(end)).alias("cd")) for end in ("", "x")])
    return _store(spark, sf).find(keys)


@query("select count(*)::bigint as asked, 0::bigint as found, 0::int as files from documents")
def absent_lookup(spark, sf):
    """Keys beyond all ranges: no file is opened."""
    keys = table(spark, sf, "documents").select(F.concat(F.lit("X"), "doc_id").alias("cd"))
    found = _store(spark, sf).find(keys)
    return keys.agg(F.count("*").alias("asked")).join(found.agg(F.count("*").alias("found")), how="cross").withColumn("files", F.lit(len(found.inputFiles())))


# --- files ---


@query(f"""{BASE} select cd, p_name as nm, ki, (select count(*) from slots s where s.idx = c.idx)::int as slots from courses c""")
def dataset_file(spark, sf):
    """The document written in parts, joined to one file, and read back after its version is checked."""
    path = new_path(spark, "dataset")
    sinks.write_dataset(catalogue.dataset(spark, sf), path, "2026-01-01T00:00:00Z")
    return ingest.read_dataset(spark, path).select(F.explode("courses").alias("c")).select("c.cd", "c.nm", "c.ki", F.size("c.slots").alias("slots"))


@query(f"{BASE} select (idx // 100 + 1)::bigint as part, count(*)::bigint as courses from courses group by all")
def dataset_parts(spark, sf):
    """Courses in each part of a document of 100 a part, by the manifest's files (B1)."""
    folder = new_path(spark, "parts")
    parts = c.document_parts(catalogue.dataset(spark, sf), "2026-01-01T00:00:00Z", part_rows=100)
    sinks.write_parts(parts.select("part", F.encode("text", "UTF-8").alias("content")), folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("text"))
    whole = sinks.read_manifest(spark, folder).join(files, "name")
    courses = (F.length("text") - F.length(F.replace("text", F.lit('{"cd":'), F.lit("")))) / 6
    return whole.select(F.col("part").cast("long").alias("part"), courses.cast("long").alias("courses")).where("courses > 0")


def _details(spark: SparkSession, sf: str) -> DataFrame:
    p = dealt(table(spark, sf, "part"), "p_partkey")  # a file takes far longer to write than its row to read
    mode = F.struct(F.lit("online").alias("mode"), F.lit("x").alias("raw"), (F.col("p_size") > 25).alias("isMedia"))
    return p.select(F.col("p_partkey").cast("string").alias("cd"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("lastUpdate"), F.concat("p_name", F.lit("\n"), "p_type").alias("summary"), mode.alias("delivery"), F.array("p_brand", "p_type").alias("keywords"))


@query("select p_partkey::varchar as cd, case when p_size > 5 then p_brand end as mark, p_name || chr(10) || p_type as summary, p_size > 25 as media, p_brand || '|' || p_type as keywords from part")
def detail_files(spark, sf):
    """A file for each code, written by tasks and read back."""
    path = new_path(spark, "details")
    sinks.write_details(_details(spark, sf), path)
    read = ingest.read_details(spark, path)
    return read.select("cd", F.col("lastUpdate").alias("mark"), "summary", F.col("delivery.isMedia").alias("media"), F.array_join("keywords", "|").alias("keywords"))


@query("select p_partkey::varchar as cd, case when p_size > 5 then p_brand else '' end as last_update from part")
def saved_marks(spark, sf):
    """Codes and marks of what is saved."""
    path = new_path(spark, "details")
    sinks.write_details(_details(spark, sf), path)
    return ingest.saved_updates(spark, path)


@query("select doc_id::varchar as cd, source as last_update, (n_chars % 5)::int as fails from documents")
def tombstone_file(spark, sf):
    """Sorted lines made by tasks, one file, read back."""
    path = new_path(spark, "tombstones")
    sinks.write_tombstones(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("cd"), F.col("source").alias("last_update"), (F.col("n_chars") % 5).cast("int").alias("fails")), path)
    return ingest.read_tombstones(spark, path)


@query(f"select row_number() over (order by p_partkey) - 1 as idx, {fold_sql('p_name')} as name, '' as subtitle, {fold_sql('p_brand')} as instructor, p_partkey::varchar as code, {fold_sql('p_type')} as keywords from part")
def index_parts(spark, sf):
    """The binary index written in parts by tasks, and read part by part."""
    folder = new_path(spark, "index")
    p = table(spark, sf, "part").withColumnRenamed("p_partkey", "idx")
    fields = {"name": F.col("p_name"), "subtitle": F.lit(""), "instructor": F.col("p_brand"), "code": F.col("idx").cast("string"), "keywords": F.col("p_type")}
    sinks.write_parts(sinks.index_parts(search.build_index(p, "idx", fields)), folder)
    return index_codec.read_index_parts(spark, folder)


@query("select 'page-' || page_id || '.json' as name, case when page_id % 5 = 0 then 'new' else html end as content from pages where page_id % 3 <> 0 union all select 'own.txt', 'kept'")
def page_files(spark, sf):
    """Pages written twice: changed ones replaced, those gone deleted, others kept."""
    folder = new_path(spark, "pages")
    pages = table(spark, sf, "pages").select("page_id", F.concat(F.lit("page-"), "page_id", F.lit(".json")).alias("name"), F.coalesce("html", F.lit("")).alias("content"))
    own = spark.range(1).select(F.lit("own.txt").alias("name"), F.lit("kept").alias("content"))
    sinks.write_pages(pages.select("name", "content").unionByName(own), folder)
    later = pages.where("page_id % 3 <> 0").withColumn("content", F.when(F.col("page_id") % 5 == 0, "new").otherwise(F.col("content")))
    sinks.write_pages(later.select("name", "content"), folder, keep="own.*")
    read = spark.read.format("binaryFile").load(folder)
    return read.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("content"))


# --- page trees ---

_MARKUP = "regexp_replace(html, '(?is)<!--.*?-->|(<script\\b[^>]*>).*?</script\\s*>|(<style\\b[^>]*>).*?</style\\s*>', '\\1\\2', 'g')"


@query(f"select page_id, name, count(*)::bigint as n from (select page_id, unnest(regexp_extract_all({_MARKUP}, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as name from pages) group by all")
def page_elements(spark, sf):
    """Elements of each page, by a table function joined laterally in SQL."""
    page_tree.register(spark)
    sql = "select p.page_id, n.name, count(*) as n from {pages} p, lateral page_nodes(p.html) n where n.name is not null group by p.page_id, n.name"
    return spark.sql(sql, pages=table(spark, sf, "pages"))


@query(f"""with l as (select page_id, regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') as text, n from (select page_id, unnest(string_split({PLAIN}, chr(10))) as x, generate_subscripts(string_split({PLAIN}, chr(10)), 1) as n from pages))
select page_id, (row_number() over (partition by page_id order by n) - 1)::int as line, text from l where text <> ''""")
def page_lines(spark, sf):
    """Lines of each page's text from its tree."""
    page_tree.register(spark)
    return spark.sql("select p.page_id, l.line, l.text from {pages} p, lateral page_lines(p.html) l", pages=table(spark, sf, "pages"))


# --- streams ---


@query("""
with o as (select user_id, event_id, case event_type when 'error' then 403 when 'click' then 404 end as status, event_id % 13 = 0 as fatal from events),
r as (select *, sum(coalesce(status = 403, false)::int) over (partition by user_id order by event_id rows between 1 preceding and current row) as run from o),
t as (select *, coalesce(max((run = 2)::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as over from r)
select user_id, count(*) filter (where status is null and not fatal) as fetched, count(*) filter (where status is not null or fatal) as skipped, count(*) filter (where fatal) as no_detail, bool_or(run = 2) as aborted, coalesce(min(event_id) filter (where run = 2), -1) as tripped_at
from t where over = 0 group by user_id""")
def crawl_stream(spark, sf):
    """The breaker and the report of each run as a stream of micro-batches."""
    kind = F.expr("case event_type when 'error' then 403 when 'click' then 404 end")
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("at"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("status"), F.concat(F.lit("HTTP "), kind.cast("string")).alias("reason"), (F.col("event_id") % 13 == 0).alias("fatal"))
    source, target = new_path(spark, "outcomes"), new_path(spark, "reports")
    low, high = rows.agg(F.min("at"), F.max("at")).first()
    third = (high - low) // 3 + 1
    for k in range(3):  # three batches, one after another
        rows.where(F.col("at").between(low + k * third, low + (k + 1) * third - 1)).coalesce(1).write.mode("append").parquet(source)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(crawl.OUTCOME).option("maxFilesPerTrigger", 1).parquet(source)
        crawl.start_reports(stream, target, new_path(spark, "checkpoint"), n=2, quiet="3650 days").awaitTermination()
    finally:
        spark.conf.set(name, before)
    found = crawl.latest(spark, target)
    return found.select(F.col("run").cast("bigint").alias("user_id"), "fetched", "skipped", "no_detail", "aborted", F.coalesce("tripped_at", F.lit(-1)).alias("tripped_at"))


# --- state by batches ---


@query("select distinct conv_id, first_value(role) over w as role, first_value(text) over w as text from conversations window w as (partition by conv_id order by turn)")
def upsert_first_wins(spark, sf):
    """First rows of each key as state that four batches change, out of order, bucket by bucket."""
    state = upsert.BucketedState(new_path(spark, "state"), "conv_id", "conv_id long, turn long, role string, text string", count=16)
    rows = table(spark, sf, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    first = lambda both: both.groupBy("conv_id").agg(F.min_by(F.struct("turn", "role", "text"), "turn").alias("r")).select("conv_id", "r.*")
    share = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))  # four batches that make up the whole table
    for k in range(4):
        state.upsert(rows.where(share == k), first)
    return state.read(spark).select("conv_id", "role", "text")


@query("select doc_id % 1000 as code, count(*)::bigint as fails, max(n_chars) as most from documents group by all")
def upsert_tally(spark, sf):
    """Tallies by code as state, two batches merged by sums."""
    state = upsert.BucketedState(new_path(spark, "state"), "code", "code long, fails long, most long", count=8)
    rows = table(spark, sf, "documents").select((F.col("doc_id") % 1000).alias("code"), F.lit(1).cast("long").alias("fails"), F.col("n_chars").cast("long").alias("most"), "source")
    added = lambda both: both.groupBy("code").agg(F.sum("fails").alias("fails"), F.max("most").alias("most"))
    for batch in (rows.where("source = 'src0'"), rows.where("source is null or source <> 'src0'")):
        state.upsert(batch, added)
    return state.read(spark)
