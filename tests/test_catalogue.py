import hashlib
import json

import pytest
from fixture_courses import ROWS
from pyspark.sql import functions as F

from facetgrid.functions import present, rules
from facetgrid.operators import bitmaps, dictionaries, grid, incremental, search, slots, tallies
from facetgrid.operators.detail import enrich
from facetgrid.operators.html_detail import extract_details
from facetgrid.plans.convert import convert, document, search_fields
from facetgrid.plans.engine import Engine, Filters
from facetgrid.sources import ingest, sample, sinks
from facetgrid.sources.index_codec import IndexFormatError, decode_index, encode_index


def raw(spark, rows, envelope=True):
    body = json.dumps({ingest.ENVELOPE: rows} if envelope else rows, ensure_ascii=False)
    return ingest.raw_courses(ingest.parse_documents(spark.createDataFrame([(0, body)], "file_ord int, text string")))


@pytest.fixture(scope="module")
def data(spark):
    return convert(raw(spark, ROWS))


@pytest.fixture(scope="module")
def engine(data):
    return Engine(data)


# --- reading ---


def test_lenient_records(spark):
    got = raw(spark, [{"kogiCd": 7, "kogiNm": True, "fukudai": None, "kochiNm": {"a": 1}, "more": 1}]).first()
    assert (got["kogiCd"], got["kogiNm"], got["fukudai"], got["kochiNm"], got["tantoKyoin"]) == ("7", "true", None, '{"a":1}', "")


def test_bad_records_are_warnings_and_bad_documents_errors(spark):
    frame = lambda text: spark.createDataFrame([(0, text)], "file_ord int, text string")
    parsed = ingest.parse_documents(frame('[{"kogiCd":"1"}, 17, "x", {"kogiCd":"2"}]'))
    assert ingest.raw_courses(parsed).count() == 2
    assert [r["warning"] for r in ingest.load_warnings(parsed).orderBy("item").collect()] == ["[item 2] skipped", "[item 3] skipped"]
    for text in ("", "  ", "{}", '{"selectKogiDtoList":null}', "nope"):
        with pytest.raises(Exception, match="empty|no list"):
            ingest.parse_documents(frame(text)).collect()


def test_files_in_byte_order(spark, tmp_path):
    for name, code in (("講義データ.json", "first"), ("講義データ-02.json", "second")):
        (tmp_path / name).write_text(json.dumps([{"kogiCd": "1", "kogiNm": code}]))
    rows, _ = ingest.read_course_folder(spark, str(tmp_path))
    assert convert(rows).courses.first()["nm"] == "second"
    assert ingest.list_files(spark, str(tmp_path / "none")) == []


def test_details_and_tombstones(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"cd":"1","lastUpdate":"u"}')
    assert ingest.read_details(spark, str(tmp_path)).first()["cd"] == "1"
    assert [tuple(r) for r in ingest.saved_updates(spark, str(tmp_path)).collect()] == [("1", "u")]
    (tmp_path / "b.json").write_text('{"cd":"1"}')
    with pytest.raises(ingest.DatasetError):
        ingest.read_details(spark, str(tmp_path))
    (tmp_path / "t.tsv").write_text("a\tu\t2\nbroken\n\tu\t1\nb\tv\tx\n")
    assert [tuple(r) for r in ingest.read_tombstones(spark, str(tmp_path / "t.tsv")).collect()] == [("a", "u", 2)]
    assert ingest.read_tombstones(spark, str(tmp_path / "none.tsv")).count() == 0


# --- slots, dictionaries, conversion ---


@pytest.mark.parametrize(
    ("timetable", "want"),
    [
        ("1学期: 月曜日１時限", [("1学期", "月", 1)]), ("1学期: 集中講義", ["no weekday or period"]), ("月曜日３時限", [("", "月", 3)]), ("1学期: 月１時限", ["no weekday"]),
        (", , ,", []), ("1学期: 月曜日７時限", [("1学期", "月", 7)]), ("1学期: 月曜日1時限", ["no period"]), ("1学期: 月曜日９時限", ["no period"]),
        ("a:b: 火曜日２時限", [("a", "火", 2)]), ("1学期: 水曜日１時限・木曜日２時限", [("1学期", "水", 1)]), ("", []),
    ],
)
def test_timetables(spark, timetable, want):
    got = spark.range(1).select(slots.parse_slots(F.lit(timetable)).alias("s")).first()["s"]
    assert [s["warning"] or (s["term"], s["day"], s["period"]) for s in got] == want


def test_dictionary_orders(spark):
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "v string")
    order = lambda df: [r["label"] for r in df.orderBy("idx").collect()]
    assert order(dictionaries.terms(frame(["x", "通年", "1学期前半", "1学期", "あ"]))) == ["1学期", "1学期前半", "通年", "x", "あ"]
    assert order(dictionaries.campuses(frame(["x", "その他", "物部キャンパス"]))) == ["物部キャンパス", "その他", "x"]
    assert order(dictionaries.catch_all_last(frame(["その他", "理", "x", "x"]))) == ["x", "理", "その他"]


def test_conversion_facts(spark, data):
    facts = data.facts.first()
    assert (data.courses.count(), facts["totalRaw"], facts["year"]) == (9, 10, "2026")
    labels = {k: [r["label"] for r in d.orderBy("idx").collect()] for k, d in data.dictionaries.items()}
    assert labels["semesters"] == ["1学期", "1学期前半", "2学期", "2学期前半", "通年"]
    assert labels["departments"] == ["人文社会科学部", "共通教育", "医学部 医学科", "理工学部", "農林海洋科学部", "その他"]
    assert labels["campuses"] == ["朝倉キャンパス", "物部キャンパス", "岡豊キャンパス", "その他"]
    assert labels["kubun"] == ["実技", "実習", "演習", "講義"]
    first = data.courses.where("cd = '001'").first()
    assert first["idx"] == 0 and [tuple(s) for s in first["slots"]] == [(0, 0, 1), (0, 2, 3)]
    assert data.courses.where("cd = '002'").first()["gaku"] == "政治学" and first["gaku"] is None


def test_document(data):
    text = document(data, "2026-01-01T00:00:00Z").first()["json"]
    assert len(text.encode()) == 2448 and not set("<>&  ") & set(text)
    doc = json.loads(text)
    assert doc["indices"]["semester"][0] == "LQEAAAAAAAA="
    assert list(doc) == ["version", "generatedAt", "year", "totalRaw", "dicts", "indices", "courses"]
    assert doc["courses"][1]["sub"] == "比較政治 & 国際関係" and "gakka" not in doc["courses"][1] and doc["courses"][4]["slots"] == []


def test_first_row_keeps_its_own_duplicates(spark):
    rows = [{"kogiCd": "1", "kogiNm": "a", "jikanwari": "1学期: 月曜日１時限, 1学期: 月曜日１時限"}, {"kogiCd": " 1 ", "kogiNm": "b", "kochiNm": "x", "jikanwari": "1学期: 月曜日１時限, 2学期: 火曜日２時限"}, {"kogiCd": "1", "jikanwari": "2学期: 火曜日２時限"}, {"kogiCd": " "}]
    d = convert(raw(spark, rows, envelope=False))
    assert [tuple(s) for s in d.courses.first()["slots"]] == [(0, 0, 1), (0, 0, 1), (1, 1, 2)]
    assert [r["label"] for r in d.dictionaries["campuses"].collect()] == ["その他"]
    assert any("empty; skipped" in r["warning"] for r in d.warnings.collect()) and d.facts.first()["totalRaw"] == 4


def test_slot_without_term_is_dropped_without_warning(spark):
    d = convert(raw(spark, [{"kogiCd": "1", "kogiNm": "a", "jikanwari": "月曜日３時限"}]))
    assert d.courses.first()["slots"] == [] and d.warnings.count() == 0


def test_indices_match_naive_sets(data):
    term_of = {r["idx"]: r["label"] for r in data.dictionaries["semesters"].collect()}
    got = {}
    for r in data.members.where("facet = 'semester'").collect():
        got.setdefault(term_of[r["value"]], set()).add(r["idx"])
    own = {}
    for r in data.slots.collect():
        own.setdefault(r["term"], set()).add(r["idx"])
    assert got == {t: own.get(t, set()) | own["通年"] for t in term_of.values()}


# --- bitmaps ---


def test_bitmaps_round_trip(spark):
    rows = spark.createDataFrame([(v, p) for v, ps in (("a", (0, 5, 63, 64, 40000)), ("b", (5, 40001))) for p in ps], "v string, p int")
    packed = bitmaps.bitmap_rows(rows, "v", "p")
    back = {(r["value"], r["position"]) for r in bitmaps.explode_positions(packed, "value").collect()}
    assert back == {("a", 0), ("a", 5), ("a", 63), ("a", 64), ("a", 40000), ("b", 5), ("b", 40001)}
    one = lambda v: packed.where(F.col("value") == v)
    assert bitmaps.count_bits(bitmaps.intersect(one("a"), one("b"))).first()["n"] == 1
    wire = bitmaps.inverted_index(rows.where("p < 100"), "v", "p", 70)
    got = {r["value"]: r["p"] for r in wire.select("value", bitmaps.positions(bitmaps.from_base64(F.col("wire"))).alias("p")).collect()}
    assert got == {"a": [0, 5, 63, 64], "b": [5]}
    short = spark.range(1).select(bitmaps.from_base64(F.lit("AQ==")).alias("b"), bitmaps.from_base64(F.lit("?")).alias("n")).first()
    assert bytes(short["b"]) == b"\1" + b"\0" * 7 and short["n"] is None


# --- engine ---


def test_filters(engine):
    n = lambda **k: engine.filter(Filters(**k)).count()
    assert [n(term=t) for t in ("1学期", "1学期前半", "2学期", "2学期前半", "通年")] == [5, 2, 3, 2, 1]
    assert [n(campus=c) for c in ("朝倉キャンパス", "物部キャンパス", "岡豊キャンパス", "その他")] == [5, 2, 1, 1]
    assert [n(query=q) for q in ("微分", "英語", "プログラミング", "海洋", "通年", "001")] == [1, 1, 1, 2, 0, 1]
    assert n() == 9 and n(term="none") == 0 and n(query=" ") == 9 and n(query=".") == 0


def test_grids(spark, engine):
    want = {"all": (7, 8), "1学期": (4, 5), "1学期前半": (2, 2), "2学期": (3, 3), "2学期前半": (2, 2), "通年": (1, 1)}
    for term, (unique, cells) in want.items():
        found = engine.query(term=term)
        assert (found.count.first()["n"], found.cells.count()) == (unique, cells)
    assert engine.has_saturday().first()[0]
    some = spark.createDataFrame([(0,), (2,)], "idx int")
    assert engine.grid(some, "unknown").count() == 3
    assert engine.filter_and_grid(days=5).cells.count() == 30


def test_ranked_search(spark, data):
    e = Engine(data)
    e.load_index(search.build_index(search_fields(data.courses), "idx", {f: F.col(f) for f in search.FIELDS}))
    hits = e.search(Filters(query="学")).orderBy(F.desc("score"), "idx").collect()
    assert [h["idx"] for h in hits[:3]] == [0, 6, 1] and hits[0]["score"] == 5.0
    assert e.search(Filters()).where("score = 0 and size(spans) = 0").count() == 9
    assert e.search(Filters(query="通年")).count() == 0
    names = search.name_spans(e.search(Filters(query="微分"))).first()["name_spans"]
    assert [tuple(s) for s in names] == [(0, 0, 2)]


def test_spans_are_utf16(spark):
    docs = spark.createDataFrame([(0, "𠮷学x学", "", "", "ＡＢ１２", ""), (1, "aaaa", "", "", "", "aa")], "idx int, name string, subtitle string, instructor string, code string, keywords string")
    index = search.build_index(docs, "idx", {f: F.col(f) for f in search.FIELDS})
    spans = lambda q, k: [tuple(s) for s in search.ranked(index, q).where(F.col("idx") == k).first()["spans"]]
    assert spans("学", 0) == [(0, 2, 1), (0, 4, 1)] and spans("ab12", 0) == [(3, 0, 4)] and spans("aa", 1) == [(0, 0, 2), (0, 2, 2), (4, 0, 2)]
    assert search.ranked(index, "aa").where("idx = 1").first()["score"] == 7.0
    assert search.ranked(index, "").count() == 0 and search.ranked(index, "学.").count() == 0


def test_plan_summary(spark):
    rows = [{"kogiCd": c, "kogiNm": c, "jikanwari": j} for c, j in (("a", "1学期: 月曜日１時限"), ("b", "通年: 月曜日１時限"), ("c", "2学期: 月曜日１時限"), ("d", "1学期: 日曜日１時限"))]
    e = Engine(convert(raw(spark, rows)))
    plan = e.resolve(spark.createDataFrame([("b",), ("a",), ("x",), ("a",), ("c",)], "cd string"))
    assert [r["idx"] for r in plan.collect()] == [0, 1, 2]
    clashes, credits = e.plan_summary(plan)
    assert sorted((r["day"], r["period"], tuple(r["courses"]), r["term"]) for r in clashes.collect()) == [(0, 1, (0, 1), "1学期"), (0, 1, (1, 2), "2学期")]
    assert credits.where("axis = 'total'").first()["count"] == 3
    only, _ = e.plan_summary(spark.createDataFrame([(1,)], "idx int"))
    assert only.count() == 0


def test_overlay_and_densify(spark):
    rows = spark.createDataFrame([(0, "t", 0, 1), (1, "t", 0, 1), (1, "t", 5, 6), (2, "t", 6, 1), (2, "t", 0, 7)], "idx int, term string, day int, period int")
    cells = grid.build_grid(rows)
    assert {(r["day"], r["period"]): r["courses"] for r in cells.collect()} == {(0, 1): [0, 1], (5, 6): [1]}
    assert grid.densify(cells, 5).where("size(courses) > 0").count() == 1
    shown = grid.overlay(cells, grid.build_grid(rows.where("idx = 0"))).where("planned").first()
    assert shown["courses"] == [0]


def test_whole_cells(spark):
    import random

    pool = random.Random(3).sample(range(3000), 3000)
    rows = spark.createDataFrame([(i, "t", i % 3 // 2, 1, pool[i] // 7) for i in range(3000)], "idx int, term string, day int, period int, score int").repartition(5)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("7", "false")):
        spark.conf.set(name, value)
    try:
        got = {r["day"]: r["courses"] for r in grid.whole_cells(grid.placed(rows, rank="score")).collect()}
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    assert got == {d: sorted((i for i in range(3000) if i % 3 // 2 == d), key=lambda i: (pool[i] // 7, i)) for d in (0, 1)}


def test_ranked_cells_are_whole(spark, tmp_path):
    from facetgrid import catalogue
    from facetgrid.queries import ORACLE

    named = "case when id % 8 < 4 then 'r' else 'rare r' end as p_name"
    spark.range(300).selectExpr("id as p_partkey", named, "'Brand#11' as p_brand", "'TIN' as p_type", "1 as p_size", "1.0D as p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    got = catalogue.engine_ranked(spark, str(tmp_path)).collect()
    assert [(r["day"], r["period"]) for r in got] == [(0, 1)]
    ids = [int(x) for x in got[0]["ids"].split(",")]
    assert len(ids) > 2 * catalogue.PAGE and sorted(ids) == list(range(len(ids)))
    duckdb = pytest.importorskip("duckdb").connect()
    duckdb.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert duckdb.sql(ORACLE["engine_ranked"]).fetchall() == [tuple(r) for r in got]


# --- tallies ---


def test_shares_and_top(spark):
    rows = spark.createDataFrame([("a", 0, "x", 40), ("a", 1, "y", 30), ("a", 2, "y", 10), ("b", 0, "x", None), ("b", 1, "y", None), ("b", 2, "z", None)], "g string, k int, t string, w int")
    segments = tallies.shares(rows, "g", "w")
    assert [r["pct"] for r in segments.orderBy("g", "k").collect()] == [50, 38, 13, 33, 33, 33]
    top = {r["g"]: (r["t"], r["pct"], r["tie"]) for r in tallies.top_type(tallies.by_type(segments, "g", "t", "k"), "g", "t").collect()}
    assert top == {"a": ("y", 51, False), "b": ("x", 33, True)}
    offsets = [r["offset"] for r in tallies.arcs(segments.where("g = 'a'"), "g", 1 / (2 * 3.141592653589793), "k").orderBy("k").collect()]
    assert offsets == pytest.approx([0, -0.5, -0.88])


def test_credit_axes(spark):
    rows = spark.createDataFrame([("k", "b", None, 2.0), ("k", None, "1", None), ("", "b", "1", 0.5)], "kubun string, bunrui string, nen string, credit double")
    got = {(r["axis"], r["key"]): (r["credits"], r["count"]) for r in tallies.credit_axes(rows).collect()}
    assert got == {("kubun", "k"): (2.0, 2), ("kubun", ""): (0.5, 1), ("bunrui", "b"): (2.5, 2), ("nen", "1"): (0.5, 2), ("total", ""): (2.5, 3)}


# --- bookkeeping ---


def test_selection_and_tombstones(spark):
    wanted = spark.createDataFrame([("a", "1", 0), ("b", "1", 1), ("c", "", 2), ("d", "2", 3)], "cd string, last_update string, ord int")
    saved = spark.createDataFrame([("a", "1"), ("b", "0"), ("c", "")], "cd string, last_update string")
    dead = spark.createDataFrame([("d", "2", 2), ("b", "1", 1)], "cd string, last_update string, fails int")
    pick = lambda **k: [r["cd"] for r in incremental.select_stale(wanted, saved, dead, **k).orderBy("ord").collect()]
    assert pick() == ["b", "c"] and pick(force=True) == ["a", "b", "c", "d"] and pick(limit=1) == ["b"]
    assert pick(only=spark.createDataFrame([("c",), ("x",)], "cd string")) == ["c"]
    failed = spark.createDataFrame([("d", "2"), ("b", "9"), ("n", "1")], "cd string, last_update string")
    merged = incremental.merge_tombstones(dead, failed, spark.createDataFrame([("n",)], "cd string"))
    assert sorted(tuple(r) for r in merged.collect()) == [("b", "9", 1), ("d", "2", 3)]


def test_breaker_and_reasons(spark):
    rows = spark.createDataFrame([("a", k, b) for k, b in enumerate((1, 1, 0, 1, 1, 1, 1))] + [("b", 0, 1)], "g string, k int, b int")
    assert [tuple(r) for r in incremental.breaker(rows, "g", "k", F.col("b") == 1).collect()] == [("a", 5)]
    reasons = spark.createDataFrame([("fatal: no guid: x", ""), ("save failed: y", ""), ("HTTP 403", "Not Found"), ("HTTP 403", ""), ("z", "")], "reason string, diagnostics string")
    tally = incremental.failure_tally(reasons)
    assert {r["reason"]: r["n"] for r in tally.collect()} == {"no guid": 1, "save failed": 1, "HTTP 403": 2, "z": 1}
    assert incremental.top_reasons(tally).first()["summary"] == "2× HTTP 403, 1× no guid, 1× save failed, +1 more"
    assert incremental.verdict(reasons).first()["hint"] == "the interface may have changed"


def test_responses(spark):
    rows = spark.createDataFrame([(200, '{"guid":"g"}', None), (200, '{"errorMsg":"m"}', None), (200, "x", None), (200, "{}", None), (429, "", "30"), (503, "", "soon")], "s int, b string, r string")
    got = [tuple(r["o"]) for r in rows.select(incremental.classify_response(F.col("s"), F.col("b"), F.col("r")).alias("o")).collect()]
    assert got == [("ok", "g"), ("fatal", "m"), ("fatal", "not JSON"), ("fatal", "no guid"), ("http", "HTTP 429 30"), ("http", "HTTP 503")]
    seconds = [r["s"] for r in spark.range(8).select(incremental.backoff_seconds(F.lit(1.0), F.col("id")).alias("s")).collect()]
    assert seconds == [1, 2, 4, 8, 16, 32, 60, 60]


def test_changes_and_pages(spark):
    diff = spark.createDataFrame([("A\tx",), ("D\ty",), ("R100\ta\tb",), ("M\tz",), ("",)], "line string")
    assert sorted(tuple(r) for r in incremental.change_set(diff).collect()) == [("a", "delete"), ("b", "add"), ("x", "add"), ("y", "delete"), ("z", "add")]
    pages = lambda rows: spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "name string, content binary")
    got = {r["name"]: (r["changed"], r["stale"]) for r in incremental.page_changes(pages([("a", b"1"), ("b", b"2")]), pages([("a", b"1"), ("b", b"3"), ("c", b"4")])).collect()}
    assert got == {"a": (False, False), "b": (True, False), "c": (False, True)}
    listed = spark.createDataFrame([(1, 1, 3, 5), (2, 2, 3, 4), (3, 9, 3, 1)], "page int, echoed int, max_page int, rows int")
    assert sorted(tuple(r) for r in incremental.page_violations(listed, 5).collect()) == [(2, "page not full"), (3, "page number")]
    names = [r["n"] for r in spark.range(1, 3).select(incremental.page_name(F.col("id"), "講義データ").alias("n")).collect()]
    assert names == ["講義データ.json", "講義データ-02.json"]


# --- details, writers, generator ---


def test_detail_page(spark):
    page = '<table><tr><th>単位数<td>2.0<tr><th>キーワード</th><td>微分、積分（極限、連続）　確率</td></tr><tr><th>授業実施方法</th><td><table class="selectGroupTable"><tr><td>対面 オンライン</td></tr></table></td></tr><tr><th>年度</th><td>2026</td></tr><tr><th>備考</th><td>x<br>y</td></tr></table><table class="is-hidden-tablet"><tr><th>単位数</th><td>9</td></tr></table><table class="tbl_status_jugyo"><tr><th>第１回</th><td>授業概要 ガイダンス</td></tr></table><table><tr><th>評価</th><th>比重</th></tr><tr><th>期末試験</th><td>６０点</td></tr></table>'
    pages = spark.createDataFrame([("1", page), ("2", None), ("3", "<table><tr><th>メディア授業科目</th><td>該当</td>"), ("4", "<<table <td")], "cd string, html string")
    got = {r["cd"]: r for r in extract_details(pages).collect()}
    one = got["1"]
    assert (one["unit"], one["keywords"], one["delivery"]["mode"]) == ("2.0", ["微分", "積分（極限、連続）", "確率"], "hybrid")
    assert [tuple(e) for e in one["extra"]] == [("備考", "x\ny")] and [(p["n"], p["text"]) for p in one["plan"]] == [(1, "ガイダンス")]
    assert [tuple(r) for r in one["eval"]["rows"]] == [("期末試験", 60, "exam")]
    assert (got["3"]["delivery"]["mode"], got["3"]["delivery"]["isMedia"]) == ("", True) and got["2"]["unit"] is None and got["4"]["extra"] == []


def test_enrich_and_cards(spark, tmp_path):
    details = sample.details(spark, 40)
    full = details.select("*", *[F.lit(None).cast("string").alias(c) for c in ("summary", "aims", "prereq", "prep", "textbooks")], F.lit(None).cast("array<struct<label:string,text:string>>").alias("extra"))
    rich = enrich(full)
    first = rich.orderBy("cd").first()
    assert [r["type"] for r in first["eval"]["rows"]] == ["exam", "report"] and first["plan"][0]["kind"] == "start" and first["plan"][-1]["kind"] == "milestone"
    assert rich.count() == 28
    d = convert(sample.courses(spark, 40))
    sinks.write_dataset(d, str(tmp_path / "data.json"), "now", rich)
    back = ingest.read_dataset(spark, str(tmp_path / "data.json")).first()
    assert back["version"] == 3 and len(back["courses"]) == 40 and back["courses"][0]["ev"] == ["exam:50", "report:50"] and back["courses"][4]["dm"] is None
    (tmp_path / "raw.json").write_text("[]")
    with pytest.raises(ingest.RawDocument):
        ingest.read_dataset(spark, str(tmp_path / "raw.json"))
    (tmp_path / "old.json").write_text('{"version":2}')
    with pytest.raises(ingest.UnsupportedVersion):
        ingest.read_dataset(spark, str(tmp_path / "old.json"))
    sinks.write_index(d, str(tmp_path / "search.idx"), rich, binary=True)
    assert len(decode_index((tmp_path / "search.idx").read_bytes())) == 40
    state = spark.createDataFrame([("b", "u", 1), ("a", "v", 2)], "cd string, last_update string, fails int")
    sinks.write_tombstones(state, str(tmp_path / "t.tsv"))
    assert (tmp_path / "t.tsv").read_text() == "a\tv\t2\nb\tu\t1\n"
    sinks.write_tombstones(state.limit(0), str(tmp_path / "t.tsv"))
    assert not (tmp_path / "t.tsv").exists()


def test_index_codec():
    docs = [("a", "", "é", "1", "x y"), ("𠮷", "b", "", "", "")]
    data = encode_index(docs)
    assert decode_index(data + b"more") == docs and decode_index(encode_index([])) == []
    for bad in (b"", b"XXXX" + data[4:], data[:-1], data[:4] + b"\2\0" + data[6:]):
        with pytest.raises(IndexFormatError):
            decode_index(bad)


def test_paged_source(spark, tmp_path):
    from facetgrid.sources.paged import PagedSource

    spark.dataSource.register(PagedSource)
    page = lambda n, rows: json.dumps({"pageNo": n, "maxPageNo": 2, "total": 3, "rows": rows})
    (tmp_path / "page.json").write_text(page(1, [{"a": 1}, {"a": 2}]))
    (tmp_path / "page-02.json").write_text(page(2, [{"a": 3}]))
    rows = spark.read.format("pages").load(str(tmp_path))
    assert [(r["page"], r["item"], r["record"]) for r in rows.orderBy("page", "item").collect()] == [(1, 0, '{"a": 1}'), (1, 1, '{"a": 2}'), (2, 0, '{"a": 3}')]
    (tmp_path / "page-02.json").write_text(page(3, []))
    with pytest.raises(Exception, match="contradicts"):
        spark.read.format("pages").load(str(tmp_path)).collect()


def test_streaming_first_wins(spark, tmp_path):
    from facetgrid.streaming.first_wins import start_first_wins

    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    run = lambda: start_first_wins(spark, str(source), str(target), str(tmp_path / "ck"), "kogiCd string, kogiNm string").awaitTermination()
    (source / "a.json").write_text('{"kogiCd":"1","kogiNm":"x"}\n{"kogiCd":"1","kogiNm":"y"}\n{"kogiCd":"2","kogiNm":"z"}\n')
    run()
    (source / "b.json").write_text('{"kogiCd":"1","kogiNm":"late"}\n{"kogiCd":"3","kogiNm":"w"}\n')
    run()
    got = {r["kogiCd"]: r["kogiNm"] for r in spark.read.parquet(str(target)).collect()}
    assert got == {"1": "x", "2": "z", "3": "w"}


def test_detail_pages_never_fail(spark):
    """Cut, nested and stray markup gives a record, however little it says."""
    odd = ["", None, "<table", "<table><tr><th>単位数", "<table><tr><td><table><tr><th>単位数</th><td>9</td></tr></table></td></tr></table>", "</td></tr><table><tr><th>単位数<td>2単位<tr><th>備考<td>x", "<table><tr><th>単位数</th><td>1</td></tr></table>" * 2, "<div>" * 3000 + "<table><tr><th>単位数</th><td>3"]
    rows = spark.createDataFrame(list(enumerate(odd)), "cd int, html string")
    got = {r["cd"]: r for r in extract_details(rows).collect()}
    assert [got[str(k)]["unit"] for k in range(8)] == [None, None, None, None, "9", "2単位", "1", "3"]
    assert [(x["label"], x["text"]) for x in got["5"]["extra"]] == [("備考", "x")]


def test_rules_at_size(spark):
    """Long fields take time in proportion to their length."""
    lines = "\n".join(f"・{k}、x（{k}、y）" if k % 3 else f"教科書：{k}" for k in range(6000))
    df = spark.createDataFrame([(lines,)], "t string")
    split = df.select(F.size(rules.split_keywords("t")).alias("n")).first()["n"]
    books = df.select(F.size(rules.textbook_info("t")["sections"]).alias("n")).first()["n"]
    blocks = df.select(F.size(present.prose_blocks("t")).alias("n")).first()["n"]
    assert (split, books, blocks) == (10_000, 2000, 4000)
    assert [r["kind"] for r in present.prose_runs(df.withColumn("k", F.lit(1)), "k", "t").where("at < 4").orderBy("at").collect()] == ["paragraph", "list", "list", "paragraph"]


def test_numbering_by_blocks(spark, monkeypatch):
    from facetgrid.plans import convert

    monkeypatch.setattr(convert, "BLOCK", 3)
    rows = [(f, k, f * 100 + k) for f in (2, 0, 5) for k in range(0, 11, 1 + f)]
    first = spark.createDataFrame(rows, "file_ord int, item int, ord long")
    got = [(r["file_ord"], r["item"]) for r in convert.dense_index(first).orderBy("idx").collect()]
    assert got == sorted((f, k) for f, k, _ in rows)
    assert [r["idx"] for r in convert.dense_index(first).orderBy("idx").collect()] == list(range(len(rows)))


def test_clash_set_and_shape(spark):
    from facetgrid.operators import grid

    found = spark.createDataFrame([(0, 1, 5), (0, 1, 6), (1, 1, 7)], "day int, period int, idx int")
    plan = spark.createDataFrame([(0, 1, 6)], "day int, period int, idx int")
    assert [r["idx"] for r in grid.clash_set(found, plan).collect()] == [5]
    assert grid.day_count(True) == 6 and grid.day_count(False) == 5
