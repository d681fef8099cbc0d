"""Gram index, containers, document parts, lookups and named files."""

import base64
import hashlib
import os
import random

import pytest
from fixture_courses import ROWS
from pyspark.sql import functions as F
from test_catalogue import raw

from facetgrid.operators import bitmaps, containers, gram_index, search
from facetgrid.plans.convert import convert, document, document_parts, search_fields, wire_bitmaps
from facetgrid.plans.engine import Engine, Filters
from facetgrid.sources import index_codec, ingest, lookup, named_files, sinks, upsert

#: Fixed value: the digest of the document of the ten rows, byte for byte.
GOLDEN = "a1fd09fcd8dd5ecb615d546e69cdb4d2561507999d3b3a81a4e24d34261eefb1"


@pytest.fixture(scope="module")
def data(spark):
    return convert(raw(spark, ROWS))


# --- gram index ---

TEXTS = [(1, "ababab", "xyz"), (2, "", None), (3, "𠮷野家の𠮷", "𠮷"), (4, "ＡＢ c", "ab ab"), (5, "a", "b"), (6, "aaaaaaa", "aa"), (7, "x\x00y", "\x00"), (8, "the cat", "The Cat the")]


def spans_of(df):
    return sorted((r["k"], round(r["score"], 3), [tuple(s) for s in r["spans"]]) for r in df.collect())


def test_postings_find_what_a_scan_finds(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "k long, a string, b string")
    fields = {"name": F.col("a"), "keywords": F.col("b")}
    index = gram_index.write(df, str(tmp_path / "x"), "k", fields, parts=4, tasks=3)
    scan = search.build_index(df, "k", fields)
    for q in ("a", "ab", "aba", "abab", "aaa", "𠮷", "の𠮷", "家", "AB", "ab c", "the cat", "zz", "", "\x00", "x\x00", "x\x00y", "c"):
        assert spans_of(index.ranked(spark, q)) == spans_of(search.ranked(scan, q, "k")), q
    assert sorted(r["k"] for r in index.containing(spark, "ab").collect()) == [1, 4]


def test_slices_of_long_texts_lose_no_gram(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab𠮷 ") for _ in range(n)) for n in (0, 1, 2, 3, 9, 50)]

    def grams(cut):
        monkeypatch.setattr(gram_index, "SLICE", cut)
        out = {}
        for rows, parts, starts, ends in gram_index._slices(texts):
            for size in (2, 3):
                of, names, bounds, places = gram_index._grams(parts, starts, ends, size)
                for k, (t, g) in enumerate(zip(of, names, strict=True)):
                    out.setdefault((rows[t], size, str(g)), []).extend(places[bounds[k] : bounds[k + 1]].tolist())
        return out

    whole = grams(1 << 20)
    for cut in (1, 2, 5, 7):
        assert grams(cut) == whole
    want = {}
    for row, text in enumerate(texts):
        for size in (2, 3):
            for i in range(len(text) - (size - 1 if size == 3 else 0)):
                want.setdefault((row, size, text[i : i + size]), []).append(len(text[:i].encode("utf-16-le")) // 2)
    assert whole == want


def test_a_query_reads_its_own_grams(spark, tmp_path, capsys):
    df = spark.createDataFrame([(k, f"text number {k} of many") for k in range(50)], "k long, t string")
    index = gram_index.write(df, str(tmp_path / "x"), "k", {"name": F.col("t")})
    index.containing(spark, "number").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert "PushedFilters" in plan and "gram" in plan.split("PushedFilters", 1)[1].split("\n", 1)[0] and "Location" in plan
    assert index.counts(spark, 3, ["num", "ber", "qqq"]) == {"num": (50, 50), "ber": (50, 50)}
    files = []
    for df in (index.of(spark, "postings", 3, ["num"]), index.read(spark, "postings")):
        df.collect()
        files.append(df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value())
    assert files[0] <= 2 < 50 < files[1]


def test_engine_over_postings(spark, data, tmp_path):
    fields = search_fields(data.courses)
    by_text, by_grams = Engine(data), Engine(data)
    by_text.load_index(search.build_index(fields, "idx", {f: F.col(f) for f in search.FIELDS}))
    by_grams.load_grams(gram_index.write(fields, str(tmp_path / "x"), "idx", {f: F.col(f) for f in search.FIELDS}))
    hits = lambda e, f: sorted((r["idx"], round(r["score"], 3), [tuple(s) for s in r["spans"]]) for r in e.search(f).collect())
    for f in (Filters(query="学"), Filters(query="Smith"), Filters(department="理工学部", query="学"), Filters(query="ない")):
        assert hits(by_grams, f) == hits(by_text, f)


# --- containers ---


def test_a_hundred_thousand_positions(spark):
    n = 100_000
    sets = {"all": range(n), "third": range(0, n, 3), "few": [5, 40_000, n - 1], "run": range(70_000, 90_000), "some": sorted(random.Random(1).sample(range(n), 900))}
    rows = [(v, p) for v, ps in sets.items() for p in ps]
    df = spark.createDataFrame(rows, "value string, idx long")
    wires = containers.wire(bitmaps.bitmap_rows(df, "value", "idx"), n, "value")
    got = {r["value"]: r["wire"] for r in wires.collect()}
    for v, ps in sets.items():
        bits = bytearray(8 * -(-n // 64))
        for p in ps:
            bits[p // 8] |= 1 << p % 8
        assert got[v] == base64.b64encode(bits).decode()
    assert sorted(map(tuple, containers.from_wire(wires, "value").collect())) == sorted(rows)
    packed = containers.build(df, "value", "idx").cache()
    assert sorted(map(tuple, containers.unpack(packed, "value").collect())) == sorted(rows)
    kinds = {(r["value"], r["kind"]) for r in packed.collect()}
    assert {("all", "runs"), ("third", "bits"), ("few", "array"), ("run", "runs"), ("some", "array")} <= kinds
    assert max(len(r["data"]) for r in packed.collect()) <= bitmaps.BUCKET // 8
    two = containers.merge(packed.where("value = 'few'"), packed.where("value in ('few', 'run')"))
    assert sorted(map(tuple, containers.unpack(two, "value").collect())) == sorted(r for r in rows if r[0] in ("few", "run"))
    other = containers.build(df.where("idx % 2 = 0"), "value", "idx")
    assert containers.common(packed, other).count() == sum(p % 2 == 0 for _, p in rows)


def test_catalogue_bitmaps_above_one_bucket(spark):
    n = 70_000
    members = spark.range(n).select(F.lit("department").alias("facet"), (F.col("id") % 2).cast("int").alias("value"), F.col("id").cast("int").alias("idx"))
    wires = {r["value"]: base64.b64decode(r["wire"]) for r in wire_bitmaps(members, n).collect()}
    assert len(wires) == 2 and all(len(w) == 8 * -(-n // 64) for w in wires.values())
    assert wires[0][: n // 8] == b"\x55" * (n // 8) and wires[1][: n // 8] == b"\xaa" * (n // 8)


# --- documents in parts ---


def test_document_is_the_golden_one(data, tmp_path):
    text = document(data, "2026-01-01T00:00:00Z").first()["json"].encode()
    assert hashlib.sha256(text).hexdigest() == GOLDEN
    sinks.write_dataset(data, str(tmp_path / "data.json"), "2026-01-01T00:00:00Z")
    assert (tmp_path / "data.json").read_bytes() == text and sorted(os.listdir(tmp_path)) == [".data.json.crc", "data.json"]


def test_parts_follow_each_other(spark, data, tmp_path):
    parts = document_parts(data, "2026-01-01T00:00:00Z", part_rows=2)
    assert [r["part"] for r in parts.orderBy("part").collect()] == [0, 1, 2, 3, 4, 5, 6]
    folder = str(tmp_path / "parts")
    sinks.write_parts(parts.select("part", F.encode("text", "UTF-8").alias("content")), folder)
    whole = b"".join((tmp_path / "parts" / r["name"]).read_bytes() for r in sinks.read_manifest(spark, folder).orderBy("part").collect())
    assert hashlib.sha256(whole).hexdigest() == GOLDEN
    for r in sinks.read_manifest(spark, folder).collect():
        content = (tmp_path / "parts" / r["name"]).read_bytes()
        assert (len(content), hashlib.sha256(content).hexdigest()) == (r["bytes"], r["sha256"])


def test_index_parts(spark, tmp_path, monkeypatch):
    rows = [(k, f"name {k}", "é" * (k % 3), "", str(k), "x") for k in range(25)]
    index = spark.createDataFrame(rows, "idx long, name string, subtitle string, instructor string, code string, keywords string").repartition(3)
    folder = str(tmp_path / "parts")
    sinks.write_parts(sinks.index_parts(index), folder)
    assert sorted(map(tuple, index_codec.read_index_parts(spark, folder).collect())) == rows
    sinks.join_parts(spark, folder, str(tmp_path / "search.idx"))
    assert (tmp_path / "search.idx").read_bytes() == index_codec.encode_index([r[1:] for r in rows])
    with pytest.raises(index_codec.IndexFormatError):
        named_files.write_files(spark.createDataFrame([("part-" + "0" * 18, b"XXXX")], "name string, content binary"), str(tmp_path / "bad"))
        index_codec.read_index_parts(spark, str(tmp_path / "bad"))


# --- lookups ---


def test_lookup_opens_files_that_may_have_the_key(spark, tmp_path):
    records = spark.range(2000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("cd"), "id").unionByName(spark.createDataFrame([(None, -1)], "cd string, id long"))
    store = lookup.write(records, str(tmp_path / "x"), "cd", 8)
    ask = lambda *keys: store.find(spark.createDataFrame([(k,) for k in keys], "cd string"))
    assert sorted(r["id"] for r in ask("k000007", "k001999", "k000007", None, "nowhere").collect()) == [7, 1999]
    opened = [f for f in ask("k000007").inputFiles() if "/records/" in f]
    assert len(opened) == 1 and ask("zzz", "a").inputFiles() == [] and ask("zzz").collect() == []
    absent = spark.range(2000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("x")).alias("cd"))
    assert store.may_have(absent).count() <= 10  # within the ranges, kept out by the filters
    none = lookup.write(records.limit(0), str(tmp_path / "none"), "cd", 2)
    assert none.find(absent).collect() == []


# --- files ---


def files_of(path):
    return {os.path.relpath(os.path.join(at, f), path): open(os.path.join(at, f), "rb").read() for at, _, names in os.walk(path) for f in names}


def test_named_files(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"a/{k}", str(k).encode()) for k in range(20)], "name string, content binary").repartition(4)
    named_files.write_files(rows, folder)
    assert files_of(folder) == {f"a/{k}": str(k).encode() for k in range(20)}
    before = os.stat(f"{folder}/a/3").st_mtime_ns
    more = spark.createDataFrame([("a/3", b"3"), ("a/4", b"new"), ("b", None)], "name string, content binary")
    named_files.write_files(more, folder)
    assert os.stat(f"{folder}/a/3").st_mtime_ns == before and files_of(folder)["a/4"] == b"new" and files_of(folder)["b"] == b""
    named_files.write_files(more, folder, overwrite=True, keep="a/1*")
    assert set(files_of(folder)) == {"a/3", "a/4", "b", "a/1", *[f"a/{k}" for k in range(10, 20)]}


@pytest.mark.parametrize("bad", [("../x", b"1"), ("/x", b"1"), (None, b"1"), ("a//b", b"1"), ("ok", b"2")])
def test_a_failed_write_leaves_no_file(spark, tmp_path, bad):
    folder = str(tmp_path / "out")
    named_files.write_files(spark.createDataFrame([("old", b"o")], "name string, content binary"), folder)
    rows = spark.createDataFrame([("ok", b"1"), ("fine", b"1"), bad], "name string, content binary").repartition(3)
    with pytest.raises(Exception, match="no name for a file|two rows for ok"):
        named_files.write_files(rows, folder, overwrite=True)
    assert files_of(folder) == {"old": b"o"} and os.listdir(tmp_path) == ["out"]


def test_an_attempt_that_failed_leaves_nothing(tmp_path):
    import pyarrow as pa

    writer = named_files.Writer(str(tmp_path), False, None)
    batch = pa.RecordBatch.from_arrays([pa.array(["x", "y"]), pa.array([b"1", b"2"])], names=["name", "content"])
    first = writer.write(iter([batch]))
    assert first.names == ["x", "y"] and not (tmp_path / "x").exists()
    writer.commit([first, None])
    assert files_of(tmp_path) == {"x": b"1", "y": b"2"}
    again = named_files.Writer(str(tmp_path), False, None)
    again.write(iter([batch.slice(0, 1)]))
    again.abort([None])
    assert files_of(tmp_path) == {"x": b"1", "y": b"2"}


def test_details_are_files_of_their_codes(spark, tmp_path):
    details = spark.createDataFrame([("1", "u", None), ("2", None, "s\n<")], "cd string, lastUpdate string, summary string")
    sinks.write_details(details, str(tmp_path))
    assert files_of(tmp_path) == {"1.json": b'{"cd":"1","lastUpdate":"u"}', "2.json": b'{"cd":"2","summary":"s\\n<"}'}
    read = ingest.read_details(spark, str(tmp_path))
    assert sorted((r["cd"], r["summary"]) for r in read.collect()) == [("1", None), ("2", "s\n<")]
    (tmp_path / "3.json").write_text('{"cd":"2"}')
    with pytest.raises(ingest.DatasetError):
        ingest.read_details(spark, str(tmp_path))
    (tmp_path / "4.json").write_text("{broken")
    assert ingest.saved_updates(spark, str(tmp_path)).where("cd = '1'").first()["last_update"] == "u"
    assert ingest.saved_updates(spark, str(tmp_path / "none")).count() == 0 and ingest.read_details(spark, str(tmp_path / "none")).count() == 0


# --- state by batches ---


def test_either_split_gives_one_state(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(40), k, f"t{k}") for k in range(200)]
    first = lambda both: both.groupBy("k").agg(F.min_by(F.struct("at", "t"), "at").alias("r")).select("k", "r.*")
    want = {}
    for k, at, t in rows:
        want.setdefault(k, (k, at, t))
    for n, cuts in enumerate(([0, 200], [0, 30, 200], [0, 150, 160, 200])):
        for back in (False, True):
            state = upsert.BucketedState(str(tmp_path / f"{n}{back}"), "k", "k long, at long, t string", count=7)
            assert state.version(spark) == 0 and state.read(spark).collect() == []
            parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            for part in reversed(parts) if back else parts:
                state.upsert(spark.createDataFrame(part, "k long, at long, t string"), first)
            assert sorted(map(tuple, state.read(spark).collect())) == sorted(want.values()) and state.version(spark) == len(parts)


def test_only_touched_buckets_are_written(spark, tmp_path):
    state = upsert.BucketedState(str(tmp_path), "k", "k long, v string", count=16)
    latest = lambda both: both.groupBy("k").agg(F.max("v").alias("v")).where("v <> 'gone'")
    state.upsert(spark.createDataFrame([(k, "a") for k in range(50)], "k long, v string"), latest)
    before = state.folders(spark)
    one = spark.createDataFrame([(3, "b")], "k long, v string")
    touched = state.upsert(one, latest)
    after = state.folders(spark)
    assert len(touched) == 1 and {b for b in after if after[b] != before[b]} == set(touched)
    assert state.read(spark).where("k = 3").first()["v"] == "b" and state.read(spark).count() == 50
    assert state.upsert(one.limit(0), latest) == [] and state.version(spark) == 2
    # A version without a complete manifest does not count, and is written again.
    os.makedirs(tmp_path / "manifest" / "00000003")
    assert state.version(spark) == 2
    state.upsert(spark.createDataFrame([(3, "gone")], "k long, v string"), latest)
    assert state.version(spark) == 3 and state.read(spark).where("k = 3").count() == 0 and state.read(spark).count() == 49


# --- size of postings ---


def test_postings_take_less_than_the_text_twice_and_no_shuffle(spark, tmp_path, capsys):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(2000)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    gram_index.postings(df, "k", {"name": F.col("t")}).explain()
    assert "Exchange" not in capsys.readouterr().out
    index = gram_index.write(df, str(tmp_path / "x"), "k", {"name": F.col("t")}, parts=4)
    size = sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(tmp_path / "x") for f in names if f.endswith(".parquet"))
    assert size < 2 * sum(map(len, texts))
    for q in (words[0], words[1][:2], f"{words[2]} {words[3]}"[:7]):
        assert {r["k"]: r["score"] for r in index.ranked(spark, q, {"name": 1}).collect()} == {k: t.count(q) for k, t in enumerate(texts) if q in t}


def test_texts_cut_into_several_blocks(monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab𠮷 ") for _ in range(n)) for n in (0, 1, 2, 3, 9, 50, 200)]
    for cut in (1, 2, 5, 64):
        monkeypatch.setattr(gram_index, "SLICE", cut)
        found = blocks_of(texts)
        for q in ("a", "ab", "b𠮷", "ab𠮷", "a b ", "𠮷𠮷a b", "aab abba", "   "):
            want = {(k, utf16(t[:i])) for k, t in enumerate(texts) for i in range(len(t)) if t[i : i + len(q)] == q}
            assert occurrences(found, q) == want, (cut, q)


def utf16(text):
    return len(text.encode("utf-16-le")) // 2


def blocks_of(texts):
    """Rows of each block, as ``postings`` makes them."""
    import pyarrow as pa

    out = []
    for rows, parts, starts, ends in gram_index._slices(iter(texts)):
        b = gram_index._grams(parts, starts, ends, 3, block=True)
        data, begins = gram_index.steps(b.places, b.bounds[:-1])
        cut = [s > 0 or not e for s, e in zip(starts, ends, strict=True)]
        bounds = {"gram": "", "data": None, "keys": rows, "fields": [0] * len(rows), "begins": b.begins.tolist(), "starts": starts, "cut": cut}
        none = dict.fromkeys(("keys", "fields", "begins", "starts", "cut"))
        made = [none | {"gram": g, "data": data[begins[b.bounds[k]] : begins[b.bounds[k + 1]]].tobytes()} for k, g in enumerate(b.grams)]
        schema = pa.schema({"gram": pa.string(), "data": pa.binary(), "keys": pa.list_(pa.int64()), "fields": pa.list_(pa.int32()), "begins": pa.list_(pa.int32()), "starts": pa.list_(pa.int32()), "cut": pa.list_(pa.bool_())})
        out.append(pa.Table.from_pylist([bounds, *made], schema))
    return out


def occurrences(blocks, q):
    at = {k: q[k : k + 3] for k in range(len(q) - 2)}
    run = gram_index.finder(at, {k: utf16(q[:k]) for k in at}, min(at, default=0), "k")
    found = {}
    for b in blocks:
        keep = [g == "" or (g in at.values() if at else g.startswith(q)) for g in b["gram"].to_pylist()]
        for r in run(b.filter(keep)).to_pylist():
            found.setdefault((r["k"], r["shift"]), set()).update(r["starts"])
    out = set()
    for k in {k for k, _ in found}:
        sets = [found[k, s] for s in (at if (k, -1) not in found else [-1]) if (k, s) in found]
        if (k, -1) in found or len(sets) == len(at):
            out |= {(k, s) for s in set.intersection(*sets)}
    return out
