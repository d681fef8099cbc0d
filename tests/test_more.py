import json

import pytest
from fixture_courses import ROWS
from pyspark.sql import functions as F

from facetgrid.functions import present
from facetgrid.operators import incremental
from facetgrid.plans import fields
from facetgrid.sources.ingest import DETAIL
from facetgrid.sources.retry import SourceError, backoff, fetch_pages, with_retries


def test_related_parts(spark):
    rows = spark.createDataFrame([("see 12345 and 54321.", ["12345"]), ("12345", ["12345"]), ("none", []), ("", ["1"])], "t string, known array<string>")
    got = [[tuple(p) for p in r["o"]] for r in rows.select(present.related_parts("t", F.col("known")).alias("o")).collect()]
    assert got == [[("see ", None), ("12345", "12345"), (" and 54321.", None)], [("12345", "12345")], [("none", None)], []]


def test_sections(spark):
    one = {"cd": "1", "summary": "s", "goals": ["g"], "plan": [], "unit": "2", "numbering": ["x"], "aims": "　", "extra": [{"label": "関連科目（1）", "text": "12345"}, {"label": "備考", "text": " "}, {"label": "注", "text": "y"}]}
    details = spark.createDataFrame([(json.dumps(one),)], "j string").select(F.from_json("j", DETAIL).alias("d")).select("d.*")
    got = [(r["key"], r["label"], r["group"], r["render"]) for r in fields.sections(details).orderBy("ord").collect()]
    assert got == [("summary", "授業の概要", "", "longtext"), ("goals", "到達目標", "授業内容", "checklist"), ("extra:関連科目（1）", "関連科目", "その他", "related"), ("extra:注", "注", "その他", "longtext"), ("__base__", "科目情報", "その他", "base")]
    assert fields.spec_frame(spark).count() == 15
    assert fields.is_current(fields.render_markdown().replace("\n", "\r\n"), fields.render_markdown()) and not fields.is_current("", fields.render_typescript())


def test_crawl_report(spark):
    outcomes = [(0, None, "", False), (1, 403, "HTTP 403", False), (2, None, "fatal: no guid", True), (3, 403, "HTTP 403", False), (4, 500, "HTTP 500", False), (5, 429, "HTTP 429", False), (6, None, "", False)]
    rows = spark.createDataFrame([("g", *o) for o in outcomes], "g string, k int, status int, reason string, fatal boolean")
    got = incremental.crawl_report(rows, "g", "k", 3, first=2).first()
    assert (got["fetched"], got["skipped"], got["no_detail"], got["aborted"]) == (1, 5, 1, True)
    assert got["diagnostics"] == ["HTTP 403", "fatal: no guid"]
    assert incremental.crawl_report(rows.where("k < 5"), "g", "k", 3).first()["aborted"] is False


def test_retries():
    waits, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise SourceError("x", status=503, retry_after=5 if len(tries) == 2 else 0)
        return "ok"

    assert with_retries(call, 3, 1.0, waits.append) == "ok" and waits == [1.0, 5]
    assert backoff(1.0, 10) == 60.0
    with pytest.raises(SourceError):
        with_retries(lambda: (_ for _ in ()).throw(SourceError("no", status=403)), 3, 1.0, waits.append)
    pages = {1: {"maxPageNo": 2, "total": 3}, 2: {"maxPageNo": 2, "total": 3}}
    assert fetch_pages(pages.__getitem__, 0, 1.0) == [pages[1], pages[2]]
    with pytest.raises(SourceError):
        fetch_pages(pages.__getitem__, 0, 1.0, min_total=9)


def test_command_line(spark, tmp_path, capsys):
    from facetgrid.__main__ import main

    source = tmp_path / "raw.json"
    source.write_text(json.dumps({"selectKogiDtoList": ROWS}))
    assert main(["convert", str(source), "-o", str(tmp_path / "data.json"), "--compact", "--generated-at", "2026-01-01T00:00:00Z"]) == 0
    assert len((tmp_path / "data.json").read_bytes()) == 2448 and (tmp_path / "search.idx").read_bytes()[:4] == b"SYX1"
    assert "フィールド実習" in capsys.readouterr().err
    source.write_text("[]")
    assert main(["convert", str(source)]) == 1
