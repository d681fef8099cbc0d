"""Files of codes in large numbers, and of any encoding."""

import pytest

from facetgrid.sources import ingest, named_files


def test_a_folder_of_files_is_read_by_few_tasks_and_once(spark, tmp_path, monkeypatch):
    n = 700
    for k in range(n):
        (tmp_path / f"{k}.json").write_text(f'{{"cd":"{k}",\n"lastUpdate":"u{k}"}}')
    (tmp_path / "x.txt").write_text("no")
    (tmp_path / "sub.json").mkdir()
    (tmp_path / "sub.json" / "y.json").write_text("{}")
    files = named_files.read_files(spark, str(tmp_path), ".json")
    assert files.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert files.count() == n and files.where("name = '7.json'").first()["content"] == b'{"cd":"7",\n"lastUpdate":"u7"}'
    monkeypatch.setattr(named_files, "FILES", 100)
    reader = named_files.Reader(str(tmp_path), ".json", 2)
    assert [len(p.names) for p in reader.partitions()] == [100] * 7
    read = ingest.read_details(spark, str(tmp_path))
    (tmp_path / "8.json").write_text("{broken")
    assert read.count() == n and read.where("cd = '8'").first()["lastUpdate"] == "u8"
    assert {tuple(r) for r in ingest.saved_updates(spark, str(tmp_path)).collect()} == {(str(k), f"u{k}") for k in range(n) if k != 8}
    with pytest.raises(Exception, match="Malformed|MALFORMED"):
        ingest.read_details(spark, str(tmp_path))


def test_files_of_any_encoding_list_and_name(spark, tmp_path):
    folder = tmp_path / "a b日"
    folder.mkdir()
    (folder / "_1.json").write_bytes('{"cd":"é1"}'.encode("utf-16-le"))
    (folder / "２.json").write_bytes("﻿[{\"cd\":\"2\"},{\"cd\":\"3\",\"lastUpdate\":\"u\"}]".encode())
    want = {("é1", None), ("2", None), ("3", "u")}
    assert {(r["cd"], r["lastUpdate"]) for r in ingest.read_details(spark, str(folder)).collect()} == want
    (folder / "zeros.json").write_bytes(b"\0" * 7)
    (folder / "bytes.json").write_bytes(b'{"cd":"\xff"}')
    (folder / "empty.json").write_bytes(b"")
    (folder / "bare.json").write_bytes(b'{"lastUpdate":"u"}')
    assert {tuple(r) for r in ingest.saved_updates(spark, str(folder)).collect()} == {(c, u or "") for c, u in want}
    with pytest.raises(Exception, match="no text in"):
        ingest.read_details(spark, str(folder))


def test_marks_of_many_files_are_read_by_few_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"{k}.json").write_text(f'{{"cd":"{k}"}}')
    marks = ingest.saved_updates(spark, str(tmp_path))
    assert marks.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and marks.count() == 300
