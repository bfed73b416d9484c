"""Folders of many documents that are one object with a list."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from registry import sources
from tableglass.sources import heads, readers


def test_many_documents_with_a_root(spark, tmp_path):
    """The folder is read by its name, and types come from all documents, found by many tasks."""
    for i in range(40):
        records = [{"k": 2 * i, "v": "a"}, {"k": 2 * i + 1.5 if i == 39 else 2 * i + 1, "v": None if i % 2 else "b"}]
        (tmp_path / f"{i:02}.json").write_text('{"data": [\n' + ",\n".join(map(json.dumps, records)) + "\n]}")
    assert readers.json_layouts(spark, str(tmp_path)) == {"object": str(tmp_path)}
    assert readers.document_texts(spark, str(tmp_path)).rdd.getNumPartitions() > 1
    df = readers.read_json_auto(spark, str(tmp_path))
    assert df.dtypes == [("k", "double"), ("v", "string")]
    rows = {r["k"]: r["v"] for r in df.collect()}
    assert rows == {2.0 * i: "a" for i in range(40)} | {2 * i + (1.5 if i == 39 else 1.0): None if i % 2 else "b" for i in range(40)}
    (tmp_path / "bad.json").write_text('{"data": [\n{"k": 1,\n]}')
    with pytest.raises(ValueError):
        readers.read_json_auto(spark, str(tmp_path))


def test_sizes_of_documents_come_with_their_heads(spark, tmp_path, monkeypatch):
    """Short documents are not listed again to find long ones; long ones still are."""
    for i in range(20):
        (tmp_path / f"{i:02}.json").write_text('{"data": [\n' + ",\n".join(json.dumps({"k": 2 * i + j}) for j in range(2)) + "\n]}")
    asked = []
    found = readers.file_names
    monkeypatch.setattr(readers, "file_names", lambda *a: asked.append(a[2]) or found(*a))
    assert readers.json_facts(spark, str(tmp_path)) == ({"object": str(tmp_path)}, max(f.stat().st_size for f in tmp_path.iterdir()))
    assert sorted(r["k"] for r in readers.read_json_auto(spark, str(tmp_path)).collect()) == list(range(40)) and not asked
    monkeypatch.setattr(readers, "TEXT_BYTES", 10)
    assert sorted(r["k"] for r in readers.read_json_auto(spark, str(tmp_path), cut_bytes=0).collect()) == list(range(40)) and asked[0] == 0


def test_heads_of_many_files_take_few_tasks(spark, tmp_path):
    for i in range(700):
        (tmp_path / f"{i:03}").write_bytes(b"%d" % i)
    df = heads.heads(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() <= max(spark.sparkContext.defaultParallelism, 3)
    assert sorted(int(r["head"]) for r in df.collect()) == list(range(700))


def test_documents_are_written_by_many_tasks(spark):
    """Spark joins small partitions to one task, whose files are written one by one; the number of tasks follows that of the documents."""
    folder = Path(sources.as_document(spark, spark.range(400).select(F.to_json(F.struct("id")).alias("record")), '{"data": [\n', "\n]}", each=2).removeprefix("file:"))
    names = [f for f in folder.iterdir() if f.name.startswith("part-")]
    assert len({f.name.split("-")[1] for f in names}) > 1
    records = [f.read_text().removeprefix('{"data": [\n').removesuffix("\n]}\n").split(",\n") for f in names]
    assert all(r == sorted(r) for r in records) and max(map(len, records)) < 20
    assert sorted(json.loads(x)["id"] for r in records for x in r) == list(range(400))
