"""Separators and layouts from the first bytes of files, however large."""

import gzip

import pytest

from tableglass.sources import detect, heads, readers


@pytest.fixture
def read_bytes(spark):
    """Bytes that Spark's readers read in an action."""
    def measured(action):
        sc = spark.sparkContext._jsc.sc()

        def total():
            sc.listenerBus().waitUntilEmpty(30_000)
            executors = sc.statusStore().executorList(True)
            return sum(executors.apply(i).totalInputBytes() for i in range(executors.size()))
        before = total()
        result = action()
        return result, total() - before
    return measured


def test_large_files_are_not_read_through(spark, tmp_path, read_bytes):
    (tmp_path / "a b%20é.csv").write_bytes(b"x;y\n" + b"1,1,1,1;2\n" * 800_000)
    (tmp_path / "lines.json").write_bytes(b'\n {"a": 1}\n' * 500_000)
    (tmp_path / "list.json").write_bytes(b"[" + b'{"a": 1},\n' * 500_000 + b'{"a": 1}]')
    found, n = read_bytes(lambda: detect.detect_separator(spark, str(tmp_path / "a b%20é.csv")).collect())
    assert [r["separator"] for r in found] == [","] and n < 100_000
    for name in ("lines", "list"):
        layouts, n = read_bytes(lambda: readers.json_layouts(spark, str(tmp_path / f"{name}.json")))
        assert list(layouts) == [name] and n < 100_000


def test_heads(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 10)
    (tmp_path / "b").write_bytes(b"y" * 9000)
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"p|q\n1|2\n"))
    rows = {r["file"].rsplit("/", 1)[1]: (r["length"], r["head"]) for r in heads.heads(spark, str(tmp_path)).collect()}
    assert rows.pop("c.gz")[1] is None
    assert rows == {"a": (10, b"x" * 10), "b": (9000, b"y" * 4096)}
    assert heads.read_head("nostore://host/x", 10) is None and heads.read_head(str(tmp_path / "missing"), 10) is None


def test_packed_files_are_read_by_spark(spark, tmp_path):
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"p|q\n1|2\n"))
    assert detect.detect_separator(spark, str(tmp_path / "c.csv.gz")).first()["separator"] == "|"
    assert [tuple(r) for r in readers.read_csv_auto(spark, str(tmp_path / "c.csv.gz")).collect()] == [(1, 2)]
    (tmp_path / "d.json.gz").write_bytes(gzip.compress(b'{"a": 1}\n{"a": 2}\n'))
    assert readers.read_json_auto(spark, str(tmp_path / "d.json.gz")).count() == 2


@pytest.mark.parametrize("text,layout", [
    ('{"a": 1}', "object"), ('{"a": 1}\n', "object"), ('\n\n {"a": 1}\n\n', "object"), ('{"a": 1}\n{"a": 2}', "lines"), ('{\n"a": 1}', "object"),
    (" [\n1]", "list"), ('{"a": "' + "x" * 5000 + '"}', "object"), ('{"a": "' + "x" * 5000 + '"}\n{"a": 1}', "lines"), ('{"a": 1}\n' + " " * 5000, "object"),
    ("\n" * 5000 + '{"a": 1}\n{"a": 2}', "lines"), ("\n" * 5000 + "[1]", "list"), (" \n", None), ('{"a": 1}\r\n{"a": 2}\r\n', "lines"), ("5\n6", "lines")])
def test_layouts(spark, tmp_path, text, layout):
    (tmp_path / "x.json").write_bytes(text.encode())
    assert list(readers.json_layouts(spark, str(tmp_path / "x.json"))) == ([layout] if layout else [])
    many = tmp_path / "many"
    many.mkdir()
    (many / "1.json").write_bytes(text.encode())
    (many / "2.json").write_bytes(b'{"a": 1}')
    found = {f.rsplit("/", 1)[1]: k for k, files in readers.json_layouts(spark, str(many)).items() for f in files}
    alone = layout == "object" and not text.startswith('{\n"a"')
    assert found == {"2.json": "lines", **({"1.json": "lines" if alone else layout} if layout else {})}
