"""CSV with line breaks in quotes and JSON lists: records over the borders of the blocks that tasks read."""

import csv
import io
import json
import random

import pytest

from tableglass.sources import elements, readers, records


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of some hundred bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def content(rows, sep=",", end="\n"):
    out = io.StringIO()
    csv.writer(out, delimiter=sep, lineterminator=end).writerows(rows)
    return out.getvalue()


def random_rows(n, seed):
    rng = random.Random(seed)
    words = ["a", "b c", 'say "hi"', "x,y;z", "line\nbreak", "two\n\nbreaks", "é", '"\n"', "long " * 30, "\n" * 5]
    return [[i, "".join(rng.choice(words) for _ in range(rng.randint(1, 6))).strip(" ") or "-", rng.choice(words[:2])] for i in range(n)]


@pytest.mark.parametrize("sep,end,encoding", [(",", "\n", "utf-8"), (";", "\r\n", "utf-8"), ("\t", "\n", "latin-1")])
def test_line_breaks_over_block_borders(spark, tmp_path, small_blocks, sep, end, encoding):
    rows = random_rows(300, 3)
    (tmp_path / "a.csv").write_bytes(content([["key", "text", "kind"], *rows], sep, end).encode(encoding))
    df = readers.read_csv_auto(spark, str(tmp_path / "a.csv"), sep=sep, multi_line=True)
    assert df.dtypes == [("key", "int"), ("text", "string"), ("kind", "string")]
    assert sorted(map(tuple, df.collect())) == [tuple(r) for r in rows]
    assert records.blocks(spark, str(tmp_path / "a.csv"), "\n", "UTF-8").rdd.getNumPartitions() > 20


def test_a_record_longer_than_blocks(spark, tmp_path, small_blocks):
    rows = [[1, "a"], [2, "\n".join(f"line {i}" for i in range(400))], [3, "b\nc"], [4, "d"]]
    (tmp_path / "a.csv").write_text(content([["key", "two\nlines"], *rows]))
    df = readers.read_csv_auto(spark, str(tmp_path / "a.csv"), multi_line=True, sep=",")
    assert df.columns == ["key", "two\nlines"] and sorted(map(tuple, df.collect())) == [tuple(r) for r in rows]


def test_bad_records_folders_and_schema(spark, tmp_path, small_blocks):
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "a.csv").write_text('k,v\n1,"x\ny"\n2,"p\nq",9\n\n3\n')
    (folder / "b.csv").write_text('k,v\n4,"u\n"\n')
    good, bad = readers.read_csv_report_bad(spark, str(folder), multi_line=True)
    assert sorted(map(tuple, good.collect())) == [(1, "x\ny"), (2, "p\nq"), (3, None), (4, "u\n")][:1] + [(3, None), (4, "u\n")]
    assert [r["line"] for r in bad.collect()] == ['2,"p\nq",9']
    kept = readers.read_csv_auto(spark, str(folder), sep=",", encoding="UTF-8", schema=good.schema, skip_bad=False, multi_line=True)
    assert sorted(map(tuple, kept.collect())) == [(1, "x\ny"), (2, "p\nq"), (3, None), (4, "u\n")]
    (tmp_path / "empty.csv").write_text("k,v\n")
    none = readers.read_csv_auto(spark, str(tmp_path / "empty.csv"), sep=",", multi_line=True)
    assert none.columns == ["k", "v"] and none.collect() == []


def test_header_names():
    assert records.header_names("﻿a,,b,A", ",") == ["a0", "_c1", "b", "A3"]


def objects(n):
    rng = random.Random(n)
    texts = ["plain", 'quote " here', "}", "{[", "back\\slash\\", '\\"}', "line\nbreak", "é日", "]" * 50, "long " * 100]
    return [{"k": i, "t": "".join(rng.choice(texts) for _ in range(rng.randint(0, 4))), "o": {"p": [{"q": i % 3}], "e": {}}} for i in range(n)]


def plain(rows):
    return sorted((r["k"], r["t"], r["o"]["p"][0]["q"]) for r in rows)


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("root", [None, 'da"t}a['])
def test_list_elements_over_block_borders(spark, tmp_path, small_blocks, indent, root):
    rows = objects(150)
    (tmp_path / "a.json").write_text(json.dumps({root: rows} if root else rows, indent=indent, ensure_ascii=False) + "\n")
    df = readers.read_json_auto(spark, str(tmp_path / "a.json"))
    assert plain(df.collect()) == plain(rows)
    assert "file_block_start" in df._jdf.queryExecution().optimizedPlan().toString()
    assert elements.blocks(spark, str(tmp_path / "a.json"), "}", "UTF-8").rdd.getNumPartitions() > 20


def test_documents_that_are_no_plain_list(spark, tmp_path, small_blocks):
    """Whatever doesn't look like a list of objects from end to end is read as before, by one task."""
    def judged(text, depth):
        (tmp_path / "x.json").write_text(text)
        return len(elements.list_files(spark, [str(tmp_path / "x.json")], depth))
    many = ", ".join(json.dumps(o) for o in objects(20))
    assert judged(f"[{many}]", 1) == 1 and judged(f'{{"a": [{many}]}}', 2) == 1 and judged('[{"a": {}}]', 1) == 1
    for text, depth in ((f"[{many}, 5]", 1), (f"[{many}", 1), (f"[{many}] x", 1), (f'{{"a": [{many}], "b": 1}}', 2), (f'{{"b": 1, "a": [{many}]}}', 2),
                        ("[1, 2]", 1), ("[]", 1), (f"[{many} {many}]", 1), (f"[[{many}]]", 1), ('{"a": {"b": 1}}', 2)):
        assert judged(text, depth) == 0, text[-30:]
    (tmp_path / "y.json").write_text(json.dumps({"n": list(range(500)), "m": {"x": 1}}))
    assert readers.read_json_auto(spark, str(tmp_path / "y.json")).columns == ["m.x", "n"]
    (tmp_path / "z.json").write_text(f"[{many}, {{broken}}]")
    with pytest.raises(ValueError):
        readers.read_json_auto(spark, str(tmp_path / "z.json"))


@pytest.mark.parametrize("encoding,mark", [("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-32-le", b"\xff\xfe\0\0"), ("utf-32-be", b"\0\0\xfe\xff")])
def test_wide_encodings_over_block_borders(spark, tmp_path, small_blocks, encoding, mark):
    """Bytes that look like a line break at half a character, in characters such as U+0A00 and U+0100, are none."""
    rows = [[i, "\u0a05\u0100\u0a0a\u0a00" * (i % 5) + f"t{i}\u0a41A" + ('"\n"' if i % 7 == 0 else ""), "Ā\u000bx"] for i in range(120)]
    (tmp_path / "a.csv").write_bytes(mark + content([["key", "text", "more"], *rows], ";").encode(encoding))
    df = readers.read_csv_auto(spark, str(tmp_path / "a.csv"), sep=";")
    assert df.columns == ["key", "text", "more"] and sorted(map(tuple, df.collect())) == [tuple(r) for r in rows]
    named = readers.read_csv_auto(spark, str(tmp_path / "a.csv"), sep=";", encoding=encoding.replace("utf-", "UTF-").replace("-le", "LE").replace("-be", "BE"))
    assert named.count() == 120


def test_lines_are_not_shuffled(spark, tmp_path, small_blocks, shuffled):
    """What moves between tasks are the ends of blocks, not the lines within: it grows far less than the file."""
    def moved(n, kind):
        path = str(tmp_path / f"{n}.{kind}")
        with open(path, "w") as f:
            f.write(content([["key", "text", "kind"], *random_rows(n, 5)]) if kind == "csv" else json.dumps(objects(n)))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        size = (tmp_path / f"{n}.{kind}").stat().st_size
        read = (lambda: readers.read_csv_auto(spark, path, sep=",", multi_line=True)) if kind == "csv" else (lambda: readers.read_json_auto(spark, path))
        return shuffled(lambda: read().write.format("noop").mode("overwrite").save()) / size
    assert moved(3000, "csv") < 0.5 and moved(1500, "json") < 0.5
