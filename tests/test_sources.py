"""Readers and inference over small files written for the test."""

import json

import pytest

from tableglass.plans.scratch import scratch_folder
from tableglass.sources import detect, infer, readers, sales, writers


def put(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


@pytest.mark.parametrize("separator", [",", ";", "\t", "|", ":"])
def test_separators(spark, tmp_path, separator):
    path = put(tmp_path, "a.csv", separator.join(["x", "y"]) + "\n" + separator.join(["1", "2"]) + "\n")
    assert detect.detect_separator(spark, path).first()["separator"] == separator
    df = readers.read_csv_auto(spark, path)
    assert [tuple(r) for r in df.collect()] == [(1, 2)] and df.columns == ["x", "y"]


def test_no_separator_means_comma_and_ties_take_the_earlier(spark, tmp_path):
    assert detect.detect_separator(spark, put(tmp_path, "a.csv", "x\n1\n")).first()["separator"] == ","
    assert detect.detect_separator(spark, put(tmp_path, "b.csv", "x;y,z\n")).first()["separator"] == ","


def test_only_the_first_4096_bytes_name_the_separator(spark, tmp_path):
    text = "x;y\n" + "".join(f"{i};{i}\n" for i in range(800)) + "a,b,c,d,e,f\n" * 2000
    assert detect.detect_separator(spark, put(tmp_path, "a.csv", text)).first()["separator"] == ";"


def test_encodings(spark, tmp_path):
    assert detect.detect_encoding(spark, put(tmp_path, "a", "é,ü\n".encode())).first()["encoding"] == "UTF-8"
    assert detect.detect_encoding(spark, put(tmp_path, "b", "x\né,ü\n".encode("latin-1"))).first()["encoding"] == "ISO-8859-1"
    assert detect.detect_encoding(spark, put(tmp_path, "c", "é,ü\n".encode("utf-16"))).first()["encoding"] == "UTF-16"
    late = b"x,y\n" + b"1,2\n" * 3000 + "é,3\n".encode("latin-1")
    df = readers.read_csv_auto(spark, put(tmp_path, "d.csv", late))
    assert df.filter("x = 'é'").count() == 1


def test_bad_lines(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'a,b\n1,2\n3,4,5\n6\n"x,y",7\n"p,q",8,9\n')
    good, bad = readers.read_csv_report_bad(spark, path)
    assert sorted((r["a"], r["b"]) for r in good.collect()) == [("1", 2), ("6", None), ("x,y", 7)]
    assert good.select("a").count() == 3
    assert {r["line"] for r in bad.collect()} == {"3,4,5", '"p,q",8,9'} and bad.count() == 2
    assert readers.read_csv_auto(spark, path).count() == 3


def test_json_layouts(spark, tmp_path):
    def rows(name, text):
        df = readers.read_json_auto(spark, put(tmp_path, name, text))
        return df.columns, sorted(tuple(r) for r in df.collect())
    assert rows("a.json", '[{"x": 1}, {"x": 2}]') == (["x"], [(1,), (2,)])
    assert rows("b.json", '[\n{"x": 1},\n{"x": 2}\n]') == (["x"], [(1,), (2,)])
    assert rows("c.json", '{"data": [{"x": 1, "y": "a"}, {"x": 2, "y": "b"}]}') == (["x", "y"], [(1, "a"), (2, "b")])
    assert rows("d.json", '{\n"data": [\n{"x": 1}]\n}') == (["x"], [(1,)])
    assert rows("e.json", '{"data": [5, 6]}') == (["0"], [(5,), (6,)])
    assert rows("f.json", '{"p": {"q": 1, "r": {"s": "t"}}, "l": [1]}') == (["l", "p.q", "p.r.s"], [([1], 1, "t")])
    assert rows("g.jsonl", '{"x": 1}\n{"x": 2}\n') == (["x"], [(1,), (2,)])
    with pytest.raises(ValueError):
        readers.read_json_auto(spark, put(tmp_path, "h.json", "no json at all"))


def test_read_any(spark, tmp_path):
    csv, meta = readers.read_any(spark, put(tmp_path, "a.tsv", "x\ty\n1\t2\n"))
    assert csv.columns == ["x", "y"]
    row = meta.first()
    assert (row["filename"], row["extension"], row["detected_format"], row["rows"], row["columns"], row["size_bytes"]) == (
        "a.tsv", ".tsv", "CSV/TSV", 1, 2, 8)
    assert readers.read_any(spark, put(tmp_path, "a.dat", "x;y\n1;2\n"))[1].first()["detected_format"] == "CSV (auto-detect)"
    assert readers.read_any(spark, put(tmp_path, "b.dat", '{"x": 1}\n'))[1].first()["detected_format"] == "JSON (auto-detect)"
    assert readers.read_any(spark, put(tmp_path, "c.dat", "one\ntwo\n"))[0].columns == ["content"]


def test_dates_and_numbers(spark):
    df = spark.createDataFrame(
        [("05/01/2024", "25/12/2023", "2024-01-05", "1 234,5", "x", "1/2/3"), ("06/30/2024", "13/01/2024", "2024-02-01", "7", "y", "no"),
         ("12/31/2023", "01/02/2024", "2024-02-01 10:00:00", "-3,25", "z", "no")],
        "us string, eu string, iso string, num string, s string, rare string")
    table, log = infer.infer_types(df, aggressive=True)
    assert dict(table.dtypes) == {"us": "timestamp", "eu": "timestamp", "iso": "timestamp", "num": "double", "s": "string", "rare": "string"}
    assert [r["num"] for r in table.collect()] == [1234.5, 7.0, -3.25]
    assert {r["column"] for r in log.collect()} == {"us", "eu", "iso", "num"}
    first = table.selectExpr("cast(us as string) us", "cast(eu as string) eu").first()
    assert tuple(first) == ("2024-05-01 00:00:00", "2023-12-25 00:00:00")
    assert dict(infer.infer_types(df)[0].dtypes)["num"] == "string"


def test_nulls_count_against_a_date(spark):
    df = spark.createDataFrame([("2024-01-05",)] * 3 + [(None,)] * 2, "d string")
    assert dict(infer.infer_datetime(df).dtypes)["d"] == "string"


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 300, 2**40, 0.5), (-128, 2, 3, 1e9 + 0.123)], "a bigint, b bigint, c bigint, x double")
    got = {r["column"]: r["suggested"] for r in infer.suggest_downcast(df).collect()}
    assert got == {"a": "tinyint", "b": "smallint", "c": "bigint", "x": "double"}
    assert dict(infer.infer_types(df)[0].dtypes) == {"a": "tinyint", "b": "smallint", "c": "bigint", "x": "double"}


def test_write_csv_and_sales(spark):
    demo = sales.example_sales(spark, 1500)
    assert demo.count() == 1500 and demo.columns == [
        "Date", "Produit", "Region", "Quantite", "Prix_Unitaire", "Client_Satisfait", "Revenu"]
    assert demo.exceptAll(sales.example_sales(spark, 1500)).count() == 0
    low, high, satisfied = demo.selectExpr("min(Prix_Unitaire)", "max(Quantite)", "avg(cast(Client_Satisfait as int))").first()
    assert low >= 10 and high <= 99 and 0.7 < satisfied < 0.9
    path = scratch_folder(spark)
    writers.write_csv(demo, path, 1000, "Date")
    back = readers.read_csv_auto(spark, path)
    assert back.count() == 1000 and dict(back.dtypes)["Client_Satisfait"] == "boolean"
    with pytest.raises(ValueError):
        writers.write_csv(demo, path, 10)


def test_each_file_has_its_own_separator_and_encoding(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes(b"k;v\n1;2\n")
    (folder / "b c%.csv").write_bytes(b"k,v\n3,4\n")
    (folder / "d.csv").write_bytes("k|v\né|5\n".encode("latin-1"))
    (folder / "e.csv").write_bytes("k|v\nü|6\n".encode())
    (folder / "f.csv").write_bytes("k,v\nà,7\n".encode("utf-16"))
    rows = {tuple(map(str, r)) for r in readers.read_csv_auto(spark, str(folder)).select("k", "v").collect()}
    assert rows == {("1", "2"), ("3", "4"), ("é", "5"), ("ü", "6"), ("à", "7")}
    assert readers.read_csv_auto(spark, str(folder), skip_bad=False).count() == 5


def test_line_breaks_in_quotes(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'k,v\n1,"a\nb"\n2,c\n')
    assert {tuple(r) for r in readers.read_csv_auto(spark, path, multi_line=True).collect()} == {(1, "a\nb"), (2, "c")}


def test_bad_json_is_never_lost(spark, tmp_path):
    text = "".join(f'{{"a": {i}}}\n' for i in range(999)) + '{"a": \n'
    path = put(tmp_path, "a.json", text)
    with pytest.raises(ValueError):
        readers.read_json_auto(spark, path)
    good, bad = readers.read_json_report_bad(spark, path)
    assert good.count() == 999 and [r["line"] for r in bad.collect()] == ['{"a": ']
    whole = readers.read_json_report_bad(spark, put(tmp_path, "b.json", '{"a": 1}\n'))
    assert whole[0].count() == 1 and whole[1].count() == 0


def test_columns_do_not_depend_on_the_number_of_rows(spark, tmp_path):
    one, two = '{"a": 1, "b": {"c": 2}}', '{"a": 3, "b": {"c": 4}}'
    for text in (f"[{one}]", f"[{one}, {two}]", f"[\n{one},\n{two}\n]", f"{one}\n{two}\n"):
        assert readers.read_json_auto(spark, put(tmp_path, "a.json", text)).columns == ["a", "b"], text
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "lines.json").write_text(one)
    (folder / "list.json").write_text(f"[{two}]")
    (folder / "object.json").write_text('{\n"a": 5,\n"e": 6}')
    rows = sorted(tuple(r) for r in readers.read_json_auto(spark, str(folder)).select("a", "b.c", "e").collect())
    assert rows == [(1, 2, None), (3, 4, None), (5, None, 6)]


def test_what_is_no_number(spark):
    df = spark.createDataFrame([(t,) for t in ("1d", "2f", "3D", "NaN", "Infinity", "-inf", "0x1F", "1e", "", ".", "1 234,5", "-7", "+.5", "3.", "1E3")], "t string")
    got = [r["t"] for r in df.select(infer.as_number(df.t).alias("t")).collect()]
    assert got == [None] * 10 + [1234.5, -7.0, 0.5, 3.0, 1000.0]


def test_many_json_documents(spark, tmp_path):
    """Types come from all files, in UTF-16 and UTF-32 too, in many tasks, and a folder of like files is read by its name."""
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(60):
        text = json.dumps([{"k": i, "v": {"x": 1 if i % 2 else 1.5, "é": "日" * (i % 3)}}] + ([{"late": True}] if i == 59 else []), ensure_ascii=False, indent=1)
        (folder / f"{i:02}.json").write_bytes(text.encode({7: "utf-16-le", 9: "utf-32-le"}.get(i, "utf-8")))
    (folder / "blank.json").write_text(" \n\n ")
    assert readers.json_layouts(spark, str(folder)) == {"list": str(folder)}
    assert readers.document_texts(spark, str(folder)).rdd.getNumPartitions() > 1
    df = readers.read_json_auto(spark, str(folder))
    assert df.dtypes == [("k", "bigint"), ("late", "boolean"), ("v", "struct<x:double,é:string>")]
    expected = sorted((i, 1.0 if i % 2 else 1.5, "日" * (i % 3)) for i in range(60))
    assert sorted((r["k"], r["v"]["x"], r["v"]["é"]) for r in df.filter("k is not null").collect()) == expected and df.count() == 61
    assert sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, spark.read.json(str(folder), multiLine=True).collect()), key=str)
    (folder / "bad.json").write_bytes(b'[{"k": "\xff"}]')
    with pytest.raises(ValueError):
        readers.read_json_auto(spark, str(folder))
    (folder / "bad.json").write_text('{"k": 70}\n{"k": 71}\n')
    assert readers.read_json_auto(spark, str(folder)).count() == 63
