import os
import tempfile

import pytest
from conftest import rows
from strata.operators import schema as S
from strata.sources import readers as R
from strata.sources import writers as W


def _write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_extension_guard():
    assert R.validate_extension("a/B.CSV") == "csv"
    with pytest.raises(ValueError):
        R.validate_extension("x.xlsx")
    with pytest.raises(ValueError):
        R.validate_extension("x.txt")


def test_csv_latin1_bom_and_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="strata-test-")
    lat = _write(os.path.join(d, "latin.csv"), "a,b,c\n1,café,NA\n2,x,3.5\n".encode("latin-1"))
    df = R.scan_csv(spark, lat)
    assert rows(df) == [(1, "café", None), (2, "x", 3.5)]
    assert df.schema["c"].dataType.simpleString() == "double"
    bom = _write(os.path.join(d, "bom.csv"), "﻿k,flag\n1,True\n2,n/a\n".encode("utf-8"))
    df2 = R.scan_csv(spark, bom)
    assert df2.columns == ["k", "flag"] and rows(df2) == [(1, True), (2, None)]
    with pytest.raises(ValueError):
        R.scan_prediction(spark, lat)  # UTF-8 only


def test_int_column_with_missing_becomes_double(spark):
    d = tempfile.mkdtemp(prefix="strata-test-")
    p = _write(os.path.join(d, "n.csv"), b"a,b\n1,2\n,3\n")
    df = R.scan_csv(spark, p)
    assert df.schema["a"].dataType.simpleString() == "double"
    assert df.schema["b"].dataType.simpleString() == "bigint"


def test_round_trip_and_manifest(spark):
    d = tempfile.mkdtemp(prefix="strata-test-")
    src = spark.createDataFrame([(1, "a,b", 2.5), (2, 'q"uote', None)], "k long, s string, v double")
    W.save_table(src, os.path.join(d, "t.csv"))
    back = R.scan_csv(spark, os.path.join(d, "t.csv"))
    assert rows(back) == [(1, "a,b", 2.5), (2, 'q"uote', None)]
    with pytest.raises(ValueError):
        W.save_table(src, os.path.join(d, "t.xyz"))
    with pytest.raises(ValueError):
        W.save_table(None, os.path.join(d, "t.csv"))
    man = dict(rows(W.export_manifest(spark, d)))
    assert set(man) == {"t.csv"} and man["t.csv"] > 0


def test_load_and_prepare(spark):
    d = tempfile.mkdtemp(prefix="strata-test-")
    p = _write(os.path.join(d, "x.csv"), b" id ,when,flag\n1,2024-01-02,yes\n2,2024-02-03,no\n")
    df, info = R.load_and_prepare(spark, p)
    t = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert t == {"id": "tinyint", "when": "timestamp", "flag": "boolean"}
    assert info.first()["rows"] == 2


def test_column_names(spark):
    assert S.clean_column_name("  Sale  Price ($) ") == "sale_price"
    df = spark.createDataFrame([(1, 2)], "`a b` int, `A-B` int")
    with pytest.raises(ValueError):
        S.clean_column_names(df)
    dup = spark.createDataFrame([(1, 2, None)], "a int, b int, c string").toDF("a", "a", "c")
    out, removed = S.drop_duplicate_columns(dup)
    assert out.columns == ["a"] and removed == ["a", "c"]


def test_validate_dataset(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert [r[1] for r in rows(S.validate_dataset(df))] == ["1 completely empty column(s)."]
    empty = spark.createDataFrame([], "a int")
    assert "Dataset is empty." in [r[1] for r in rows(S.validate_dataset(empty))]


def test_sample_rows_exact(spark):
    df = spark.range(100)
    s1 = S.sample_rows(df, 10, id_col="id")
    assert s1.count() == 10 and rows(s1) == rows(S.sample_rows(df, 10, id_col="id"))
    assert S.sample_rows(df, 500, id_col="id").count() == 100


def test_flatten_and_align(spark):
    df = spark.createDataFrame([(1, (2, (3,)))], "k int, s struct<a:int, b:struct<c:int>>")
    assert S.flatten_struct(df).columns == ["k", "s.a", "s.b.c"]
    al = S.align_features(spark.createDataFrame([(1, 2, 3)], "b int, x int, a int"), ["a", "b", "m"])
    assert al.columns == ["a", "b", "m"] and al.first()["m"] == 0


def test_csv_cells_come_back_as_written(spark, tmp_path):
    data = [(1, " a ", "x"), (2, "1D", "y"), (3, 'q"x\r\ny', "z"), (4, "b,c", " "), (5, "", "w"), (6, None, "v")]
    df = spark.createDataFrame(data, "k long, s string, e string")
    W.save_table(df, f"{tmp_path}/t.csv")
    back = R.scan_csv(spark, f"{tmp_path}/t.csv")
    want = [(k, None if s in ("", None) else s, e) for k, s, e in data]  # an empty cell is missing, as in pandas
    assert rows(back, "k", "s", "e") == sorted(want)
    assert dict(back.dtypes) == {"k": "bigint", "s": "string", "e": "string"}
    raw = "".join(p.read_text() for p in (tmp_path / "t.csv").glob("*.csv"))
    assert '5,"",w' in raw and "6,,v" in raw  # the file keeps empty and missing apart


def test_csv_encoding_is_decided_per_file(spark, tmp_path):
    folder = tmp_path / "m.csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes("k,s\n1,é\n".encode())
    (folder / "b.csv").write_bytes("k,s\n2,é\n".encode("latin-1"))
    assert rows(R.scan_csv(spark, str(folder)), "k", "s") == [(1, "é"), (2, "é")]
    with pytest.raises(ValueError):
        R.scan_csv(spark, str(folder), encodings=("utf-8",))


def test_header_only_csv_is_refused(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        R.scan_csv(spark, f"{tmp_path}/h.csv")


def test_numbers_need_the_form_of_numbers(spark, tmp_path):
    (tmp_path / "n.csv").write_text("a,b,c,d\n1D,2,1e3,inf\n2F,3,.5,1\n")
    assert dict(R.scan_csv(spark, f"{tmp_path}/n.csv").dtypes) == {"a": "string", "b": "bigint", "c": "double", "d": "double"}
