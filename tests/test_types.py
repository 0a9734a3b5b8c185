from conftest import rows
from strata.operators import types as TY


def test_tighten_types(spark):
    df = spark.createDataFrame([(1, 100000, 0.5, "Yes", "maybe"), (2, -5, 0.25, "no", "yes")],
                               "a bigint, b bigint, f double, yn string, m string")
    out = TY.tighten_types(df)
    t = dict((f.name, f.dataType.simpleString()) for f in out.schema.fields)
    assert t == {"a": "tinyint", "b": "int", "f": "float", "yn": "boolean", "m": "string"}
    assert rows(out, "a", "yn") == [(1, True), (2, False)]


def test_float_not_narrowed_when_values_move(spark):
    df = spark.createDataFrame([(68423.46,)], "f double")
    assert TY.tighten_types(df).schema["f"].dataType.simpleString() == "double"


def test_datetime_detection_threshold(spark):
    data = [(i, "2020-01-%02d" % (i % 28 + 1) if i % 10 < 8 else "junk") for i in range(100)]
    df = spark.createDataFrame(data, "k int, d string")
    det = {r["column"]: r for r in TY.datetime_detection(df).collect()}
    assert det["d"]["format"] == "yyyy-MM-dd" and det["d"]["parsed_ratio"] == 0.8 and det["d"]["is_datetime"]
    assert det["d"]["unparsed"] == 20
    assert TY.parse_datetime(df).schema["d"].dataType.simpleString() == "string"
    parsed = TY.parse_datetime(df, lossy=True)
    assert parsed.schema["d"].dataType.simpleString() == "timestamp"
    assert parsed.where("d IS NULL").count() == 20


def test_dates_after_a_long_prefix_are_not_lost(spark):
    data = [(i, "2020-01-%02d" % (i % 28 + 1) if i < 1000 else "03.%02d.2021" % (i % 12 + 1)) for i in range(5000)]
    df = spark.createDataFrame(data, "k int, d string")
    assert TY.parse_datetime(df).where("d IS NOT NULL").count() == 5000
    assert {r["format"] for r in TY.datetime_detection(df).collect()} == {"dd.MM.yyyy"}


def test_date_layouts(spark):
    values = ["2021-03-04T05:06:07Z", "2021-03-04T05:06:07.123+02:00", "4 Mar 2021", "March 4, 2021", "25/12/2021",
              "12/25/2021", "2021-03-04 05:06:07.123"]
    for v in values:
        df = spark.createDataFrame([(v,)], "d string")
        out = TY.parse_datetime(df)
        assert out.schema["d"].dataType.simpleString() == "timestamp", v
        assert out.first()[0].year == 2021
    long = spark.createDataFrame([("x" * 100_000,), (None,)], "d string")
    assert TY.parse_datetime(long).schema["d"].dataType.simpleString() == "string"


def test_feature_groups_text_ratio(spark):
    df = spark.createDataFrame([(str(i), str(i % 2), i, True) for i in range(10)],
                               "t string, c string, n int, b boolean")
    g = dict(rows(TY.feature_groups(df)))
    assert g == {"t": "text", "c": "categorical", "n": "numeric", "b": "boolean"}
    assert dict(rows(TY.feature_groups(df, target="n"))).get("n") is None


def test_text_columns_mean_length(spark):
    df = spark.createDataFrame([("x" * 30, "a"), ("y" * 30, "a"), (None, "b")], "long string, short string")
    assert [r[0] for r in rows(TY.text_columns(df), "column")] == ["long"]


def test_shapes_never_hide_a_value_that_a_layout_parses(spark):
    """Every layout on every odd value, with and without the test of shapes."""
    from pyspark.sql import functions as F
    values = ["2021-03-04", "2021-3-4", "+12021-03-04", "-2021-03-04", "2021-13-04", "2021-02-30", "2021-02-29", "2020-02-29",
              "03/04/2021", "13/04/2021", "04/13/2021", "31.12.1999", "00.12.1999", "2021/03/04", "2021-03-04 05:06", "0000-01-01",
              "2021-03-04 24:00:00", "2021-03-04 23:59:60", "2021-03-04 05:06:07", "2021-03-04T05:06:07", "2021-03-04 05:06:07.1",
              "2021-03-04 05:06:07.123456", "2021-03-04 05:06:07.1234567", "2021-03-04T05:06:07Z", "2021-03-04T05:06:07+02:00",
              "2021-03-04T05:06:07.12-11:30", "2021-03-04 05:06:07+0200", "2021-03-04 05:06:07Z", "4 Mar 2021", "04 Mar 2021",
              "004 mar 2021", "4 March 2021", "MARCH 4, 2021", "Mar 4, 2021", "Mar 44, 2021", "4 May 2021", " 2021-03-04", "2021-03-04 ",
              "٢٠٢١-٠٣-٠٤", "", "x", None, "12/31/2020 10:11:12", "31.01.2020 10:11:12", "2021-03-04 05:06:07.", "20210304"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    hits = 0
    for fmt in TY.DATETIME_FORMATS:
        plain = F.try_to_timestamp(F.when(F.length("v") <= 40, F.col("v")), F.lit(fmt))
        rows_ = df.select("v", F.unix_micros(plain).alias("a"), F.unix_micros(TY._parsed(F.col("v"), fmt)).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in rows_), (fmt, [r for r in rows_ if r["a"] != r["b"]])
        hits += sum(r["b"] is not None for r in rows_)
    assert hits > 25
    other = df.select(TY._parsed(F.col("v"), "yyyyMMdd").alias("b"), "v").where("b IS NOT NULL").collect()
    assert [r["v"] for r in other] == ["20210304"]
