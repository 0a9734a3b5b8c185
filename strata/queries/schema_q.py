"""Schema-level queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import schema as S
from strata.queries import register, table
from strata.queries.common import LINEITEM_N_SQL, ORDERS_N_SQL, lineitem_n, orders_n, union_all


@register("clean_column_names", """
SELECT n_nationkey AS nation_key, n_name AS "näme_x", n_regionkey AS region_key_2 FROM nation""")
def clean_column_names(spark, sf):
    d = table(spark, sf, "nation").select(F.col("n_nationkey").alias(" Nation Key "),
                                          F.col("n_name").alias("Näme--X"),
                                          F.col("n_regionkey").alias("__Region__Key__2"))
    return S.clean_column_names(d)


@register("drop_duplicate_columns", "SELECT r_regionkey, r_name FROM region")
def drop_duplicate_columns(spark, sf):
    r = table(spark, sf, "region")
    d = r.select("r_regionkey", "r_name", F.col("r_name").alias("r_regionkey"),
                 F.lit(None).cast("string").alias("empty"))
    return S.drop_duplicate_columns(d)[0]


_LN_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "qty_n", "mostly_null",
            "half_null", "qty_out", "empty_c", "const_c"]


@register("validate_dataset", f"""
WITH t AS ({LINEITEM_N_SQL}),
e AS (SELECT {' + '.join(f'(CASE WHEN COUNT({c}) = 0 THEN 1 ELSE 0 END)' for c in _LN_COLS)} AS n FROM t)
SELECT 0 AS seq, n || ' completely empty column(s).' AS issue FROM e WHERE n > 0""")
def validate_dataset(spark, sf):
    return S.validate_dataset(lineitem_n(spark, sf))


@register("select_numeric", union_all([
    f"SELECT 'numeric' AS kind, o_orderkey AS k, CAST(o_orderkey AS DOUBLE) AS a, CAST(o_custkey AS DOUBLE) AS b, "
    f"o_totalprice AS c, price_n AS d FROM ({ORDERS_N_SQL})"]))
def select_numeric(spark, sf):
    num = S.select_kind(orders_n(spark, sf), "numeric")
    a, b, c, d = num.columns
    return num.select(F.lit("numeric").alias("kind"), F.col(a).alias("k"), F.col(a).cast("double").alias("a"),
                      F.col(b).cast("double").alias("b"), F.col(c).alias("c"), F.col(d).alias("d"))


@register("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def preview(spark, sf):
    return S.preview(table(spark, sf, "orders"), 10, "o_orderkey")


@register("sample_rows", """
SELECT * FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42') LIMIT 1000""")
def sample_rows(spark, sf):
    return S.sample_rows(table(spark, sf, "orders"), 1000, id_col="o_orderkey", seed=42)


@register("flatten_struct", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k", event_type FROM events""")
def flatten_struct(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("props"),
                                          "event_type")
    return S.flatten_struct(e)


@register("align_features", """
SELECT l_discount, l_quantity, CAST(0 AS INTEGER) AS missing_a, l_tax FROM lineitem""")
def align_features(spark, sf):
    d = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag")
    return S.align_features(d, ["l_discount", "l_quantity", "missing_a", "l_tax"], fill=0)


@register("align_null", """
SELECT l_discount, l_quantity, CAST(NULL AS DOUBLE) AS missing_a, l_tax FROM lineitem""")
def align_null(spark, sf):
    d = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag")
    return S.align_features(d, ["l_discount", "l_quantity", "missing_a", "l_tax"], fill=None)
