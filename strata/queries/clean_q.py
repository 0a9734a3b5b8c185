"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import clean as C
from strata.plans import preprocess as PP
from strata.queries import register, table
from strata.queries.common import (LINEITEM_N_SQL, NATION_DUP_SQL, ORDERS_N_SQL, lineitem_n,
                                   nation_dup, orders_n, round_doubles)


@register("drop_duplicates", f"SELECT DISTINCT * FROM ({NATION_DUP_SQL})")
def drop_duplicates(spark, sf):
    return C.drop_duplicates(nation_dup(spark, sf))


_LN_ALL = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
           "l_tax, l_returnflag, l_linestatus, l_shipdate")


@register("drop_constant", f"SELECT {_LN_ALL}, qty_n, mostly_null, half_null, qty_out FROM ({LINEITEM_N_SQL})")
def drop_constant(spark, sf):
    return C.drop_constant(lineitem_n(spark, sf))[0]


@register("drop_high_missing",
          f"SELECT {_LN_ALL}, qty_n, half_null, qty_out, const_c FROM ({LINEITEM_N_SQL})")
def drop_high_missing(spark, sf):
    """Threshold 60 %: the null shares of the derived columns are 1/2 and 2/3 at every scale."""
    return C.drop_high_missing(lineitem_n(spark, sf), 0.6)[0]


@register("drop_high_cardinality", "SELECT doc_id, lang, source, n_chars FROM documents")
def drop_high_cardinality(spark, sf):
    return C.drop_high_cardinality(table(spark, sf, "documents"), 100)[0]


def _mode_sql(c):
    return (f"(SELECT v FROM (SELECT {c} AS v, COUNT(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY 1) "
            "ORDER BY n DESC, v LIMIT 1)")


@register("impute_numeric", f"""
WITH t AS ({LINEITEM_N_SQL})
SELECT l_orderkey, l_linenumber,
  ROUND(COALESCE(qty_n, (SELECT QUANTILE_CONT(qty_n, 0.5) FROM t)), 6) AS qty_median,
  ROUND(COALESCE(qty_n, (SELECT AVG(qty_n) FROM t)), 6) AS qty_mean,
  ROUND(COALESCE(qty_n, {_mode_sql('qty_n')}), 6) AS qty_mode,
  ROUND(COALESCE(qty_n, 0.0), 6) AS qty_const,
  ROUND(COALESCE(half_null, (SELECT QUANTILE_CONT(half_null, 0.5) FROM t)), 6) AS half_median,
  ROUND(COALESCE(CAST(l_linenumber AS DOUBLE), 0.0), 6) AS line_median
FROM t""")
def impute_numeric(spark, sf):
    df = lineitem_n(spark, sf).select("l_orderkey", "l_linenumber", "qty_n", "half_null")
    med = C.fill_plan(df, ["qty_n", "half_null", "l_linenumber"], [], [], "median")
    mean = C.fill_plan(df, ["qty_n"], [], [], "mean")
    mode = C.fill_plan(df, ["qty_n"], [], [], "most_frequent")
    const = C.fill_plan(df, ["qty_n"], [], [], "constant")

    q = F.col("qty_n").cast("double")
    out = df.select(
        "l_orderkey", F.col("l_linenumber"),
        F.coalesce(q, F.lit(med.numeric["qty_n"])).alias("qty_median"),
        F.coalesce(q, F.lit(mean.numeric["qty_n"])).alias("qty_mean"),
        F.coalesce(q, F.lit(mode.numeric["qty_n"])).alias("qty_mode"),
        F.coalesce(q, F.lit(const.numeric["qty_n"])).alias("qty_const"),
        F.coalesce(F.col("half_null"), F.lit(med.numeric["half_null"])).alias("half_median"),
        F.coalesce(F.col("l_linenumber").cast("double"), F.lit(med.numeric["l_linenumber"])).alias("line_median"))
    return round_doubles(out)


@register("impute_categorical", f"""
WITH t AS ({ORDERS_N_SQL})
SELECT o_orderkey, COALESCE(prio_n, {_mode_sql('prio_n')}) AS prio_n, o_orderstatus FROM t""")
def impute_categorical(spark, sf):
    df = orders_n(spark, sf).select("o_orderkey", "prio_n", "o_orderstatus")
    return C.apply_fill(df, C.fill_plan(df, [], ["prio_n", "o_orderstatus"], []))


@register("impute_boolean", f"""
WITH t AS ({ORDERS_N_SQL})
SELECT o_orderkey, COALESCE(big_n, {_mode_sql('big_n')}) AS big_n FROM t""")
def impute_boolean(spark, sf):
    df = orders_n(spark, sf).select("o_orderkey", "big_n")
    return C.apply_fill(df, C.fill_plan(df, [], [], ["big_n"]))


_IQR_SQL = f"""WITH t AS ({LINEITEM_N_SQL}),
b AS (SELECT QUANTILE_CONT(qty_out, 0.25) AS q1, QUANTILE_CONT(qty_out, 0.75) AS q3,
             QUANTILE_CONT(l_extendedprice, 0.25) AS e1, QUANTILE_CONT(l_extendedprice, 0.75) AS e3,
             QUANTILE_CONT(qty_n, 0.25) AS n1, QUANTILE_CONT(qty_n, 0.75) AS n3 FROM t)"""


@register("iqr_outliers", _IQR_SQL + """
SELECT l_orderkey, l_linenumber, qty_out,
  COALESCE(qty_out < q1 - 1.5 * (q3 - q1) OR qty_out > q3 + 1.5 * (q3 - q1), FALSE) AS qty_out_outlier,
  COALESCE(qty_n < n1 - 1.5 * (n3 - n1) OR qty_n > n3 + 1.5 * (n3 - n1), FALSE) AS qty_n_outlier
FROM t, b""")
def iqr_outliers(spark, sf):
    df = lineitem_n(spark, sf).select("l_orderkey", "l_linenumber", "qty_out", "qty_n")
    return C.outlier_flags(df, ["qty_out", "qty_n"], "iqr").drop("qty_n")


@register("zscore_outliers", f"""
WITH t AS ({LINEITEM_N_SQL}),
b AS (SELECT AVG(qty_out) AS m, STDDEV_SAMP(qty_out) AS s, AVG(const_c) AS cm, STDDEV_SAMP(const_c) AS cs FROM t)
SELECT l_orderkey, l_linenumber, qty_out,
  COALESCE(ABS((qty_out - m) / NULLIF(s, 0)) > 3.0, FALSE) AS qty_out_outlier,
  COALESCE(ABS((const_c - cm) / NULLIF(cs, 0)) > 3.0, FALSE) AS const_c_outlier
FROM t, b""")
def zscore_outliers(spark, sf):
    df = lineitem_n(spark, sf).select("l_orderkey", "l_linenumber", "qty_out", "const_c")
    return C.outlier_flags(df, ["qty_out", "const_c"], "zscore").drop("const_c")


@register("remove_outliers", _IQR_SQL + """
SELECT l_orderkey, l_linenumber, qty_out, l_extendedprice, qty_n FROM t, b
WHERE NOT COALESCE(qty_out < q1 - 1.5 * (q3 - q1) OR qty_out > q3 + 1.5 * (q3 - q1), FALSE)
  AND NOT COALESCE(l_extendedprice < e1 - 1.5 * (e3 - e1) OR l_extendedprice > e3 + 1.5 * (e3 - e1), FALSE)
  AND NOT COALESCE(qty_n < n1 - 1.5 * (n3 - n1) OR qty_n > n3 + 1.5 * (n3 - n1), FALSE)""")
def remove_outliers(spark, sf):
    df = lineitem_n(spark, sf).select("l_orderkey", "l_linenumber", "qty_out", "l_extendedprice", "qty_n")
    return C.remove_outliers(df, ["qty_out", "l_extendedprice", "qty_n"], "iqr")


_INF = ["l_orderkey", "l_quantity", "l_returnflag",
        "CASE WHEN l_discount = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity / l_discount END AS q_per_disc",
        "CASE WHEN l_discount = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE 1.0 END AS neg_inf_or_one",
        "CAST('Infinity' AS DOUBLE) AS all_inf",
        "CAST(NULL AS DOUBLE) AS empty_c", "CAST(1.0 AS DOUBLE) AS const_c", "'x' AS const_s"]


@register("remove_invalid_features", """
SELECT l_orderkey, l_quantity, l_returnflag,
  CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity / l_discount END AS q_per_disc,
  CASE WHEN l_discount = 0 THEN NULL ELSE 1.0 END AS neg_inf_or_one
FROM lineitem""")
def remove_invalid_features(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(*_INF)
    return C.remove_invalid_features(df)[0]


_PRE_SQL = f"""WITH t AS ({ORDERS_N_SQL}),
m AS (SELECT QUANTILE_CONT(CAST(o_orderkey AS DOUBLE), 0.5) AS k, QUANTILE_CONT(CAST(o_custkey AS DOUBLE), 0.5) AS c,
             QUANTILE_CONT(o_totalprice, 0.5) AS p, QUANTILE_CONT(price_n, 0.5) AS pn FROM t)
SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus,
  o_totalprice, o_orderdate, o_orderpriority,
  COALESCE(prio_n, {_mode_sql('prio_n')}) AS prio_n,
  COALESCE(big_n, {_mode_sql('big_n')}) AS big_n,
  ROUND(COALESCE(price_n, pn), 6) AS price_n,
  CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter,
  CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(weekofyear(o_orderdate) AS INTEGER) AS o_orderdate_week,
  CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek,
  CAST(dayofyear(o_orderdate) AS INTEGER) AS o_orderdate_dayofyear, CAST(hour(o_orderdate) AS INTEGER) AS o_orderdate_hour,
  CAST(minute(o_orderdate) AS INTEGER) AS o_orderdate_minute,
  CAST(COALESCE(isodow(o_orderdate) - 1 >= 5, FALSE) AS INTEGER) AS o_orderdate_is_weekend
FROM t, m"""


@register("preprocess", _PRE_SQL)
def preprocess(spark, sf):
    out, _ = PP.preprocess(orders_n(spark, sf))
    return round_doubles(out)


@register("preprocess_report", f"""
WITH t AS ({ORDERS_N_SQL})
SELECT CAST(COUNT(*) AS BIGINT) AS original_rows, CAST(COUNT(*) AS BIGINT) AS processed_rows,
  CAST(0 AS BIGINT) AS rows_removed, CAST(9 AS BIGINT) AS original_columns, CAST(19 AS BIGINT) AS processed_columns,
  CAST(SUM((prio_n IS NULL)::INT + (big_n IS NULL)::INT + (price_n IS NULL)::INT) AS BIGINT) AS missing_before,
  CAST(0 AS BIGINT) AS missing_after
FROM t""")
def preprocess_report(spark, sf):
    _, meta = PP.preprocess(orders_n(spark, sf))
    return meta["report"]
