"""Chart-data queries."""

from __future__ import annotations

from strata.operators import charts as CH
from strata.queries import register, table
from strata.queries.common import (LINEITEM_N_SQL, ORDERS_N_SQL, lineitem_n, orders_n, q,
                                   round_doubles, union_all)

_HIST = """WITH s AS (SELECT MIN({c}) AS lo, MAX({c}) AS hi FROM {t}),
b AS (SELECT CAST(LEAST(CAST(FLOOR(30.0 * ({c} - lo) / (hi - lo)) AS BIGINT) + 1, 30) AS INTEGER) AS bin,
             COUNT(*) AS n FROM {t}, s WHERE {c} IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(1, 31))
SELECT g.bin, ROUND(lo + (g.bin - 1) * ((hi - lo) / 30), 6) AS lower, ROUND(lo + g.bin * ((hi - lo) / 30), 6) AS upper,
       CAST(COALESCE(b.n, 0) AS BIGINT) AS count
FROM g LEFT JOIN b ON g.bin = b.bin, s"""


@register("histogram", _HIST.format(c="l_extendedprice", t="lineitem"))
def histogram(spark, sf):
    return round_doubles(CH.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30))


@register("box_stats", f"""
WITH t AS ({LINEITEM_N_SQL}),
s AS (SELECT QUANTILE_CONT(qty_out, 0.25) AS q1, QUANTILE_CONT(qty_out, 0.5) AS q2,
             QUANTILE_CONT(qty_out, 0.75) AS q3 FROM t)
SELECT q1, q2 AS median, q3, q3 - q1 AS iqr,
  MIN(CASE WHEN qty_out >= q1 - 1.5 * (q3 - q1) AND qty_out <= q3 + 1.5 * (q3 - q1) THEN qty_out END) AS lower_whisker,
  MAX(CASE WHEN qty_out >= q1 - 1.5 * (q3 - q1) AND qty_out <= q3 + 1.5 * (q3 - q1) THEN qty_out END) AS upper_whisker,
  CAST(COUNT(CASE WHEN qty_out < q1 - 1.5 * (q3 - q1) OR qty_out > q3 + 1.5 * (q3 - q1) THEN 1 END) AS BIGINT)
    AS n_outliers
FROM t, s GROUP BY q1, q2, q3""")
def box_stats(spark, sf):
    return CH.box_stats(lineitem_n(spark, sf), "qty_out")


@register("box_outliers", f"""
WITH t AS ({LINEITEM_N_SQL}),
s AS (SELECT QUANTILE_CONT(qty_out, 0.25) AS q1, QUANTILE_CONT(qty_out, 0.75) AS q3 FROM t)
SELECT qty_out FROM t, s WHERE qty_out < q1 - 1.5 * (q3 - q1) OR qty_out > q3 + 1.5 * (q3 - q1)""")
def box_outliers(spark, sf):
    return CH.box_outliers(lineitem_n(spark, sf), "qty_out")


@register("density", """
WITH s AS (
  SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, COUNT(*) AS n,
         1.059 * LEAST(STDDEV_SAMP(l_extendedprice),
                       (QUANTILE_CONT(l_extendedprice, 0.75) - QUANTILE_CONT(l_extendedprice, 0.25)) / 1.349)
           * POW(COUNT(*), -0.2) AS h FROM lineitem),
b AS (SELECT LEAST(CAST(FLOOR(512.0 * (l_extendedprice - lo) / (hi - lo)) AS INTEGER), 511) AS bin, COUNT(*) AS c
      FROM lineitem, s GROUP BY 1),
g AS (SELECT lo - 2 * h + range * ((hi - lo + 4 * h) / 99) AS x FROM s, range(0, 100))
SELECT ROUND(x, 4) AS value,
       ROUND(SUM(c * EXP(-0.5 * POW((x - (lo + (bin + 0.5) * ((hi - lo) / 512))) / h, 2))) / (MAX(n) * MAX(h) * SQRT(2 * PI()))
             * 1000000, 6) AS density
FROM g, b, s GROUP BY x""")
def density(spark, sf):
    """The violin curve of ``l_extendedprice``, as density per million."""
    from pyspark.sql import functions as F
    out = CH.density(table(spark, sf, "lineitem"), "l_extendedprice")
    return out.select(F.round("value", 4).alias("value"), F.round(F.col("density") * 1e6, 6).alias("density"))


@register("prediction_plot", """
WITH p AS (SELECT l_extendedprice AS actual, 1500.0 * l_quantity AS predicted FROM lineitem),
e AS (SELECT LEAST(MIN(actual), MIN(predicted)) AS lo, GREATEST(MAX(actual), MAX(predicted)) AS hi FROM p)
SELECT actual, CAST(predicted AS DOUBLE) AS predicted, 'point' AS kind FROM p
UNION ALL SELECT lo, lo, 'ideal' FROM e UNION ALL SELECT hi, hi, 'ideal' FROM e""")
def prediction_plot(spark, sf):
    """Every line's price against a price predicted from its quantity, and the ends of the ideal line."""
    from strata.operators.evaluate import prediction_plot as plot
    lines = table(spark, sf, "lineitem").selectExpr("l_extendedprice", "1500.0D * l_quantity AS predicted")
    return plot(lines, "l_extendedprice", "predicted")


@register("value_counts", f"""
SELECT COALESCE(prio_n, 'Missing') AS Category, COUNT(*) AS Count FROM ({ORDERS_N_SQL}) GROUP BY 1
ORDER BY Count DESC, Category""")
def value_counts(spark, sf):
    return CH.value_counts(orders_n(spark, sf), "prio_n")


@register("scatter_sample", """
SELECT o_totalprice, o_custkey, o_orderstatus FROM orders
ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42') LIMIT 10000""")
def scatter_sample(spark, sf):
    return CH.scatter_sample(table(spark, sf, "orders"), "o_totalprice", "o_custkey", "o_orderstatus",
                             id_col="o_orderkey")


_ON = ["o_orderkey", "o_custkey", "o_totalprice", "price_n"]


@register("correlation_long", f"WITH t AS ({ORDERS_N_SQL}) " + union_all([
    f"SELECT '{a}' AS x, '{b}' AS y, ROUND(COVAR_POP(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END, "
    f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END) / NULLIF(STDDEV_POP(CASE WHEN {a} IS NOT NULL AND "
    f"{b} IS NOT NULL THEN {a} END) * STDDEV_POP(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END), 0), 2) AS r "
    "FROM t" for a in _ON for b in _ON]))
def correlation_long(spark, sf):
    return CH.correlation_long(orders_n(spark, sf))


_MM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "qty_n", "mostly_null", "half_null", "qty_out",
            "empty_c", "const_c"]


@register("missing_matrix", f"""
WITH t AS ({LINEITEM_N_SQL}), s AS (SELECT MIN(l_orderkey) AS lo, MAX(l_orderkey) AS hi FROM t),
b AS (SELECT CAST(LEAST(FLOOR((CAST(l_orderkey AS DOUBLE) - lo) / (hi - lo + 1) * 10), 9) AS INTEGER) AS block, t.*
      FROM t, s)
""" + union_all([f"SELECT block, '{c}' AS \"column\", ROUND(AVG(CASE WHEN {q(c)} IS NULL THEN 1.0 ELSE 0.0 END), 9) "
                 "AS null_share FROM b GROUP BY block" for c in _MM_COLS]))
def missing_matrix(spark, sf):
    return round_doubles(CH.missing_matrix(lineitem_n(spark, sf), "l_orderkey", blocks=10), 9)


@register("pair_sample", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42') LIMIT 500""")
def pair_sample(spark, sf):
    return CH.pair_sample(table(spark, sf, "orders"), id_col="o_orderkey")


@register("target_distribution", """
SELECT o_orderstatus AS Category, COUNT(*) AS Count FROM orders GROUP BY 1 ORDER BY Count DESC, Category""")
def target_distribution(spark, sf):
    return CH.target_distribution(table(spark, sf, "orders"), "o_orderstatus")
