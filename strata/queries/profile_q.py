"""Profiling queries."""

from __future__ import annotations

from strata.operators import profile as P
from strata.queries import register, table
from strata.queries.common import (LINEITEM_COLS, LINEITEM_N_EXTRA, LINEITEM_N_SQL,
                                   NATION_DUP_SQL, NUMERIC, ORDERS_COLS, ORDERS_N_EXTRA,
                                   ORDERS_N_SQL, lineitem_n, nation_dup, orders_n, q,
                                   round_doubles, union_all)

LN = LINEITEM_COLS + LINEITEM_N_EXTRA
ON = ORDERS_COLS + ORDERS_N_EXTRA


def _stats_sql_named(cols, src) -> str:
    # column names of a UNION take the first branch's names; alias explicitly
    parts = []
    for c, t in cols:
        num = t in NUMERIC or t == "boolean"
        v = f"CAST({q(c)} AS DOUBLE)"
        if num:
            mom = (f"ROUND(MIN({v}), 8) AS min, ROUND(MAX({v}), 8) AS max, "
                   f"ROUND(AVG({v}), 8) AS mean, ROUND(STDDEV_SAMP({v}), 8) AS std")
        else:
            mom = ("CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, "
                   "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std")
        parts.append(
            f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CAST(COUNT({q(c)}) AS BIGINT) AS non_null, "
            f"CAST(COUNT(*) - COUNT({q(c)}) AS BIGINT) AS missing, "
            f"CAST(COUNT(DISTINCT {q(c)}) AS BIGINT) AS \"unique\", {mom} FROM t")
    return f"WITH t AS ({src}) " + union_all(parts)


@register("feature_statistics", _stats_sql_named(LN, LINEITEM_N_SQL))
def feature_statistics(spark, sf):
    return round_doubles(P.feature_statistics(lineitem_n(spark, sf)), 8)


@register("missing_counts", "WITH t AS (" + LINEITEM_N_SQL + ") " + union_all([
    f"SELECT '{c}' AS \"column\", CAST(COUNT(*) - COUNT({q(c)}) AS BIGINT) AS missing FROM t"
    for c, _ in LN]))
def missing_counts(spark, sf):
    return P.missing_counts(lineitem_n(spark, sf))


@register("missing_percent", "WITH t AS (" + ORDERS_N_SQL + ") " + union_all([
    f"SELECT '{c}' AS \"column\", ROUND(100.0 * (COUNT(*) - COUNT({q(c)})) / COUNT(*), 2) "
    "AS missing_percent FROM t" for c, _ in ON]))
def missing_percent(spark, sf):
    return P.missing_percent(orders_n(spark, sf))


@register("missing_summary", "WITH t AS (" + LINEITEM_N_SQL + ") SELECT * FROM (" + union_all([
    f"SELECT '{c}' AS \"column\", CAST(COUNT(*) - COUNT({q(c)}) AS BIGINT) AS missing_values, "
    f"ROUND(100.0 * (COUNT(*) - COUNT({q(c)})) / COUNT(*), 2) AS percentage FROM t"
    for c, _ in LN]) + ") ORDER BY percentage DESC, \"column\"")
def missing_summary(spark, sf):
    return P.missing_summary(lineitem_n(spark, sf))


@register("duplicate_rows", f"""
WITH t AS ({NATION_DUP_SQL}), g AS (SELECT n_nationkey, n_name, n_regionkey, COUNT(*) AS n FROM t GROUP BY ALL)
SELECT CAST(SUM(n) AS BIGINT) AS rows, CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows,
       ROUND(100.0 * SUM(n - 1) / SUM(n), 2) AS duplicate_percent FROM g""")
def duplicate_rows(spark, sf):
    return P.duplicate_rows(nation_dup(spark, sf))


@register("constant_columns", "WITH t AS (" + LINEITEM_N_SQL + ") SELECT \"column\" FROM (" + union_all([
    f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {q(c)}) + MAX(CASE WHEN {q(c)} IS NULL THEN 1 ELSE 0 END) AS k FROM t"
    for c, _ in LN]) + ") WHERE k <= 1")
def constant_columns(spark, sf):
    return P.constant_columns(lineitem_n(spark, sf))


def _card_sql(tbl, cols, threshold):
    return union_all([
        f"SELECT '{tbl}' AS tbl, {threshold} AS threshold, '{c}' AS \"column\", "
        f"CAST(COUNT(DISTINCT {c}) AS BIGINT) AS \"unique\" FROM {tbl} HAVING COUNT(DISTINCT {c}) >= {threshold}"
        for c in cols])


@register("high_cardinality", union_all([
    _card_sql("part", ["p_name", "p_brand", "p_type"], 50),
    _card_sql("supplier", ["s_name"], 100),
    _card_sql("customer", ["c_name", "c_mktsegment"], 100),
    _card_sql("documents", ["text", "lang", "source"], 100)]))
def high_cardinality(spark, sf):
    from pyspark.sql import functions as F
    outs = []
    for tbl, th in (("part", 50), ("supplier", 100), ("customer", 100), ("documents", 100)):
        outs.append(P.high_cardinality(table(spark, sf, tbl), th).select(
            F.lit(tbl).alias("tbl"), F.lit(th).alias("threshold"), "column", "unique"))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def _describe_sql():
    parts = []
    for c, t in ON:
        if t in NUMERIC or t.startswith("timestamp"):
            v = f"CAST({q(c)} AS DOUBLE)" if t in NUMERIC else f"epoch({q(c)})"
            std = f"ROUND(STDDEV_SAMP({v}), 6)" if t in NUMERIC else "CAST(NULL AS DOUBLE)"
            parts.append(
                f"SELECT '{c}' AS \"column\", CAST(COUNT({q(c)}) AS BIGINT) AS count, "
                f"CAST(NULL AS BIGINT) AS \"unique\", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, "
                f"ROUND(AVG({v}), 6) AS mean, {std} AS std, ROUND(MIN({v}), 6) AS min, "
                f"ROUND(QUANTILE_CONT({v}, 0.25), 6) AS q25, ROUND(QUANTILE_CONT({v}, 0.5), 6) AS q50, "
                f"ROUND(QUANTILE_CONT({v}, 0.75), 6) AS q75, ROUND(MAX({v}), 6) AS max FROM t")
        else:
            s = f"CAST({q(c)} AS VARCHAR)"
            parts.append(
                f"SELECT '{c}' AS \"column\", CAST(COUNT({q(c)}) AS BIGINT) AS count, "
                f"CAST(COUNT(DISTINCT {q(c)}) AS BIGINT) AS \"unique\", "
                f"(SELECT v FROM (SELECT {s} AS v, COUNT(*) AS n FROM t WHERE {q(c)} IS NOT NULL GROUP BY 1) "
                f"ORDER BY n DESC, v LIMIT 1) AS top, "
                f"(SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM t WHERE {q(c)} IS NOT NULL GROUP BY {q(c)})) AS freq, "
                "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, "
                "CAST(NULL AS DOUBLE) AS q25, CAST(NULL AS DOUBLE) AS q50, CAST(NULL AS DOUBLE) AS q75, "
                "CAST(NULL AS DOUBLE) AS max FROM t")
    return f"WITH t AS ({ORDERS_N_SQL}) " + union_all(parts)


@register("describe", _describe_sql())
def describe(spark, sf):
    return round_doubles(P.describe(orders_n(spark, sf)), 6)


def _corr_sql(cols, src):
    parts = []
    for a in cols:
        for b in cols:
            x, y = f"CAST({q(a)} AS DOUBLE)", f"CAST({q(b)} AS DOUBLE)"
            both = f"{q(a)} IS NOT NULL AND {q(b)} IS NOT NULL"
            xs, ys = f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END"
            parts.append(
                f"SELECT '{a}' AS x, '{b}' AS y, ROUND(COVAR_POP({xs}, {ys}) / "
                f"NULLIF(STDDEV_POP({xs}) * STDDEV_POP({ys}), 0), 6) AS r FROM t")
    return f"WITH t AS ({src}) " + union_all(parts)


_CORR_COLS = [c for c, t in LN if t in NUMERIC]


@register("correlation", _corr_sql(_CORR_COLS, LINEITEM_N_SQL))
def correlation(spark, sf):
    return round_doubles(P.correlation(lineitem_n(spark, sf)))


_MEM_SQL = ("SELECT CAST(SUM(8+8+8+4+8+8+8+8+8 + COALESCE(STRLEN(l_returnflag),0) + "
            "COALESCE(STRLEN(l_linestatus),0)) AS BIGINT) AS bytes, "
            "ROUND(SUM(8+8+8+4+8+8+8+8+8 + COALESCE(STRLEN(l_returnflag),0) + "
            "COALESCE(STRLEN(l_linestatus),0)) / 1048576.0, 2) AS memory_mb FROM lineitem")


@register("memory_usage", _MEM_SQL)
def memory_usage(spark, sf):
    return P.memory_usage(table(spark, sf, "lineitem"))


@register("dataset_summary", f"""
WITH t AS ({NATION_DUP_SQL})
SELECT CAST(COUNT(*) AS BIGINT) AS rows, CAST(3 AS BIGINT) AS columns,
       CAST(0 AS BIGINT) AS missing_cells,
       CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM t)) AS BIGINT) AS duplicate_rows,
       ROUND(SUM(4 + 4 + STRLEN(n_name)) / 1048576.0, 2) AS memory_mb,
       CAST(2 AS BIGINT) AS numeric_columns, CAST(1 AS BIGINT) AS categorical_columns,
       CAST(0 AS BIGINT) AS boolean_columns, CAST(0 AS BIGINT) AS datetime_columns
FROM t""")
def dataset_summary(spark, sf):
    return P.dataset_summary(nation_dup(spark, sf))
