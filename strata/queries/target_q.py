"""Target and problem detection queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import target as TG
from strata.queries import register, table
from strata.queries.common import NUMERIC, q, union_all

TABLE_COLS = {
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("o_orderpriority", "string")],
}
KEYWORDS_SQL = "[" + ", ".join(f"'{k}'" for k in TG.TARGET_KEYWORDS) + "]"


def _stats_cte(tbl: str) -> str:
    cols = TABLE_COLS[tbl]
    parts = []
    for i, (c, t) in enumerate(cols):
        num = t in NUMERIC
        std = f"STDDEV_SAMP(CAST({q(c)} AS DOUBLE))" if num else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS pos, '{c}' AS name, {'TRUE' if num else 'FALSE'} AS is_num, "
            f"{'TRUE' if t == 'string' else 'FALSE'} AS is_str, "
            f"{'TRUE' if t.startswith('timestamp') else 'FALSE'} AS is_dt, "
            f"COUNT(*) AS nrows, COUNT(*) - COUNT({q(c)}) AS missing, COUNT(DISTINCT {q(c)}) AS u, "
            f"{std} AS sd FROM {tbl}")
    n = len(cols)
    return f"""stats AS ({union_all(parts)}),
scored AS (
  SELECT *,
    (SELECT COALESCE(SUM(CASE WHEN k = lower(replace(trim(name), ' ', '_')) THEN 50
                              WHEN contains(lower(replace(trim(name), ' ', '_')), k) THEN 30 ELSE 0 END), 0)
     FROM (SELECT unnest({KEYWORDS_SQL}) AS k)) AS kw,
    {'0.0' if n <= 1 else f'pos / {n - 1}.0 * 15'} AS position,
    CASE WHEN missing * 1.0 / nrows >= 0.75 THEN -30 WHEN missing * 1.0 / nrows >= 0.5 THEN -20
         WHEN missing * 1.0 / nrows >= 0.25 THEN -10 ELSE 0 END AS penalty,
    (CASE WHEN u = 2 THEN 40 WHEN u <= 5 THEN 30 WHEN u <= 10 THEN 20 WHEN u <= 20 THEN 10 ELSE 0 END
     + CASE WHEN u * 1.0 / GREATEST(nrows, 1) < 0.10 THEN 15 ELSE 0 END
     + CASE WHEN is_str THEN 10 ELSE 0 END) AS cls,
    CASE WHEN NOT is_num THEN 0 ELSE
      (CASE WHEN u * 1.0 / GREATEST(nrows, 1) > 0.30 THEN 25 ELSE 0 END
       + CASE WHEN u > 20 THEN 20 ELSE 0 END + CASE WHEN COALESCE(sd > 0, FALSE) THEN 10 ELSE 0 END) END AS reg
  FROM stats),
final AS (
  SELECT '{tbl}' AS tbl, pos, name AS "column", is_dt,
    ROUND(LEAST(GREATEST(kw + position + penalty + CASE WHEN cls >= reg THEN cls ELSE reg END, 0.0), 100.0), 2)
      AS confidence,
    concat_ws(', ', CASE WHEN kw > 0 THEN 'Target keyword' END,
              CASE WHEN position >= 10 THEN 'Near end of dataset' END,
              CASE WHEN penalty <> 0 THEN 'Missing value penalty' END,
              CASE WHEN cls >= reg THEN 'Low-cardinality target' ELSE 'Continuous numeric target' END) AS reason,
    CASE WHEN cls >= reg THEN 'classification' ELSE 'regression' END AS problem_hint
  FROM scored)"""


SCORE_TABLES = ("labels", "customer", "part")


@register("target_scores", union_all([
    f"(WITH {_stats_cte(t)} SELECT tbl, \"column\", CAST(confidence AS DOUBLE) AS confidence, reason, "
    "problem_hint FROM final)" for t in SCORE_TABLES]))
def target_scores(spark, sf):
    outs = [TG.target_scores(table(spark, sf, t)).select(
        F.lit(t).alias("tbl"), "column", "confidence", "reason", "problem_hint") for t in SCORE_TABLES]
    return reduce(DataFrame.unionByName, outs)


RANK_TABLES = ("labels", "customer", "orders")


@register("target_ranking", union_all([
    f"""(WITH {_stats_cte(t)},
  cand AS (SELECT * FROM final WHERE NOT is_dt),
  kept AS (SELECT * FROM cand WHERE confidence >= 20 OR NOT EXISTS (SELECT 1 FROM cand WHERE confidence >= 20))
  SELECT tbl, CAST(rn AS INTEGER) AS rank, "column", CAST(confidence AS DOUBLE) AS confidence, reason,
         problem_hint, confidence >= 60 AS is_good
  FROM (SELECT *, row_number() OVER (ORDER BY confidence DESC, pos) AS rn FROM kept) WHERE rn <= 5)"""
    for t in RANK_TABLES]))
def target_ranking(spark, sf):
    outs = [TG.target_ranking(table(spark, sf, t)).select(F.lit(t).alias("tbl"), "*")
            for t in RANK_TABLES]
    return reduce(DataFrame.unionByName, outs)


PROBLEM_CASES = (("labels", "quality"), ("customer", "c_acctbal"), ("customer", "c_mktsegment"),
                 ("orders", "o_totalprice"), ("part", "p_size"), ("labels", "doc_id"))


def _problem_sql(tbl, target):
    cols = dict(TABLE_COLS[tbl])
    t = cols[target]
    has_dt = any(v.startswith("timestamp") for v in cols.values())
    num = t in NUMERIC
    c = q(target)
    if has_dt and num:
        return (f"SELECT '{tbl}' AS tbl, '{target}' AS target, 'time_series' AS problem_type, 95.0 AS confidence, "
                f"'{TG.TIME_SERIES_REASON}' AS reason, TRUE AS is_time_series")
    reg = ("LEAST(CASE WHEN u > 20 THEN 30 ELSE 0 END + CASE WHEN r > 0.25 THEN 35 ELSE 0 END "
           "+ CASE WHEN COALESCE(sd > 0, FALSE) THEN 20 ELSE 0 END "
           "+ CASE WHEN COALESCE(mn <> mx, TRUE) THEN 15 ELSE 0 END, 100)" if num else "0")
    cls = (f"LEAST({'40' if t == 'string' else '0'} + CASE WHEN u = 2 THEN 35 WHEN u <= 5 THEN 25 "
           "WHEN u <= 10 THEN 15 WHEN u <= 20 THEN 8 ELSE 0 END "
           "+ CASE WHEN r < 0.05 THEN 20 WHEN r < 0.10 THEN 10 ELSE 0 END, 100)")
    return f"""SELECT '{tbl}' AS tbl, '{target}' AS target,
  CASE WHEN cls >= reg THEN 'classification' ELSE 'regression' END AS problem_type,
  CAST(ROUND(CASE WHEN cls >= reg THEN cls ELSE reg END, 2) AS DOUBLE) AS confidence,
  CASE WHEN cls >= reg THEN '{TG.CLASSIFICATION_REASON}' ELSE '{TG.REGRESSION_REASON}' END AS reason,
  FALSE AS is_time_series
FROM (SELECT {cls} AS cls, {reg} AS reg FROM (
  SELECT COUNT(DISTINCT {c}) AS u, COUNT(DISTINCT {c}) * 1.0 / GREATEST(COUNT(*), 1) AS r,
         {'STDDEV_SAMP(CAST(' + c + ' AS DOUBLE))' if num else 'NULL'} AS sd,
         MIN({c}) AS mn, MAX({c}) AS mx FROM {tbl}))"""


@register("problem_type", union_all([_problem_sql(t, c) for t, c in PROBLEM_CASES]))
def problem_type(spark, sf):
    outs = [TG.problem_type(table(spark, sf, t), c).select(
        F.lit(t).alias("tbl"), F.lit(c).alias("target"), "problem_type",
        F.col("confidence").cast("double").alias("confidence"), "reason", "is_time_series")
        for t, c in PROBLEM_CASES]
    return reduce(DataFrame.unionByName, outs)
