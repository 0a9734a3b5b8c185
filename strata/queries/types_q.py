"""Type inference and health queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import health as H
from strata.operators import types as TY
from strata.queries import register, table
from strata.queries.common import (LINEITEM_COLS, LINEITEM_N_EXTRA, LINEITEM_N_SQL,
                                   NATION_DUP_SQL, NUMERIC, ORDERS_COLS, ORDERS_N_EXTRA,
                                   ORDERS_N_SQL, lineitem_n, nation_dup, orders_n, q,
                                   union_all)
from strata.queries.profile_q import _corr_sql, _describe_sql

COLS = {
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                  ("source", "string"), ("n_chars", "bigint")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "orders_n": ORDERS_COLS + ORDERS_N_EXTRA,
    "lineitem_n": LINEITEM_COLS + LINEITEM_N_EXTRA,
    "nation_dup": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
}
SRC = {"documents": "SELECT * FROM documents", "customer": "SELECT * FROM customer",
       "part": "SELECT * FROM part", "orders_n": ORDERS_N_SQL, "lineitem_n": LINEITEM_N_SQL,
       "nation_dup": NATION_DUP_SQL}


def _load(spark, sf, name) -> DataFrame:
    if name == "orders_n":
        return orders_n(spark, sf)
    if name == "lineitem_n":
        return lineitem_n(spark, sf)
    if name == "nation_dup":
        return nation_dup(spark, sf)
    return table(spark, sf, name)


def _kind(t):
    if t == "boolean":
        return "boolean"
    if t in NUMERIC:
        return "numeric"
    if t.startswith("timestamp"):
        return "datetime"
    return "string"


def _colstats_sql(name):
    """CTE text: cs(pos, name, kind, nrows, u, avg_len, avg_len0)."""
    parts = []
    for i, (c, t) in enumerate(COLS[name]):
        s = t == "string"
        parts.append(
            f"SELECT {i} AS pos, '{c}' AS name, '{_kind(t)}' AS kind, COUNT(*) AS nrows, "
            f"COUNT(DISTINCT {q(c)}) AS u, "
            f"{'AVG(LENGTH(' + q(c) + '))' if s else 'NULL'} AS avg_len, "
            f"{'AVG(COALESCE(LENGTH(' + q(c) + '), 0))' if s else 'NULL'} AS avg_len0 FROM t")
    return f"t AS ({SRC[name]}), cs AS ({union_all(parts)})"


def _union_tables(fn, names):
    return reduce(DataFrame.unionByName, [fn(n).select(F.lit(n).alias("tbl"), "*") for n in names])


GROUP_TABLES = ("documents", "orders_n", "customer")


@register("feature_groups", union_all([
    f"""(WITH {_colstats_sql(n)} SELECT '{n}' AS tbl, name AS "column",
  CASE WHEN kind = 'string' THEN CASE WHEN u * 1.0 / nrows >= 0.70 THEN 'text' ELSE 'categorical' END
       ELSE kind END AS feature_group FROM cs)""" for n in GROUP_TABLES]))
def feature_groups(spark, sf):
    return _union_tables(lambda n: TY.feature_groups(_load(spark, sf, n)), GROUP_TABLES)


EDA_TABLES = ("documents", "part", "customer")


@register("feature_types_eda", union_all([
    f"""(WITH {_colstats_sql(n)} SELECT '{n}' AS tbl, name AS "column",
  CASE WHEN kind = 'string' THEN CASE WHEN u * 1.0 / nrows > 0.70 OR avg_len0 > 25 THEN 'text'
       ELSE 'categorical' END ELSE kind END AS feature_group FROM cs)""" for n in EDA_TABLES]))
def feature_types_eda(spark, sf):
    return _union_tables(lambda n: TY.feature_types_eda(_load(spark, sf, n)), EDA_TABLES)


TEXT_TABLES = ("documents", "part", "customer")


@register("text_columns", union_all([
    f"""(WITH {_colstats_sql(n)} SELECT '{n}' AS tbl, '{rule}' AS rule, name AS "column",
  ROUND(COALESCE(avg_len, 0.0), 6) AS avg_length, ROUND(u * 1.0 / nrows, 6) AS unique_ratio FROM cs
  WHERE kind = 'string' AND (u * 1.0 / nrows >= 0.70 {'OR COALESCE(avg_len, 0) >= 20' if rule == 'length_or_ratio' else ''}))"""
    for n in TEXT_TABLES for rule in ("length_or_ratio", "ratio")]))
def text_columns(spark, sf):
    outs = []
    for n in TEXT_TABLES:
        for rule in ("length_or_ratio", "ratio"):
            outs.append(TY.text_columns(_load(spark, sf, n), rule=rule).select(
                F.lit(n).alias("tbl"), F.lit(rule).alias("rule"), "column",
                F.round("avg_length", 6).alias("avg_length"), F.round("unique_ratio", 6).alias("unique_ratio")))
    return reduce(DataFrame.unionByName, outs)


INFER_TABLES = ("customer", "orders_n", "part")


@register("infer_types", union_all([
    f"""(WITH {_colstats_sql(n)} SELECT '{n}' AS tbl, name AS "column",
  CASE WHEN kind <> 'string' THEN kind WHEN u <= 20 THEN 'categorical' ELSE 'text' END AS inferred_type FROM cs)"""
    for n in INFER_TABLES]))
def infer_types(spark, sf):
    return _union_tables(lambda n: TY.infer_types(_load(spark, sf, n)), INFER_TABLES)


# --- tightening ------------------------------------------------------------

_TIGHT_SPARK = ["l_orderkey", "l_linenumber", "l_discount", "l_extendedprice", "l_returnflag",
                "CASE WHEN l_linenumber % 2 = 0 THEN 'Yes' ELSE 'no' END AS yes_no",
                "CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN 'TRUE' "
                "ELSE 'false' END AS tf_null",
                "CASE WHEN l_linenumber % 3 = 0 THEN 'maybe' ELSE 'yes' END AS not_bool",
                "CAST(l_quantity AS BIGINT) * 100000 AS big_int"]


@register("tighten_types", """
SELECT l_orderkey, CAST(l_linenumber AS TINYINT) AS l_linenumber,
       CAST(l_discount AS FLOAT) AS l_discount, l_extendedprice, l_returnflag,
       CASE WHEN l_linenumber % 2 = 0 THEN TRUE ELSE FALSE END AS yes_no,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN TRUE ELSE FALSE END AS tf_null,
       CASE WHEN l_linenumber % 3 = 0 THEN 'maybe' ELSE 'yes' END AS not_bool,
       CAST(CAST(l_quantity AS BIGINT) * 100000 AS INTEGER) AS big_int
FROM lineitem""")
def tighten_types(spark, sf):
    """Narrowed columns; the key, whose width depends on the scale, is widened again for comparison."""
    out = TY.tighten_types(table(spark, sf, "lineitem").selectExpr(*_TIGHT_SPARK))
    return out.withColumn("l_orderkey", F.col("l_orderkey").cast("long"))


def _dated_orders(spark, sf):
    o = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate",
                    F.when(F.col("o_orderkey") % 10 < 9, day).otherwise("n/a?").alias("d90"),
                    F.when(F.col("o_orderkey") % 10 < 7, day).otherwise("n/a?").alias("d70"),
                    F.when(F.col("o_orderkey") % 10 < 9, F.date_format("o_orderdate", "MM/dd/yyyy"))
                    .alias("us90"))


_DATED_SQL = """SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate,
  CASE WHEN o_orderkey % 10 < 9 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a?' END AS d90,
  CASE WHEN o_orderkey % 10 < 7 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a?' END AS d70,
  CASE WHEN o_orderkey % 10 < 9 THEN strftime(o_orderdate, '%m/%d/%Y') END AS us90
FROM orders"""


@register("detect_datetime", f"""
WITH s AS (SELECT * FROM ({_DATED_SQL}))
SELECT 'o_orderdate' AS "column", CAST(NULL AS VARCHAR) AS format, 1.0 AS parsed_ratio, CAST(0 AS BIGINT) AS unparsed,
  TRUE AS is_datetime
UNION ALL SELECT 'o_orderstatus', NULL, 0.0, COUNT(*), FALSE FROM s
UNION ALL SELECT 'o_orderpriority', NULL, 0.0, COUNT(*), FALSE FROM s
UNION ALL SELECT 'd90', 'yyyy-MM-dd', AVG(CASE WHEN try_strptime(d90, '%Y-%m-%d') IS NOT NULL THEN 1.0 ELSE 0.0 END),
  COUNT(CASE WHEN d90 IS NOT NULL AND try_strptime(d90, '%Y-%m-%d') IS NULL THEN 1 END),
  AVG(CASE WHEN try_strptime(d90, '%Y-%m-%d') IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.8 FROM s
UNION ALL SELECT 'd70', 'yyyy-MM-dd', AVG(CASE WHEN try_strptime(d70, '%Y-%m-%d') IS NOT NULL THEN 1.0 ELSE 0.0 END),
  COUNT(CASE WHEN d70 IS NOT NULL AND try_strptime(d70, '%Y-%m-%d') IS NULL THEN 1 END),
  AVG(CASE WHEN try_strptime(d70, '%Y-%m-%d') IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.8 FROM s
UNION ALL SELECT 'us90', 'MM/dd/yyyy', AVG(CASE WHEN try_strptime(us90, '%m/%d/%Y') IS NOT NULL THEN 1.0 ELSE 0.0 END),
  COUNT(CASE WHEN us90 IS NOT NULL AND try_strptime(us90, '%m/%d/%Y') IS NULL THEN 1 END),
  AVG(CASE WHEN try_strptime(us90, '%m/%d/%Y') IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.8 FROM s
""")
def detect_datetime(spark, sf):
    return TY.datetime_detection(_dated_orders(spark, sf))


@register("parse_datetime", f"""
SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate,
       try_strptime(d90, '%Y-%m-%d') AS d90, d70, try_strptime(us90, '%m/%d/%Y') AS us90
FROM ({_DATED_SQL})""")
def parse_datetime(spark, sf):
    return TY.parse_datetime(_dated_orders(spark, sf), lossy=True)


# --- health ------------------------------------------------------------------

def _bytes_expr(name):
    parts = []
    for c, t in COLS[name]:
        if t == "string":
            parts.append(f"COALESCE(STRLEN({q(c)}), 0)")
        else:
            parts.append({"bigint": "8", "int": "4", "double": "8", "boolean": "1",
                          "timestamp_ntz": "8", "smallint": "2", "tinyint": "1"}[t])
    return " + ".join(parts)


def _prof_sql(name):
    cols = COLS[name]
    allc = ", ".join(q(c) for c, _ in cols)
    missing = " + ".join(f"(COUNT(*) - COUNT({q(c)}))" for c, _ in cols)
    with_missing = " + ".join(f"(CASE WHEN COUNT(*) > COUNT({q(c)}) THEN 1 ELSE 0 END)" for c, _ in cols)
    consts = " + ".join(
        f"(CASE WHEN COUNT(DISTINCT {q(c)}) + MAX(CASE WHEN {q(c)} IS NULL THEN 1 ELSE 0 END) <= 1 THEN 1 ELSE 0 END)"
        for c, _ in cols)
    strings = [c for c, t in cols if t == "string"]
    hc50 = " + ".join(f"(CASE WHEN COUNT(DISTINCT {q(c)}) >= 50 THEN 1 ELSE 0 END)" for c in strings) or "0"
    hc100 = " + ".join(f"(CASE WHEN COUNT(DISTINCT {q(c)}) >= 100 THEN 1 ELSE 0 END)" for c in strings) or "0"
    return f"""t AS ({SRC[name]}),
prof AS (SELECT COUNT(*) AS nrows, {len(cols)} AS ncols,
  COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {allc} FROM t)) AS dups,
  {missing} AS missing_cells, {with_missing} AS cols_missing, {consts} AS consts,
  {hc50} AS hc50, {hc100} AS hc100, SUM({_bytes_expr(name)}) AS bytes FROM t)"""


_HS = ("100.0 - missing_cells * 1.0 / GREATEST(nrows * ncols, 1) * 40 - dups * 1.0 / GREATEST(nrows, 1) * 20 "
       "- consts * 1.0 / GREATEST(ncols, 1) * 20 - hc50 * 1.0 / GREATEST(ncols, 1) * 20")
HEALTH_TABLES = ("lineitem_n", "nation_dup", "part", "documents")


@register("health_score", union_all([
    f"(WITH {_prof_sql(n)} SELECT '{n}' AS tbl, ROUND(GREATEST({_HS}, 0.0), 2) AS health_score FROM prof)"
    for n in HEALTH_TABLES]))
def health_score(spark, sf):
    return _union_tables(lambda n: H.health_score(_load(spark, sf, n)), HEALTH_TABLES)


def _health_report_sql(n):
    return f"""(WITH {_prof_sql(n)} SELECT '{n}' AS tbl,
  ROUND(GREATEST(100.0 - CASE WHEN missing_cells * 1.0 / GREATEST(nrows * ncols, 1) > 0.2 THEN 20 ELSE 0 END
    - CASE WHEN dups > 0 THEN 10 ELSE 0 END - CASE WHEN consts > 0 THEN 5 ELSE 0 END
    - CASE WHEN hc100 > 0 THEN 5 ELSE 0 END, 0.0), 1) AS score,
  concat_ws(' | ', CASE WHEN missing_cells * 1.0 / GREATEST(nrows * ncols, 1) > 0.2 THEN '{H.MSG_HIGH_MISSING}' END,
    CASE WHEN dups > 0 THEN dups || ' duplicate rows detected.' END,
    CASE WHEN consts > 0 THEN '{H.MSG_CONSTANT}' END, CASE WHEN hc100 > 0 THEN '{H.MSG_HIGH_CARD}' END) AS warnings,
  concat_ws(' | ', CASE WHEN missing_cells * 1.0 / GREATEST(nrows * ncols, 1) > 0.2 THEN '{H.REC_HIGH_MISSING}' END,
    CASE WHEN dups > 0 THEN '{H.REC_DUPLICATES}' END,
    CASE WHEN consts > 0 THEN '{H.REC_CONSTANT}' END, CASE WHEN hc100 > 0 THEN '{H.REC_HIGH_CARD}' END)
    AS recommendations FROM prof)"""


@register("health_report", union_all([_health_report_sql(n) for n in HEALTH_TABLES]))
def health_report(spark, sf):
    return _union_tables(lambda n: H.health_report(_load(spark, sf, n)).select(
        "score", F.array_join("warnings", " | ").alias("warnings"),
        F.array_join("recommendations", " | ").alias("recommendations")), HEALTH_TABLES)


@register("quality_issues", union_all([
    f"""(WITH {_prof_sql(n)}, items AS (
  SELECT 0 AS k, CASE WHEN dups > 0 THEN dups || ' duplicate rows detected.' END AS issue FROM prof
  UNION ALL SELECT 1, CASE WHEN consts > 0 THEN consts || ' constant-value columns detected.' END FROM prof
  UNION ALL SELECT 2, CASE WHEN cols_missing > 0 THEN cols_missing || ' columns contain missing values.' END FROM prof
  UNION ALL SELECT 3, CASE WHEN hc50 > 0 THEN hc50 || ' high-cardinality columns detected.' END FROM prof)
  SELECT '{n}' AS tbl, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS seq, issue
  FROM items WHERE issue IS NOT NULL)""" for n in HEALTH_TABLES]))
def quality_issues(spark, sf):
    return _union_tables(lambda n: H.quality_issues(_load(spark, sf, n)), HEALTH_TABLES)


def _group_counts_sql(name, eda):
    if eda:
        rule = "u * 1.0 / nrows > 0.70 OR avg_len0 > 25"
    else:
        rule = "u * 1.0 / nrows >= 0.70"
    return f"""g AS (SELECT CASE WHEN kind = 'string' THEN CASE WHEN {rule} THEN 'text' ELSE 'categorical' END
  ELSE kind END AS grp FROM cs)"""


PROFILE_TABLES = ("documents", "lineitem_n", "orders_n")


@register("inspect_dataset", union_all([
    f"""(WITH {_prof_sql(n)}, {_colstats_sql(n).split(', cs AS', 1)[0].replace('t AS', 't2 AS', 1)},
  cs AS ({_colstats_sql(n).split('cs AS (', 1)[1][:-1]}), {_group_counts_sql(n, False)}
  SELECT '{n}' AS tbl, CAST(nrows AS BIGINT) AS rows, CAST(ncols AS BIGINT) AS columns,
    CAST(dups AS BIGINT) AS duplicate_rows, CAST(consts AS BIGINT) AS constant_columns,
    CAST(hc50 AS BIGINT) AS high_cardinality_columns, ROUND(bytes / 1048576.0, 2) AS memory_mb,
    ROUND(GREATEST({_HS}, 0.0), 2) AS health_score,
    (SELECT COUNT(*) FROM g WHERE grp = 'numeric') AS numeric_features,
    (SELECT COUNT(*) FROM g WHERE grp IN ('categorical', 'text')) AS categorical_features,
    (SELECT COUNT(*) FROM g WHERE grp = 'boolean') AS boolean_features,
    (SELECT COUNT(*) FROM g WHERE grp = 'datetime') AS datetime_features,
    (SELECT COUNT(*) FROM g WHERE grp = 'text') AS text_features
  FROM prof)""" for n in PROFILE_TABLES]))
def inspect_dataset(spark, sf):
    return _union_tables(lambda n: H.inspect_dataset(_load(spark, sf, n)), PROFILE_TABLES)


def _summary_sql(n):
    return f"""(WITH {_prof_sql(n)}, {_colstats_sql(n).split(', cs AS', 1)[0].replace('t AS', 't2 AS', 1)},
  cs AS ({_colstats_sql(n).split('cs AS (', 1)[1][:-1]}), {_group_counts_sql(n, True)}
  SELECT '{n}' AS tbl, CAST(nrows AS BIGINT) AS rows, CAST(ncols AS BIGINT) AS columns,
    CAST(missing_cells AS BIGINT) AS missing_cells,
    CAST(dups AS BIGINT) AS duplicate_rows, CAST(consts AS BIGINT) AS constant_columns,
    CAST(hc100 AS BIGINT) AS high_cardinality_columns, ROUND(bytes / 1048576.0, 2) AS memory_mb,
    (SELECT COUNT(*) FROM g WHERE grp = 'numeric') AS numeric_features,
    (SELECT COUNT(*) FROM g WHERE grp = 'categorical') AS categorical_features,
    (SELECT COUNT(*) FROM g WHERE grp = 'boolean') AS boolean_features,
    (SELECT COUNT(*) FROM g WHERE grp = 'datetime') AS datetime_features,
    (SELECT COUNT(*) FROM g WHERE grp = 'text') AS text_features
  FROM prof)"""


@register("summarize_dataset", union_all([_summary_sql(n) for n in PROFILE_TABLES]))
def summarize_dataset(spark, sf):
    return _union_tables(lambda n: H.summarize_dataset(_load(spark, sf, n)), PROFILE_TABLES)


_MOMENTS = ["count", "unique", "freq", "mean", "std", "min", "q25", "q50", "q75", "max"]


def _long_sql(section, key, numbers, texts, sql):
    """A section's values as (section, item, name, number, text) rows."""
    rows = [f"SELECT '{section}' AS section, {key} AS item, '{c}' AS name, ROUND(CAST({q(c)} AS DOUBLE), 6) AS number, "
            f"CAST(NULL AS VARCHAR) AS text FROM s" for c in numbers]
    rows += [f"SELECT '{section}', {key}, '{c}', CAST(NULL AS DOUBLE), {q(c)} FROM s" for c in texts]
    return f"(WITH s AS ({sql}) {union_all(rows)})"


def _eda_sql():
    n = "orders_n"
    missing = f"WITH t AS ({SRC[n]}) " + union_all([
        f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({q(c)}) AS missing_values, "
        f"ROUND((COUNT(*) - COUNT({q(c)})) * 100.0 / COUNT(*), 2) AS percentage FROM t" for c, _ in COLS[n]])
    duplicates = (f"WITH t AS ({SRC[n]}), g AS (SELECT COUNT(*) AS n FROM t GROUP BY {', '.join(q(c) for c, _ in COLS[n])}) "
                  "SELECT SUM(n) AS rows, SUM(n - 1) AS duplicate_rows, ROUND(100.0 * SUM(n - 1) / SUM(n), 2) AS duplicate_percent FROM g")
    return union_all([
        _long_sql("summary", "''", ["rows", "columns", "missing_cells", "duplicate_rows", "constant_columns",
                                    "high_cardinality_columns", "memory_mb", *[f"{g}_features" for g in (
                                        "numeric", "categorical", "boolean", "datetime", "text")]], [], _summary_sql(n)),
        _long_sql("health", "''", ["score"], ["warnings", "recommendations"], _health_report_sql(n)),
        _long_sql("missing", '"column"', ["missing_values", "percentage"], [], missing),
        _long_sql("duplicates", "''", ["rows", "duplicate_rows", "duplicate_percent"], [], duplicates),
        _long_sql("statistics", '"column"', _MOMENTS, ["top"], _describe_sql()),
        _long_sql("correlation", "x || ' ' || y", ["r"], [], _corr_sql([c for c, t in COLS[n] if t in NUMERIC], SRC[n]))])


def _long(section, d: DataFrame) -> DataFrame:
    """A section's values as (section, item, name, number, text) rows."""
    keys = [c for c in ("column", "x", "y") if c in d.columns]
    cells = []
    for f in d.schema.fields:
        if f.name in keys:
            continue
        number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
        if isinstance(f.dataType, T.StringType):
            text = F.col(f.name)
        elif isinstance(f.dataType, T.ArrayType):
            text = F.array_join(f.name, " | ")
        else:
            number = F.round(F.col(f.name).cast("double"), 6)
        cells.append(F.struct(F.lit(f.name).alias("name"), number.alias("number"), text.alias("text")))
    return d.select(F.lit(section).alias("section"), F.concat_ws(" ", *keys).alias("item"), F.inline(F.array(*cells)))


@register("eda_report", _eda_sql())
def eda_report(spark, sf):
    """Every value of all EDA sections of ``orders`` in long form."""
    parts = H.eda_report(orders_n(spark, sf))
    return reduce(DataFrame.unionByName, [_long(k, d) for k, d in parts.items()])
