"""Feature-generator queries."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import functions as F

from strata.operators import features as FE
from strata.plans import engineer as EN
from strata.queries import register, table
from strata.queries.common import LINEITEM_N_SQL, lineitem_n, q, round_doubles

# Unicode White_Space for DuckDB's RE2 (its \s is ASCII only)
WS_RE2 = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NUM4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _r(e, d=6):
    return f"ROUND({e}, {d})"


def _div(a, b):
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


@register("safe_divide", """
SELECT l_orderkey, l_linenumber,
  l_quantity / NULLIF(l_discount, 0) AS div_null,
  COALESCE(l_quantity / NULLIF(l_discount, 0), 0.0) AS div_default,
  ROUND(COALESCE(l_discount * 100.0 / NULLIF(l_tax, 0), 0.0), 2) AS pct,
  GREATEST(10.0, LEAST(40.0, l_quantity)) AS clamped
FROM lineitem""")
def safe_divide(spark, sf):
    from strata.functions.columns import safe_div
    d = table(spark, sf, "lineitem")
    return d.select("l_orderkey", "l_linenumber",
                    safe_div(F.col("l_quantity"), F.col("l_discount")).alias("div_null"),
                    FE.safe_divide_scalar(F.col("l_quantity"), F.col("l_discount")).alias("div_default"),
                    FE.percentage(F.col("l_discount"), F.col("l_tax")).alias("pct"),
                    FE.clamp(F.col("l_quantity"), 10.0, 40.0).alias("clamped"))


_L8 = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"] + NUM4
_PAIRS = list(combinations(_L8, 2))


@register("interactions", "SELECT " + ", ".join(
    [f"{_r(f'CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE)')} AS {a}_x_{b}" for a, b in _PAIRS]) + " FROM lineitem")
def interactions(spark, sf):
    d = table(spark, sf, "lineitem")
    out, names = FE.interactions(d, _L8)
    return round_doubles(out.select(*names))


@register("ratios", "SELECT " + ", ".join(
    [f"{_r(_div(a, b))} AS {a}_div_{b}" for a, b in _PAIRS]) + " FROM lineitem")
def ratios(spark, sf):
    out, names = FE.ratios(table(spark, sf, "lineitem"), _L8)
    return round_doubles(out.select(*names))


_RA = ["l_quantity", "l_discount", "l_tax", "qty_n", "half_null", "empty_c"]
_RA_LIST = "list_filter([" + ", ".join(f"CAST({c} AS DOUBLE)" for c in _RA) + "], lambda x: x IS NOT NULL)"


@register("row_aggregates", f"""
SELECT l_orderkey, l_linenumber,
  ROUND(COALESCE(list_sum({_RA_LIST}), 0.0), 6) AS row_sum,
  ROUND(list_avg({_RA_LIST}), 6) AS row_mean,
  ROUND(CASE WHEN len({_RA_LIST}) >= 2 THEN list_stddev_samp({_RA_LIST}) END, 6) AS row_std,
  ROUND(list_min({_RA_LIST}), 6) AS row_min, ROUND(list_max({_RA_LIST}), 6) AS row_max,
  ROUND(list_max({_RA_LIST}) - list_min({_RA_LIST}), 6) AS row_range
FROM ({LINEITEM_N_SQL})""")
def row_aggregates(spark, sf):
    d = lineitem_n(spark, sf)
    out, names = FE.row_aggregates(d, _RA)
    return round_doubles(out.select("l_orderkey", "l_linenumber", *names))


_POLY = ["l_quantity", "l_discount", "l_tax"]


def _poly_sql():
    items = []
    for combo in combinations_with_replacement(_POLY, 2):
        a, b = combo
        name = f"{a}^2" if a == b else f"{a} {b}"
        items.append(f"{_r(f'{a} * {b}')} AS {q(name)}")
    return "SELECT " + ", ".join(items) + " FROM lineitem"


@register("polynomial", _poly_sql())
def polynomial(spark, sf):
    out, names = FE.polynomial(table(spark, sf, "lineitem"), _POLY, 2)
    return round_doubles(out.select(*names))


_LOGSRC = ("SELECT l_quantity, l_discount, l_tax, l_quantity - 25 AS centered, "
           "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS price_n FROM lineitem")
_LOGCOLS = ["l_quantity", "l_discount", "l_tax", "centered", "price_n"]


def _logsrc(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_quantity", "l_discount", "l_tax", "l_quantity - 25 AS centered",
        "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS price_n")


@register("log_features", f"""
SELECT {', '.join(f"{_r(f'ln(1 + {c})', 9)} AS {c}_log" for c in _LOGCOLS if c != 'centered')}
FROM ({_LOGSRC})""")
def log_features(spark, sf):
    out, names = FE.log_features(_logsrc(spark, sf), _LOGCOLS)
    return round_doubles(out.select(*names), 9)


@register("sqrt_features", f"""
SELECT {', '.join(f"sqrt({c}) AS {c}_sqrt" for c in _LOGCOLS if c != 'centered')}
FROM ({_LOGSRC})""")
def sqrt_features(spark, sf):
    out, names = FE.sqrt_features(_logsrc(spark, sf), _LOGCOLS)
    return out.select(*names)


@register("squared", f"SELECT {', '.join(f'{c} * {c} AS {c}_squared' for c in _LOGCOLS)} FROM ({_LOGSRC})")
def squared(spark, sf):
    out, names = FE.squared(_logsrc(spark, sf), _LOGCOLS)
    return out.select(*names)


@register("cubed", f"SELECT {', '.join(f'{c} * {c} * {c} AS {c}_cubed' for c in _LOGCOLS)} FROM ({_LOGSRC})")
def cubed(spark, sf):
    out, names = FE.cubed(_logsrc(spark, sf), _LOGCOLS)
    return out.select(*names)


@register("absolute", f"SELECT {', '.join(f'ABS({c}) AS {c}_abs' for c in _LOGCOLS)} FROM ({_LOGSRC})")
def absolute(spark, sf):
    out, names = FE.absolute(_logsrc(spark, sf), _LOGCOLS)
    return out.select(*names)


@register("reciprocal", f"SELECT {', '.join(f'1.0 / NULLIF({c}, 0) AS {c}_reciprocal' for c in _LOGCOLS)} "
          f"FROM ({_LOGSRC})")
def reciprocal(spark, sf):
    out, names = FE.reciprocal(_logsrc(spark, sf), _LOGCOLS)
    return out.select(*names)


# --- engineer_numeric over a small lineitem projection ----------------------

_EN_SRC = ("SELECT l_quantity, l_discount, l_tax, "
           "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty_n, "
           "CAST(NULL AS DOUBLE) AS empty_c, CAST(1.0 AS DOUBLE) AS const_c, l_returnflag FROM lineitem")
_EN_NUM = ["l_quantity", "l_discount", "l_tax", "qty_n", "empty_c", "const_c"]


def _engineer_numeric_sql():
    keep = ["l_quantity", "l_discount", "l_tax", "qty_n", "l_returnflag"]
    items = [f"{c}" for c in keep]
    live = ["l_quantity", "l_discount", "l_tax", "qty_n"]     # empty_c → all null, const_c → constant
    for a, b in combinations(_EN_NUM, 2):
        if a in live and b in live:
            items.append(f"{_r(f'{a} * {b}')} AS {a}_x_{b}")
        elif a in live and b == "const_c":
            items.append(f"{_r(f'{a} * {b}')} AS {a}_x_{b}")
    for a, b in combinations(_EN_NUM, 2):
        if a in live and b in live:
            items.append(f"{_r(_div(a, b))} AS {a}_div_{b}")
        elif a in live and b == "const_c":
            items.append(f"{_r(_div(a, b))} AS {a}_div_{b}")
    vals = "list_filter([" + ", ".join(_EN_NUM) + "], lambda x: x IS NOT NULL)"
    items += [f"{_r(f'COALESCE(list_sum({vals}), 0.0)')} AS row_sum", f"{_r(f'list_avg({vals})')} AS row_mean",
              f"{_r(f'CASE WHEN len({vals}) >= 2 THEN list_stddev_samp({vals}) END')} AS row_std",
              f"{_r(f'list_min({vals})')} AS row_min", f"{_r(f'list_max({vals})')} AS row_max",
              f"{_r(f'list_max({vals}) - list_min({vals})')} AS row_range"]
    items += [f"{_r(f'ln(1 + {c})', 6)} AS {c}_log" for c in live]
    items += [f"{_r(f'sqrt({c})')} AS {c}_sqrt" for c in live]
    items += [f"{_r(f'{c} * {c}')} AS {c}_squared" for c in live]
    items += [f"{_r(f'{c} * {c} * {c}')} AS {c}_cubed" for c in live]
    items += [f"{_r(f'ABS({c})')} AS {c}_abs" for c in live]
    items += [f"{_r(f'1.0 / NULLIF({c}, 0)')} AS {c}_reciprocal" for c in live]
    return "SELECT " + ", ".join(items) + f" FROM ({_EN_SRC})"


@register("engineer_numeric", _engineer_numeric_sql())
def engineer_numeric(spark, sf):
    d = table(spark, sf, "lineitem").selectExpr(
        "l_quantity", "l_discount", "l_tax", "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty_n",
        "CAST(NULL AS DOUBLE) AS empty_c", "CAST(1.0 AS DOUBLE) AS const_c", "l_returnflag")
    out, _ = EN.engineer_numeric(d)
    return round_doubles(out)


# --- dates --------------------------------------------------------------------

def _parts_sql(c, with_time):
    items = [f"CAST(year({c}) AS INTEGER) AS {c}_year", f"CAST(quarter({c}) AS INTEGER) AS {c}_quarter",
             f"CAST(month({c}) AS INTEGER) AS {c}_month", f"CAST(weekofyear({c}) AS INTEGER) AS {c}_week",
             f"CAST(day({c}) AS INTEGER) AS {c}_day", f"CAST(isodow({c}) - 1 AS INTEGER) AS {c}_dayofweek",
             f"CAST(dayofyear({c}) AS INTEGER) AS {c}_dayofyear"]
    if with_time:
        items += [f"CAST(hour({c}) AS INTEGER) AS {c}_hour", f"CAST(minute({c}) AS INTEGER) AS {c}_minute"]
    items.append(f"CAST(COALESCE(isodow({c}) >= 6, FALSE) AS INTEGER) AS {c}_is_weekend")
    return items


_EV_TS = ("SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS ts FROM events")


@register("date_parts", f"SELECT event_id, ts, {', '.join(_parts_sql('ts', True))} FROM ({_EV_TS})")
def date_parts(spark, sf):
    d = table(spark, sf, "events").selectExpr("event_id",
                                              "CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS ts")
    return FE.date_part_features(d, ["ts"], with_time=True)[0]


def _cyc_sql(c):
    parts = {"month": f"month({c})", "day": f"day({c})", "dayofweek": f"(isodow({c}) - 1)",
             "dayofyear": f"dayofyear({c})", "hour": f"hour({c})", "minute": f"minute({c})"}
    periods = {"month": 12, "day": 31, "dayofweek": 7, "dayofyear": 365, "hour": 24, "minute": 60}
    items = []
    for k, e in parts.items():
        ang = f"(2 * pi() * COALESCE(CAST({e} AS DOUBLE), 0.0) / {periods[k]}.0)"
        items += [f"ROUND(sin({ang}), 9) + 0.0 AS {c}_{k}_sin", f"ROUND(cos({ang}), 9) + 0.0 AS {c}_{k}_cos"]
    return items


@register("cyclical", f"SELECT event_id, {', '.join(_cyc_sql('ts'))} FROM ({_EV_TS})")
def cyclical(spark, sf):
    d = table(spark, sf, "events").selectExpr("event_id",
                                              "CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS ts")
    out, names = FE.cyclical_features(d, ["ts"])
    return round_doubles(out.select("event_id", *names), 9)


# --- text ---------------------------------------------------------------------

def _clean_sql(c):
    s = f"lower(COALESCE({c}, ''))"
    s = f"regexp_replace({s}, '^{WS_RE2}+', '')"
    s = f"regexp_replace({s}, '{WS_RE2}+$', '')"
    return f"regexp_replace({s}, '{WS_RE2}+', ' ', 'g')"


@register("clean_text", f"""
SELECT conv_id, turn, {_clean_sql('text')} AS text FROM conversations
UNION ALL SELECT doc_id, -1, {_clean_sql('text')} FROM documents""")
def clean_text(spark, sf):
    c = FE.clean_text_columns(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["text"])
    d = FE.clean_text_columns(table(spark, sf, "documents").select(
        F.col("doc_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), "text"), ["text"])
    return c.unionByName(d)


@register("text_lengths", f"""
SELECT doc_id, COALESCE(text, '') AS text, CAST(length(COALESCE(text, '')) AS INTEGER) AS text_length,
  CAST(len(list_filter(regexp_split_to_array(COALESCE(text, ''), '{WS_RE2}+'), lambda x: x <> '')) AS INTEGER)
    AS text_word_count,
  lang, CAST(length(lang) AS INTEGER) AS lang_length,
  CAST(len(list_filter(regexp_split_to_array(lang, '{WS_RE2}+'), lambda x: x <> '')) AS INTEGER) AS lang_word_count
FROM documents""")
def text_lengths(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return FE.text_length_features(d, ["text", "lang"])[0]


@register("format_numbers", """
SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS price_text, format('{:,}', o_custkey * 1000) AS cust_text,
  CASE WHEN o_totalprice < 1024 THEN format('{:.2f}', o_totalprice) || ' B'
       WHEN o_totalprice / 1024 < 1024 THEN format('{:.2f}', o_totalprice / 1024) || ' KB'
       ELSE format('{:.2f}', o_totalprice / 1048576) || ' MB' END AS size_text,
  CASE WHEN o_totalprice / 1000 < 60 THEN format('{:.2f}', o_totalprice / 1000) || ' sec'
       WHEN o_totalprice / 1000 / 60 < 60 THEN format('{:.2f}', o_totalprice / 1000 / 60) || ' min'
       ELSE format('{:.2f}', o_totalprice / 1000 / 60 / 60) || ' hr' END AS duration_text
FROM orders""")
def format_numbers(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey",
                    FE.format_number(F.col("o_totalprice"), 2).alias("price_text"),
                    FE.format_number(F.col("o_custkey") * 1000, integral=True).alias("cust_text"),
                    FE.format_bytes(F.col("o_totalprice")).alias("size_text"),
                    FE.format_duration(F.col("o_totalprice") / 1000).alias("duration_text"))
