"""Encoding, scaling and engineered-feature queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from strata.operators import encode as E
from strata.plans import engineer as EN
from strata.plans import preprocess as PP
from strata.queries import register, table
from strata.queries.common import (LINEITEM_N_SQL, ORDERS_N_SQL, lineitem_n, orders_n, q,
                                   round_doubles)
from strata.queries.features_q import WS_RE2, _cyc_sql, _parts_sql

TRAIN_SQL = "md5(CAST(o_orderkey AS VARCHAR) || ':42') >= '33333333'"


@register("frequency_encode", f"""
WITH t AS ({ORDERS_N_SQL})
SELECT o_orderkey, prio_n, o_orderstatus,
  CAST(COUNT(*) OVER (PARTITION BY prio_n) AS DOUBLE) AS prio_n_frequency,
  CAST(COUNT(*) OVER (PARTITION BY o_orderstatus) AS DOUBLE) AS o_orderstatus_frequency
FROM t""")
def frequency_encode(spark, sf):
    d = orders_n(spark, sf).select("o_orderkey", "prio_n", "o_orderstatus")
    return E.frequency_encode(d, ["prio_n", "o_orderstatus"])[0]


@register("count_encode", f"""
WITH t AS ({ORDERS_N_SQL})
SELECT o_orderkey, prio_n, o_orderstatus,
  CASE WHEN prio_n IS NULL THEN NULL ELSE COUNT(*) OVER (PARTITION BY prio_n) END AS prio_n_count,
  COUNT(*) OVER (PARTITION BY o_orderstatus) AS o_orderstatus_count
FROM t""")
def count_encode(spark, sf):
    d = orders_n(spark, sf).select("o_orderkey", "prio_n", "o_orderstatus")
    return E.count_encode(d, ["prio_n", "o_orderstatus"])[0]


_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("one_hot", f"""
WITH t AS ({ORDERS_N_SQL})
SELECT o_orderkey, {', '.join(f"CASE WHEN prio_n = '{v}' THEN 1.0 ELSE 0.0 END AS {q('prio_n_' + v)}" for v in _PRIOS)},
  {', '.join(f"CASE WHEN o_orderstatus = '{v}' THEN 1.0 ELSE 0.0 END AS {q('o_orderstatus_' + v)}" for v in 'FOP')}
FROM t""")
def one_hot(spark, sf):
    d = orders_n(spark, sf).select("o_orderkey", "prio_n", "o_orderstatus")
    return E.one_hot_columns(d, ["prio_n", "o_orderstatus"])[0]


@register("ordinal", f"""
WITH t AS ({ORDERS_N_SQL}),
cats AS (SELECT prio_n AS v, CAST(row_number() OVER (ORDER BY prio_n) - 1 AS DOUBLE) AS i
         FROM (SELECT DISTINCT prio_n FROM t WHERE {TRAIN_SQL} AND prio_n IS NOT NULL))
SELECT o_orderkey, COALESCE(cats.i, -1.0) AS prio_n FROM t LEFT JOIN cats ON t.prio_n = cats.v""")
def ordinal(spark, sf):
    d = orders_n(spark, sf).select("o_orderkey", "prio_n")
    train = d.filter(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":42"))) >= "33333333")
    cats = E.categories(train, ["prio_n"])
    return E.ordinal_columns(d, ["prio_n"], cats)


_SC = ["l_quantity", "l_extendedprice", "qty_n", "const_c"]


def _scaled_sql(method):
    items, aggs = [], []
    for i, c in enumerate(_SC):
        if method == "standard":
            aggs += [f"AVG({c}) AS a{i}", f"COALESCE(NULLIF(STDDEV_POP({c}), 0), 1.0) AS b{i}"]
        elif method == "minmax":
            aggs += [f"MIN({c}) AS a{i}", f"COALESCE(NULLIF(MAX({c}) - MIN({c}), 0), 1.0) AS b{i}"]
        else:
            aggs += [f"QUANTILE_CONT({c}, 0.5) AS a{i}",
                     f"COALESCE(NULLIF(QUANTILE_CONT({c}, 0.75) - QUANTILE_CONT({c}, 0.25), 0), 1.0) AS b{i}"]
        items.append(f"ROUND(({c} - a{i}) / b{i}, 6) AS {c}")
    return (f"WITH t AS ({LINEITEM_N_SQL}), s AS (SELECT {', '.join(aggs)} FROM t) "
            f"SELECT l_orderkey, l_linenumber, {', '.join(items)} FROM t, s")


def _scaled(spark, sf, method):
    d = lineitem_n(spark, sf).select("l_orderkey", "l_linenumber", *_SC)
    return round_doubles(E.scale(d, _SC, method))


@register("scale_standard", _scaled_sql("standard"))
def scale_standard(spark, sf):
    return _scaled(spark, sf, "standard")


@register("scale_minmax", _scaled_sql("minmax"))
def scale_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


@register("scale_robust", _scaled_sql("robust"))
def scale_robust(spark, sf):
    return _scaled(spark, sf, "robust")


# --- engineer_features on orders (target o_orderstatus) ----------------------

def _engineer_features_sql():
    num = ["o_orderkey", "o_custkey", "o_totalprice"]

    def r(e):
        return e

    def r6(e):
        return f"ROUND({e}, 6)"

    d = {c: f"CAST({c} AS DOUBLE)" for c in num}
    items = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    items += [f"{r(f'{d[a]} * {d[b]}')} AS {a}_x_{b}" for a, b in combinations(num, 2)]
    items += [f"{r(f'{d[a]} / NULLIF({d[b]}, 0)')} AS {a}_div_{b}" for a, b in combinations(num, 2)]
    lst = "[" + ", ".join(d[c] for c in num) + "]"
    items += [f"{r(f'list_sum({lst})')} AS row_sum", f"{r6(f'list_avg({lst})')} AS row_mean",
              f"{r6(f'list_stddev_samp({lst})')} AS row_std", f"{r(f'list_min({lst})')} AS row_min",
              f"{r(f'list_max({lst})')} AS row_max", f"{r(f'list_max({lst}) - list_min({lst})')} AS row_range"]
    items += [f"{r6(f'ln(1 + {d[c]})')} AS {c}_log" for c in num]
    items += [f"{r(f'sqrt({d[c]})')} AS {c}_sqrt" for c in num]
    items += [f"{r(f'{d[c]} * {d[c]}')} AS {c}_squared" for c in num]
    items += [f"{r(f'{d[c]} * {d[c]} * {d[c]}')} AS {c}_cubed" for c in num]
    items += [f"{r(f'ABS({d[c]})')} AS {c}_abs" for c in num]
    items += [f"{r(f'1.0 / NULLIF({d[c]}, 0)')} AS {c}_reciprocal" for c in num]
    items += [p for p in _parts_sql("o_orderdate", False)]
    items += [p.replace(" + 0.0", "") for p in _cyc_sql("o_orderdate")]
    ws = f"'{WS_RE2}+'"
    items += ["CAST(length(o_orderpriority) AS INTEGER) AS o_orderpriority_length",
              f"CAST(len(list_filter(regexp_split_to_array(o_orderpriority, {ws}), lambda x: x <> '')) AS INTEGER) "
              "AS o_orderpriority_word_count",
              "CAST(COUNT(*) OVER (PARTITION BY o_orderpriority) AS DOUBLE) AS o_orderpriority_frequency",
              "COUNT(*) OVER (PARTITION BY o_orderpriority) AS o_orderpriority_count"]
    return "SELECT " + ", ".join(items) + " FROM orders"


@register("engineer_features", _engineer_features_sql())
def engineer_features(spark, sf):
    out, _ = EN.engineer_features(table(spark, sf, "orders"), target="o_orderstatus")
    digits = {c: (9 if c.endswith(("_sin", "_cos")) else 6 if c.endswith("_log") or c in ("row_mean", "row_std")
                  else None) for c in out.columns}
    return round_doubles(out, 6, digits)


@register("build_preprocessor")
def build_preprocessor(spark, sf):
    """Fit the preprocessing pipeline on the training split of orders and
    return the assembled feature rows of all orders."""
    d = orders_n(spark, sf).drop("o_orderdate")
    pipe, _, _ = PP.build_preprocessor(d, target="o_orderstatus")
    train = d.filter(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":42"))) >= "33333333")
    model = pipe.fit(train)
    return model.transform(d).select("o_orderkey", "o_orderstatus", "features")


@register("prepare_training")
def prepare_training(spark, sf):
    data, feats, target, _pipe, _meta = PP.prepare_training(orders_n(spark, sf), "o_orderstatus")
    return data
