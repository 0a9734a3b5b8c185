"""Shared derived inputs and SQL text helpers for the registered queries.

The derived tables add nulls, constants and duplicates to the driver's tables
with recipes whose SQL text is identical in Spark SQL and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.queries import table

# derived-column recipes (same text in both engines)
LINEITEM_N_COLS = [
    "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty_n",
    "CASE WHEN l_orderkey % 3 = 0 THEN l_tax END AS mostly_null",
    "CASE WHEN l_orderkey % 2 = 0 THEN l_tax END AS half_null",
    "CASE WHEN l_orderkey % 1000 = 0 THEN l_quantity * 100 ELSE l_quantity END AS qty_out",
    "CAST(NULL AS DOUBLE) AS empty_c",
    "CAST(1.0 AS DOUBLE) AS const_c",
]
ORDERS_N_COLS = [
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS prio_n",
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice > 250000 END AS big_n",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price_n",
]
NATION_DUP_SQL = "SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_nationkey < 5"


def lineitem_n(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("*", *LINEITEM_N_COLS)


def orders_n(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("*", *ORDERS_N_COLS)


def nation_dup(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.unionByName(n.filter("n_nationkey < 5"))


LINEITEM_N_SQL = "SELECT *, " + ", ".join(LINEITEM_N_COLS) + " FROM lineitem"
ORDERS_N_SQL = "SELECT *, " + ", ".join(ORDERS_N_COLS) + " FROM orders"

# (name, spark simpleString) of the tables' columns, for generating oracle text
LINEITEM_COLS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
LINEITEM_N_EXTRA = [("qty_n", "double"), ("mostly_null", "double"), ("half_null", "double"),
                    ("qty_out", "double"), ("empty_c", "double"), ("const_c", "double")]
ORDERS_COLS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("o_orderpriority", "string")]
ORDERS_N_EXTRA = [("prio_n", "string"), ("big_n", "boolean"), ("price_n", "double")]
NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


#: rounded columns from which on a projection is kept out of whole-stage code
ROUND_APART = 12


def round_doubles(df: DataFrame, digits: int = 6, overrides: dict | None = None) -> DataFrame:
    """Round every double column (results are compared across engines);
    ``overrides`` maps column names to their own number of digits.

    Dozens of roundings in one whole-stage method are too long for the JVM's compiler,
    which then interprets them for every row.  A projection with a higher-order function
    is compiled by itself, in short methods; so one of many columns is rounded that way."""
    out, many = [], 0
    overrides = overrides or {}
    for f in df.schema.fields:
        c = F.col("`" + f.name + "`")
        d = overrides.get(f.name, digits)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and d is not None:
            many += 1
            value = c.cast("double")
            out.append((F.transform(F.array(value), lambda x: F.round(x, d))[0] if many == ROUND_APART
                        else F.round(value, d)).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)
