"""The bound of the categories that one-hot and ordinal encodings bring to the driver."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strata.operators import encode as E


def test_a_column_beyond_the_bound_raises_and_others_encode(spark):
    d = spark.range(60).select(F.col("id").cast("string").alias("many"), (F.col("id") % 3).cast("string").alias("few"))
    with pytest.raises(ValueError, match="many has 60 categories"):
        E.categories(d, ["few", "many"], max_categories=59)
    assert {c: len(v) for c, v in E.categories(d, ["few", "many"], max_categories=60).items()} == {"few": 3, "many": 60}
    assert len(E.categories(d, ["many"], max_categories=None)["many"]) == 60
    assert E.one_hot_columns(d, ["few"])[1] == ["few_0", "few_1", "few_2"]


def test_the_bound_holds_by_default(spark):
    d = spark.range(E.MAX_CATEGORIES + 1).select(F.col("id").cast("string").alias("c"))
    for encode in (E.one_hot_columns, E.ordinal_columns):
        with pytest.raises(ValueError, match=f"limit {E.MAX_CATEGORIES}"):
            encode(d, ["c"])
