"""Joins that must not depend on the size of a side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """Rows of left whose column is NOT IN right's other column, as SQL means it: with a null on the right none is, and a null on
    the left isn't unless the right is empty. NOT IN itself would broadcast the right side whatever its size; this is an
    anti-join that Spark may shuffle, and one row of counts."""
    keys = right.select(F.col(other).alias("k"))
    counts = keys.agg(F.struct(F.count("*").alias("n"), F.count_if(F.col("k").isNull()).alias("nulls"))).scalar()
    return left.join(keys, left[column] == keys["k"], "left_anti").where((counts["n"] == 0) | (F.col(column).isNotNull() & (counts["nulls"] == 0)))
