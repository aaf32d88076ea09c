"""Left join of a fact table to a dimension with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_dimension(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Every fact row once, with the dimension's columns.

    How the two meet is left to Spark: a dimension within the session's broadcast limit is broadcast, by its estimated or,
    after its own stage, its real size, and the fact table is not sorted. A larger one is joined by shuffle, where adaptive
    execution splits the partition of a hot key over as many tasks as its bytes ask for and repeats the one dimension row.
    """
    return fact.join(dimension, key, "left")
