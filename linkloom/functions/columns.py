"""Small helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column whose value is computed once, however many later expressions use it.

    The optimizer copies a plain column into every expression that uses it; it doesn't copy
    through the explosion of a list of one.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))
