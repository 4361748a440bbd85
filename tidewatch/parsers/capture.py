"""Values that are worked out once for each line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    A plain column is recomputed inside every filter that the optimizer pushes below it; a one-element
    explode keeps such filters above, which matters when the value costs several passes over the line.
    """
    return df.withColumn(name, F.explode(F.array(value)))
