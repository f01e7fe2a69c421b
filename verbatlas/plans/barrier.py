"""Where the optimizer should leave a filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition) over columns that are dear to compute.

    A plain filter is pushed below the projection and repeats the whole expression there once per
    reference, ending in a method too large to be compiled. Next to a column that isn't
    deterministic it stays where it is, over the computed columns.
    """
    return df.withColumn("_part", F.spark_partition_id()).where(condition & (F.col("_part") >= 0)).drop("_part")
