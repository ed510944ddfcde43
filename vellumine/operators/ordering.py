"""Global row numbers without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_row_number(df: DataFrame, bucket: Column, order: list[str | Column], out: str) -> DataFrame:
    """``row_number`` over a total order. ``bucket`` must never fall along ``order``: rows are
    numbered within buckets, and only the buckets' counts are summed in one place."""
    keyed = df.withColumn("_b", bucket)
    ahead = keyed.groupBy(F.col("_b").alias("_k")).count()
    ahead = ahead.select("_k", (F.sum("count").over(Window.orderBy("_k")) - F.col("count")).alias("_ahead"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    numbered = keyed.withColumn("_n", local).join(ahead, F.col("_b") == F.col("_k"))
    return numbered.withColumn(out, (F.col("_ahead") + F.col("_n")).cast("long")).drop("_b", "_k", "_n", "_ahead")
