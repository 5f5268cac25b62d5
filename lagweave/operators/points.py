"""Rows behind prediction charts."""

from pyspark.sql import DataFrame, functions as F


def first_test_points(scored: DataFrame, n: int = 96) -> DataFrame:
    """The first n test windows of each key. A filter on the window number, so nothing is sorted or gathered."""
    point = F.col("idx") - F.col("n_train")
    return scored.where((point >= 1) & (point <= n)).withColumn("point", point)
