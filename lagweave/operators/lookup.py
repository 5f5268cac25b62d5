"""Equi-join of a long table with one row per key."""

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join `table`, which has one row per `on`, to every row of `df`.

    The plan is Spark's choice. Scalers, coefficients and catalogs are stored tables, whose size Spark knows: small ones
    go to the executors and `df` does not move. A larger one is joined by shuffle, where adaptive execution splits the
    rows of a hot key over several tasks. Write a computed table first (`sources.shared.stored`), since the size of a plan that was not run is
    a guess.
    """
    return df.join(table, list(on), how)
