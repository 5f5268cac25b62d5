"""Min-max scaling expressions; a constant series scales to 0."""

from pyspark.sql import Column, functions as F


def span(lo: Column, hi: Column) -> Column:
    """Range of the fit set, 1 where it is a single value."""
    return F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)


def minmax(x: Column, lo: Column, hi: Column) -> Column:
    return (x - lo) / span(lo, hi)


def unminmax(x: Column, lo: Column, hi: Column) -> Column:
    return x * span(lo, hi) + lo
