"""Min-max scaler as a parameter table."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scaling import minmax, unminmax
from .lookup import lookup


def minmax_fit(df: DataFrame, keys: Sequence[str], value: str = "flow", when: Column | None = None) -> DataFrame:
    """(keys, x_min, x_max) over all rows, or over those where `when` holds."""
    x = F.col(value) if when is None else F.when(when, F.col(value))
    return df.groupBy(*keys).agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"))


def minmax_transform(
    df: DataFrame, params: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("flow",)
) -> DataFrame:
    """Scale `columns`. Rows whose key has no parameters stay as they are."""
    return _apply(df, params, keys, columns, minmax)


def minmax_inverse(
    df: DataFrame, params: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("flow",)
) -> DataFrame:
    """Undo `minmax_transform`. Rows whose key has no parameters, such as pooled ones, stay as they are."""
    return _apply(df, params, keys, columns, unminmax)


def unscale(df: DataFrame, columns: Sequence[str] = ("y", "y_hat")) -> DataFrame:
    """Undo the scaling of rows that carry their own `x_min, x_max`."""
    lo, hi = F.col("x_min"), F.col("x_max")
    return df.withColumns({c: unminmax(F.col(c), lo, hi) for c in columns})


def _apply(df, params, keys, columns, formula):
    joined = lookup(df, params, keys, "left")
    lo, hi = F.col("x_min"), F.col("x_max")
    out = {c: F.when(lo.isNull(), F.col(c)).otherwise(formula(F.col(c), lo, hi)) for c in columns}
    return joined.withColumns(out).drop("x_min", "x_max")
