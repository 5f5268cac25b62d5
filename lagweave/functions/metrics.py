"""Regression metrics as aggregate expressions over (truth, prediction).

Every one is a mean, variance or extremum, so Spark combines map-side and a hot key costs no more than any other.
"""

from pyspark.sql import Column, functions as F


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def r2(y: Column, p: Column) -> Column:
    """1 - SSE/SST. Constant truth: 1 if exact, else 0. Undefined (NaN) below two rows."""
    exact = F.max(F.abs(y - p)) == 0
    return (
        F.when(F.count(y - p) < 2, F.lit(float("nan")))
        .when(exact, F.lit(1.0))
        .when(F.min(y) == F.max(y), F.lit(0.0))
        .otherwise(1 - mse(y, p) / F.var_pop(y))
    )


def explained_variance(y: Column, p: Column) -> Column:
    """1 - Var(error)/Var(truth), with the same rule for constant truth."""
    e = y - p
    return (
        F.when(F.min(e) == F.max(e), F.lit(1.0))
        .when(F.min(y) == F.max(y), F.lit(0.0))
        .otherwise(1 - F.var_pop(e) / F.var_pop(y))
    )


def mape(y: Column, p: Column) -> Column:
    """Percentage error over rows with positive truth; 0 if there are none."""
    return F.coalesce(F.lit(100.0) * F.avg(F.when(y > 0, F.abs(y - p) / y)), F.lit(0.0))


def mape_eps(y: Column, p: Column, eps: float = 1e-7) -> Column:
    """Percentage error over all rows, denominator clamped from below."""
    return F.lit(100.0) * F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(eps)))


def regression_metrics(y: Column, p: Column) -> list[Column]:
    """The six-metric bundle, one aggregate each."""
    return [
        mape(y, p).alias("mape"),
        rmse(y, p).alias("rmse"),
        r2(y, p).alias("r2"),
        mae(y, p).alias("mae"),
        mse(y, p).alias("mse"),
        explained_variance(y, p).alias("explained_variance"),
    ]
