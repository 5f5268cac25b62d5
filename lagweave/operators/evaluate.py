"""Six-metric evaluation."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.metrics import mape_eps, mse, regression_metrics


def as_predictions(scored: DataFrame, keys: Sequence[str] = ("site_id", "location", "ts")) -> DataFrame:
    return scored.select(*keys, "model_type", "y", "y_hat")


def join_truth(truth: DataFrame, predictions: DataFrame, on: Sequence[str] = ("site_id", "location", "ts")) -> DataFrame:
    """Align predictions with truth by key; the key is unique per observation, so no task gets a whole site."""
    return truth.join(predictions, list(on))


def regression_report(predictions: DataFrame, keys: Sequence[str] = ("site_id", "model_type")) -> DataFrame:
    """(keys, mape, rmse, r2, mae, mse, explained_variance); one shuffle of map-side partials."""
    return predictions.groupBy(*keys).agg(*regression_metrics(F.col("y"), F.col("y_hat")))


def training_summary(scored: DataFrame, keys: Sequence[str] = ("model_type",)) -> DataFrame:
    """(keys, loss, mape_eps) on scaled values: mean squared error and clamped percentage error."""
    y, p = F.col("y"), F.col("y_hat")
    return scored.groupBy(*keys).agg(mse(y, p).alias("loss"), mape_eps(y, p).alias("mape_eps"))
