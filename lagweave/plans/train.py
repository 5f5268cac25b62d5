"""Fit forecasters on a window table and store them."""

from pyspark.sql import DataFrame, SparkSession

from ..operators.forecast import LINEAR_MODELS, PER_KEY_MODELS, fit_model
from ..operators.windows import LENGTH
from ..sources.store import save_model, write_coefficients

def train_per_site(spark: SparkSession, windows: DataFrame, path: str, models=LINEAR_MODELS, length: int = LENGTH) -> DataFrame:
    """One model per site and type, each type for all sites in one job; a single site is the same with a filter on `windows`.

    Boosted trees (`boost`) are fitted where named; their rows stand in the same table. `windows` is read once per type, so pass a stored table. The result is read back and may be scored as it is.
    """
    for model_type in models:
        if model_type not in PER_KEY_MODELS:
            raise ValueError(f"unsupported model type: {model_type}")
        write_coefficients(fit_model(model_type, windows, length=length), f"{path}/model={model_type}")
    return spark.read.parquet(*[f"{path}/model={m}" for m in models]).select("site_id", "model_type", "coef")


def train_pooled(windows: DataFrame, folder: str, models=("linear",), length: int = LENGTH, all_sites: bool = False) -> dict[str, str]:
    """One MLlib model per type over all sites; returns where each was saved."""
    return {m: save_model(fit_model(m, windows, length=length), folder, m, all_sites) for m in models}


def pooled_coefficients(model, model_type: str = "linear") -> list[tuple[str, list[float]]]:
    """A pooled linear model as [intercept, lag_1, .., lag_L]; its features run oldest first."""
    return [(model_type, [float(model.intercept), *[float(c) for c in reversed(model.coefficients.toArray())]])]
