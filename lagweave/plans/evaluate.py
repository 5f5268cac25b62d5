"""Score test windows, undo the scaling, report."""

from pyspark.sql import DataFrame, functions as F

from ..operators.compare import model_summary
from ..operators.evaluate import as_predictions, regression_report
from ..operators.forecast import choose_models, fit_model, score_ar, score_chosen, with_previous_period
from ..operators.scale import unscale
from ..operators.select import with_location
from ..operators.windows import lag_windows
from ..sources.shared import stored
from ..sources.store import materialise


BASELINES = ("naive", "seasonal_naive", "ar1")
SCORED = ("site_id", "location", "ts", "split", "idx", "n_train", "x_min", "x_max", "previous", "lag_1", "y")


def baseline_predictions(series: DataFrame, unscaled: bool = True, **how) -> DataFrame:
    """Test predictions of naive, seasonal_naive and ar1: (site_id, location, ts, model_type, y, y_hat).

    The windows are computed and stored once, with the columns these models need; fit and scoring read them.
    """
    return predictions_of(lag_windows(with_previous_period(series), **how), unscaled)


def predictions_of(windows: DataFrame, unscaled: bool = True) -> DataFrame:
    """`baseline_predictions` from windows with `previous`."""
    windows = stored(windows.select(*SCORED), "windows")
    fitted = [fit_model(m, windows) for m in BASELINES]
    coefs = stored(fitted[0].unionByName(fitted[1]).unionByName(fitted[2]), "coefficients")
    scored = score_ar(windows.where(F.col("split") == "test"), coefs)
    return as_predictions(unscale(scored) if unscaled else scored)


def evaluate_sites(windows: DataFrame, coefs: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metrics per site and model with location, summary per model) for a coefficient table of any model types.

    Sites without a model drop out. Filter `windows` to a site to evaluate only that one.
    """
    scored = score_ar(windows.where(F.col("split") == "test"), coefs.select("site_id", "model_type", "coef"))
    return _report(scored, sites)


def evaluate_stored(
    windows: DataFrame, per_site: DataFrame, pooled: dict, sites: DataFrame, path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Load, choose, score, report: sites without models of their own use the pooled MLlib models.

    `per_site` is a coefficient table, `pooled` has MLlib models by type. With `path`, metrics and summary are written there as
    CSV and read back.
    """
    spark = windows.sparkSession
    types = spark.createDataFrame([(m, None) for m in pooled], "model_type string, coef array<double>")
    chosen = stored(choose_models(per_site, types, sites), "chosen")
    metrics, summary = _report(score_chosen(windows.where(F.col("split") == "test"), chosen, pooled), sites)
    if not path:
        return metrics, summary
    out = []
    for name, table in (("metrics", metrics), ("summary", summary)):
        materialise(table, f"{path}/{name}", force=True, fmt="csv")
        out.append(spark.read.schema(table.schema).csv(f"{path}/{name}", header=True))
    return out[0], out[1]


def _report(scored, sites):
    metrics = regression_report(unscale(scored))
    return with_location(metrics, sites), model_summary(metrics)


def evaluate_pooled(scored: DataFrame) -> DataFrame:
    """Metrics per model over the pooled test rows, in scaled units."""
    report = regression_report(scored, ["model_type"])
    return report.select(F.lit("combined").alias("site_id"), F.lit("Combined Dataset").alias("location"), "*")
