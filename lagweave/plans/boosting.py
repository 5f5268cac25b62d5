"""Queries on boosted trees and on tables of models of several types."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import boost, catalog, evaluate, forecast, history, windows as win
from ..sources.shared import compiled, stored
from . import evaluate as evaluation, queries as base
from .queries import read_table, rounded

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TREES = 2


def query(function):
    REGISTRY[function.__name__] = compiled(function)
    return function


def _train(spark, folder):
    return base.supplier_windows(spark, folder).where(F.col("split") == "train")


def _numbers(coefs):
    """One row per number of an ensemble."""
    return coefs.select(*[c for c in coefs.columns if c != "coef"], F.posexplode("coef").alias("place", "number"))


@query
def fit_histogram_boost(spark, folder):
    """Boosted trees of every supplier: all splits and leaves."""
    return _numbers(boost.fit_boost(_train(spark, folder), rounds=TREES)).drop("model_type")


@query
def fit_histogram_boost_pooled(spark, folder):
    """One ensemble over the windows of all sites."""
    return _numbers(boost.fit_boost(base.train_rows(spark, folder), keys=(), rounds=TREES)).drop("model_type")


@query
def histogram_boost_history(spark, folder):
    """Loss per round on the train and the validation rows of every supplier."""
    return rounded(boost.boost_history(_train(spark, folder), rounds=TREES)).drop("model_type")


@query
def histogram_boost_stop(spark, folder):
    """Where training would end after one round without a lower validation loss, and the best round."""
    rounds = stored(boost.boost_history(_train(spark, folder), rounds=TREES), "history")
    best = history.best_epoch(rounds).select("site_id", F.round("best_val_loss", 6).alias("best_val_loss"))
    stops = history.early_stop(rounds, patience=1).select("site_id", "stop_epoch", "best_epoch", "stopped")
    return stops.join(best, "site_id")


def mixed_models(spark, folder):
    """(windows, models of every supplier): own ones of three types in one region, pooled ones of two types elsewhere; all are rows."""
    rows = stored(base.supplier_windows(spark, folder), "windows")
    train = rows.where(F.col("split") == "train")
    s, n, r = (read_table(spark, folder, t) for t in ("supplier", "nation", "region"))
    home = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    home = stored(home.where(F.col("r_name") == "ASIA").select(F.col("s_suppkey").cast("string").alias("site_id")), "home")
    near = train.join(home, "site_id", "left_semi")
    own = win.pooled(*[forecast.fit_ar1(near), forecast.fit_ar(near, length=2), boost.fit_boost(near, rounds=TREES)])
    pooled = forecast.fit_ar1(train, keys=()).unionByName(boost.fit_boost(train, keys=(), rounds=TREES))
    chosen = forecast.choose_models(stored(own, "models"), stored(pooled, "models"), catalog.distinct_sites(rows))
    return rows, stored(chosen, "chosen")


@query
def evaluate_mixed_models(spark, folder):
    """Metrics of linear models and trees, own and pooled, scored by one scan of the windows."""
    rows, chosen = mixed_models(spark, folder)
    scored = forecast.score_chosen(rows.where(F.col("split") == "test"), chosen)
    return rounded(evaluate.regression_report(scored))


@query
def score_histogram_boost(spark, folder):
    """Test predictions of the pooled ensemble over all sites, as metrics."""
    rows = stored(base.windows(spark, folder), "windows")
    model = boost.fit_boost(rows.where(F.col("split") == "train"), keys=(), rounds=TREES)
    chosen = forecast.choose_models(model.withColumn("site_id", F.lit("none")).limit(0), model, catalog.distinct_sites(rows))
    scored = forecast.score_chosen(rows.where(F.col("split") == "test"), stored(chosen, "chosen"))
    return rounded(evaluation.evaluate_pooled(scored))
