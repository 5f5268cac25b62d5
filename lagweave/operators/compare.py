"""Summaries and rankings over the metrics table (one row per site and model)."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_values import HIGHER_IS_BETTER, METRIC_NAMES, METRIC_TITLES

SUMMARY_METRICS = ("mape", "rmse", "r2")


def better_first(metric: str, column: Column) -> Column:
    return column.desc() if metric in HIGHER_IS_BETTER else column.asc()


def model_summary(metrics: DataFrame, names: Sequence[str] = SUMMARY_METRICS) -> DataFrame:
    """(model_type, avg_, min_ and max_ of each metric), unweighted over sites."""
    aggs = [f(m).alias(f"{p}_{m}") for m in names for p, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    return metrics.groupBy("model_type").agg(*aggs)


def model_summary_short(metrics: DataFrame) -> DataFrame:
    return model_summary(metrics).select("model_type", "avg_mape", "avg_rmse", "avg_r2", "min_mape", "max_mape")


def error_bars(summary: DataFrame, names: Sequence[str] = SUMMARY_METRICS) -> DataFrame:
    """(model_type, metric, avg, below, above): distances from the average to the extremes."""
    bars = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"avg_{m}").alias("avg"),
            (F.col(f"avg_{m}") - F.col(f"min_{m}")).alias("below"),
            (F.col(f"max_{m}") - F.col(f"avg_{m}")).alias("above"),
        )
        for m in names
    ]
    return summary.select("model_type", F.inline(F.array(*bars)))


def site_model_pivot(metrics: DataFrame, metric: str, models: Sequence[str], site: str = "site_id") -> DataFrame:
    """One row per site, one column per model. A second row for a (site, model) fails the query."""
    value = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("duplicate (site, model)")).cast("double")).otherwise(F.first(metric))
    return metrics.groupBy(site).pivot("model_type", list(models)).agg(value)


def top_sites_by_metric(metrics: DataFrame, metric: str = "mape", n: int = 10, site: str = "site_id") -> DataFrame:
    """(site, avg_metric): the n best sites by their mean over models; NULLs are skipped, ties go by id."""
    means = metrics.groupBy(site).agg(F.avg(metric).alias(f"avg_{metric}"))
    return means.orderBy(better_first(metric, F.col(f"avg_{metric}")), site).limit(n)


def rank_models(summary: DataFrame, metric: str = "mape") -> DataFrame:
    """Models by average metric, best first."""
    return summary.orderBy(better_first(metric, F.col(f"avg_{metric}")), "model_type")


def metric_rows(metrics: DataFrame, keys: Sequence[str] = ("site_id", "model_type")) -> DataFrame:
    """(keys, metric, value), one row per metric."""
    return metrics.unpivot(list(keys), list(METRIC_TITLES), "metric", "value")


def comparison_table(metrics: DataFrame, models: Sequence[str], keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """(keys, metric title, one text column per model in capitals); two digits for MAPE, four for the rest."""
    titles = F.create_map(*[F.lit(x) for pair in METRIC_TITLES.items() for x in pair])
    cells = metric_rows(metrics, [*keys, "model_type"]).select(
        *keys,
        titles[F.col("metric")].alias("metric"),
        F.upper("model_type").alias("model_type"),
        F.when(F.col("metric") == "mape", F.format_string("%.2f", "value"))
        .otherwise(F.format_string("%.4f", "value"))
        .alias("cell"),
    )
    return cells.groupBy(*keys, "metric").pivot("model_type", [m.upper() for m in models]).agg(F.first("cell"))


def metric_display_name(metric: Column) -> Column:
    """Long name of a metric, the metric itself if it has none."""
    names = F.create_map(*[F.lit(x) for pair in METRIC_NAMES.items() for x in pair])
    return F.coalesce(names[metric], metric)
