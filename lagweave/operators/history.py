"""Training histories: one row per run and epoch. A run is bounded by its number of epochs."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

RUN = ("site_id", "model_type")


def best_epoch(history: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """(run, best_epoch, best_val_loss): lowest validation loss, the earliest on ties."""
    best = F.min(F.struct("val_loss", "epoch"))
    kept = history.where(F.col("val_loss").isNotNull())
    return kept.groupBy(*run).agg(best["epoch"].alias("best_epoch"), best["val_loss"].alias("best_val_loss"))


def early_stop(history: DataFrame, patience: int = 10, run: Sequence[str] = RUN) -> DataFrame:
    """(run, stop_epoch, best_epoch, stopped): where training ends after `patience` epochs without a new lowest loss.

    Runs that never get there stop at their last epoch.
    """
    so_far = Window.partitionBy(*run).orderBy("epoch")
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    marked = history.withColumn("_low", F.min("val_loss").over(before))
    marked = marked.withColumn("_new", F.col("_low").isNull() | (F.col("val_loss") < F.col("_low")))
    marked = marked.withColumn("_best", F.max(F.when(F.col("_new"), F.col("epoch"))).over(so_far))
    waited = F.col("epoch") - F.col("_best") >= patience
    stop = F.min(F.when(waited, F.struct("epoch", "_best")))
    end = F.max(F.struct("epoch", "_best"))
    runs = marked.groupBy(*run).agg(stop.alias("_stop"), end.alias("_end"))
    point = F.coalesce("_stop", "_end")
    return runs.select(
        *run,
        point["epoch"].alias("stop_epoch"),
        point["_best"].alias("best_epoch"),
        F.col("_stop").isNotNull().alias("stopped"),
    )
