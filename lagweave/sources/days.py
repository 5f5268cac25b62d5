"""A series that grows by days: windows, chunk summaries and catalog are appended to, not computed anew.

Below one folder stand four tables, each in folders by day (the chunk):

* `series`, the rows as they came;
* `summaries`, one row per key and day: size, extrema and the last L values;
* `windows`, the lags and target of every row in raw units, with its position in the key, but without scaling and split, which change for all rows
  of a key when a day is added;
* `presence`, one row per site and day: the number of rows and the first location, for the catalog.

Adding days reads the new rows, the summaries of the days before (a halo of L values among them), and nothing of the history. The
folders of the new days are replaced whole. The folder of a day in `presence` goes first and comes last, as the mark that the day is done: days that a lost
run has left without it are done again by the next append, and cannot be read before. Days that come late or again make the days after them part of the
work, as their positions and halos change; the days before are never read. Scaling and split come from the summaries when windows are read.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StructType

from ..functions.scaling import span
from ..operators.lookup import lookup
from ..operators.sequence import pack_chunks, packed_lag_frame, packed_summaries
from ..operators.windows import LENGTH, MARGIN, TRAIN_SHARE, lag_names, train_size
from .manifest import _place
from .shared import stored

KEYS, ORDER, VALUE = ("site_id",), ("ts", "location"), "flow"


def _exists(spark: SparkSession, path: str) -> bool:
    system, target = _place(spark, path)
    return system.exists(target)


def _days(spark: SparkSession, path: str) -> set[str]:
    """The days that a table has folders for."""
    system, target = _place(spark, path)
    names = [f.getPath().getName() for f in system.listStatus(target)] if system.exists(target) else []
    return {n.removeprefix("chunk=") for n in names if n.startswith("chunk=")}


def _read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    schema = schema or spark.read.parquet(path).schema
    schema["chunk"].dataType = DateType()
    return spark.read.schema(schema).parquet(path)


def _replace(rows: DataFrame, path: str, dealt: bool = False) -> None:
    """Replaces the folders of the days that `rows` has, each as a whole; a day's rows are dealt to tasks by key, or `dealt` so already."""
    rows = rows if dealt else rows.repartition("chunk", *[k for k in KEYS if k in rows.columns])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)


def append_days(new: DataFrame, path: str, length: int = LENGTH) -> None:
    """Adds the days of `new` (site_id, location, ts, flow) to the tables at `path`; days that are there already are replaced.

    The number of lags is that of the first call. An empty `new` changes nothing.
    """
    spark = new.sparkSession
    rows = stored(new.where(F.col("ts").isNotNull() & F.col("site_id").isNotNull()).withColumn("chunk", F.to_date("ts")), "new-days")
    first = rows.agg(F.min("chunk").cast("string")).first()[0]
    if first is None:
        return
    done = _days(spark, f"{path}/presence")
    first = min([first, *(_days(spark, f"{path}/series") - done)])
    for day in sorted(d for d in done if d >= first):
        system, target = _place(spark, f"{path}/presence/chunk={day}")
        system.delete(target, True)
    _replace(rows, f"{path}/series")
    later = _read(spark, f"{path}/series", rows.schema).where(F.col("chunk") >= F.lit(first).cast("date"))
    before = None
    if _exists(spark, f"{path}/summaries"):
        known = _read(spark, f"{path}/summaries").where(F.col("chunk") < F.lit(first).cast("date"))
        # The writes below replace folders that this plan does not read; the copy keeps it so for lost tasks too.
        before = stored(known, "summaries-before")
    # Each day of a site is sorted once, as one row, which summaries, windows and presence are taken from.
    packed = stored(pack_chunks(later, KEYS, ORDER, VALUE, F.to_date("ts")), "packed")
    raw = packed_lag_frame(packed, KEYS, VALUE, length, before)
    windows = raw.select("site_id", "location", "ts", "chunk", "idx", *lag_names(length), F.col(VALUE).alias("y"))
    _replace(packed_summaries(packed, KEYS, VALUE, length), f"{path}/summaries")
    _replace(windows, f"{path}/windows", dealt=True)
    _replace(_presence(packed), f"{path}/presence")


def _check_whole(spark: SparkSession, path: str) -> None:
    lost = _days(spark, f"{path}/series") - _days(spark, f"{path}/presence")
    if lost:
        raise ValueError(f"an append was lost: days {min(lost)} to {max(lost)} are not done, append again")


def key_totals(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, n_rows, x_min, x_max) from the summaries."""
    rows = _read(spark, f"{path}/summaries")
    return rows.groupBy(*keys).agg(F.sum("_size").alias("n_rows"), F.min("_lo").alias("x_min"), F.max("_hi").alias("x_max"))


def read_windows(spark: SparkSession, path: str, share: float = TRAIN_SHARE, scale: bool = True) -> DataFrame:
    """The windows over all days, as `operators.windows.lag_windows` gives them."""
    _check_whole(spark, path)
    rows = _read(spark, f"{path}/windows")
    names = [c for c in rows.columns if c.startswith("lag_")]
    length = len(names)
    sized = lookup(rows, stored(key_totals(spark, path), "totals"), KEYS)
    sized = sized.where((F.col("n_rows") >= length + MARGIN) & (F.col("idx") > length)).withColumn("_span", span(F.col("x_min"), F.col("x_max")))
    idx, n = F.col("idx") - length, F.col("n_rows") - length
    n_train = train_size(n, share)
    values = [F.expr(f"({c} - x_min) / _span").alias(c) if scale else F.col(c) for c in [*names, "y"]]
    return sized.select(
        "site_id", "location", "ts", "chunk", idx.alias("idx"), n.alias("n_windows"), n_train.alias("n_train"),
        F.when(idx <= n_train, "train").otherwise("test").alias("split"), "x_min", "x_max", *values,
    )


def _presence(packed: DataFrame) -> DataFrame:
    """Per site and day: the number of rows, and the first row's time and location."""
    first = F.struct(*[F.get("rows", F.lit(0))[c].alias(c) for c in ORDER])
    return packed.select("site_id", "chunk", F.size("rows").cast("bigint").alias("points"), first.alias("first"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, location, days, data_points) over all days, from the presence table: one row per site and day, which simply add up."""
    _check_whole(spark, path)
    rows = _read(spark, f"{path}/presence")
    return rows.groupBy("site_id").agg(
        F.min("first")["location"].alias("location"), F.count(F.lit(1)).alias("days"), F.sum("points").alias("data_points")
    )
