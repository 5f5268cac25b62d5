"""Lag windows with a chronological split, scaled per key."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scaling import span
from ..sources.shared import stored
from .lookup import lookup
from .sequence import by_day, lag_frame, packed_lag_frame, positions

LENGTH = 12
MARGIN = 10
TRAIN_SHARE = 0.7


def lag_names(length: int = LENGTH) -> list[str]:
    """Oldest first."""
    return [f"lag_{k}" for k in range(length, 0, -1)]


def train_size(n: Column, share: float = TRAIN_SHARE) -> Column:
    """How many of a key's n windows train; each side keeps one window at least.

    The cut is computed in binary double, as 90 * 0.7 is 62.99.. there and 63 in decimal.
    """
    return F.greatest(F.lit(1), F.least(n - 1, F.floor(n.cast("double") * F.lit(float(share)))))


def lag_windows(
    series: DataFrame,
    keys: Sequence[str] = ("site_id",),
    order: Sequence[str] = ("ts", "location"),
    value: str = "flow",
    length: int = LENGTH,
    share: float = TRAIN_SHARE,
    chunk: Column | None = None,
    scale: bool = True,
) -> DataFrame:
    """One row per window of `length` lags and a target `y`, for every key with `length + 10` rows or more.

    Columns: those of the series without `value`, `chunk`, `idx` (1-based), `n_windows`, `n_train`, `split`, `x_min`,
    `x_max`, `lag_L .. lag_1`, `y`. The first `n_train` windows are the train split. Lags and `y` are min-max scaled over
    all rows of the key; `x_min, x_max` undo it. Windows run across missing intervals.
    """
    frame = lag_frame(series, keys, order, value, length, by_day() if chunk is None else chunk)
    return _split_and_scaled(frame, [c for c in series.columns if c not in (value, "chunk")], value, length, share, scale)


def packed_lag_windows(
    packed: DataFrame, keys: Sequence[str] = ("site_id",), value: str = "flow", length: int = LENGTH, share: float = TRAIN_SHARE, scale: bool = True,
    made: Sequence[int] | None = None,
) -> DataFrame:
    """`lag_windows` of packed chunks (see `sequence.pack_chunks`, `reshape.wide_to_packed`).

    Windows have `length` lags, of which `made` names those wanted as columns, by default all.
    """
    frame = packed_lag_frame(packed, keys, value, length, made=made)
    columns = [c for c in frame.columns[: frame.columns.index("chunk")] if c != value]
    return _split_and_scaled(frame, columns, value, length, share, scale, made)


def _split_and_scaled(frame, columns, value, length, share, scale, made=None):
    windows = frame.where((F.col("n_rows") >= length + MARGIN) & (F.col("idx") > length))
    windows = windows.withColumn("_span", span(F.col("x_min"), F.col("x_max")))
    idx, n = F.col("idx") - length, F.col("n_rows") - length
    n_train = train_size(n, share)
    return windows.select(
        *columns,
        "chunk",
        idx.alias("idx"),
        n.alias("n_windows"),
        n_train.alias("n_train"),
        F.when(idx <= n_train, F.lit("train")).otherwise(F.lit("test")).alias("split"),
        "x_min",
        "x_max",
        *_values(value, length, scale, made),
    )


def lag_windows_per_file(
    series: DataFrame,
    chunk: Column,
    keys: Sequence[str] = (),
    source: str = "source_file",
    order: Sequence[str] = ("file_order",),
    value: str = "flow",
    length: int = LENGTH,
    scale: bool = True,
) -> DataFrame:
    """Windows of a series that comes already split into a 'train' and a 'test' source.

    Windows do not cross from one source to the other. The scaler is fitted on the train rows and applied to both, so
    test values may leave [0, 1].
    """
    frame = lag_frame(
        series, [*keys, source], order, value, length, chunk, fit_keys=keys, fit_when=F.col(source) == "train"
    )
    windows = frame.where(F.col("idx") > length).withColumn("_span", span(F.col("x_min"), F.col("x_max")))
    return windows.select(
        *[c for c in series.columns if c not in (value, "chunk")],
        "chunk",
        (F.col("idx") - length).alias("idx"),
        (F.col("n_rows") - length).alias("n_windows"),
        F.when(F.col(source) == "train", F.col("n_rows") - length).alias("n_train"),
        F.col(source).alias("split"),
        "x_min",
        "x_max",
        *_values(value, length, scale),
    )


def _values(value, length, scale, made=None):
    names = [f"lag_{k}" for k in sorted(range(1, length + 1) if made is None else made, reverse=True)]
    if not scale:
        return [*names, F.col(value).alias("y")]
    # Scaling is affine, so it commutes with taking lags and is done last.
    scaled = [F.expr(f"({c} - x_min) / _span").alias(c) for c in names]
    return [*scaled, F.expr(f"(`{value}` - x_min) / _span").alias("y")]


def lags_array(length: int = LENGTH) -> Column:
    """The features as one array, oldest first."""
    return F.array(*lag_names(length))


def features_and_target(window: Column, length: int = LENGTH) -> list[Column]:
    """Cut an array of L+1 values into the first L and the last one."""
    return [F.slice(window, 1, length).alias("lags"), F.element_at(window, -1).alias("y")]


def with_channel_axis(lags: Column) -> Column:
    """(L) to (L, 1)."""
    return F.transform(lags, lambda x: F.array(x))


def pooled(*parts: DataFrame) -> DataFrame:
    """Stack the windows of several sites or runs."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def shuffled(
    rows: DataFrame, keys: Sequence[str] = ("site_id",), ident: Sequence[str] = ("site_id", "idx"), seed: int = 42, digits: int | None = None
) -> DataFrame:
    """Adds `shuffle_key` and `shuffle_pos`, a reproducible random order of the rows of each key.

    With `keys=()` the order runs over all rows. The leading hex digits of the digest serve as chunk: 16^digits even parts per key, so a hot
    key is cut as finely as a cold one; beyond two digits these are the coarse and the rest the fine part. Every part has a summary row, so
    parts should hold many rows each: 256 of a key by default, 4,096 where all rows are one sequence. Take a digit more for every 16 times as
    many rows of one key; the result does not depend on it.
    """
    digits = digits or (2 if keys else 3)
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ident], F.lit(str(seed)))
    keyed = rows.drop("chunk").withColumn("shuffle_key", F.md5(text.cast("binary")))
    chunk = F.substring("shuffle_key", 1, min(digits, 2))
    if digits > 2:
        chunk = F.struct(chunk.alias("coarse"), F.substring("shuffle_key", 3, digits - 2).alias("fine"))
    placed = positions(keyed.withColumnRenamed("idx", "_idx"), keys, ["shuffle_key", "_idx"], chunk)
    return placed.withColumnRenamed("idx", "shuffle_pos").withColumnRenamed("_idx", "idx").drop("chunk")


def validation_tail(rows: DataFrame, share: float = 0.1, places: bool = True, **how) -> DataFrame:
    """Marks the last `share` of the shuffled rows of each key with `is_validation`.

    Without `places` the same rows are marked, but do not get `shuffle_key, shuffle_pos`, and no row moves: see `_marked`. `rows` is then read
    three times.
    """
    if not places:
        return _marked(rows, share, **how)
    cut = F.floor(F.col("n_rows").cast("double") * F.lit(1.0 - share))
    return shuffled(rows, **how).withColumn("is_validation", F.col("shuffle_pos") > cut)


def _marked(
    rows: DataFrame, share: float, keys: Sequence[str] = ("site_id",), ident: Sequence[str] = ("site_id", "idx"), seed: int = 42
) -> DataFrame:
    """Rows behind the last one that is not validation, by digest. `ident` is unique within a key, and nothing in `rows` is random.

    Counts by the first digit of the digest say in which sixteenth of a key that last row is; only rows of that sixteenth are put in order.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ident], F.lit(str(seed))).cast("binary"))
    for name in keys:
        rows = rows.where(F.col(name).isNotNull())
    keyed = rows.select(*keys, F.col("idx").alias("_idx"), digest.alias("shuffle_key"))
    keyed = keyed.withColumn("_part", F.substring("shuffle_key", 1, 1))
    key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.floor(F.sum("_n").over(key).cast("double") * F.lit(1.0 - share))
    parts = keyed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumns({"_before": before, "_cut": cut})
    parts = parts.where((F.col("_before") < F.col("_cut")) & (F.col("_cut") <= F.col("_before") + F.col("_n"))).drop("_n")
    near = lookup(keyed, stored(parts, "parts"), [*keys, "_part"])
    placed = positions(near, keys, ["shuffle_key", "_idx"], F.substring("shuffle_key", 2, 2))
    last = placed.where(F.col("_before") + F.col("idx") == F.col("_cut"))
    last = stored(last.select(*keys, F.struct("shuffle_key", "_idx").alias("_last")), "last")
    here = F.struct(digest.alias("shuffle_key"), F.col("idx").alias("_idx"))
    # A key of so few rows that none is left to fit on has no last one: all its rows are validation.
    marked = lookup(rows, last, list(keys), "left").withColumn("is_validation", F.coalesce(here > F.col("_last"), F.lit(True)))
    return marked.drop("_last", "chunk")
