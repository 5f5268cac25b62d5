"""Wide day rows to a long series, time grids."""

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from ..functions.calendar import slot_columns, slot_timestamp
from ..functions.clean import canonical_id, is_junk, parse_day, parse_number, present, zero_fill
from ..functions.fixed_values import SLOT_MINUTES, WIDE_DATE, WIDE_ID, WIDE_LOCATION


def clean_wide(raw: DataFrame, site: str = WIDE_ID, location: str = WIDE_LOCATION, day: str = WIDE_DATE) -> DataFrame:
    """Type the id, location and day of all-text wide rows; rows without an id or a valid day are dropped.

    Slot columns stay as they are. Absent ones are tolerated by `wide_to_long`.
    """
    present_columns = set(raw.columns)
    slots = [c for c in slot_columns() if c in present_columns]
    return raw.select(
        canonical_id(F.col(f"`{site}`")).alias("site_id"),
        present(F.col(f"`{location}`")).alias("location"),
        parse_day(F.col(f"`{day}`")).alias("day"),
        *slots,
    ).na.drop(subset=["site_id", "day"])


def tag_wide(raw: DataFrame, site: str = WIDE_ID, location: str = WIDE_LOCATION, day: str = WIDE_DATE) -> DataFrame:
    """What `clean_wide` gives, with the rows it drops: adds `raw_site, raw_day` as read, `reason` and `n_junk`.

    `reason` is NULL for rows that stay, else 'no_id', 'no_date' or 'bad_date', the first that holds. `n_junk` counts the slot cells that hold
    something that is no number; they become 0 in the series of a row that stays. The rows that stay and the others come from one scan.
    """
    present_columns = set(raw.columns)
    slots = [c for c in slot_columns() if c in present_columns]
    texts = [c for c in slots if raw.schema[c].dataType.simpleString() == "string"]
    id_, day_ = canonical_id(F.col(f"`{site}`")), parse_day(F.col(f"`{day}`"))
    no_day = present(F.trim(F.col(f"`{day}`"))).isNull()
    reason = F.when(id_.isNull(), "no_id").when(no_day, "no_date").when(day_.isNull(), "bad_date")
    junk = F.size(F.filter(F.array(*texts), is_junk)) if texts else F.lit(0)
    return raw.select(
        id_.alias("site_id"), present(F.col(f"`{location}`")).alias("location"), day_.alias("day"), *slots,
        F.col(f"`{site}`").alias("raw_site"), F.col(f"`{day}`").alias("raw_day"), reason.alias("reason"), junk.alias("n_junk"),
    )


def kept_wide(tagged: DataFrame) -> DataFrame:
    """The rows of `tag_wide` that stay, as `clean_wide` gives them."""
    return tagged.where(F.col("reason").isNull()).drop("raw_site", "raw_day", "reason", "n_junk")


def rejected_rows(tagged: DataFrame) -> DataFrame:
    """(raw_site, location, raw_day, reason, n_junk) of every dropped row, and of rows that stay with junk cells ('junk_cells')."""
    why = F.coalesce("reason", F.when(F.col("n_junk") > 0, F.lit("junk_cells")))
    return tagged.select("raw_site", "location", "raw_day", why.alias("reason"), "n_junk").where(F.col("reason").isNotNull())


REASONS = ("no_id", "no_date", "bad_date", "junk_cells")


def count_rejects(tagged: DataFrame, counts: Observation) -> DataFrame:
    """`tagged`, whose rejects are counted by whatever reads it: see `reject_counts`."""
    kept_junk = F.col("reason").isNull() & (F.col("n_junk") > 0)
    rows = [F.count_if(F.col("reason") == r).alias(f"{r}_rows") for r in REASONS[:-1]] + [F.count_if(kept_junk).alias("junk_cells_rows")]
    junk = [F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("n_junk"))), F.lit(0)).alias(f"{r}_cells") for r in REASONS[:-1]]
    kept = F.coalesce(F.sum(F.when(kept_junk, F.col("n_junk"))), F.lit(0)).alias("junk_cells_cells")
    return tagged.observe(counts, *rows, *junk, kept)


def reject_counts(spark: SparkSession, counts: Observation) -> DataFrame:
    """(reason, n_rows, n_junk), one row per reason, after the pass that `count_rejects` watched."""
    got = counts.get
    return spark.createDataFrame([(r, got[f"{r}_rows"], got[f"{r}_cells"]) for r in REASONS], "reason string, n_rows bigint, n_junk bigint")


def wide_to_long(wide: DataFrame, fill: bool = True) -> DataFrame:
    """One row per slot: (site_id, location, ts, flow).

    Takes `site_id, location, day` and any of V00..V95, as text or double. One array explode, so the slot cells of a row
    are read once; text is parsed after the explode, inside generated code.
    """
    types = dict(wide.dtypes)
    names = [c for c in slot_columns() if c in types]
    numbers = [int(c[1:]) for c in names]
    text = types[names[0]] == "string"
    slot = F.col("pos")
    if numbers != list(range(len(numbers))):
        slot = F.element_at(F.array(*[F.lit(i) for i in numbers]), slot + 1)
    flow = parse_number(F.col("cell")) if text else F.col("cell")
    cells = wide.select("site_id", "location", "day", F.posexplode(F.array(*names)).alias("pos", "cell"))
    return cells.select(
        "site_id",
        "location",
        slot_timestamp(F.col("day"), slot).alias("ts"),
        (zero_fill(flow) if fill else flow.cast("double")).alias("flow"),
    )


def wide_to_packed(wide: DataFrame, previous: bool = False) -> DataFrame:
    """(site_id, chunk, rows): one row per site and day with all its (ts, location, flow) in order, for `sequence.packed_lag_frame`.

    The rows of `wide_to_long` by day, but a day moves and is sorted as one row instead of 96 for every approach. Rows without a site or a day
    belong to no sequence. With `previous`, every slot also has the greatest value of the day before, NULL where there is none (see
    `forecast.with_previous_period`); that looks at wide rows, one for a day of a site and location.
    """
    types = dict(wide.dtypes)
    names = [c for c in slot_columns() if c in types]
    number = parse_number if types[names[0]] == "string" else lambda c: c
    days = wide.where(F.col("site_id").isNotNull() & F.col("day").isNotNull())
    days = days.select("site_id", "location", "day", *[zero_fill(number(F.col(c))).alias(c) for c in names])
    parts = {
        "ts": F.array(*[slot_timestamp(F.col("day"), F.lit(int(c[1:]))) for c in names]),
        "location": F.array_repeat("location", len(names)),
        "flow": F.array(*names),
    }
    if previous:
        day_before = Window.partitionBy("site_id", "location").orderBy(F.unix_date("day")).rangeBetween(-1, -1)
        days = days.withColumns({f"_before_{c}": F.max(c).over(day_before) for c in names})
        parts["previous"] = F.array(*[f"_before_{c}" for c in names])
    row = "array<struct<ts:timestamp_ntz,location:string,flow:double" + (",previous:double>>" if previous else ">>")
    cells = days.select("site_id", F.col("day").alias("chunk"), F.arrays_zip(*parts.values()).cast(row).alias("cells"))
    packed = cells.groupBy("site_id", "chunk").agg(F.collect_list("cells").alias("cells"))
    return packed.select("site_id", "chunk", F.sort_array(F.flatten("cells")).alias("rows"))


def time_grid(bounds: DataFrame, start: str, stop: str, minutes: int = SLOT_MINUTES, ts: str = "ts") -> DataFrame:
    """A regular grid from `start` to `stop`, both included, for every row of `bounds`."""
    step = F.expr(f"interval {int(minutes)} minutes")
    grid = F.explode(F.sequence(F.col(start), F.col(stop), step)).alias(ts)
    return bounds.select(*[c for c in bounds.columns if c not in (start, stop)], grid)
