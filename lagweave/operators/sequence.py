"""Position and lags within a key, without one task per key.

A window over a key sorts the whole key in one task, which fails when one key holds a third of the data. Here the rows of
a key are cut into *chunks*: an expression that never decreases along the order, such as the day of the timestamp. Then:

1. one exchange by (keys, chunk); row numbers, lags and extrema are local to a chunk;
2. every chunk gives one summary row: size, extrema and its last L values;
3. a window over the summaries turns them into the chunk's start position, the key's size and extrema, and the halo, i.e.
   the L values before the chunk;
4. the summaries join back on (keys, chunk). The rows are still partitioned and sorted that way, so only the summaries move.

A key's summaries number as many as its chunks, which the calendar bounds, not the number of rows. Days suit a key with
some thousands of rows a day. For denser keys take `by_hour` or the timestamp itself. Where even one day of one key is
too much for a task, take a struct of a coarse and a fine part, such as the day and a range of the next order column: its
summaries are combined per coarse part first, each by itself, so that no task sees all chunks of a key. The last resort is
`sources.store.with_range_chunks`, which cuts by the whole order.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..functions.clean import zero_fill


def by_day(ts: str = "ts") -> Column:
    return F.to_date(ts)


def by_hour(ts: str = "ts") -> Column:
    """Finer chunks, for keys with very many rows a day."""
    return F.date_trunc("HOUR", ts)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column) -> DataFrame:
    """Adds `idx` (1-based position in the key), `n_rows` (size of the key) and `chunk`."""
    return _sequence(df, keys, order, None, 0, chunk, None, None)


def lag_frame(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    lags: int,
    chunk: Column,
    fit_keys: Sequence[str] | None = None,
    fit_when: Column | None = None,
    before: DataFrame | None = None,
) -> DataFrame:
    """`positions` plus `lag_1 .. lag_L` of `value` and its extrema `x_min, x_max`.

    `value` is zero-filled first. The extrema are taken over `fit_keys` (a subset of `keys`, by default all of them), over
    the rows where `fit_when` holds. `before` has the summaries (see `chunk_summaries`) of chunks whose rows are not in `df`: positions, lags,
    sizes and extrema then are those of the whole series.
    """
    df = df.withColumn(value, zero_fill(F.col(value)))
    return _sequence(df, keys, order, value, lags, chunk, fit_keys, fit_when, before)


def chunk_summaries(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lags: int, chunk: Column) -> DataFrame:
    """(keys, chunk, _size, _lo, _hi, _tail): one row per chunk, all that the rows of other chunks need to know of it."""
    at = [*keys, "chunk"]
    rows, local = _chunked(df.withColumn(value, zero_fill(F.col(value))), at, order, value, chunk)
    lagged = rows.withColumns({"_rn": F.row_number().over(local), **{f"_lag_{k}": F.lag(value, k).over(local) for k in range(1, lags)}})
    return _last_rows(lagged, at, local, value, lags, None)


def pack_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, chunk: Column) -> DataFrame:
    """(keys, chunk, rows): a row per chunk with all its rows in order, as `packed_lag_frame` takes them.

    For chunks of some thousands of rows, such as the days of a key; denser ones stay with `lag_frame`, which spills within a chunk.
    """
    at = [*keys, "chunk"]
    rows, _ = _chunked(df.withColumn(value, zero_fill(F.col(value))), at, order, value, chunk)
    row = F.struct(*order, value, *[c for c in df.columns if c not in (*at, *order, value)])
    return rows.groupBy(*at).agg(F.sort_array(F.collect_list(row)).alias("rows"))


def packed_summaries(packed: DataFrame, keys: Sequence[str], value: str, lags: int) -> DataFrame:
    """`chunk_summaries` of packed chunks."""
    values = F.col("rows")[value]
    tail = F.slice(values, F.greatest(F.size("rows") - (lags - 1), F.lit(1)), F.lit(lags))
    return packed.select(
        *keys, "chunk", F.size("rows").cast("bigint").alias("_size"), F.array_min(values).alias("_lo"), F.array_max(values).alias("_hi"), tail.alias("_tail")
    )


def packed_lag_frame(
    packed: DataFrame, keys: Sequence[str], value: str, lags: int, before: DataFrame | None = None, made: Sequence[int] | None = None
) -> DataFrame:
    """What `lag_frame` gives, from chunks that are one row each (see `pack_chunks`, `reshape.wide_to_packed`).

    Summaries and their join see a row per chunk, and lag k is the chunk's values behind its halo, moved by k, so the rows of a chunk are
    sorted once and never again. `made` names the lags that are wanted as columns, by default all.
    """
    chunks = packed_summaries(packed, keys, value, lags)
    if before is not None:
        chunks = chunks.unionByName(before.select(chunks.columns))
    placed = packed.join(_summaries(chunks, keys, value, lags, None).hint("merge"), [*keys, "chunk"])
    # The tails of short chunks overlap to more than the L values before; at the start of a key there are fewer.
    halo = _last(F.concat(F.array_repeat(F.lit(float("nan")), lags), "_halo"), lags)
    halo = F.transform(halo, lambda x: F.nanvl(x, F.lit(None).cast("double")))
    placed = placed.withColumns({"_values": F.concat(halo, F.col("rows")[value]), "_size": F.size("rows")})
    made = list(range(1, lags + 1) if made is None else made)
    moved = [F.slice("_values", F.lit(lags + 1 - k), F.col("_size")) for k in made]
    spread = placed.select(
        *keys, "chunk", "_start", "n_rows", "x_min", "x_max",
        F.inline(F.arrays_zip("rows", F.sequence(F.lit(1), F.col("_size")), *moved)).alias("_row", "_at", *[f"lag_{k}" for k in made]),
    )
    columns = [f.name for f in packed.schema["rows"].dataType.elementType]
    return spread.select(
        *keys,
        *[F.col("_row")[c].alias(c) for c in columns],
        "chunk",
        (F.col("_start") + F.col("_at")).alias("idx"),
        "n_rows",
        "x_min",
        "x_max",
        *[f"lag_{k}" for k in made],
    )


def _chunked(df, at, order, value, chunk):
    """Rows that have a chunk, and the order within it."""
    # Rows without a key or a place in the order belong to no sequence. Said here, before the two uses of `rows`, the
    # filter is the same in both and Spark reuses the exchange.
    rows = df.withColumn("chunk", chunk)
    for name in at:
        rows = rows.where(F.col(name).isNotNull())
    # The value breaks remaining ties, so equal order keys cannot give different results in two evaluations.
    return rows, Window.partitionBy(*at).orderBy(*order, *([value] if value else []))


def _sequence(df, keys, order, value, lags, chunk, fit_keys, fit_when, before=None):
    at = [*keys, "chunk"]
    rows, local = _chunked(df, at, order, value, chunk)
    numbered = rows.withColumns(
        {"_rn": F.row_number().over(local), **{f"_lag_{k}": F.lag(value, k).over(local) for k in range(1, lags + 1)}}
    )
    if value:
        chunks = _last_rows(numbered, at, local, value, lags, fit_when)
    else:
        chunks = rows.groupBy(*at).agg(F.count("*").alias("_size"))
    if before is not None:
        chunks = chunks.unionByName(before.select(chunks.columns))
    # A merge join takes the rows as they lie; without the hint a low size estimate could broadcast them.
    combine = _two_levels if isinstance(chunks.schema["chunk"].dataType, StructType) else _summaries
    joined = numbered.join(combine(chunks, keys, value, lags, fit_keys).hint("merge"), at)
    return joined.select(
        *[c for c in df.columns if c != "chunk"],
        "chunk",
        (F.col("_start") + F.col("_rn")).alias("idx"),
        "n_rows",
        *(["x_min", "x_max"] if value else []),
        *[_across_chunks(k).alias(f"lag_{k}") for k in range(1, lags + 1)],
    )


def _across_chunks(k: int) -> Column:
    """Lag k: local where the chunk reaches back far enough, else from the end of the halo."""
    return F.expr(f"CASE WHEN _rn > {k} THEN _lag_{k} ELSE try_element_at(_halo, _rn - {k + 1}) END")


def _last_rows(numbered, at, local, value, lags, fit_when):
    """The last row of every chunk: its number is the size, the running extrema are final and its lags are the tail."""
    fitted = F.col(value) if fit_when is None else F.when(fit_when, F.col(value))
    running = local.rowsBetween(Window.unboundedPreceding, 0)
    marked = numbered.withColumns(
        {
            "_lo": F.min(fitted).over(running),
            "_hi": F.max(fitted).over(running),
            "_more": F.lead(F.lit(1), 1).over(local),
        }
    )
    tail = F.array(*[f"_lag_{k}" for k in range(lags - 1, 0, -1)], value)
    return marked.where(F.col("_more").isNull()).select(*at, F.col("_rn").alias("_size"), "_lo", "_hi", tail.alias("_tail"))


def _summaries(chunks, keys, value, lags, fit_keys):
    """One row per chunk: start position, size and extrema of the key, halo."""
    key = Window.partitionBy(*keys)
    along = key.orderBy("chunk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    out = {"_start": F.coalesce(F.sum("_size").over(before), F.lit(0)), "n_rows": F.sum("_size").over(key)}
    if value:
        out["x_min"], out["x_max"] = _extrema(chunks, key, fit_keys)
        # Every chunk has a row, so the L chunks before hold the L values before.
        tails = F.flatten(F.collect_list("_tail").over(along.rowsBetween(-lags, -1)))
        out["_halo"] = F.filter(tails, lambda x: x.isNotNull())
    return chunks.select(*keys, "chunk", *[c.alias(name) for name, c in out.items()])


def _extrema(chunks, key, fit_keys):
    """Extrema over the fit keys; over all chunks they are a global aggregate, combined where the chunks lie."""
    if fit_keys is not None and not list(fit_keys):
        return chunks.agg(F.min("_lo")).scalar(), chunks.agg(F.max("_hi")).scalar()
    fit = key if fit_keys is None else Window.partitionBy(*fit_keys)
    return F.min("_lo").over(fit), F.max("_hi").over(fit)


def _two_levels(chunks, keys, value, lags, fit_keys):
    """`_summaries` for chunks of a coarse and a fine part: within each coarse part, then over the coarse parts of a key."""
    coarse = chunks.schema["chunk"].dataType.names[0]
    at = [*keys, "_coarse"]
    inside = Window.partitionBy(*at).orderBy("chunk")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    parts = chunks.withColumn("_coarse", F.col("chunk")[coarse])
    own = {"_inner": F.coalesce(F.sum("_size").over(before), F.lit(0)), "_more": F.lead(F.lit(1), 1).over(inside)}
    if value:
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        own |= {"_low": F.min("_lo").over(upto), "_high": F.max("_hi").over(upto)}
        own["_near"] = F.flatten(F.collect_list("_tail").over(inside.rowsBetween(-lags, -1)))
        own["_end"] = F.flatten(F.collect_list("_tail").over(inside.rowsBetween(1 - lags, 0)))
    parts = parts.withColumns(own)
    # The last chunk of a coarse part knows its size, extrema and tail.
    whole = parts.where(F.col("_more").isNull()).select(
        *keys,
        F.col("_coarse").alias("chunk"),
        (F.col("_inner") + F.col("_size")).alias("_size"),
        *([F.col("_low").alias("_lo"), F.col("_high").alias("_hi"), _last(F.col("_end"), lags).alias("_tail")] if value else []),
    )
    tops = _summaries(whole, keys, value, lags, fit_keys).withColumnRenamed("chunk", "_coarse")
    joined = parts.join(tops.hint("merge"), at)
    out = [*keys, "chunk", (F.col("_start") + F.col("_inner")).alias("_start"), "n_rows"]
    if value:
        out += ["x_min", "x_max", _last(F.concat("_halo", "_near"), lags).alias("_halo")]
    return joined.select(*out)


def _last(values: Column, n: int) -> Column:
    """The last n values that are not NULL."""
    known = F.filter(values, lambda x: x.isNotNull())
    return F.slice(known, F.greatest(F.size(known) - (n - 1), F.lit(1)), F.lit(n))
