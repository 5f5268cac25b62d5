"""Helpers of the text operators."""

import os
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the session was started outside the repository."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join(x for x in [ROOT, *known] if x)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """`function` over the Arrow batches of each partition; empty batches are skipped. It returns one batch, several, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield from [out] if isinstance(out, pa.RecordBatch) else out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def groups_of(texts: Sequence[bytes], most: int) -> Iterator[slice]:
    """Slices of the texts of about `most` bytes; a longer text is a slice by itself."""
    first = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= most or k == len(texts) - 1:
            yield slice(first, k + 1)
            first, size = k + 1, 0


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as bytes, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def keep_rows(docs: DataFrame, keys: Sequence[tuple[str, Column]], kept: DataFrame) -> DataFrame:
    """The rows of `docs` whose keys are in `kept`, with the columns of `docs`, one row for each entry of `kept`.

    `keys` gives (column of `kept`, expression over `docs`); NULL matches NULL. Of rows with equal keys, which are copies
    of one another under the same id, the first by a hash of their columns stays. The row travels as a struct, so no name
    can clash. It moves once: join and window use the same columns, in which a flag stands for NULL.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[e.alias(n) for n, (_, e) in zip(names, keys)])
    wanted = kept.select(*[F.col(c).alias(n) for n, (c, _) in zip(names, keys)])
    kinds = {n: rows.schema[n].dataType for n in names}

    def without_nulls(df: DataFrame) -> DataFrame:
        flags = {f"{n}_none": F.col(n).isNull() for n in names}
        return df.withColumns(flags).withColumns({n: F.coalesce(F.col(n), F.lit(0).cast(kinds[n])) for n in names})

    on = [c for n in names for c in (n, f"{n}_none")]
    first = Window.partitionBy(*on).orderBy("_hash")
    joined = without_nulls(rows).withColumn("_hash", F.xxhash64("_row")).join(without_nulls(wanted).distinct(), on, "left_semi")
    return joined.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("_row.*")
