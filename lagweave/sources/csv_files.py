"""CSV sources. Everything is read as text and typed later, never inferred."""

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.clean import parse_number, present, zero_fill
from ..functions.fixed_values import LISTING_COLUMNS, LISTING_PREAMBLE_LINES, TWO_FILE_ATTRIBUTE


def _leading_lines(spark: SparkSession, path: str, n: int) -> list[str]:
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(n).collect()
    return [line["value"] for line in lines]


def _cells(line: str) -> list[str]:
    return next(csv.reader([line.lstrip("\ufeff")]))


def _same_row(columns: list[str], cells: list[str]) -> Column:
    """True for rows that repeat a given line, whichever file or split they come from."""
    same = F.lit(True)
    for name, cell in zip(columns, cells):
        same = same & F.col(f"`{name}`").eqNullSafe(F.lit(cell if cell != "" else None))
    return same


def read_wide_days(spark: SparkSession, path: str) -> DataFrame:
    """The wide-day CSV: a preamble line, a header line, then one row per site, approach and day.

    Several files or splits are read at once, so the two leading lines are dropped by value, not by position.
    """
    preamble, header = _leading_lines(spark, path, 2)
    names: list[str] = []
    for i, name in enumerate(_cells(header)):
        names.append(name if name and name not in names else f"{name}_{i}")
    schema = StructType([StructField(name, StringType()) for name in names])
    rows = spark.read.schema(schema).csv(path, header=False, encoding="UTF-8")
    width = len(names)
    lead = [(_cells(line) + [""] * width)[:width] for line in (preamble, header)]
    # Any leading byte-order mark stays in the first cell of a preamble; the other cells identify the line.
    return rows.where(~_same_row(names, lead[1])).where(~_same_row(names[1:], lead[0][1:]) | ~_starts_like(names[0], lead[0][0]))


def _starts_like(name: str, cell: str) -> Column:
    text = F.regexp_replace(F.coalesce(F.col(f"`{name}`"), F.lit("")), "^\ufeff", "")
    return text == F.lit(cell)


def read_site_listing(spark: SparkSession, path: str) -> DataFrame:
    """The site listing: a preamble and a header, then rows renamed by position; short rows are padded with NULL.

    Rows without a site number are dropped. The preamble is counted in physical lines of each file, blank ones included.
    """
    lines = _without_first_lines(spark.read.text(path), LISTING_PREAMBLE_LINES + 1)
    schema = ", ".join(f"{name} string" for name in LISTING_COLUMNS)
    row = F.from_csv("value", F.lit(schema)).alias("row")
    listing = lines.select(row).select("row.*").withColumns({c: present(F.col(c)) for c in LISTING_COLUMNS})
    return listing.where(F.col("Site_Number").isNotNull())


def _without_first_lines(lines: DataFrame, n: int) -> DataFrame:
    """Lines of text files without the first n of each file; these stand in a file's first split, which is of bounded size."""
    placed = lines.select("value", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") > 0).alias("_later"))
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    first = Window.partitionBy("_file").orderBy("_at")
    begun = placed.where(~F.col("_later")).withColumn("_line", F.row_number().over(first)).where(F.col("_line") > n)
    return begun.select("value").union(placed.where("_later").select("value"))


def read_two_files(spark: SparkSession, train: str, test: str, attribute: str = TWO_FILE_ATTRIBUTE) -> DataFrame:
    """(source_file, file_block, file_order, flow) of a train and a test CSV whose row order is time order.

    Either may be a folder of files in the order of their names. `file_block` is the file and the byte offset of the split
    a row was read from, and `file_order` rises within it, so (file_block, file_order) is the order of the rows, and `file_block` is a
    chunk of bounded size.
    """

    def one(path, label):
        rows = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
        return rows.select(
            F.lit(label).alias("source_file"),
            F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("file_block"),
            F.monotonically_increasing_id().alias("file_order"),
            zero_fill(parse_number(F.col(f"`{attribute}`"))).alias("flow"),
        )

    return one(train, "train").unionByName(one(test, "test"))
