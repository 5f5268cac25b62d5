"""Exact duplicates by skew-safe combining.

1. Locally: every task reduces its own rows to one row per text (Spark's map-side aggregate).
2. Salted: these go by (digest, salt, text), the salt being the task that made them, so that the rows of a hot text, one
   per task, are spread over `salts` reducers.
3. Globally: the salt winners go by (digest, text); at most `salts` rows per text arrive.

The text itself is part of the grouping key in all three stages, so a digest collision cannot merge two texts. Decisions go
back to the rows by digest, length and a second hash, without moving texts again.

Defined cases: a NULL text is an empty text, and empty texts are equal to each other. NULL ids never win against an id; a
group of NULL ids only keeps one of them. Rows that repeat id and text are members of their group. An empty table gives no
rows. Further columns are ignored by `duplicate_groups` and kept by `keep_first`.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .common import keep_rows, text_of

BLANKS = "[\\x20\\x09-\\x0D]+"


def normalised(text: str = "text") -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text_of(text), BLANKS, " ")


def _digests(text: Column) -> dict[str, Column]:
    return {"_digest": F.sha2(text, 256), "_check": F.xxhash64(text), "_length": F.octet_length(text)}


def combined(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = 32) -> DataFrame:
    """One row per distinct text: (_digest, _check, _length, keep_id, group_size)."""
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), normalised(text_column).alias("_text"))
    rows = rows.withColumns({"_digest": F.sha2("_text", 256), "_salt": F.pmod(F.spark_partition_id(), F.lit(salts))})
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.min("_id").alias("_id"), F.count("*").alias("_n"))
    whole = salted.groupBy("_digest", "_text").agg(F.min("_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    text = F.col("_text")
    return whole.select("_digest", F.xxhash64(text).alias("_check"), F.octet_length(text).alias("_length"), "keep_id", "group_size")


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = 32) -> DataFrame:
    """One row per row of `docs`: (id, keep_id, group_size, kept, text_sha256)."""
    rows = docs.select(F.col(f"`{id_column}`").alias("_id"), normalised(text_column).alias("_text"))
    rows = rows.select("_id", *[c.alias(n) for n, c in _digests(F.col("_text")).items()])
    joined = rows.join(combined(docs, id_column, text_column, salts), ["_digest", "_check", "_length"])
    return joined.select(
        F.col("_id").alias(id_column),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = 32) -> DataFrame:
    """The rows of `docs` without later copies: of equal texts, the one row with the smallest id."""
    text = normalised(text_column)
    keys = [("keep_id", F.col(f"`{id_column}`")), ("_digest", F.sha2(text, 256)), ("_length", F.octet_length(text))]
    return keep_rows(docs, keys, combined(docs, id_column, text_column, salts))
