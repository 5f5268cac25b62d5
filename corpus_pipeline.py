"""A corpus pipeline: quality, exact copies, near copies, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last keep the columns of documents and drop rows:

1. quality: documents whose score, learned from `labels`, stays under the cut go;
2. exact: of equal texts (up to white space) the one with the smallest id stays;
3. near: of each component of near fingerprints the document with the smallest id stays;
4. leaks: documents that hold a benchmark item, edited ones included, go;
5. tokens: ids of the remaining texts, their digest, and the digest of the text they decode to.

NULL texts count as empty. An empty table passes through. Ids that repeat with equal texts are copies.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lagweave.llm import bpe, decontaminate, exact_dedup, quality, simhash
from lagweave.sources.events import read_table
from lagweave.sources.shared import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("leaks", leak_stage),
    ("tokens", token_stage),
]

#: Fingerprints, compression and tokenizers have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
