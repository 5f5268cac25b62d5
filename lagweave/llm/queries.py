"""The registered queries of the text operators: (spark, folder) -> DataFrame over whole tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from ..sources.events import read_table
from . import (
    bpe, centroids, chat, decontaminate, exact_dedup, fill_middle, license_scan, quality, sharding, simhash, token_files, toxicity, url_filter,
)

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    REGISTRY[function.__name__] = function
    return function


@query
def op1_bpe_encoding(spark, folder):
    """Token ids of every document and the text they decode to, as digests."""
    return bpe.encode_documents(read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_chat_formatting(spark, folder):
    """All conversations formatted with generation markers, and what is read back from the written result."""
    return chat.format_and_read(read_table(spark, folder, "conversations"))


@query
def op3_simhash_near_dedup(spark, folder):
    """Fingerprint of three-word shingles and component at three differing bits or fewer, for every document."""
    return simhash.near_components(read_table(spark, folder, "documents"))


@query
def op4_exact_dedup(spark, folder):
    """Which document stays for every document, texts being equal up to white space."""
    return exact_dedup.duplicate_groups(read_table(spark, folder, "documents"))


@query
def op5_license_scan(spark, folder):
    """Every text, paragraph and line of the documents that is a known licence text or notice."""
    return license_scan.license_matches(read_table(spark, folder, "documents"))


@query
def op6_toxicity(spark, folder):
    """Expected severity and toxic flag of every document."""
    return toxicity.severities(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query
def op7_sharding(spark, folder):
    """Sixteen shards of near equal bytes over all documents, equal texts together."""
    return sharding.shard_rows(read_table(spark, folder, "documents"), 16)


@query
def op8_token_files(spark, folder):
    """All documents as token ids, written in coded blocks and read back."""
    return token_files.write_and_read(read_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


@query
def op9_quality_classifier(spark, folder):
    """Quality score of every document, learned from the labelled ones that are not held out."""
    return quality.quality_scores(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query
def op10_benchmark_decontamination(spark, folder):
    """The benchmark items that documents hold, edited ones included, over all documents."""
    return decontaminate.leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query
def op11_url_filter(spark, folder):
    """Rule or reputation of every page's url; a page is bad if the label under its id says poor or toxic, as pages have no labels of their own."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    pages, labels = read_table(spark, folder, "pages"), read_table(spark, folder, "labels")
    return url_filter.judge(pages, labels, url_filter.RULES, outcome_id="doc_id", bad=bad)


@query
def op12_fill_in_middle(spark, folder):
    """Every document in fill-in-middle form, and what is restored from the output, as digests."""
    return fill_middle.transform_and_restore(read_table(spark, folder, "documents"))


@query
def op13_centroid_clustering(spark, folder):
    """Eight clusters of all embeddings after ten exact rounds."""
    return centroids.cluster_report(read_table(spark, folder, "embeddings"))


@query
def pipeline(spark, folder):
    """The stages of corpus_pipeline.py over all documents."""
    return corpus_pipeline.run(spark, folder)


SQL["op5_license_scan"] = license_scan.ORACLE_SQL
SQL["op11_url_filter"] = url_filter.ORACLE_SQL
SQL["op12_fill_in_middle"] = fill_middle.ORACLE_SQL
SQL["op13_centroid_clustering"] = centroids.oracle_sql()
SQL["op4_exact_dedup"] = r"""
WITH rows AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), groups AS (
    SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM rows JOIN groups USING (t)
"""
