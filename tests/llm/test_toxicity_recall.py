"""Recall of the toxic flag on held-out labels, beside its false alarms."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from lagweave.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


def test_recall_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    taught = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    rows = [(r["toxic"], known[r["doc_id"]]) for r in toxicity.severities(docs, taught).collect() if r["doc_id"] in known]
    assert sum(t == 1 for _, t in rows) >= 100
    assert np.mean([flag for flag, t in rows if t == 1]) > 0.8
    assert np.mean([flag for flag, t in rows if t == 0]) < 0.02
