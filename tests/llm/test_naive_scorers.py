"""Scores of whole tables against the plainest way to compute them from a fitted model."""

import math
import zlib

import pytest
import zstandard

from lagweave.llm import quality, toxicity


def naive_compressor(words):
    """zstandard with the words as a raw dictionary, made anew."""
    known = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=quality.LEVEL)
    return zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)


@pytest.fixture
def tables(spark, small):
    return tuple(spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))


def test_toxicity_is_the_sum_of_the_weights_of_a_text(tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = toxicity.severities(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        own = {f for w in toxicity.words_of(texts[r["doc_id"]]) for f in toxicity.features_of(w)}
        total = sum(model.weights.get(f, 0.0) for f in own)
        over = [1 / (1 + math.exp(t - total)) for t in model.thresholds]  # P(grade over 0), P(grade over 1), ..
        shares = [a - b for a, b in zip([1.0, *over], [*over, 0.0])]
        assert r["toxic_probability"] == pytest.approx(over[0], abs=1e-9)
        assert r["expected_severity"] == pytest.approx(sum(k * p for k, p in enumerate(shares)), abs=1e-9)
        assert shares[r["severity"]] == pytest.approx(max(shares), abs=1e-9)
        assert r["toxic"] == (over[0] >= model.cut) or abs(over[0] - model.cut) < 1e-9


def test_quality_is_the_difference_of_two_compressed_sizes(tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    assert 0 < len(model.good) <= quality.DICTIONARY and 0 < len(model.bad) <= quality.DICTIONARY
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    compressors = [naive_compressor(words) for words in (model.good, model.bad)]
    for r in rows:
        sizes = []
        for own in compressors:
            sizes.append(sum(len(own.compress(part)) - quality.FRAME for part in quality.shapes(texts[r["doc_id"]])))
        size = max(sum(sizes), 1)
        logit = model.weights[0] * (sizes[1] - sizes[0]) / size + model.weights[1] / (1 + size / quality.SHORT) + model.weights[2]
        score = 1 / (1 + math.exp(-min(30.0, max(-30.0, logit))))
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert r["predicted"] == int(score >= quality.CUT) or abs(score - quality.CUT) < 1e-9
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
