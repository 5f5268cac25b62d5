"""The pipeline against plain Python over a small corpus, and the registration of all operators."""

import hashlib
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from lagweave.llm import decontaminate, quality
from test_dedup_and_shards import normal, simple_fingerprint, simple_roots


def plain_pipeline(spark, rows, folder):
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    w = np.array(model.weights)
    good = [(i, t) for i, t in rows if 1 / (1 + np.exp(-(np.array([*quality.features((t or "").encode(), model), 1.0]) @ w))) >= 0.7]
    first = {}
    for i, t in sorted(good, key=lambda r: r[0]):
        first.setdefault(normal(t), (i, t))
    prints = {i: simple_fingerprint(t) for i, t in first.values()}
    points = sorted(set(prints.values()))
    roots = simple_roots(points, [(a, b) for k, a in enumerate(points) for b in points[:k] if (a ^ b).bit_count() <= 3])
    lowest = {}
    for i, p in prints.items():
        lowest[roots[p]] = min(i, lowest.get(roots[p], i))
    kept = [(i, t) for i, t in first.values() if i in lowest.values()]
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    fold = lambda t: decontaminate.canonical((t or "").encode()).decode()
    most = lambda x: int(decontaminate.EDITED * len(x))
    clean = [(i, t) for i, t in kept if not any(decontaminate.passage_distance(fold(x), fold(t), most(x)) <= most(x) for x in items)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, t in clean:
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        out.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), packed))
    return sorted(out)


def test_pipeline_equals_brute_force(spark, small, tmp_path):
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"][:3000], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet").limit(4)
    leak = benchmark.first()["text"]
    near = max((r[1] for r in rows), key=len)
    rows += [(1000, rows[5][1].replace(" ", "  "), None, "x", 1), (1001, rows[6][1], "en", None, 1), (1002, near + " more", "en", "x", None)]
    rows += [(1003, rows[7][1] + " " + leak + " " + rows[8][1], "en", "x", 1), (1004, None, None, None, None), (1005, "", "en", "x", 0), (1006, rows[9][1], "en", "x", 1), (1006, rows[9][1], "en", "x", 1)]
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], bytes(r["ids"])) for r in got) == plain_pipeline(spark, [r[:2] for r in rows], folder)
    assert 20 < len(got) < len(rows) and 1003 not in {r["doc_id"] for r in got}


def test_stages_keep_the_columns_and_take_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "leaks", "tokens"]
    wide = docs.selectExpr("*", "'x' AS _row", "1 AS keep_id", "'y' AS fingerprint", "0 AS score").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, small)
        assert out.columns == wide.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, wide, small).count() == 0


def test_every_operator_is_registered():
    names = set(entry.queries())
    for n in range(1, 11):
        assert len([x for x in names if re.match(rf"op{n}_", x)]) == 1
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()
