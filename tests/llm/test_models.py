"""Classifiers on held-out rows, licence lookups, and benchmark passages against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.llm import decontaminate, license_scan, quality, toxicity

DOCS = "doc_id long, text string, score string, _text int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(3)


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def truth(spark, folder, column):
    rows = spark.read.parquet(f"{folder}/labels.parquet").collect()
    return {r["doc_id"]: r[column] for r in rows}


@pytest.fixture(scope="module")
def middle():
    return "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark, middle):
    docs, labels = (spark.read.parquet(f"{middle}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).collect()
    known = truth(spark, middle, "quality")
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows)
    tested = [r["predicted"] == known[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in known]
    assert len(tested) > 60 and np.mean(tested) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)


def test_held_out_labels_do_not_matter(spark, middle):
    docs, labels = (spark.read.parquet(f"{middle}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, turned)


def test_quality_of_odd_tables(spark):
    docs = table(spark, [(1, None), (2, ""), (None, "Some text."), (3, "word " * 100_000), (3, "word " * 100_000)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] > 0.99 for r in quality.quality_scores(docs, none).collect()] == [True] * 5
    bad = spark.createDataFrame([(1, 0), (3, 0), (None, 1), (2, None), (99, 1)], "doc_id long, quality int")
    assert {r["predicted"] for r in quality.quality_scores(docs, bad).collect()} == {0}
    assert quality.quality_scores(docs.limit(0), bad).count() == 0
    rng = random.Random(1)
    texts = [(k, " ".join(rng.choice(["good", "fine", "words,", "here."]) for _ in range(60))) for k in range(60)]
    texts += [(100 + k, " ".join(rng.choice(["BAD!!", "JUNK!!", "X$$"]) for _ in range(60))) for k in range(60)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in texts], "doc_id long, quality int")
    rows = quality.quality_scores(table(spark, [*texts, (None, None), (777, "")]), labels).collect()
    assert len(rows) == 122 and all(r["predicted"] == (r["doc_id"] < 100) for r in rows if r["doc_id"] in dict(texts) and r["doc_id"] is not None)


def test_shapes():
    assert quality.shapes(b"Some words, words words.\nAB!! x9$$") == [b"Aa a, a a. \n AA!! a9$$"]
    assert quality.shapes("été été".encode()) == [b"a ="]


def test_toxicity_on_held_out_rows(spark, middle):
    docs, labels = (spark.read.parquet(f"{middle}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    rows = toxicity.severities(docs, labels.where(~out)).collect()
    known = truth(spark, middle, "toxic")
    assert len(rows) == docs.count()
    assert all(0 <= r["expected_severity"] <= 2 and r["severity"] in (0, 1, 2) for r in rows)
    tested = [(r["toxic"], known[r["doc_id"]] == 1) for r in rows if held(r["doc_id"]) and r["doc_id"] in known]
    assert np.mean([a == b for a, b in tested]) > 0.88
    assert np.mean([a for a, b in tested if not b]) < 0.05
    told = [r["severity"] for r in rows if not held(r["doc_id"]) and known.get(r["doc_id"]) == 1]
    assert {1, 2} <= set(told)


def test_ordinal_thresholds_share_weights_and_keep_their_order():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (3000, 8))
    z = x @ np.array([2.0, -2, 1, 0, 0, 3, 0, -1]) + rng.logistic(size=3000)
    grades = (z > 0).astype(int) + (z > 2) + (z > 4)
    rows, columns = np.nonzero(x)
    w, t = toxicity.fit_ordinal(rows, columns, grades, 8, ridge=0.1, rounds=800)
    assert (np.diff(t) > 1).all() and abs(t - [0, 2, 4]).max() < 0.6
    assert abs(w - [2, -2, 1, 0, 0, 3, 0, -1]).max() < 0.5


def test_toxicity_of_odd_tables(spark):
    docs = table(spark, [(1, None), (2, ""), (None, "text"), (3, "word " * 50_000)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["toxic"] for r in toxicity.severities(docs, none).collect()} == {False}
    ones = spark.createDataFrame([(3, 1), (2, 1), (None, 0), (9, 0), (1, None)], "doc_id long, toxic int")
    assert {r["toxic"] for r in toxicity.severities(docs, ones).collect()} == {True}
    assert toxicity.severities(docs.limit(0), none).count() == 0


MIT = next(t for n, t in license_scan.KNOWN if n == "MIT" and t.startswith("Permission"))


def test_licences(spark):
    rows = [
        (1, "Copyright (c) 2020 Some One\n\n" + MIT),
        (2, MIT.upper().replace(",", " -- ")),
        (3, "Some text.\nreleased UNDER the MIT Licence\nmore"),
        (4, "Some text. Released under the MIT License."),
        (5, "first part\n\nLicensed under the Apache License,\nVersion 2.0.\n\nlast part"),
        (6, None),
        (7, ""),
        (None, "SPDX-License-Identifier: MIT"),
        (8, "no licence\n" * 20_000 + "SPDX-License-Identifier: ISC"),
        (9, "SPDX-License-Identifier: ISC\nSPDX-License-Identifier: ISC"),
    ]
    got = sorted(map(tuple, license_scan.license_matches(table(spark, rows)).collect()), key=str)
    assert got == sorted(
        [
            (1, "text", 0, "MIT"),
            (2, "text", 0, "MIT"),
            (3, "line", 1, "MIT"),
            (5, "paragraph", 1, "Apache-2.0"),
            (None, "text", 0, "MIT"),
            (8, "line", 20_000, "ISC"),
            (9, "line", 0, "ISC"),
            (9, "line", 1, "ISC"),
        ],
        key=str,
    )
    assert license_scan.license_matches(table(spark, rows).limit(0)).count() == 0
    plan = license_scan.license_matches(table(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def simple_distance(item, text):
    above = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (a != b)))
        above = row
    return min(above)


def test_passage_distance_equals_dynamic_programming():
    rng = random.Random(6)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 30)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 50)))
        assert decontaminate.passage_distance(item, text, 99) == simple_distance(item, text)


def edited(rng, text, share):
    out = []
    for c in text:
        kind = rng.random() / share
        out.append("" if kind < 1 / 3 else rng.choice("abcdefgh ") if kind < 2 / 3 else c + "x" if kind < 1 else c)
    return "".join(out)


def test_leaks_are_found_and_clean_documents_left(spark, middle):
    rng = random.Random(9)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{middle}/benchmark.parquet").collect()]
    clean = [r["text"] for r in spark.read.parquet(f"{middle}/documents.parquet").limit(300).collect()]
    clean = [t for t in clean if not any(i in t for _, i in items)][:150]
    rows, expected = [(k, t) for k, t in enumerate(clean)], set()
    for k, (item, text) in enumerate(items):
        base = clean[k % len(clean)][:800]
        for kind, hidden in enumerate([text, text.upper(), text.replace(" ", "\n"), edited(rng, text, 0.03), edited(rng, text, 0.07)]):
            rows.append((1000 * (kind + 1) + k, f"{base} {hidden} {base}"))
            expected.add((1000 * (kind + 1) + k, item))
    rows += [(None, items[0][1]), (90_000, None), (90_001, ""), (90_002, "word " * 30_000 + items[1][1])]
    expected |= {(None, items[0][0]), (90_002, items[1][0])}
    benchmark = spark.createDataFrame([*items, (900, None), (901, ""), (902, "short one"), (None, items[2][1])], "item_id long, text string")
    docs = table(spark, rows)
    got = decontaminate.leaks(docs, benchmark.where("item_id IS NOT NULL")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert pairs <= expected and len(pairs) >= 0.97 * len(expected)
    texts = dict(items)
    by_id = dict(rows)
    for r in got[::7]:
        folded = decontaminate.canonical(by_id[r["doc_id"]].encode()).decode()
        wanted = decontaminate.canonical(texts[r["item_id"]].encode()).decode()
        if len(folded) < 4000:
            assert r["edits"] == simple_distance(wanted, folded)
    kept = decontaminate.keep_clean(docs, benchmark)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and ids == {i for i, _ in rows} - {d for d, _ in pairs}


def test_items_in_blocks_and_empty_tables(spark, monkeypatch):
    items = [(k, f"item {k} " + " ".join(f"w{k}x{j}" for j in range(20))) for k in range(7)]
    docs = table(spark, [(k, f"before {t} after") for k, t in items] + [(50, "nothing of it")])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", ("item_id", "text", 3))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()} == {(k, k) for k in range(7)}
    assert [r["doc_id"] for r in decontaminate.keep_clean(docs, benchmark).collect()] == [50]
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.keep_clean(docs, benchmark.limit(0)).count() == 8
    assert decontaminate.leaks(docs.limit(0), benchmark).count() == 0
