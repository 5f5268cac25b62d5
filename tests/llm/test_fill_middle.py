import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lagweave.llm import fill_middle


def hashes(doc):
    h = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    return [int(h[8 * j : 8 * j + 8], 16) for j in range(4)]


def brute(doc, text, rate=100, first=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashes(doc)
    one, two = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, t
    p, m, s = ("".join(x) for x in (units[:one], units[one:two], units[two:]))
    spm = h[3] % 100 < first
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def run(rows, rate=100, first=50):
    texts = [(t or "").encode() for _, t in rows]
    n, form, p, m, out = fill_middle.transform(texts, np.array([hashes(d) for d, _ in rows], np.int64).reshape(-1, 4), rate, first)
    outputs = out.to_pylist()
    back = fill_middle.rebuild([o.encode() for o in outputs], form.tolist()).to_pylist()
    return list(zip(n.tolist(), form.tolist(), p.to_pylist(), m.to_pylist(), outputs)), back


TEXT = st.text(st.sampled_from("ab\n\n<>PSMé漢😀 "), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.none() | TEXT), max_size=12), st.sampled_from([1, 3, 1 << 20]), st.sampled_from([(100, 50), (60, 0), (100, 100)]))
def test_outputs_and_way_back_equal_plain_python(rows, window, shares):
    old, fill_middle.WINDOW = fill_middle.WINDOW, window
    try:
        got, back = run(rows, *shares)
    finally:
        fill_middle.WINDOW = old
    assert got == [brute(d, t, *shares) for d, t in rows]
    assert back == [t or "" for _, t in rows]


def test_markers_that_only_touch_are_no_markers():
    rows = [(i, t) for i, t in enumerate(["<P", ">", "<", "S>\n", "<P\n>", "x<", "P>y", "<M", "><P>", "a<S>b\n"])]
    got, back = run(rows)
    assert [g[1] == "plain" for g in got] == [False] * 8 + [True, True]
    assert got == [brute(d, t) for d, t in rows] and back == [t for _, t in rows]


def test_rows_of_all_kinds_through_spark(spark):
    long = "\n".join(f"line {i} é" for i in range(60_000))
    rows = [(1, None), (2, ""), (None, "a\nb\n"), (3, "x\n" * 7), (3, "x\n" * 7), (3, "other\ntext"), (4, long), (5, "no end\n\n\r\nmore"), (-6, "漢字\n" * 3)]
    docs = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, output string, n int").repartition(3)
    got = fill_middle.transform_and_restore(docs).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [(d, *b[:4], sha(b[4]), sha(t or "")) for d, t in rows for b in [brute(d, t)]]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert fill_middle.transform_and_restore(docs.limit(0)).collect() == []


@pytest.mark.parametrize("rate, first, forms", [(0, 50, {"plain"}), (100, 0, {"psm"}), (100, 100, {"spm"})])
def test_rates(spark, rate, first, forms):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('a\\n', id, '\\nc') AS text")
    assert {r["form"] for r in fill_middle.fill_middle(docs, rate=rate, suffix_first=first).collect()} == forms
