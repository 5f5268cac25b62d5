"""Exact duplicates, near duplicates and shards against brute force on small tables."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

import numpy as np
from lagweave.llm import components, exact_dedup, sharding, simhash

DOCS = "doc_id long, text string, kept string, _row int"


def table(spark, rows):
    """Rows (doc_id, text) with further columns whose names clash with those of results and internals."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [words(rng, rng.choice([1, 2, 3, 40, 120])) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    hot = base[20]
    rows += [(100 + i, hot.replace(" ", rng.choice([" ", "  ", "\t\n", "\x0b"]))) for i in range(60)]
    for i in range(40):  # near copies
        near = base[i].split(" ")
        near[rng.randrange(len(near))] = "changed"
        rows.append((200 + i, " ".join(near)))
    rows += [(300, None), (301, ""), (302, " \n "), (303, "Ünï  cödé"), (None, "no id"), (None, base[3]), (7, base[7]), (7, base[7])]
    rows += [(400, words(rng, 30_000))]
    rng.shuffle(rows)
    return rows


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups_equal_brute_force(spark, corpus):
    got = exact_dedup.duplicate_groups(table(spark, corpus).repartition(7)).collect()
    groups = {}
    for i, t in corpus:
        groups.setdefault(normal(t), []).append(i)
    expected = []
    for i, t in corpus:
        ids = groups[normal(t)]
        low = min((x for x in ids if x is not None), default=None)
        expected.append((i, low, len(ids), i == low, hashlib.sha256(normal(t).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_exact_keep_first_leaves_one_row_per_text(spark, corpus):
    docs = table(spark, corpus)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({normal(t) for _, t in corpus}) == len({normal(r["text"]) for r in rows})
    lowest = {}
    for i, t in corpus:
        if i is not None:
            lowest[normal(t)] = min(i, lowest.get(normal(t), i))
    assert all(r["doc_id"] == lowest.get(normal(r["text"])) for r in rows)


def simple_fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simple_roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_components_equal_brute_force(spark, corpus):
    prints = [(i, simple_fingerprint(t)) for i, t in corpus]
    distinct = sorted({f for _, f in prints})
    linked = [(a, b) for k, a in enumerate(distinct) for b in distinct[:k] if (a ^ b).bit_count() <= 3]
    assert linked
    roots = simple_roots(distinct, linked)
    lowest = {}
    for i, f in prints:
        if i is not None:
            lowest[roots[f]] = min(i, lowest.get(roots[f], i))
    expected = [(i, f"{f:016x}", lowest.get(roots[f])) for i, f in prints]
    docs = table(spark, corpus)
    got = [tuple(r) for r in simhash.near_components(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [r["doc_id"] for r in kept.collect()]
    assert sorted(rows, key=str) == sorted((lowest.get(r) for r in set(roots.values())), key=str)


def test_every_pair_within_the_radius_meets(spark):
    rng = random.Random(3)
    for radius in (1, 2, 3):
        chosen = simhash.masks(radius)
        assert len(chosen) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            differing = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not m & differing for m in chosen)


@pytest.mark.parametrize("bucket", [1, 8, 256])
def test_links_of_a_dense_group(spark, bucket):
    """A large group of near fingerprints: small limits send its buckets through the second covering."""
    rng = random.Random(bucket)
    center = rng.getrandbits(64)
    prints = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(300)}
    prints |= {rng.getrandbits(64) for _ in range(100)}
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    points = spark.createDataFrame([(f,) for f in signed], "_fp long")
    got = components.components(simhash.links(points, 3, bucket)).collect()
    linked = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3]
    roots = simple_roots(signed, linked)
    expected = {n: r for n, r in roots.items() if n != r}
    assert {r["node"]: r["root"] for r in got} == expected


def test_components_of_a_path_a_hub_and_nothing(spark):
    path = [(i, i + 1) for i in range(40)]
    hub = [(100, 100 + i) for i in range(1, 300)]
    links = spark.createDataFrame(path + hub + [(7, 7), (None, 3)] + path[:5], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 300)}}
    assert components.components(links.limit(0)).count() == 0


def simple_cuts(sizes, shards):
    """Minimax by trying every capacity; the sizes are those of the groups in order."""
    for capacity in range(max(sizes), sum(sizes) + 1):
        out, room = [[]], capacity
        for s in sizes:
            if s > room:
                out.append([])
                room = capacity
            out[-1].append(s)
            room -= s
        if len(out) <= shards:
            return out


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_shards_are_minimax(spark, corpus, shards):
    rows = [(i if i is not None else -1 - k, t) for k, (i, t) in enumerate(corpus)]
    got = sharding.shard_rows(table(spark, rows).repartition(5), shards).collect()
    text = dict(rows)
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    ordered = sorted(groups, key=lambda t: min(groups[t]))
    sizes = [len(groups[t]) * (len(t.encode()) + 1) for t in ordered]
    shard_of, k = {}, 0
    for shard, taken in enumerate(simple_cuts(sizes, shards)):
        for _ in taken:
            shard_of[ordered[k]] = shard
            k += 1
    slots = {}
    for r in got:
        t = text[r["doc_id"]] or ""
        assert r["shard"] == shard_of[t] and r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
        assert r["law"] == "bytes" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("bins", [32, 64, 1024])
def test_cuts_are_exact_for_any_bins(spark, bins):
    rng = np.random.default_rng(bins)
    sizes = rng.integers(1, 400, 700)
    ends = np.cumsum(sizes)
    frame = spark.createDataFrame([(int(e), i + 1) for i, e in enumerate(ends)], "_end long, _row long")
    cuts = sharding.minimax_cuts(frame, 16, int(ends[-1]), len(sizes), int(sizes.max()), bins)
    parts = simple_cuts(sizes.tolist(), 16)
    expected = np.cumsum([sum(p) for p in parts]).tolist()
    assert [c for c, _ in cuts][: len(expected)] == expected
    assert [r for _, r in cuts][: len(expected)] == np.cumsum([len(p) for p in parts]).tolist()


def test_empty_tables(spark):
    none = table(spark, [(1, "a")]).limit(0)
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert exact_dedup.keep_first(none).columns == none.columns
    assert simhash.near_components(none).count() == 0
    assert simhash.keep_one(none).count() == 0
    assert sharding.shard_rows(none).count() == 0


def test_shards_use_built_in_expressions_only(spark, corpus):
    plan = sharding._ordered(table(spark, corpus), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
