import hashlib
import math
import random

import numpy as np
import pytest

from lagweave.llm import centroids


def brute(rows, clusters=8, rounds=10, width=64, scale=1024, seed=3):
    kept = []
    for vec, x in rows:
        if x is not None and len(x) == width and all(v is not None and math.isfinite(v) and abs(v) < centroids.LARGEST for v in x):
            kept.append((vec, [math.floor(scale * v) for v in x]))
    digest = lambda v: hashlib.sha256(f"{seed}:{'' if v is None else v}".encode()).hexdigest()
    centers = [x for _, _, x in sorted((digest(v), x, x) for v, x in kept)[:clusters]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(centers)):
            mine = [x for (_, x), o in zip(kept, own) if o == j]
            if mine:
                centers[j] = [sum(c) // len(mine) for c in zip(*mine)]
    final = [nearest(x) for _, x in kept]
    return sorted((repr(v), j, d) for (v, _), (d, j) in zip(kept, final)), centers


def vectors(count, width, seed, spread=0.15, kinds=12):
    random.seed(seed)
    middles = [[random.gauss(0, 0.3) for _ in range(width)] for _ in range(kinds)]
    return [(i, [float(np.float32(m + random.gauss(0, spread))) for m in random.choice(middles)]) for i in range(count)]


def run(spark, rows, **options):
    frame = spark.createDataFrame([(v, x, 1, "c") for v, x in rows], "vec_id long, embedding array<float>, cluster int, _vector string").repartition(3)
    found, centers = centroids.cluster_vectors(frame, **options)
    return sorted((repr(r["vec_id"]), r["cluster"], r["distance"]) for r in found.collect()), centers.tolist()


def test_rounds_equal_plain_rounds(spark):
    rows = vectors(400, 64, 1)
    evaluated = []
    assert run(spark, rows, evaluations=evaluated) == brute(rows)
    assert evaluated[0] == 8 * 400 and evaluated[-1] < evaluated[0] / 2


@pytest.mark.parametrize("seed", range(3))
def test_odd_vectors_ties_and_copies(spark, seed):
    random.seed(seed)
    rows = [(i, [float(random.randint(-2, 2)) for _ in range(3)]) for i in range(80)]  # many ties
    rows += rows[:30] + [(5, [1.0, 1.0, 2.0]), (5, [0.0, -1.0, 2.0]), (None, [1.0, 2.0, 1.0]), (None, [1.0, 0.0, 1.0])]
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [float("nan"), 0.0, 0.0]), (905, [float("inf"), 0.0, 0.0]), (906, [1e30, 0.0, 0.0])]
    options = {"clusters": 5, "rounds": 6, "width": 3, "scale": 3}
    assert run(spark, rows, **options) == brute(rows, 5, 6, 3, 3)


def test_few_vectors_and_none(spark):
    rows = vectors(3, 64, 2)
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(1, [1.0])])[0] == []
    assert centroids.cluster_report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [float((i * 7919 % 131) * (-1) ** i * 1000), 131071.0 - i]) for i in range(60)]
    assert run(spark, rows, clusters=4, width=2) == brute(rows, 4, 10, 2)


def test_history_bounds_are_tighter_than_summed_drifts():
    history = np.array([[[0, 0]], [[30, 0]], [[0, 1]]])
    assert centroids.displacements(history)[0, 0] == 1.0  # summed: 30 and 30.02


def test_old_rounds_are_removed(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    centroids.cluster_vectors(spark.createDataFrame(vectors(60, 64, 4), "vec_id long, embedding array<float>"))[0].collect()
    assert len(set(os.listdir(folder)) - before) == 1
