"""Orders by permutation: a bijection of any size, without an exchange, the same in plain Python."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from lagweave.operators.permute import PRIME, ROUNDS, permuted, permuted_tail


def brute_place(position, n, key, seed=42):
    digest = hashlib.sha256(f"{key}|{seed}".encode()).hexdigest()
    u = [int(digest[7 * k : 7 * k + 7], 16) for k in range(8)]
    a = math.ceil(math.sqrt(n))
    b = (n + a - 1) // a
    cell = position - 1
    while True:
        parts = [cell // b, cell % b]
        for step in range(ROUNDS):
            to = step % 2
            h = ((parts[1 - to] % PRIME) * (u[step] + 1) + u[(step + 2) % 8]) % PRIME
            parts[to] = (parts[to] + pow(h, 3, PRIME)) % (b if to else a)
        cell = parts[0] * b + parts[1]
        if cell < n:
            return cell + 1


def test_a_bijection_for_every_size(spark):
    rows = spark.range(1, 2001).select(F.col("id").alias("n_train"), F.lit("s").alias("site_id")).withColumn("idx", F.explode(F.sequence(F.lit(1), "n_train")))
    places = permuted(rows.repartition(8)).groupBy("n_train").agg(F.countDistinct("shuffle_pos").alias("k"), F.min("shuffle_pos").alias("lo"), F.max("shuffle_pos").alias("hi"))
    bad = places.where("k <> n_train OR lo <> 1 OR hi <> n_train OR k IS NULL")
    assert places.count() == 2000 and bad.isEmpty()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 1009])
def test_places_equal_plain_python(spark, n):
    rows = spark.range(1, n + 1).select(F.col("id").alias("idx"), F.lit(n).alias("n_train"), F.explode(F.array(F.lit("a"), F.lit("0970"))).alias("site_id"))
    got = {(r["site_id"], r["idx"]): r["shuffle_pos"] for r in permuted(rows).collect()}
    assert got == {(k, i): brute_place(i, n, k) for k in ("a", "0970") for i in range(1, n + 1)}


def test_large_sizes_and_odd_rows(spark):
    sizes = [(1 << 40) + 3, (1 << 52) - 5]
    rows = [("a", i, n) for n in sizes for i in (1, 2, n // 2, n)] + [("a", None, 5), ("a", 6, 5), ("a", 0, 5), ("a", 1, None), (None, 1, 5)]
    got = permuted(spark.createDataFrame(rows, "site_id string, idx long, n_train long")).collect()
    assert [r["shuffle_pos"] for r in got[:8]] == [brute_place(i, n, "a") for _, i, n in rows[:8]]
    assert [r["shuffle_pos"] for r in got[8:12]] == [None] * 4 and 1 <= got[12]["shuffle_pos"] <= 5
    assert permuted(spark.createDataFrame([], "site_id string, idx long, n_train long")).collect() == []


def test_the_order_looks_random(spark):
    n = 20_000
    rows = spark.range(1, n + 1).select(F.col("id").alias("idx"), F.lit(n).alias("n_train"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("site_id"))
    by_site = {}
    for r in permuted(rows).collect():
        by_site.setdefault(r["site_id"], {})[r["idx"]] = r["shuffle_pos"]
    a, b = ([p[i] for i in range(1, n + 1)] for p in (by_site["a"], by_site["b"]))
    mean, var = (n + 1) / 2, (n * n - 1) / 12

    def correlation(x, y):
        return sum((p - mean) * (q - mean) for p, q in zip(x, y)) / len(x) / var

    # Four standard errors: with the position, between neighbours near and a root apart, and between keys.
    pairs = [(range(1, n + 1), a), (a[1:], a[:-1]), (a[141:], a[:-141]), (a[142:], a[:-142]), (a, b)]
    assert all(abs(correlation(x, y)) < 4 / math.sqrt(n) for x, y in pairs)
    tenths = [sum(p > n * 0.9 for p in a[k : k + n // 10]) for k in range(0, n, n // 10)]  # the tail comes from everywhere
    assert all(abs(t - n / 100) < 4.5 * math.sqrt(n / 10 * 0.09) for t in tenths)


def test_no_exchange_and_no_sort(spark, tmp_path):
    spark.range(1, 100).selectExpr("'a' AS site_id", "id AS idx", "99L AS n_train").write.parquet(str(tmp_path / "rows"))
    tail = permuted_tail(spark.read.parquet(str(tmp_path / "rows")))
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Python" not in plan
    assert tail.where("is_validation").count() == 99 - math.floor(99 * 0.9)
