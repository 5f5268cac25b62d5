"""Centroid clustering with ns-bounds: exact integer k-means that evaluates few distances.

For every vector and centroid the last evaluated distance is stored with the round it was evaluated in. The centroids of all rounds are
kept, so a stored distance is off by at most the norm of the centroid's total displacement since that round, which is never more than the sum
of its moves from round to round. Where these bounds cannot rule a centroid out, its distance is evaluated exactly, in integers; ties go to
the smaller number. So results equal plain rounds over all pairs.

A round is one pass: it reads vectors and stored distances, writes them anew to the shared folder, and next to them one row per batch
with the sums of the vectors that changed cluster. These rows add up to the next centroids. No vector is shuffled, and only the centroids (clusters
times components) come to the driver. Two rounds of the table exist at a time, older ones are removed. When no centroid
moves, further rounds change nothing and are left out.

Defined cases: vectors of another length, with NULL, not finite components or components of 2**17 or more (whose squared distances need not fit a
long) are not kept. With fewer vectors than clusters, there are as many clusters as vectors. Repeated ids and repeated vectors are vectors each; among
equal ids the first centroids come in the order of their components. A NULL id is hashed as an empty string. An empty table gives
no rows. Further columns are ignored.
"""

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import discard, fresh_path
from .common import map_batches

CLUSTERS = 8
ROUNDS = 10
WIDTH = 64
SCALE = 1024
SEED = 3
LARGEST = 1 << 17  # of a component; scaled differences are under 2**28, their squares over 64 components under 2**62
MARGIN = 1e-9  # relative, far over the rounding of a bound


def kept_vectors(vectors: DataFrame, id_column: str, vector_column: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(_id, _vector): the whole vectors as integers floor(scale * x)."""
    vector = F.col(f"`{vector_column}`")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) >= LARGEST))
    whole = vectors.where(vector.isNotNull() & (F.size(vector) == width)).where(~bad)
    integer = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("int"))
    return whole.select(F.col(f"`{id_column}`").alias("_id"), integer.alias("_vector"))


def first_centroids(rows: DataFrame, clusters: int, seed: int, width: int) -> np.ndarray:
    """The vectors with the smallest digests of seed and id, in their order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    chosen = rows.select("_vector", digest.alias("_digest")).orderBy("_digest", "_vector").limit(clusters).collect()
    return np.array([r["_vector"] for r in chosen], np.int64).reshape(len(chosen), width)


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = vectors - centroid
    return np.einsum("ij,ij->i", gap, gap)


def displacements(history: np.ndarray) -> np.ndarray:
    """How far each centroid of each round is from where it is now."""
    gap = history - history[-1]
    return np.sqrt(np.einsum("rij,rij->ri", gap, gap))


def assign(vectors: np.ndarray, cluster: np.ndarray, stored: np.ndarray, seen: np.ndarray, history: np.ndarray) -> int:
    """Moves every vector to its nearest centroid of the last round of `history`; changes `cluster`, `stored` distances and the
    rounds they were `seen` in, and returns how many distances were evaluated. A vector without a cluster has -1."""
    now, clusters = len(history) - 1, history.shape[1]
    drift = displacements(history)
    evaluated = 0

    def evaluate(rows: np.ndarray, j: int) -> np.ndarray:
        nonlocal evaluated
        exact = squared(vectors[rows], history[now, j])
        stored[rows, j], seen[rows, j] = np.sqrt(exact), now
        evaluated += len(rows)
        return exact

    def doubtful(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether a centroid may be as near as the vector's own, for rows and clusters."""
        slack = np.take_along_axis(drift, seen[rows], axis=0)
        low = stored[rows] - slack
        high = np.take_along_axis(stored[rows] + slack, own[:, None], axis=1)
        near = low * (1 - MARGIN) <= high * (1 + MARGIN)
        np.put_along_axis(near, own[:, None], False, axis=1)
        return near

    fresh = np.flatnonzero(cluster < 0)
    if len(fresh):
        cluster[fresh] = np.argmin(np.column_stack([evaluate(fresh, j) for j in range(clusters)]), axis=1)
    rest = np.flatnonzero(seen.min(axis=1) < now)
    rest = rest[doubtful(rest, cluster[rest]).any(axis=1)]
    if not len(rest):
        return evaluated
    own = cluster[rest]
    best = np.empty(len(rest), np.int64)
    for j in range(clusters):  # the upper bound first: often enough
        mine = np.flatnonzero(own == j)
        best[mine] = evaluate(rest[mine], j)
    near = doubtful(rest, own)
    winner = own.copy()
    for j in range(clusters):
        asked = np.flatnonzero(near[:, j])
        exact = evaluate(rest[asked], j)
        better = (exact < best[asked]) | ((exact == best[asked]) & (j < winner[asked]))
        best[asked[better]], winner[asked[better]] = exact[better], j
    cluster[rest] = winner
    return evaluated


def moved_sums(vectors: np.ndarray, before: np.ndarray, after: np.ndarray, clusters: int) -> np.ndarray:
    """What the sums of components and the count of each cluster change by."""
    change = np.zeros((clusters, vectors.shape[1] + 1), np.int64)
    moved = np.flatnonzero(before != after)
    for sign, own in ((-1, before[moved]), (1, after[moved])):
        for j in np.unique(own[own >= 0]):
            mine = moved[own == j]
            change[j, :-1] += sign * vectors[mine].sum(axis=0)
            change[j, -1] += sign * len(mine)
    return change


def matrix(batch: pa.RecordBatch, name: str, width: int, kind) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))


def _state(batch: pa.RecordBatch, width: int, clusters: int):
    vectors = matrix(batch, "_vector", width, np.int64)
    if "_cluster" in batch.schema.names:
        cluster = batch.column(batch.schema.get_field_index("_cluster")).to_numpy(zero_copy_only=False).astype(np.int64)
        return vectors, cluster, matrix(batch, "_stored", clusters, np.float64), matrix(batch, "_seen", clusters, np.int64)
    return vectors, np.full(len(vectors), -1), np.zeros((len(vectors), clusters)), np.zeros((len(vectors), clusters), np.int64)


def _round(batch: pa.RecordBatch, history: np.ndarray) -> Iterator[pa.RecordBatch]:
    clusters, width = history.shape[1:]
    vectors, cluster, stored, seen = _state(batch, width, clusters)
    before = cluster.copy()
    evaluated = assign(vectors, cluster, stored, seen, history)
    rows = len(vectors)
    names = ["kind", "_id", "_vector", "_cluster", "_stored", "_seen", "_change"]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int16()), pa.list_(pa.int64())]
    ids = batch.column(0)
    state = [
        pa.array(np.zeros(rows, np.int32)), ids, batch.column(1).cast(kinds[2]), pa.array(cluster, kinds[3]),
        lists(stored, pa.float64()), lists(seen, pa.int16()), pa.nulls(rows, kinds[6]),
    ]
    yield pa.RecordBatch.from_arrays(state, names)
    change = np.append(moved_sums(vectors, before, cluster, clusters).ravel(), evaluated)
    none = [pa.nulls(1, a.type) for a in state]
    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *none[1:6], lists(change[None, :], pa.int64())], names)


def _last(batch: pa.RecordBatch, history: np.ndarray) -> pa.RecordBatch:
    clusters, width = history.shape[1:]
    vectors, cluster, stored, seen = _state(batch, width, clusters)
    assign(vectors, cluster, stored, seen, history)
    distance = np.empty(len(vectors), np.int64)
    for j in range(clusters):
        mine = np.flatnonzero(cluster == j)
        distance[mine] = squared(vectors[mine], history[-1, j])
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], ["_id", "cluster", "distance"])


def cluster_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    width: int = WIDTH, scale: int = SCALE, seed: int = SEED, evaluations: list[int] | None = None,
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every kept vector, squared distance, and the centroids. `evaluations` is given each round's evaluated distances."""
    spark = vectors.sparkSession
    rows = kept_vectors(vectors, id_column, vector_column, width, scale)
    kind = rows.schema["_id"].dataType.simpleString()
    history = first_centroids(rows, clusters, seed, width)[None]
    count = history.shape[1]
    if not count:
        empty = spark.createDataFrame([], f"_id {kind}, cluster int, distance bigint").withColumnRenamed("_id", id_column)
        return empty, history[0]
    schema = f"kind int, _id {kind}, _vector array<int>, _cluster int, _stored array<double>, _seen array<smallint>, _change array<bigint>"
    sums, last = np.zeros((count, width + 1), np.int64), None
    for _ in range(rounds):
        path = fresh_path(spark, "centroids")
        map_batches(rows, partial(_round, history=history), schema).write.partitionBy("kind").parquet(path)
        table = spark.read.schema(schema).option("basePath", path).parquet(path)
        changes = table.where("kind = 1").select(F.posexplode("_change").alias("at", "by")).groupBy("at").agg(F.sum("by").alias("by")).collect()
        change = np.array([r["by"] for r in sorted(changes, key=lambda r: r["at"])], np.int64)
        sums += change[:-1].reshape(count, width + 1)
        if evaluations is not None:
            evaluations.append(int(change[-1]))
        some = sums[:, -1:] > 0
        centroids = np.where(some, sums[:, :-1] // np.maximum(sums[:, -1:], 1), history[-1])
        rows = table.where("kind = 0").select("_id", "_vector", "_cluster", "_stored", "_seen")
        if last:
            discard(spark, last)
        last = path
        history = np.concatenate([history, centroids[None]])
        if (centroids == history[-2]).all():
            break
    out = map_batches(rows, partial(_last, history=history), f"_id {kind}, cluster int, distance bigint")
    return out.withColumnRenamed("_id", id_column), history[-1]


def cluster_report(vectors: DataFrame) -> DataFrame:
    """Cluster, distance, sums of distances and digest of the final centroid of every vector."""
    found, centroids = cluster_vectors(vectors)
    path = fresh_path(vectors.sparkSession, "clusters")
    found.write.parquet(path)
    found = vectors.sparkSession.read.schema(found.schema).parquet(path)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # one row per cluster

    def by_cluster(values: dict[int, Column]) -> Column:
        out = F.lit(None)
        for j, value in values.items():
            out = F.when(F.col("cluster") == j, value).otherwise(out)
        return out

    if not sums:
        return found.selectExpr("*", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    return found.select(
        "*", by_cluster({j: F.lit(x).cast("bigint") for j, x in sums.items()}).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"), by_cluster({j: F.lit(digests[j]) for j in sums}).alias("centroid_sha256"),
    )


def oracle_sql(rounds: int = ROUNDS) -> str:
    """Plain rounds over all pairs."""
    steps = [
        f"""
kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
    WHERE len(embedding) = {WIDTH} AND len([x FOR x IN embedding IF isfinite(x) AND abs(x) < {LARGEST}]) = {WIDTH}
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c
    FROM (SELECT v, sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM kept ORDER BY h, v LIMIT {CLUSTERS})
)"""
    ]
    for t in range(rounds + 1):
        steps.append(f"""
a{t} AS MATERIALIZED (
    SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v,
           min(list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, c)])::HUGEINT * {CLUSTERS} + j) AS m
    FROM kept, c{t} GROUP BY r
)""")
        if t < rounds:
            steps.append(f"""
s{t} AS MATERIALIZED (
    SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT m % {CLUSTERS} AS j, unnest(v) AS x, unnest(range({WIDTH})) AS i FROM a{t}) GROUP BY j, i
), c{t + 1} AS MATERIALIZED (
    SELECT j, coalesce(w, c) AS c FROM c{t} LEFT JOIN
        (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS w FROM s{t} GROUP BY j) USING (j)
)""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, (m % {CLUSTERS})::INTEGER AS cluster, (m // {CLUSTERS})::BIGINT AS distance,
       sum(m // {CLUSTERS}) OVER (PARTITION BY m % {CLUSTERS})::BIGINT AS cluster_inertia, sum(m // {CLUSTERS}) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON j = m % {CLUSTERS}
"""
