"""Centroid clustering: Lloyd's rounds over distinct quantised vectors.

Components become integers, equal vectors one row with a multiplicity, and everything after that is
exact integer arithmetic: a round assigns each distinct vector, sums components weighted by
multiplicity (one row a task and cluster), and divides rounding down. So the result depends neither
on the order of rows nor on the number of tasks. Assignments are joined back to the ids at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, small

CLUSTERS, ROUNDS, SCALE, DIMS, SEED = 8, 10, 1024, 64, 3
#: Below this size of all components, squared distances are whole doubles; beyond it, they are Python's integers.
_EXACT = 1 << 22


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly ``dims`` components, none of them null, NaN or infinite."""
    infinite = F.lit(float("inf"))
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return (F.size(vector) == dims) & whole


def quantise(vector: Column, scale: int) -> Column:
    """Components as floor(scale * x), with x as double; one that does not fit an int is an error."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def nearest(vectors, centroids: list[list[int]]):
    """For each row of an integer matrix, the number of the nearest centroid (ties: the smaller) and its squared distance."""
    import numpy as np

    c = np.array(centroids, dtype=object)
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if most < _EXACT else object
    v, c = vectors.astype(kind), c.astype(kind)
    distances = np.stack([((v - x) ** 2).sum(axis=1) for x in c], axis=1)
    best = distances.argmin(axis=1)
    return best, distances[np.arange(len(v)), best].astype(np.int64)


def _matrix(column: pa.Array):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(distinct: DataFrame, centroids: list[list[int]], dims: int) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and componentwise sums of each cluster that has any; one row a cluster comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        count, total = [0] * len(centroids), [np.zeros(dims, dtype=np.int64) for _ in centroids]
        for batch in batches:
            if batch.num_rows:
                vectors, n = _matrix(batch.column("q")).astype(np.int64), batch.column("n").to_numpy()
                best, _ = nearest(vectors, centroids)
                for k in np.unique(best):
                    own = best == k
                    count[k] += int(n[own].sum())
                    total[k] += (vectors[own] * n[own, None]).sum(axis=0)
        used = [k for k, c in enumerate(count) if c]
        yield pa.RecordBatch.from_pydict({"k": pa.array(used, pa.int32()), "n": pa.array([count[k] for k in used], pa.int64()), "s": pa.array([total[k].tolist() for k in used], pa.list_(pa.int64()))})

    parts = distinct.mapInArrow(run, "k int, n long, s array<long>")
    sums = parts.groupBy("k").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dims)]).alias("s"))
    return {r["k"]: (r["n"], r["s"]) for r in sums.collect()}


def _assign(distinct: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(q, n, k, d): the cluster of each distinct vector and its squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if batch.num_rows:
                best, distance = nearest(_matrix(batch.column("q")).astype(np.int64), centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["q", "n", "k", "d"])

    return distinct.select("q", "n").mapInArrow(run, "q array<int>, n long, k int, d long")


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: int = SEED, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows and columns of ``vectors`` with a usable vector, plus ``cluster`` (int), ``distance``, ``cluster_inertia``, ``inertia`` (long) and ``centroid_sha256``.

    Vectors that are null, of another length than ``dims``, or with null or non-finite components
    are left out. Centroids start as the vectors with the smallest sha256 of ``seed:id``; rows
    without an id come last there. With fewer vectors than clusters there are as many clusters as
    vectors. Repeated rows count as often as they stand there; equal vectors always share a cluster;
    ties go to the smaller number; a cluster that loses all vectors keeps its centroid. Components
    beyond an int after scaling, or distances beyond a long, end in an error. An empty table gives an
    empty result. Columns named like the new ones are replaced; others may have any name.
    """
    spark = vectors.sparkSession
    new = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    vectors = vectors.drop(*new)
    (own,) = fresh(vectors, "quantised_")
    kept = vectors.where(usable(F.col(vector), dims)).withColumn(own, quantise(F.col(vector), scale))
    distinct = materialise(kept.groupBy(F.col(own).alias("q")).agg(F.count("*").alias("n")), "distinct-vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")), 256)
    first = kept.select(rank.alias("rank"), F.col(own).alias("q")).orderBy(F.col("rank").asc_nulls_last(), "q").limit(clusters)
    centroids = [list(r["q"]) for r in first.collect()]
    for _ in range(rounds if centroids else 0):
        sums = _sums(distinct, centroids, dims)
        centroids = [[x // sums[k][0] for x in sums[k][1]] if k in sums else c for k, c in enumerate(centroids)]
    assigned = materialise(_assign(distinct, centroids), "assigned-vectors")

    inertia = {r["k"]: (r["d"], r["n"], r["rows"]) for r in assigned.groupBy("k").agg(F.sum(F.col("d") * F.col("n")).alias("d"), F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    total = sum(d for d, _, _ in inertia.values())
    facts = [(k, inertia.get(k, (0,))[0], total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    each = spark.createDataFrame(facts, "k int, cluster_inertia long, inertia long, centroid_sha256 string")

    # Back to the rows. Vectors that more than a thousandth of all rows hold are at most a thousand, and are broadcast; so no key of the shuffle is hot.
    q, k, d = fresh(kept, "q_", "k_", "d_")
    one = assigned.select(F.col("q").alias(q), F.col("k").alias(k), F.col("d").alias(d), "n")
    rows, n_distinct = sum(n for _, n, _ in inertia.values()), sum(r for _, _, r in inertia.values())
    on = F.col(own) == F.col(q)
    if small(n_distinct, 8 * dims + 100):
        back = kept.join(F.broadcast(one.drop("n")), on)
    else:
        hot = F.broadcast(one.where(F.col("n") * 1000 > rows).drop("n"))
        rest = one.where(F.col("n") * 1000 <= rows).drop("n")
        back = kept.join(hot, on).unionByName(kept.join(hot, on, "left_anti").join(rest, on))
    named = back.withColumn("cluster", F.col(k)).withColumn("distance", F.col(d)).drop(own, q, k, d)
    return named.join(F.broadcast(each.withColumnRenamed("k", k)), F.col("cluster") == F.col(k)).drop(k)


def op13_centroid_clustering(vectors: DataFrame) -> DataFrame:
    return cluster_vectors(vectors.select("vec_id", "embedding")).drop("embedding")


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: int = SEED) -> str:
    """DuckDB SQL of op13: one pair of tables a round."""
    distance = "CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, q FROM (SELECT sha256('{seed}:' || vec_id) AS h, q FROM kept ORDER BY h LIMIT {clusters}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(v.q) AS q, min({{'d': {distance}, 'k': c.k}}) AS m FROM kept v CROSS JOIN c{i} c GROUP BY vec_id)")
        if i < rounds:
            parts.append(f"m{i} AS MATERIALIZED (SELECT k, list(x ORDER BY p) AS q FROM (SELECT k, p, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT m.k AS k, p, sum(q[p]) AS s, count(*) AS n FROM a{i}, range(1, {dims + 1}) r(p) GROUP BY ALL)) GROUP BY k)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, q FROM m{i} UNION ALL SELECT k, q FROM c{i} WHERE k NOT IN (SELECT k FROM m{i}))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, CAST(a.m.k AS INTEGER) AS cluster, a.m.d AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.m.k"""


OP13_SQL = _sql()
