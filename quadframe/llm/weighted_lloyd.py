"""Centroid clustering of vectors as whole numbers: equal vectors are one with a weight, Lloyd's rounds run on the distinct ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, join_hot, written
from .vectors import quantised, squared_distances, unpack


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid; the smaller number of two."""
    far = squared_distances(x, centroids)
    cluster = far.argmin(axis=1)
    return cluster, far[np.arange(len(x)), cluster].astype(np.int64)


def _sums(distinct: DataFrame, centroids: np.ndarray) -> list:
    """Per cluster its weight and the weighted sums of its vectors' components: added up in each task, then over all tasks."""
    clusters, length = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((clusters, length), np.int64), np.zeros(clusters, np.int64)
        for batch in batches:
            x, weights = unpack(batch.column("q"), length), batch.column("n").to_numpy(zero_copy_only=False)
            cluster, _ = _nearest(x, centroids)
            for c in np.unique(cluster):
                own = cluster == c
                totals[c] += weights[own] @ x[own]
                counts[c] += weights[own].sum()
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(totals[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = distinct.mapInArrow(add, "cluster long, n long, sums array<long>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(length)]).alias("sums")).collect()


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", *, clusters: int = 16, rounds: int = 3, scale: int = 64, length: int = 64) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of ``length`` finite components.

    Components become floor(scale * x).  Centroids start as the vectors with the least sha256 of ``1:`` and the key; fewer vectors
    than ``clusters`` make fewer centroids.  Equal vectors are grouped to one with their number, partly before the shuffle, so that
    a vector of very many copies is one row; rounds run on the distinct vectors, with sums of whole numbers, and the driver holds
    only the centroids.  At the end the assignments are joined back to the rows; the rows of a frequent vector meet theirs by
    broadcast, of fewer than 10,000 vectors of at most ``4 * length`` bytes.

    Null, shorter and longer vectors and those with a null or non-finite component are left out.  A repeated row is a vector of its own; where
    keys are equal, the lesser vector starts first; a null key hashes as an empty text.  An empty table gives no rows; other columns
    are left behind, whatever their names.  Components beyond 2^27 count as 2^27 - 1, as a long could not hold the distances; an inertia that no long holds is null.
    """
    kept = written(quantised(vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")), "v", scale, length, "k"), "kept")
    distinct = written(kept.groupBy("q").agg(F.count("*").alias("n")), "distinct")
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("k").cast("string"), F.lit(""))), 256)
    first = kept.select(hashed.alias("h"), "q").orderBy("h", "q").limit(clusters).collect()
    centroids = unpack(pa.array([bytes(r.q) for r in first], pa.binary()), length)
    for _ in range(rounds if first else 0):
        for r in _sums(distinct, centroids):
            centroids[r.cluster] = [s // r.n for s in r.sums]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = _nearest(unpack(batch.column("q"), length), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("n"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["q", "n", "cluster", "distance"])

    assigned = written(distinct.mapInArrow(assign, "q binary, n long, cluster int, distance long"), "assigned")
    discard(distinct)
    weighted = F.sum(F.col("distance").cast("decimal(20,0)") * F.col("n").cast("decimal(17,0)"))
    inertia = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(weighted).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    rows = [(c, fits(n), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in sorted(inertia.items())]
    table = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = join_hot(kept, assigned, ["q"], "n").join(F.broadcast(table), "cluster")
    return found.select(F.col("k").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = 16, rounds: int = 3, scale: int = 64, length: int = 64) -> str:
    far = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"raw AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        f"WHERE len(embedding) = {length} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {length})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM raw QUALIFY c < {clusters})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT x.vec_id, x.v, c.c, CAST({far} AS BIGINT) AS d FROM raw x, c{i} c QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY d, c.c) = 1)")
        if i < rounds:
            mean = "(s - ((s % n) + n) % n) // n"
            steps.append(
                f"m{i} AS MATERIALIZED (SELECT c, list({mean} ORDER BY i) AS v FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM "
                f"(SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY c, i) GROUP BY c)"
            )
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (c))")
    return (
        f"WITH {', '.join(steps)} SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} f USING (c)"
    )
