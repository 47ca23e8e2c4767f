"""Lloyd's clustering of quantised vectors, each distinct vector once with its multiplicity.

Vectors become rows of integers; equal ones are grouped with their number, and each
round reads only the distinct ones: a task adds up weighted integer sums for each centroid and
sends one row for each, so that a round moves clusters x components numbers for each task.
Assignments go back to the vectors' ids by a join that leaves hot vectors in place.

Integers are exact. Where all products of a batch stay below 2 ** 53 they are computed as
doubles, else as Python's integers; components saturate at the range of a long, and so do
distances and inertias in the result.

Defined cases: vectors of another length, null vectors and vectors with a null or non-finite
component are not kept and have no row. A null id is clustered, but begins no cluster;
where none begins, the result is empty. Rows
that repeat an id count each; where two beginnings have one hash, the lesser vector is first.
Fewer kept vectors than clusters give as many clusters. An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conefix.llm.skew import join_split
from conefix.session import Scratch

#: Components below this are multiplied as doubles: 64 squares of their differences stay below 2 ** 53.
EXACT_BELOW = 1 << 22
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, dims: int = 64, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, q)`` of the vectors that are kept, ``q`` as longs."""
    x = F.col(vector)
    usable = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rows = vectors.select(F.col(key).alias("vec_id"), x.cast("array<double>").alias("x")).where(F.size("x") == dims).where(F.forall("x", usable))
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("q"))


def distances(q: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of rows to centroids, exact."""
    largest = max(int(max(q.max(), -int(q.min()))), max(abs(c) for row in centroids for c in row))
    if largest < EXACT_BELOW and q.shape[1] <= 64:
        x, c = q.astype(np.float64), np.array(centroids, dtype=np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    x, c = q.astype(object), np.array(centroids, dtype=object)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("q").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def weighted_sums(distinct: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Cluster -> its number of vectors and their sums; one row for each cluster, component and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, sums, counts = len(centroids), None, np.zeros(len(centroids), dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            q, w = _matrix(batch), batch.column("weight").to_numpy()
            nearest = distances(q, centroids).argmin(axis=1)
            sums = np.zeros((k, q.shape[1]), dtype=object) if sums is None else sums
            small = int(max(q.max(), -int(q.min()))) < EXACT_BELOW and int(w.sum()) < 1 << 40
            for c in np.unique(nearest).tolist():
                rows = nearest == c
                own, times = (q[rows], w[rows]) if small else (q[rows].astype(object), w[rows].astype(object))
                sums[c] += (own * times[:, None]).sum(axis=0)
                counts[c] += int(w[rows].sum())
        if sums is not None:
            rows = [(c, d, int(counts[c]), Decimal(int(sums[c, d]))) for c in range(k) for d in range(sums.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.decimal128(38, 0))], ["cluster", "d", "n", "s"])

    parts = distinct.mapInArrow(run, "cluster int, d int, n long, s decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for row in parts.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("cluster", "d").collect():  # clusters x components rows
        out.setdefault(row["cluster"], (row["n"], []))[1].append(int(row["s"]))
    return out


def assigned(distinct: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``(q, weight, cluster, distance)`` of the distinct vectors; of equal distances the smaller cluster is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(_matrix(batch), centroids) if batch.num_rows else np.zeros((0, 1), dtype=np.int64)
            nearest = d.argmin(axis=1) if batch.num_rows else np.zeros(0, dtype=np.int64)
            near = [min(int(v), _LONG) for v in d[np.arange(len(nearest)), nearest]]
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("weight"), pa.array(nearest, pa.int32()), pa.array(near, pa.int64())], ["q", "weight", "cluster", "distance"])

    return distinct.mapInArrow(run, "q array<bigint>, weight long, cluster int, distance long")


def first_centroids(kept: DataFrame, k: int, salt: str = "3:") -> list[list[int]]:
    """The k kept vectors with the smallest hashes of their ids, in the order of the hashes."""
    hashed = kept.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("h"), "q")
    return [list(row["q"]) for row in hashed.orderBy("h", "q").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``, a row for each kept vector."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    kept = scratch.save(quantised(vectors, dims, scale, key, vector), "kept")
    centroids = first_centroids(kept, k)
    if not centroids:  # no vector begins a cluster
        blank = kept.limit(0).select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")))
        return blank.withColumn("centroid_sha256", F.lit(""))
    distinct = scratch.save(kept.groupBy("q").agg(F.count("*").alias("weight")), "distinct")
    for _ in range(rounds):
        for c, (n, sums) in weighted_sums(distinct, centroids).items():
            if n:
                centroids[c] = [s // n for s in sums]
    final = scratch.save(assigned(distinct, centroids), "assigned")
    long = lambda c: F.least(c, F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    inertia = final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("weight").cast("decimal(19,0)")).cast("decimal(38,0)").alias("s"))
    own = {row["cluster"]: min(int(row["s"]), _LONG) for row in inertia.collect()}  # a row for each cluster
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, own.get(c, 0), min(sum(own.values()), _LONG), h) for c, h in enumerate(hashes)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    total = final.agg(F.sum("weight")).first()[0] or 0
    back = join_split(kept, final.select("q", "cluster", "distance", "weight"), "q", total, rows="weight")
    return back.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
