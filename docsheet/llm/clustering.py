"""Centroid clustering of integer vectors: Lloyd's rounds with Hamerly bounds.

Each vector carries one upper bound of the distance to its centroid and one lower bound of that to the second nearest. A round
loosens both by how far the centroids moved and leaves a vector where it is if its upper bound lies below its lower bound (or below half
the way from its centroid to the nearest other one); else the upper bound is made exact, and only what is ambiguous still is held against all
centroids in exact integers. Bounds are rounded outwards, so no vector is left where the exact distances would move it; equal
distances go to the smaller number.

Vectors and bounds are written after each round and the round before is deleted: lost executors repeat one round at most. Sums follow
the vectors that moved; what the driver holds are the centroids (k times the number of components).

Kept are vectors with exactly ``dim`` components, none null or not finite; other rows, null vectors included, have no result. Rows
that repeat an id or a vector stay rows of their own; a null id hashes as empty text and stays null. With fewer kept rows than ``k`` each of them is a centroid;
an empty table gives an empty table. Other columns of the table, whatever their names, are not read. A component beyond 2^27 steps of
the scale raises an error, as its squared distances need not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import delete_table, map_arrow, materialise, scratch

#: Factors that round a bound up and down by more than the error of the operations on it.
UP, DOWN = 1 + 2.0**-40, 1 - 2.0**-40
LARGEST = 1 << 27


def _distances(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return ((v - centroid) ** 2).sum(axis=1)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the way from each centroid to the nearest other one, rounded down."""
    apart = np.array([[np.inf if i == j else float(_distances(a[None], b)[0]) for j, b in enumerate(centroids)] for i, a in enumerate(centroids)])
    return np.sqrt(apart.min(axis=1)) * (0.5 * DOWN)


def _assigned(centroids: np.ndarray, drift: np.ndarray | None):
    """Rows with their bounds after a round; ``drift`` is null in the first one, which scans every vector."""
    k, dim = centroids.shape
    gaps = _gaps(centroids)
    others = None if drift is None else np.array([max((d for j, d in enumerate(drift) if j != i), default=0.0) for i in range(k)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column(1), dim)
            n = len(v)
            if drift is None:
                was, now, upper, lower, scan = np.full(n, -1), np.full(n, -1), np.full(n, np.inf), np.zeros(n), np.arange(n)
            else:
                was = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                now = was.copy()
                upper = (batch.column(3).to_numpy(zero_copy_only=False) + drift[was]) * UP
                lower = np.maximum(batch.column(4).to_numpy(zero_copy_only=False) - others[was], 0.0) * DOWN
                near = np.nonzero(upper >= np.maximum(lower, gaps[was]))[0]
                upper[near] = np.sqrt(((v[near] - centroids[was[near]]) ** 2).sum(axis=1).astype(float)) * UP
                scan = near[upper[near] >= np.maximum(lower[near], gaps[was[near]])]
            if len(scan):
                d = np.stack([_distances(v[scan], c) for c in centroids], axis=1)
                now[scan] = d.argmin(axis=1)  # of equals the first
                two = np.partition(d, 1, axis=1)[:, :2] if k > 1 else np.stack([d[:, 0], np.full(len(scan), np.iinfo(np.int64).max)], axis=1)
                upper[scan], lower[scan] = np.sqrt(two[:, 0].astype(float)) * UP, np.sqrt(two[:, 1].astype(float)) * DOWN
            scanned = np.zeros(n, bool)
            scanned[scan] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(now.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(was.astype(np.int32)), pa.array(now != was), pa.array(scanned)], ["id", "v", "a", "upper", "lower", "was", "moved", "scanned"])

    return run


def _moves(k: int, dim: int):
    """Per task what moved vectors bring to and take from each centroid: rows of centroid, component and sum; component ``dim`` is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            v = _vectors(batch.column(0), dim)
            for column, sign in ((1, 1), (2, -1)):
                where = batch.column(column).to_numpy(zero_copy_only=False)
                for c in range(k):
                    own = where == c
                    sums[c, :dim] += sign * v[own].sum(axis=0)
                    sums[c, dim] += sign * int(own.sum())
        c, i = np.divmod(np.arange(sums.size, dtype=np.int32), dim + 1)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(sums.ravel())], ["c", "i", "s"])

    return run


def _measured(centroids: np.ndarray):
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, a = _vectors(batch.column(1), dim), batch.column(2)
            yield pa.RecordBatch.from_arrays([batch.column(0), a, pa.array(((v - centroids[a.to_numpy(zero_copy_only=False)]) ** 2).sum(axis=1))], ["id", "cluster", "distance"])

    return run


def integer_vectors(table: DataFrame, dim: int, scale: int, id_col: str, vector: str) -> DataFrame:
    """(id, v) of the kept rows: floor(scale * x) of every component."""
    x = F.transform(vector, lambda e: e.cast("double"))
    good = (F.size(vector) == dim) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform(x, lambda e: F.floor(e * scale))
    fits = F.forall(x, lambda e: F.abs(e) <= LARGEST / scale)
    checked = F.when(fits, whole.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}")))
    return table.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).alias("id"), checked.alias("v"))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans): one row per kept vector.

    Centroids start as the ``k`` kept vectors with the smallest sha256 of ``<seed>:<id>`` (of equal ones the smaller vectors). ``scans`` is how many of the
    rounds + 1 assignments held any vector at all against all centroids, as a share of all of them: what the bounds left to do.
    """
    spark = vectors.sparkSession
    sha = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    with scratch(spark):
        state = materialise(integer_vectors(vectors, dim, scale, id_col, vector))
        first = state.orderBy(sha, "v").limit(k).collect()
        if not first:
            return spark.createDataFrame([], f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans double")
        centroids = np.array([r["v"] for r in first], np.int64)
        k = len(centroids)
        sums, drift, scans = [[0] * (dim + 1) for _ in range(k)], None, []
        kind = state.schema["id"].dataType.simpleString()
        for round_no in range(rounds + 1):
            state, scanned = _next_state(state, centroids, drift, kind)
            scans.append(scanned)
            if round_no == rounds:
                break
            moved = map_arrow(state.where("moved").select("v", "a", "was"), _moves(k, dim), "c int, i int, s long")
            for c, i, total in moved.groupBy("c", "i").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect():
                sums[c][i] += int(total)
            after = np.array([[x // s[dim] for x in s[:dim]] if s[dim] else old for s, old in zip(sums, centroids.tolist(), strict=True)], np.int64)
            drift = np.sqrt(((after - centroids) ** 2).sum(axis=1).astype(float)) * UP
            centroids = after
        measured = materialise(map_arrow(state.select("id", "v", "a"), _measured(centroids), f"id {kind}, cluster int, distance long"), kept=True)
    totals = measured.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    own = {r["cluster"]: int(r["d"]) for r in totals}
    every = sum(own.values())
    rows = [(c, own.get(c, 0), every, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return measured.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", F.lit(sum(scans) / len(scans)).alias("scans"))


def _next_state(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, kind: str) -> tuple[DataFrame, float]:
    """The state after a round, and the share of vectors that were held against all centroids; the state before is deleted once the next is written."""
    own = state if drift is None else state.select("id", "v", "a", "upper", "lower")
    rows, seen = map_arrow(own, _assigned(centroids, drift), f"id {kind}, v array<int>, a int, upper double, lower double, was int, moved boolean, scanned boolean"), Observation()
    after = materialise(rows.observe(seen, F.avg(F.col("scanned").cast("double")).alias("share")).drop("scanned"))
    delete_table(state)
    return after, seen.get["share"]


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same by exact scans of all vectors in every round."""
    squares = "list_sum(list_transform(list_zip(r.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY 1, 2 LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r.id, min({{'d': {squares}::BIGINT, 'c': c.c}}) AS best FROM kept r, c{n} c GROUP BY r.id)")
        if n < rounds:
            total = f"t{n} AS (SELECT best.c AS c, g.i, sum(v[g.i]) AS s, count(*) AS n FROM a{n} JOIN kept USING (id), range(1, {dim + 1}) g(i) GROUP BY ALL)"
            mean = f"m{n} AS (SELECT c, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS v FROM t{n} GROUP BY c)"
            parts += [total, mean, f"c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{n} o LEFT JOIN m{n} m USING (c))"]
    return f"""WITH {", ".join(parts)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia, sha256(list_aggregate(c.v, 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (id) JOIN c{rounds} c ON c.c = best.c"""
