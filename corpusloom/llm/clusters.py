"""Centroid clustering in exact integers, with bounds that loosen by the geometry of the drift.

Every vector keeps its cluster, an upper bound of the distance to that cluster's centroid and a lower bound of the distance
to every other one. When centroids move:

1. the upper bound grows by the drift of the own centroid;
2. the vectors of cluster i lie in a sphere around its old centroid, whose radius is their greatest upper bound. In the plane
   through that centre and the ends ``a`` and ``b`` of the way of centroid j, a point z with ``|z - a| - |z - b| = t`` lies on
   a hyperbola inside the cone ``cos(angle) >= t / |a - b|`` around the way, seen from its middle. So no vector of the sphere
   comes nearer to j by more than ``|a - b| * cos(phi - alpha)``, where ``phi`` is the angle between the way and the centre and
   ``alpha`` half the angle under which the sphere is seen; nothing where that is over a right angle, the whole drift only
   where the sphere covers the middle or the way's direction. The lower bound loosens by the greatest of these over j;
3. a vector stays unseen where its upper bound is below its lower bound or half the distance to the next centroid. The others
   get their exact distance, and where that does not settle it, all centroids are scanned in exact integers.

Sums are gathered by task, then by Spark; only ``k`` centroids of ``dims`` components come to the driver. Each round is one
table in the shared folder, and the table before it is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.session import discard, saved, scratch_path

K, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
#: Greatest magnitude of an integer component: 64 squared differences of such components fit a long.
MOST = 2**26
#: Products of components up to here stay exact in doubles.
EXACT = 2**22
#: Bounds give way by this share, which is far above the rounding of the doubles they are made of.
ROOM = 1e-9
#: Components are packed as unsigned big-endian integers above this, so that bytes sort as the vectors do.
OFFSET = 2**31
STATE = "id long, x binary, cluster int, upper double, lower double, scans int, distance long"


def integers(vectors: DataFrame, id_col: str, vec_col: str, dims: int = DIMS, scale: float = SCALE) -> DataFrame:
    """id and x (``floor(scale * component)`` packed) of the vectors of ``dims`` finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dims), False)
            rows = batch.filter(right)
            flat = rows.column(1).flatten()
            whole = np.asarray(pc.is_valid(flat)).reshape(-1, dims).all(1)
            x = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            whole &= np.isfinite(x).all(1)
            x = np.floor(x[whole] * scale)
            if len(x) and not (np.abs(x) <= MOST).all():
                raise ArithmeticError(f"a component times {scale} is beyond {MOST}: squared distances would not fit a long")
            packed = (x + OFFSET).astype(">u4")
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(pa.array(whole)), pa.array([r.tobytes() for r in packed], pa.binary())], names=["id", "x"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col)).mapInArrow(run, "id long, x binary")


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    return unpacked(column.to_pylist(), dims)


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), ">u4").reshape(-1, dims).astype(np.int64) - OFFSET


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centres."""
    if max(np.abs(x).max(initial=0), np.abs(centers).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), centers.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centers], 1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster the most by which any vector of its sphere comes nearer to another centroid."""
    a, b = old.astype(np.float64), new.astype(np.float64)
    way, middle = b - a, (a + b) / 2
    drift = np.sqrt((way * way).sum(1))
    seen = a[:, None] - middle[None]
    far = np.sqrt((seen * seen).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        phi = np.arccos(np.clip((seen * way[None]).sum(2) / (far * drift[None]), -1, 1))
        alpha = np.where(radius[:, None] < far, np.arcsin(np.minimum(radius[:, None] / far, 1)), np.pi)
        most = drift[None] * np.maximum(0, np.cos(np.maximum(0, phi - alpha)))
    most = np.where(drift[None] == 0, 0, np.where(np.isfinite(most), most, drift[None]))
    np.fill_diagonal(most, 0)
    return most.max(1) + 1e-6 * drift.max(initial=0)  # arccos is good to about 1e-8


def assigned(state: DataFrame, centers: np.ndarray, moves: tuple[np.ndarray, np.ndarray] | None, last: bool) -> DataFrame:
    """``state`` after assignment to ``centers``; ``moves`` holds drift and loosening by cluster, None in the first round."""
    k, dims = centers.shape
    gaps = np.sqrt(squared(centers, centers).astype(np.float64))
    np.fill_diagonal(gaps, np.inf)
    half = gaps.min(1) / 2 * (1 - ROOM)

    def scan(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        all_of = squared(x, centers)
        nearest = all_of.argmin(1)
        upper = np.sqrt(all_of[np.arange(len(x)), nearest].astype(np.float64)) * (1 + ROOM)
        lower = np.sqrt(np.partition(all_of, 1, 1)[:, 1].astype(np.float64)) * (1 - ROOM) if k > 1 else np.full(len(x), np.inf)
        return nearest, upper, lower

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_of(batch.column("x"), dims)
            if moves is None:
                cluster, upper, lower = scan(x)
                scans = np.ones(len(x), np.int32)
            else:
                cluster, scans = batch.column("cluster").to_numpy().astype(np.int64), batch.column("scans").to_numpy().copy()
                upper = batch.column("upper").to_numpy() + moves[0][cluster]
                lower = batch.column("lower").to_numpy() - moves[1][cluster]
                unsure = np.flatnonzero(~(upper < np.maximum(lower, half[cluster])))
                upper[unsure] = np.sqrt(((x[unsure] - centers[cluster[unsure]]) ** 2).sum(1).astype(np.float64)) * (1 + ROOM)
                unsure = unsure[~(upper[unsure] < np.maximum(lower, half[cluster])[unsure])]
                cluster[unsure], upper[unsure], lower[unsure] = scan(x[unsure]) if len(unsure) else (0, 0, 0)
                scans[unsure] += 1
            distance = pa.array(((x - centers[cluster]) ** 2).sum(1)) if last else pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(scans), distance], names=["id", "x", "cluster", "upper", "lower", "scans", "distance"])

    return state.mapInArrow(run, STATE)


def totals(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
    """Vectors and exact component sums of each cluster, and the radius of its sphere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, radius = np.zeros((k, dims + 1), np.int64), np.zeros(k)
        for batch in batches:
            cluster = batch.column(0).to_numpy()
            if not len(cluster):
                continue
            order = np.argsort(cluster, kind="stable")
            starts = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            own = cluster[order][starts]
            sums[own, :dims] += np.add.reduceat(rows_of(batch.column(1), dims)[order], starts, axis=0)
            sums[own, dims] += np.diff(np.append(starts, len(cluster)))
            radius[own] = np.maximum(radius[own], np.maximum.reduceat(batch.column(2).to_numpy()[order], starts))
        at = np.flatnonzero(sums[:, dims])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, dims + 1).astype(np.int32)), pa.array(np.tile(np.arange(dims + 1, dtype=np.int32), len(at))), pa.array(sums[at].ravel()), pa.array(np.repeat(radius[at], dims + 1))], names=["cluster", "dim", "total", "radius"])

    parts = state.select("cluster", "x", "upper").mapInArrow(run, "cluster int, dim int, total long, radius double")
    rows = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("radius").alias("radius")).collect()
    counts, sums, radius = np.zeros(k, np.int64), [[0] * dims for _ in range(k)], np.zeros(k)
    for r in rows:
        radius[r["cluster"]] = r["radius"]
        if r["dim"] == dims:
            counts[r["cluster"]] = int(r["total"])
        else:
            sums[r["cluster"]][r["dim"]] = int(r["total"])
    return counts, sums, radius


def drift_clusters(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: str = "2", report: Callable[[int, int, int], None] | None = None) -> DataFrame:
    """Per kept vector: ``id_col``, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans.

    Vectors that are null, of another length than ``dims`` or hold a null or non-finite component are left out, rows that
    repeat an id or a vector stay rows of their own. Centroids start as the ``k`` vectors (all, if fewer) whose
    ``seed:id`` has the smallest SHA-256; a null id comes last, equal hashes by their components. Ties go to the smaller
    cluster number, an empty cluster keeps its centroid. An empty table gives an empty result; other columns are not looked
    at. A component beyond 2^26 after scaling is an error, as distances would not fit a long. ``scans`` counts the rounds in
    which all centroids were scanned for the vector; ``report`` gets each round's number, its scans so far and the vectors.
    """
    path = scratch_path(spark)
    state = saved(integers(vectors, id_col, vec_col, dims, scale), spark, path)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    chosen = state.orderBy(digest.asc_nulls_last(), "x").limit(k).collect()
    centers = unpacked([bytes(r["x"]) for r in chosen], dims)
    if not len(centers):
        return spark.createDataFrame([], f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans int")
    moves = None
    for turn in range(rounds + 1):
        before, path = path, scratch_path(spark)
        state = saved(assigned(state, centers, moves, turn == rounds), spark, path)
        discard(spark, before)
        if report:
            report(turn, *state.agg(F.sum("scans"), F.count("*")).first())
        if turn < rounds:
            counts, sums, radius = totals(state, *centers.shape)
            moved = np.array([[s // int(n) for s in row] if n else c.tolist() for n, row, c in zip(counts, sums, centers, strict=True)], np.int64)
            drift = np.sqrt(((moved - centers) ** 2).sum(1).astype(np.float64)) * (1 + ROOM)
            moves, centers = (drift, loosening(centers, moved, radius)), moved
    inertia = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [(i, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centers[i].tolist())).encode()).hexdigest()) for i, s in inertia.items()]
    # one row a cluster, so at most k
    heads = F.broadcast(spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return state.join(heads, "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans")
