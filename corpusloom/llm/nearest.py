"""Nearest vectors by inner product: a block matrix join with int8 tiles and exact recomputation of what may win.

1. Rows that take part are told apart by id and vector. Of equal vectors only the ``k + 1`` smallest ids can be among the
   nearest of any query, as ties go to the smaller id; the others are no candidates, which loses nothing.
2. Queries are dealt into blocks, candidates into at most ``MOST_STRIPES`` stripes; each pair of a block and a stripe is one
   unit. A unit holds its block of queries and sees the stripe's candidates some thousands at a time.
3. Both sides of a tile are rounded to int8 with a scale a vector. The product of the integers, exact in single precision,
   gives the inner product up to ``|q - q'| |c| + |q'| |c - c'|``, where the primes are the rounded vectors. A pair survives
   unless its upper bound is below the query's present ``k``-th score, or below the ``k + 1``-th greatest lower bound in the tile.
4. Survivors are recomputed from the original vectors in double precision, component by component, and enter the query's heap.
   A unit gives ``k`` rows a query at most; the heaps of a query's stripes are merged in order by a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.session import saved

K = 20
QUERIES = 16_384
STRIPE, MOST_STRIPES = 4_096, 16
#: Queries and candidates of one product.
TILE = 1_024, 4_096
#: Products of so many components of int8 stay exact in single precision.
EXACT = 1_024


def participants(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, digest, dims, raw (doubles as bytes) of the vectors that take part, once for each id and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(pc.fill_null(pc.greater(pc.list_value_length(batch.column(1)), 0), False))
            keep, digests, sizes, raws = [], [], [], []
            for i, vector in enumerate(rows.column(1)):
                if vector.values.null_count:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 is 0.0
                if np.isfinite(x).all() and x.any():
                    keep.append(i)
                    raws.append(x.tobytes())
                    digests.append(xxhash.xxh3_128_digest(raws[-1]))
                    sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(keep, pa.int64())), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(raws, pa.binary())], names=["id", "digest", "dims", "raw"])

    found = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col)).filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    return found.mapInArrow(run, "id long, digest binary, dims int, raw binary").dropDuplicates(["id", "digest"])


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as single precision), scale, length of the vector, of its rounded form and of what rounding took."""
    with np.errstate(all="ignore"):
        scale = np.abs(x).max(1) / 127
        whole = np.clip(np.nan_to_num(np.rint(x / scale[:, None])), -127, 127).astype(np.int8)
        back = whole * scale[:, None]
        length, kept, lost = (np.sqrt((m * m).sum(1)) for m in (x, back, x - back))
    return whole.astype(np.float32), scale, length, kept, lost


def inner(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of ``q`` with rows j of ``c``, summed from the first component to the last."""
    out = np.empty(len(i))
    qt, ct = np.ascontiguousarray(q.T), np.ascontiguousarray(c.T)
    with np.errstate(all="ignore"):
        for at in range(0, len(i), 65_536):
            a, b = i[at : at + 65_536], j[at : at + 65_536]
            total = np.zeros(len(a))
            for x, y in zip(qt, ct, strict=True):
                total += x[a] * y[b]
            out[at : at + 65_536] = total
    return out


class Heaps:
    """The ``k`` best of each query of a block so far, the worst on top: (score, -id)."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.heaps, self.last = k, [[] for _ in range(n)], np.full(n, -np.inf)

    def push(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        # of one tile no more than k enter
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        best = place < self.k
        for q, v, s in zip(query[best].tolist(), ids[best].tolist(), score[best].tolist(), strict=True):
            heap = self.heaps[q]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -v))
            elif (s, -v) > heap[0]:
                heapq.heapreplace(heap, (s, -v))
            if len(heap) == self.k:
                self.last[q] = heap[0][0]


def search_tile(q: np.ndarray, c: np.ndarray, own: np.ndarray, last: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, candidate, score) that may be among the ``k`` best, and how many pairs were recomputed for them.

    ``own`` (query, candidate) are pairs to leave out, one a query at most.
    """
    q8, qs, ql, qk, qe = rounded(q)
    c8, cs, cl, _, ce = rounded(c)
    about = np.zeros((len(q), len(c)))
    for at in range(0, q.shape[1], EXACT):
        about += q8[:, at : at + EXACT] @ c8[:, at : at + EXACT].T
    with np.errstate(all="ignore"):
        about *= qs[:, None]
        about *= cs[None]
        # the last term is far above the rounding of these doubles and of the exact sums
        error = qe[:, None] * cl[None] + qk[:, None] * ce[None] + (ql[:, None] * cl[None]) * (1e-13 * q.shape[1]) + np.finfo(np.float64).tiny
        least = last
        if len(c) > k and not np.isfinite(last).all():
            lower = np.nan_to_num(about - error, nan=-np.inf, posinf=-np.inf, neginf=-np.inf)
            least = np.maximum(last, np.partition(lower, len(c) - k - 1, 1)[:, len(c) - k - 1])
        survive = ~(about + error < least[:, None])
    survive[own[0], own[1]] = False
    i, j = np.nonzero(survive)
    score = inner(q, c, i, j)
    return i, j, np.where(np.isnan(score), -np.inf, score), len(i)


def units(rows: DataFrame, k: int, every: int, n: int, queries: int) -> DataFrame:
    """unit, side (0 query, 1 candidate), id, digest, raw: each query and candidate in all units that it belongs to."""
    blocks, stripes = max(1, -(-queries // QUERIES)), max(1, min(MOST_STRIPES, -(-n // STRIPE)))
    within = Window.partitionBy("digest").orderBy("id")
    some = rows.withColumn("_at", F.row_number().over(within)).filter(F.col("_at") <= k + 1).drop("_at")
    deal = lambda seed, m: F.pmod(F.xxhash64(F.lit(seed), "id", "digest"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).select("*", deal(1, blocks).alias("block"), each(stripes).alias("stripe"), F.lit(0).alias("side"))
    offered = some.select("*", each(blocks).alias("block"), deal(2, stripes).alias("stripe"), F.lit(1).alias("side"))
    return asked.unionByName(offered).select("dims", "block", "stripe", "side", "id", "digest", "raw")


def search(dealt: DataFrame, k: int) -> DataFrame:
    """(query, digest, stripe, place, id, score): the best ``k`` of each unit for each of its queries, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, asked, ids, digests, heaps, raw = None, None, [], [], None, []

        def found() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(heaps.heaps) if heaps else 0, 1_000):
                rows = [(ids[q], digests[q], unit[2], place, -v, s) for q, heap in enumerate(heaps.heaps[at : at + 1_000], at) for place, (s, v) in enumerate(sorted(heap, reverse=True))]
                if rows:
                    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["query", "digest", "stripe", "place", "id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            cuts = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))), len(keys)) if len(keys) else np.zeros(1, int)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if unit != (now := tuple(keys[lo, :3].tolist())):
                    yield from found()
                    unit, asked, ids, digests, raw, heaps = now, None, [], [], [], None
                own_ids, own_digests, own_raw = (batch.column(i).slice(lo, hi - lo).to_pylist() for i in (4, 5, 6))
                if not keys[lo, 3]:
                    ids += own_ids
                    digests += own_digests
                    raw += own_raw
                    continue
                if not ids:
                    continue
                if asked is None:
                    asked, raw = np.frombuffer(b"".join(raw), np.float64).reshape(len(ids), -1), []
                    places, heaps = {key: i for i, key in enumerate(zip(ids, digests, strict=True))}, Heaps(len(ids), k)
                for at in range(0, len(own_ids), TILE[1]):
                    offered = np.frombuffer(b"".join(own_raw[at : at + TILE[1]]), np.float64).reshape(-1, asked.shape[1])
                    numbers = np.array(own_ids[at : at + TILE[1]])
                    met = [(q, j) for j, key in enumerate(zip(own_ids[at : at + TILE[1]], own_digests[at : at + TILE[1]], strict=True)) if (q := places.get(key)) is not None]
                    met = np.array(met, np.int64).reshape(-1, 2)
                    for top in range(0, len(asked), TILE[0]):
                        own = met[(met[:, 0] >= top) & (met[:, 0] < top + TILE[0])]
                        i, j, score, _ = search_tile(asked[top : top + TILE[0]], offered, (own[:, 0] - top, own[:, 1]), heaps.last[top : top + TILE[0]], k)
                        heaps.push(i + top, numbers[j], score)
        yield from found()

    order = ["dims", "block", "stripe", "side"]
    return dealt.repartition("dims", "block", "stripe").sortWithinPartitions(*order).mapInArrow(run, "query long, digest binary, stripe int, place int, id long, score double")


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ordered lists of a query's stripes merged by a heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lists = None, {}

        def best() -> list[tuple]:
            order = heapq.merge(*([(-s, v) for v, s in part] for part in lists.values()))
            return [(key[0], rank, v, -s) for rank, (s, v) in enumerate(islice(order, k), 1)]

        for batch in batches:
            out = []
            for query, digest, stripe, _, v, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (query, digest):
                    out += best() if key else []
                    key, lists = (query, digest), {}
                lists.setdefault(stripe, []).append((v, s))
            yield _ranked(out)
        yield _ranked(best() if key else [])

    def _ranked(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "rank", "vec_id", "score"])

    by_query = found.repartition("query", "digest").sortWithinPartitions("query", "digest", "stripe", "place")
    return by_query.mapInArrow(run, "query_id long, rank int, vec_id long, score double")


def nearest(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of greatest inner product for each row whose id ``every`` divides.

    Fewer rows where there are fewer candidates; ties go to the smaller id. Rows whose id or vector is null, whose vector is
    empty, zero or holds a null or non-finite component take no part. Vectors of different lengths are never compared. Rows
    that repeat id and vector count once; rows that repeat an id with another vector are rows of their own, each a candidate
    to the other. A sum that overflows to no number comes last. An empty table gives an empty result; other columns are not
    looked at.
    """
    rows = saved(participants(vectors, id_col, vec_col), spark)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.pmod("id", F.lit(every)) == 0).alias("q")).first()
    return merged(search(units(rows, k, every, sizes["n"], sizes["q"]), k), k)
