"""Exact best partners by inner product within groups, without a list of all pairs.

Vectors are sorted by group, nearest pivot and angle to it, and cut into blocks. By the triangle inequality of angles two
vectors whose angles to a pivot differ by ``g`` have an inner product of ``cos(g)`` times their lengths at most; a pair of
blocks in which no vectors can reach ``least`` is never sent. What is left is one matrix product a pair of blocks, which
gives the best partner of each vector only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from corpusloom.functions.keys import order_key
from corpusloom.functions.vectors import norm
from corpusloom.operators.ranks import ranked
from corpusloom.session import saved

PIVOTS = 4
BLOCK = 1_024
ROOM = 1e-9
#: Rows of a product made at once; bound of the error of a product of unit vectors in single precision, per component.
SLICE, SINGLE = 256, 2.0**-22


def pivots(rows: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """(grp, pivots): some vectors of each group of (grp, key, v), by hash; vectors of no length are none."""
    some = rows.filter(norm(F.col("v")) > 0).select("grp", "v", order_key("pivot", F.col("key")).alias("_h"))
    some = some.withColumn("_at", F.row_number().over(Window.partitionBy("grp").orderBy("_h"))).filter(F.col("_at") <= pivots)
    return some.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "v"))), lambda x: x["v"]).alias("pivots"))


def placed(rows: DataFrame, around: DataFrame) -> DataFrame:
    """``rows`` (grp, key, v, ...) with angles (to each pivot) and length."""
    both = rows.join(around, "grp")
    schema = StructType([f for f in both.schema if f.name != "pivots"]).add("angles", ArrayType(DoubleType())).add("length", DoubleType())
    names, at, of = schema.names, both.columns.index("v"), both.columns.index("pivots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.asarray(batch.column(at).flatten(), np.float64).reshape(batch.num_rows, -1)
            sizes = pc.list_value_length(batch.column(of)).to_numpy()
            row = np.repeat(np.arange(len(v)), sizes)
            p = np.asarray(batch.column(of).flatten().flatten(), np.float64).reshape(len(row), -1)
            length = np.sqrt((v * v).sum(1))
            lengths = np.sqrt((p * p).sum(1)) * length[row]
            cosine = np.divide((p * v[row]).sum(1), lengths, out=np.ones(len(row)), where=lengths > 0)
            angles = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.arccos(np.clip(cosine, -1, 1))))
            own = [c for i, c in enumerate(batch.columns) if i != of]
            yield pa.RecordBatch.from_arrays([*own, angles, pa.array(length)], names=names)

    return both.mapInArrow(run, schema)


def blocked(rows: DataFrame, around: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` (grp, key, v, ...) with angles (to each pivot), length and block (from 0 in each group)."""
    out = saved(placed(rows, around), rows.sparkSession).withColumn("_near", F.array_min("angles")).withColumn("_pivot", F.array_position("angles", F.col("_near")))
    return ranked(out, "grp", [F.col("_pivot"), F.col("_near"), F.col("key")], "_place").withColumn("block", F.floor(F.col("_place") / block).cast("int")).drop("_place", "_size", "_near", "_pivot")


def _heads(rows: DataFrame, side: str) -> DataFrame:
    """One row a block: its number of rows, greatest length, and the least and greatest angle to each pivot."""
    each = lambda f: F.array(*[f(F.get("angles", F.lit(i))) for i in range(PIVOTS)])
    own = rows.groupBy("grp", "block").agg(F.count("*").alias("n"), F.max("length").alias("length"), each(F.min).alias("low"), each(F.max).alias("high"))
    return own.select("grp", *[F.col(c).alias(f"{side}_{c}") for c in ("block", "n", "length", "low", "high")])


def block_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(grp, l_block, r_block, pairs, alive) of all pairs of blocks; ``alive`` where vectors may reach ``least``."""
    both = _heads(left, "l").join(_heads(right, "r"), "grp")
    gap = lambda i: F.coalesce(F.greatest(F.get("r_low", F.lit(i)) - F.get("l_high", F.lit(i)), F.get("l_low", F.lit(i)) - F.get("r_high", F.lit(i))), F.lit(0.0))
    apart = F.greatest(F.lit(0.0), *[gap(i) for i in range(PIVOTS)])
    most = F.col("l_length") * F.col("r_length") * F.cos(apart)
    return both.select("grp", "l_block", "r_block", (F.col("l_n") * F.col("r_n")).alias("pairs"), (F.greatest(most, F.lit(0.0)) + ROOM >= least).alias("alive"))


def runs_of(batches: Iterator[pa.RecordBatch], keys: int, one: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``one`` over the batches of each run of rows that are equal in their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    unit = None
    for batch in batches:
        found = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        start = 0
        for i in range(1, len(found) + 1):
            if i == len(found) or found[i] != found[start]:
                if found[start] != unit:
                    yield from one(held)
                    held, unit = [], found[start]
                held.append(batch.slice(start, i - start))
                start = i
    yield from one(held)


def _tiles(left: DataFrame, right: DataFrame, around: DataFrame, least: float, block: int, report, tile, schema: str) -> DataFrame:
    """``tile`` over (grp, left rows, right rows) of each pair of blocks that may reach ``least``; rows are (key, mark, v)."""
    spark = left.sparkSession
    left, right = (rows if "block" in rows.columns else saved(blocked(rows, around, block), spark) for rows in (left, right))
    pairs = block_pairs(left, right, least)
    if report:
        pairs = saved(pairs, spark)
        report(*pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("alive"), F.col("pairs"))), F.lit(0))).first())
    alive = pairs.filter("alive").select("grp", "l_block", "r_block")
    sent = lambda rows, side: rows.withColumnRenamed("block", f"{'lr'[side]}_block").join(alive, ["grp", f"{'lr'[side]}_block"]).select("grp", "l_block", "r_block", F.lit(side).alias("side"), "key", "mark", "v")
    # by number, as a few small units are long work that must not come together in one task
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    units = sent(left, 0).unionByName(sent(right, 1)).repartition(tasks, "grp", "l_block", "r_block").sortWithinPartitions("grp", "l_block", "r_block", "side")

    def one(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        side, key, mark = (rows.column(i).to_numpy() for i in (3, 4, 5))
        middle = int((side == 0).sum())
        if middle in (0, len(side)):
            return
        v = np.asarray(rows.column(6).combine_chunks().flatten(), np.float64).reshape(len(side), -1)
        i, j, value = tile(key[:middle], mark[:middle], v[:middle], key[middle:], mark[middle:], v[middle:])
        grp = pa.chunked_array(rows.column(0).take(pa.array(i))).combine_chunks() if len(i) else pa.array([], rows.column(0).type)
        yield pa.RecordBatch.from_arrays([grp, pa.array(key[:middle][i]), pa.array(key[middle:][j]), pa.array(value)], names=["grp", "key", "partner", "cosine"])

    return units.mapInArrow(lambda batches: runs_of(batches, 3, one), schema)


def best_matches(left: DataFrame, right: DataFrame, least: float, apart: bool = False, block: int = BLOCK, report=None) -> DataFrame:
    """(grp, key, partner, cosine): for each row of ``left`` the one of ``right`` in its group with the greatest inner product.

    Both sides are (grp, key, v): keys of one integer type, vectors of one length. Rows that reach no ``least`` have no row
    here; ties go to the smaller key. ``apart`` leaves out equal keys. Where ``left`` has a column ``above``, a partner's
    ``place`` must be greater. ``report`` gets the pairs of all blocks and those compared. Rows of both sides that have
    the columns of :func:`blocked`, around the same pivots, keep their blocks.
    """
    own = ("angles", "length", "block") if "block" in right.columns else ()
    around = None if own else saved(pivots(right), left.sparkSession)
    bound = "above" in left.columns
    left = left.select("grp", F.col("key").cast("long").alias("key"), "v", (F.col("above") if bound else F.lit(0)).cast("long").alias("mark"), *own)
    right = right.select("grp", F.col("key").cast("long").alias("key"), "v", (F.col("place") if bound else F.lit(1)).cast("long").alias("mark"), *own)

    def best(key, mark, v, other, place, w):
        # the right side by key, so that the first of equal scores is the smallest key
        order = np.argsort(other, kind="stable")
        other, place, w = other[order], place[order], w[order]
        longest = np.sqrt(max((v * v).sum(1).max(), (w * w).sum(1).max(), 1e-18))
        slack = SINGLE * v.shape[1] * longest * longest
        at, value = np.zeros(len(key), np.int64), np.full(len(key), -np.inf)
        twin = np.full(len(key), -1)
        if apart:
            _, mine, same = np.intersect1d(key, other, return_indices=True)
            twin[mine] = same

        def without(score, part):
            mine = np.flatnonzero(twin[part] >= 0)
            score[mine, twin[part][mine]] = -np.inf
            if bound:
                score[~(mark[part][:, None] < place[None])] = -np.inf
            return score

        # single precision leaves few pairs, which double precision decides; where it leaves many, it is no help
        short = longest < 1e9
        v32, w32 = (v.astype(np.float32), w.astype(np.float32)) if short else (v, w)
        for start in range(0, len(key), SLICE):
            part = slice(start, start + SLICE)
            rows = np.arange(start, min(start + SLICE, len(key)))
            i = j = None
            if short:
                score = without(v32[part] @ w32.T, part)
                top = score.max(1)
                rows = rows[(top >= least - slack) & (top > -np.inf)]
                if not len(rows):
                    continue
                score, top = score[rows - start], top[rows - start]
                i, j = np.nonzero(score >= (top - 2 * slack)[:, None])
            if i is not None and len(i) <= 4 * len(rows):
                exact = (v[rows[i]] * w[j]).sum(1)
                # of each row the greatest, then the first
                first = np.lexsort((j, -exact, i))
                first = first[np.unique(i[first], return_index=True)[1]]
                at[rows], value[rows] = j[first], exact[first]
            else:
                score = without(v[part] @ w.T, part)[rows - start]
                at[rows] = score.argmax(1)
                value[rows] = score[np.arange(len(rows)), at[rows]]
        i = np.flatnonzero((value >= least) & (value > -np.inf))
        return i, order[at[i]], value[i]

    found = _tiles(left, right, around, least, block, report, best, f"grp {dict(left.dtypes)['grp']}, key long, partner long, cosine double")
    return found.groupBy("grp", "key").agg(F.max_by("partner", F.struct("cosine", -F.col("partner"))).alias("partner"), F.max("cosine").alias("cosine"))


def near_lists(left: DataFrame, right: DataFrame, least: float, most: int, block: int = BLOCK) -> DataFrame:
    """(grp, key, partners): of each row of ``left`` those of ``right`` in its group that reach ``least``, the nearest ``most``.

    Nearest first, ties to the smaller key; rows that reach ``least`` with none have no row here.
    """
    around = saved(pivots(right), left.sparkSession)
    left, right = (rows.select("grp", F.col("key").cast("long").alias("key"), "v", F.lit(0).cast("long").alias("mark")) for rows in (left, right))

    def nearest(key, _, v, other, __, w):
        parts = []
        for start in range(0, len(key), SLICE):
            score = v[start : start + SLICE] @ w.T
            bound = np.partition(score, -most, axis=1)[:, -most] if score.shape[1] > most else np.full(len(score), -np.inf)
            i, j = np.nonzero(score >= np.maximum(bound, least)[:, None] - ROOM)
            exact = (v[start + i] * w[j]).sum(1)
            order = np.lexsort((other[j], -exact, i))
            order = order[exact[order] >= least]
            i, j, exact = i[order], j[order], exact[order]
            # a row's place in its list
            first = np.arange(len(i)) - np.searchsorted(i, i) < most
            parts.append((start + i[first], j[first], exact[first]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    found = _tiles(left, right, around, least, block, None, nearest, f"grp {dict(left.dtypes)['grp']}, key long, partner long, cosine double")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("_c"), "partner")))
    return found.groupBy("grp", "key").agg(F.slice(F.transform(ordered, lambda x: x["partner"]), 1, most).alias("partners"))


def near_pairs(rows: DataFrame, least: float, block: int = BLOCK, report=None) -> DataFrame:
    """(grp, key, partner, cosine): every pair of rows (grp, key, v) of a group whose inner product reaches ``least``, once."""
    around = saved(pivots(rows), rows.sparkSession)
    rows = rows.select("grp", F.col("key").cast("long").alias("key"), "v", F.lit(0).cast("long").alias("mark"))

    def near(key, _, v, other, __, w):
        score = v @ w.T
        i, j = np.nonzero((score >= least) & (key[:, None] < other[None]))
        return i, j, score[i, j]

    return _tiles(rows, rows, around, least, block, report, near, f"grp {dict(rows.dtypes)['grp']}, key long, partner long, cosine double")
