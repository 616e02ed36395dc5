"""Joins and runs over intervals (key, start, stop), in seconds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from corpusloom.session import saved


def _binned(rows: DataFrame, start: str, stop: str, width: float) -> DataFrame:
    return rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width))))


def overlap_join(left: DataFrame, right: DataFrame, key: str, least: float = 0.0, width: float = 3600.0) -> DataFrame:
    """Pairs of intervals of one key that overlap by ``least`` or more, with lo and hi of the overlap.

    Both sides are cut into bins of ``width`` and joined on (key, bin), so the join is an equi-join whatever the number
    of intervals of a key; a pair is kept in the first bin that both share. Columns: key, start, stop, then the right
    side's r_start, r_stop and its other columns.
    """
    right = right.select(key, F.col("start").alias("r_start"), F.col("stop").alias("r_stop"), *[c for c in right.columns if c not in (key, "start", "stop")])
    joined = _binned(left, "start", "stop", width).join(_binned(right, "r_start", "r_stop", width), [key, "_bin"])
    lo, hi = F.greatest("start", "r_start"), F.least("stop", "r_stop")
    first = F.col("_bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("r_start") / width))
    return joined.filter(first & (hi - lo >= least) & (hi > lo)).withColumn("lo", lo).withColumn("hi", hi).drop("_bin")


def covered_share(spans: DataFrame, speech: DataFrame, key: str, span_id: str, least: float = 0.7, width: float = 3600.0) -> DataFrame:
    """Spans of which overlapping intervals cover ``least`` or more of the duration, with ``share``."""
    summed = overlap_join(spans, speech, key, width=width).groupBy(span_id).agg((F.sum(F.col("hi") - F.col("lo")) / F.first(F.col("stop") - F.col("start"))).alias("share"))
    return summed.filter(F.col("share") >= least)


def bleeding(spans: DataFrame, turns: DataFrame, key: str, own: str, other: str, pad: float, least: float, width: float = 3600.0) -> DataFrame:
    """Spans that, padded on both sides, touch a turn of another speaker by ``least`` or more."""
    padded = spans.withColumn("start", F.greatest(F.lit(0.0), F.col("start") - pad)).withColumn("stop", F.col("stop") + pad)
    found = overlap_join(padded, turns, key, least, width).filter(F.col(own) != F.col(other))
    return found.select([c for c in spans.columns if c not in ("start", "stop")]).distinct()


def runs(rows: DataFrame, key: str, order: str, active: Column, least: int = 1) -> DataFrame:
    """Maximal runs of consecutive active rows of each key: first, last, n."""
    by = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("_on", active).withColumn("_new", F.when(F.col("_on") & ~F.coalesce(F.lag("_on").over(by), F.lit(False)), 1).otherwise(0))
    marked = marked.withColumn("run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).filter("_on")
    return marked.groupBy(key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).filter(F.col("n") >= least)


def bounded_sessions(rows: DataFrame, key: str, gap: float, longest: float) -> DataFrame:
    """Intervals of a key merged while the gap is below ``gap`` and the whole not longer than ``longest``: key, start, stop, n.

    A gap of ``gap`` or more always ends a session. The rows are sorted by range, so that a key may span many tasks: each
    part carries on from the last row of the part before, and these gaps cut the rows into stretches. Only within a
    stretch does a session depend on the one before it, so the rows of each stretch pass in order through one task, which
    holds the open session alone. A null key is a key; a row with a null start or stop is a session of its own, and the next row
    begins one.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(key).alias("_k"), F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"))
    parts = saved(rows.repartitionByRange("_k", "start", "stop").withColumn("_part", F.spark_partition_id()), spark)
    by, parts_of = Window.partitionBy("_part", "_k").orderBy("start", "stop"), Window.partitionBy("_k").orderBy("_part")
    ends = parts.groupBy("_k", "_part").agg(F.max(F.struct("start", "stop"))["stop"].alias("_end"))
    ends = ends.select(F.col("_k").alias("_kk"), F.col("_part").alias("_p"), F.lag("_end").over(parts_of).alias("_before"))
    same = F.col("_k").eqNullSafe(F.col("_kk")) & (F.col("_part") == F.col("_p"))
    placed = parts.join(ends, same).drop("_kk", "_p").withColumn("_row", F.row_number().over(by))
    last = F.when(F.col("_row") == 1, F.col("_before")).otherwise(F.lag("stop").over(by))
    placed = placed.withColumn("_new", F.coalesce(F.col("start") - last >= gap, F.lit(True))).drop("_before")
    placed = saved(placed.withColumn("_own", F.count_if("_new").over(by)), spark)
    counts = placed.groupBy("_k", "_part").agg(F.count_if("_new").alias("_n"))
    upto = F.coalesce(F.sum("_n").over(parts_of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("_k").alias("_kk"), F.col("_part").alias("_p"), upto.alias("_upto"))
    stretches = placed.join(counts, same).withColumn("_stretch", F.col("_own") + F.col("_upto"))
    in_order = stretches.repartition("_k", "_stretch").sortWithinPartitions("_k", "_stretch", "_part", "_row")
    schema = T.StructType([T.StructField(key, rows.schema["_k"].dataType), *[T.StructField(c, T.DoubleType()) for c in ("start", "stop")], T.StructField("n", T.IntegerType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, current, done = None, None, []
        for batch in batches:
            kind = batch.schema.field(0).type
            for k, new, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current and not new and None not in (current[1], stop) and stop - current[1] <= longest:
                    current[2], current[3] = stop, current[3] + 1
                else:
                    done += [current] if current else []
                    current = [k, start, stop, 1]
            yield _sessions(done, key, kind)
            done = []
        if current:
            yield _sessions([current], key, kind)

    return in_order.select("_k", "_new", "start", "stop").mapInArrow(fold, schema)


def _sessions(found: list[list], key: str, kind: pa.DataType) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else [[]] * 4
    types = (kind, pa.float64(), pa.float64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[key, "start", "stop", "n"])
