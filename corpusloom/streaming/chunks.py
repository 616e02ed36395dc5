"""Keyed streams in chunks: batch forms, and the stateful form on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.ranks import ranked


def chunked(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """(key, chunk, frames, is_final): frames of each key in chunks of ``size``, the rest in a last one."""
    by = Window.partitionBy(key)
    ranked = rows.withColumn("_r", F.row_number().over(by.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(by))
    chunk = F.floor(F.col("_r") / size)
    return ranked.groupBy(key, chunk.alias("chunk")).agg(F.count("*").alias("frames"), (F.max("_r") == F.max("_n") - 1).alias("is_final"))


def sliding(rows: DataFrame, key: str, order: list[str], size: int, value: str) -> DataFrame:
    """Sum and count over the last ``size`` rows of the key."""
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - size, 0)
    return rows.withColumn("total", F.sum(value).over(by)).withColumn("held", F.count("*").over(by))


def lanes(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """(key, lane): keys in the order of their first row are dealt to ``n`` lanes in turn; no task orders all keys."""
    first = rows.groupBy(key).agg(F.min(order).alias("_f")).withColumn("_one", F.lit(1))
    return ranked(first, "_one", [F.col("_f"), F.col(key)], "_at").select(key, (F.col("_at") % n).cast("int").alias("lane"))


def stream_chunks(stream: DataFrame, key: str, size: int, quiet: str | None = "10 seconds") -> DataFrame:
    """(key, chunk, frames, is_final) from a stream: a chunk is given when ``size`` frames are there.

    The rest of a key follows as its final chunk when it has been quiet for ``quiet`` of processing time; frames that
    come later begin a new sequence. Without ``quiet`` the rest stays held.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(found: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunk, held = state.get if state.exists else (0, 0)
        out = []
        if state.hasTimedOut:
            if held:
                out.append((found[0], chunk, held, True))
            state.remove()
        else:
            held += sum(len(p) for p in parts)
            while held >= size:
                out.append((found[0], chunk, size, False))
                chunk, held = chunk + 1, held - size
            state.update((chunk, held))
            if quiet:
                state.setTimeoutDuration(int(pd.Timedelta(quiet).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=[key, "chunk", "frames", "is_final"])

    wait = GroupStateTimeout.ProcessingTimeTimeout if quiet else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, chunk long, frames long, is_final boolean", "chunk long, held long", "append", wait)
