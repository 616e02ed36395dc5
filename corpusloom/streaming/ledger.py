"""Streams that go on where they stopped: each batch is written once, and keys that are done are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.relational import one_per_key


def read_ledger(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The ledger's rows with their batch; None where there is none yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def once(path: str, key: str, work: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: rows whose ``key`` no other batch has done, after ``work``, go to ``path``/batch=number.

    A batch that is replayed after a crash writes its own folder again, so its rows are there once. Of rows of one key in
    a batch the least counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        done = read_ledger(batch.sparkSession, path)
        fresh = one_per_key(batch, [key], [F.asc(c) for c in batch.columns])
        if done is not None:
            fresh = fresh.join(done.filter(F.col("batch") != number).select(key), key, "left_anti")
        (work(fresh) if work else fresh).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_ledger(stream: DataFrame, path: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """All that is there now, once; call it again to go on."""
    return stream.writeStream.foreachBatch(once(path, key, work)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
