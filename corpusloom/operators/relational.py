"""Joins with defaults and overrides, ledgers, first and last wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def one_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def override(rows: DataFrame, changes: DataFrame, key: str, always: list[str], if_missing: list[str] = (), if_set: list[str] = ()) -> DataFrame:
    """``changes`` over ``rows``: some columns always, some where absent, some where the change is not empty."""
    renamed = changes.select(key, *[F.col(c).alias(f"_{c}") for c in [*always, *if_missing, *if_set]])
    out = rows.join(renamed, key, "left")
    for c in always:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    for c in if_missing:
        out = out.withColumn(c, F.coalesce(c, f"_{c}"))
    for c in if_set:
        out = out.withColumn(c, F.when(F.coalesce(F.col(f"_{c}"), F.lit("")) != "", F.col(f"_{c}")).otherwise(F.col(c)))
    return out.select(*rows.columns)


def with_default(rows: DataFrame, other: DataFrame, key: str, column: str, default: Column) -> DataFrame:
    return rows.join(other.select(key, F.col(column).alias("_d")), key, "left").withColumn(column, F.coalesce("_d", default)).drop("_d")


def not_done(rows: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows whose key the ledger does not hold."""
    return rows.join(ledger.select(key).distinct(), key, "left_anti")


def drop_reasons(rows: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """``reason``: the first that holds, else 'kept'."""
    out = None
    for name, test in reasons:
        out = F.when(test, name) if out is None else out.when(test, name)
    return rows.withColumn("reason", out.otherwise("kept"))
