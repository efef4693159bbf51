"""Bytes of operations, files and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sweep import running
from ..options import ENTRY_OVERHEAD, LOG_HEADER


def payload() -> Column:
    return F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))


def byte_counts(log: DataFrame) -> DataFrame:
    """One row: user_bytes, wal_bytes, mem_bytes."""
    total = lambda extra: F.coalesce(F.sum((payload() + extra).cast("long")), F.lit(0))
    return log.agg(total(0).alias("user_bytes"), total(LOG_HEADER).alias("wal_bytes"), total(ENTRY_OVERHEAD).alias("mem_bytes"))


def amplification(written: Column, user: Column) -> Column:
    return F.when(user == 0, F.lit(0.0)).otherwise(written / user)


def summary(log: DataFrame, *by: str) -> DataFrame:
    """Of each group: smallest, largest, entries, max_seq."""
    return log.groupBy(*by).agg(
        F.min("key").alias("smallest"), F.max("key").alias("largest"), F.count(F.lit(1)).alias("entries"), F.max("seq").alias("max_seq")
    )


def nearest_rank(df: DataFrame, column: str, percents: list[float]) -> DataFrame:
    """p, value: the value at rank round(p * (n - 1)) in order.

    Ranks come from per-value counts and running sums over ranges of the distinct values: equal
    values combine before the shuffle, and distinct ones are never in one task.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = running(counts, ["value"], {"lo": "n"}, "ranks")
    total = upto.agg(F.sum("n")).first()[0] or 0
    ranks = [F.struct(F.lit(float(p)).alias("p"), F.round(F.lit(float(p)) * (total - 1)).cast("long").alias("rank")) for p in percents]
    wanted = upto.withColumn("w", F.explode(F.filter(F.array(*ranks), lambda w: (w["rank"] >= F.col("lo")) & (w["rank"] < F.col("lo") + F.col("n")))))
    return wanted.select("w.p", "value")
