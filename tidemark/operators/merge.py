"""Runs of a log as one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """One row per (key, seq), of the first run that holds it; ``src`` is that run's number.

    A run that can't be read fails the whole: leaving its rows out could bring deleted keys back.
    """
    tagged = [r.withColumn("src", F.lit(i)) for i, r in enumerate(runs)]
    return merge_tagged(reduce(DataFrame.unionByName, tagged))


def merge_tagged(rows: DataFrame) -> DataFrame:
    first = Window.partitionBy("key", "seq").orderBy("src")
    return rows.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
