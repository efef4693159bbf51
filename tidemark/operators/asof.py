"""Reads as of a sequence number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .oplog import DELETE, PUT
from .sweep import swept


def newest(log: DataFrame, seq: int | None = None) -> DataFrame:
    """Per key the newest row with ``seq`` at most the given one, deletes included.

    The bound on seq comes before the choice and any test of kind after it: the other way round a
    deleted key would come back. ``row_number() = 1`` is planned with a group limit before the
    shuffle, so a key with any number of versions sends one row per task.
    """
    rows = log if seq is None else log.filter(F.col("seq") <= seq)
    order = Window.partitionBy("key").orderBy(F.desc("seq"))
    return rows.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def asof(log: DataFrame, seq: int | None = None) -> DataFrame:
    """key, seq, value of the keys that live at ``seq`` (default: at the end)."""
    return newest(log, seq).filter(F.col("kind") == PUT).select("key", "seq", "value")


def lookup(log: DataFrame, keys: DataFrame, seq: int | None = None) -> DataFrame:
    """Of each row of ``keys`` (key): outcome put, delete or absent, and the value if put."""
    found = newest(log.join(keys.select("key").distinct(), "key", "left_semi"), seq)
    outcome = F.when(F.col("kind").isNull(), "absent").when(F.col("kind") == DELETE, "delete").otherwise("put")
    return keys.select("key").join(found, "key", "left").select("key", outcome.alias("outcome"), "value")


def get(log: DataFrame, key, seq: int | None = None) -> DataFrame:
    """One key: a row of key and value if it lives, else none. The filter reaches the scan."""
    return asof(log.filter(F.col("key") == F.lit(key)), seq).select("key", "value")


def asof_join(probes: DataFrame, log: DataFrame) -> DataFrame:
    """``probes``: probe_seq, key. Adds the value that the key had at probe_seq; dead keys go.

    Versions and probes are swept in one order of key and seq: the work grows with probes plus
    versions. The order is cut into ranges, each of which is told the last version before it, so a
    key with any number of versions spreads over many tasks.
    """
    state = F.struct("key", "kind", "value").alias("state")
    one = log.select("key", F.col("seq").alias("at"), F.lit(0).alias("probe"), state)
    two = probes.select("key", F.col("probe_seq").alias("at"), F.lit(1).alias("probe"), F.lit(None).cast(one.schema["state"].dataType).alias("state"))
    seen = swept(one.unionByName(two), ["key", "at", "probe"], "state", "asof-join")
    found = (F.col("probe") == 1) & (F.col("state.key") == F.col("key")) & (F.col("state.kind") == PUT)
    return seen.filter(found).select(F.col("at").alias("probe_seq"), "key", F.col("state.value").alias("value"))
