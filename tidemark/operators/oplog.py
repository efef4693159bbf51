"""The operation log: one row per put (kind 1) or delete (kind 0), newest by the largest seq."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE = 1, 0
SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("kind", T.IntegerType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)


def from_events(events: DataFrame) -> DataFrame:
    """The driver's event table as a log: an error deletes its user's entry, the rest puts props."""
    kind = F.when(F.col("event_type") == "error", DELETE).otherwise(PUT)
    return events.select(
        F.concat(F.lit("user/"), F.lpad(F.col("user_id").cast("string"), 10, "0")).alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        kind.alias("kind"),
        F.when(kind == PUT, F.col("props")).alias("value"),
    )


def in_order(log: DataFrame) -> DataFrame:
    """Keys ascending, versions of a key newest first."""
    return log.orderBy("key", F.desc("seq"))


def history(log: DataFrame, key) -> DataFrame:
    """All versions of one key, newest first, each with the seq of the version before it."""
    from pyspark.sql import Window

    own = log.filter(F.col("key") == F.lit(key))
    return own.withColumn("prev_seq", F.lag("seq").over(Window.partitionBy("key").orderBy("seq"))).orderBy(F.desc("seq"))
