"""Dropping versions that no reader can see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import asof, newest
from .oplog import DELETE


def watermark(live_snapshots: list[int], visible_seq: int) -> int:
    """The oldest seq that is still read: of the snapshots, or what is visible without any."""
    return min([*live_snapshots, visible_seq])


def retain(log: DataFrame, oldest: int, *, bottom: bool) -> DataFrame:
    """What must stay for all reads at ``oldest`` or later.

    All newer versions stay, and of the others the newest of each key; that one goes too if it is
    a delete and no older level holds the key (``bottom``). Newer versions aren't shuffled, and of
    the others each task sends one row a key, so a key with any number of versions is no burden.
    """
    last = newest(log.filter(F.col("seq") <= oldest))
    if bottom:
        last = last.filter(F.col("kind") != DELETE)
    return log.filter(F.col("seq") > oldest).unionByName(last)


def differences(log: DataFrame, oldest: int, seq: int, *, bottom: bool) -> DataFrame:
    """Rows that a read at ``seq`` has before or after :func:`retain` but not both: none."""
    before, after = asof(log, seq), asof(retain(log, oldest, bottom=bottom), seq)
    return before.exceptAll(after).unionByName(after.exceptAll(before))
