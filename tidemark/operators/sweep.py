"""Running sums and sweeps over a global order, without one task for all or for one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage


#: Rows of at most this size, by the planner's estimate from file sizes, are one range: a task's work.
ONE_RANGE_BYTES = 256 << 10


def _one_range(rows: DataFrame) -> bool:
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= ONE_RANGE_BYTES


def _ranged(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with ``_range``, the number of their range in ``order``; written once."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), name)


def running(rows: DataFrame, order: list[Column | str], amounts: dict[str, Column | str], name: str) -> DataFrame:
    """Adds, for each of ``amounts``, the sum over the rows that come before in ``order``.

    Rows are cut into ranges, written once, and summed by range; the table of ranges has a row for
    each partition, so its own running sum and its broadcast are bounded by their number.
    """
    added = {f"_amount_{k}": F.col(c) if isinstance(c, str) else c for k, c in amounts.items()}
    wide = rows.withColumns(added)
    before = (Window.unboundedPreceding, -1)
    upto = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(*before)), F.lit(0))
    if _one_range(rows):
        return wide.select(*rows.columns, *[upto(f"_amount_{k}", Window.orderBy(*order)).alias(k) for k in amounts])
    ranged = _ranged(wide, order, name)
    sums = ranged.groupBy("_range").agg(*[F.sum(c).alias(c) for c in added])
    bases = sums.select("_range", *[upto(c, Window.orderBy("_range")).alias(f"_base{c}") for c in added])
    near = Window.partitionBy("_range").orderBy(*order)
    inner = ranged.withColumns({f"_in{c}": upto(c, near) for c in added})
    out = inner.join(F.broadcast(bases), "_range")
    return out.select(*rows.columns, *[(F.col(f"_base_amount_{k}") + F.col(f"_in_amount_{k}")).alias(k) for k in amounts])


def swept(events: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``events`` with the last ``value`` that isn't null, up to each row in ``order``.

    As in :func:`running`, each range starts with what the ranges before it end with.
    """
    upto = (Window.unboundedPreceding, Window.currentRow)
    if _one_range(events):
        return events.withColumn(value, F.last(value, ignorenulls=True).over(Window.orderBy(*order).rowsBetween(*upto)))
    ranged = _ranged(events, order, name)
    ends = ranged.groupBy("_range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_range", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    near = Window.partitionBy("_range").orderBy(*order).rowsBetween(*upto)
    inner = ranged.withColumn(value, F.last(value, ignorenulls=True).over(near))
    return inner.join(F.broadcast(carried), "_range").withColumn(value, F.coalesce(value, "_carried")).drop("_range", "_carried")
