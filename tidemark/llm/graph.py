"""Connected components by alternating stars, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import delete, new_path


def components(edges: DataFrame, *, max_rounds: int = 100) -> DataFrame:
    """``edges``: a, b (longs, undirected). Returns node, root: the smallest node reachable.

    Large star: each node gives its larger neighbours to its least one. Small star: each node
    gives its smaller neighbours, and itself, to the least. Both keep components and shrink their
    depth, until every node hangs on its root; the number of rounds grows with the logarithm of
    the size. Self-loops, repeated and reversed edges don't matter; no edges give no rows.
    """
    spark = edges.sparkSession
    path = new_path(spark, "components")

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = write(e, "0-edges")
    before = state(e)
    for k in range(1, max_rounds + 1):
        # a hub's row count may be any share of the edges: its minimum is pre-aggregated and
        # written, so that the join is a plain one, which AQE can split
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{k}-large-min")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        e = write(large, f"{k}-large")
        least = write(e.groupBy("a").agg(F.min("b").alias("m")), f"{k}-small-min")
        small = e.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        e = write(small.filter("a != b").distinct(), f"{k}-edges")
        delete(spark, f"{path}/{k - 1}-edges")
        for name in ("large-min", "large", "small-min"):
            delete(spark, f"{path}/{k}-{name}")
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
