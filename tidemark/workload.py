"""Workload generators: Zipfian keys and read/update mixes, as bulk DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import zipf_key

#: Skew and value size of the mixes.
THETA = 0.99
VALUE_BYTES = 100
#: Shares of reads, updates and read-modify-writes.
MIXES = {"A": (0.5, 0.5, 0.0), "B": (0.95, 0.05, 0.0), "C": (1.0, 0.0, 0.0), "F": (0.5, 0.0, 0.5)}


def zeta(spark: SparkSession, n: int, theta: float = THETA) -> float:
    """Rounded, since a sum of doubles depends on its order."""
    total = spark.range(1, n + 1).agg(F.sum(F.pow(F.col("id").cast("double"), F.lit(-theta)))).first()[0]
    return round(total or 0.0, 6)


@dataclass(frozen=True)
class Zipf:
    """Ranks 0..n-1, small ones most often, from a uniform column in closed form."""

    n: int
    zeta_n: float
    theta: float = THETA

    @classmethod
    def of(cls, spark: SparkSession, n: int, theta: float = THETA) -> Zipf:
        return cls(n, zeta(spark, n, theta), theta)

    def rank(self, u: Column) -> Column:
        alpha, zeta2 = 1 / (1 - self.theta), 1 + 0.5**self.theta
        eta = (1 - (2 / self.n) ** (1 - self.theta)) / (1 - zeta2 / self.zeta_n)
        far = F.floor(F.lit(float(self.n)) * F.pow(eta * u - eta + 1, F.lit(alpha))).cast("long")
        scaled = u * self.zeta_n
        return F.when(scaled < 1, 0).when(scaled < zeta2, 1).otherwise(F.least(far, F.lit(self.n - 1)))


def uniform(id_: Column) -> Column:
    """A fixed point in [0, 1) for each id, by a linear congruence any SQL engine can repeat."""
    mod = 2147483647
    once = (id_ % mod * 48271 + 11) % mod
    return ((once * 69621 + 7) % mod).cast("double") / float(mod)


def requests(spark: SparkSession, n: int, chooser: Zipf, mix: str = "C") -> DataFrame:
    """request, op (read, update, rmw), key."""
    reads, updates, _ = MIXES[mix]
    roll = uniform(F.col("id") * 7 + 3)
    op = F.when(roll < reads, "read").when(roll < reads + updates, "update").otherwise("rmw")
    return spark.range(n).select(F.col("id").alias("request"), op.alias("op"), zipf_key(chooser.rank(uniform(F.col("id")))).alias("key"))


def random_ops(spark: SparkSession, n: int, keys: int, *, seed: int = 42) -> DataFrame:
    """op_index, key, kind, value: about a fifth deletes."""
    h = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 31))
    kind = F.when(h(1) % 5 == 0, 0).otherwise(1)
    value = F.when(kind == 1, F.concat(F.lit("val-"), F.col("id").cast("string")).cast("binary"))
    return spark.range(n).select(F.col("id").alias("op_index"), F.format_string("key-%05d", h(0) % keys).cast("binary").alias("key"), kind.alias("kind"), value.alias("value"))
