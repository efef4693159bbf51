"""Shared helpers of the operators: text, keys of rows, literals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sweep import running, swept
from ..staging import create, delete, new_path, shared_dir, stage, within

__all__ = [
    "UPPER", "WORD", "WS", "all_of", "create", "delete", "let", "lower_ascii", "new_path", "row_key", "running", "shared_dir", "stage", "swept", "table", "text_of", "within",
]

#: White space of every contract here: the space and U+0009..U+000D.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_of(col: str | Column) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else.

    ``translate`` looks up every character; a text of ASCII alone takes the quick way.
    """
    plain = F.octet_length(col) == F.char_length(col)
    return F.when(plain, F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, even where a lambda inside uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two longs that stand for a row: equal for repeated rows, whose results are equal too."""
    both = F.struct(F.col(id_col), F.col(text_col))
    return F.xxhash64(both).alias("k1"), F.xxhash64(F.lit("row"), both).alias("k2")
