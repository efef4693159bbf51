"""Ranges of keys."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Generic, TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = TypeVar("K", bytes, str)


@dataclass(frozen=True)
class Range(Generic[K]):
    """Bounds; None is unbounded. An inverted range is empty, not an error."""

    lo: K | None = None
    hi: K | None = None
    lo_open: bool = False
    hi_open: bool = True

    def apply(self, df: DataFrame, column: str = "key") -> DataFrame:
        c = F.col(column)
        if self.lo is not None:
            df = df.filter(c > F.lit(self.lo) if self.lo_open else c >= F.lit(self.lo))
        if self.hi is not None:
            df = df.filter(c < F.lit(self.hi) if self.hi_open else c <= F.lit(self.hi))
        return df

    def meets(self, smallest: K, largest: K) -> bool:
        """Whether a file with these keys may hold any of the range."""
        below = self.hi is not None and (smallest >= self.hi if self.hi_open else smallest > self.hi)
        above = self.lo is not None and (largest <= self.lo if self.lo_open else largest < self.lo)
        return not (below or above)


def prefix_range(prefix: bytes) -> Range[bytes]:
    """The keys that start with ``prefix``: up to the least key after all of them, if there is one."""
    stem = prefix.rstrip(b"\xff")
    if not stem:
        return Range(prefix, None)
    return Range(prefix, stem[:-1] + bytes([stem[-1] + 1]))


def prefix_range_text(prefix: str) -> Range[str]:
    """The same over strings of ASCII."""
    found = prefix_range(prefix.encode("ascii"))
    return Range(prefix, None if found.hi is None else found.hi.decode("ascii"))


def scan(view: DataFrame, bounds: Range) -> DataFrame:
    """Live keys of a range in ascending order."""
    return bounds.apply(view).orderBy("key")
