"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one in local mode only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/{name}"


_STAGED: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage with a table that survives a lost executor, and pins values that a second
    evaluation could number differently. The table stays for readers of lazy results until
    :func:`release`.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def within(spark: SparkSession, path: str) -> list[str]:
    """Sorted names in a folder, hidden ones apart; none if there is no such folder."""
    fs, p = _hadoop(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if n[0] not in "._")


def create(spark: SparkSession, path: str) -> None:
    """An empty file, which is there whole or not at all."""
    fs, p = _hadoop(spark, path)
    fs.create(p, True).close()


@contextmanager
def collected() -> Iterator[list[str]]:
    """The list of what is staged inside, complete at the end."""
    own: list[str] = []
    since = len(_STAGED)
    try:
        yield own
    finally:
        own += _STAGED[since:]


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete staged tables, by default all of this process; how many went.

    Only once the results that read them have been read or written themselves.
    """
    gone = [p for p in _STAGED if paths is None or p in paths]
    for path in gone:
        _STAGED.remove(path)
        delete(spark, path.rsplit("/", 1)[0])
    return len(gone)
