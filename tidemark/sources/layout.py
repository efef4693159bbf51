"""Sorted Parquet runs and log batches: writing, syncing, reading and checking them."""

from __future__ import annotations

import os
import re
import shutil
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DataFileCorrupt
from ..operators.oplog import SCHEMA
from ..plans.manifest import FileMeta, LogBatch, LogFile

#: Checksums of more bytes than these are taken by the executors.
DRIVER_BYTES = 64 << 20
#: What one task sorts for a run, in bytes of keys, values and overhead.
SORT_BYTES = 32 << 20
#: Rows of a large run's row group, in the same bytes, so that reading it spreads however well it is packed.
ROW_GROUP_BYTES = 16 << 20
_CHUNK = 8 << 20
_COLUMNS = ["key", "seq", "kind", "value"]
_ARROW = pa.schema([pa.field("key", pa.binary(), False), pa.field("seq", pa.int64(), False), pa.field("kind", pa.int32(), False), pa.field("value", pa.binary())])


def list_batches(folder: str) -> list[int]:
    """Numbers of ``batch=<digits>`` folders, in numeric order; other names are ignored."""
    if not os.path.isdir(folder):
        return []
    return sorted(int(m[1]) for f in os.listdir(folder) if (m := re.fullmatch(r"batch=(\d+)", f)))


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of files or folders given one by one, so that later files don't change the view.

    Pages are read against their checksums.
    """
    if not paths:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("parquet.page.verify-checksum.enabled", "true").parquet(*paths)


def write_log(rows: DataFrame, path: str) -> None:
    _writer(rows).parquet(path)


def write_log_here(rows: list[tuple[bytes, int, int, bytes | None]], path: str) -> None:
    """A batch that the driver holds: one file, without a job."""
    os.makedirs(path)
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)]
    pq.write_table(pa.Table.from_arrays(columns, schema=_ARROW), f"{path}/part-00000.parquet", compression="zstd", write_page_checksum=True)


def _writer(rows: DataFrame) -> DataFrameWriter:
    return rows.select(*_COLUMNS).write.option("compression", "zstd").option("parquet.page.write-checksum.enabled", "true")


def write_runs(rows: DataFrame, path: str, files: int, entries: int, size: int = 0) -> None:
    """``files`` runs of disjoint key ranges, each in internal order, of ``entries`` rows in all.

    Ranges are by key alone, so all versions of a key are in one file. A file's Bloom filter over
    its keys is made for its share of the rows. Rows of over ``SORT_BYTES`` (``size``, as the
    memtable counts them) are sorted in ranges first: a task never sorts a file or a key whole.
    """
    if size > SORT_BYTES:
        staging = f"{os.path.dirname(path)}/staging={os.path.basename(path).rpartition('=')[2]}"
        try:
            _merge_ranges(rows, staging, path, files, entries, size)
        finally:
            shutil.rmtree(staging, ignore_errors=True)
        return
    ordered = (rows.coalesce(1) if files == 1 else rows.repartitionByRange(files, "key")).sortWithinPartitions("key", F.desc("seq"))
    _bloomed(_writer(ordered), entries, files).parquet(path)


def _bloomed(writer: DataFrameWriter, entries: int, files: int) -> DataFrameWriter:
    each = str(max(16, -(-entries // files)))
    return writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", each)


def _merge_ranges(rows: DataFrame, staging: str, path: str, files: int, entries: int, size: int) -> None:
    """Ranges of key and seq, sorted by a task each; then a task for each file strings them together.

    A range may begin within a key. Files are cut at the first key of a range, and take what the
    range before has of that key. Both kinds of task hold a range or a few batches at most.
    """
    spark, parts = rows.sparkSession, max(files, -(-size // SORT_BYTES))
    order = ["key", F.desc("seq")]
    _writer(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)).parquet(staging)
    ranges = sorted(describe(spark, staging), key=lambda f: (f.smallest, f.largest, -f.max_seq))
    if not ranges:
        return os.makedirs(path)
    share, cuts, held = sum(f.entries for f in ranges) / files, [ranges[0].smallest], 0
    for f in ranges:
        if held >= share * len(cuts) and f.smallest > cuts[-1]:
            cuts.append(f.smallest)
        held += f.entries
    plan = [(lo, hi, [f.path for f in ranges if f.largest >= lo and (hi is None or f.smallest < hi)]) for lo, hi in zip(cuts, [*cuts[1:], None], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in b.column("id").to_pylist():
                yield from _between(*plan[n])

    merged = spark.range(0, len(plan), 1, len(plan)).mapInArrow(run, "key binary, seq long, kind int, value binary")  # a task a file
    group = max(1, entries * ROW_GROUP_BYTES // size)
    _bloomed(_writer(merged), min(group, -(-entries // len(plan))), 1).option("parquet.block.row.count.limit", str(group)).parquet(path)


def _between(lo: bytes, hi: bytes | None, paths: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of the files, one file after the other, with keys from ``lo`` to before ``hi``."""
    for path in paths:
        with pq.ParquetFile(path, buffer_size=1 << 20, pre_buffer=False, page_checksum_verification=True) as f:
            width = sum(f.metadata.row_group(i).total_byte_size for i in range(f.metadata.num_row_groups)) // f.metadata.num_rows + 1
            for b in f.iter_batches(max(1, min(4096, (4 << 20) // width)), columns=_COLUMNS):
                keep = pc.greater_equal(b.column("key"), pa.scalar(lo, pa.binary()))
                if hi is not None:
                    keep = pc.and_(keep, pc.less(b.column("key"), pa.scalar(hi, pa.binary())))
                if (found := b.filter(keep)).num_rows:
                    yield found


def data_files(path: str) -> list[str]:
    return sorted(f"{path}/{f}" for f in os.listdir(path) if f.endswith(".parquet") and f[0] not in "._")


def sync(path: str) -> None:
    """Put a folder's files, and the names on the way to them, on disk."""
    for name in [*data_files(path), path, os.path.dirname(path), os.path.dirname(os.path.dirname(path))]:
        at = os.open(name, os.O_RDONLY)
        try:
            os.fsync(at)
        finally:
            os.close(at)


def _crc(path: str) -> int:
    crc = 0
    with open(path, "rb") as f:
        while chunk := f.read(_CHUNK):
            crc = zlib.crc32(chunk, crc)
    return crc


def checksums(spark: SparkSession, paths: list[str]) -> dict[str, int | None]:
    """CRC-32 of each file's bytes; None where it can't be read. Executors read many bytes."""

    def one(path: str) -> int | None:
        try:
            return _crc(path)
        except OSError:
            return None

    if sum(os.path.getsize(p) for p in paths if os.path.exists(p)) <= DRIVER_BYTES:
        return {p: one(p) for p in paths}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([one(n) for n in names], pa.int64())], ["path", "crc"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 1024))
    return {r.path: r.crc for r in files.mapInArrow(run, "path string, crc long").collect()}  # one row a file


def seal(spark: SparkSession, path: str) -> tuple[LogFile, ...]:
    """Sync a log folder; the size, row count and checksum of each file, for its commit."""
    sync(path)
    files = data_files(path)
    crcs = checksums(spark, files)
    return tuple(LogFile(os.path.basename(f), os.path.getsize(f), pq.ParquetFile(f).metadata.num_rows, crcs[f]) for f in files)


def validate_logs(spark: SparkSession, logs: list[LogBatch]) -> None:
    """All that was acknowledged must be there, byte for byte."""
    wanted = {f"{b.path}/{f.name}": f for b in logs for f in b.files}
    for path, f in wanted.items():
        size = os.path.getsize(path) if os.path.isfile(path) else None
        if size != f.size:
            raise DataFileCorrupt(f"{path}: {size} bytes, not {f.size}")
    for path, crc in checksums(spark, list(wanted)).items():
        if crc != wanted[path].crc32:
            raise DataFileCorrupt(f"{path}: the checksum differs")


def describe(spark: SparkSession, path: str) -> list[FileMeta]:
    """Metadata of the non-empty files under ``path``, in key order and numbered from 0."""
    payload = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    rows = read(spark, [path]).groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min("key").alias("smallest"), F.max("key").alias("largest"), F.max("seq").alias("max_seq"), F.count(F.lit(1)).alias("entries"), F.sum(payload.cast("long")).alias("payload")
    )
    found = sorted(rows.collect(), key=lambda r: (bytes(r.smallest), r.file))  # one row a file
    out = []
    for k, r in enumerate(found):
        local = f"{path}/{os.path.basename(r.file)}"
        out.append(FileMeta(k, bytes(r.smallest), bytes(r.largest), os.path.getsize(local), r.max_seq, r.entries, local, r.payload))
    return out


def validate(meta: FileMeta) -> None:
    """A file must be there with the size and the row count of the manifest."""
    try:
        size, rows = os.path.getsize(meta.path), pq.ParquetFile(meta.path).metadata.num_rows
    except Exception as e:
        raise DataFileCorrupt(f"{meta.path}: {e}") from e
    if size != meta.size or rows != meta.entries:
        raise DataFileCorrupt(f"{meta.path}: {size} bytes and {rows} rows, not {meta.size} and {meta.entries}")


def out_of_order(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, row_index, key, seq of the rows that don't come after the row before them in the file.

    Keys ascend, and of a key seqs descend. A task sorts one file at most, which has the target size.
    """
    rows = read(spark, paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"), "key", "seq")
    order = Window.partitionBy("file").orderBy("row_index")
    rows = rows.withColumns({"k": F.lag("key").over(order), "s": F.lag("seq").over(order)})
    return rows.filter((F.col("k") > F.col("key")) | (F.col("k") == F.col("key")) & (F.col("s") <= F.col("seq"))).select("file", "row_index", "key", "seq")
