"""Exact dedup as a stateful stream.

Two streams run one after the other. The first reads the table's new files and notes of each row
its id, its locator (file, row) and the SHA-256 of its normalised text; texts are read and hashed
there once. The second feeds these notes to a keyed aggregation that holds, per digest, the member
count and the smallest (id, locator); its state lives in RocksDB on the executors' disks, is
checkpointed to the shared folder and never expires, so a later call with the same ``state_dir``
goes on where the last one ended.

Then the bytes of hits are checked: through their locators the texts of new rows whose digest is
held more than once, and of the row that represented the digest before, are read again, and texts
of one digest must be one text. A digest under which different texts stand is regrouped by the
texts themselves, in this and all later calls.

Partial aggregation before each shuffle means that a text held by a third of all rows sends one
row per task, in the count as in the check.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WS, create, new_path, stage, text_of, within

_STATE = "spark.sql.streaming.stateStore."
#: State on disk; the caches and write buffers of all state partitions of an executor share one
#: bound, whatever their number.
_SETTINGS = {
    _STATE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    _STATE + "rocksdb.boundedMemoryUsage": "true",
    _STATE + "rocksdb.maxMemoryUsageMB": "128",
    _STATE + "rocksdb.writeBufferSizeMB": "2",
    _STATE + "rocksdb.maxWriteBufferNumber": "2",
    # many small state partitions: no files allocated ahead
    _STATE + "rocksdb.allowFAllocate": "false",
}
#: Hits are marked by a broadcast set of hashes up to this size, each taking ``MARK_BYTES`` there;
#: beyond, a shuffled join on the locator finds the same rows.
BROADCAST_BYTES, MARK_BYTES = 32 << 20, 32


def normalise(text: Column) -> Column:
    return F.regexp_replace(text, WS + "+", " ")


def _digest(sha: Column, bits: int) -> Column:
    return sha if bits == 256 else F.substring(F.hex(sha), 1, bits // 4).cast("binary")


def _place() -> tuple[Column, Column]:
    return F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")


def _folders(spark: SparkSession, path: str, after: str = "", upto: str = "~") -> list[str]:
    """Folders of micro-batches under ``path``, whose names sort as they were written."""
    return [f"{path}/{n}" for n in within(spark, path) if after < n <= upto]


def _read(spark: SparkSession, schema: T.StructType, folders: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _run(spark: SparkSession, rows: DataFrame, state_dir: str, name: str) -> None:
    """Stream ``rows`` to the end, each micro-batch into a folder of its own."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state_dir}/{name}/b{number:010d}")

    writer = rows.writeStream.outputMode("update").trigger(availableNow=True)
    writer.option("checkpointLocation", f"{state_dir}/checkpoint-{name}").foreachBatch(keep).start().awaitTermination()


def _notes(id_type: T.DataType) -> T.StructType:
    fields = [("id", id_type), ("file", T.LongType()), ("row", T.LongType()), ("path", T.StringType()), ("sha", T.BinaryType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _loc() -> Column:
    """Orders rows: by id, null last, then by file and row."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row").alias("loc")


def _keyed(notes: DataFrame, digest_bits: int) -> DataFrame:
    rows = notes.select(_digest(F.col("sha"), digest_bits).alias("digest"), _loc())
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("loc").alias("first"))


def _reduced(changes: DataFrame, batches: int) -> DataFrame:
    """The newest row of each digest: a micro-batch writes those that it touched."""
    if batches <= 1:
        return changes
    return changes.groupBy("digest").agg(F.max("n").alias("n"), F.min("first").alias("first"))


def ingest(
    spark: SparkSession,
    path: str,
    state_dir: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest_bits: int = 256,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Stream the new files of the Parquet table at ``path`` into the keyed state; return its contents.

    Columns: digest, n (rows seen), first (struct no_id, id, file, row of the keeper). Members only
    join and the keeper only gets smaller, so over a digest's rows max and min give its state.
    """
    path = path.rstrip("/")
    schema = spark.read.parquet(path).schema
    limit = {"maxFilesPerTrigger": max_files_per_trigger} if max_files_per_trigger else {}
    # as a pattern, since a stream takes a plain path for a folder and this may be one file
    texts = spark.readStream.schema(schema).options(**limit).parquet(f"{path[:-1]}[{path[-1]}]")
    sha = F.unhex(F.sha2(normalise(text_of(F.col(text_col))), 256)).alias("sha")
    notes = texts.select(F.col(id_col).alias("id"), *_place(), F.col("_metadata.file_path").alias("path"), sha)
    _run(spark, notes, state_dir, "rows")
    fields = _notes(schema[id_col].dataType)
    if not within(spark, f"{state_dir}/rows"):
        return _keyed(spark.createDataFrame([], fields), digest_bits)
    keyed = _keyed(spark.readStream.schema(fields).options(**limit).parquet(f"{state_dir}/rows/b*"), digest_bits)
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        _run(spark, keyed, state_dir, "changes")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    folders = _folders(spark, f"{state_dir}/changes")
    return _reduced(_read(spark, keyed.schema, folders), len(folders))


def exact_dedup(
    spark: SparkSession,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    state_dir: str | None = None,
    digest_bits: int = 256,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Group equal texts of the Parquet table at ``path``.

    Texts are equal if identical once each run of white space (U+0020, U+0009..U+000D) is one
    space. Per row: doc_id, keep_id, group_size, kept, text_sha256. A later call with the same
    ``state_dir`` returns the rows of all files seen, and reads the texts of new files and of files
    that hold a row that new rows hit. Defined cases: a null text counts as empty; a null id sorts
    after all ids; of rows with the same id and text (repeated rows) the first by the hash of its
    file's path, then by row, stays; an empty table gives no rows; other columns are ignored.
    ``digest_bits`` below 256 weakens the digest, for tests of the byte comparison.
    """
    state_dir = state_dir or new_path(spark, "exact-dedup")
    state = ingest(
        spark, path, state_dir, id_col=id_col, text_col=text_col,
        digest_bits=digest_bits, max_files_per_trigger=max_files_per_trigger,
    )
    id_type = spark.read.parquet(path).schema[id_col].dataType
    # names of the last micro-batches whose hits were checked, by the last call that ended
    checked = within(spark, f"{state_dir}/done")[-1:]
    last_rows, last_changes = checked[0].split("-") if checked else ("", "")
    old, new = _folders(spark, f"{state_dir}/rows", upto=last_rows), _folders(spark, f"{state_dir}/rows", after=last_rows)

    def noted(folders: list[str], is_new: bool) -> DataFrame:
        return _read(spark, _notes(id_type), folders).withColumn("new", F.lit(is_new))

    rows = noted(old, False).union(noted(new, True)) if old and new else noted(new or old, bool(new))
    rows = rows.select(_digest(F.col("sha"), digest_bits).alias("digest"), _loc(), "sha", "new")
    joined = stage(rows.join(state, "digest"), "digest-groups")
    hits = joined.filter("new and n > 1").select("digest", "loc.file", "loc.row")
    paths = None
    if old:
        before = _folders(spark, f"{state_dir}/changes", upto=last_changes)
        before = _reduced(_read(spark, state.schema, before), len(before))
        met = stage(before.join(hits.select("digest").distinct(), "digest", "left_semi").select("digest", "first.file", "first.row"), "digest-anchors")
        hits = hits.unionByName(met)
        known = noted(old + new, True).select("file", "path").distinct()  # a row for each file
        paths = [r.path for r in known.join(hits.select("file").distinct(), "file", "left_semi").select("path").collect()]
    texts = _texts(spark, path, paths, text_col)
    n_hits = hits.count()
    if n_hits * MARK_BYTES <= BROADCAST_BYTES:
        marks = hits.select(F.xxhash64("file", "row").alias("mark")).distinct()
        texts = texts.withColumn("mark", F.xxhash64("file", "row")).join(F.broadcast(marks), "mark", "left_semi")
    else:
        texts = texts.join(hits.select("file", "row"), ["file", "row"], "left_semi")
    norm = normalise(text_of(F.col("text"))).alias("norm")
    distinct = texts.select(norm).distinct()
    distinct = distinct.select(_digest(F.unhex(F.sha2("norm", 256)), digest_bits).alias("digest"))
    collided = distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    upto = [f[-1].rsplit("/", 1)[-1] if f else "" for f in (_folders(spark, f"{state_dir}/rows"), _folders(spark, f"{state_dir}/changes"))]
    if new and n_hits:
        collided.write.mode("overwrite").parquet(f"{state_dir}/collided/{upto[0]}")
    if new:
        create(spark, f"{state_dir}/done/{upto[0]}-{upto[1]}")
    bad = _read(spark, collided.schema, _folders(spark, f"{state_dir}/collided", upto=upto[0])).distinct()
    if bad.isEmpty():
        return _result(joined)
    # different texts of one digest: group the members by text
    members = joined.join(bad, "digest", "left_semi").select("digest", "loc")
    found = _texts(spark, path, None, text_col).select("file", "row", norm)
    members = stage(members.join(found, (F.col("loc.file") == F.col("file")) & (F.col("loc.row") == F.col("row"))).select("digest", "loc", "norm"), "digest-collisions")
    groups = members.groupBy("digest", "norm").agg(F.min("loc").alias("own_first"), F.count(F.lit(1)).alias("own_n"))
    own = members.join(groups, ["digest", "norm"]).select("digest", "loc", "own_first", "own_n")
    out = joined.join(own, ["digest", "loc"], "left")
    return _result(out.select("loc", "sha", F.coalesce("own_first", "first").alias("first"), F.coalesce("own_n", "n").alias("n")))


def _texts(spark: SparkSession, path: str, files: list[str] | None, text_col: str) -> DataFrame:
    """file, row, text of the table, or of some of its files."""
    if files is not None:
        names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in files]
        if not names:
            return spark.createDataFrame([], "file long, row long, text string")
        found = spark.read.schema(f"`{text_col}` string").parquet(*names)
    else:
        found = spark.read.parquet(path)
    return found.select(*_place(), F.col(text_col).alias("text"))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("loc.id").alias("doc_id"),
        F.col("first.id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("loc") == F.col("first")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
