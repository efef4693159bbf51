"""A store: atomic batches, snapshots, flush and leveled compaction over Parquet files.

``<dir>/_lock`` is held while open; ``_manifest`` has the commits; ``log/batch=N`` the committed
batches that aren't flushed; ``L<n>/job=N`` the sorted files. Executors write data files (the driver
those of batches it holds), the driver syncs them and then commits their names, with size, row count
and checksum for what is only in the log. A view names its files one by one, so later writes,
flushes and compactions don't touch it; files go when no snapshot or view that is registered needs
them. The directory must be a POSIX path that all executors share.

Writers from any number of threads queue up. The one that finds nobody committing takes what is
queued, commits it as one log file and one manifest record, answers all, and hands over to the
first that came meanwhile. When
the log has ``memtable_size`` bytes it is frozen and flushed, by the writer itself or, with
``background``, by a thread, which lets writers go on until ``MAX_FROZEN`` frozen logs wait.

Locks are taken in this order: ``_writing`` (one commit of data at a time), ``_work`` (one flush or
compaction at a time), ``_guard`` (state in memory and the manifest). Jobs run outside ``_guard``.
"""

from __future__ import annotations

import contextlib
import fcntl
import os
import shutil
import threading
import time
from collections import Counter, deque
from collections.abc import Callable, Iterable
from concurrent.futures import Future
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .errors import DataFileCorrupt, InvalidArgument, StoreClosed, StoreError, StoreIOError, StoreLocked, StorePoisoned
from .functions.accounting import payload
from .operators import asof as reads
from .operators.bounds import Range
from .operators.merge import merge_tagged
from .operators.oplog import DELETE, PUT
from .operators.retention import retain, watermark
from .options import ENTRY_OVERHEAD, LOG_HEADER, MAX_BATCH_REQUESTS, MAX_FROZEN, MAX_KEY_LEN, MAX_VALUE_LEN, Options
from .plans.compaction import Plan, hull, may_drop_deletes, overlapping, pick
from .plans.manifest import FileMeta, LogBatch, Manifest, added
from .sources import layout


class WriteBatch:
    """Puts and deletes that are committed together, in order."""

    def __init__(self) -> None:
        self.ops: list[tuple[bytes, int, bytes | None]] = []

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self.ops.append((bytes(key), PUT, bytes(value)))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self.ops.append((bytes(key), DELETE, None))
        return self

    def is_empty(self) -> bool:
        return not self.ops

    def __len__(self) -> int:
        return len(self.ops)


@dataclass
class Stats:
    """Counted since the store was opened."""

    level_files: list[int] = field(default_factory=list)
    level_bytes: list[int] = field(default_factory=list)
    memtable_bytes: int = 0
    user_bytes: int = 0
    wal_bytes: int = 0
    flush_bytes: int = 0
    compaction_bytes: int = 0
    #: Keys and values of what was written, before Parquet's compression.
    flush_payload: int = 0
    compaction_payload: int = 0
    #: Log files committed: batches of several writers share one.
    log_commits: int = 0
    background_idle: bool = True

    def write_amplification(self) -> float:
        return (self.wal_bytes + self.flush_bytes + self.compaction_bytes) / self.user_bytes if self.user_bytes else 0.0


@dataclass
class _Request:
    """What one caller wants committed, and where the answer goes."""

    batches: list[WriteBatch]
    size: int
    answer: Future = field(default_factory=Future)
    #: Set once there is an answer, or once this caller is to commit for all that wait.
    turn: threading.Event = field(default_factory=threading.Event)

    def succeed(self, seqs: list[int]) -> None:
        self.answer.set_result(seqs)
        self.turn.set()

    def fail(self, e: Exception) -> None:
        self.answer.set_exception(e)
        self.turn.set()


class Snapshot:
    """A seq and the files that hold all up to it, until released."""

    def __init__(self, store: Store, seq: int, paths: list[str]) -> None:
        self._store, self._seq, self._paths, self._open = store, seq, paths, True

    def seq(self) -> int:
        return self._seq

    def log(self) -> DataFrame:
        return layout.read(self._store.spark, self._paths)

    def view(self) -> DataFrame:
        """key, seq, value of all live keys."""
        return reads.asof(self.log(), self._seq)

    def get(self, key: bytes) -> bytes | None:
        found = reads.get(layout.read(self._store.spark, self._store._holding(self._paths, Range(key, key, hi_open=False))), bytearray(key), self._seq).head()
        return bytes(found.value) if found else None

    def scan(self, bounds: Range = Range()) -> DataFrame:  # noqa: B008
        """Ascending keys; files outside the bounds aren't opened."""
        rows = bounds.apply(layout.read(self._store.spark, self._store._holding(self._paths, bounds)))
        return reads.asof(rows, self._seq).select("key", "value").orderBy("key")

    def release(self) -> None:
        if self._open:
            self._open = False
            self._store._release(self)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options) -> None:
        self.spark, self.path, self.options = spark, path, options
        self._guard = threading.RLock()
        self._changed = threading.Condition(self._guard)
        self._writing, self._work = threading.RLock(), threading.RLock()
        self._queue: deque[_Request] = deque()
        self._leading = False
        #: The last log batch of each frozen log that waits for its flush, oldest first.
        self._frozen: list[int] = []
        self._busy = False
        self._thread: threading.Thread | None = None
        self._next = 1
        self._snapshots: dict[int, Snapshot] = {}
        self._seqs: Counter[int] = Counter()
        self._garbage: set[str] = set()
        self._stats = Stats()
        self._closed, self._failed = False, ""

    # --- life ---------------------------------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Store:
        """Recover: lock, fold the manifest, check the files, drop what no commit names, go on.

        A batch whose commit isn't there never was. A file that a commit names and that isn't there
        as it was acknowledged is an error, and nothing is removed.
        """
        options = options or Options()  # checks its values before the directory is touched
        self = cls(spark, path.rstrip("/"), options)
        os.makedirs(self.path, exist_ok=True)
        self._lock = os.open(f"{self.path}/_lock", os.O_RDWR | os.O_CREAT)
        try:
            fcntl.flock(self._lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            os.close(self._lock)
            raise StoreLocked(self.path) from e
        try:
            self._manifest = Manifest(f"{self.path}/_manifest")
            for files in self._manifest.state.levels:
                for meta in files:
                    layout.validate(meta)
            layout.validate_logs(spark, self._manifest.state.logs)
            self._remove_orphans()
        except BaseException:
            self._unlock()
            raise
        self._next = self._manifest.state.next_number
        if options.background:
            self._thread = threading.Thread(target=self._background, name="tidemark-maintenance", daemon=True)
            self._thread.start()
        return self

    def _unlock(self) -> None:
        fcntl.flock(self._lock, fcntl.LOCK_UN)
        os.close(self._lock)

    def close(self) -> None:
        """Commits that have begun end; what is still queued fails. The log stays for the next open."""
        with self._guard:
            if self._closed:
                return
            self._closed = True
            self._changed.notify_all()
        if self._thread and self._thread is not threading.current_thread():
            self._thread.join()
        with self._writing, self._work, self._guard:  # after the commit or job that is running
            while self._queue:
                self._queue.popleft().fail(StoreClosed(self.path))
            self._collect_garbage(everything=True)
            self._unlock()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _ready(self) -> None:
        if self._closed:
            raise StoreClosed(self.path)
        if self._failed:
            raise StorePoisoned(self._failed)

    def _fail(self, e: Exception) -> StoreIOError:
        """The first failure half-way: no call goes on until the store is opened again."""
        with self._guard:
            self._failed = self._failed or str(e)[:200] or type(e).__name__
            self._changed.notify_all()
        return e if isinstance(e, StorePoisoned) else StoreIOError(str(e))

    def _allot(self, n: int = 1) -> int:
        with self._guard:
            self._next += n
            return self._next - n

    def _remove_orphans(self) -> None:
        """Log batches, jobs and staging folders that no commit names; what else lies there stays."""
        state = self._manifest.state
        named = {os.path.dirname(f.path) for files in state.levels for f in files} | {b.path for b in state.logs}
        found = [f"{self.path}/log/batch={n}" for n in layout.list_batches(f"{self.path}/log")]
        for top in os.listdir(self.path):
            if top == "log" or top[:1] == "L" and top[1:].isdigit():
                found += [f"{self.path}/{top}/{n}" for n in os.listdir(f"{self.path}/{top}") if n.startswith(("job=", "staging="))]
        for folder in set(found) - named:
            shutil.rmtree(folder, ignore_errors=True)

    # --- writes -------------------------------------------------------------------------------

    def put(self, key: bytes, value: bytes) -> int:
        return self.write_batch(WriteBatch().put(key, value))

    def delete(self, key: bytes) -> int:
        """A delete is written, and takes a seq, even if the key isn't there."""
        return self.write_batch(WriteBatch().delete(key))

    def write_batch(self, batch: WriteBatch) -> int:
        """Commit all or nothing; returns the batch's last seq."""
        return self.write_batches([batch])[0]

    def write_batches(self, batches: Iterable[WriteBatch]) -> list[int]:
        """Commit several batches in one; each batch's last seq.

        Other threads' batches may share the commit. A batch that is out of limits fails the call
        before anything is written, and no other's call.
        """
        batches = list(batches)
        for key, _, value in (op for b in batches for op in b.ops):
            if len(key) > MAX_KEY_LEN or value is not None and len(value) > MAX_VALUE_LEN:
                raise InvalidArgument("key or value too long")
        request = _Request(batches, sum(len(k) + len(v or b"") for b in batches for k, _, v in b.ops))
        with self._guard:
            self._ready()
            self._queue.append(request)
            if self._leading:
                self._changed.notify_all()  # the leader may be waiting for more
            else:
                self._leading = True
                request.turn.set()
        request.turn.wait()
        if not request.answer.done():  # it is the first in the queue, so it gets its answer now
            try:
                with self._writing:
                    self._lead()
            finally:
                with self._guard:
                    self._leading = bool(self._queue)
                    if self._queue:
                        self._queue[0].turn.set()
        return request.answer.result()

    def _active(self) -> list[LogBatch]:
        """Log batches that aren't frozen."""
        frozen = self._frozen[-1] if self._frozen else self._manifest.state.flushed_log
        return [b for b in self._manifest.state.logs if b.number > frozen]

    def _take(self) -> list[_Request]:
        """The requests of the next commit: the first always, more while they fit the memtable."""
        with self._guard:
            room = self.options.memtable_size - sum(b.mem_bytes for b in self._active())
            until = time.monotonic() + self.options.commit_window
            taken = [self._queue.popleft()] if self._queue else []
            size = sum(r.size for r in taken)
            while taken and len(taken) < MAX_BATCH_REQUESTS and size < room:
                if self._queue:
                    taken.append(self._queue.popleft())
                    size += taken[-1].size
                elif self._closed or (left := until - time.monotonic()) <= 0:
                    break
                else:
                    self._changed.wait(left)
            return taken

    def _lead(self) -> None:
        """One group commit. Held: ``_writing``."""
        taken = self._take()
        if not taken:
            return
        try:
            with self._guard:
                self._ready()
                seq = self._manifest.state.last_seq
            rows, acks = [], []
            for request in taken:
                acks.append([])
                for b in request.batches:
                    for key, kind, value in b.ops:
                        seq += 1
                        rows.append((key, seq, kind, value))
                    acks[-1].append(seq)
            if rows:

                def write(path: str) -> int:
                    layout.write_log_here(rows, path)
                    return sum(r.size for r in taken)

                self._commit_log(write, seq, len(rows))
        except BaseException as e:  # nobody who waits may be left without an answer
            for request in taken:
                request.fail(e if isinstance(e, Exception) else self._fail(StoreIOError(type(e).__name__)))
            if not isinstance(e, Exception):
                raise
            return
        for request, seqs in zip(taken, acks, strict=True):
            request.succeed(seqs)
        self._rotate_if_full()

    def _commit_log(self, write: Callable[[str], int], last_seq: int, n: int, stream: tuple[str, int] | None = None) -> None:
        """Write (which returns the bytes of keys and values), sync, commit. Held: ``_writing``.

        What is acknowledged is on disk, and its commit has the checksums.
        """
        number = self._allot()
        path = f"{self.path}/log/batch={number}"
        try:
            user = write(path)
            batch = LogBatch(number, last_seq, user + ENTRY_OVERHEAD * n, path, layout.seal(self.spark, path))
            records = [{"type": "logged", "batch": asdict(batch)}]
            if stream:
                records.append({"type": "stream", "name": stream[0], "batch_id": stream[1]})
            with self._guard:
                self._manifest.commit(records)
                self._stats.user_bytes += user
                self._stats.wal_bytes += user + LOG_HEADER * n
                self._stats.log_commits += 1
        except InvalidArgument:
            shutil.rmtree(path, ignore_errors=True)  # refused before its commit
            raise
        except Exception as e:
            raise self._fail(e) from e

    def write_frame(self, ops: DataFrame, *, stream: tuple[str, int] | None = None) -> int:
        """Commit a DataFrame of op_index, key, kind, value; returns the last seq.

        Later op_index gets the later seq, so a key's last operation wins; an op_index that occurs
        twice, or is null, is refused, as are keys, kinds and values out of range, before anything
        is committed. Positions are counts per range partition plus row numbers in it, never one
        task for all. ``stream`` (name, batch id) makes the commit idempotent.
        """
        with self._writing:
            with self._guard:
                self._ready()
                state = self._manifest.state
                last, seen = state.last_seq, state.streams.get(stream[0], -1) if stream else -1
            if stream and seen >= stream[1]:
                return last
            tmp = f"{self.path}/log/staging={self._allot()}"
            try:
                seq = self._write_frame(ops, tmp, last, stream)
            finally:
                shutil.rmtree(tmp, ignore_errors=True)
            self._rotate_if_full()
            return seq

    def _write_frame(self, ops: DataFrame, tmp: str, last: int, stream: tuple[str, int] | None) -> int:
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = ops.select("op_index", F.col("key").cast("binary").alias("key"), F.col("kind").cast("int").alias("kind"), F.col("value").cast("binary").alias("value"))
        rows.repartitionByRange(parts, "op_index").withColumn("part", F.spark_partition_id()).write.parquet(tmp)
        staged = self.spark.read.parquet(tmp)
        counts = sorted((r[0], r[1]) for r in staged.groupBy("part").count().collect())  # a row a partition
        if not counts:
            return last
        bases, seq = [], last
        for part, n in counts:
            bases.append((part, seq))
            seq += n
        base = F.broadcast(self.spark.createDataFrame(bases, "part int, base long"))
        order = Window.partitionBy("part").orderBy("op_index")  # equal ones are in one part
        staged = staged.withColumns({"nth": F.row_number().over(order), "twice": F.lag("op_index").over(order).eqNullSafe(F.col("op_index")) & (F.row_number().over(order) > 1)})
        bad = F.col("key").isNull() | F.col("op_index").isNull() | F.col("kind").isNull() | ~F.col("kind").isin(PUT, DELETE) | (F.col("kind") == PUT) & F.col("value").isNull()
        bad = bad | (F.octet_length("key") > MAX_KEY_LEN) | (F.coalesce(F.octet_length("value"), F.lit(0)) > MAX_VALUE_LEN)
        value = F.when(F.col("kind") == PUT, F.col("value"))
        numbered = staged.join(base, "part").select("key", (F.col("base") + F.col("nth")).alias("seq"), "kind", value.alias("value"), bad.alias("bad"), "twice")
        facts = {"user": F.sum(payload().cast("long")), "bad": F.count_if(F.coalesce("bad", F.lit(True))), "twice": F.count_if("twice")}

        def write(path: str) -> int:
            # looked at while it is written: the batch is committed only if all of it is right
            seen = Observation()
            layout.write_log(numbered.observe(seen, *[c.alias(k) for k, c in facts.items()]), path)
            found = seen.get
            if found["bad"] or found["twice"]:
                raise InvalidArgument("a key, kind or value out of range" if found["bad"] else "an op_index occurs twice")
            return found["user"]

        self._commit_log(write, seq, seq - last, stream)
        return seq

    def _freeze(self) -> None:
        """The log so far becomes one flush; without a new batch there is nothing to freeze. Held: ``_guard``."""
        if active := self._active():
            self._frozen.append(active[-1].number)
            self._changed.notify_all()

    def _rotate_if_full(self) -> None:
        """Freeze a full log, and flush it or wait while too many wait for the background. Held: ``_writing``."""
        with self._guard:
            if self._failed or sum(b.mem_bytes for b in self._active()) < self.options.memtable_size:
                return
            while self._thread and len(self._frozen) >= MAX_FROZEN and not (self._failed or self._closed):
                self._changed.wait()
            if self._failed or self._closed:
                return
            self._freeze()
        if not self._thread:
            # what was written stands and is acknowledged; a failure here fails the calls after it
            with contextlib.suppress(StoreError):
                self.maintain()

    # --- reads --------------------------------------------------------------------------------

    def snapshot(self) -> Snapshot:
        with self._guard:  # one lock for the seq and its registration: no collection in between
            self._ready()
            state = self._manifest.state
            paths = [f.path for files in state.levels for f in files] + [b.path for b in state.logs]
            found = Snapshot(self, state.last_seq, paths)
            self._snapshots[id(found)] = found
            self._seqs[found.seq()] += 1
            return found

    def _release(self, snapshot: Snapshot) -> None:
        with self._guard:
            self._snapshots.pop(id(snapshot), None)
            self._seqs[snapshot.seq()] -= 1
            self._seqs += Counter()
            if not self._closed:
                self._collect_garbage()

    def _holding(self, paths: list[str], bounds: Range) -> list[str]:
        """Of ``paths`` those whose keys may lie in the bounds; log batches always."""
        known = {f.path: f for files in self._manifest.state.levels for f in files}
        return [p for p in paths if p not in known or bounds.meets(known[p].smallest, known[p].largest)]

    def get(self, key: bytes) -> bytes | None:
        with self.snapshot() as s:
            return s.get(key)

    def scan(self, bounds: Range = Range()) -> list[tuple[bytes, bytes]]:  # noqa: B008
        """Of a range small enough for the driver; :meth:`snapshot` gives DataFrames."""
        with self.snapshot() as s:
            return [(bytes(r.key), bytes(r.value)) for r in s.scan(bounds).collect()]

    def visible_seq(self) -> int:
        return self._manifest.state.last_seq

    def oldest_snapshot(self) -> int:
        return watermark(list(self._seqs), self.visible_seq())

    # --- maintenance --------------------------------------------------------------------------

    def flush(self) -> int:
        """The log to level 0, frozen logs first; the last job's number, or the last number if none."""
        with self._guard:
            self._ready()
            self._freeze()
        done = None
        with self._work:
            while True:
                with self._guard:
                    self._ready()
                    if not self._frozen:
                        return self._next - 1 if done is None else done
                done = self._flush_oldest()

    def _sized(self, size: int) -> int:
        return max(1, -(-size // self.options.target_file_size))

    def _flush_oldest(self) -> int:
        """All versions of the oldest frozen log, as files of disjoint keys. Held: ``_work``."""
        with self._guard:
            upto = self._frozen[0]
            logs = [b for b in self._manifest.state.logs if b.number <= upto]
        number = self._allot()
        path = f"{self.path}/L0/job={number}"
        try:
            held = [f for b in logs for f in b.files]
            rows = layout.read(self.spark, [b.path for b in logs])
            layout.write_runs(rows, path, self._sized(sum(f.size for f in held)), sum(f.rows for f in held), sum(b.mem_bytes for b in logs))
            layout.sync(path)
            found = layout.describe(self.spark, path)
            with self._guard:
                files = self._numbered(found)
                self._manifest.commit([*(added(0, f) for f in files), {"type": "log_flushed", "upto": upto}, {"type": "next_number", "value": self._next}])
                self._frozen.pop(0)
                self._stats.flush_bytes += sum(f.size for f in files)
                self._stats.flush_payload += sum(f.payload for f in files)
                self._garbage.update(b.path for b in logs)
                self._changed.notify_all()
        except Exception as e:
            raise self._fail(e) from e
        self._collect_garbage()
        return number

    def _numbered(self, found: list[FileMeta]) -> list[FileMeta]:
        first = self._allot(len(found))
        return [replace(f, number=first + f.number) for f in found]

    def _run(self, plan: Plan) -> None:
        """Held: ``_work``."""
        with self._guard:
            levels = self._manifest.state.levels
            inputs = [f for level, number in plan.inputs for f in levels[level] if f.number == number]
            bottom, oldest = may_drop_deletes(levels, inputs, plan.target), self.oldest_snapshot()
        path = f"{self.path}/L{plan.target}/job={self._allot()}"
        try:
            tagged = layout.read(self.spark, [f.path for f in inputs]).withColumn("src", F.lit(0))
            rows = retain(merge_tagged(tagged).drop("src"), oldest, bottom=bottom)
            layout.write_runs(rows, path, self._sized(sum(f.size for f in inputs)), sum(f.entries for f in inputs), sum(f.payload + ENTRY_OVERHEAD * f.entries for f in inputs))
            layout.sync(path)
            found = layout.describe(self.spark, path)
            with self._guard:
                outputs = self._numbered(found)
                gone = ({"type": "deleted", "level": level, "number": n} for level, n in plan.inputs)
                self._manifest.commit([*(added(plan.target, f) for f in outputs), *gone, {"type": "next_number", "value": self._next}])
                self._stats.compaction_bytes += sum(f.size for f in outputs)
                self._stats.compaction_payload += sum(f.payload for f in outputs)
                self._garbage.update(f.path for f in inputs)
                self._changed.notify_all()
        except Exception as e:
            raise self._fail(e) from e
        self._collect_garbage()

    def _plan(self) -> Plan | None:
        with self._guard:
            self._ready()
            return pick(self._manifest.state.levels, self.options)

    def maintain(self) -> None:
        """Flush, then all rewrites that sizes call for."""
        self.flush()
        with self._work:
            while plan := self._plan():
                self._run(plan)

    def compact(self) -> None:
        """Everything to the last level, in one rewrite. What a reader sees doesn't change."""
        self.flush()
        with self._work:
            with self._guard:
                self._ready()
                levels, last = self._manifest.state.levels, self.options.max_levels - 1
                upper = [(n, f) for n, files in enumerate(levels[:last]) for f in files]
                if not upper:
                    return
                lo, hi = hull([f for _, f in upper])
                below = overlapping(levels[last] if len(levels) > last else [], lo, hi)
            self._run(Plan(tuple((n, f.number) for n, f in upper) + tuple((last, f.number) for f in below), last))

    def _background(self) -> None:
        """Frozen logs oldest first, then rewrites, until the store is closed or fails."""
        while True:
            with self._guard:
                while not (self._closed or self._failed or self._frozen or pick(self._manifest.state.levels, self.options)):
                    self._changed.wait()
                if self._closed or self._failed:
                    return
                self._busy = True
            with contextlib.suppress(StoreError), self._work:
                if self._frozen:
                    self._flush_oldest()
                elif plan := self._plan():
                    self._run(plan)
            with self._guard:
                self._busy = False
                self._changed.notify_all()

    def wait_idle(self, timeout: float | None = None) -> bool:
        """Until the background has nothing to do; whether it has come to that."""
        with self._guard:
            return self._changed.wait_for(lambda: bool(self._failed or self._closed) or self._idle(), timeout)

    def _idle(self) -> bool:
        return not (self._frozen or self._busy or pick(self._manifest.state.levels, self.options))

    def verify(self) -> int:
        """Check the order of all sorted files and the bytes of the log; how many files there are."""
        with self.snapshot():
            with self._guard:
                files = [f for level in self._manifest.state.levels for f in level]
                logs = list(self._manifest.state.logs)
            for f in files:
                layout.validate(f)
            layout.validate_logs(self.spark, logs)
            if files and (bad := layout.out_of_order(self.spark, [f.path for f in files]).first()):
                raise DataFileCorrupt(f"{bad.file}: row {bad.row_index} is out of order")
            return len(files) + sum(len(b.files) for b in logs)

    def _collect_garbage(self, *, everything: bool = False) -> None:
        with self._guard:
            held = set() if everything else {p for s in self._snapshots.values() for p in s._paths}
            free = [p for p in self._garbage if p not in held]
            self._garbage.difference_update(free)
        for path in free:
            shutil.rmtree(path, ignore_errors=True) if os.path.isdir(path) else os.path.exists(path) and os.remove(path)
            folder = os.path.dirname(path)
            if os.path.basename(folder).startswith("job=") and os.path.isdir(folder) and not any(f.endswith(".parquet") and not f.startswith(".") for f in os.listdir(folder)):
                shutil.rmtree(folder, ignore_errors=True)

    def stats(self) -> Stats:
        with self._guard:
            self._ready()
            state = self._manifest.state
            self._stats.level_files = [len(files) for files in state.levels]
            self._stats.level_bytes = [sum(f.size for f in files) for files in state.levels]
            self._stats.memtable_bytes = sum(b.mem_bytes for b in state.logs)
            self._stats.background_idle = self._idle()
            return Stats(**asdict(self._stats))

    def files(self) -> list[list[FileMeta]]:
        return [list(files) for files in self._manifest.state.levels]
