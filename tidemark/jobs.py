"""A durable job queue on a store: records, a status index, and reports on snapshots.

What an event does to a job is said once, by :func:`changed`, over columns or over one record's
values. Many jobs change by a DataFrame transform, one by a read-modify-write under a lock; either
is written as one atomic batch.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Mapping
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .functions.keys import INDEX, JOB, NEXT_ID, STATUSES, job_key, job_key_bytes, status_key, status_key_bytes
from .operators.bounds import prefix_range
from .operators.oplog import DELETE, PUT
from .store import Snapshot, Stats, Store, WriteBatch

#: Fixed values.
MAX_RECORD_BYTES = 64 << 10
DEFAULT_ATTEMPTS = 3
LIST_LIMIT = 1000
DEFAULT_LIST = 50
DEFAULT_LEASE_MS = 30_000
SWEEP_SECONDS = 5.0
U64_MAX = (1 << 64) - 1
LONG_MAX = (1 << 63) - 1
LEASE_EXPIRED = "lease expired"

RECORD = (
    "id long, kind string, payload string, status string, attempts int, max_attempts int, claim_token long, "
    "lease_until long, created_at long, updated_at long, last_error string"
)


class JobError(Exception):
    """Base of what a job call can fail with."""


class NotFound(JobError):
    pass


class LeaseLost(JobError):
    pass


class InvalidState(JobError):
    pass


class PayloadTooLarge(JobError):
    pass


def parse_status(text: str) -> str:
    """One of the four names, as it is written; anything else is an error."""
    if text not in STATUSES:
        raise ValueError(f"unknown status {text!r}: not one of {', '.join(STATUSES)}")
    return text


@dataclass
class Job:
    id: int
    kind: str
    payload: Any
    status: str = "pending"
    attempts: int = 0
    max_attempts: int = DEFAULT_ATTEMPTS
    claim_token: int = 0
    lease_until: int | None = None
    created_at: int = 0
    updated_at: int = 0
    last_error: str | None = None

    def encode(self) -> bytes:
        return json.dumps(asdict(self), separators=(",", ":")).encode()

    @staticmethod
    def decode(raw: bytes) -> Job:
        return Job(**json.loads(raw))


# --- transitions, of one job or of many ----------------------------------------------------------


def _choose(test: Any, then: Any, other: Any) -> Any:
    return F.when(test, then).otherwise(other) if isinstance(test, Column) else then if test else other


def _least(a: Any, b: Any) -> Any:
    return F.least(a, F.lit(b)) if isinstance(a, Column) else min(a, b)


def changed(event: str, job: Mapping[str, Any], now: Any, *, lease_ms: int = DEFAULT_LEASE_MS, error: str | None = None) -> dict[str, Any]:
    """The fields that an event (claim, complete or fail) changes; ``job`` holds values or columns.

    A claim gives the next token and a lease. A failure is one more attempt: dead once attempts
    reach their maximum, else pending again.
    """
    if event == "claim":
        most = LONG_MAX if isinstance(job["id"], Column) else U64_MAX  # what a column, or the record, can hold
        return {"status": "running", "claim_token": job["claim_token"] + 1, "lease_until": _least(now + lease_ms, most), "updated_at": now}
    if event == "complete":
        return {"status": "done", "lease_until": None, "updated_at": now}
    tried = job["attempts"] + 1
    return {"attempts": tried, "status": _choose(tried >= job["max_attempts"], "dead", "pending"), "lease_until": None, "last_error": error, "updated_at": now}


def applied(jobs: DataFrame, event: str, now: int | Column, **options: Any) -> DataFrame:
    """``jobs`` after the event, all columns kept."""
    now = F.lit(now).cast("long") if isinstance(now, int) else now
    found = changed(event, {c: F.col(c) for c in jobs.columns}, now, **options)
    typed = {"lease_until": "long", "last_error": "string"}
    return jobs.withColumns({k: (v if isinstance(v, Column) else F.lit(v)).cast(typed[k]) if k in typed else v if isinstance(v, Column) else F.lit(v) for k, v in found.items()})


def failed(jobs: DataFrame, now: int | Column, error: str) -> DataFrame:
    return applied(jobs, "fail", now, error=error)


def expired(jobs: DataFrame, now: int) -> DataFrame:
    """Running jobs whose lease ended at ``now`` or before; without a lease none has."""
    return jobs.filter((F.col("status") == "running") & (F.col("lease_until") <= now))


def purgeable(jobs: DataFrame, status: str, older_than: int) -> DataFrame:
    return jobs.filter((F.col("status") == status) & (F.col("updated_at") < older_than))


def moves(jobs: DataFrame, before: Column, record: Column) -> DataFrame:
    """id, op, key, value: out of the old index entry, into the new one, and the record."""
    steps = F.array(
        F.struct(F.lit("delete").alias("op"), status_key(before, F.col("id")).alias("key"), F.lit(None).cast("string").alias("value")),
        F.struct(F.lit("put").alias("op"), status_key(F.col("status"), F.col("id")).alias("key"), F.lit("").alias("value")),
        F.struct(F.lit("put").alias("op"), job_key(F.col("id")).alias("key"), record.alias("value")),
    )
    return jobs.select("id", F.explode(steps).alias("s")).select("id", "s.op", "s.key", "s.value")


def status_report(jobs: DataFrame) -> DataFrame:
    """status, n for all statuses, 0 where there is none."""
    all_ = jobs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return all_.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def oldest(jobs: DataFrame, status: str = "pending") -> DataFrame:
    return jobs.filter(F.col("status") == status).agg(F.min("id").alias("id"))


def listed(index: DataFrame, jobs: DataFrame, status: str, limit: int = DEFAULT_LIST) -> DataFrame:
    """The first jobs of a status by id: the limit goes on the index, then records join."""
    first = index.filter(F.col("status") == status).orderBy("id").limit(min(limit, LIST_LIMIT)).select("id")
    return jobs.join(F.broadcast(first), "id").filter(F.col("status") == status)  # at most LIST_LIMIT ids


def inconsistent(index: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: records without their index entry, and entries without their record."""
    on = ["id", "status"]
    missing = jobs.select(*on).join(index.select(*on), on, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    orphan = index.select(*on).join(jobs.select(*on), on, "left_anti").agg(F.count(F.lit(1)).alias("orphan"))
    return missing.join(F.broadcast(orphan))


# --- the queue ---------------------------------------------------------------------------------


class JobStore:
    def __init__(self, store: Store) -> None:
        self.store = store
        self._write = threading.RLock()

    def _next_id(self) -> int:
        raw = self.store.get(NEXT_ID.encode())
        return int.from_bytes(raw, "big") if raw else 1

    def enqueue(self, kind: str, payload: Any, now: int, *, max_attempts: int | None = None) -> Job:
        return self.enqueue_many([(kind, payload)], now, max_attempts=max_attempts)[0]

    def enqueue_many(self, new: list[tuple[str, Any]], now: int, *, max_attempts: int | None = None) -> list[Job]:
        """One atomic batch; ids are dense, and a rejected record takes none."""
        with self._write:
            first = self._next_id()
            tries = max(1, DEFAULT_ATTEMPTS if max_attempts is None else max_attempts)
            jobs = [Job(first + i, k, p, max_attempts=tries, created_at=now, updated_at=now) for i, (k, p) in enumerate(new)]
            batch = WriteBatch()
            for job in jobs:
                raw = job.encode()
                if len(raw) > MAX_RECORD_BYTES:
                    raise PayloadTooLarge(f"{len(raw)} bytes; at most {MAX_RECORD_BYTES}")
                batch.put(job_key_bytes(job.id), raw).put(status_key_bytes("pending", job.id), b"")
            if jobs:
                self.store.write_batch(batch.put(NEXT_ID.encode(), (first + len(jobs)).to_bytes(8, "big")))
            return jobs

    def get(self, id_: int) -> Job | None:
        raw = self.store.get(job_key_bytes(id_))
        return Job.decode(raw) if raw is not None else None

    def _move(self, job: Job, event: str, now: int, **options: Any) -> Job:
        """Apply the event: record and index entry in one batch."""
        after = replace(job, **changed(event, asdict(job), now, **options))
        batch = WriteBatch().delete(status_key_bytes(job.status, job.id)).put(status_key_bytes(after.status, job.id), b"")
        self.store.write_batch(batch.put(job_key_bytes(job.id), after.encode()))
        return after

    def _finish(self, id_: int, token: int, event: str, now: int, **options: Any) -> Job:
        """Only the holder of the latest claim may, and only while the job runs.

        In this order: the job must be there, under that claim, and running.
        """
        with self._write:
            job = self.get(id_)
            found = NotFound(id_) if job is None else LeaseLost(id_) if job.claim_token != token else None
            if found is None and job.status != "running":
                found = InvalidState(f"{id_} is {job.status}")
            if found:
                raise found
            return self._move(job, event, now, **options)

    def claim(self, lease_ms: int, now: int) -> Job | None:
        """The pending job of the lowest id becomes running under a new token."""
        with self._write, self.store.snapshot() as s:
            head = s.scan(prefix_range(f"{INDEX}pending/".encode())).select("key").first()
            if head is None:
                return None
            id_ = int(bytes(head.key)[-16:], 16)
            raw = s.get(job_key_bytes(id_))
            if raw is None:
                raise NotFound(id_)
            return self._move(Job.decode(raw), "claim", now, lease_ms=lease_ms)

    def complete(self, id_: int, token: int, now: int) -> Job:
        return self._finish(id_, token, "complete", now)

    def fail(self, id_: int, token: int, error: str, now: int) -> Job:
        return self._finish(id_, token, "fail", now, error=error)

    def load(self, jobs: DataFrame) -> int:
        """Bulk load of columns as in ``RECORD`` (payload is JSON text): records, index and the next id.

        One atomic batch; ids must be new. Returns how many.
        """
        with self._write:
            puts = F.array(
                F.struct(job_key(F.col("id")).cast("binary").alias("key"), record().cast("binary").alias("value")),
                F.struct(status_key(F.col("status"), F.col("id")).cast("binary").alias("key"), F.lit(b"").alias("value")),
            )
            rows = jobs.select("id", F.posexplode(puts).alias("n", "put")).select(F.struct("id", "n").alias("op_index"), "put.key", "put.value")
            n, top = jobs.agg(F.count(F.lit(1)), F.max("id")).first()
            if not n:
                return 0
            after = max(self._next_id(), top + 1).to_bytes(8, "big")
            last = jobs.sparkSession.range(1).select(F.struct((F.lit(top) + 1).cast("long").alias("id"), F.lit(0).alias("n")).alias("op_index"), F.lit(NEXT_ID.encode()).alias("key"), F.lit(after).alias("value"))
            self.store.write_frame(rows.union(last).withColumn("kind", F.lit(PUT)))
            return n

    def records(self, snapshot: Snapshot) -> DataFrame:
        """All records as columns; payload is its JSON text."""
        rows = snapshot.scan(prefix_range(b"job/"))
        raw = F.col("value").cast("string")
        return rows.select(F.from_json(raw, RECORD).alias("j"), raw.alias("record")).select("j.*", "record")

    def index(self, snapshot: Snapshot) -> DataFrame:
        key = F.split(F.col("key").cast("string"), "/")
        return snapshot.scan(prefix_range(b"idx/status/")).select(key[2].alias("status"), F.conv(key[3], 16, 10).cast("long").alias("id"))

    def requeue_expired(self, now: int) -> int:
        """All expired leases count as failed attempts, in one batch. Returns how many."""
        with self._write, self.store.snapshot() as s:
            rows = failed(expired(self.records(s), now), now, LEASE_EXPIRED)
            return self._write_moves(moves(rows.withColumn("payload", _payload()), F.lit("running"), record()))

    def _write_moves(self, ops: DataFrame) -> int:
        ops = ops.withColumn("op_index", F.struct("id", F.when(F.col("op") == "delete", 0).otherwise(1), "key"))
        frame = ops.select("op_index", "key", F.when(F.col("op") == "put", PUT).otherwise(DELETE).alias("kind"), F.when(F.col("op") == "put", F.coalesce("value", F.lit(""))).alias("value"))
        before = self.store.visible_seq()
        return (self.store.write_frame(frame) - before) // 3

    def list(self, status: str, limit: int = DEFAULT_LIST) -> list[Job]:
        parse_status(status)
        with self.store.snapshot() as s:
            rows = listed(self.index(s), self.records(s), status, limit).orderBy("id").collect()
            return [Job.decode(r.record.encode()) for r in rows]

    def report(self, snapshot: Snapshot | None = None) -> dict:
        """counts of all statuses and the oldest pending job, on one snapshot."""
        own = snapshot or self.store.snapshot()
        try:
            rows = self.records(own)
            counts = {r.status: r.n for r in status_report(rows).collect()}
            least = oldest(rows).first().id
            found = rows.filter(F.col("id") == least).first() if least is not None else None
            return {"counts": counts, "oldest_pending": Job.decode(found.record.encode()) if found else None, "seq": own.seq()}
        finally:
            if snapshot is None:
                own.release()

    def export(self, path: str) -> int:
        """One JSON record a line, in id order over the files as they are named; returns how many."""
        with self.store.snapshot() as s:
            rows = s.scan(prefix_range(JOB.encode())).select(F.col("value").cast("string").alias("value"))
            seen = Observation()
            rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path)
            return seen.get["n"]

    def sweep(self, stop: threading.Event, clock, every: float = SWEEP_SECONDS) -> int:
        """Requeue expired leases now and then until ``stop`` is set; how many in all."""
        total = 0
        while not stop.wait(every):
            total += self.requeue_expired(clock())
        return total

    def purge(self, status: str, older_than: int) -> int:
        """Delete record and index entry of old jobs, all in one batch."""
        parse_status(status)
        with self._write, self.store.snapshot() as s:
            rows = purgeable(self.records(s), status, older_than)
            keys = rows.select("id", F.explode(F.array(job_key(F.col("id")), status_key(F.col("status"), F.col("id")))).alias("key"))
            before = self.store.visible_seq()
            after = self.store.write_frame(keys.select(F.struct("id", "key").alias("op_index"), "key", F.lit(DELETE).alias("kind"), F.lit(None).cast("string").alias("value")))
            return (after - before) // 2

    def maintenance(self) -> tuple[Stats, Stats]:
        """Statistics before and after a flush and a full compaction."""
        before = self.store.stats()
        self.store.flush()
        self.store.compact()
        return before, self.store.stats()


def record() -> Column:
    """The JSON of a job's columns, as :meth:`Job.encode` writes it. The payload is JSON text already."""
    plain = lambda names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    head, tail = plain(["id", "kind"]), plain(["status", "attempts", "max_attempts", "claim_token", "lease_until", "created_at", "updated_at", "last_error"])
    inside = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)
    return F.concat(F.lit("{"), inside(head), F.lit(',"payload":'), F.coalesce("payload", F.lit("null")), F.lit(","), inside(tail), F.lit("}"))


def _payload() -> Column:
    """The payload's JSON as the record has it."""
    return F.coalesce(F.to_json(F.variant_get(F.parse_json("record"), "$.payload", "variant")), F.lit("null"))


def stats_view(stats: Stats) -> dict[str, Any]:
    """Statistics as plain values, ready for JSON."""
    plain = asdict(stats)
    return plain | {"disk_bytes": stats.flush_bytes + stats.compaction_bytes, "write_amplification": stats.write_amplification()}
