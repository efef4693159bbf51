"""A scripted run of the job queue: enqueue, work, crash, recover, report, compact.

``python -m tidemark.demo [folder]`` prints what each step found as JSON lines.
"""

from __future__ import annotations

import json
import shutil
import sys
import tempfile
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession

from .jobs import JobStore, stats_view
from .options import Options
from .store import Store

JOBS = 60


def run(spark: SparkSession, folder: str, jobs: int = JOBS) -> Iterator[tuple[str, Any]]:
    """Name and finding of each step. Times are made up: nothing here waits."""
    options = Options(memtable_size=256 << 10)
    store = Store.open(spark, f"{folder}/queue", options)
    queue = JobStore(store)
    queue.enqueue_many([("email", {"n": n}) for n in range(jobs)], now=0, max_attempts=2)
    yield "enqueued", queue.report()["counts"]

    for turn in range(4):  # two done, one failed, one left running
        job = queue.claim(lease_ms=100, now=10)
        if turn < 2:
            queue.complete(job.id, job.claim_token, now=20)
        elif turn == 2:
            queue.fail(job.id, job.claim_token, "no route", now=20)
    yield "worked", queue.report()["counts"]

    with store.snapshot() as before:
        requeued = queue.requeue_expired(now=110)
        yield "swept", {"requeued": requeued, "then": queue.report(before)["counts"], "now": queue.report()["counts"]}
    store.close()  # as after a crash: the log is all there is of most of this

    store = Store.open(spark, f"{folder}/queue", options)
    queue = JobStore(store)
    yield "recovered", queue.report()["counts"]
    yield "purged", queue.purge("done", older_than=21)
    first, last = queue.maintenance()
    yield "compacted", {"before": stats_view(first), "after": stats_view(last)}
    yield "exported", queue.export(f"{folder}/export")
    store.close()


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else tempfile.mkdtemp(prefix="tidemark-demo-")
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    for step, found in run(spark, folder):
        print(json.dumps({step: found}))
    spark.stop()
    if len(sys.argv) < 2:
        shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
