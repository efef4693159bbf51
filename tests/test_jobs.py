"""The job queue."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark import demo
from tidemark import jobs as J
from tidemark.options import Options
from tidemark.store import Store


@pytest.fixture
def queue(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "jobs"), Options(memtable_size=1 << 30)) as s:
        yield J.JobStore(s)


def status_of(queue):
    with queue.store.snapshot() as s:
        return {r.id: r.status for r in queue.records(s).collect()}


def consistent(queue):
    with queue.store.snapshot() as s:
        return tuple(J.inconsistent(queue.index(s), queue.records(s)).first()) == (0, 0)


def test_lifecycle(queue):
    assert queue.claim(10, 0) is None
    queue.enqueue_many([("email", {"n": i, "t": [1.5, None, "é"]}) for i in range(3)], 5)
    job = queue.claim(100, 1000)
    assert (job.id, job.status, job.claim_token, job.lease_until) == (1, "running", 1, 1100)
    with pytest.raises(J.LeaseLost):
        queue.complete(1, 99, 1001)
    with pytest.raises(J.NotFound):
        queue.complete(77, 1, 1001)
    assert queue.complete(1, 1, 1001).status == "done"
    with pytest.raises(J.InvalidState):
        queue.fail(1, 1, "late", 1002)
    assert queue.get(1).payload == {"n": 0, "t": [1.5, None, "é"]} and queue.get(9) is None
    assert [j.id for j in queue.list("pending")] == [2, 3] and [j.id for j in queue.list("pending", 1)] == [2]
    assert consistent(queue)


def test_fail_until_dead(queue):
    queue.enqueue("x", {}, 0, max_attempts=2)
    first = queue.claim(10, 1)
    assert queue.fail(1, first.claim_token, "e1", 2).status == "pending"
    second = queue.claim(10, 3)
    assert second.claim_token == 2 and queue.fail(1, 2, "e2", 4).status == "dead"
    assert queue.claim(10, 5) is None and queue.get(1).last_error == "e2" and consistent(queue)


def test_requeue_expired(queue):
    queue.enqueue_many([("x", {"deep": {"a": [1, {"b": "c"}]}}), ("x", None)], 0)
    queue.claim(100, 1000)
    assert queue.requeue_expired(1050) == 0 and queue.requeue_expired(1100) == 1
    job = queue.get(1)
    assert (job.status, job.attempts, job.last_error, job.lease_until, job.claim_token) == ("pending", 1, "lease expired", None, 1)
    assert job.payload == {"deep": {"a": [1, {"b": "c"}]}} and consistent(queue)
    with pytest.raises(J.LeaseLost):
        queue.complete(1, 0, 1101)


def test_report_on_a_snapshot(queue):
    queue.enqueue_many([("x", {})] * 20, 0)
    with queue.store.snapshot() as old:
        queue.enqueue_many([("x", {})] * 20, 0)
        queue.claim(10, 0)
        then, now = queue.report(old), queue.report()
    assert then["counts"] == {"pending": 20, "running": 0, "done": 0, "dead": 0} and then["oldest_pending"].id == 1
    assert now["counts"] == {"pending": 39, "running": 1, "done": 0, "dead": 0} and now["oldest_pending"].id == 2


def test_purge_export_maintenance(queue, tmp_path):
    queue.enqueue_many([("x", {"n": i}) for i in range(6)], 0)
    for _ in range(3):
        job = queue.claim(10, 10)
        queue.complete(job.id, job.claim_token, 30)
    assert queue.purge("done", 30) == 0 and queue.purge("done", 31) == 3
    assert status_of(queue) == {4: "pending", 5: "pending", 6: "pending"} and consistent(queue)
    assert queue.export(str(tmp_path / "out")) == 3
    lines = [json.loads(r.value)["id"] for r in queue.store.spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == [4, 5, 6]
    before, after = queue.maintenance()
    assert after.memtable_bytes == 0 and after.compaction_bytes >= before.compaction_bytes and consistent(queue)


def test_one_rule_for_one_job_and_for_many(spark):
    """Columns and values give the same record after each event."""
    rows = [J.Job(i, "k", None, "running", i % 4, 1 + i % 3, i, 50 + i, 1, 2, None if i % 2 else "old") for i in range(12)]
    df = spark.createDataFrame([tuple({**vars(j), "payload": "null"}.values()) for j in rows], J.RECORD)
    for event, options in (("claim", {"lease_ms": 7}), ("complete", {}), ("fail", {"error": "e"})):
        got = {r.id: r.asDict() for r in J.applied(df, event, 99, **options).collect()}
        for j in rows:
            want = vars(j) | {"payload": "null"} | J.changed(event, vars(j), 99, **options)
            assert got[j.id] == want
    assert J.changed("claim", vars(rows[0]), J.U64_MAX, lease_ms=5)["lease_until"] == J.U64_MAX


def test_bulk_load_and_export(spark, queue, tmp_path):
    """Loaded jobs are as if enqueued one by one, and are exported in id order."""
    df = spark.range(1, 41).select("id", F.lit("mail").alias("kind"), F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit(',"s":"é"}')).alias("payload"), F.when(F.col("id") % 2 == 0, "pending").otherwise("done").alias("status"), F.lit(0).alias("attempts"), F.lit(3).alias("max_attempts"), F.lit(0).cast("long").alias("claim_token"), F.lit(None).cast("long").alias("lease_until"), F.lit(1).cast("long").alias("created_at"), F.lit(1).cast("long").alias("updated_at"), F.lit(None).cast("string").alias("last_error"))
    assert queue.load(df) == 40 and queue.load(df.limit(0)) == 0 and consistent(queue)
    assert queue.get(7) == J.Job(7, "mail", {"n": 7, "s": "é"}, "done", created_at=1, updated_at=1) and queue.enqueue("x", {}, 5).id == 41
    assert queue.claim(10, 10).id == 2 and queue.requeue_expired(20) == 1
    assert queue.export(str(tmp_path / "out")) == 41
    lines = [json.loads(line) for part in sorted((tmp_path / "out").glob("part-*")) for line in part.read_text().splitlines()]
    assert [r["id"] for r in lines] == list(range(1, 42)) and list(lines[0]) == list(vars(J.Job(1, "", None)))


def test_unknown_status_is_refused(queue):
    assert [J.parse_status(s) for s in ("pending", "running", "done", "dead")] == list(J.STATUSES)
    for call in (lambda: J.parse_status("Done"), lambda: queue.list("gone"), lambda: queue.purge("", 1)):
        with pytest.raises(ValueError, match="unknown status"):
            call()


def test_stats_view(queue):
    queue.enqueue("x", {}, 0)
    queue.store.flush()
    view = json.loads(json.dumps(J.stats_view(queue.store.stats())))
    assert view["disk_bytes"] == view["flush_bytes"] > 0 and view["write_amplification"] > 1 and view["level_files"] == [1] and view["background_idle"]


def test_sweeper(queue):
    import threading

    queue.enqueue("x", {}, 0)
    queue.claim(10, 0)
    stop = threading.Event()

    def clock():
        stop.set()
        return 10

    assert queue.sweep(stop, clock, every=0.01) == 1 and queue.get(1).status == "pending"


def test_too_large_takes_no_id(queue):
    with pytest.raises(J.PayloadTooLarge):
        queue.enqueue("x", "y" * J.MAX_RECORD_BYTES, 0)
    assert queue.enqueue("x", {}, 0).id == 1


def test_demo(spark, tmp_path):
    found = dict(demo.run(spark, str(tmp_path), jobs=9))
    assert found["enqueued"]["pending"] == 9 and found["worked"] == {"pending": 6, "running": 1, "done": 2, "dead": 0}
    assert found["swept"]["requeued"] == 1 and found["swept"]["then"] == found["worked"]
    assert found["recovered"] == found["swept"]["now"] == {"pending": 6, "running": 0, "done": 2, "dead": 1}  # it had failed before
    assert found["purged"] == 2 and found["exported"] == 7 and found["compacted"]["after"]["memtable_bytes"] == 0
