"""The store end to end."""

import os
import random
import subprocess
import sys
import textwrap
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.errors import DataFileCorrupt, InvalidArgument, StoreClosed, StoreIOError, StoreLocked, StorePoisoned
from tidemark.operators import asof as reads
from tidemark.operators.bounds import Range, prefix_range
from tidemark.options import MAX_KEY_LEN, Options
from tidemark.plans.manifest import CHECKPOINT_EVERY, Manifest
from tidemark.sources import layout
from tidemark.store import Store, WriteBatch
from tidemark.streaming import ingest
from tidemark.workload import Zipf, random_ops, requests

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = Options(memtable_size=1 << 30, l1_max_bytes=1 << 14, target_file_size=1 << 15)


def batch_of(puts, deletes=()):
    batch = WriteBatch()
    for k, v in puts.items():
        batch.put(k, v)
    for k in deletes:
        batch.delete(k)
    return batch


@pytest.fixture
def store(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "db"), SMALL) as s:
        yield s


def test_basics(store):
    assert store.get(b"a") is None
    assert store.put(b"a", b"1") == 1 and store.delete(b"zz") == 2
    assert store.write_batch(WriteBatch().put(b"a", b"2").put(b"b", b"").delete(b"a").put(b"", b"")) == 6
    assert store.write_batch(WriteBatch()) == 6 and WriteBatch().is_empty() and len(WriteBatch().put(b"", b"")) == 1
    assert store.get(b"a") is None and store.get(b"b") == b"" and store.get(b"") == b""
    assert store.scan() == [(b"", b""), (b"b", b"")]
    with pytest.raises(InvalidArgument):
        store.write_batches([WriteBatch().put(b"ok", b""), WriteBatch().put(b"x" * (MAX_KEY_LEN + 1), b"")])
    assert store.visible_seq() == 6 and store.get(b"ok") is None
    assert store.write_batches([WriteBatch().put(b"x", b""), WriteBatch(), WriteBatch().put(b"y", b"")]) == [7, 7, 8]


def test_atomic_batch_between_snapshots(store):
    store.put(b"d", b"old")
    before = store.snapshot()
    store.write_batch(WriteBatch().put(b"a", b"1").put(b"b", b"2").delete(b"d"))
    after = store.snapshot()
    assert [bytes(r.key) for r in before.scan().collect()] == [b"d"] and [bytes(r.key) for r in after.scan().collect()] == [b"a", b"b"]
    before.release(), after.release(), after.release()


def test_old_reader_and_a_rewrite(store):
    """A reader from before keeps its view through a rewrite; without readers only live rows stay."""
    first = {f"item/{i * 37 % 101:03}".encode(): f"first {i}".encode() for i in range(101)}
    store.write_batch(batch_of(first))
    store.flush()
    gone, changed = sorted(first)[10:50], sorted(first)[40:90:2]
    with store.snapshot() as old:
        store.write_batch(batch_of({k: b"second" for k in changed}, gone))
        store.compact()
        assert {bytes(r.key): bytes(r.value) for r in old.scan().collect()} == first
        assert store.oldest_snapshot() == len(first)
        now = {k: v for k, v in (first | dict.fromkeys(changed, b"second")).items() if k not in gone}
        assert dict(store.scan()) == now
        stats = store.stats()
        assert stats.memtable_bytes == 0 and not any(stats.level_files[:-1]) and stats.write_amplification() > 1
    assert store.oldest_snapshot() == store.visible_seq()
    lo, hi = min(first), max(first)
    store.write_batch(batch_of({lo: b"", hi: b""}))  # meets all files below
    store.compact()
    files = [f for level in store.files() for f in level]
    assert sum(f.entries for f in files) == len(now | {lo: b"", hi: b""}) and store.verify() == len(files)
    on_disk = {os.path.join(d, x) for d, _, names in os.walk(store.path) for x in names if x.endswith(".parquet")}
    assert on_disk == {f.path for f in files}


def test_model(spark, tmp_path):
    """Random batches with flushes, compactions and reopening against a dict."""
    rnd, model, path = random.Random(42), {}, str(tmp_path / "m")
    store = Store.open(spark, path, SMALL)
    for round_ in range(5):
        batch = WriteBatch()
        for _ in range(200):
            key = f"key-{rnd.randrange(80):05}".encode()
            if rnd.randrange(5) == 0:
                model.pop(key, None)
                batch.delete(key)
            else:
                model[key] = f"val-{rnd.random()}".encode()
                batch.put(key, model[key])
        store.write_batch(batch)
        if round_ % 2:
            store.flush()
        if round_ == 2:
            store.maintain()
        if round_ == 3:
            store.compact()
            store.close()
            store = Store.open(spark, path, SMALL)
            assert store.stats().user_bytes == 0  # counters are of this opening
        assert store.scan() == sorted(model.items())
    levels = store.files()
    for files in levels[1:]:
        assert all(a.largest < b.smallest for a, b in zip(files, files[1:], strict=False))
    store.close()
    with pytest.raises(StoreClosed):
        store.put(b"", b"")
    store.close()


def test_write_frame(spark, store):
    ops = random_ops(spark, 3000, 200)
    assert store.write_frame(ops) == 3000
    model = {}
    for r in ops.orderBy("op_index").collect():
        model.pop(bytes(r.key), None)
        if r.kind:
            model[bytes(r.key)] = bytes(r.value)
    assert dict(store.scan()) == model
    log = store.snapshot().log()
    assert log.agg(F.count_distinct("seq"), F.min("seq"), F.max("seq")).first()[:] == (3000, 1, 3000)
    got = store.scan(prefix_range(b"key-0001"))
    assert got == sorted((k, v) for k, v in model.items() if k.startswith(b"key-0001"))
    with pytest.raises(InvalidArgument):
        store.write_frame(spark.createDataFrame([(0, None, 1, "x")], "op_index long, key string, kind int, value string"))
    with pytest.raises(InvalidArgument):
        store.write_frame(spark.createDataFrame([(0, "a", 1, None)], "op_index long, key string, kind int, value string"))
    twice = spark.createDataFrame([(7, "a", 1, "x"), (8, "b", 1, "x"), (7, "c", 1, "x")], "op_index long, key string, kind int, value string")
    with pytest.raises(InvalidArgument, match="twice"):
        store.write_frame(twice)
    with pytest.raises(InvalidArgument):
        store.write_frame(twice.select(F.lit(None).cast("long").alias("op_index"), "key", "kind", "value").limit(1))
    assert store.write_frame(ops.limit(0)) == 3000 and len(os.listdir(f"{store.path}/log")) == 1


def test_levels_are_disjoint_and_pruned(spark, store):
    ops = spark.range(2_000).select(F.col("id").alias("op_index"), F.format_string("k%06d", "id").cast("binary").alias("key"), F.lit(1).alias("kind"), F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("value"))
    store.write_frame(ops)
    store.compact()
    files = store.files()[-1]
    assert len(files) > 2 and all(a.largest < b.smallest for a, b in zip(files, files[1:], strict=False))
    paths = [f.path for f in files]
    assert len(store._holding(paths, Range(b"k000100", b"k000101"))) == 1
    assert store.get(b"k000100") is not None and len(store.scan(Range(b"k000100", b"k000110"))) == 10


def _rows_scanned(df):
    """Rows that the scan gave, after row groups were skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_bloom_filter_skips_absent_keys(spark, tmp_path):
    """A key between a file's smallest and largest that isn't in it: no row is read."""
    path = str(tmp_path / "runs")
    rows = spark.range(5_000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("key"), F.lit(1).cast("long").alias("seq"), F.lit(1).alias("kind"), F.lit(b"").alias("value"))
    layout.write_runs(rows, path, 1, 5_000)
    there, absent = bytes(rows.first().key), b"7" * 64
    plain = spark.read.option("parquet.filter.dictionary.enabled", "false").option("parquet.filter.columnindex.enabled", "false").parquet(path)
    with_filter = lambda key: plain.filter(F.col("key") == F.lit(bytearray(key)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert _rows_scanned(with_filter(absent)) == 0 and _rows_scanned(with_filter(there)) == 5_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_no_task_sorts_a_whole_file(spark, tmp_path, monkeypatch):
    """One file by its target size, half of it one key's versions: sorted in ranges by many tasks."""
    monkeypatch.setattr(layout, "SORT_BYTES", 1 << 14, raising=False)
    sorts, own = [], type(spark.range(0)).sortWithinPartitions
    monkeypatch.setattr(type(spark.range(0)), "sortWithinPartitions", lambda self, *c, **b: sorts.append(self) or own(self, *c, **b))
    ops = random_ops(spark, 6_000, 500).withColumn("key", F.when(F.col("op_index") % 2 == 0, F.lit(b"key-00250")).otherwise(F.col("key")))
    with Store.open(spark, str(tmp_path / "one"), Options(memtable_size=1 << 40, target_file_size=1 << 40)) as s:
        s.write_frame(ops)
        held = s.snapshot()  # the log's files stay, for the counts below
        before = sorted(map(tuple, held.log().collect()))
        s.flush()
        [file] = s.files()[0]
        assert sorted(map(tuple, s.snapshot().log().collect())) == before and s.verify() == 1
        largest = sorts[0].groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert largest < 0.4 * 6_000
        want = {bytes(r.key): bytes(r.value) for r in held.view().collect()}
        held.release()
        s.compact()
        assert len(s.files()[-1]) == 1 and s.verify() == 1 and dict(s.scan()) == want
        assert not [n for n in os.listdir(s.path + "/L0") if n.startswith("staging=")] and all(s.get(k) == want[k] for k in (b"key-00250", min(want)) if k in want)


@pytest.mark.parametrize("files", [1, 3, 40])
def test_large_runs_are_disjoint_by_key(spark, tmp_path, monkeypatch, files):
    """Ranges begin within keys; files don't, and hold all rows in order."""
    monkeypatch.setattr(layout, "SORT_BYTES", 4_000)
    rows = random_ops(spark, 3_000, 7).withColumn("seq", F.col("op_index") + 1)
    want = [(bytes(r.key), r.seq, r.kind, r.value) for r in rows.orderBy("key", F.desc("seq")).collect()]
    path = str(tmp_path / "L0/job=3")
    layout.write_runs(rows, path, files, 3_000, 90_000)
    found = layout.describe(spark, path)
    assert all(a.largest < b.smallest for a, b in zip(found, found[1:])) and (len(found) == 1 if files == 1 else 1 < len(found) <= 7)
    assert [(bytes(r.key), r.seq, r.kind, r.value) for f in found for r in spark.read.parquet(f.path).orderBy(F.col("_metadata.row_index")).collect()] == want
    layout.write_runs(rows.limit(0), str(tmp_path / "L0/job=4"), files, 3_000, 90_000)
    assert layout.describe(spark, str(tmp_path / "L0/job=4")) == [] and sorted(os.listdir(tmp_path / "L0")) == ["job=3", "job=4"]


def test_one_file_point_read(spark, tmp_path):
    """A run of versions in one file, read at each of its seqs."""
    with Store.open(spark, str(tmp_path / "one"), SMALL) as s:
        for i in range(6):
            s.write_batch(WriteBatch().put(b"k", f"{i}".encode()) if i != 3 else WriteBatch().delete(b"k"))
        s.flush()
        [file] = s.files()[0]
        log = layout.read(spark, [file.path])
        got = [[bytes(r.value) for r in reads.get(log, bytearray(b"k"), seq).collect()] for seq in range(8)]
        assert got == [[], [b"0"], [b"1"], [b"2"], [], [b"4"], [b"5"], [b"5"]]


def test_list_batches_takes_numbers_only(tmp_path):
    for name in ("batch=10", "batch=9", "batch=x", "batch=", "other", "batch=3.tmp"):
        os.makedirs(tmp_path / name)
    assert layout.list_batches(str(tmp_path)) == [9, 10] and layout.list_batches(str(tmp_path / "none")) == []


def test_lock_orphans_corruption(spark, tmp_path):
    path = str(tmp_path / "x")
    with Store.open(spark, path) as s:
        s.put(b"a", b"1")
        s.flush()
        with pytest.raises(StoreLocked):
            Store.open(spark, path)
    for extra in ("log/batch=77", "log/staging=5", "L0/job=99"):
        os.makedirs(f"{path}/{extra}")
    with Store.open(spark, path) as s:
        assert s.get(b"a") == b"1" and not os.path.exists(f"{path}/L0/job=99") and not os.path.exists(f"{path}/log/batch=77")
        data = s.files()[0][0].path
    with open(data, "r+b") as f:
        f.truncate(10)
    with pytest.raises(DataFileCorrupt):
        Store.open(spark, path)


def test_bad_options_leave_no_folder(spark, tmp_path):
    with pytest.raises(InvalidArgument):
        Store.open(spark, str(tmp_path / "none"), Options(max_levels=1))
    assert not os.path.exists(tmp_path / "none")


def _broken(*_):
    raise OSError("disk")


@pytest.mark.parametrize("step", ["link", "fsync"])
@pytest.mark.parametrize("call", ["put", "flush", "compact"])
def test_failure_half_way_poisons(spark, tmp_path, monkeypatch, step, call):
    """Whichever step fails, no read or write goes on; what was acknowledged is there after reopening."""
    path = str(tmp_path / "p")
    store = Store.open(spark, path)
    store.put(b"a", b"1")
    if call == "compact":
        store.flush()
    monkeypatch.setattr(os, step, _broken)
    with pytest.raises(StoreIOError):
        store.put(b"b", b"2") if call == "put" else store.flush() if call == "flush" else store.compact()
    monkeypatch.undo()
    for again in (lambda: store.put(b"c", b""), store.snapshot, lambda: store.get(b"a"), store.flush, store.compact, store.stats, lambda: store.write_frame(random_ops(spark, 5, 2))):
        with pytest.raises(StorePoisoned):
            again()
    store.close()
    with Store.open(spark, path) as s:
        assert s.get(b"a") == b"1" and s.get(b"c") is None
        s.put(b"d", b"")
        s.compact()
        assert s.get(b"d") == b""


def test_failed_describe_poisons(spark, tmp_path, monkeypatch):
    store = Store.open(spark, str(tmp_path / "p"))
    store.put(b"a", b"1")
    monkeypatch.setattr(layout, "describe", _broken)
    with pytest.raises(StoreIOError):
        store.flush()
    with pytest.raises(StorePoisoned):
        store.get(b"a")
    store.close()


def test_failed_checkpoint_leaves_its_commit(tmp_path, monkeypatch):
    m = Manifest(str(tmp_path))
    monkeypatch.setattr(m, "checkpoint", _broken)
    for i in range(1, CHECKPOINT_EVERY + 1):
        assert m.commit([{"type": "last_seq", "value": i}]) == i
    with pytest.raises(StorePoisoned):
        m.commit([{"type": "last_seq", "value": 999}])
    assert Manifest(str(tmp_path)).state.last_seq == CHECKPOINT_EVERY


def _log_file(path):
    return next(os.path.join(d, f) for d, _, names in os.walk(f"{path}/log") for f in names if f.endswith(".parquet") and f[0] != ".")


@pytest.mark.parametrize("bulk", [False, True])
@pytest.mark.parametrize("damage", ["remove", "truncate", "flip", "grow"])
def test_damaged_log_is_refused(spark, tmp_path, damage, bulk):
    """An acknowledged batch can't vanish or change in silence, and nothing is removed then."""
    path = str(tmp_path / "d")
    with Store.open(spark, path) as s:
        s.write_frame(random_ops(spark, 50, 9)) if bulk else s.put(b"a", b"1")
    data = _log_file(path)
    whole = open(data, "rb").read()
    if damage == "remove":
        os.remove(data)
    else:
        changed = {"truncate": whole[:-1], "grow": whole + b"x", "flip": whole[:20] + bytes([whole[20] ^ 1]) + whole[21:]}[damage]
        open(data, "wb").write(changed)
    os.makedirs(f"{path}/log/batch=999")
    with pytest.raises(DataFileCorrupt):
        Store.open(spark, path)
    assert os.path.exists(f"{path}/log/batch=999")
    open(data, "wb").write(whole)
    with Store.open(spark, path) as s:
        assert s.visible_seq() == (50 if bulk else 1) and s.verify() >= 1 and not os.path.exists(f"{path}/log/batch=999")


def test_executors_take_many_checksums(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "DRIVER_BYTES", 0)
    path = str(tmp_path / "d")
    with Store.open(spark, path) as s:
        s.write_frame(random_ops(spark, 50, 9))
        state = s._manifest.state
        assert layout.checksums(spark, [f"{b.path}/{f.name}" for b in state.logs for f in b.files]) == {f"{b.path}/{f.name}": f.crc32 for b in state.logs for f in b.files}
    with Store.open(spark, path) as s:
        assert s.visible_seq() == 50


def test_flipped_page_is_noticed_when_read(spark, tmp_path):
    """A level's file of the right size and rows: its pages have checksums, wherever it lies."""
    path = str(tmp_path / "page")
    with Store.open(spark, path) as s:
        s.write_batch(batch_of({f"k{i:04}".encode(): os.urandom(64) for i in range(200)}))
        s.flush()
        data = s.files()[0][0].path
    os.remove(os.path.join(os.path.dirname(data), f".{os.path.basename(data)}.crc"))  # of the local file system alone
    with open(data, "r+b") as f:
        f.seek(2_000)
        byte = f.read(1)
        f.seek(2_000)
        f.write(bytes([byte[0] ^ 1]))
    with Store.open(spark, path) as s, pytest.raises(Exception, match=r"(?i)crc|checksum"):
        s.scan()


def test_order_of_files_is_checked(spark, tmp_path):
    path = str(tmp_path / "o")
    rows = [(b"b", 2, 1, b""), (b"a", 3, 1, b""), (b"c", 1, 1, b""), (b"c", 4, 1, b""), (b"c", 2, 1, b"")]
    layout.write_log_here(rows, path)
    assert sorted((r.row_index, bytes(r.key)) for r in layout.out_of_order(spark, [path]).collect()) == [(1, b"a"), (3, b"c")]
    with Store.open(spark, str(tmp_path / "s")) as s:
        s.write_frame(random_ops(spark, 500, 40))
        s.flush()
        assert layout.out_of_order(spark, [f.path for f in s.files()[0]]).isEmpty() and s.verify() == 1


def test_bulk_flush_is_many_files_and_one_run(spark, tmp_path):
    """A bulk load is flushed in ranges of keys; it counts once towards the rewrite of level 0."""
    with Store.open(spark, str(tmp_path / "b"), Options(memtable_size=1 << 30, target_file_size=4_000, l0_compaction_trigger=2)) as s:
        s.write_frame(random_ops(spark, 4_000, 900))
        s.flush()
        top = sorted(s.files()[0], key=lambda f: f.smallest)
        assert len(top) > 4 and all(a.largest < b.smallest for a, b in zip(top, top[1:], strict=False))
        assert max(f.entries for f in top) < 2_000 and s.stats().background_idle
        s.put(b"key-00001", b"")
        s.flush()
        assert not s.stats().background_idle


# --- writers in threads ----------------------------------------------------------------------------


def _run_all(jobs):
    threads = [threading.Thread(target=j) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not any(t.is_alive() for t in threads)


@pytest.mark.parametrize("window", [0.0, 0.02])
def test_writers_share_commits(spark, tmp_path, window):
    """All batches of all threads land, in far fewer commits, each under seqs of its own."""
    acks = {}
    with Store.open(spark, str(tmp_path / "w"), Options(commit_window=window)) as s:

        def work(w):
            for i in range(25):
                acks[w, i] = s.write_batch(WriteBatch().put(f"{w}:{i}".encode(), f"{i}".encode()).put(f"{w}".encode(), f"{i}".encode()))

        _run_all([lambda w=w: work(w) for w in range(16)])
        assert sorted(acks.values()) == list(range(2, 802, 2)) and s.visible_seq() == 800
        assert all(acks[w, i] < acks[w, i + 1] for w in range(16) for i in range(24))
        commits = s.stats().log_commits
        assert commits <= 250
        s.compact()
        got = dict(s.scan())
        assert len(got) == 16 * 26 and all(got[f"{w}:{i}".encode()] == f"{i}".encode() for w in range(16) for i in range(25))


def test_group_stays_within_the_memtable(spark, tmp_path):
    """The first request is taken whatever its size, more only while they fit."""
    with Store.open(spark, str(tmp_path / "g"), Options(memtable_size=1024, commit_window=0.2)) as s:
        big = WriteBatch().put(b"big", b"x" * 5_000)
        _run_all([lambda: s.write_batch(big), lambda: s.write_batch(big), lambda: s.put(b"a", b"x" * 5_000)])
        assert s.stats().log_commits == 3 and s.stats().memtable_bytes == 0


def test_one_bad_batch_fails_alone(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "o"), Options(commit_window=0.1)) as s:
        failed = []

        def bad():
            try:
                s.put(b"x" * (MAX_KEY_LEN + 1), b"")
            except InvalidArgument as e:
                failed.append(e)

        _run_all([bad, *(lambda i=i: s.put(f"{i}".encode(), b"") for i in range(6))])
        assert len(failed) == 1 and len(s.scan()) == 6


def test_failed_commit_fails_the_whole_group(spark, tmp_path, monkeypatch):
    s = Store.open(spark, str(tmp_path / "f"), Options(commit_window=0.3))
    errors = []

    def put(i):
        try:
            s.put(f"{i}".encode(), b"")
        except StoreIOError as e:
            errors.append(e)

    monkeypatch.setattr(os, "link", _broken)
    _run_all([lambda i=i: put(i) for i in range(5)])
    monkeypatch.undo()
    assert len(errors) == 5
    s.close()
    with Store.open(spark, s.path) as again:
        assert again.scan() == []


def test_close_among_writers(spark, tmp_path):
    """close() returns, no writer hangs, and each acknowledged write is there after reopening."""
    options = Options(memtable_size=2048, background=True)
    s = Store.open(spark, str(tmp_path / "c"), options)
    acked = []

    def work(w):
        for i in range(10_000):
            try:
                s.put(f"{w}/{i}".encode(), b"v" * 50)
                acked.append(f"{w}/{i}".encode())
            except StoreClosed:
                return

    threads = [threading.Thread(target=work, args=(w,)) for w in range(6)]
    for t in threads:
        t.start()
    time.sleep(2)
    s.close()
    for t in threads:
        t.join(60)
    assert not any(t.is_alive() for t in threads) and acked
    with Store.open(spark, s.path, options) as again:
        assert set(acked) <= {k for k, _ in again.scan()}


def test_writers_wait_for_the_background(spark, tmp_path, monkeypatch):
    """With so many frozen logs waiting, the next one that is full stalls its writer until a flush."""
    gate, started = threading.Event(), threading.Event()
    write_runs = layout.write_runs

    def slow(*args):
        started.set()
        assert gate.wait(60)
        write_runs(*args)

    monkeypatch.setattr(layout, "write_runs", slow)
    with Store.open(spark, str(tmp_path / "s"), Options(memtable_size=1024, background=True, l0_compaction_trigger=100)) as s:
        full = lambda i: s.put(f"k{i}".encode(), b"v" * 1100)
        full(0)
        assert started.wait(60)
        full(1)
        last = threading.Thread(target=lambda: (full(2), full(3)))
        last.start()
        time.sleep(1)
        assert last.is_alive() and s.visible_seq() == 3 and len(s._frozen) == 2  # the third is acknowledged and waits to be frozen
        gate.set()
        last.join(60)
        assert not last.is_alive() and s.wait_idle(60) and s.stats().background_idle and s.stats().memtable_bytes == 0
        assert [k for k, _ in s.scan()] == [b"k0", b"k1", b"k2", b"k3"]


def test_killed_while_threads_write(tmp_path, spark):
    """SIGKILL at any point: each write that was acknowledged is there, and the store goes on."""
    path = str(tmp_path / "k")
    code = f"""
        import sys, threading
        sys.path.insert(0, {HERE!r})
        from pyspark.sql import SparkSession
        from tidemark.options import Options
        from tidemark.store import Store
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        s = Store.open(spark, {path!r}, Options(memtable_size=1 << 14, background=True))
        def work(w):
            for i in range(10 ** 6):
                s.put(f"{{w}}/{{i:07}}".encode(), f"{{w}}={{i}}".encode())
                sys.stdout.write(f"{{w}} {{i}}" + chr(10))
                sys.stdout.flush()
        for w in range(8):
            threading.Thread(target=work, args=(w,)).start()
    """
    child = subprocess.Popen([sys.executable, "-c", textwrap.dedent(code)], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, start_new_session=True)
    lines = [child.stdout.readline() for _ in range(300)]
    os.killpg(child.pid, 9)
    lines += child.stdout.read().splitlines(keepends=True)
    child.wait(60)
    acked = [line.split() for line in lines if line.endswith("\n") and len(line.split()) == 2]
    assert len(acked) >= 290
    with Store.open(spark, path) as s:
        got = dict(s.scan())
        assert all(got[f"{w}/{int(i):07}".encode()] == f"{w}={i}".encode() for w, i in acked)
        before = s.visible_seq()
        assert s.put(b"more", b"") == before + 1 and s.verify() >= 1


def test_killed_between_staging_and_commit(spark, tmp_path):
    """The data is written but no commit names it: the batch never was, those before stay."""
    path = str(tmp_path / "k")
    code = f"""
        import os, sys
        sys.path.insert(0, {HERE!r})
        from pyspark.sql import SparkSession
        from tidemark.store import Store
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        s = Store.open(spark, {path!r})
        s.put(b"a", b"1")
        s._manifest.commit = lambda records: os.kill(os.getpid(), 9)
        s.put(b"b", b"2")
    """
    assert subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, timeout=180).returncode == -9
    assert len(os.listdir(f"{path}/log")) == 2
    with Store.open(spark, path) as s:
        assert s.scan() == [(b"a", b"1")] and len(os.listdir(f"{path}/log")) == 1 and s.put(b"c", b"3") == 2


def test_automatic_rotation(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "r"), Options(memtable_size=1024, l0_compaction_trigger=2)) as s:
        for i in range(3):
            s.write_batch(WriteBatch().put(f"k{i}".encode(), b"v" * 1100))
        stats = s.stats()
        assert stats.memtable_bytes == 0 and stats.background_idle and stats.flush_bytes and stats.compaction_bytes
        assert [k for k, _ in s.scan()] == [b"k0", b"k1", b"k2"]


def test_stream(spark, tmp_path, store):
    source = str(tmp_path / "source")
    ops = random_ops(spark, 600, 50)
    ops.filter("op_index < 300").write.parquet(source)
    stream = lambda: spark.readStream.schema(ops.schema).parquet(source)
    ingest(store, stream(), name="s", checkpoint=str(tmp_path / "c")).awaitTermination()
    assert store.visible_seq() == 300
    ops.filter("op_index >= 300").write.mode("append").parquet(source)
    ingest(store, stream(), name="s", checkpoint=str(tmp_path / "c")).awaitTermination()
    assert store.visible_seq() == 600
    assert store.write_frame(ops.limit(5), stream=("s", 1)) == 600  # delivered again: nothing happens
    want = {}
    for r in ops.orderBy("op_index").collect():
        want.pop(bytes(r.key), None)
        if r.kind:
            want[bytes(r.key)] = bytes(r.value)
    assert dict(store.scan()) == want


def test_zipf(spark):
    z = Zipf.of(spark, 1000)
    got = [r.n for r in requests(spark, 20_000, z, "A").groupBy("key").agg(F.count("*").alias("n")).orderBy("key").collect()]
    assert got[0] > got[5] > got[-1] and abs(got[0] / 20_000 - 1 / z.zeta_n) < 0.01
    ops = {r.op: r.n for r in requests(spark, 20_000, z, "F").groupBy("op").agg(F.count("*").alias("n")).collect()}
    assert set(ops) == {"read", "rmw"} and abs(ops["read"] / 20_000 - 0.5) < 0.02
