"""The relational operators against small models."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import accounting, keys
from tidemark.operators import asof, bounds, merge, oplog, retention, sweep

SCHEMA = "key string, seq long, kind int, value string"


def rows_of(spark, entries):
    """entries: key, seq, value or None for a delete."""
    return spark.createDataFrame([(k, s, int(v is not None), v) for k, s, v in entries], SCHEMA)


def seen(df):
    return [(r.key, r.seq) for r in df.orderBy("key", F.desc("seq")).collect()]


def live(entries, at):
    newest = {}
    for k, s, v in entries:
        if s <= at and s > newest.get(k, (0, None))[0]:
            newest[k] = (s, v)
    return {k: v for k, (s, v) in newest.items() if v is not None}


def test_merge(spark):
    one, two = rows_of(spark, [("a", 3, "x"), ("b", 1, "x")]), rows_of(spark, [("a", 1, "x"), ("c", 2, "x")])
    assert seen(merge.merge_runs([one, two])) == [("a", 3), ("a", 1), ("b", 1), ("c", 2)]
    same = merge.merge_runs([rows_of(spark, [("a", 1, "first")]), rows_of(spark, [("a", 1, "second")])]).collect()
    assert [(r.value, r.src) for r in same] == [("first", 0)]


def test_asof_every_seq(spark):
    entries = [("a", 5, "a5"), ("a", 2, "a2"), ("b", 3, None), ("b", 1, "b1"), ("c", 4, "c4")]
    log = rows_of(spark, entries)
    for s in range(7):
        assert {r.key: r.value for r in asof.asof(log, s).collect()} == live(entries, s)


def test_kind_is_tested_after_the_choice(spark):
    """A filter on kind below the choice would bring the deleted key back."""
    log = rows_of(spark, [("a", 1, "old"), ("a", 2, None)])
    assert asof.asof(log).collect() == []
    plan = asof.asof(log)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("kind") < plan.index("Window")


def test_seq_and_key_filters_reach_the_scan(spark, tmp_path):
    rows_of(spark, [("a", 1, "x")]).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = asof.asof(log, 7).filter("key = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(seq,7)" in plan and "EqualTo(key,a)" in plan and "WindowGroupLimit" in plan


def test_three_valued_get(spark):
    log = rows_of(spark, [("a", 5, "v5"), ("a", 3, "v3"), ("a", 1, None)])
    probe = spark.createDataFrame([("a",)], "key string")
    got = [(asof.lookup(log, probe, s).first().outcome, asof.lookup(log, probe, s).first().value) for s in (10, 4, 1, 0)]
    assert got == [("put", "v5"), ("put", "v3"), ("delete", None), ("absent", None)]


@pytest.mark.parametrize(
    ("entries", "bottom", "want"),
    [
        ([("a", 5, "x"), ("a", 3, "x"), ("a", 2, "x"), ("a", 1, "x")], False, [5, 3, 2]),
        ([("a", 5, "x"), ("a", 2, None), ("a", 1, "x")], False, [5, 2]),
        ([("a", 5, "x"), ("a", 2, None), ("a", 1, "x")], True, [5]),
        ([("a", 5, None), ("a", 1, "x")], True, [5, 1]),
    ],
)
def test_retain(spark, entries, bottom, want):
    assert [s for _, s in seen(retention.retain(rows_of(spark, entries), 2, bottom=bottom))] == want


ENTRIES = st.lists(st.tuples(st.text("abcde", min_size=1, max_size=2), st.integers(1, 49), st.one_of(st.none(), st.text("xyz", max_size=4))), max_size=40, unique_by=lambda e: e[1])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(entries=ENTRIES, oldest=st.integers(0, 50), extra=st.integers(0, 20))
def test_retain_is_invisible(spark, entries, oldest, extra):
    log = rows_of(spark, entries)
    s = oldest + extra
    for bottom in (True, False):
        kept = retention.retain(log, oldest, bottom=bottom)
        assert {r.key: r.value for r in asof.asof(kept, s).collect()} == live(entries, s)


def test_watermark():
    assert retention.watermark([], 9) == 9 and retention.watermark([4, 7], 9) == 4


def test_asof_join(spark):
    entries = [("a", 1, "x"), ("a", 4, None), ("a", 6, "y"), ("b", 2, "z")]
    probes = [(s, k) for s in range(8) for k in "abc"]
    got = {(r.probe_seq, r.key): r.value for r in asof.asof_join(spark.createDataFrame(probes, "probe_seq long, key string"), rows_of(spark, entries)).collect()}
    assert got == {(s, k): live(entries, s)[k] for s, k in probes if k in live(entries, s)}


def test_history(spark):
    log = rows_of(spark, [("a", 1, "x"), ("a", 4, None), ("b", 2, "z")])
    assert [(r.seq, r.prev_seq) for r in oplog.history(log, "a").collect()] == [(4, 1), (1, None)]


@pytest.mark.parametrize("lo_open", [False, True])
@pytest.mark.parametrize("hi_open", [False, True])
@pytest.mark.parametrize(("lo", "hi"), [("fig", "pear"), (None, "fig"), ("fig", None), (None, None), ("pear", "fig"), ("f", "fz"), ("fig", "fig")])
def test_ranges(spark, lo, hi, lo_open, hi_open):
    fruit = ["apple", "cherry", "fig", "figs", "grape", "pear", "pears", "plum"]
    above = lambda k: lo is None or (k > lo if lo_open else k >= lo)
    below = lambda k: hi is None or (k < hi if hi_open else k <= hi)
    r = bounds.Range(lo, hi, lo_open, hi_open)
    want = [k for k in fruit if above(k) and below(k)]
    view = asof.asof(rows_of(spark, [(k, i + 1, k.upper()) for i, k in enumerate(fruit)]))
    assert [x.key for x in bounds.scan(view, r).collect()] == want
    assert all(r.meets(k, k) == (k in want) for k in fruit)


@pytest.mark.parametrize(("prefix", "hi"), [(b"a/", b"a0"), (b"a\xff", b"b"), (b"\xff\xff", None), (b"", None)])
def test_prefix_range(prefix, hi):
    got = bounds.prefix_range(prefix)
    assert (got.lo, got.hi, got.lo_open, got.hi_open) == (prefix, hi, False, True)


def test_key_codec(spark):
    df = spark.createDataFrame([(0,), (255,), (2**62 + 5,)], "id long")
    got = df.select("id", keys.job_key(F.col("id")).alias("k"), keys.status_key(F.lit("done"), F.col("id")).alias("s"))
    got = got.withColumns({"a": keys.id_from_key(F.col("k")), "b": keys.id_from_key(F.col("s"))}).collect()
    assert all(r.id == r.a == r.b and r.k == keys.job_key_bytes(r.id).decode() and r.s == keys.status_key_bytes("done", r.id).decode() for r in got)
    bad = spark.createDataFrame([("job/12",), ("job/zzzzzzzzzzzzzzzz",), ("",)], "k string").select(keys.id_from_key(F.col("k")).alias("i")).collect()
    assert [r.i for r in bad] == [None] * 3


def test_nearest_rank(spark):
    values = [5.0, 1.0, 3.0, 3.0, 9.0, None]
    got = {r.p: r.value for r in accounting.nearest_rank(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0.0, 0.5, 0.9, 1.0]).collect()}
    order = sorted(v for v in values if v is not None)
    assert got == {p: order[int(p * 4 + 0.5)] for p in (0.0, 0.5, 0.9, 1.0)}


def test_hot_key_spreads(spark, monkeypatch):
    """Nine tenths of the versions and probes have one key: no range holds much over its share."""
    ranges = []
    monkeypatch.setattr(sweep, "ONE_RANGE_BYTES", 0)
    own = sweep.stage
    monkeypatch.setattr(sweep, "stage", lambda df, name: ranges.append(own(df, name)) or ranges[-1])
    log = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), F.col("id").cast("string"))).otherwise("hot").alias("key"), (F.col("id") + 1).alias("seq"), F.when(F.col("id") % 7 == 0, 0).otherwise(1).alias("kind"), F.col("id").cast("string").alias("value"))
    probes = log.select((F.col("seq") - 1).alias("probe_seq"), "key")
    got = asof.asof_join(probes, log)
    share = ranges[0].groupBy("_range").count().agg(F.max("count"), F.sum("count")).first()
    versions = {(r.key, r.seq): r for r in log.collect()}
    last, want = {}, {}
    for (key, seq), r in sorted(versions.items(), key=lambda x: x[0][1]):
        if key in last and last[key].kind:
            want[(seq - 1, key)] = last[key].value
        last[key] = r
    assert {(r.probe_seq, r.key): r.value for r in got.collect()} == want
    assert share[0] < 0.35 * share[1]  # of four ranges
    kept = retention.retain(log, 15_000, bottom=True)
    assert kept.filter("key = 'hot' AND seq <= 15000").count() == 1
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [0, 4 << 20])
def test_running_and_swept(spark, monkeypatch, most):
    """One range or many: the same sums and the same last values, ties and nulls among them."""
    monkeypatch.setattr(sweep, "ONE_RANGE_BYTES", most)
    rows = [(i * 7919 % 1000, i % 5, None if i % 3 else f"v{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "at long, amount long, value string")
    order = sorted(rows)
    want, total, last = {}, 0, None
    for at, amount, value in order:
        last = value if value is not None else last
        want[at] = (total, last)
        total += amount
    assert {r.at: r.before for r in sweep.running(df, ["at"], {"before": "amount"}, "t").collect()} == {k: v[0] for k, v in want.items()}
    assert {r.at: r.value for r in sweep.swept(df, ["at"], "value", "t").collect()} == {k: v[1] for k, v in want.items()}
    assert sweep.running(df.limit(0), ["at"], {"before": "amount"}, "t").collect() == sweep.swept(df.limit(0), ["at"], "value", "t").collect() == []


@pytest.mark.parametrize("most", [0, 4 << 20])
def test_nearest_rank_of_distinct_values_is_spread(spark, monkeypatch, most):
    monkeypatch.setattr(sweep, "ONE_RANGE_BYTES", most)
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("v"))
    assert {r.p: r.value for r in accounting.nearest_rank(df, "v", [0.0, 0.5, 0.999, 1.0]).collect()} == {0.0: 0.0, 0.5: 25_000.0, 0.999: 49_949.0, 1.0: 49_999.0}
    assert accounting.nearest_rank(df.limit(0), "v", [0.5]).collect() == []


def test_release_removes_staged_tables(spark):
    from tidemark import staging

    df = staging.stage(spark.range(3), "t")
    path = df.inputFiles()[0]
    assert staging.within(spark, path.rsplit("/", 1)[0]) and staging.release(spark) >= 1
    assert not staging.within(spark, path.rsplit("/", 1)[0]) and staging.within(spark, path) == []
    with staging.collected() as own:
        old = staging.stage(spark.range(3), "old")
    last = staging.stage(spark.range(4), "last")
    assert len(own) == 1 and staging.release(spark, own) == 1 and last.count() == 4
    assert not staging.within(spark, old.inputFiles()[0].rsplit("/", 1)[0])
