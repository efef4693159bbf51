"""Queries of the engine over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs as J
from . import workload
from .functions import accounting, keys
from .operators import asof as A
from .operators import merge, oplog, retention
from .operators.bounds import Range, prefix_range_text, scan
from .options import Options
from .plans.compaction import hull, overlapping
from .sources import layout
from .staging import new_path, stage
from .store import Store
from .streaming import ingest

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


FOUND: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        FOUND[run.__name__] = Query(run, sql)
        return run

    return add


# --- relations ---------------------------------------------------------------------------------

LOG = """log AS (
  SELECT 'user/' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS key, event_id + 1 AS seq,
    CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value
  FROM events
), s AS (SELECT max(seq) AS head, max(seq) // 2 AS mid FROM log)"""

NOW = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.from_events(table(spark, sf_dir, "events"))


def head(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]


def _live(bound: str) -> str:
    return f"(SELECT * FROM (SELECT * FROM log, s WHERE seq <= {bound} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE kind = 1)"


JOBS = f"""jobs AS (
  SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'done' END AS status,
    CAST(o_orderkey % 3 AS INTEGER) AS attempts, 3 AS max_attempts, CAST(o_custkey AS BIGINT) AS claim_token,
    CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 400 END AS lease_until, o_orderkey % 100 AS created_at, o_orderkey % 300 AS updated_at
  FROM orders
), nowt AS (SELECT {NOW} AS now)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs; times and attempts come from the id."""
    id_ = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return table(spark, sf_dir, "orders").select(
        id_.alias("id"),
        status.alias("status"),
        (id_ % 3).cast("int").alias("attempts"),
        F.lit(3).alias("max_attempts"),
        F.col("o_custkey").alias("claim_token"),
        F.when(status == "running", id_ % 400).alias("lease_until"),
        (id_ % 100).alias("created_at"),
        (id_ % 300).alias("updated_at"),
    )


# --- reads -------------------------------------------------------------------------------------


@query(f"WITH {LOG} SELECT key, seq, value FROM {_live('head')}")
def asof_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.asof(log(spark, sf_dir))


@query(f"WITH {LOG} SELECT key, seq, value FROM {_live('mid')}")
def asof_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    return A.asof(rows, head(rows) // 2)


@query(f"WITH {LOG} SELECT key, value FROM {_live('mid')} WHERE key = 'user/0000000005'")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    return A.get(rows, "user/0000000005", head(rows) // 2)


@query(f"""WITH {LOG}, p AS (SELECT 'user/' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS key FROM customer),
n AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
SELECT p.key, CASE WHEN kind IS NULL THEN 'absent' WHEN kind = 0 THEN 'delete' ELSE 'put' END AS outcome, value FROM p LEFT JOIN n ON p.key = n.key""")
def get_three_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's key: some were never users."""
    id_ = F.lpad(F.col("c_custkey").cast("string"), 10, "0")
    return A.lookup(log(spark, sf_dir), table(spark, sf_dir, "customer").select(F.concat(F.lit("user/"), id_).alias("key")))


def _ranged(name: str, bounds: Range, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan(A.asof(log(spark, sf_dir)), bounds).select("key", "value")

    run.__name__ = name
    query(f"WITH {LOG} SELECT key, value FROM {_live('head')} WHERE {where}")(run)


_ranged("range_inc_exc", Range("user/0000000003", "user/0000000040"), "key >= 'user/0000000003' AND key < 'user/0000000040'")
_ranged("range_exc_inc", Range("user/0000000003", "user/0000000040", True, False), "key > 'user/0000000003' AND key <= 'user/0000000040'")
_ranged("range_inc_inc", Range("user/0000000003", "user/0000000040", False, False), "key BETWEEN 'user/0000000003' AND 'user/0000000040'")
_ranged("range_exc_unbounded", Range("user/0000000100", None, True), "key > 'user/0000000100'")
_ranged("range_unbounded", Range(), "true")
_ranged("range_inverted", Range("user/0000000040", "user/0000000003"), "key >= 'user/0000000040' AND key < 'user/0000000003'")
_ranged("prefix_scan", prefix_range_text("user/00000000"), "key LIKE 'user/00000000%'")


@query(f"WITH {LOG} SELECT key, seq, kind, value, lag(seq) OVER (ORDER BY seq) AS prev_seq FROM log WHERE key = 'user/0000000003'")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.history(log(spark, sf_dir), "user/0000000003")


@query(f"WITH {LOG} SELECT key, seq, kind, value FROM log WHERE key >= 'user/0000000010'")
def iter_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions from a key on, in order, of a store's files."""
    store = _stored(spark, sf_dir, 2)
    rows = oplog.in_order(Range(b"user/0000000010", None).apply(store.snapshot().log()))
    return rows.select(F.col("key").cast("string").alias("key"), "seq", "kind", F.col("value").cast("string").alias("value"))


@query(f"WITH {LOG} SELECT key, seq, kind, value FROM log")
def iter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.in_order(log(spark, sf_dir))


@query(f"""WITH {LOG} SELECT probe_seq, p.key, l.value FROM (SELECT seq - 1 AS probe_seq, key FROM log) p
ASOF JOIN log l ON p.key = l.key AND p.probe_seq >= l.seq WHERE l.kind = 1""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each operation's key held just before it."""
    rows = log(spark, sf_dir)
    return A.asof_join(rows.select((F.col("seq") - 1).alias("probe_seq"), "key"), rows)


# --- merge, retention --------------------------------------------------------------------------


@query(f"""WITH {LOG}, r AS (SELECT key, seq, kind, 0 AS src FROM log, s WHERE seq <= 2 * mid - mid // 2 UNION ALL SELECT key, seq, kind, 1 FROM log, s WHERE seq > mid // 2)
SELECT key, seq, kind, min(src) AS src FROM r GROUP BY ALL""")
def merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    mid = head(rows) // 2
    runs = [rows.filter(F.col("seq") <= 2 * mid - mid // 2), rows.filter(F.col("seq") > mid // 2)]
    return merge.merge_runs(runs).select("key", "seq", "kind", "src")


def _gc_sql(extra: str) -> str:
    return f"""WITH {LOG}, m AS (SELECT key, seq, kind, seq > mid AS young, row_number() OVER (PARTITION BY key, seq <= mid ORDER BY seq DESC) AS rn FROM log, s)
SELECT key, seq, kind FROM m WHERE young OR (rn = 1{extra})"""


@query(_gc_sql(""))
def gc_filter_keep_tomb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    return retention.retain(rows, head(rows) // 2, bottom=False).select("key", "seq", "kind")


@query(_gc_sql(" AND kind = 1"))
def gc_filter_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    return retention.retain(rows, head(rows) // 2, bottom=True).select("key", "seq", "kind")


@query("SELECT CAST(0 AS BIGINT) AS n_diff")
def gc_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    top = head(rows)
    diff = [retention.differences(rows, top // 2, seq, bottom=b).select("key") for seq in (top // 2, top * 3 // 4, top) for b in (True, False)]
    out = diff[0]
    for d in diff[1:]:
        out = out.unionByName(d)
    return out.agg(F.count(F.lit(1)).alias("n_diff"))


@query(f"WITH {LOG} SELECT least(head, 1 * mid) AS watermark FROM s")
def gc_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = head(log(spark, sf_dir))
    return spark.createDataFrame([(retention.watermark([top // 2, top], top),)], "watermark long")


# --- files and bytes, of real stores -------------------------------------------------------------

#: Batches that the log comes in; each is flushed to one file.
BATCHES = 4
_OPTIONS = Options(memtable_size=1 << 40, target_file_size=1 << 40)


def _folder(spark: SparkSession) -> str:
    """A new folder for a store, where all executors can write."""
    return new_path(spark, "store").removeprefix("file://").removeprefix("file:")


def _stored(spark: SparkSession, sf_dir: str, batches: int = BATCHES, *, compact_after: int | None = None) -> Store:
    """A store that got the log in so many batches, with a flush after each."""
    store = Store.open(spark, _folder(spark), _OPTIONS)
    rows = log(spark, sf_dir).withColumnRenamed("seq", "op_index")
    top = head(log(spark, sf_dir))
    for n in range(batches):
        store.write_frame(rows.filter((F.col("op_index") > top * n // batches) & (F.col("op_index") <= top * (n + 1) // batches)))
        store.flush()
        if n == compact_after:
            store.compact()
    return store


def _file_rows(spark: SparkSession, store: Store) -> DataFrame:
    """A row for each file of the store, from its manifest; gen counts the files of a level, oldest first."""
    rows = [
        (level, n, f.smallest.decode(), f.largest.decode(), f.entries, f.max_seq, f.payload)
        for level, files in enumerate(store.files())
        for n, f in enumerate(sorted(files, key=lambda f: f.number))
    ]
    return spark.createDataFrame(rows, "level long, gen long, smallest string, largest string, entries long, max_seq long, payload long")


GENS = f"""g AS (SELECT *, (SELECT min(k) FROM range({BATCHES}) t(k) WHERE seq <= head * (k + 1) // {BATCHES}) AS gen FROM log, s),
gens AS (SELECT gen, min(key) AS smallest, max(key) AS largest, count(*) AS entries, max(seq) AS max_seq FROM g GROUP BY 1)"""


@query(f"WITH {LOG}, {GENS} SELECT * FROM gens")
def flush_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store recorded of each file that it flushed."""
    with _stored(spark, sf_dir) as store:
        return _file_rows(spark, store).select("gen", "smallest", "largest", "entries", "max_seq")


@query(f"WITH {LOG}, {GENS} SELECT a.gen AS a_gen, b.gen AS b_gen FROM gens a JOIN gens b ON a.gen < b.gen AND a.smallest <= b.largest AND b.smallest <= a.largest")
def file_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the store's files that may hold the same key, by the picker's test."""
    with _stored(spark, sf_dir) as store:
        files = sorted(store.files()[0], key=lambda f: f.number)
    met = [(i, j) for i, f in enumerate(files) for j in range(i + 1, len(files)) if overlapping([files[j]], f.smallest, f.largest)]
    return spark.createDataFrame(met, "a_gen long, b_gen long")


@query(f"WITH {LOG}, {GENS} SELECT min(smallest) AS smallest, max(largest) AS largest FROM gens")
def key_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _stored(spark, sf_dir) as store:
        return spark.createDataFrame([tuple(k.decode() for k in hull(store.files()[0]))], "smallest string, largest string")


_BYTES = """SELECT CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS user_bytes,
  CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 21) AS BIGINT) AS wal_bytes, CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 16) AS BIGINT) AS mem_bytes FROM log"""


@query(f"WITH {LOG} {_BYTES}")
def byte_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.byte_counts(log(spark, sf_dir))


#: The log by halves: what a rewrite of the first half keeps, and the second half as it came.
_HALVES = f"""{LOG}, kept AS (SELECT key, value FROM {_live('mid')}), rest AS (SELECT key, value FROM log, s WHERE seq > mid)"""
_SIZE = "coalesce(CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT), 0)"


def _halved(spark: SparkSession, sf_dir: str) -> Store:
    return _stored(spark, sf_dir, 2, compact_after=0)


@query(f"""WITH {_HALVES}, l AS (SELECT 0 AS level, CAST(1 AS BIGINT) AS files, count(*) AS entries, {_SIZE} AS bytes FROM rest UNION ALL SELECT 6, 1, count(*), {_SIZE} FROM kept)
SELECT n AS level, coalesce(files, 0) AS files, CAST(coalesce(entries, 0) AS BIGINT) AS entries, coalesce(bytes, 0) AS bytes FROM range(7) t(n) LEFT JOIN l ON n = level""")
def level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, rows and bytes (of keys and values) of each level, emptied ones too."""
    with _halved(spark, sf_dir) as store:
        files, levels = _file_rows(spark, store), spark.range(len(store.files())).withColumnRenamed("id", "level")
    sums = files.groupBy("level").agg(F.count(F.lit(1)).alias("files"), F.sum("entries").alias("entries"), F.sum("payload").alias("bytes"))
    return levels.join(sums, "level", "left").na.fill(0)


@query(f"""WITH {_HALVES}, b AS ({_BYTES}), k AS (SELECT {_SIZE} AS kept_bytes FROM kept)
SELECT user_bytes, wal_bytes, user_bytes AS flush_bytes, kept_bytes AS compaction_bytes,
  CASE WHEN user_bytes = 0 THEN 0.0 ELSE (wal_bytes + user_bytes + kept_bytes) / CAST(user_bytes AS DOUBLE) END AS write_amp FROM b, k""")
def write_amp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log + flush + compaction) / user bytes as the store counted them, before compression."""
    with _halved(spark, sf_dir) as store:
        t = store.stats()
    row = spark.createDataFrame([(t.user_bytes, t.wal_bytes, t.flush_payload, t.compaction_payload)], "user_bytes long, wal_bytes long, flush_bytes long, compaction_bytes long")
    written = (F.col("wal_bytes") + F.col("flush_bytes") + F.col("compaction_bytes")).cast("double")
    return row.withColumn("write_amp", accounting.amplification(written, F.col("user_bytes")))


@query("""WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), p(p) AS (VALUES (0.5::DOUBLE), (0.99::DOUBLE), (0.999::DOUBLE))
SELECT p, value FROM p JOIN r ON i = CAST(round(p * (n - 1)) AS BIGINT)""")
def latency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.nearest_rank(table(spark, sf_dir, "events"), "value", [0.5, 0.99, 0.999])


# --- jobs --------------------------------------------------------------------------------------


@query(f"WITH {JOBS}, st(status) AS (VALUES ('pending'), ('running'), ('done'), ('dead')) SELECT st.status, count(id) AS n FROM st LEFT JOIN jobs USING (status) GROUP BY 1")
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.status_report(jobs(spark, sf_dir))


@query(f"WITH {JOBS} SELECT min(id) AS id FROM jobs WHERE status = 'pending'")
def oldest_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.oldest(jobs(spark, sf_dir))


@query(f"WITH {JOBS} SELECT id, status FROM jobs WHERE status = 'running' ORDER BY id LIMIT 50")
def list_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir)
    return J.listed(rows.select("id", "status"), rows, "running").select("id", "status")


@query(f"""WITH {JOBS}, idx AS (SELECT id, CASE WHEN id % 97 = 0 THEN 'dead' ELSE status END AS status FROM jobs)
SELECT (SELECT count(*) FROM jobs ANTI JOIN idx USING (id, status)) AS missing, (SELECT count(*) FROM idx ANTI JOIN jobs USING (id, status)) AS orphan""")
def index_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs(spark, sf_dir)
    index = rows.select("id", F.when(F.col("id") % 97 == 0, "dead").otherwise(F.col("status")).alias("status"))
    return J.inconsistent(index, rows)


@query("SELECT o_orderkey AS id, 'job/' || lpad(lower(to_hex(o_orderkey)), 16, '0') AS key, o_orderkey AS id_back, 'idx/status/done/' || lpad(lower(to_hex(o_orderkey)), 16, '0') AS index_key FROM orders")
def key_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(id_.alias("id"), keys.job_key(id_).alias("key"), keys.status_key(F.lit("done"), id_).alias("index_key"))
    return rows.withColumn("id_back", keys.id_from_key(F.col("key")))


_FAILED = "CASE WHEN attempts + 1 >= max_attempts THEN 'dead' ELSE 'pending' END AS status, attempts + 1 AS attempts"


@query(f"WITH {JOBS} SELECT id, {_FAILED}, 'lease expired' AS last_error FROM jobs, nowt WHERE status = 'running' AND lease_until <= now")
def requeue_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.failed(J.expired(jobs(spark, sf_dir), NOW), NOW, J.LEASE_EXPIRED).select("id", "status", "attempts", "last_error")


@query(f"WITH {JOBS} SELECT id, {_FAILED}, CAST(now AS BIGINT) AS updated_at FROM jobs, nowt WHERE status = 'running'")
def fail_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = jobs(spark, sf_dir).filter("status = 'running'")
    return J.failed(running, NOW, "worker error").select("id", "status", "attempts", "updated_at")


@query(f"WITH {JOBS} SELECT id, status, attempts FROM jobs, nowt WHERE status = 'done' AND updated_at < now")
def purge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.purgeable(jobs(spark, sf_dir), "done", NOW).select("id", "status", "attempts")


@query(f"""WITH {JOBS}, h AS (SELECT id, status, lpad(lower(to_hex(id)), 16, '0') AS x FROM jobs)
SELECT id, 'delete' AS op, 'idx/status/' || status || '/' || x AS key FROM h UNION ALL SELECT id, 'put', 'idx/status/dead/' || x FROM h UNION ALL SELECT id, 'put', 'job/' || x FROM h""")
def move_batch_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs given up: three operations each."""
    rows = jobs(spark, sf_dir).withColumnRenamed("status", "before").withColumn("status", F.lit("dead"))
    return J.moves(rows, F.col("before"), F.lit("{}")).select("id", "op", "key")


@query(f"""WITH {JOBS}, x AS (SELECT *, CASE WHEN lease_until IS NULL THEN 'null' ELSE CAST(lease_until AS VARCHAR) END AS lease FROM jobs)
SELECT id, '{{"id":' || id || ',"kind":"order","payload":{{"order":' || id || '}},"status":"' || status || '","attempts":' || attempts || ',"max_attempts":' || max_attempts || ',"claim_token":' || claim_token
  || ',"lease_until":' || lease || ',"created_at":' || created_at || ',"updated_at":' || updated_at || ',"last_error":null}}' AS line FROM x""")
def export_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs loaded into a queue, exported to text files and read back."""
    id_ = F.col("id").cast("string")
    rows = jobs(spark, sf_dir).withColumns({"kind": F.lit("order"), "payload": F.concat(F.lit('{"order":'), id_, F.lit("}")), "last_error": F.lit(None).cast("string")})
    folder = new_path(spark, "export")
    with Store.open(spark, _folder(spark), _OPTIONS) as store:
        queue = J.JobStore(store)
        queue.load(rows)
        queue.export(folder)
    lines = spark.read.text(folder).withColumnRenamed("value", "line")
    return lines.select(F.get_json_object("line", "$.id").cast("long").alias("id"), "line")


# --- workloads ---------------------------------------------------------------------------------

_U = "((((({0}) % 2147483647) * 48271 + 11) % 2147483647 * 69621 + 7) % 2147483647) / 2147483647.0::DOUBLE"


@query(f"""WITH k AS (SELECT o_orderkey AS id, {_U.format('o_orderkey')} AS u FROM orders), n AS (SELECT count(*) AS n FROM orders)
SELECT 'key' || lpad(CAST(CAST(floor(u * n) AS BIGINT) AS VARCHAR), 10, '0') AS key, count(*) AS hits FROM k, n GROUP BY 1""")
def ycsb_uniform_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    n = orders.count()
    return orders.groupBy(keys.zipf_key(F.floor(workload.uniform(F.col("o_orderkey")) * F.lit(float(n)))).alias("key")).agg(F.count(F.lit(1)).alias("hits"))


def _value(owner: Column) -> Column:
    return F.rpad(owner, workload.VALUE_BYTES, "x")


def _mix(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The mix over a store with a record for each order.

        Reads see the records as of the load; updates, and writes that follow a read, are one
        batch. Per record that was asked for: reads, writes, the value read and the value after.
        """
        orders = table(spark, sf_dir, "orders")
        n = orders.count()
        first = orders.select(F.col("o_orderkey").alias("op_index"), keys.zipf_key(F.col("o_orderkey")).alias("key"), F.lit(1).alias("kind"), _value(F.concat(F.lit("load-"), F.col("o_orderkey").cast("string"))).alias("value"))
        asked = workload.requests(spark, n, workload.Zipf.of(spark, n), name)
        # counted per key before the join: the hottest key is one row there
        wrote = F.col("op") != "read"
        asked = asked.groupBy("key").agg(F.count_if(F.col("op") != "update").alias("reads"), F.count_if(wrote).alias("writes"), F.max(F.when(wrote, F.struct("request", "op"))).alias("last"))
        store = Store.open(spark, _folder(spark), _OPTIONS)
        store.write_frame(first)
        store.flush()
        before = store.snapshot()
        # Parquet's sizes are of packed values, so the planner would broadcast a table far too large
        read = asked.join(before.view().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("read")).hint("merge"), "key")
        read = stage(read, "ycsb-reads")
        # the last write of a key stands; one that follows a read keeps the end of what it read
        request = F.col("last.request").cast("string")
        value = F.when(F.col("last.op") == "update", _value(F.concat(F.lit("set-"), request))).otherwise(F.concat(F.rpad(F.concat(F.lit("rmw-"), request), 50, "y"), F.substring("read", 51, 50)))
        store.write_frame(read.filter("writes > 0").select(F.col("last.request").alias("op_index"), "key", F.lit(1).alias("kind"), value.alias("value")))
        after = store.snapshot().view().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
        return read.join(after.hint("merge"), "key").select("key", "reads", "writes", F.when(F.col("reads") > 0, F.col("read")).alias("read"), "value")

    reads, updates, _ = workload.MIXES[name]
    run.__name__ = f"ycsb_{name.lower()}_bulk"
    query(f"""WITH n AS (SELECT count(*) AS n FROM orders), i AS (SELECT unnest(range(n)) AS id, n FROM n),
z AS (SELECT round(sum(pow(CAST(id + 1 AS DOUBLE), -0.99::DOUBLE)), 6) AS zn, 1 + pow(0.5::DOUBLE, 0.99::DOUBLE) AS z2 FROM i),
c AS (SELECT zn, z2, (1 - pow(2.0::DOUBLE / n, 1 - 0.99::DOUBLE)) / (1 - z2 / zn) AS eta, 1 / (1 - 0.99::DOUBLE) AS alpha FROM z, n),
r AS (SELECT id, {_U.format('id')} AS u, {_U.format('id * 7 + 3')} AS roll, n FROM i),
k AS (SELECT id, CASE WHEN u * zn < 1 THEN 0 WHEN u * zn < z2 THEN 1 ELSE least(CAST(floor(CAST(n AS DOUBLE) * pow(eta * u - eta + 1, alpha)) AS BIGINT), n - 1) END AS rank,
  CASE WHEN roll < {reads}::DOUBLE THEN 'read' WHEN roll < {reads + updates}::DOUBLE THEN 'update' ELSE 'rmw' END AS op FROM r, c),
a AS (SELECT rank, count(*) FILTER (op <> 'update') AS reads, count(*) FILTER (op <> 'read') AS writes, max(id) FILTER (op <> 'read') AS last, arg_max(op, id) FILTER (op <> 'read') AS last_op
  FROM k WHERE rank IN (SELECT o_orderkey FROM orders) GROUP BY 1),
v AS (SELECT *, rpad('load-' || rank, 100, 'x') AS was FROM a)
SELECT 'key' || lpad(CAST(rank AS VARCHAR), 10, '0') AS key, reads, writes, CASE WHEN reads > 0 THEN was END AS read,
  CASE WHEN writes = 0 THEN was WHEN last_op = 'update' THEN rpad('set-' || last, 100, 'x') ELSE rpad('rmw-' || last, 50, 'y') || substr(was, 51, 50) END AS value FROM v""")(run)


for _name in workload.MIXES:
    _mix(_name)


# --- storage -----------------------------------------------------------------------------------


_STORED = "SELECT key, seq, value FROM "


def _shown(view: DataFrame) -> DataFrame:
    return view.select(F.col("key").cast("string").alias("key"), "seq", F.col("value").cast("string").alias("value"))


@query(f"WITH {LOG} {_STORED}{_live('head')}")
def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written to a store in two batches, flushed, fully compacted, and read back."""
    store = _stored(spark, sf_dir, 2)
    store.compact()
    return _shown(store.snapshot().view())


@query(f"WITH {LOG} {_STORED}{_live('mid')}")
def store_old_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot taken between the batches, read after the second one and a compaction."""
    store = Store.open(spark, _folder(spark), _OPTIONS)
    rows = log(spark, sf_dir).withColumnRenamed("seq", "op_index")
    half = head(log(spark, sf_dir)) // 2
    store.write_frame(rows.filter(F.col("op_index") <= half))
    old = store.snapshot()
    store.write_frame(rows.filter(F.col("op_index") > half))
    store.compact()
    return _shown(old.view())


@query(f"WITH {LOG} {_STORED}{_live('head')}")
def store_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in a flushed and an unflushed half, a batch whose commit never came, and a reopening."""
    path = _folder(spark)
    rows = log(spark, sf_dir).withColumnRenamed("seq", "op_index")
    half = head(log(spark, sf_dir)) // 2
    with Store.open(spark, path, _OPTIONS) as store:
        store.write_frame(rows.filter(F.col("op_index") <= half))
        store.flush()
        store.write_frame(rows.filter(F.col("op_index") > half))
    layout.write_log_here([(b"user/lost", 1 << 40, 1, b"")], f"{path}/log/batch=999999")
    return _shown(Store.open(spark, path, _OPTIONS).snapshot().view())


@query(f"WITH {LOG} {_STORED}{_live('head')}")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a file stream of one micro-batch per file, committed to a store and read back."""
    folder = _folder(spark)
    source = f"{folder}-source"
    rows = log(spark, sf_dir).withColumnRenamed("seq", "op_index")
    rows.repartitionByRange(3, "op_index").write.parquet(source)
    store = Store.open(spark, folder, _OPTIONS)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    ingest(store, stream, name="events", checkpoint=f"{folder}-checkpoint").awaitTermination()
    return _shown(store.snapshot().view())


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: live keys of a prefix, in order, as of the end of the log."""
    return scan(A.asof(log(spark, sf_dir)), prefix_range_text("user/")).select("key", "seq", "value")
