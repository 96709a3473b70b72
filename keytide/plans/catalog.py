"""The queries of the driver's contract over its tables, and their SQL for DuckDB.

The change log: an event is a change of its user's key; ``error`` is a delete; views live for three days, clicks for ten.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions import bloom as blooms
from keytide.functions.codec import frame, frame_ok, payload
from keytide.operators import reads, resolve
from keytide.plans.keyrange import KeyRange
from keytide.plans.schema import as_changes, composite_key, entry_size, level_of, padded_key
from keytide.sources.store import KvStore, Options
from keytide.streaming import ingest

AS_OF = 1706832000  # 2024-02-02 00:00:00 UTC
KEY_TTL = {"view": 259200, "click": 864000}
DB_TTL = 604800


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seconds() -> F.Column:
    return F.unix_timestamp(F.col("ts").cast("timestamp"))


def key_ttl() -> F.Column:
    t = F.col("event_type")
    return F.when(t == "view", KEY_TTL["view"]).when(t == "click", KEY_TTL["click"])


def changes(spark: SparkSession, sf: str, ttl: str | None = None) -> DataFrame:
    """``ttl``: None, "key", "database" or "both"."""
    kw = {"key_ttl": key_ttl()} if ttl in ("key", "both") else {}
    return as_changes(table(spark, sf, "events"), key=padded_key(F.col("user_id")), seq=F.col("event_id"), value=F.col("value"), is_delete=F.col("event_type") == "error", now=seconds(), store_ttl=DB_TTL if ttl in ("database", "both") else None, **kw)


def live(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.state(changes(spark, sf), AS_OF)


CHG = """chg AS (SELECT lpad(CAST(user_id AS VARCHAR), 12, '0') AS key, value, event_type = 'error' AS is_delete, event_id AS seq,
  CAST(floor(epoch(ts)) AS BIGINT) AS t, CASE event_type WHEN 'view' THEN 259200 WHEN 'click' THEN 864000 END AS ttl FROM events)"""
LATEST = f"{CHG}, latest AS (SELECT * FROM chg QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"
LIVE = f"WITH {LATEST}, live AS (SELECT key, value FROM latest WHERE NOT is_delete)"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"{LIVE} SELECT * FROM live")
def latest_state(spark, sf):
    return live(spark, sf).select("key", "value")


@query(f"{LIVE} SELECT key, value, row_number() OVER (ORDER BY key) AS position FROM live")
def fold_full(spark, sf):
    """Ordered scan with each row's place, from the counts of key ranges: in two steps, so that the one task that sees all
    ranges sees one row for a million keys."""
    from pyspark.sql import Window

    part = lambda n: F.substring("key", 1, n)
    rows = live(spark, sf).select("key", "value", part(6).alias("_a"), part(9).alias("_b"))
    fine = rows.groupBy("_a", "_b").count()
    coarse = fine.groupBy("_a").agg(F.sum("count").alias("_m"))
    sums = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.select("_a", sums("_m", Window.orderBy("_a")).alias("_x"))
    lower = fine.join(coarse, "_a").select("_b", (F.col("_x") + sums("count", Window.partitionBy("_a").orderBy("_b"))).alias("_n"))
    return rows.join(lower, "_b").select("key", "value", (F.col("_n") + F.row_number().over(Window.partitionBy("_b").orderBy("key"))).alias("position"))


@query("""SELECT concat_ws('/', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), CAST(l_linenumber AS VARCHAR)) AS key, l_quantity AS quantity, l_extendedprice AS price FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1""")
def put_overwrite(spark, sf):
    li = table(spark, sf, "lineitem").select(composite_key(padded_key(F.col("l_orderkey")), F.col("l_linenumber").cast("string")).alias("key"), "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return resolve.latest(li, "key", ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("key", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))


@query(f"WITH {LATEST} SELECT count(*) AS keys, count(*) FILTER (is_delete) AS deleted, count(*) FILTER (NOT is_delete) AS visible FROM latest")
def delete_tombstone(spark, sf):
    return resolve.latest(changes(spark, sf)).agg(F.count(F.lit(1)).alias("keys"), F.count_if("is_delete").alias("deleted"), F.count_if(~F.col("is_delete")).alias("visible"))


@query(f"{LIVE} SELECT * FROM live WHERE key = '000000000007'")
def get_point(spark, sf):
    return reads.get(live(spark, sf), "000000000007").select("key", "value")


@query("SELECT CAST(0 AS BIGINT) AS found")
def get_missing(spark, sf):
    return reads.lookup(live(spark, sf), "no such key").agg(F.count(F.lit(1)).alias("found"))


@query(f"{LIVE}, wanted AS (SELECT DISTINCT lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS key FROM orders) SELECT w.key, l.value FROM wanted w LEFT JOIN live l USING (key)")
def multi_get(spark, sf):
    return reads.multi_get(live(spark, sf), table(spark, sf, "orders").select(padded_key(F.col("o_custkey")).alias("key")).distinct())


RANGES = {
    "range_half_open": (KeyRange("000000000020", "000000000060"), "key >= '000000000020' AND key < '000000000060'"),
    "range_inclusive_to": (KeyRange("000000000020", "000000000060", hi_inclusive=True), "key >= '000000000020' AND key <= '000000000060'"),
    "range_exclusive_from": (KeyRange("000000000020", "000000000060", lo_inclusive=False), "key > '000000000020' AND key < '000000000060'"),
    "range_open_end": (KeyRange("000000000090"), "key >= '000000000090'"),
    "range_all": (KeyRange(), "true"),
    "topk_limit": (KeyRange("000000000010", limit=25), "key >= '000000000010' ORDER BY key LIMIT 25"),
    "range_limit_zero": (KeyRange(limit=0), "false"),
}
for _name, (_range, _sql) in RANGES.items():

    def _scan(spark, sf, r=_range):
        return reads.scan(live(spark, sf), r).select("key", "value")

    _scan.__name__ = _name
    query(f"{LIVE} SELECT * FROM live WHERE {_sql}")(_scan)


@query(f"{LIVE} SELECT key, value, (row_number() OVER (ORDER BY key) - 1) // 30 AS page FROM live WHERE key < '000000000090'")
def paged_scan(spark, sf):
    """Pages of 30 rows, each read from after the last key of the one before."""
    pages = reads.pages(live(spark, sf).select("key", "value"), KeyRange(hi="000000000090"), 30)
    return spark.createDataFrame([(r.key, r.value, i) for i, p in enumerate(pages) for r in p], "key string, value double, page long")


@query("SELECT url AS key, page_id FROM pages WHERE starts_with(url, 'https://www') QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1")
def prefix_scan(spark, sf):
    newest = resolve.latest(table(spark, sf, "pages").select(F.col("url").alias("key"), "page_id"), "key", "page_id")
    return newest.where(F.col("key").startswith("https://www"))


@query(f"{LIVE} SELECT count(*) AS n FROM (SELECT * FROM live WHERE key >= '000000000005' ORDER BY key LIMIT 100)")
def fold_100(spark, sf):
    return reads.fold(live(spark, sf), KeyRange("000000000005", limit=100), n=F.count(F.lit(1)))


@query(f"{LIVE} SELECT count(*) AS n FROM live")
def fold_count(spark, sf):
    return reads.fold(live(spark, sf), KeyRange(), n=F.count(F.lit(1)))


@query(f"{LIVE} SELECT round(sum(value), 4) AS total, min(key) AS low, max(key) AS high FROM live")
def fold_sum(spark, sf):
    return reads.fold(live(spark, sf), KeyRange(), total=F.round(F.sum("value"), 4), low=F.min("key"), high=F.max("key"))


@query(f"{LIVE} SELECT coalesce(string_agg(key, ',' ORDER BY key), '') AS keys FROM (SELECT key FROM live WHERE key >= '000000000010' ORDER BY key LIMIT 50)")
def fold_ordered_concat(spark, sf):
    joined = reads.fold_ordered(live(spark, sf), KeyRange("000000000010", limit=50), F.lit(""), lambda a, x: F.when(a == "", x["key"]).otherwise(F.concat(a, F.lit(","), x["key"])))
    return joined.select(F.col("acc").alias("keys"))


@query(f"{LIVE} SELECT coalesce(string_agg(key, ',' ORDER BY key DESC), '') AS keys FROM (SELECT key FROM live WHERE key >= '000000000010' ORDER BY key LIMIT 50)")
def fold_reverse(spark, sf):
    joined = reads.fold_ordered(live(spark, sf), KeyRange("000000000010", limit=50), F.lit(""), lambda a, x: F.when(a == "", x["key"]).otherwise(F.concat(a, F.lit(","), x["key"])), reverse=True)
    return joined.select(F.col("acc").alias("keys"))


def _ttl(name: str, kind: str, ttl: str, as_of: int = AS_OF):
    def run(spark, sf):
        return resolve.state(changes(spark, sf, kind), as_of).select("key", "value", "expire_at")

    run.__name__ = name
    query(f"WITH {LATEST} SELECT key, value, t + {ttl} AS expire_at FROM latest WHERE NOT is_delete AND ({ttl} IS NULL OR t + {ttl} >= {as_of})")(run)


_ttl("ttl_key", "key", "ttl")
_ttl("ttl_database", "database", f"CAST({DB_TTL} AS BIGINT)")
_ttl("ttl_min_both", "both", f"least(ttl, {DB_TTL})")
_ttl("ttl_hides_older", "key", "ttl", AS_OF + 86400)


@query(f"""WITH {LATEST}, edge AS (SELECT max(t + 864000) AS x FROM latest WHERE NOT is_delete AND ttl = 864000)
SELECT step, (SELECT count(*) FROM latest, edge WHERE NOT is_delete AND (ttl IS NULL OR t + ttl >= x + step)) AS visible FROM (VALUES (-1), (0), (1)) s(step)""")
def ttl_boundary(spark, sf):
    """At the second of expiry a change is still there; a second later it isn't."""
    newest = resolve.latest(changes(spark, sf, "key"))
    last = table(spark, sf, "events").select(padded_key(F.col("user_id")).alias("key"), F.col("event_id").alias("seq"), "event_type")
    edge = newest.join(last, ["key", "seq"]).where("event_type = 'click'").agg(F.max("expire_at").alias("x"))
    steps = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    rows = newest.where(~F.col("is_delete")).crossJoin(F.broadcast(edge))  # one row
    return rows.select(steps.alias("step"), "expire_at", "x").groupBy("step").agg(F.count_if(~resolve.expired(F.col("x") + F.col("step"))).alias("visible"))


@query("""WITH ops AS (SELECT conv_id AS tx, turn, role AS key, md5(text) AS value, turn % 4 = 3 AS is_delete FROM conversations),
last AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY tx, key ORDER BY turn DESC) = 1)
SELECT CAST(tx AS BIGINT) AS tx_id, key, value FROM last WHERE NOT is_delete""")
def transact_batch(spark, sf):
    """Each conversation is a transaction on its own keys: an array of operations, taken apart in order."""
    op = F.struct("turn", F.col("role").alias("key"), F.md5("text").alias("value"), (F.col("turn") % 4 == 3).alias("is_delete"))
    batch = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("tx_id")).agg(F.sort_array(F.collect_list(op)).alias("ops"))
    rows = batch.select("tx_id", F.posexplode("ops").alias("pos", "op")).select(F.col("tx_id").cast("long").alias("tx_id"), "pos", "op.key", "op.value", "op.is_delete")
    return resolve.latest(rows, ["tx_id", "key"], "pos").where(~F.col("is_delete")).select("tx_id", "key", "value")


def split(log: DataFrame, n: int) -> list[DataFrame]:
    return [log.where(F.col("seq") % n == i) for i in range(n)]


_MERGED = f"WITH {LATEST} SELECT key, CASE WHEN is_delete THEN NULL ELSE value END AS value, is_delete, seq FROM latest"


@query(_MERGED)
def merge_two_runs(spark, sf):
    return resolve.merge(*split(changes(spark, sf), 2)).select("key", "value", "is_delete", "seq")


@query(_MERGED)
def kway_merge(spark, sf):
    return resolve.merge(*split(changes(spark, sf), 8)).select("key", "value", "is_delete", "seq")


@query(f"{LIVE} SELECT * FROM live")
def compact_drop_tombstones(spark, sf):
    a, b, c = split(changes(spark, sf), 3)
    upper = resolve.compact([a, b], AS_OF, bottom=False)
    return resolve.compact([upper, c], AS_OF, bottom=True).select("key", "value")


def scratch(spark: SparkSession) -> str:
    """A new folder which all executors share: in spark.checkpoint.dir, and only without that a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='keytide-')).rstrip('/')}/{uuid.uuid4().hex}"


def loaded(spark: SparkSession, sf: str, parts: int, log: DataFrame | None = None, **options) -> KvStore:
    store = KvStore.open(spark, scratch(spark), {"max_runs": 3} | options)
    log = (changes(spark, sf) if log is None else log).withColumn("value", F.col("value").cast("string"))
    edges = log.agg(F.min("seq"), F.max("seq")).first()
    step = max(1, (edges[1] - edges[0]) // parts + 1)
    for lo in range(edges[0], edges[1] + 1, step):
        store.put_df(log.where(F.col("seq").between(lo, lo + step - 1)).withColumn("seq", F.col("seq") - lo))
    return store


@query(f"{LIVE} SELECT key, value FROM live")
def flush_equivalence(spark, sf):
    """The state read back from a store of several merged runs."""
    s = loaded(spark, sf, 4)
    return s.state(AS_OF).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").cast("double").alias("value"))


@query(f"WITH {LATEST} SELECT key, value, t + nullif(coalesce(ttl, 0), 0) AS expire_at FROM latest WHERE NOT is_delete AND (ttl IS NULL OR t + ttl >= {AS_OF})")
def store_ttl(spark, sf):
    """The state of a store whose changes have lifetimes, 0 among them, which means none."""
    log = as_changes(table(spark, sf, "events"), key=padded_key(F.col("user_id")), seq=F.col("event_id"), value=F.col("value"), is_delete=F.col("event_type") == "error", now=seconds(), key_ttl=F.coalesce(key_ttl(), F.lit(0)))
    # Merging drops what has expired by the clock, which is far ahead of these events.
    s = loaded(spark, sf, 3, log, max_runs=9)
    return s.state(AS_OF).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").cast("double").alias("value"), "expire_at")


@query(f"{LIVE}, n AS (SELECT count(*) AS rows FROM live) SELECT rows, CAST(0 AS BIGINT) AS deletes, CAST(ceil(log2(greatest(rows, 16) / 16.0)) AS INT) AS level, (SELECT min(key) FROM live) AS low, (SELECT max(key) FROM live) AS high FROM n")
def store_levels(spark, sf):
    """The one run of a store that is compacted: its rows, and the level which its size gives it (16 rows at level 0, twice as many at each next)."""
    s = loaded(spark, sf, 5, min_run_rows=16, max_runs=2)
    s.compact(AS_OF)
    key = lambda c: F.decode(F.unhex(c), "UTF-8")
    return s.describe_levels().select("rows", "deletes", "level", key("min_key").alias("low"), key("max_key").alias("high"))


def plain(state: DataFrame) -> DataFrame:
    """Rows of a store with key and value as text and number."""
    return state.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").cast("double").alias("value"))


@query(f"{LIVE} SELECT key, value FROM live")
def store_reopen(spark, sf):
    """A compressed store that is closed, opened again under a name, and read by that name as a view."""
    s = loaded(spark, sf, 2, compression="gzip")
    s.close()
    name = f"kv_{uuid.uuid4().hex}"
    KvStore.open(spark, s.path, {"compression": "gzip"}, name=name)
    return plain(spark.table(name))


@query("SELECT CAST(0 AS BIGINT) AS left_over, true AS refused")
def store_destroy(spark, sf):
    """After a store is destroyed nothing of it is left, and it takes no changes."""
    s = loaded(spark, sf, 1)
    s.destroy()
    try:
        s.put(b"k", b"v")
        refused = False
    except ValueError:
        refused = True
    fs, path = s._fs(s.path)
    return spark.createDataFrame([(int(fs.exists(path)), refused)], "left_over long, refused boolean")


@query(f"{LIVE} SELECT key, value FROM live WHERE key >= '000000000020' AND key < '000000000060' AND key NOT IN ('000000000030', '000000000040') UNION ALL SELECT * FROM (VALUES ('000000000030', 1.5), ('0000000000405', 2.5)) t(key, value)")
def store_range_pending(spark, sf):
    """A range scan sees changes that were gathered and not yet committed: two puts and a delete over the committed state."""
    s = loaded(spark, sf, 2, sync_seconds=3600.0)
    s.put(b"000000000030", b"1.5")
    s.put(b"0000000000405", b"2.5")
    s.delete(b"000000000040")
    return plain(s.range(KeyRange("000000000020", "000000000060"), AS_OF))


@query(f"{LIVE} SELECT key, value FROM live WHERE key NOT IN ('000000000001', '000000000002') UNION ALL SELECT '000000000001', 3.0")
def store_transact(spark, sf):
    """One transaction over a store: of two changes of a key the later one counts."""
    s = loaded(spark, sf, 1)
    s.transact([("put", b"000000000001", b"1"), ("put", b"000000000002", b"2"), ("put", b"000000000001", b"3"), ("delete", b"000000000002")])
    return plain(s.state(AS_OF))


@query(f"{LIVE} SELECT key, value FROM live WHERE key > '000000000050' ORDER BY key LIMIT 1")
def store_seek(spark, sf):
    """The first visible key after a given one; runs and pages that end before it aren't read."""
    return plain(loaded(spark, sf, 2).range(KeyRange("000000000050", lo_inclusive=False, limit=1), AS_OF))


@query(f"""WITH {CHG}, cut AS (SELECT min(seq) + 2 * ((max(seq) - min(seq)) // 4 + 1) AS x FROM chg)
SELECT key, value FROM (SELECT * FROM chg WHERE seq < (SELECT x FROM cut) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT is_delete""")
def store_snapshot(spark, sf):
    """The state of a store as its second of four commits left it."""
    return plain(loaded(spark, sf, 4, max_runs=9).state(AS_OF, version=2))


@query("SELECT (SELECT count(*) FROM events) AS before, CAST(0 AS BIGINT) AS after")
def store_unmerged(spark, sf):
    """Rows in levels of more than one run, before and after compaction."""
    s = loaded(spark, sf, 3, max_runs=9)
    before = s.unmerged_count()
    s.compact(AS_OF)
    return spark.createDataFrame([(before, s.unmerged_count())], "before long, after long")


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS descents FROM events")
def run_key_order(spark, sf):
    """Files of runs hold their keys in ascending order, as the rows' places in the files show."""
    from pyspark.sql import Window

    rows = loaded(spark, sf, 2, max_runs=9).changes().select("key", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    before = F.lag("key").over(Window.partitionBy("f").orderBy("i"))
    return rows.withColumn("b", before).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("b") > F.col("key")).alias("descents"))


@query(f"{LIVE} SELECT count(*) AS visible, 1 AS removed FROM live")
def store_recovery(spark, sf):
    """A run that was written before its writer stopped, and that no manifest names, isn't read; vacuum deletes it and nothing else."""
    s = loaded(spark, sf, 2, max_runs=9)
    s._write_run(s.changes().withColumn("is_delete", F.lit(True)).withColumn("seq", F.col("seq") + 1_000_000_000), 0)
    again = KvStore.open(spark, s.path, {"max_runs": 9})
    visible, removed = again.state(AS_OF).count(), len(again.vacuum())
    return again.state(AS_OF).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == visible).select(F.col("n").alias("visible"), F.lit(removed).alias("removed"))


@query(f"{LIVE} SELECT key, value FROM live")
def store_predictable(spark, sf):
    """Small levels of which each commit merges one at most, caught up when the store is opened again."""
    s = loaded(spark, sf, 4, max_runs=2, min_run_rows=16, merge_strategy="predictable")
    return plain(KvStore.open(spark, s.path, {"max_runs": 2, "min_run_rows": 16}).state(AS_OF))


@query(f"{LIVE} SELECT key, value FROM live")
def store_merge_budget(spark, sf):
    """Commits that merge two runs each, as their budget of rows is below any run, and the state behind them."""
    s = loaded(spark, sf, 4, max_runs=3, merge_strategy="predictable", merge_rows=1)
    return plain(s.state(AS_OF))


@query("SELECT CAST(1 AS BIGINT) AS commits, CAST(2 AS BIGINT) AS rows")
def store_timed_sync(spark, sf):
    """Two changes that are gathered are committed together by the timer, without another call."""
    s = KvStore.open(spark, scratch(spark), {"sync_seconds": 1.0})
    s.put(b"a", b"1")
    s.put(b"b", b"2")
    until = time.monotonic() + 120
    while not s.versions() and time.monotonic() < until:
        time.sleep(0.1)
    m = s.manifest()
    return spark.createDataFrame([(m.version, sum(r.rows for r in m.runs))], "commits long, rows long")


@query("SELECT * FROM (VALUES ('bloom', 'False'), ('max_runs', '7'), ('page_size', '4096'), ('sync_seconds', '2.5')) t(name, value)")
def session_options(spark, sf):
    """Options of a store: one given at opening comes before that of the session, and words become the option's type."""
    given = {"bloom": "false", "max_runs": "5", "page_size": "4096", "sync_seconds": "2.5"}
    for k, v in given.items():
        spark.conf.set(f"spark.keytide.{k}", v)
    try:
        o = Options.of({"max_runs": 7}, spark)
    finally:
        for k in given:
            spark.conf.unset(f"spark.keytide.{k}")
    return spark.createDataFrame([(k, repr(getattr(o, k))) for k in given], "name string, value string")


@query(f"{LIVE} SELECT coalesce(max(n), 0) AS seen, max(key) AS last FROM (SELECT key, row_number() OVER (ORDER BY key) AS n FROM live) WHERE n <= 17")
def fold_until(spark, sf):
    """A fold by a Python function that stops once it has seen 17 rows."""
    seen, last = reads.fold_iter(live(spark, sf), KeyRange(), lambda k, v, a: (a[0] + 1, k), (0, None), until=lambda a: a[0] == 17)
    return spark.createDataFrame([(seen, last)], "seen long, last string")


@query(f"WITH {CHG} SELECT key, value FROM (SELECT * FROM chg WHERE seq <= (SELECT (min(seq) + max(seq)) // 2 FROM chg) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT is_delete")
def snapshot_asof(spark, sf):
    log = changes(spark, sf)
    lo, hi = log.agg(F.min("seq"), F.max("seq")).first()
    return resolve.state(log, AS_OF, upto=(lo + hi) // 2).select("key", "value")


@query("""WITH probes AS (SELECT DISTINCT CAST(floor(l_extendedprice) AS BIGINT) AS probe FROM lineitem), t AS (SELECT CAST(floor(o_totalprice) AS BIGINT) AS key, max(o_orderkey) AS value FROM orders GROUP BY 1)
SELECT probe, t.key, t.value FROM probes ASOF LEFT JOIN t ON probe >= t.key""")
def floor_lookup(spark, sf):
    probes = table(spark, sf, "lineitem").select(F.floor("l_extendedprice").alias("key")).distinct()
    t = table(spark, sf, "orders").groupBy(F.floor("o_totalprice").alias("key")).agg(F.max("o_orderkey").alias("value"))
    return reads.floor_lookup(t, probes, buckets=reads.edges(t, 64))


@query(f"{LIVE} SELECT * FROM live")
def page_dict_roundtrip(spark, sf):
    """The state as dictionaries of up to ten keys, and as pairs again."""
    return reads.dict_entries(reads.dict_build(live(spark, sf).select("key", "value"), F.substring("key", 1, 11)))


@query(f"{LIVE}, wanted AS (SELECT DISTINCT lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS key FROM orders) SELECT w.key, l.value FROM wanted w LEFT JOIN live l USING (key)")
def page_dict_find(spark, sf):
    """Many keys sought in dictionaries of up to a hundred keys, by bisection."""
    by = F.substring("key", 1, 10)
    return reads.dict_find(reads.dict_build(live(spark, sf).select("key", "value"), by), table(spark, sf, "orders").select(padded_key(F.col("o_custkey")).alias("key")).distinct(), by)


@query("SELECT name, TRY_CAST(nullif(regexp_extract(name, '^[^0-9]+-([0-9]+)\\.data$', 1), '') AS INT) AS level FROM (SELECT concat('A-', n_nationkey, '.data') AS name FROM nation UNION ALL SELECT n_name FROM nation)")
def parse_level(spark, sf):
    n = table(spark, sf, "nation")
    names = n.select(F.concat(F.lit("A-"), "n_nationkey", F.lit(".data")).alias("name")).union(n.select("n_name"))
    return names.select("name", level_of(F.col("name")).alias("level"))


@query(f"{LIVE} SELECT min(key) AS key FROM live")
def first_key(spark, sf):
    return reads.first_key(live(spark, sf))


@query("""WITH a AS (SELECT o_custkey AS key, sum(o_totalprice) AS value FROM orders GROUP BY 1), b AS (SELECT c_custkey AS key, c_acctbal AS value FROM customer)
SELECT key, round(CASE WHEN a.value IS NULL THEN b.value WHEN b.value IS NULL THEN a.value ELSE a.value + b.value END, 2) AS value FROM a FULL JOIN b USING (key)""")
def dict_merge_resolver(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.sum("o_totalprice").alias("value"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return reads.dict_merge(a, b, lambda x, y: x + y).withColumn("value", F.round("value", 2))


@query(f"WITH {CHG} SELECT key, CASE WHEN is_delete THEN NULL ELSE value END AS value, is_delete, seq FROM chg WHERE key < '000000000050'")
def raw_versions_scan(spark, sf):
    return changes(spark, sf).where(KeyRange(hi="000000000050").predicate()).select("key", "value", "is_delete", "seq")


@query(f"WITH {CHG} SELECT seq % 8 AS run, count(*) AS changes, count(*) FILTER (is_delete) AS deletes, min(key) AS low, max(key) AS high, CAST(sum(length(key) + 8) AS BIGINT) AS bytes FROM chg GROUP BY 1")
def run_stats(spark, sf):
    return changes(spark, sf).groupBy((F.col("seq") % 8).alias("run")).agg(F.count(F.lit(1)).alias("changes"), F.count_if("is_delete").alias("deletes"), F.min("key").alias("low"), F.max("key").alias("high"), F.sum(entry_size(F.col("key"), F.lit(8))).alias("bytes"))


@query()
def crc_frame(spark, sf):
    """Log frames of all changes, and whether each reads back whole and a torn one is noticed. No CRC in DuckDB: tested against zlib."""
    log = changes(spark, sf, "key").select("seq", F.col("key").cast("binary").alias("key"), F.col("value").cast("string").cast("binary").alias("value"), "is_delete", "expire_at")
    framed = log.select("seq", frame(payload(F.col("key"), F.col("value"), F.col("is_delete"), F.col("expire_at"))).alias("f"))
    torn = F.expr("substring(f, 1, octet_length(f) - 1)")
    return framed.select("seq", F.octet_length("f").alias("bytes"), F.hex("f").alias("frame"), frame_ok(F.col("f")).alias("sound"), frame_ok(torn).alias("torn_sound"))


@query(f"{LIVE} SELECT key, value FROM live")
def wal_replay(spark, sf):
    """All changes as log files of a thousand frames, read back and resolved."""
    from keytide.sources import wal

    ship(spark)
    log = changes(spark, sf).select("seq", F.col("key").cast("binary").alias("key"), F.col("value").cast("string").cast("binary").alias("value"), "is_delete", "expire_at")
    files = wal.encode(log).groupBy(F.floor(F.col("seq") / 1000).alias("n")).agg(F.sort_array(F.collect_list(F.struct("seq", "frame"))).alias("f"))
    files = files.select(F.lpad(F.col("n").cast("string"), 15, "0").alias("path"), F.aggregate("f", F.lit(bytearray()), lambda a, x: F.concat(a, x["frame"])).alias("content"))
    read = wal.replay(files).where("broken = 0").withColumn("seq", F.concat("path", F.lpad(F.col("pos").cast("string"), 15, "0")))
    return resolve.state(read, AS_OF).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").cast("double").alias("value"))


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a session."""
    if getattr(spark.sparkContext, "_keytide_shipped", False):
        return
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="keytide-")) / "keytide.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._keytide_shipped = True


@query("SELECT count(*) AS keys, count(*) AS found FROM (SELECT DISTINCT user_id FROM events)")
def bloom_no_false_negative(spark, sf):
    keys = table(spark, sf, "events").select(padded_key(F.col("user_id")).alias("key")).distinct()
    n = keys.count()
    return blooms.contains(keys, blooms.build(keys, n), n).agg(F.count(F.lit(1)).alias("keys"), F.count_if("maybe").alias("found"))


@query("SELECT count(*) AS keys, count(*) AS found FROM (SELECT DISTINCT user_id FROM events)")
def bloom_encode_decode(spark, sf):
    """A filter that was written as checksummed binaries and read again still has all keys."""
    keys = table(spark, sf, "events").select(padded_key(F.col("user_id")).alias("key")).distinct()
    n = keys.count()
    again = blooms.decode(blooms.encode(blooms.build(keys, n), n), n)
    return blooms.contains(keys, again, n).agg(F.count(F.lit(1)).alias("keys"), F.count_if("maybe").alias("found"))


@query("SELECT count(*) AS keys, count(*) AS found FROM (SELECT DISTINCT user_id AS k FROM events UNION SELECT -c_custkey FROM customer)")
def bloom_scalable(spark, sf):
    """Filters of growing size that take two sets of keys one after the other."""
    a = table(spark, sf, "events").select(padded_key(F.col("user_id")).alias("key")).distinct()
    b = table(spark, sf, "customer").select(padded_key(-F.col("c_custkey")).alias("key")).distinct()
    both = blooms.ScalableBloom(first=64).add(a, a.count()).add(b, b.count())
    return both.contains(a.union(b)).agg(F.count(F.lit(1)).alias("keys"), F.count_if("maybe").alias("found"))


@query(f"{LIVE} SELECT key, value FROM live")
def stream_ingest_state(spark, sf):
    """The event table as a file stream, folded into a table of newest changes batch by batch."""
    events = table(spark, sf, "events")
    raw = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    log = as_changes(raw, key=padded_key(F.col("user_id")), seq=F.col("event_id"), value=F.col("value"), is_delete=F.col("event_type") == "error", now=seconds())
    base = scratch(spark)
    return resolve.visible(ingest.ingest_state(log, f"{base}/state", f"{base}/checkpoint"), AS_OF).select("key", "value")
