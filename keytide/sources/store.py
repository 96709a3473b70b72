"""A store: immutable runs of changes in Parquet, sorted by key, under numbered manifests.

Each commit writes its run first and then creates the next manifest by a rename that fails if the name is taken (so on
HDFS and local disks; object stores rename by copying, and there nothing but having one writer keeps two commits apart);
readers pin a manifest and so see one snapshot. A crash between the two leaves a folder that no manifest names, which
``vacuum`` deletes. One writer at a time, as many readers as there are.

Levels go by size: a run of level n has at most ``min_run_rows * 2^n`` rows. Merging the runs of a level gives one run, which
stays at its level if it fits there and goes up if not. Pages carry checksums, and reading a page with a wrong one fails.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keytide.operators import reads, resolve
from keytide.plans.keyrange import KeyRange
from keytide.plans.schema import CHANGES, COLUMNS, MAX_KEY, lifetime


def parse_level(name: str) -> int | None:
    """Level of a run that a file name like ``A-12.data`` tells; None for other names."""
    m = re.fullmatch(r"[^0-9]+-([0-9]+)\.data", name)
    return int(m[1]) if m else None


def typed(value, default):
    """A setting of the session (a string) as the type of its default; booleans are true, false, yes, no, on, off, 1 or 0."""
    if not isinstance(value, str) or default is None:
        return value
    if isinstance(default, bool):
        word = value.strip().lower()
        if word not in ("true", "yes", "on", "1", "false", "no", "off", "0"):
            raise ValueError(f"{value!r} is no boolean")
        return word in ("true", "yes", "on", "1")
    return type(default)(value)


def get_opt(name: str, options: dict, spark: SparkSession | None = None, default=None):
    """An option given at opening, else of the session (``spark.keytide.<name>``), else the default."""
    if name in options:
        return options[name]
    value = spark.conf.get(f"spark.keytide.{name}", None) if spark else None
    return default if value is None else typed(value, default)


@dataclass
class Options:
    compression: str = "none"
    page_size: int = 8192
    block_size: int = 128 << 20
    expiry_secs: int = 0
    #: Runs of a level before they are merged; most rows of a run of the smallest level.
    max_runs: int = 4
    min_run_rows: int = 1 << 20
    #: "fast" merges what is due at once, "predictable" at most one level for each commit.
    merge_strategy: str = "fast"
    #: Most rows that "predictable" merges in a commit (two runs at least); 0 sets no bound.
    merge_rows: int = 0
    #: None commits every change; a number of seconds lets ``put`` and ``delete`` gather changes for that long, after which
    #: a timer commits them.
    sync_seconds: float | None = None
    #: A filter on keys in each run, for point lookups.
    bloom: bool = True

    @classmethod
    def of(cls, options: dict, spark: SparkSession) -> Options:
        out = cls(**{k: get_opt(k, options, spark, v) for k, v in asdict(cls()).items()})
        if isinstance(out.sync_seconds, str):
            out.sync_seconds = None if out.sync_seconds.lower() in ("", "none") else float(out.sync_seconds)
        if out.compression not in ("none", "gzip", "snappy", "lz4") or out.merge_strategy not in ("fast", "predictable") or out.expiry_secs < 0 or out.merge_rows < 0:
            raise ValueError(f"bad options: {out}")
        return out


@dataclass(frozen=True)
class Run:
    id: str
    level: int
    rows: int
    deletes: int
    min_key: str
    max_key: str
    min_seq: int
    max_seq: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_seq: int = 1
    runs: tuple[Run, ...] = field(default=())


class KvStore:
    _names: dict[str, KvStore] = {}

    def __init__(self, spark: SparkSession, path: str, options: dict | None = None) -> None:
        self.spark, self.path, self.opts = spark, path.rstrip("/"), Options.of(options or {}, spark)
        self._pending: list[tuple] = []
        self._timer: threading.Timer | None = None
        self._lock = threading.RLock()
        self._open = True
        self._mkdirs(f"{self.path}/manifest")

    # Opening and closing

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: dict | None = None, name: str | None = None) -> KvStore:
        """Open or create a store; levels that a stopped writer left full are merged."""
        store = cls(spark, path, options)
        store.merge_due()
        if name:
            cls._names[name] = store
            store.register(name)
        return store

    @classmethod
    def named(cls, name: str) -> KvStore:
        return cls._names[name]

    def __enter__(self) -> KvStore:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        """Commit what is pending; closing twice does nothing."""
        if self._open:
            self.flush()
            self._open = False

    def destroy(self) -> None:
        if not self._fs(f"{self.path}/manifest")[0].exists(self._fs(f"{self.path}/manifest")[1]):
            raise ValueError(f"{self.path} is not a store")
        fs, p = self._fs(self.path)
        fs.delete(p, True)
        with self._lock:
            self._pending, self._open = [], False
            if self._timer:
                self._timer.cancel()

    # Files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _mkdirs(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.mkdirs(p)

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/manifest")
        return sorted(int(n[:-5]) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            have = self.versions()
            if not have:
                return Manifest()
            version = have[-1]
        fs, p = self._fs(f"{self.path}/manifest/{version:012d}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        m = json.loads(text)
        return Manifest(m["version"], m["next_seq"], tuple(Run(**r) for r in m["runs"]))

    def _commit(self, old: Manifest, next_seq: int, runs: tuple[Run, ...]) -> Manifest:
        new = Manifest(old.version + 1, next_seq, runs)
        fs, p = self._fs(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/manifest/{new.version:012d}.json")
        if fs.exists(final) or not fs.rename(p, final):
            fs.delete(p, False)
            raise RuntimeError(f"another writer has committed version {new.version} of {self.path}")
        return new

    # Writing

    def capacity(self, level: int) -> int:
        return self.opts.min_run_rows << level

    def _write_run(self, changes: DataFrame, level: int, grows: bool = False) -> Run | None:
        """Write a run in key order and describe it from what was written. AQE chooses the number of files by size.

        With ``grows`` the run goes to the lowest level from ``level`` on that its rows fit in.
        """
        run, o, seen = uuid.uuid4().hex, self.opts, Observation()
        figures = (
            F.count(F.lit(1)).alias("rows"), F.count_if("is_delete").alias("deletes"), F.hex(F.min("key")).alias("lo"), F.hex(F.max("key")).alias("hi"),
            F.min("seq").alias("a"), F.max("seq").alias("b"), F.max(F.octet_length("key")).alias("longest"),
        )
        rows = changes.select(*COLUMNS).repartitionByRange("key").sortWithinPartitions("key").observe(seen, *figures)
        w = rows.write.option("compression", {"lz4": "lz4_raw"}.get(o.compression, o.compression))
        w = w.option("parquet.page.size", o.page_size).option("parquet.block.size", o.block_size).option("parquet.page.write-checksum.enabled", "true")
        if o.bloom:
            w = w.option("parquet.bloom.filter.enabled#key", "true")
        w.parquet(f"{self.path}/runs/{run}")
        s = seen.get
        if not s.get("rows"):
            # An empty plan may end without figures.
            s = self._read(run).agg(*figures).first().asDict()
        if not s["rows"] or s["longest"] > MAX_KEY:
            fs, p = self._fs(f"{self.path}/runs/{run}")
            fs.delete(p, True)
            if s["rows"]:
                raise ValueError(f"a key has {s['longest']} bytes; the most is {MAX_KEY}")
            return None
        while grows and s["rows"] > self.capacity(level):
            level += 1
        return Run(run, level, s["rows"], s["deletes"], s["lo"], s["hi"], s["a"], s["b"])

    def _scan(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(CHANGES).option("parquet.page.verify-checksum.enabled", "true").parquet(*paths)

    def _read(self, run: str) -> DataFrame:
        return self._scan([f"{self.path}/runs/{run}"])

    def put_df(self, changes: DataFrame) -> Manifest:
        """Commit a batch as one unit. Columns: key, value, seq (order within the batch, from 0, unique for each key), and if wanted
        is_delete, tx_id, expire_at."""
        m = self.manifest()
        has = set(changes.columns)
        if "seq" not in has:
            raise ValueError("a batch needs a column seq, the order of its changes; Spark knows no order of rows that holds when a task runs again")
        opt = lambda c, kind, d=None: F.col(c).cast(kind) if c in has else F.lit(d).cast(kind)
        order = F.col("seq").cast("long")
        rows = changes.select(
            F.col("key").cast("binary").alias("key"), opt("value", "binary").alias("value"), F.coalesce(opt("is_delete", "boolean", False), F.lit(False)).alias("is_delete"),
            (order + m.next_seq).alias("seq"), opt("tx_id", "long").alias("tx_id"), opt("expire_at", "long").alias("expire_at"),
        )
        if self.opts.expiry_secs:
            rows = rows.withColumn("expire_at", F.least("expire_at", F.unix_timestamp() + lifetime(None, self.opts.expiry_secs)))
        run = self._write_run(rows, 0)
        if run is None:
            return m
        return self.merge_due(self._commit(m, run.max_seq + 1, (*m.runs, run)))

    def put(self, key: bytes, value: bytes, ttl: int | None = None) -> None:
        self._add((key, value, False, ttl))

    def delete(self, key: bytes) -> None:
        self._add((key, None, True, None))

    def transact(self, ops: list[tuple]) -> None:
        """[("put", key, value) | ("delete", key), ...]: all or nothing; of two changes of a key the later one counts."""
        rows = [(o[1], o[2], False, None) if o[0] == "put" else (o[1], None, True, None) for o in ops]
        if rows:
            self.flush()
            self._write_rows(rows, self.manifest().next_seq)

    def _add(self, row: tuple) -> None:
        if len(row[0]) > MAX_KEY:
            raise ValueError(f"a key has at most {MAX_KEY} bytes")
        with self._lock:
            if not self._open:
                raise ValueError("the store is closed")
            # A lifetime of 0 is none.
            self._pending.append((*row[:3], int(time.time()) + row[3] if row[3] else None))
            if self.opts.sync_seconds is None:
                self.flush()
            elif self._timer is None:
                self._timer = threading.Timer(self.opts.sync_seconds, self.flush)
                self._timer.daemon = True
                self._timer.start()

    def flush(self) -> None:
        """Commit what is pending, if anything."""
        with self._lock:
            rows, self._pending = self._pending, []
            if self._timer:
                self._timer.cancel()
                self._timer = None
            if rows:
                self._write_rows(rows, None)

    def _write_rows(self, rows: list[tuple], tx: int | None) -> None:
        data = [(bytearray(k), None if v is None else bytearray(v), d, i, tx, e) for i, (k, v, d, e) in enumerate(rows)]
        self.put_df(self.spark.createDataFrame(data, CHANGES))

    # Reading

    def changes(self, version: int | None = None, within: KeyRange | None = None) -> DataFrame:
        """Raw changes of a snapshot; runs whose keys can't meet the interval aren't opened."""
        if version is None:
            self.flush()
        runs = [r for r in self.manifest(version).runs if within is None or within.meets(r.min_key, r.max_key)]
        paths = [f"{self.path}/runs/{r.id}" for r in runs]
        return self._scan(paths) if paths else self.spark.createDataFrame([], CHANGES)

    def state(self, as_of: Column | int | None = None, version: int | None = None) -> DataFrame:
        return resolve.state(self.changes(version), as_of)

    def register(self, view: str) -> None:
        self.state().createOrReplaceTempView(view)

    def get(self, key: bytes, as_of: int | None = None) -> bytes | None:
        at = KeyRange(key, key, hi_inclusive=True)
        row = reads.get(resolve.state(self.changes(within=at).where(at.predicate()), as_of), key).select("value").first()
        return None if row is None else bytes(row.value)

    lookup = get

    def multi_get(self, keys: DataFrame, as_of: int | None = None) -> DataFrame:
        return reads.multi_get(self.state(as_of), keys)

    def range(self, r: KeyRange, as_of: int | None = None, version: int | None = None) -> DataFrame:
        return reads.scan(resolve.state(self.changes(version, r).where(r.predicate()), as_of), r)

    def fold_range(self, fun: Callable, acc, r: KeyRange, as_of: int | None = None, until: Callable | None = None):
        return reads.fold_iter(resolve.state(self.changes(within=r).where(r.predicate()), as_of), r, fun, acc, until)

    def fold(self, fun: Callable, acc, as_of: int | None = None):
        return self.fold_range(fun, acc, KeyRange(), as_of)

    # Merging

    def merge_due(self, m: Manifest | None = None, as_of: int | None = None) -> Manifest:
        """Merge the runs of each level that holds ``max_runs`` into one (of one level only if "predictable", and of its oldest
        runs only so many as ``merge_rows`` lets it)."""
        m = m or self.manifest()
        level = 0
        while level <= max((r.level for r in m.runs), default=-1):
            due = [r for r in m.runs if r.level == level]
            if len(due) >= self.opts.max_runs:
                m = self._merge(m, self._within_budget(due), level, as_of)
                if self.opts.merge_strategy == "predictable":
                    break
            level += 1
        return m

    def _within_budget(self, due: list[Run]) -> list[Run]:
        if self.opts.merge_strategy != "predictable" or not self.opts.merge_rows:
            return due
        due, n, rows = sorted(due, key=lambda r: r.min_seq), 0, 0
        while n < len(due) and (n < 2 or rows + due[n].rows <= self.opts.merge_rows):
            rows += due[n].rows
            n += 1
        return due[:n]

    def compact(self, as_of: int | None = None) -> Manifest:
        """Merge all runs into one, without deletes and expired changes."""
        self.flush()
        m = self.manifest()
        return self._merge(m, list(m.runs), 0, as_of) if m.runs else m

    def _merge(self, m: Manifest, due: list[Run], level: int, as_of: int | None) -> Manifest:
        ids = {r.id for r in due}
        newest = max(r.max_seq for r in due)
        # Nothing older may be left in other runs, or what a delete hides would come back.
        bottom = not any(r.min_seq <= newest for r in m.runs if r.id not in ids)
        merged = resolve.compact([self._read(r.id) for r in due], as_of if as_of is not None else int(time.time()), bottom)
        run = self._write_run(merged, level, grows=True)
        rest = tuple(r for r in m.runs if r.id not in ids)
        return self._commit(m, m.next_seq, (run, *rest) if run else rest)

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Delete old manifests and the runs that no kept one names; returns the runs' ids."""
        have = self.versions()
        keep = {r.id for v in have[-keep_versions:] for r in self.manifest(v).runs}
        for v in have[:-keep_versions]:
            fs, p = self._fs(f"{self.path}/manifest/{v:012d}.json")
            fs.delete(p, False)
        fs, p = self._fs(f"{self.path}/manifest")
        for n in (s.getPath() for s in fs.listStatus(p)):
            if n.getName().startswith("."):
                fs.delete(n, False)
        fs, p = self._fs(f"{self.path}/runs")
        gone = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        gone = [n for n in gone if n not in keep]
        for n in gone:
            fs.delete(self._fs(f"{self.path}/runs/{n}")[1], True)
        return gone

    def describe_levels(self) -> DataFrame:
        schema = "id string, level int, rows long, deletes long, min_key string, max_key string, min_seq long, max_seq long"
        return self.spark.createDataFrame([tuple(asdict(r).values()) for r in self.manifest().runs], schema)

    def unmerged_count(self) -> int:
        """Rows of the levels that hold more than one run."""
        runs = self.manifest().runs
        return sum(r.rows for r in runs if sum(x.level == r.level for x in runs) > 1)
