"""The store against a dict, whatever is flushed, merged or reopened in between, and the semantics of single operators."""

import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from keytide.functions import bloom, codec
from keytide.operators import reads, resolve
from keytide.plans.keyrange import KeyRange, prefix
from keytide.plans.schema import CHANGES, int_key, lifetime
from keytide.sources import wal
from keytide.sources.store import KvStore, get_opt, parse_level
from keytide.streaming import ingest


def rows(spark, data):
    """(key, value | None for a delete, seq, expire_at)."""
    return spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), v is None, s, None, e) for k, v, s, e in data], CHANGES)


def pairs(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.orderBy("key").collect()]


def test_single_changes(spark, tmp_path):
    with KvStore.open(spark, str(tmp_path / "s"), name="view1") as s:
        s.put(b"", b"data77")
        s.put("é".encode(), "ü".encode())
        assert s.get(b"") == b"data77" and s.lookup("é".encode()) == "ü".encode()
        s.delete("é".encode())
        s.delete(b"never there")
        assert s.get("é".encode()) is None and s.get(b"x") is None
        s.transact([])
        s.transact([("put", b"a", b"1"), ("put", b"a", b"2"), ("put", b"b", b"1"), ("delete", b"b")])
        assert s.get(b"a") == b"2" and s.get(b"b") is None
        assert KvStore.named("view1") is s
    s.close()
    again = KvStore.open(spark, str(tmp_path / "s"))
    assert pairs(again.state()) == [(b"", b"data77"), (b"a", b"2")]
    again.destroy()
    assert not (tmp_path / "s").exists()
    with pytest.raises(ValueError):
        again._fs and KvStore.destroy(_Bare(spark, str(tmp_path)))


class _Bare(KvStore):
    def __init__(self, spark, path):
        self.spark, self.path = spark, path


def test_model(spark, tmp_path):
    r, model, path = random.Random(5), {}, str(tmp_path / "m")
    s = KvStore.open(spark, path, {"max_runs": 3})
    for step in range(12):
        batch = []
        for i in range(40):
            k = bytes([r.randrange(4), r.choice([0, 0x7F, 0x80, 0xFF])][: r.randrange(1, 3)])
            v = None if r.random() < 0.25 else b"v%d.%d" % (step, i)
            batch.append((k, v, i, None))
            model.pop(k, None)
            if v is not None:
                model[k] = v
        s.put_df(rows(spark, batch))
        if step % 5 == 4:
            s.compact()
        if step % 4 == 3:
            s.close()
            s = KvStore.open(spark, path, {"max_runs": 3, "merge_strategy": "predictable"})
    assert pairs(s.state()) == sorted(model.items())
    lo, hi = b"\x01", b"\x02\x80"
    inside = [(k, v) for k, v in sorted(model.items()) if lo <= k < hi]
    assert pairs(s.range(KeyRange(lo, hi))) == inside
    assert s.fold_range(lambda k, v, acc: acc + [bytes(k)], [], KeyRange(lo, hi, limit=3)) == [k for k, _ in inside][:3]
    assert s.fold(lambda k, v, n: n + 1, 0) == len(model)
    assert [bytes(x.key) for p in reads.pages(s.state(), KeyRange(), 3) for x in p] == sorted(model)
    old = s.manifest().version
    before = pairs(s.state())
    s.put(b"new", b"1")
    assert pairs(s.state(version=old)) == before
    s.vacuum()
    assert pairs(s.state()) == sorted([*before, (b"new", b"1")]) and s.describe_levels().count() == len(s.manifest().runs)
    assert s.unmerged_count() >= 0


def test_two_writers_cannot_commit_the_same_version(spark, tmp_path):
    s = KvStore.open(spark, str(tmp_path / "w"))
    m = s.manifest()
    s.put(b"a", b"1")
    with pytest.raises(RuntimeError):
        s._commit(m, 5, ())


def test_expiry(spark):
    log = rows(spark, [(b"a", b"old", 1, None), (b"a", b"new", 2, 100), (b"b", b"x", 3, None), (b"b", None, 4, 100)])
    assert pairs(resolve.state(log, 100)) == [(b"a", b"new")]
    assert pairs(resolve.state(log, 101)) == []  # an expired put or delete hides what is older
    a, b = log.where("seq < 2"), log.where("seq >= 2")
    assert resolve.compact([b], 101, bottom=False).count() == 2 and resolve.compact([a, b], 101, bottom=True).count() == 0
    got = spark.range(1).select(*(lifetime(F.lit(k), d).alias(n) for n, k, d in (("x", 0, 0), ("y", 5, 0), ("z", 0, 7), ("w", 9, 7)))).first()
    assert tuple(got) == (None, 5, 7, 7)


def test_limit_counts_visible_rows_only(spark):
    log = rows(spark, [(bytes([i]), b"v", i, None) for i in range(20)] + [(bytes([i]), None, 100 + i, None) for i in range(0, 20, 2)])
    assert [k for k, _ in pairs(reads.scan(resolve.state(log, 0), KeyRange(limit=5)))] == [bytes([i]) for i in (1, 3, 5, 7, 9)]
    assert reads.scan(resolve.state(log, 0), KeyRange(limit=0)).count() == 0


def test_ranges_and_prefix(spark):
    keys = [b"", b"\x7f", b"\x7f\x00", b"\x80", b"\xff", b"\xff\xff"]
    t = rows(spark, [(k, b"v", i, None) for i, k in enumerate(keys)])
    for lo in keys:
        for hi in [*keys, None]:
            for a in (True, False):
                for b in (True, False):
                    r = KeyRange(lo, hi, a, b)
                    want = [k for k in keys if (k > lo or (a and k == lo)) and (hi is None or k < hi or (b and k == hi))]
                    assert all(r.meets(k.hex(), k.hex()) == (k in want) for k in keys)
    assert [k for k, _ in pairs(t.where(KeyRange(b"\x7f", b"\x80", False, True).predicate()))] == [b"\x7f\x00", b"\x80"]
    assert [k for k, _ in pairs(t.where(prefix(b"\xff").predicate()))] == [b"\xff", b"\xff\xff"]
    assert [k for k, _ in pairs(t.where(prefix(b"\x7f").predicate()))] == [b"\x7f", b"\x7f\x00"]


def test_two_runs_of_even_and_odd_keys(spark):
    key = int_key(F.col("id")).alias("key")
    run = lambda df, seq: df.select(key, F.lit(b"d").alias("value"), F.lit(False).alias("is_delete"), F.lit(seq).alias("seq"))
    assert resolve.merge(run(spark.range(1, 10000, 2), 1), run(spark.range(2, 5002), 2)).count() == 7500


def test_floor_lookup(spark):
    t = spark.createDataFrame([(k, k) for k in (2, 4, 6, 122)], "key int, value int")
    p = spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 100, 150)], "key int")
    for buckets in (None, [3, 5, 110]):
        assert {r.probe: r.key for r in reads.floor_lookup(t, p, buckets).collect()} == {1: None, 2: 2, 3: 2, 5: 4, 100: 6, 150: 122}


def framed(body):
    return len(body).to_bytes(4, "big") + zlib.crc32(body).to_bytes(4, "big") + body + b"\xff"


def test_log_format(spark):
    """Every kind of frame byte for byte, as the format has them."""
    log = rows(spark, [(b"key", b"value", 1, None), (b"abcdefgh", None, 2, None), (b"k", b"\xff\xff", 3, 99), (b"d", None, 4, 98), (b"", b"", 5, 1 << 40)])
    want = [
        framed(b"\x80\0\0\0\x03keyvalue"), framed(b"\x81abcdefgh"), framed(b"\x84\0\0\0\x63\0\0\0\x01k\xff\xff"), framed(b"\x85\0\0\0\x62d"), framed(b"\x84\xff\xff\xff\xff\0\0\0\0"),
    ]
    frames = [bytes(r.frame) for r in wal.encode(log).orderBy("seq").collect()]
    assert frames == want
    assert want[0].hex() == "0000000d" + f"{zlib.crc32(bytes.fromhex('80000000036b657976616c7565')):08x}" + "80000000036b657976616c7565" + "ff"
    at = spark.range(1).select(codec.pointer(F.lit(bytearray(b"k")), F.lit(1 << 33), F.lit(7)).alias("p")).first().p
    assert bytes(at) == b"\x82\0\0\0\x02\0\0\0\0\0\0\0\x07k"
    tx = bytes(spark.createDataFrame([([bytearray(f) for f in frames[:2]],)], "f array<binary>").select(codec.transaction(F.col("f"))).first()[0])
    assert tx == framed(b"\x83" + frames[0] + frames[1])


def test_log_replay(spark):
    log = rows(spark, [(b"a", b"1", 1, None), (b"b", None, 2, None), (b"c", b"\xff\xff", 3, 99), (b"d", None, 4, 98)])
    frames = [bytes(r.frame) for r in wal.encode(log).orderBy("seq").collect()]
    whole = [(b"a", b"1", False, None), (b"b", None, True, None), (b"c", b"\xff\xff", False, 99), (b"d", None, True, 98)]
    tx = framed(b"\x83" + b"".join(frames))
    assert list(codec.parse(b"".join(frames))) == whole and list(codec.parse(tx)) == whole
    # A torn or broken transaction gives none of its members, whatever stands around it.
    assert list(codec.parse(frames[0] + tx[:-3])) == [whole[0], None]
    assert list(codec.parse(framed(b"\x83" + frames[0] + frames[1][:-1] + b"\xfe") + frames[3])) == [None, whole[3]]
    spoilt = bytearray(tx)
    spoilt[20] ^= 1
    assert list(codec.parse(bytes(spoilt) + frames[3])) == [None, whole[3]]
    assert [x for x in codec.parse(frames[0] + b"junk\xff" + frames[3]) if x] == [whole[0], whole[3]]
    # What isn't a change is broken: unknown tags, pointers, keys longer than their payload, nothing at all.
    for body in (b"\x80\0\0\0\x09key", b"\x7fkey", b"\x82" + bytes(12) + b"k", b"\x84\0\0", b""):
        assert list(codec.parse(framed(body) + frames[0])) == [None, whole[0]]
    files = spark.createDataFrame([("x", bytearray(frames[0] + frames[1][:-4])), ("y", bytearray(b"")), ("z", None)], "path string, content binary")
    got = wal.replay(files).collect()
    assert [(bytes(r.key), bytes(r.value)) for r in got if not r.broken] == [(b"a", b"1")] and sum(r.broken for r in got) == 1


def test_bloom(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    b = bloom.build(keys, 3000)
    assert bloom.contains(keys, b, 3000).where("maybe").count() == 3000
    other = spark.range(10000, 13000).select(F.col("id").cast("string").alias("key"))
    assert bloom.contains(other, b, 3000).where("maybe").count() < 3000 * 0.03


def test_bloom_as_binary_and_growing(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    b = bloom.build(keys, 3000)
    told = bloom.size(b, 3000).first()
    assert told.bits == codec.bloom_bits(3000)[0] and abs(told["keys"] - 3000) < 90
    binary = bloom.encode(b, 3000)
    again = bloom.decode(binary, 3000)
    assert sorted((r.bucket, bytes(r.bitmap)) for r in again.collect()) == sorted((r.bucket, bytes(r.bitmap)) for r in b.collect())
    for spoilt, n in ((binary.select(F.expr("overlay(encoded placing X'00' from 40)").alias("encoded")), 3000), (binary, 2999)):
        with pytest.raises(Exception, match="a broken filter"):
            bloom.decode(spoilt, n).collect()
    grown = bloom.ScalableBloom(first=500).add(keys.where("key < 400"), 400).add(keys, 3000)
    assert grown.contains(keys).where("maybe").count() == 3000 and grown.capacity() >= 3400 and grown.false_positives() <= 0.01
    other = spark.range(10000, 13000).select(F.col("id").cast("string").alias("key"))
    assert grown.contains(other).where("maybe").count() < 3000 * 0.03


def test_bloom_bits(spark):
    """The blocks have the bits of their keys and no others, and a key is found just when all of its bits are set."""
    keys = spark.range(12000).select(F.col("id").cast("string").alias("key"))
    other = spark.range(20000, 32000).select(F.col("id").cast("string").alias("key"))
    (bits, hashes), b = codec.bloom_bits(12000), bloom.build(keys.union(keys), 12000)
    blocks = -(-bits // codec.BLOOM_BLOCK)
    at = lambda k: k.select("key", codec.bloom_block(F.col("key"), F.lit(blocks)).alias("block"), codec.bloom_positions(F.col("key"), F.lit(bits // blocks), F.lit(hashes)).alias("bits")).collect()
    want = {(r.block, p) for r in at(keys) for p in r.bits}
    assert blocks == 4 and {(r.bucket, p) for r in b.collect() for p in range(8 * len(r.bitmap)) if r.bitmap[p // 8] >> p % 8 & 1} == want
    got = {r.key: r.maybe for r in bloom.contains(other.union(other), b, 12000).collect()}
    assert got == {r.key: all((r.block, p) in want for p in r.bits) for r in at(other)} and 0 < sum(got.values()) < 12000 * 0.015
    # A binary of the form without the bits of a block, whose keys are elsewhere, isn't taken for a filter.
    former = bloom.encode(b, 12000).select(codec.frame(F.expr("concat(substring(encoded, 9, 12), substring(encoded, 25, 4104))")).alias("encoded"))
    with pytest.raises(Exception, match="a broken filter"):
        bloom.decode(former, 12000).collect()


def test_growing_bloom_tests_a_key_once_an_add(spark):
    """However many slices an add takes, its keys are dealt once to be added and once to be tested, and over small filters evenly."""
    keys = spark.range(20000).select(F.col("id").cast("string").alias("key"))
    plans = []
    for first in (1, 1 << 16):
        grown = bloom.ScalableBloom(first=first).add(keys.where("key < 300"), 300).add(keys, 20000)
        assert grown.contains(keys).where("not maybe").count() == 0
        other = spark.range(50000, 70000).select(F.col("id").cast("string").alias("key"))
        assert grown.contains(other).where("maybe").count() < 20000 * 0.01
        plans.append(grown.contains(keys)._jdf.queryExecution().executedPlan().toString().count("Exchange "))
    assert plans[0] == plans[1]
    small = bloom.ScalableBloom(first=64).add(keys.where("key < 300"), 300)
    assert sum(len(g) for _, g in small.groups) == 3
    most = bloom._dealt(keys, [g for _, g in small.groups]).groupBy("slice", "bucket", "copy").count().agg(F.max("count")).first()[0]
    assert most < 20000 * 0.02


def test_page_dictionaries(spark):
    pairs = spark.createDataFrame([(i, str(i)) for i in range(0, 400, 3)] + [(9, "z")], "key long, value string")
    by = F.floor(F.col("key") / 50)
    pages = reads.dict_build(pairs, by)
    assert sorted((r.key, r.value) for r in reads.dict_entries(pages).collect()) == [(i, str(i)) for i in range(0, 400, 3)]
    probes = spark.createDataFrame([(i,) for i in (*range(0, 60), 399, 400, 5000)], "key long")
    assert {r.key: r.value for r in reads.dict_find(pages, probes, by).collect()} == {i: str(i) if i % 3 == 0 and i < 400 else None for i in (*range(0, 60), 399, 400, 5000)}


def test_fold_stops(spark):
    t = rows(spark, [(bytes([i]), b"v", i, None) for i in range(20)])
    seen = lambda k, v, acc: acc + [k[0]]
    assert reads.fold_iter(t, KeyRange(), seen, [], until=lambda a: len(a) == 3) == [0, 1, 2]
    assert reads.fold_iter(t, KeyRange(limit=5), seen, [], reverse=True) == [4, 3, 2, 1, 0]
    assert reads.fold_iter(t, KeyRange(), seen, [9], until=lambda a: a == [9]) == [9]


def test_lifetimes_and_timed_commits(spark, tmp_path):
    s = KvStore.open(spark, str(tmp_path / "t"), {"sync_seconds": 1.0})
    s.put(b"never", b"1", ttl=0)
    s.put(b"long", b"1", ttl=1000)
    assert s.versions() == []
    for _ in range(100):
        if s.versions():
            break
        time.sleep(0.2)
    # A timer has committed both; a fold that stops sees them in order.
    assert len(s.versions()) == 1 and s.get(b"never", int(time.time()) + 10**6) == b"1"
    assert s.get(b"long") == b"1" and s.get(b"long", int(time.time()) + 2000) is None
    assert s.fold_range(lambda k, v, a: a + [k], [], KeyRange(), until=lambda a: len(a) == 1) == [b"long"]
    s.close()


def test_levels_by_size_and_catch_up(spark, tmp_path):
    path = str(tmp_path / "l")
    s = KvStore.open(spark, path, {"max_runs": 2, "min_run_rows": 4})
    for n in range(6):
        s.put_df(rows(spark, [(bytes([n, i]), b"v", i, None) for i in range(3)]))
        runs = s.manifest().runs
        assert all(r.rows <= s.capacity(r.level) for r in runs) and len({r.level for r in runs}) == len(runs)
    s.put_df(rows(spark, [(bytes([0, i]), b"w", i, None) for i in range(3)]))
    small = KvStore.open(spark, str(tmp_path / "s"), {"max_runs": 2, "min_run_rows": 100})
    for n in range(3):
        small.put_df(rows(spark, [(b"k", b"%d" % n, 0, None)]))
    # What fits stays at its level.
    assert [(r.level, r.rows) for r in small.manifest().runs] == [(0, 1)] and small.get(b"k") == b"2"
    lazy = KvStore.open(spark, path, {"max_runs": 9, "min_run_rows": 4})
    for n in range(3):
        lazy.put_df(rows(spark, [(bytes([9, n]), b"v", 0, None)]))
    assert lazy.unmerged_count() > 0
    again = KvStore.open(spark, path, {"max_runs": 2, "min_run_rows": 4})
    assert again.unmerged_count() == 0 and again.state().count() == 21
    assert [parse_level(x) for x in ("A-12.data", "M-3.data", "A-12.data.x", "12", "A-.data")] == [12, 3, None, None, None]


def test_crash_between_run_and_manifest(spark, tmp_path, monkeypatch):
    """Whether a put or a merge stops after its run is written: the state is that of the last manifest, and vacuum removes the rest."""
    s = KvStore.open(spark, str(tmp_path / "c"), {"max_runs": 3})
    s.put(b"a", b"1")
    s.put(b"b", b"1")

    def stop(*_):
        raise OSError("stopped")

    for act in (lambda: s.put(b"c", b"1"), lambda: s.compact()):
        with monkeypatch.context() as m:
            m.setattr(KvStore, "_commit", stop)
            with pytest.raises(OSError):
                act()
    again = KvStore.open(spark, str(tmp_path / "c"))
    assert pairs(again.state()) == [(b"a", b"1"), (b"b", b"1")]
    assert len(again.vacuum()) == 2 and pairs(again.state()) == [(b"a", b"1"), (b"b", b"1")]
    again.put(b"c", b"2")
    assert again.get(b"c") == b"2"


def test_broken_pages_fail(spark, tmp_path):
    s = KvStore.open(spark, str(tmp_path / "p"), {"bloom": False})
    s.put(b"key", b"a value that stands in the page " * 20)
    file = next((tmp_path / "p").glob("runs/*/part-*.parquet"))
    data = bytearray(file.read_bytes())
    data[data.index(b"a value that") + 3] ^= 1
    file.write_bytes(bytes(data))
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt|verif"):
        s.state().collect()


def test_batches_need_an_order(spark, tmp_path):
    s = KvStore.open(spark, str(tmp_path / "q"))
    with pytest.raises(ValueError, match="seq"):
        s.put_df(spark.createDataFrame([(bytearray(b"a"), bytearray(b"1"))], "key binary, value binary"))
    with pytest.raises(ValueError):
        s.put_df(rows(spark, [(b"x" * 70_000, b"", 1, None)]))
    assert not list((tmp_path / "q").glob("runs/*"))


def test_streams(spark, tmp_path):
    """A state table of many batches, merged on the way; an empty stream; a batch that comes twice."""
    source, schema = tmp_path / "in", CHANGES
    source.mkdir()
    stream = lambda: ingest.change_stream(spark, str(source), schema)
    assert ingest.ingest_state(stream(), str(tmp_path / "e"), str(tmp_path / "ec")).count() == 0
    for n in range(5):
        rows(spark, [(bytes([i]), b"%d" % n, 10 * n + i, None) for i in range(n, n + 3)]).coalesce(1).write.mode("append").parquet(str(source))
    state = ingest.ingest_state(stream(), str(tmp_path / "o"), str(tmp_path / "oc"), every=2)
    want = [(bytes([i]), b"%d" % min(i, 4)) for i in range(7)]
    assert pairs(state) == want
    table = ingest.StateTable(spark, str(tmp_path / "o"), schema)
    table.add(spark.read.schema(schema).parquet(str(source)), 5, every=2)
    table.add(spark.read.schema(schema).parquet(str(source)), 5, every=2)
    assert pairs(table.rows()) == want
    store = KvStore.open(spark, str(tmp_path / "k"))
    ingest.ingest(stream(), store, str(tmp_path / "kc")).awaitTermination()
    assert store.state().count() == 7


def test_options(spark, tmp_path):
    assert get_opt("max_runs", {"max_runs": 7}) == 7 and get_opt("max_runs", {}, spark, 4) == 4
    spark.conf.set("spark.keytide.max_runs", "9")
    assert KvStore(spark, str(tmp_path / "o")).opts.max_runs == 9
    spark.conf.unset("spark.keytide.max_runs")
    for name, text, value in (("bloom", "false", False), ("bloom", "True", True), ("sync_seconds", "5", 5.0), ("min_run_rows", "7", 7)):
        spark.conf.set(f"spark.keytide.{name}", text)
        assert getattr(KvStore(spark, str(tmp_path / "o")).opts, name) == value
        spark.conf.unset(f"spark.keytide.{name}")
    assert KvStore(spark, str(tmp_path / "o")).opts.sync_seconds is None
    with pytest.raises(ValueError):
        KvStore(spark, str(tmp_path / "o"), {"compression": "zip"})
    for c in ("none", "gzip", "snappy", "lz4"):
        s = KvStore(spark, str(tmp_path / c), {"compression": c})
        s.put(b"a", c.encode())
        assert s.get(b"a") == c.encode()
    with pytest.raises(ValueError):
        s.put(b"x" * 70_000, b"")


def test_plans(spark, sf):
    """Key filters reach the scan below the choice of versions; a limited scan is a top-k."""
    from keytide.plans.catalog import changes

    log = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "value", F.lit(False).alias("is_delete"), F.lit(None).cast("long").alias("expire_at"))
    plan = resolve.state(log, 0).where("key = 7")._jdf.queryExecution().toString()
    assert "EqualTo(user_id,7)" in plan
    assert "TakeOrderedAndProject" in reads.scan(resolve.state(changes(spark, sf), 0), KeyRange(limit=5))._jdf.queryExecution().toString()


def test_merge_budget(spark, tmp_path):
    """A commit merges the oldest runs of a level as far as the budget of rows goes, two at least; nothing older comes back."""
    s = KvStore.open(spark, str(tmp_path / "s"), {"max_runs": 4, "merge_strategy": "predictable", "merge_rows": 5})
    for i in range(3):
        s.transact([("put", b"a", b"%d" % i), ("put", b"b%d" % i, b"x")])
    s.transact([("delete", b"a"), ("put", b"c", b"y")])
    runs = s.manifest().runs
    # Of four runs of two rows the two oldest make one of three rows (a counts once).
    assert sorted(r.rows for r in runs) == [2, 2, 3] and min(runs, key=lambda r: r.min_seq).rows == 3
    assert s.get(b"a") is None and {bytes(r.key) for r in s.state().collect()} == {b"b0", b"b1", b"b2", b"c"}
    assert s._within_budget(list(runs)) == sorted(runs, key=lambda r: r.min_seq)[:2]
    with pytest.raises(ValueError):
        KvStore.open(spark, str(tmp_path / "t"), {"merge_rows": -1})
