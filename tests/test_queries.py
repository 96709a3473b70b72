"""Every query with SQL against DuckDB on the same tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e
from keytide.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf, f"{t}.parquet")
        if p.exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_query_equals_sql(name, spark, sf, duck):
    df = e.queries()[name](spark, sf)
    want = duck.execute(e.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), names)


def test_entry(spark):
    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    assert e.entry(spark).count() > 0


def test_crc_frame(spark, sf):
    """Length, checksum, end byte and the payload of each frame."""
    import zlib

    log = {r.seq: r for r in catalog.changes(spark, sf, "key").collect()}
    for r in e.queries()["crc_frame"](spark, sf).limit(200).collect():
        f, c = bytes.fromhex(r.frame), log[r.seq]
        key, expiry = c.key.encode(), b"" if c.expire_at is None else c.expire_at.to_bytes(4, "big")
        tag = (0x81 if c.is_delete else 0x80) + (0 if c.expire_at is None else 4)
        body = f[8:-1]
        assert int.from_bytes(f[:4], "big") == len(body) and f[-1] == 0xFF and zlib.crc32(body) == int.from_bytes(f[4:8], "big")
        head = bytes([tag]) + expiry + (key if c.is_delete else len(key).to_bytes(4, "big") + key)
        assert body.startswith(head) and (body == head if c.is_delete else float(body[len(head) :]) == c.value)
        assert r.sound and not r.torn_sound
