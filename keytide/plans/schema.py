"""The one physical schema of a change log, and how to make keys and changes.

A change is a put or a delete of a key. ``seq`` is a total order of all writes: of two changes of a key
the one with the higher ``seq`` counts. ``expire_at`` is in epoch seconds; null means never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGES = T.StructType([
    T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType()), T.StructField("is_delete", T.BooleanType(), False),
    T.StructField("seq", T.LongType(), False), T.StructField("tx_id", T.LongType()), T.StructField("expire_at", T.LongType()),
])
COLUMNS = CHANGES.names
MAX_KEY = 65_535


def int_key(c: Column) -> Column:
    """Eight big-endian bytes; bytewise order is the order of non-negative integers."""
    return F.to_binary(F.lpad(F.hex(c.cast("long")), 16, F.lit("0")), F.lit("hex"))


def padded_key(c: Column, width: int = 12) -> Column:
    """Decimal digits with leading zeros, readable and in order."""
    return F.lpad(c.cast("string"), width, F.lit("0"))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def lifetime(key_ttl: Column | None, store_ttl: int | None) -> Column:
    """Seconds to live: the shorter of what is set; null and 0 mean no limit."""
    sides = [F.nullif(c, F.lit(0).cast("long")) for c in (F.lit(None).cast("long") if key_ttl is None else key_ttl.cast("long"), F.lit(store_ttl).cast("long"))]
    return F.least(*sides)


def as_changes(df: DataFrame, *, key: Column, seq: Column, value: Column | None = None, is_delete: Column | None = None, now: Column | None = None, key_ttl: Column | None = None, store_ttl: int | None = None, tx_id: Column | None = None) -> DataFrame:
    """Rows of any table as changes. Key and value keep their type (the store wants binary)."""
    gone = F.coalesce(is_delete if is_delete is not None else F.lit(False), F.lit(False))
    clock = now if now is not None else F.unix_timestamp()
    return df.select(
        key.alias("key"), F.when(~gone, value if value is not None else F.lit(None)).alias("value"), gone.alias("is_delete"), seq.cast("long").alias("seq"),
        (tx_id if tx_id is not None else F.lit(None)).cast("long").alias("tx_id"), (clock + lifetime(key_ttl, store_ttl)).cast("long").alias("expire_at"),
    )


def entry_size(key: Column, value_bytes: Column) -> Column:
    """Bytes of a key and its value."""
    return F.octet_length(key) + value_bytes


def level_of(name: Column) -> Column:
    """Level of a run that a file name like ``A-12.data`` tells; null for other names."""
    return F.nullif(F.regexp_extract(name, r"^[^0-9]+-([0-9]+)\.data$", 1), F.lit("")).cast("int")
